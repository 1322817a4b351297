"""A corpus pipeline: language ID, line dedup, near-duplicates, decontamination, sentence pieces.

Each stage takes (spark, docs, sf_dir) and works on what its predecessor kept; its result is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.llm import decontaminate, langid, lines, near_dup, pieces
from residua.llm.common import held_out, table, written
from residua.llm.queries import tokenizer

#: A document is rejected if its language can't be told: no letters, or a score below this.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (null and empty texts among them) or with a language that the model is not sure of.
    Rows of one id are each judged by their own text; an empty table stays empty."""
    model = langid.train(docs.filter(~held_out()))
    found = langid.identify(docs, model, into="_language")
    return found.filter((F.col("_language.lang_pred") != "und") & (F.col("_language.score") >= LEAST_SCORE)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes cross-site boilerplate lines out of the texts; n_chars follows, and is null where the text is. Every row stays:
    null texts, null sources (one site of their own) and repeated ids as well, and the texts all of whose lines are
    boilerplate as they are."""
    out = lines.remove(docs)
    return out.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates (five words, 0.8).
    Texts without words are like nothing and stay, as do rows with null ids; rows of one id go or stay together."""
    return near_dup.kept(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item. Null and empty texts hold none and stay; items without words are held by
    none; rows of one id go or stay together, and a row with a null id stays, as nothing names it."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the encoding's digests to each document's id, a row for each row: a null text counts as the empty one."""
    return pieces.digest(docs.select("doc_id", "text"), tokenizer("piece_bpe_32k.model")).select("doc_id", "encoded.*")


STAGES = [
    ("language ID", language),
    ("line dedup", line_dedup),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("sentence pieces", sentence_pieces),
]
#: Language models and latent retrieval cannot be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs
