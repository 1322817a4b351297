"""Ranked lexical search by an Aho-Corasick scan of the documents, without an index of them.

The distinct terms of the items go to every task as one automaton, each between two guard bytes; a text's separators are
guard bytes too, so that a term is found only as a whole, and the running states count its occurrences straight from the
text. The automaton's outputs map to the items that hold the term. Two scans do it: the first adds up the corpus's figures
(documents, terms, and the documents with each term), the second scores and keeps each item's best of a task. What is sent
on is a row for each term, and `top` rows for each item, of a task. Terms and postings of a pair of scans are bounded by
BLOCK_BYTES; items beyond that go in further blocks, each with scans of its own.

Defined cases: null and empty texts have no terms, are not counted in N and score nothing; rows of one item id are one
item with the terms of all; an item without terms has no rows; a null item id is an item like others; rows of one document
id are documents of their own; of equal scores a null document id comes last; a term that no document holds weighs nothing
for anyone; other columns take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from residua.llm.common import arrow_schema, batch, steps, written

#: Bytes of terms (and 16 a posting) of the items that one pair of scans looks for.
BLOCK_BYTES = 4 << 20
#: Bytes of text that the automaton is given at once.
SCAN_BYTES = 1 << 20
#: Scores held at once, of documents by items.
CELLS = 1 << 22
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of a text as the automaton reads them: letters in lower case, 0 for separators.
_READ = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 0 for b in range(256))
_DOCUMENTS, _TERMS = -1, -2


def terms_of(items: DataFrame, *, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, term) of each item, once each."""
    lowered = F.translate(F.col(text), _LETTERS, _LETTERS.lower())
    return items.select(F.col(key).alias("item"), F.explode(F.split(lowered, SEPARATORS)).alias("term")).filter("term <> ''").distinct()


def blocks_of(terms: DataFrame, most: int = BLOCK_BYTES) -> int:
    """So many blocks, by hash of the item, that none has more than `most` bytes, unless it is of one item."""
    sizes = terms.groupBy("item").agg(F.sum(F.octet_length("term") + 16).alias("size"))
    n = max(1, -(-(sizes.agg(F.sum("size")).first()[0] or 0) // most))
    while not sizes.groupBy(_block(n)).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("items")).filter((F.col("size") > most) & (F.col("items") > 1)).isEmpty():
        n *= 2
    return n


def _block(n: int):
    return F.pmod(F.xxhash64("item"), F.lit(n)).alias("block")


class Terms:
    """A block's terms, and the items (by number) that hold each."""

    def __init__(self, pairs: list[tuple[int, str]]):
        self.terms = sorted({t for _, t in pairs})
        at = {t: i for i, t in enumerate(self.terms)}
        of = np.array([at[t] for _, t in pairs], np.int64)
        order = np.argsort(of, kind="stable")
        self.items = np.array([i for i, _ in pairs], np.int64)[order]
        self.starts = np.searchsorted(of[order], np.arange(len(self.terms) + 1))


@lru_cache(2)
def _automaton(terms: tuple[str, ...]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, t in enumerate(terms):
        out.add_word(f"\0{t.encode().decode('latin-1')}\0", i)  # a character a byte
    out.make_automaton()
    return out


def _scanned(texts: pa.Array, terms: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms in each text; and of each term of `terms` in a text: the text, the term, and its occurrences."""
    texts = pc.fill_null(texts, "")
    stop = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1)  # the guard after each text
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), "\0")[0].as_buffer().to_pybytes()
    data = b"\0%b\0" % whole.translate(_READ)
    inside = np.frombuffer(data, np.uint8) != 0
    begun = np.cumsum(inside[1:] & ~inside[:-1])  # terms begun before a place
    n = np.diff(begun[stop - 1], prepend=0)
    found, at = [np.zeros(0, np.int64)], 0
    while at < len(data) - 1:  # in parts that share a guard
        end = data.find(b"\0", min(at + SCAN_BYTES, len(data) - 1))
        hits = np.fromiter(chain.from_iterable(_automaton(terms).iter(data[at : end + 1].decode("latin-1"))), np.int64)
        found.append(np.searchsorted(stop, hits[::2] + at) * len(terms) + hits[1::2])
        at = end
    pairs, times = np.unique(np.concatenate(found), return_counts=True)
    return n, pairs // max(1, len(terms)), pairs % max(1, len(terms)), times


def _figures(docs: DataFrame, shared) -> DataFrame:
    """(term, count): documents with each term, documents with any, and terms in all."""
    schema = arrow_schema("term int, count bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = tuple(shared.value.terms)
        docs_with, n_docs, n_terms = np.zeros(len(terms), np.int64), 0, 0
        for b in batches:
            for i, j in steps(b.column(1)):
                n, _, term, _ = _scanned(b.column(1).slice(i, j - i), terms)
                docs_with += np.bincount(term, minlength=len(terms))
                n_docs, n_terms = n_docs + int((n > 0).sum()), n_terms + int(n.sum())
        held = np.flatnonzero(docs_with)
        yield batch(schema, np.append(held, [_DOCUMENTS, _TERMS]).astype(np.int32), np.append(docs_with[held], [n_docs, n_terms]))

    return docs.mapInArrow(run, "term int, count bigint").groupBy("term").agg(F.sum("count").alias("count"))


class _Best:
    """Each item's best documents so far."""

    def __init__(self, items: int, top: int):
        self.top, self.least = top, np.zeros(items, np.int64)
        self.rows = [np.zeros(0, np.int64) for _ in range(3)] + [np.zeros(0, bool)]  # item, score, document, whether that is null

    def add(self, scores: np.ndarray, docs: np.ndarray, nulls: np.ndarray) -> None:
        """scores: of documents by items."""
        d, item = np.nonzero((scores > 0) & (scores >= self.least))
        item, score, doc, null = (np.concatenate(x) for x in zip(self.rows, (item, scores[d, item], docs[d], nulls[d]), strict=True))
        order = np.lexsort((doc, null, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        order = order[place < self.top]
        self.rows = [np.sort(item[place < self.top]), score[order], doc[order], null[order]]
        last = place == self.top - 1
        self.least[item[last]] = self.rows[1][np.flatnonzero(np.arange(len(order)) - np.searchsorted(self.rows[0], self.rows[0]) == self.top - 1)]


def _scores(docs: DataFrame, shared, weights, items: int, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(item, score, doc): the best of each task."""
    ddl = "item int, score bigint, doc bigint"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weight, best = shared.value, weights.value, _Best(items, top)
        terms, many = tuple(block.terms), np.diff(block.starts)
        for b in batches:
            ids = b.column(0)
            nulls, ids = ids.is_null().to_numpy(zero_copy_only=False), pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
            for i, j in steps(b.column(1)):
                n, doc, term, tf = _scanned(b.column(1).slice(i, j - i), terms)
                m = np.array([10 + 90 * x * n_docs // max(1, n_terms) for x in n.tolist()], np.int64)  # in Python's integers
                part = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
                width = max(1, CELLS // max(1, items))
                for k in range(0, j - i, width):
                    mine = slice(*np.searchsorted(doc, (k, k + width)))
                    d, t, times = doc[mine] - k, term[mine], many[term[mine]]
                    ends = np.cumsum(times)
                    item = block.items[np.repeat(block.starts[t] - (ends - times), times) + np.arange(ends[-1] if len(ends) else 0)]
                    size = min(width, j - i - k)
                    total = np.zeros(size * items, np.int64)
                    np.add.at(total, np.repeat(d, times) * items + item, np.repeat(part[mine], times))
                    best.add(total.reshape(size, items), ids[i + k : i + k + size], nulls[i + k : i + k + size])
        item, score, doc, null = best.rows
        if len(item):
            yield batch(schema, item.astype(np.int32), score, pa.array(doc, pa.int64(), mask=null))

    return docs.mapInArrow(run, ddl)


def _ranked(rows: DataFrame, group: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def rank(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", top: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score) of the `top` documents of each item with a score above 0."""
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    terms = written(terms_of(items, key=item_key, text=item_text), "lexical-terms")
    n, out = blocks_of(terms, block_bytes), None
    for k in range(n):
        pairs = terms.filter(_block(n) == k).collect()  # of one block, so bounded
        ids = sorted({r.item for r in pairs}, key=lambda x: (x is None, x))
        number = {x: i for i, x in enumerate(ids)}
        block = Terms([(number[r.item], r.term) for r in pairs])
        if not ids:
            continue
        shared = spark.sparkContext.broadcast(block)
        count = {r.term: r["count"] for r in _figures(docs, shared).collect()}
        n_docs, n_terms = count.get(_DOCUMENTS, 0), count.get(_TERMS, 0)
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * count.get(t, 0) + 1))) for t in range(len(block.terms))], np.int64)
        found = _scores(docs, shared, spark.sparkContext.broadcast(weights), len(ids), n_docs, n_terms, top)
        names = spark.createDataFrame(list(enumerate(ids)), f"item int, item_id {terms.schema['item'].dataType.simpleString()}")
        # the tasks' rows of an item meet in parts first, however many tasks there are
        found = _ranked(_ranked(found.withColumn("part", F.spark_partition_id() % 64), ["item", "part"], top), ["item"], top)
        found = found.join(F.broadcast(names), "item").select("item_id", "rank", F.col("doc").alias("doc_id"), "score")
        out = found if out is None else out.union(found)
    if out is None:
        return terms.select(F.col("item").alias("item_id"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    return out
