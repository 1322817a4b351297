"""The registered queries of the corpus operators, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.llm import ann, bpe, decontaminate, langid, lexical, lines, merkle, near_dup, pieces, quality, substrings, token_counts, warc
from residua.llm.common import held_out, scratch, table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = scratch(spark, "warc")
    warc.write(pages.select(F.col("page_id").alias("id"), "url", F.col("html").cast("binary").alias("payload")), path)
    found = warc.records(warc.read(spark, path, with_chunks=False))
    return found.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


_DIGITS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((g[{i + 1}] // {32 ** (3 - k)}) % 32 + 1)::INT, 1)" for i in range(8) for k in range(4))
OP1_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b)::BIGINT AS n, sha1(b) AS s FROM p),
g AS (SELECT page_id, n, s, list_transform(range(8), lambda i: ('0x' || substr(s, 5 * i::INT + 1, 5))::INT) AS g FROM h),
d AS (SELECT page_id, n, s, {_DIGITS} AS digest FROM g),
w AS (SELECT s, max(page_id) AS best FROM d GROUP BY s)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> best THEN best END AS refers_to
FROM d JOIN w USING (s)
"""


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.matches(docs, table(spark, sf_dir, "benchmark"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = substrings.without_repeats(docs, with_text=False)
    return out.select("doc_id", "cut.n_words", "cut.n_removed", "cut.kept_sha256")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(len(w)))::BIGINT AS i FROM d),
g AS (SELECT doc_id, i, CASE WHEN i + 20 <= len(w) THEN md5(array_to_string(w[i + 1:i + 20], ' ')) END AS h FROM p),
f AS (SELECT doc_id, i, h IS NOT NULL AND row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1 AS again FROM g),
c AS (SELECT doc_id, i, max(CASE WHEN again THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f),
k AS (SELECT c.doc_id, count(*) AS n, sum(gone) AS r, coalesce(string_agg(d.w[c.i + 1], ' ' ORDER BY c.i) FILTER (gone = 0), '') AS kept FROM c JOIN d ON c.doc_id = d.doc_id GROUP BY c.doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(r, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.filter(~held_out()))
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "language.lang_pred", "language.score")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.digest(docs, tokenizer("piece_bpe_32k.model")).select("doc_id", "encoded.*")


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = near_dup.components_of(docs, width=2)
    return found.select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS x FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
t AS (SELECT s.doc_id, s.x, n.n FROM s JOIN n USING (doc_id)),
j AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS shared FROM t a JOIN t b ON a.x = b.x AND a.doc_id < b.doc_id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n) GROUP BY ALL),
e AS (SELECT a, b FROM j WHERE 100 * shared >= 80 * (na + nb - shared) UNION ALL SELECT b, a FROM j WHERE 100 * shared >= 80 * (na + nb - shared)),
r AS (SELECT a AS id, b AS other FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.other = e.a),
c AS (SELECT id, least(id, min(other)) AS component FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component, d.doc_id) AS component_id, coalesce(c.component, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.id = d.doc_id
"""


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count(docs, tokenizer("byte_bpe_50k.tiktoken")).select("doc_id", "tokens.*")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(rows, F.col("vec_id") % 50 == 0).withColumnRenamed("id", "vec_id")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = lines.remove(docs, counts=True)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = """
WITH l AS (
  SELECT doc_id, source, i, line, trim(translate(line, chr(9) || chr(13), '  '), ' ') AS t
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL)),
bad AS (SELECT t FROM l WHERE t <> '' GROUP BY t HAVING count(DISTINCT coalesce(source, chr(0))) >= 10),
m AS (SELECT l.*, bad.t IS NOT NULL AS gone FROM l LEFT JOIN bad USING (t)),
d AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS g, count(*) FILTER (t <> '') AS full_lines,
             coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept FROM m GROUP BY doc_id)
SELECT x.doc_id, coalesce(n, 0)::BIGINT AS n_lines, CASE WHEN g < full_lines THEN g ELSE 0 END::BIGINT AS n_removed,
       CASE WHEN g > 0 AND g < full_lines THEN sha256(kept) ELSE sha256(x.text) END AS kept_sha256
FROM documents x LEFT JOIN d USING (doc_id)
"""


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.train(docs.filter(~held_out()), labels.filter(~held_out()))
    out = quality.score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


OP11_SQL = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
d AS (SELECT doc_id, r, len(w) AS n, w FROM t WHERE len(w) > 0),
g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM d),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
o AS (SELECT r, unnest(w) AS term FROM d),
f AS (SELECT r, term, count(*) AS tf FROM o WHERE term IN (SELECT term FROM i) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, g GROUP BY term, docs),
m AS (SELECT r, doc_id, 10 + (90 * n * docs) // terms AS m FROM d, g),
s AS (SELECT i.item_id, m.doc_id, m.r, sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 8 * m.m)))::BIGINT AS score FROM i JOIN f USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digest(docs, tokenizer("byte_bpe_50k.json")).select("doc_id", "encoded.*")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    changed = [F.translate(c, _UPPER, _LOWER) if c == "text" else F.col(c) for c in merkle.FIELDS]
    manifest = merkle.build(docs, carry={"tampered": F.when(held_out(), merkle.leaf(*changed))})
    found = merkle.proofs(manifest)
    shown = {c: merkle.hexed(F.col(c)) for c in ("leaf", "subroot", "root")}
    out = found.select(F.col("id").alias("doc_id"), *[c.alias(n) for n, c in shown.items()], merkle.hexed(merkle.proof_digest(F.col("segments"))).alias("proof_sha256"), merkle.hexed(merkle.folded(F.coalesce("tampered", "leaf"), F.col("segments"))).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _op13_sql(lower: int = 7, upper: int = 4) -> str:
    """lower, upper: the heights of the trees that the SQL unrolls; it is right for any tree up to these."""
    field = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
    row = lambda text: "sha256(" + " || ".join(field.format(text if c == "text" else c) for c in merkle.FIELDS) + ")"
    crc = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))"
    parts = [f"""d AS (SELECT doc_id, coalesce(source, '') AS src, source IS NOT NULL AS named, {row('text')} AS leaf,
  CASE WHEN doc_id IS NOT NULL AND xor({crc}, 4294967295) % 5 = 0 THEN {row(f"translate(text, '{_UPPER}', '{_LOWER}')")} ELSE {row('text')} END AS folded FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY named, src ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k, count(*) OVER (PARTITION BY named, src) AS n,
  dense_rank() OVER (ORDER BY named, encode(src)) - 1 AS g FROM d),
a0 AS (SELECT g, k AS i, n, leaf AS h FROM r)"""]

    def tree(name: str, levels: int) -> None:
        w = f"(PARTITION BY g, i // {merkle.FANOUT} ORDER BY i ROWS BETWEEN"
        for t in range(levels):
            beside = lambda rows: f"coalesce(string_agg(h, '') OVER {w} {rows}), '')"
            parts.append(f"{name}s{t} AS (SELECT g, i, n, h, {beside('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS l, {beside('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS r FROM {name}{t})")
            parts.append(f"{name}{t + 1} AS (SELECT g, i // {merkle.FANOUT} AS i, any_value((n + {merkle.FANOUT - 1}) // {merkle.FANOUT}) AS n, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {name}{t} GROUP BY g, i // {merkle.FANOUT})")

    tree("a", lower)
    parts.append(f"b0 AS (SELECT 0 AS g, g AS i, (SELECT count(*) FROM a{lower}) AS n, h FROM a{lower})")
    tree("b", upper)
    parts.append("p0 AS (SELECT doc_id, leaf, folded AS f, g, k, k AS i, '' AS s FROM r)")
    step = "SELECT p.* EXCLUDE (f, i, s), CASE WHEN x.n > 1 THEN sha256(x.l || p.f || x.r) ELSE p.f END AS f, p.i // {0} AS i, CASE WHEN x.n > 1 THEN p.s || x.l || x.r ELSE p.s END AS s FROM {1} p JOIN {2} x ON {3} = x.g AND p.i = x.i"
    for t in range(lower):
        parts.append(f"p{t + 1} AS ({step.format(merkle.FANOUT, f'p{t}', f'as{t}', 'p.g')})")
    parts.append(f"q0 AS (SELECT * REPLACE (g AS i) FROM p{lower})")
    for t in range(upper):
        parts.append(f"q{t + 1} AS ({step.format(merkle.FANOUT, f'q{t}', f'bs{t}', '0')})")
    return f"WITH {', '.join(parts)}\nSELECT doc_id, leaf, a.h AS subroot, b.h AS root, sha256(s) AS proof_sha256, f AS folded_root, f = b.h AS verified FROM q{upper} q JOIN a{lower} a USING (g) CROSS JOIN b{upper} b"


OP13_SQL = _op13_sql()


QUERIES = {f.__name__: f for f in (op1_warc, op2_decontamination, op3_substring_dedup, op4_language_id, op5_sentencepiece, op6_near_dup, op7_token_counts, op8_nearest, op9_line_dedup, op10_quality, op11_lexical, op12_bpe, op13_merkle)}
ORACLES = {"op1_warc": OP1_SQL, "op3_substring_dedup": OP3_SQL, "op6_near_dup": OP6_SQL, "op9_line_dedup": OP9_SQL, "op11_lexical": OP11_SQL, "op13_merkle": OP13_SQL}
