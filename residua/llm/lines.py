"""Line dedup by distinct-site spread: lines that many sites share are boilerplate and go from every document.

Each line (blanks at its ends trimmed) has a 128-bit hash; HyperLogLog sketches of the sites that show it merge by
aggregation. Lines whose estimate lies near the threshold get an exact distinct count of their (line, site) pairs, the
others are decided by the sketch alone. Everything is DataFrame functions.

Defined cases: a null text has no lines and stays null; blank lines are never counted nor removed; a null site counts as
one site of its own; a line counts once for a site, however often it is repeated there; a document all of whose non-blank
lines are boilerplate is a copy rather than a page with boilerplate, and is left as it is for the document operators; rows
of one id are treated each by its own text; null ids are ids like others; other columns pass through under their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residua.llm.common import free, written

#: Boilerplate lines of which every task gets a list (16 bytes a line); more than these meet the documents' lines by hash.
BROADCAST_LINES = 1 << 18
#: Parts of a line's occurrences where they meet by hash.
SALT = 16


def _trimmed(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, "[\\t\\r]", " "))


def _row(key: str, text: str) -> list[Column]:
    """A row's name: rows of one id and text have one name, as they have the same lines."""
    return [F.xxhash64(F.col(key), F.col(text)).alias("r1"), F.xxhash64(F.lit("row"), F.col(key), F.col(text)).alias("r2")]


def occurrences(docs: DataFrame, key: str, text: str, site: str) -> DataFrame:
    """(r1, r2, at, site, h1, h2) for each non-blank line: its row, position, site and hash."""
    # the row's name is taken before its lines are rows: else the text is hashed once a line
    rows = docs.select(*_row(key, text), F.xxhash64(F.col(site), F.lit("site")).alias("site"), F.split(F.col(text), "\n").alias("lines"))
    lines = rows.select("r1", "r2", "site", F.posexplode("lines").alias("at", "line"))
    lines = lines.select("r1", "r2", "at", "site", _trimmed(F.col("line")).alias("line")).filter("line <> ''")
    return lines.select("r1", "r2", "at", "site", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), "line").alias("h2"))


def boilerplate(docs: DataFrame, *, key: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = 10, lg_k: int = 12) -> DataFrame:
    """(h1, h2) of the lines shown by min_sites sites or more."""
    seen = occurrences(docs, key, text, site).select("h1", "h2", "site")
    band = 5 * 1.04 / (1 << lg_k) ** 0.5  # five standard errors of a sketch
    spread = seen.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites")).filter(F.col("sites") >= min_sites * (1 - band))
    sure = spread.filter(F.col("sites") > min_sites * (1 + band)).select("h1", "h2")
    near = spread.filter(F.col("sites") <= min_sites * (1 + band)).select("h1", "h2")
    # a line's sites are made distinct before they meet: a hot line sends one row for each site and task
    exact = seen.distinct().join(near, ["h1", "h2"]).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("sites")).filter(F.col("sites") >= min_sites)
    return sure.union(exact.select("h1", "h2"))


def remove(docs: DataFrame, *, key: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = 10, lg_k: int = 12, counts: bool = False) -> DataFrame:
    """docs with the boilerplate lines taken out of the text; counts adds n_lines and n_removed (columns of these names
    are replaced)."""
    bad = written(boilerplate(docs, key=key, text=text, site=site, min_sites=min_sites, lg_k=lg_k), "boilerplate")
    r1, r2, at, marks, hit, kept = free(docs, "r1", "r2", "at", "marks", "hit", "kept")
    found = occurrences(docs, key, text, site)
    if bad.count() <= BROADCAST_LINES:
        found = found.join(F.broadcast(bad), ["h1", "h2"])
    else:  # a line that every document shows is SALT keys
        bad = bad.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        found = found.withColumn("salt", (F.pmod("r1", F.lit(SALT))).cast("int")).join(bad, ["h1", "h2", "salt"])
    hits = found.groupBy(F.col("r1").alias(r1), F.col("r2").alias(r2)).agg(F.sort_array(F.collect_set("at")).alias(at))
    # a byte for each line up to the last that goes: to look one up takes no search
    gap = lambda p, k: p - F.when(k > 0, F.get(F.col(at), k - 1)).otherwise(-1) - 1
    hits = hits.withColumn(marks, F.unhex(F.array_join(F.transform(at, lambda p, k: F.concat(F.repeat(F.lit("00"), gap(p, k)), F.lit("01"))), "")))
    own = _row(key, text)
    joined = docs.withColumn(r1, own[0]).withColumn(r2, own[1]).join(hits, [r1, r2], "left")
    lines = F.split(F.col(text), "\n")
    filled = F.size(F.filter(lines, lambda x: _trimmed(x) != ""))
    out = joined.withColumn(hit, F.when(F.col(at).isNotNull(), filled > F.size(at)).otherwise(False))
    stays = lambda x, i: F.substring(F.col(marks), i + 1, F.lit(1)) != F.unhex(F.lit("01"))
    out = out.withColumn(kept, F.when(F.col(hit), F.concat_ws("\n", F.filter(lines, stays))).otherwise(F.col(text)))
    names = [c for c in docs.columns if not (counts and c.lower() in ("n_lines", "n_removed"))]
    more = []
    if counts:
        more = [F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"), F.when(F.col(hit), F.size(at)).otherwise(0).cast("long").alias("n_removed")]
    return out.select(*[F.col(kept).alias(c) if c == text else F.col(c) for c in names], *more)
