"""Substring dedup by De Bruijn compaction.

Every window of WINDOW words is an edge between its first and its last WINDOW - 1 words. Consecutive edges with one
minimizer (the least hash of MINI neighbouring words in the window) travel together to the bucket of that minimizer, so
equal edges meet whatever document they come from, at a few bytes an edge; of edges that one slice of input repeats, only
the first goes out. A bucket finds for every edge the place where it starts first, its source, and sends runs of edges
whose sources advance in step: the graph's arcs. An arc's nodes are named by source coordinates, and their degrees are
counted over distinct arcs. Where a single arc comes in and a single one goes out, the two are one nonbranching path:
joins that double their reach lead every arc to the head of its path, and a document's runs along a path become one span.

Buckets tell edges by hashes, so a span is only a candidate. Each document that takes part digests the words (SHA-256) of
its spans and of those that others take from it; a path whose digests are not all one is taken apart, and its windows are
told by their words. No word goes, or stays, for a hash of 64 bits or less.

Defined cases: null, empty and blank texts have no words; a text shorter than a window has no edges; equal windows in one
document count as repeats of the earlier start, overlapping ones included; rows repeated under one id are one document at
the same places, so none is a repeat of the other, and where their texts differ each loses only words that start earlier
elsewhere; a null id sorts before all others; other columns pass through, but a column named cut is replaced.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.llm.common import arrow_schema, batch, free, hashes, mixed, run_hashes, sliced, steps, words, written

MINI = 4
#: Bytes of text whose edges one bucket gets, about.
BUCKET_BYTES = 4 << 20
SLICE_BYTES = 4 << 20
#: Bytes of text whose words and spans are cut together.
CUT_BYTES = 1 << 20
#: Bits of an edge's hash within its minimizer's bucket.
EDGE_BITS = 48
NULL_ID = -(1 << 63)
_EDGES, _PATHS = 0, 1
ROWS = "bucket int, kind int, body binary"
PATHS = "doc bigint, start int, n int, src_doc bigint, src_start int"
_path = np.dtype([("doc", "<i8"), ("start", "<i4"), ("n", "<i4"), ("src_doc", "<i8"), ("src_start", "<i4")])


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of every n neighbours."""
    size, out = 1, x
    while size * 2 <= n:
        out = np.minimum(out[: len(out) - size], out[size:])
        size *= 2
    rest = n - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _paths(doc, start, src_doc, src_start) -> np.ndarray:
    """Joins consecutive edges with consecutive sources."""
    if not len(doc):
        return np.zeros(0, _path)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (src_doc[1:] != src_doc[:-1]) | (start[1:] != start[:-1] + 1) | (src_start[1:] != src_start[:-1] + 1)
    at = np.flatnonzero(new)
    out = np.zeros(len(at), _path)
    out["doc"], out["start"], out["src_doc"], out["src_start"] = doc[at], start[at], src_doc[at], src_start[at]
    out["n"] = np.diff(np.append(at, len(doc)))
    return out


def _six(x: np.ndarray) -> np.ndarray:
    """The low six bytes of each value."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :6]


def _sent(ids: np.ndarray, texts: pa.Array, window: int, buckets: int, bits: int):
    """(bucket, kind, body) rows of a slice."""
    codes, offsets, distinct = words(texts)
    if len(codes) < window:
        return
    h = hashes(distinct)[codes]
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    edge = run_hashes(h, window) & np.uint64((1 << bits) - 1)
    mini = _least(run_hashes(mixed(h), MINI) & np.uint64((1 << 48) - 1), window - MINI + 1)[: len(edge)]
    inside = np.flatnonzero(doc[: len(edge)] == doc[window - 1 :])
    if not len(inside):
        return
    edge, mini, doc = edge[inside], mini[inside], doc[inside]
    place = (inside - offsets[doc]).astype(np.int32)
    ids = ids[doc]
    # of the edges that the slice repeats, the one that starts first goes out
    order = np.lexsort((place, ids)) if (np.diff(ids) < 0).any() else None
    key = _keys(mini, edge)
    if order is not None:
        key = key[order]
    _, first, back = np.unique(key, return_index=True, return_inverse=True)
    first = first[back]
    if order is not None:
        to = np.empty_like(order)
        to[order] = order[first]
        first = to
    own = np.arange(len(edge))
    again = first != own
    repeats = own[again]
    found = _paths(ids[repeats], place[repeats], ids[first[repeats]], place[first[repeats]])
    found = found[(found["doc"] != found["src_doc"]) | (found["start"] != found["src_start"])]
    if len(found):
        yield int(mixed(np.array([edge[0]]))[0] % np.uint64(buckets)), _PATHS, found.tobytes()
    keep = own[~again]
    edge, mini, ids, place = edge[keep], mini[keep], ids[keep], place[keep]
    new = np.ones(len(keep), bool)
    new[1:] = (mini[1:] != mini[:-1]) | (ids[1:] != ids[:-1]) | (place[1:] != place[:-1] + 1)
    new |= np.arange(len(keep)) % 200 == 0  # a run's length is a byte
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(keep)))
    spread = mixed(mini[at] ^ np.uint64(0xA5A5A5A5))
    bucket = (spread % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    at, n, bucket, minis = at[order], n[order], bucket[order], mini[at[order]]
    total = np.cumsum(n)
    edges = edge[np.repeat(at - (total - n), n) + np.arange(total[-1])]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    six = _six(minis)
    for a, b in zip([0, *cuts], [*cuts, len(at)], strict=True):
        head = np.array([b - a], np.int32)
        parts = (head, ids[at[a:b]], place[at[a:b]], n[a:b].astype(np.uint8), six[a:b], _six(edges[total[a] - n[a] : total[b - 1]]))
        yield int(bucket[a]), _EDGES, b"".join(x.tobytes() for x in parts)


def _keys(mini: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """What tells edges, in a slice as in a bucket: else a slice would keep back edges that belong to another bucket."""
    return mixed(mini * np.uint64(0xD6E8FEB86659FD93) + edge)


def _wide(body: bytes, at: int, n: int) -> np.ndarray:
    """n values of six bytes each."""
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :6] = np.frombuffer(body, np.uint8, 6 * n, at).reshape(n, 6)
    return wide.view(np.uint64).ravel()


def _met(bodies: list) -> np.ndarray:
    """Paths of the repeated edges of a bucket."""
    ids, place, n, mini, edge = [], [], [], [], []
    for body in bodies:
        k = int(np.frombuffer(body, np.int32, 1)[0])
        at = 4
        ids.append(np.frombuffer(body, np.int64, k, at))
        place.append(np.frombuffer(body, np.int32, k, at + 8 * k))
        n.append(np.frombuffer(body, np.uint8, k, at + 12 * k))
        mini.append(_wide(body, at + 13 * k, k))
        edge.append(_wide(body, at + 19 * k, int(n[-1].sum(dtype=np.int64))))
    ids, place, n, mini, edge = (np.concatenate(x) for x in (ids, place, n, mini, edge))
    n = n.astype(np.int64)
    order = np.lexsort((place, ids))
    begins = np.cumsum(n) - n
    ids, place, n, mini, begins = ids[order], place[order], n[order], mini[order], begins[order]
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    key = _keys(np.repeat(mini, n), edge[np.repeat(begins, n) + step])
    sorted_at = np.argsort(key, kind="stable")
    ordered = key[sorted_at]
    lead = np.ones(len(ordered), bool)
    lead[1:] = ordered[1:] != ordered[:-1]
    first = np.empty(len(key), np.int64)
    first[sorted_at] = np.repeat(sorted_at[lead], np.diff(np.append(np.flatnonzero(lead), len(key))))
    again = np.flatnonzero(first != np.arange(len(key)))
    first = first[again]
    ids, place = np.repeat(ids, n), np.repeat(place, n) + step.astype(np.int32)
    out = _paths(ids[again], place[again], ids[first], place[first])
    return out[(out["doc"] != out["src_doc"]) | (out["start"] != out["src_start"])]


def arcs(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = 20, bits: int = EDGE_BITS) -> DataFrame:
    """Arcs as documents run along them (doc, start, n, src_doc, src_start): by their hashes, the n windows from word
    `start` of doc repeat those from word src_start of src_doc, which start first (or earlier, where the repeat lies in one
    slice of input)."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    buckets = max(1, -(-size // BUCKET_BYTES))
    schema = arrow_schema(ROWS)

    def send(b: pa.RecordBatch) -> pa.RecordBatch | None:
        rows = list(_sent(b.column(0).to_numpy(zero_copy_only=False), b.column(1), window, buckets, bits))
        return batch(schema, *zip(*rows, strict=True)) if rows else None

    sent = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("doc"), F.col(text).alias("text")).mapInArrow(sliced(send, "text", SLICE_BYTES), ROWS)
    found = arrow_schema(PATHS)

    def given(p: np.ndarray) -> pa.RecordBatch:
        return batch(found, *(np.ascontiguousarray(p[c]) for c in _path.names))

    def meet(batches):
        bucket, bodies = None, []
        for b in batches:
            for k, kind, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if k != bucket:
                    if bodies:
                        yield given(_met(bodies))
                    bucket, bodies = k, []
                if kind == _EDGES:
                    bodies.append(body.as_py())
                else:
                    yield given(np.frombuffer(body.as_py(), _path))
        if bodies:
            yield given(_met(bodies))

    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-buckets // 8))
    return sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, PATHS)


def _heads(runs: DataFrame) -> DataFrame:
    """(src_doc, src_start, n, head, head_n) of each distinct arc that a nonbranching node joins to the one before it: the
    arc at the head of its path. Each round of joins doubles the reach of all links."""
    distinct = written(runs.select("src_doc", "src_start", "n").distinct(), "arcs")
    into = distinct.select("src_doc", (F.col("src_start") + F.col("n")).alias("node"), F.lit(1).alias("in"), F.lit(0).alias("out"), F.col("src_start").alias("head"), F.col("n").alias("head_n"))
    out = distinct.select("src_doc", F.col("src_start").alias("node"), F.lit(0).alias("in"), F.lit(1).alias("out"), F.lit(None).cast("int").alias("head"), F.lit(None).cast("int").alias("head_n"))
    nodes = into.union(out).groupBy("src_doc", "node").agg(F.sum("in").alias("in"), F.sum("out").alias("out"), F.max("head").alias("head"), F.max("head_n").alias("head_n"))
    links = written(distinct.join(nodes.filter("`in` = 1 AND out = 1").select("src_doc", F.col("node").alias("src_start"), "head", "head_n"), ["src_doc", "src_start"]), "links")
    while True:
        above = links.select("src_doc", F.col("src_start").alias("head"), F.col("n").alias("head_n"), F.col("head").alias("next"), F.col("head_n").alias("next_n"))
        reach = links.select("src_doc", "src_start", "n", "head", "head_n").join(above, ["src_doc", "head", "head_n"], "left")
        links = written(reach.select("src_doc", "src_start", "n", F.coalesce("next", "head").alias("head"), F.coalesce("next_n", "head_n").alias("head_n"), F.col("next").isNotNull().alias("moved")), "links")
        if links.filter("moved").isEmpty():
            return links.drop("moved")


def repeated_paths(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = 20, bits: int = EDGE_BITS) -> DataFrame:
    """Candidate spans (doc, start, n, src_doc, src_start), as arcs, along whole nonbranching paths."""
    runs = written(arcs(docs, key=key, text=text, window=window, bits=bits), "runs")
    on = runs.join(_heads(runs), ["src_doc", "src_start", "n"], "left").withColumn("shift", F.col("src_start") - F.col("start"))
    along = on.groupBy("doc", "src_doc", "shift", F.coalesce("head", "src_start").alias("head"), F.coalesce("head_n", "n").alias("head_n"))
    parts = along.agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("n")).alias("end"), F.sum("n").alias("all"), F.collect_list(F.struct("start", "n")).alias("parts"))
    # a document that leaves a path and comes back at the same shift keeps its runs apart
    whole = F.array(F.struct("start", F.col("all").cast("int").alias("n")))
    spans = parts.select("doc", "src_doc", "shift", F.inline(F.when(F.col("all") == F.col("end") - F.col("start"), whole).otherwise(F.col("parts"))))
    return spans.select("doc", "start", "n", "src_doc", (F.col("start") + F.col("shift")).alias("src_start"))


SPAN = "start int, n int, src_doc bigint, src_start int, gone boolean, expected binary"
CUT = "struct<n_words: bigint, n_removed: bigint, kept_sha256: string, kept: string, found: array<binary>>"


def _cutter(window: int, with_text: bool):
    """A function of texts and their spans: what is left, and the digest of each span's words. Spans that are `gone` take
    their words with them, if the digest is the expected one or none is expected."""

    @F.arrow_udf(CUT)
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [], [], []
        for i, j in steps(texts, CUT_BYTES):
            split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(texts.slice(i, j - i), "")))
            flat = split.flatten()
            real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))])
            part = spans.slice(i, j - i)
            per = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            of = np.repeat(np.arange(j - i), per)
            rows = part.flatten()
            start, n = (rows.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1))
            begin = np.minimum(offsets[of] + start, offsets[of + 1])
            end = np.minimum(begin + n + window - 1, offsets[of + 1])
            # all words in a row, a blank after each
            at = np.concatenate([[0], np.cumsum(pc.binary_length(flat.cast(pa.binary())).to_numpy(zero_copy_only=False).astype(np.int64) + 1)])
            row = pa.ListArray.from_arrays(pa.array([0, len(flat) + 1], pa.int32()), pa.concat_arrays([flat, pa.array([""])]))
            raw = memoryview(pc.binary_join(row, " ")[0].as_buffer())
            found = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(at[begin].tolist(), at[end].tolist(), strict=True)]
            gone = rows.field(4).to_numpy(zero_copy_only=False).astype(bool)
            gone &= np.fromiter((e is None or e == f for e, f in zip(rows.field(5).to_pylist(), found, strict=True)), bool, len(found))
            marks = np.zeros(len(flat) + 1, np.int64)
            np.add.at(marks, begin[gone], 1)
            np.add.at(marks, end[gone], -1)
            cover = np.cumsum(marks[:-1]) > 0
            stays = real & ~cover
            count = lambda m: np.diff(np.concatenate([[0], np.cumsum(m)])[offsets])  # noqa: B023, E731
            kept = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(stays)])[offsets], pa.int32()), flat.filter(pa.array(stays)))
            joined = pc.binary_join(kept, " ")
            out[0].append(count(real))
            out[1].append(count(cover & real))
            out[2].extend(hashlib.sha256(x).hexdigest() for x in joined.cast(pa.binary()).to_pylist())
            out[3].extend(joined.to_pylist() if with_text else [None] * (j - i))
            ends = np.concatenate([[0], np.cumsum(per)])
            out[4].extend(found[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))
        columns = [pa.array(np.concatenate(out[0])), pa.array(np.concatenate(out[1])), pa.array(out[2], pa.string()), pa.array(out[3], pa.string()), pa.array(out[4], pa.list_(pa.binary()))]
        return pa.StructArray.from_arrays(columns, ["n_words", "n_removed", "kept_sha256", "kept", "found"])

    return cut.asNondeterministic()


def _windows(window: int):
    """A function of a text and starts: the windows there."""

    @F.udf("array<struct<at: int, words: string>>")
    def windows(text: str | None, starts: list[int]):
        found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        return [(i, " ".join(found[i : i + window])) for i in starts if i + window <= len(found)]

    return windows


def without_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = 20, with_text: bool = True, bits: int = EDGE_BITS) -> DataFrame:
    """docs with a struct column `cut`: n_words, n_removed, the digest of the words that stay (joined by one blank) and,
    with_text, these words; without, the text is left out. Results don't depend on bits."""
    doc, spans = free(docs, "doc", "spans")
    named = docs.withColumn(doc, F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)))
    paths = written(repeated_paths(docs, key=key, text=text, window=window, bits=bits), "spans")
    unit = ["src_doc", "src_start", "n"]
    span = F.expr("struct(start, n, src_doc, src_start, gone, expected)").cast(f"struct<{SPAN}>")
    own = paths.withColumn("gone", F.lit(True))
    sources = paths.select(*unit).distinct().select(F.col("src_doc").alias("doc"), F.col("src_start").alias("start"), "n", "src_doc", "src_start", F.lit(False).alias("gone"))
    nothing = F.lit(None).cast("binary").alias("expected")

    def cut(rows: DataFrame, asked: DataFrame, how: str, name: str) -> DataFrame:
        lists = asked.groupBy(F.col("doc").alias(doc)).agg(F.collect_list(span).alias(spans))
        out = rows.join(lists, doc, how).withColumn("cut", _cutter(window, with_text)(F.col(text), F.col(spans)))
        return written(out if with_text else out.drop(text), name)

    done = cut(named, own.unionByName(sources).withColumn("expected", nothing), "left", "cut")
    told = done.select(F.col(doc).alias("doc"), F.inline(F.arrays_zip(F.col(spans).alias("span"), F.col("cut.found").alias("found")))).select("doc", "span.*", "found")
    false = written(told.groupBy(*unit).agg(F.min("found").alias("least"), F.max("found").alias("most")).filter("least <> most").select(*unit), "false")
    if not false.isEmpty():
        # paths that hashes alone had joined: their windows by their words, then the documents that hold any once more
        doubted = told.join(false, unit, "left_semi")
        starts = doubted.select("doc", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("at")).groupBy(F.col("doc").alias(doc)).agg(F.collect_set("at").alias(spans))
        held = written(named.select(doc, text).join(starts, doc).select(F.col(doc).alias("doc"), F.inline(_windows(window)(F.col(text), F.col(spans)))), "windows")
        first = held.groupBy("words").agg(F.min(F.struct("doc", "at")).alias("first"))
        again = held.join(first, "words").filter(F.struct("doc", "at") > F.col("first")).select("doc", F.col("at").alias("start"), F.lit(1).alias("n"), F.lit(None).alias("src_doc"), F.lit(None).alias("src_start"), F.lit(True).alias("gone"), F.unhex(F.sha2(F.concat("words", F.lit(" ")), 256)).alias("expected")).distinct()
        touched = doubted.select("doc").distinct()
        sound = own.join(touched, "doc", "left_semi").join(false, unit, "left_anti").withColumn("expected", nothing)
        here = named.join(touched.select(F.col("doc").alias(doc)), doc, "left_semi")
        mended = cut(here, sound.unionByName(again), "left", "mended")
        done = done.join(touched.select(F.col("doc").alias(doc)), doc, "left_anti").unionByName(mended)
    return done.withColumn("cut", F.col("cut").dropFields("found")).drop(doc, spans)
