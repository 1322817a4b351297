"""Hops, masks and walks on contact graphs."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from residua.functions.ranks import percentile
from residua.operators import sourced
from residua.operators.against import against


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that the cluster shares: spark.checkpoint.dir, or the warehouse where that is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
    return f"{base.rstrip('/')}/graph-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df written to the folder that the cluster shares, which cuts the lineage of a loop. The folder goes when the
    application ends; clear() removes what there is so far."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    place, files = _files(df.sparkSession, path)
    files.deleteOnExit(place)
    _made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_made: list[str] = []


def _files(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def clear(spark: SparkSession) -> int:
    """Removes all that kept() has written so far in this application, when nothing that was made from it is read any more;
    how many folders that were."""
    count = len(_made)
    while _made:
        place, files = _files(spark, _made.pop())
        files.delete(place, True)
    return count


def hops(sources: DataFrame, edges: DataFrame) -> DataFrame:
    """(target, src, i, hop): breadth-first distances from each source (target, i) over edges in both directions, by plain
    searches of a batch of sources in a task that has its target's contacts."""
    return sourced.hops(sources, edges)


def sequence_mask(residues: DataFrame, span: int) -> DataFrame:
    """(target, i, masked): within span of a source along the chain."""
    near = residues.filter("source").select("target", F.explode(F.sequence(F.col("i") - span, F.col("i") + span)).alias("i")).distinct()
    return residues.select("target", "i").join(near.withColumn("masked", F.lit(True)), ["target", "i"], "left").fillna(False, ["masked"])


def shell(residues: DataFrame, edges: DataFrame) -> DataFrame:
    """(target, i): sources and their neighbours."""
    own = residues.filter("source").select("target", "i")
    return own.union(edges.join(own, ["target", "i"], "left_semi").select("target", F.col("j").alias("i"))).distinct()


def distal_sources(values: DataFrame, residues: DataFrame, span: int = 10, size: int = 5, count: int = 1) -> DataFrame:
    """(target, src, concentration, selected): the sum of a source's largest values (target, src, i, c) over residues that
    are no sources and farther than span along the chain; the count largest are selected, ties to the earlier source. A
    source without such residues has no row."""
    far = values.join(residues.filter(~F.col("source")).select("target", "i"), ["target", "i"]).filter(F.abs(F.col("i") - F.col("src")) > span)
    top = far.withColumn("r", F.row_number().over(Window.partitionBy("target", "src").orderBy(F.desc("c"), "i"))).filter(F.col("r") <= size)
    out = top.groupBy("target", "src").agg(F.round(F.sum("c"), 9).alias("concentration"))
    return out.withColumn("selected", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("concentration"), "src")) <= count)


def hop_ranks(values: DataFrame, distances: DataFrame) -> DataFrame:
    """(target, src, i, p): the percentile of values (target, src, i, c) within a source's hop shell; a source itself has 0."""
    rows = values.join(distances, ["target", "src", "i"])
    ranked = rows.filter("hop > 0").withColumn("p", percentile("c", "target", "src", "hop")).select("target", "src", "i", "p")
    return ranked.union(rows.filter("hop = 0").select("target", "src", "i", F.lit(0.0).alias("p")))


def hop_percentiles(values: DataFrame, distances: DataFrame) -> DataFrame:
    """(target, i, score): mean over the sources of a residue's percentiles within their hop shells."""
    return hop_ranks(values, distances).groupBy("target", "i").agg(F.avg("p").alias("score"))


def explained_by_hops(values: DataFrame, distances: DataFrame) -> DataFrame:
    """(target, explained): share of the variance of log10 c that the hop medians explain, between 0 and 1."""
    rows = values.join(distances.filter("hop > 0"), ["target", "src", "i"]).withColumn("v", F.log10(F.greatest("c", F.lit(1e-300))))
    rows = rows.withColumn("rest", F.col("v") - F.median("v").over(Window.partitionBy("target", "src", "hop")))
    out = rows.groupBy("target").agg(F.var_pop("v").alias("a"), F.var_pop("rest").alias("b"))
    return out.select("target", F.when(F.col("a") <= 1e-15, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("b") / F.col("a")))).alias("explained"))


def restart_walk(sources: DataFrame, edges: DataFrame, steps: int = 4, restart: float = 0.15) -> DataFrame:
    """(target, src, i, p): steps of a walk that returns to its source with the given chance."""
    out = edges.select("target", "i", "j", (1 / F.count(F.lit(1)).over(Window.partitionBy("target", "i"))).alias("w"))
    start = sources.select("target", F.col("i").alias("src"), "i", F.lit(1.0).alias("p"))
    p = start
    for _ in range(steps):
        moved = p.join(out, ["target", "i"]).select("target", "src", F.col("j").alias("i"), (F.col("p") * F.col("w") * (1 - restart)).alias("p"))
        p = moved.union(start.withColumn("p", F.lit(restart))).groupBy("target", "src", "i").agg(F.sum("p").alias("p"))
    return p


def _by_size(links: DataFrame, work: Callable, schema: str) -> DataFrame:
    """(target and schema): work of each target's adjacency matrix, many at once. links: (target, i, to). Matrices of one
    size are a stack; a target is one molecule or one order, so its matrix fits a task."""
    kind = links.schema["target"].dataType.simpleString()
    rows = links.groupBy("target").agg(F.collect_list(F.struct("i", "to")).alias("rows"))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            for n in np.unique(sizes):
                every = np.flatnonzero(sizes == n)
                # stacks of 16 MB
                for some in np.array_split(every, max(1, len(every) * n * n >> 21)):
                    flat = lists.take(pa.array(some)).flatten()
                    i, to = flat.field(0).to_numpy(zero_copy_only=False).reshape(-1, n), flat.field(1)
                    order = np.argsort(i, axis=1)
                    ids = np.take_along_axis(i, order, 1)
                    inverse = np.argsort(order, axis=1).ravel()
                    at = np.repeat(np.arange(len(some) * n), to.value_lengths().to_numpy(zero_copy_only=False))
                    a = np.zeros((len(some), n, n))
                    row, j = at // n, to.flatten().to_numpy(zero_copy_only=False)
                    # ids of a target follow those of the one before
                    low, span = int(ids.min()), int(ids.max()) - int(ids.min()) + 1
                    col = np.searchsorted((ids.astype(np.int64) - low + np.arange(len(some))[:, None] * span).ravel(), j.astype(np.int64) - low + row * span) - row * n
                    a[row, inverse[at], col] = 1
                    c = work(a)
                    one, two = np.triu_indices(n, 1)
                    names_of = batch.column(0).take(pa.array(np.repeat(some, len(one))))
                    yield pa.RecordBatch.from_arrays([names_of, pa.array(ids[:, one].ravel(), pa.int32()), pa.array(ids[:, two].ravel(), pa.int32()), pa.array(c[:, one, two].ravel())], ["target", *names])

    return rows.mapInArrow(run, f"target {kind}, {schema}")


def quantum_walk(edges: DataFrame, times: list[float], decay: float | None = None) -> DataFrame:
    """(target, i, j, c): time-averaged transition probabilities of the continuous-time quantum walk on each target's
    Laplacian, scaled to a largest eigenvalue of 1. A target's matrix fits a task; the matrices of many small ones are
    taken at once."""
    t = np.array(times)
    w = np.ones_like(t) if decay is None else np.exp(-t / decay)

    def walk(a: np.ndarray) -> np.ndarray:
        values, v = np.linalg.eigh(a.sum(2)[:, :, None] * np.eye(a.shape[1]) - a)
        values = values / values[:, -1:]
        c = np.zeros_like(a)
        for k, x in enumerate(t):
            re, im = ((v * f(values * x)[:, None, :]) @ v.transpose(0, 2, 1) for f in (np.cos, np.sin))
            c += w[k] * (re * re + im * im)
        return np.clip((c + c.transpose(0, 2, 1)) / 2 / w.sum(), 0, 1)

    return _by_size(edges.groupBy("target", "i").agg(F.collect_set("j").alias("to")), walk, "i int, j int, c double")


def coined_walk(sources: DataFrame, edges: DataFrame, steps: int, size: int = 512) -> DataFrame:
    """(target, src, i, p): mean chance of being at i over the first steps of a walk on arcs, begun evenly on a source's
    own arcs: the Grover coin at each node, then a swap of each arc's direction. A task has a batch of sources with the
    contacts of their target, and only the arcs that walks have reached; the source itself is left out. edges: both
    directions of each contact."""

    def ready(edges: pa.Table | None) -> dict:
        links = sourced.Contacts(edges)
        tail = np.repeat(np.arange(len(links.nodes)), links.degree)
        back = np.empty(len(tail), np.int64)
        back[np.lexsort((tail, links.to))] = np.arange(len(tail))
        return {"links": links, "tail": tail, "back": back}

    def work(batch: pa.Table, links: sourced.Contacts, tail: np.ndarray, back: np.ndarray) -> dict:
        srcs = batch.column("src").to_numpy()
        srcs, found = srcs[np.isin(srcs, links.nodes)], []
        for k in range(0, len(srcs), 32):
            found.append(_coined(links, tail, back, srcs[k : k + 32], steps))
        return {n: pa.array(np.concatenate([f[c] for f in found] or [np.zeros(0)]), t) for c, (n, t) in enumerate((("src", pa.int32()), ("i", pa.int32()), ("p", pa.float64())))}

    rows = sources.select("target", F.col("i").alias("src")).distinct()
    return against(rows, {"edges": edges.select("target", "i", "j")}, work, "src int, i int, p double", size, ready)


def _coined(links: sourced.Contacts, tail: np.ndarray, back: np.ndarray, srcs: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(src, i, p) of coined_walk. tail and back: the node that each arc begins at, and the arc of the other direction."""
    count, start = len(links.nodes), links.place(srcs)
    n = links.degree[start]
    walk, a = np.repeat(np.arange(len(srcs)), n), np.repeat(1 / np.sqrt(n), n)
    arc = np.repeat(links.first[start] - np.cumsum(n) + n, n) + np.arange(n.sum())
    keys, chances = [], []
    for _ in range(steps):
        at, own = np.unique(walk * count + tail[arc], return_inverse=True)
        node = at % count
        n = links.degree[node]
        before = np.cumsum(n) - n
        coined = np.repeat(2 * np.bincount(own, a, len(at)) / n, n)
        coined[before[own] + arc - links.first[tail[arc]]] -= a
        walk, arc, a = np.repeat(at // count, n), back[np.repeat(links.first[node] - before, n) + np.arange(n.sum())], coined
        key, own = np.unique(walk * count + tail[arc], return_inverse=True)
        keys.append(key)
        chances.append(np.bincount(own, a * a, len(key)))
    key, own = np.unique(np.concatenate(keys), return_inverse=True)
    p = np.bincount(own, np.concatenate(chances), len(key)) / steps
    src, i = srcs[key // count], links.nodes[key % count]
    return src[i != src], i[i != src], p[i != src]


def least_labels(residues: DataFrame, edges: DataFrame) -> DataFrame:
    """(target, i, component): the smallest index that each residue reaches over edges in both directions.

    Each residue points to one of its component. In a round it looks at where its neighbours' pointers point to: the least
    of these becomes the pointer of what the residue points to and its own, if it is less, and every pointer is
    shortened by one step. Trees join and halve in the same round, so the rounds grow with the logarithm of a
    component's size, not with its diameter."""
    at = kept(residues.select("target", "i", F.col("i").alias("p")))
    links = kept(edges.select("target", F.col("i").alias("to"), F.col("j").alias("i")))
    while True:
        above = at.select("target", F.col("i").alias("p"), F.col("p").alias("g"))
        two = kept(at.join(above, ["target", "p"]))
        heard = links.join(two.select("target", "i", "g"), ["target", "i"]).groupBy("target", F.col("to").alias("i")).agg(F.min("g").alias("m"))
        seen = two.join(heard, ["target", "i"], "left").withColumn("m", F.least("m", "g", "p"))
        told = seen.select("target", F.explode(F.array(F.struct("i", F.col("m").alias("p"), F.col("p").alias("old")), F.struct(F.col("p").alias("i"), F.col("m").alias("p"), F.lit(None).cast("int").alias("old")))).alias("e"))
        new = kept(told.groupBy("target", F.col("e.i").alias("i")).agg(F.min("e.p").alias("p"), F.max("e.old").alias("old")))
        at = new.select("target", "i", "p")
        if new.filter("p <> old").isEmpty():
            return at.withColumnRenamed("p", "component")


def settled_walk(edges: DataFrame, restart: float = 0.15) -> DataFrame:
    """(target, i, j, p), i < j, where there is a walk: the settled random walk with restart, made symmetric: the restart
    times the inverse of 1 less the walk's matrix. A target's matrix fits a task; those of many small ones are inverted at
    once."""

    def settled(a: np.ndarray) -> np.ndarray:
        p = restart * np.linalg.inv(np.eye(a.shape[1]) - (1 - restart) * a / a.sum(1)[:, None, :])
        joined = a + np.eye(a.shape[1])
        for _ in range(a.shape[1].bit_length()):
            joined = (joined @ joined > 0).astype(float)
        return np.where(joined > 0, (p + p.transpose(0, 2, 1)) / 2, np.nan)

    found = _by_size(edges.groupBy("target", "i").agg(F.collect_set("j").alias("to")), settled, "i int, j int, p double")
    return found.filter(~F.isnan("p"))


def low_modes(residues: DataFrame, blocks: DataFrame, count: int) -> DataFrame:
    """(target, mode, eigenvalue, i, ux, uy, uz): the lowest modes of the elastic network above its rigid motions, each
    with its largest component positive. blocks: (target, i, j, k, l, h)."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, codes = np.unique(np.concatenate([pdf.i, pdf.j]), return_inverse=True)
        h = np.zeros((3 * len(ids), 3 * len(ids)))
        h[3 * codes[: len(pdf)] + pdf.k, 3 * codes[len(pdf) :] + pdf.l] = pdf.h
        values, v = np.linalg.eigh((h + h.T) / 2)
        low = np.flatnonzero(values > max(np.abs(values).max() * 1e-9, 1e-10))[:count]
        out = []
        for m, at in enumerate(low):
            u = v[:, at] * np.sign(v[np.abs(v[:, at]).argmax(), at])
            out.append(pd.DataFrame({"target": key[0], "mode": m, "eigenvalue": values[at], "i": ids, "ux": u[0::3], "uy": u[1::3], "uz": u[2::3]}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("target", "mode", "eigenvalue", "i", "ux", "uy", "uz")})

    kind = residues.schema["target"].dataType.simpleString()
    return blocks.groupBy("target").applyInPandas(one, f"target {kind}, mode int, eigenvalue double, i int, ux double, uy double, uz double")
