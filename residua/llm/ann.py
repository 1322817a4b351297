"""Approximate nearest neighbours by low-dimensional stable projections in a kd-tree.

Unit vectors are projected onto DIMS Gaussian directions, so the squared projected distance of two vectors is their
squared distance times a chi-square variable of DIMS degrees. A kd-tree over the projections (its upper levels split the
space into cells, fitted on a bounded sample; every vector is indexed in its cell) gives projected neighbours in order of
distance; each is verified on the original vectors, until a neighbour closer than the k-th found would have shown up by
now with probability `sure`: delta^2 / d_k^2 >= quantile(sure). So each true neighbour is found with probability `sure`
at least, whatever the data. The first round searches a query's own cell, the second all further cells that the stopping
radius of the first reaches. Points go out once for every BLOCK queries that reach their cell, so a cell that few queries
reach is sent once. Column `verified` counts the vectors whose cosine a query had computed: where the k-th neighbour is not much
closer than any other vector, these are most of them, and no projection can tell them apart.

Equal vectors are indexed once, with the k + 1 smallest of their ids, so a very common vector is one entry.

Defined cases: vectors that are null, zero or empty or hold null, NaN or infinite components take no part, nor do those
whose length differs from the most common one (of equally common lengths the larger counts); null ids take no part;
fewer than k candidates: all; ties go to the smaller id; rows repeated under one id and vector count once; other columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from residua.llm.common import arrow_schema, batch, lists, written

DIMS = 16
SAMPLE = 20_000
CELL = 2048
MOST_CELLS = 4096
BLOCK = 2048
AT_ONCE = 128


def quantile(sure: float, dims: int = DIMS) -> float:
    """Of the chi-square distribution with an even number of degrees."""
    def below(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))

    low, high = 0.0, 200.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < sure else (low, mid)
    return high


def directions(size: int, dims: int = DIMS) -> np.ndarray:
    return np.random.default_rng(7).standard_normal((size, dims))


class Tree:
    """Cells of a kd-tree with 2 ** depth leaves: each level splits at the sample's median of its widest axis."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth, self.low, self.high = depth, [], []
        self.splits: list[list[tuple[int, float]]] = [[] for _ in range(depth)]
        self._grow(sample, 0, np.full(sample.shape[1], -np.inf), np.full(sample.shape[1], np.inf))
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _grow(self, points: np.ndarray, level: int, low: np.ndarray, high: np.ndarray) -> None:
        if level == self.depth:
            self.low.append(low)
            self.high.append(high)
            return
        axis = int(np.ptp(points, 0).argmax()) if len(points) else level % len(low)
        at = float(np.median(points[:, axis])) if len(points) else float(np.clip(0, low[axis], high[axis]))
        self.splits[level].append((axis, at))
        up, down = low.copy(), high.copy()
        up[axis], down[axis] = at, at
        right = points[:, axis] >= at
        self._grow(points[~right], level + 1, low, down)
        self._grow(points[right], level + 1, up, high)

    def cell(self, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), np.int64)
        for level in self.splits:
            axis, value = np.array([s[0] for s in level]), np.array([s[1] for s in level])
            at = 2 * at + (points[np.arange(len(points)), axis[at]] >= value[at])
        return at

    def gap(self, point: np.ndarray) -> np.ndarray:
        """Squared distances from a point to all cells."""
        return (np.maximum(0, np.maximum(self.low - point, point - self.high)) ** 2).sum(1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _units(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    got = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("id is not null and v is not null and size(v) > 0")
    got = got.filter(F.forall("v", fine) & F.exists("v", lambda x: x != 0))
    lengths = got.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    return got.filter(F.size("v") == (lengths[0].length if lengths else 0))


def search(rows: DataFrame, is_query, *, key: str = "vec_id", vector: str = "embedding", k: int = 5, sure: float = 0.95) -> DataFrame:
    """(query_id, rank, id, score, verified): the k nearest found by cosine. is_query: a condition on rows."""
    good = usable(rows, key, vector)
    queries = usable(rows.filter(is_query), key, vector) if is_query is not None else good
    own = Window.partitionBy("h1", "h2").orderBy("id")
    hashed = good.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit("v"), "v"))
    few = hashed.dropDuplicates(["h1", "h2", "id"]).withColumn("n", F.row_number().over(own)).filter(F.col("n") <= k + 1)
    index = written(few.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("v").alias("v")).select("ids", "v"), "vectors")
    total = index.count()
    if not total:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, id bigint, score double, verified bigint")
    size = index.select(F.size("v")).first()[0]
    drawn = index.filter(F.pmod(F.xxhash64("v", F.lit("tree")), F.lit(1_000_000)) < int(1e6 * SAMPLE / total)).limit(2 * SAMPLE).select("v").toArrow()
    sample = _units(_matrix(drawn.column(0).combine_chunks())) @ directions(size) if drawn.num_rows else np.zeros((0, DIMS))
    depth = min(int(math.log2(MOST_CELLS)), max(0, math.ceil(math.log2(total / CELL))))
    tree = rows.sparkSession.sparkContext.broadcast(Tree(sample, depth))
    stop = quantile(sure)
    placed = "cell int, id bigint, ids array<bigint>, v array<double>, p array<double>"
    schema = arrow_schema(placed)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = _units(_matrix(b.column(2))) @ directions(size)
            yield batch(schema, tree.value.cell(p).astype(np.int32), b.column(0), b.column(1), b.column(2), lists(p.ravel(), np.arange(len(p) + 1) * DIMS))

    points = index.select(F.col("ids")[0].alias("id"), "ids", "v").mapInArrow(place, placed)
    points = written(points, "points")
    # a cell of many points is searched in parts, many queries of a cell in blocks: tables of at most MOST_CELLS rows
    parts = points.groupBy("cell").agg(F.greatest(F.lit(1), F.round(F.count("*") / (2 * CELL)).cast("int")).alias("parts"))
    points = points.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), "parts"))
    asked = queries.dropDuplicates(["id"]).select("id", F.array("id").alias("ids"), "v").mapInArrow(place, placed)
    asked = written(asked, "queries")
    found = "query_id bigint, ids array<bigint>, scores array<double>, verified bigint"
    result = arrow_schema(found)

    def verify(points: pa.Table, queries: pa.Table) -> pa.Table:
        """The k nearest of one cell's points for each query, by incremental projected neighbours."""
        if not points.num_rows or not queries.num_rows:
            return result.empty_table()
        col = lambda t, n: t.column(n).combine_chunks()
        v, p, owners = _matrix(col(points, "v")), _matrix(col(points, "p")), col(points, "ids").to_pylist()
        norms = np.sqrt((v * v).sum(1))
        q, qp, bound = _matrix(col(queries, "v")), _matrix(col(queries, "p")), col(queries, "far").to_numpy(zero_copy_only=False)
        qn = np.sqrt((q * q).sum(1))
        square = (p * p).sum(1)
        out = [], [], [], []
        for i, me in enumerate(col(queries, "id").to_pylist()):
            if i % AT_ONCE == 0:
                some = qp[i : i + AT_ONCE]
                deltas = np.maximum(0, square + (some * some).sum(1)[:, None] - 2 * (some @ p.T))
            delta, far, best = deltas[i % AT_ONCE], float(bound[i]), []
            near = np.flatnonzero(delta <= far * stop) if np.isfinite(far) else np.arange(len(delta))
            near = near[np.argsort(delta[near], kind="stable")]
            a, step = 0, 64
            while a < len(near) and delta[near[a]] <= far * stop:
                part = near[a : a + step]
                a, step = a + len(part), step * 2
                score = (v[part] @ q[i]) / (norms[part] * qn[i])
                cut = best[-1][0] if len(best) == k else np.inf
                hit = np.flatnonzero(-score <= cut)
                if len(hit) > k:  # of equal scores all stay
                    hit = hit[score[hit] >= np.partition(score[hit], -k - 1)[-k - 1]]
                if len(hit):
                    best = sorted(best + [(-float(score[h]), o) for h in hit for o in owners[part[h]] if o != me])[:k]
                    if len(best) == k:
                        far = min(far, max(0.0, 2 + 2 * best[-1][0]))
                        near = near[: np.searchsorted(delta[near], far * stop, "right")]
            out[0].append(me)
            out[1].append([o for _, o in best])
            out[2].append([-s for s, _ in best])
            out[3].append(a)
        return pa.Table.from_batches([batch(result, *out)])

    def answered(asks: DataFrame) -> DataFrame:
        """asks: queries with cell and far, the squared distance to beat."""
        asks = written(asks.select("cell", "id", "v", "p", "far"), "asks")
        blocks = F.broadcast(asks.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
        spot = F.concat_ws("/", "cell", "part", "block")
        there = points.join(blocks, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        asks = asks.join(F.broadcast(parts), "cell").join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
        asks = asks.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        there, asks = there.select(spot.alias("spot"), "ids", "v", "p"), asks.select(spot.alias("asked"), "id", "v", "p", "far")
        return there.groupBy("spot").cogroup(asks.groupBy("asked")).applyInArrow(lambda left, right: verify(left, right), found)

    one = Window.partitionBy("query_id")
    nearest = one.orderBy(F.desc("score"), "id")

    def merged(answers: DataFrame) -> DataFrame:
        pairs = answers.select("query_id", "verified", F.posexplode_outer(F.arrays_zip("ids", "scores")).alias("at", "x"))
        pairs = pairs.withColumn("verified", F.sum(F.when(F.coalesce("at", F.lit(0)) == 0, F.col("verified"))).over(one))
        pairs = pairs.select("query_id", F.col("x.ids").alias("id"), F.col("x.scores").alias("score"), "verified")
        return pairs.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k).drop("rank")

    home = written(merged(answered(asked.withColumn("far", F.lit(float("inf"))))), "home")
    reach = home.groupBy("query_id").agg(F.when(F.count("id") >= k, F.greatest(F.lit(0.0), 2 - 2 * F.min("score"))).otherwise(F.lit(float("inf"))).alias("far"))
    asks = asked.join(reach.withColumnRenamed("query_id", "id"), "id", "left").withColumn("far", F.coalesce("far", F.lit(float("inf"))))
    ddl = "cell int, id bigint, v array<double>, p array<double>, far double"
    spread = arrow_schema(ddl)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (home_cell, p, far) in enumerate(zip(b.column(0).to_pylist(), _matrix(b.column(3)), b.column(4).to_pylist(), strict=True)):
                reached = np.flatnonzero(tree.value.gap(p) <= far * stop)
                reached = reached[reached != home_cell]
                if len(reached):
                    rest = pa.RecordBatch.from_arrays([c.take(pa.array(np.full(len(reached), i))) for c in b.columns[1:]], schema=pa.schema(list(spread)[1:]))
                    yield batch(spread, reached.astype(np.int32), *rest.columns)

    further = merged(answered(asks.select("cell", "id", "v", "p", "far").mapInArrow(cells, ddl)))
    both = home.withColumn("round", F.lit(1)).union(further.withColumn("round", F.lit(2)))
    total = lambda n: F.coalesce(F.max(F.when(F.col("round") == n, F.col("verified"))).over(one), F.lit(0))
    both = both.withColumn("verified", total(1) + total(2)).filter("id is not null").withColumn("rank", F.row_number().over(nearest))
    return both.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score", "verified")
