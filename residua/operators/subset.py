"""Exact selection of k residues under a quadratic objective."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from residua.functions.ranks import percentile


def objective(candidates: DataFrame, pairs: DataFrame, *, k: int = 5, weight: float = 0.1, width: float = 7.8) -> DataFrame:
    """(target, a, b, q), a <= b: minus the lining percentile g on the diagonal; for pairs the weight times the smaller g,
    the percentile of their connectivity c (0 where c <= 0) and a Gaussian of their distance d, over k - 1.
    candidates: (target, i, support); pairs: (target, i, j, c, d), i < j, all pairs of candidates."""
    g = candidates.withColumn("g", percentile("support", "target")).select("target", "i", "g")
    single = g.select("target", F.col("i").alias("a"), F.col("i").alias("b"), (-F.col("g")).alias("q"))
    if k == 1:
        return single
    one, two = g.select("target", "i", F.col("g").alias("g1")), g.select("target", F.col("i").alias("j"), F.col("g").alias("g2"))
    rows = pairs.withColumn("p", F.when(F.col("c") > 0, percentile("c", "target")).otherwise(0.0)).join(one, ["target", "i"]).join(two, ["target", "j"])
    q = weight * F.least("g1", "g2") * F.col("p") * F.exp(-0.5 * F.pow(F.col("d") / width, 2)) / (k - 1)
    return single.union(rows.select("target", F.col("i").alias("a"), F.col("j").alias("b"), q.alias("q")))


def lining(rows: DataFrame, modes: tuple[str, ...] = ("support", "persistent", "variable")) -> DataFrame:
    """(target, i, mode, g): percentiles of a lining's support, of the support times the root of the residue's frequency, and
    of that times the root of what is left of it. rows: (target, i, support, frequency), the frequency between 0 and 1. A
    target in which a mode leaves no support above 0 has no rows of that mode."""
    weight = {"support": F.lit(1.0), "persistent": F.sqrt("frequency"), "variable": F.sqrt(1 - F.col("frequency"))}
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), F.round(F.col("support") * weight[m], 12).alias("v")) for m in modes)))
    values = rows.select("target", "i", each.alias("e")).select("target", "i", "e.mode", "e.v")
    values = values.withColumn("most", F.max("v").over(Window.partitionBy("target", "mode"))).filter("most > 0")
    return values.select("target", "i", "mode", percentile("v", "target", "mode").alias("g"))


def subsets(q: DataFrame, k: int = 5) -> DataFrame:
    """(target, members, energy) of all k-subsets, grown by one larger member a time; each step adds the energies of the
    new member with those before it. A subset meets only the candidates after its last member, through the key (target,
    last), so one target's subsets are spread over its candidates and no row is made to be dropped. q holds all pairs.
    The number of subsets grows as m over k: meant for the lining of one pocket, of some tens of residues."""
    single = q.filter("a = b").select("target", "a", "q")
    pairs = q.filter("a < b").select("target", F.col("a").alias("last"), F.col("b").alias("j"), "q")
    table = pairs.groupBy("target", "j").agg(F.map_from_entries(F.collect_list(F.struct("last", "q"))).alias("with"))
    own = single.select("target", F.col("a").alias("j"), F.col("q").alias("own")).join(table, ["target", "j"])
    after = pairs.select("target", "last", "j").join(own, ["target", "j"])
    rows = single.select("target", F.array("a").alias("members"), F.col("q").alias("energy"))
    for _ in range(k - 1):
        grown = rows.withColumn("last", F.element_at("members", -1)).join(after, ["target", "last"])
        more = F.aggregate("members", F.lit(0.0), lambda s, m: s + F.col("with")[m])
        rows = grown.select("target", F.concat("members", F.array("j")).alias("members"), (F.col("energy") + F.col("own") + more).alias("energy"))
    return rows.withColumn("energy", F.round("energy", 12))


def best(found: DataFrame) -> DataFrame:
    """(target, members, energy) of the least energy, the first in order on ties."""
    return found.groupBy("target").agg(F.min(F.struct("energy", "members")).alias("x")).select("target", "x.members", "x.energy")


#: Subsets that are added up at once.
AT_ONCE = 1 << 18


@lru_cache(256)
def _choices(n: int, k: int) -> np.ndarray:
    return np.fromiter(itertools.chain.from_iterable(itertools.combinations(range(n), k)), np.int64).reshape(math.comb(n, k), k)


class _Search:
    """Subsets of k of a target's candidates whose first member is given: the least energy with each candidate, and the
    least of all with its members."""

    def __init__(self, q: np.ndarray, k: int):
        self.q, self.k = q, k
        self.own, self.pair = q.diagonal(), q - np.diag(q.diagonal())
        self.less = min(0.0, self.pair.min())
        self.least = np.full(len(q), np.inf)
        self.members, self.energy = None, np.inf
        self.above = self._reached()

    def _reached(self) -> np.ndarray:
        """For each candidate, the energy of a subset with it that is grown by the best next member."""
        taken, energy, cost = np.eye(len(self.q), dtype=bool), self.own.copy(), self.own + self.pair
        for _ in range(self.k - 1):
            gain = np.where(taken, np.inf, cost)
            new = gain.argmin(1)
            energy, taken[np.arange(len(new)), new] = energy + gain[np.arange(len(new)), new], True
            cost = cost + self.pair[new]
        return energy + 1e-9

    def run(self, prefix: list[int], energy: float) -> None:
        more = self.k - len(prefix)
        rest = np.arange(prefix[-1] + 1, len(self.q))
        if more > len(rest):
            return
        gain = self.own[rest] + self.pair[prefix][:, rest].sum(0)
        if more:
            # no subset of the branch is below this; with a given member, none is below the second
            low = np.sort(gain)[:more]
            spare = energy + math.comb(more, 2) * self.less
            with_each = spare + gain + np.where(gain <= low[-1], low.sum() - gain, low[:-1].sum())
            if spare + low.sum() > self.above[prefix].max() and (with_each > self.above[rest]).all():
                return
        if math.comb(len(rest), more) > AT_ONCE:
            for c, g in zip(rest.tolist(), gain.tolist(), strict=True):
                self.run([*prefix, c], energy + g)
            return
        chosen = _choices(len(rest), more)
        total = energy + gain[chosen].sum(1)
        for i, j in itertools.combinations(range(more), 2):
            total += self.pair[rest[chosen[:, i]], rest[chosen[:, j]]]
        total = np.round(total, 12)
        at = int(total.argmin())  # subsets come in order, so the first on ties
        self.least[prefix] = np.minimum(self.least[prefix], total[at])
        for j in range(more):
            np.minimum.at(self.least, rest[chosen[:, j]], total)
        members = [*prefix, *rest[chosen[at]].tolist()]
        if (total[at], members) < (self.energy, self.members or members):
            self.energy, self.members = total[at], members


def marginals(q: DataFrame, k: int = 5) -> DataFrame:
    """(target, i, energy, members): the least energy of a k-subset with each candidate i; and at i = -1 the least of all,
    with its members, the first in order on ties. Exact, by branch and bound: a task has the subsets of one target that
    begin with one candidate, goes on by a second member, and leaves a branch of which no subset can be below what a
    greedy subset with one of its members has. q holds all pairs; a target's objective goes to each of its tasks, so it
    is meant for the lining of a pocket, of some tens to hundreds of residues."""
    terms = q.groupBy("target").agg(F.collect_list(F.struct("a", "b", "q")).alias("terms"), F.sort_array(F.collect_set("a")).alias("ids"))
    tasks = terms.select("target", "terms", F.posexplode("ids").alias("first", "a")).drop("a")
    tasks = tasks.repartition("target", "first")
    kind = q.schema["target"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                a, b, value = (batch.column(1)[row].values.field(n).to_numpy(zero_copy_only=False) for n in range(3))
                ids, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
                matrix = np.zeros((len(ids), len(ids)))
                np.add.at(matrix, (codes[: len(a)], codes[len(a) :]), value)
                matrix = np.triu(matrix) + np.tril(matrix, -1).T
                matrix = matrix + np.triu(matrix, 1).T
                found, first = _Search(matrix, k), batch.column(2)[row].as_py()
                found.run([first], matrix[first, first])
                at = np.flatnonzero(np.isfinite(found.least))
                if not len(at):
                    continue
                members = [None] * len(at) + [ids[found.members].tolist()]
                names = batch.column(0).take(pa.array([row] * len(members)))
                yield pa.RecordBatch.from_arrays([names, pa.array([*ids[at].tolist(), -1], pa.int32()), pa.array([*found.least[at], found.energy]), pa.array(members, pa.list_(pa.int32()))], ["target", "i", "energy", "members"])

    rows = tasks.mapInArrow(search, f"target {kind}, i int, energy double, members array<int>")
    least = rows.groupBy("target", "i").agg(F.min(F.struct("energy", "members")).alias("x"))
    return least.select("target", "i", "x.energy", "x.members")


def chosen(found: DataFrame) -> DataFrame:
    """(target, members, energy) of the best subset. found: as marginals gives."""
    return found.filter("i = -1").select("target", "members", "energy")


def scores(residues: DataFrame, found: DataFrame) -> DataFrame:
    """(target, i, score): -1 outside the candidates; inside, the best value of a subset with the residue, scaled to 0
    to 1, and 1 more for the members of the best subset. found: as marginals gives, read once."""
    every = Window.partitionBy("target")
    m, own = -F.col("energy"), F.col("i") >= 0
    inner = lambda f: f(F.when(own, m)).over(every)
    scaled = (m - inner(F.min)) / F.greatest(inner(F.max) - inner(F.min), F.lit(1e-15))
    more = F.array_contains(F.max("members").over(every), F.col("i")).cast("double")
    inside = found.withColumn("s", scaled + more).filter(own).select("target", "i", "s")
    return residues.select("target", "i", "residue_id").join(inside, ["target", "i"], "left").select("target", "i", "residue_id", F.coalesce("s", F.lit(-1.0)).alias("score"))


def hit_list(scored: DataFrame, k: int = 5) -> DataFrame:
    """(target, rank, i, residue_id, score) of the k best."""
    rank = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("score"), "i"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("target", "rank", "i", "residue_id", "score")
