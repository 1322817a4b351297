"""Cavity fields, mixed region scores and the lift of random scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from residua.operators.against import against
from residua.operators.geometry import near_pairs
from residua.operators.graph import kept


def mixed_regions(values: DataFrame, members: DataFrame, k: int = 5) -> DataFrame:
    """(target, pocket, region): mean of a pocket's k largest values after the mean over all sources. values: (target, src,
    i, c); members: (target, pocket, i)."""
    mixed = values.groupBy("target", "i").agg(F.round(F.avg("c"), 12).alias("c"))
    best = F.row_number().over(Window.partitionBy("target", "pocket").orderBy(F.desc("c"), "i"))
    top = mixed.join(members, ["target", "i"]).withColumn("k", best).filter(F.col("k") <= k)
    return top.groupBy("target", "pocket").agg(F.avg("c").alias("region"))


def cavity_field(centres: DataFrame, members: DataFrame, scores: DataFrame, radius: float = 8.0, tolerance: float = 0.95, direct: DataFrame | None = None) -> DataFrame:
    """(target, pocket, recurrent, nodes): the direct pocket (target, pocket), by default the one of the largest transport
    score, or the field of pockets around one centre in its place.

    A field is the pockets whose centres lie within the radius of one centre; equal fields count once, at the first. Its
    recurrence is the mean of its five residues of the largest summed transport over the root of its pockets. The field
    of the largest recurrence is taken where the best pocket stands alone, responds mechanically, and the field's largest
    response is at least `tolerance` of its own. Ties go to the lower pocket. centres: (target, pocket, x, y, z);
    members: (target, pocket, i); scores: (target, pocket, transport, mechanical)."""
    points = centres.select("target", F.col("pocket").alias("i"), "x", "y", "z")
    same = points.join(points.withColumnRenamed("i", "j"), ["target", "x", "y", "z"]).select("target", F.col("i").alias("anchor"), F.col("j").alias("pocket"))
    hood = near_pairs(points, points, radius).select("target", F.col("i").alias("anchor"), F.col("j").alias("pocket")).union(same)
    scores = kept(scores)
    hood = kept(hood.join(scores, ["target", "pocket"]))
    each = hood.groupBy("target", "anchor").agg(F.sort_array(F.collect_list("pocket")).alias("pockets"), F.max("mechanical").alias("mechanical"))
    lead = each.groupBy("target", "pockets").agg(F.min("anchor").alias("anchor"), F.first("mechanical").alias("mechanical"))
    support = hood.join(members, ["target", "pocket"]).groupBy("target", "anchor", "i").agg(F.sum("transport").alias("s"))
    best = F.row_number().over(Window.partitionBy("target", "anchor").orderBy(F.desc("s"), "i"))
    strong = support.withColumn("k", best).filter("k <= 5").groupBy("target", "anchor").agg(F.avg("s").alias("strong"))
    recurrence = F.round(F.col("strong") / F.sqrt(F.size("pockets")), 9)
    field = lead.join(strong, ["target", "anchor"]).groupBy("target").agg(F.min_by(F.struct("anchor", "mechanical"), F.struct(-recurrence, "anchor")).alias("f"))
    direct = (scores if direct is None else scores.join(direct.select("target", "pocket"), ["target", "pocket"])).groupBy("target").agg(F.min_by(F.struct("pocket", "mechanical"), F.struct(-F.col("transport"), "pocket")).alias("d"))
    alone = each.select("target", F.col("anchor").alias("pocket"), (F.size("pockets") == 1).alias("alone"))
    both = direct.join(field, "target").withColumn("pocket", F.col("d.pocket")).join(alone, ["target", "pocket"])
    chosen = both.select("target", "pocket", F.col("f.anchor").alias("anchor"), (F.col("alone") & (F.col("d.mechanical") > 0) & (F.col("f.mechanical") >= tolerance * F.col("d.mechanical"))).alias("recurrent"))
    listed = lambda rows: rows.groupBy("target", "pocket", "recurrent").agg(F.sort_array(F.collect_set("i")).alias("nodes"))
    own = chosen.filter(~F.col("recurrent")).join(members, ["target", "pocket"])
    wide = chosen.filter("recurrent").join(hood.select("target", "anchor", F.col("pocket").alias("near")), ["target", "anchor"])
    wide = wide.join(members.withColumnRenamed("pocket", "near"), ["target", "near"])
    return listed(own).union(listed(wide))


def refinement_gate(ranked: DataFrame, centres: DataFrame, radius: float = 8.0) -> DataFrame:
    """(target, pocket, candidates, near, refine): each target's first pocket, how many centres lie within the radius of
    its own (itself counts), and whether it stands alone among several, so that the network's mechanical response has to
    tell whether it is a part of a larger field. ranked: (target, rank, pocket); centres: (target, pocket, x, y, z)."""
    points = centres.select("target", F.col("pocket").alias("i"), "x", "y", "z")
    first = ranked.filter("rank = 1").select("target", "pocket")
    own = points.join(first.withColumnRenamed("pocket", "i"), ["target", "i"])
    same = own.select("target", F.col("i").alias("pocket"), "x", "y", "z").join(points, ["target", "x", "y", "z"]).select("target", "pocket", "i")
    near = near_pairs(own, points, radius).select("target", F.col("i").alias("pocket"), F.col("j").alias("i")).union(same)
    near = near.groupBy("target", "pocket").agg(F.count(F.lit(1)).alias("near"))
    count = centres.groupBy("target").agg(F.count(F.lit(1)).alias("candidates"))
    return near.join(count, "target").select("target", "pocket", "candidates", "near", ((F.col("near") == 1) & (F.col("candidates") > 1)).alias("refine"))


def _precision(score: np.ndarray, truth: np.ndarray) -> float | None:
    """As evaluate.average_precision, of one target."""
    order = np.argsort(-score)
    last = np.flatnonzero(np.append(np.diff(score[order]) != 0, True))
    hits = np.cumsum(truth[order])[last]
    return float((np.diff(hits, prepend=0) * hits / (last + 1)).sum() / hits[-1]) if hits[-1] else None


def random_lift(rows: DataFrame, sizes: DataFrame, draws: int = 200) -> DataFrame:
    """(target, lift, spread): mean and standard deviation of the lift of uniform random scores, drawn from numpy's default
    generator with seeds from 0, for all n residues of a target; null without true rows. rows: (target, i, truth) that
    count; sizes: (target, n). A task has some draws of a target, one at a time, with its rows; only lifts leave it."""

    def work(batch: pa.Table, rows: pa.Table | None) -> dict:
        out = []
        if rows is not None:
            i, truth = rows.column("i").to_numpy(), pc.fill_null(rows.column("truth"), 0).to_numpy()
            # a null index has no score
            i = np.nan_to_num(i, nan=-1).astype(np.int64)
            for seed, n in zip(batch.column("draw").to_pylist(), batch.column("n").to_pylist(), strict=True):
                own = (i >= 0) & (i < n)
                if own.any():
                    ap = _precision(np.random.default_rng(seed).random(n)[i[own]], truth[own])
                    out.append(None if ap is None else ap / (truth.sum() / len(truth)))
        return {"l": pa.array(out, pa.float64())}

    seeds = sizes.select("target", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"), "n")
    lifts = against(seeds, {"rows": rows.select("target", "i", "truth")}, work, "l double", 20)
    return lifts.groupBy("target").agg(F.avg("l").alias("lift"), F.stddev_pop("l").alias("spread"))
