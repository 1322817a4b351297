"""Distance joins on residues."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def near_pairs(left: DataFrame, right: DataFrame, radius: float, least: float = 0.0) -> DataFrame:
    """(target, i, j, d) with least < d <= radius (least <= d if least > 0), i from left and j from right, of one target.

    Space is cut into cubes of the radius; right rows are copied to the 27 cubes around theirs, so that the distance test
    follows a hash join on the cube instead of a product of all residues."""
    cube = [F.floor(F.col(c) / radius).cast("int") for c in "xyz"]
    around = F.array(*(F.array(*map(F.lit, s)) for s in itertools.product((-1, 0, 1), repeat=3)))
    a = left.select("target", "i", "x", "y", "z", *[c.alias(f"c{k}") for k, c in enumerate(cube)])
    b = right.select("target", F.col("i").alias("j"), *[F.col(c).alias(f"{c}2") for c in "xyz"], *[c.alias(f"b{k}") for k, c in enumerate(cube)], F.explode(around).alias("s"))
    b = b.select("target", "j", "x2", "y2", "z2", *[(F.col(f"b{k}") + F.col("s")[k]).alias(f"c{k}") for k in range(3)])
    d = F.sqrt(sum((F.col(c) - F.col(f"{c}2")) * (F.col(c) - F.col(f"{c}2")) for c in "xyz"))
    # the copies are 27 times the rows, which no estimate of sizes sees: they are not to be broadcast
    pairs = a.join(b.hint("merge"), ["target", "c0", "c1", "c2"]).select("target", "i", "j", d.alias("d"))
    return pairs.filter((F.col("d") <= radius) & ((F.col("d") >= least) if least else (F.col("d") > 0)))


def contacts(residues: DataFrame, cutoff: float = 7.8) -> DataFrame:
    """Both directions of each contact."""
    return near_pairs(residues, residues, cutoff)


def burial(residues: DataFrame, radius: float = 10.0) -> DataFrame:
    """(target, i, burial): other residues within the radius, 0 included."""
    n = near_pairs(residues, residues, radius).groupBy("target", "i").agg(F.count(F.lit(1)).alias("burial"))
    return residues.select("target", "i").join(n, ["target", "i"], "left").fillna(0, ["burial"])


def graph_stats(residues: DataFrame, edges: DataFrame) -> DataFrame:
    """(target, n, edges, mean_degree) of each target."""
    n = residues.groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    m = edges.groupBy("target").agg(F.count(F.lit(1)).alias("both"))
    return n.join(m, "target", "left").fillna(0, ["both"]).select("target", "n", F.expr("both div 2").alias("edges"), (F.col("both") / F.col("n")).alias("mean_degree"))


def hessian_blocks(residues: DataFrame, cutoff: float = 12.0) -> DataFrame:
    """(target, i, j, k, l, h): blocks of the elastic network's Hessian; each contact gives its unit direction's outer
    product, once to both diagonals and negated to the blocks across."""
    p = residues.select("target", F.col("i"), *[F.col(c).alias(f"{c}1") for c in "xyz"])
    q = residues.select("target", F.col("i").alias("j"), *[F.col(c).alias(f"{c}2") for c in "xyz"])
    edges = contacts(residues, cutoff).join(p, ["target", "i"]).join(q, ["target", "j"])
    unit = F.array(*((F.col(f"{c}2") - F.col(f"{c}1")) / F.col("d") for c in "xyz"))
    cells = edges.withColumn("u", unit).withColumn("k", F.explode(F.array(*map(F.lit, range(3))))).withColumn("l", F.explode(F.array(*map(F.lit, range(3)))))
    h = cells.select("target", "i", "j", "k", "l", (F.col("u")[F.col("k")] * F.col("u")[F.col("l")]).alias("h"))
    diagonal = h.groupBy("target", "i", "k", "l").agg(F.sum("h").alias("h")).select("target", "i", F.col("i").alias("j"), "k", "l", "h")
    return diagonal.unionByName(h.withColumn("h", -F.col("h")))
