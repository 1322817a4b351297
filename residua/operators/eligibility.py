"""Which observations, pockets and residues may be used, and what they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def valid_observations(members: DataFrame, sources: DataFrame, shell: DataFrame, least: int = 5) -> DataFrame:
    """(target, pocket, size, shell_share) of pockets (target, pocket, i) with at least `least` residues, no source among
    them and less than half of them in the shell."""
    mark = lambda df, name: df.select("target", "i", F.lit(1).alias(name)).distinct()
    rows = members.join(mark(sources, "own"), ["target", "i"], "left").join(mark(shell, "near"), ["target", "i"], "left")
    out = rows.groupBy("target", "pocket").agg(F.count(F.lit(1)).alias("size"), F.count("own").alias("own"), (F.count("near") / F.count(F.lit(1))).alias("shell_share"))
    return out.filter((F.col("size") >= least) & (F.col("own") == 0) & (F.col("shell_share") < 0.5)).drop("own")


def eligible_pockets(members: DataFrame, valid: DataFrame, excluded: DataFrame, least: int = 5) -> DataFrame:
    """(target, pocket, i): residues of valid pockets that are not excluded, where at least `least` stay."""
    left = members.join(valid.select("target", "pocket"), ["target", "pocket"], "left_semi").join(excluded.select("target", "i").distinct(), ["target", "i"], "left_anti")
    return left.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("target", "pocket"))).filter(F.col("n") >= least).select("target", "pocket", "i")


def best_family(members: DataFrame, chosen: DataFrame) -> DataFrame:
    """(target, pocket, jaccard): the family (target, pocket, i) that overlaps the chosen residues (target, i) most; the first
    of equal ones."""
    sizes = members.groupBy("target", "pocket").agg(F.count(F.lit(1)).alias("n"))
    both = members.join(chosen.select("target", "i"), ["target", "i"], "left_semi").groupBy("target", "pocket").agg(F.count(F.lit(1)).alias("both"))
    rows = sizes.join(both, ["target", "pocket"], "left").fillna(0, ["both"]).join(chosen.groupBy("target").agg(F.count(F.lit(1)).alias("m")), "target")
    rows = rows.withColumn("jaccard", F.round(F.col("both") / (F.col("n") + F.col("m") - F.col("both")), 9))
    best = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("jaccard"), "pocket"))
    return rows.withColumn("k", best).filter("k = 1").select("target", "pocket", "jaccard")


def matched_controls(rows: DataFrame, tolerance: float = 0.3) -> DataFrame:
    """(target, i) of residues without truth whose burial and hop both lie within tolerance * max(mean, 1) of the mean of
    those with truth. rows: (target, i, truth, burial, hop)."""
    means = rows.filter("truth = 1").groupBy("target").agg(F.avg("burial").alias("mb"), F.avg("hop").alias("mh"))
    near = lambda c, m: F.abs(F.col(c) - F.col(m)) <= tolerance * F.greatest(F.col(m), F.lit(1.0))
    return rows.filter("truth = 0").join(means, "target").filter(near("burial", "mb") & near("hop", "mh")).select("target", "i")
