"""Tie-aware evaluation of scores against binary truth, by target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from residua.functions.ranks import average_rank


def scope(residues: DataFrame) -> DataFrame:
    """The residues that scores are held against: all but the sources."""
    return residues.filter(~F.col("source"))


def average_precision(rows: DataFrame) -> DataFrame:
    """(target, ap): rows of one score form one step of the curve; null without true rows."""
    steps = rows.groupBy("target", "score").agg(F.sum("truth").alias("tp"), F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("target").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("target")
    steps = steps.select("target", "tp", F.sum("tp").over(down).alias("a"), F.sum("n").over(down).alias("b"), F.sum("tp").over(every).alias("p"))
    return steps.groupBy("target").agg(F.sum(F.try_divide("tp", "p") * F.col("a") / F.col("b")).alias("ap"))


def auroc(rows: DataFrame) -> DataFrame:
    """(target, auroc) from average ranks; null where one class is absent."""
    ranked = rows.withColumn("r", average_rank("score", "target"))
    s = ranked.groupBy("target").agg(F.sum(F.when(F.col("truth") == 1, F.col("r"))).alias("r"), F.sum("truth").cast("double").alias("p"), F.count(F.lit(1)).cast("double").alias("n"))
    return s.select("target", F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("n") - F.col("p"))).alias("auroc"))


def hits_at_k(rows: DataFrame, k: int = 5) -> DataFrame:
    """(target, hits): true rows among the k best; ties to the lower index."""
    best = rows.withColumn("r", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("score"), "i"))).filter(F.col("r") <= k)
    return best.groupBy("target").agg(F.sum("truth").cast("bigint").alias("hits"))


def evaluation(rows: DataFrame, k: int = 5) -> DataFrame:
    """(target, n, positives, floor, ap, lift, auroc, hits) of targets with both classes."""
    base = rows.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.sum("truth").cast("bigint").alias("positives")).filter("positives > 0 and positives < n")
    base = base.withColumn("floor", F.col("positives") / F.col("n"))
    out = base.join(average_precision(rows), "target").join(auroc(rows), "target").join(hits_at_k(rows, k), "target")
    return out.select("target", "n", "positives", "floor", "ap", (F.col("ap") / F.col("floor")).alias("lift"), "auroc", "hits")


def mean_difference(rows: DataFrame, value: str) -> DataFrame:
    """(target, smd): standardised mean difference of a value between true and other rows."""
    a, b = (F.when(F.col("truth") == t, F.col(value)) for t in (1, 0))
    pooled = F.sqrt(0.5 * (F.var_pop(a) + F.var_pop(b)))
    return rows.groupBy("target").agg(F.when(pooled <= 1e-12, 0.0).otherwise((F.avg(a) - F.avg(b)) / pooled).alias("smd"))


def strongest_mean(rows: DataFrame, k: int = 5) -> DataFrame:
    """(target, strongest): mean of the k largest scores."""
    best = rows.withColumn("r", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("score"), "i"))).filter(F.col("r") <= k)
    return best.groupBy("target").agg(F.avg("score").alias("strongest"))
