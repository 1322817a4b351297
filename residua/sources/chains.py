"""Residue tables: a protein-like chain built from the embeddings table (sources.mmcif has those of structure files).

A residue table has target, i (position in its target), residue_id, x, y, z, score, truth and source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Distance of neighbours in a chain, in angstrom.
STEP = 3.8


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain per label: each vector's first three components, as a step of STEP, added to the residue before."""
    at = [F.col("embedding")[k].cast("double") for k in range(8)]
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("label").alias("target"), "vec_id", *[c.alias(f"e{k}") for k, c in enumerate(at)])
    order = Window.partitionBy("target").orderBy("vec_id")
    before = order.rowsBetween(Window.unboundedPreceding, 0)
    r = F.sqrt(F.col("e0") * F.col("e0") + F.col("e1") * F.col("e1") + F.col("e2") * F.col("e2"))
    place = [F.round(F.sum(STEP * F.col(f"e{k}") / r).over(before), 3).alias(n) for k, n in enumerate("xyz")]
    rows = rows.withColumn("i", (F.row_number().over(order) - 1).cast("int")).select("target", "vec_id", "i", *place, F.round("e6", 6).alias("score"), (F.col("e7") > 0.05).cast("int").alias("truth"))
    return rows.withColumn("residue_id", F.concat(F.lit("A:"), (F.col("i") + 1).cast("string"))).withColumn("source", F.col("i") % 25 == 3)
