"""Connected components of links that may not fit one machine, by rounds of least neighbours and jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.llm.common import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root) for every id in links: the smallest id that it reaches. Each round hooks every id, and the root that it
    has, to the least root among its neighbours, then follows roots of roots; a round is written to the shared folder.
    A link with a null end, or of an id with itself, joins nothing. Hot ids are aggregated before the shuffle. Rounds grow with the logarithm of a component's diameter."""
    both = links.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y"))
    edges = written(both.filter("x > y").union(both.filter("x < y").select("y", "x")).distinct(), "links")
    while True:
        # large star: neighbours above an id join the least of its neighbourhood
        around = edges.select("x", "y").union(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = around.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        big = around.filter("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        # small star: neighbours below an id, and the id, join the least of them
        lowest = big.groupBy("x").agg(F.min("y").alias("m"))
        new = big.join(lowest, "x").select(F.when(F.col("y") == F.col("m"), F.col("x")).otherwise(F.col("y")).alias("x"), F.col("m").alias("y")).distinct()
        new = written(new, "links")
        # done when every id hangs on one root that hangs on none
        state = new.groupBy("x").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("many"))
        nested = new.select(F.col("y").alias("x")).distinct().join(new, "x", "left_semi").limit(1).count()
        edges = new
        if not state.first()[0] and not nested:
            break
    roots = edges.groupBy("x").agg(F.min("y").alias("root"))
    return roots.union(roots.select(F.col("root").alias("x"), "root").distinct()).select(F.col("x").alias("id"), "root")
