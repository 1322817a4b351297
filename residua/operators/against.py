"""Rows that each meet whole tables of their own target, a batch of rows to a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Parts of a target's rows, each of which has a copy of its tables.
PARTS = 32


def packed(rows: DataFrame, name: str) -> DataFrame:
    """(target, name): each target's rows as one Arrow stream, some tens of bytes a row."""
    kind = rows.schema["target"].dataType.simpleString()

    def pack(table: pa.Table) -> pa.Table:
        sink, own = pa.BufferOutputStream(), table.drop_columns(["target"]).combine_chunks()
        with pa.ipc.new_stream(sink, own.schema) as out:
            out.write_table(own)
        return pa.table({"target": table.column("target").slice(0, 1), name: pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    return rows.groupBy("target").applyInArrow(pack, f"target {kind}, {name} binary")


def against(rows: DataFrame, tables: dict[str, DataFrame], work: Callable[..., dict], schema: str, size: int = 64, ready: Callable[..., dict] | None = None) -> DataFrame:
    """(target and the columns of schema) that work makes of batches of rows (target, ...) and the tables of their target.

    work gets a batch as an Arrow table and, by name, each table's rows of the batch's target, or None without any, and
    returns columns. Batches hold at most `size` rows, and what they make, often as many rows as the product, leaves a task
    before the next batch is taken. ready, if given, gets the tables and makes what work gets in their place, once for all
    batches of a part. The rows of a target are dealt evenly over PARTS parts at most, each with a copy of its tables, so
    that what is shuffled grows with the rows and the tables, not with their product."""
    spark, kind = rows.sparkSession, rows.schema["target"].dataType.simpleString()
    names = [c for c in rows.columns if c != "target"]
    number = F.row_number().over(Window.partitionBy("target").orderBy(names[0])) - 1
    each = F.greatest(F.lit(size), F.ceil(F.count(F.lit(1)).over(Window.partitionBy("target")) / PARTS))
    batches = rows.withColumn("part", F.floor(number / each)).groupBy("target", "part").agg(F.collect_list(F.struct(*names)).alias("batch"))
    held_names = list(tables)
    for name, table in tables.items():
        batches = batches.join(packed(table, name), "target", "left")

    def run(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a group is one row
        for table in groups:
            held = {n: table.column(n)[0].as_py() for n in held_names}
            held = {n: None if v is None else pa.ipc.open_stream(v).read_all() for n, v in held.items()}
            held = held if ready is None else ready(**held)
            own = pa.Table.from_struct_array(table.column("batch").flatten())
            for k in range(0, len(own), size):
                made = work(own.slice(k, size).combine_chunks(), **held)
                count = len(next(iter(made.values())))
                target = table.column("target").take(pa.array(np.zeros(count, np.int64)))
                yield from pa.table({"target": target} | made).combine_chunks().to_batches()

    dealt = batches.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "target", "part")
    return dealt.groupBy("target", "part").applyInArrow(run, f"target {kind}, {schema}")
