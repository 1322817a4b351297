"""Result files: residue scores, hit lists, matrices and method records, written and read by Spark with fixed schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from residua.sources.atoms import column, places

SCORES = "target int, matrix_index int, chain_id string, residue_number int, insertion_code string, quantum_score double, eligible int"
#: The form of a matrix's values.
CELL = "%.18e"
HITS = "target int, rank int, matrix_index int, residue_id string, score double"
EVALUATION = "target int, n bigint, positives bigint, floor double, ap double, lift double, auroc double, hits bigint"
POCKET = "number int, geometry_score double, score double, residue_numbers array<int>, residues array<int>"
METHOD = f"schema_version int, input_sha256 string, scope struct<residues: bigint, orthosteric: array<string>>, parameters struct<cutoff: double, top_k: int>, pocket struct<{', '.join(f'{c.split()[0]}: {c.split()[1]}' for c in POCKET.split(', '))}>"


def write_table(df: DataFrame, path: str) -> None:
    """CSV with a header and \\n line ends."""
    df.write.option("header", True).option("lineSep", "\n").option("emptyValue", "").csv(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """A missing insertion code is the empty one."""
    return spark.read.schema(SCORES).option("header", True).csv(path).fillna("", ["insertion_code"])


def read_hits(spark: SparkSession, path: str, size: int = 5) -> DataFrame:
    """Fails on a target that has not exactly `size` rows."""
    n = F.count(F.lit(1)).over(Window.partitionBy("target"))
    rows = spark.read.schema(HITS).option("header", True).csv(path).withColumn("n", n)
    rank = F.when(F.col("n") == size, F.col("rank")).otherwise(F.raise_error(F.concat(F.lit("a hit list must have "), F.lit(size), F.lit(" rows, not "), F.col("n").cast("string"))).cast("int"))
    return rows.withColumn("rank", rank).drop("n")


def write_matrix(lines: DataFrame, path: str) -> None:
    """lines (target, i, cells): a row of a matrix each, its values by j in the form %.18e between commas."""
    lines.select(F.concat_ws("|", F.col("target").cast("string"), F.col("i").cast("string"), "cells").alias("value")).write.text(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(target, i, j, v) of such lines."""
    part = F.split("value", "\\|")
    # a line is split before its cells become rows, as otherwise it would be split again for every cell
    lines = spark.read.text(path).select(part[0].cast("int").alias("target"), part[1].cast("int").alias("i"), F.split(part[2], ",").alias("cells"))
    return lines.select("target", "i", F.posexplode("cells").alias("j", "v")).withColumn("v", F.col("v").cast("double"))


def write_method(records: DataFrame, path: str) -> None:
    """records: target and the fields of METHOD as columns; one JSON document a line, with its target in front."""
    fields = [c for c in records.columns if c != "target"]
    records.select(F.concat_ws("|", F.col("target").cast("string"), F.to_json(F.struct(*fields))).alias("value")).write.text(path)


def read_method(spark: SparkSession, path: str) -> DataFrame:
    """Method records; older names of pocket fields (score, residues) stand in for missing ones."""
    cut = F.instr("value", "|")
    rows = spark.read.text(path).select(F.expr("cast(substring(value, 1, instr(value, '|') - 1) as int)").alias("target"), F.from_json(F.expr("substring(value, instr(value, '|') + 1)"), METHOD).alias("m")).filter(cut > 0)
    return rows.select(
        "target", "m.schema_version", "m.input_sha256", "m.scope", "m.parameters", F.coalesce("m.pocket.geometry_score", "m.pocket.score").alias("geometry_score"),
        F.coalesce("m.pocket.residue_numbers", "m.pocket.residues").alias("residue_numbers"),
    )


def windows(specs: DataFrame) -> DataFrame:
    """(target, chain, first, last) of specs (target, spec) of the form CHAIN:FIRST-LAST; others fail."""
    at = lambda k: F.regexp_extract("spec", r"^([^:]+):(\d+)-(\d+)$", k)
    chain = F.when(at(1) != "", at(1)).otherwise(F.raise_error(F.concat(F.lit("no window: "), F.col("spec"))))
    return specs.select("target", chain.alias("chain"), at(2).cast("int").alias("first"), at(3).cast("int").alias("last"))


def resolved(requests: DataFrame, residues: DataFrame) -> DataFrame:
    """requests (target, ord, residue_id) with the residue's index i; a repeated one counts at its first place, an unknown
    one has no index and is marked missing."""
    first = requests.groupBy("target", "residue_id").agg(F.min("ord").alias("ord"))
    return first.join(residues.select("target", "residue_id", "i"), ["target", "residue_id"], "left").withColumn("missing", F.col("i").isNull())


def replayed(one: DataFrame, two: DataFrame) -> DataFrame:
    """(target, n, unlike, same): whether two residue tables (target, i, residue_id) agree in order and names."""
    both = one.select("target", "i", F.col("residue_id").alias("a")).join(two.select("target", "i", F.col("residue_id").alias("b")), ["target", "i"], "full")
    out = both.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("unlike"))
    return out.withColumn("same", F.col("unlike") == 0)


def write_evaluation(rows: DataFrame, path: str) -> None:
    """Evaluations by target, one JSON document a line; nulls are written."""
    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def read_evaluation(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVALUATION).json(path)


def general(value: str):
    """A double in C's form %.10g."""
    plain = F.regexp_replace(F.format_string("%.10g", value), r"(\.\d*?)0+(e|$)", "$1$2")
    return F.regexp_replace(plain, r"\.(e|$)", "$1")


def labelled_lines(values: DataFrame, residues: DataFrame) -> DataFrame:
    """(target, i, line) of a matrix (target, i, j, v) with names: the header of all names stands at -1, then a line a row."""
    listed = lambda key, c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, c.alias("c")))), lambda x: x["c"]), ",")
    return named_lines(values.groupBy("target", "i").agg(listed("j", general("v")).alias("cells")), residues)


def named_lines(cells: DataFrame, residues: DataFrame) -> DataFrame:
    """(target, i, line), as labelled_lines, of lines (target, i, cells) without names."""
    names = F.transform(F.sort_array(F.collect_list(F.struct("i", "residue_id"))), lambda x: x["residue_id"])
    heads = residues.groupBy("target").agg(F.array_join(names, ",").alias("names"))
    rows = cells.join(residues.select("target", "i", "residue_id"), ["target", "i"])
    return heads.select("target", F.lit(-1).alias("i"), F.concat_ws(",", F.lit("residue_id"), "names").alias("line")).union(rows.select("target", "i", F.concat_ws(",", "residue_id", "cells")))


def manifest(lines: DataFrame) -> DataFrame:
    """(target, lines, sha256) of each target's file, every line ended by \\n."""
    text = F.concat(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n"), F.lit("\n"))
    return lines.groupBy("target").agg(F.count(F.lit(1)).alias("lines"), F.sha2(text.cast("binary"), 256).alias("sha256"))


def write_snapshots(atoms: DataFrame, path: str) -> None:
    """Snapshots (target, snapshot, serial, atom, element, resname, chain, resnum, x, y, z) as fixed-column atom lines, a
    folder a target and snapshot. Counts that their columns can't hold start again from 0; a coordinate that is too wide for
    its column moves what follows to the right."""
    name = F.when(F.length("atom") < 4, F.concat(F.lit(" "), "atom")).otherwise(F.col("atom"))
    line = F.format_string("ATOM  %5d %-4s %3s %1s%4d    %8.3f%8.3f%8.3f%6.2f%6.2f          %2s", F.col("serial") % 100_000, name, "resname", "chain", F.col("resnum") % 10_000, "x", "y", "z", F.lit(1.0), F.lit(0.0), "element")
    atoms.repartition("target", "snapshot").sortWithinPartitions("target", "snapshot", "serial").select("target", "snapshot", line.alias("value")).write.partitionBy("target", "snapshot").text(path)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """(target, snapshot, serial, atom, resname, chain, resnum, x, y, z, element) of such lines; others are left out."""
    rows = spark.read.text(path).filter(F.col("value").startswith("ATOM  "))
    cut = lambda first, size: F.trim(F.substr("value", first if isinstance(first, Column) else F.lit(first), F.lit(size)))
    at, moved = places("value", [column("value", k).cast("double") for k in range(3)])
    text = {"atom": (13, 4), "resname": (18, 3), "chain": (22, 1), "element": (77 + moved, 2)}
    return rows.select("target", "snapshot", cut(7, 5).cast("int").alias("serial"), cut(23, 4).cast("int").alias("resnum"), *[x.alias(c) for c, x in zip("xyz", at, strict=True)], *[cut(a, n).alias(c) for c, (a, n) in text.items()])
