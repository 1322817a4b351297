"""Pocket files of a cavity program: lining atoms (pocketN_atm.pdb) and alpha spheres (pocketN_vert.pqr)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.sources.atoms import column, places

ATOMS, SPHERES = r"([^/]+)/pockets/pocket(\d+)_atm\.pdb$", r"([^/]+)/pockets/pocket(\d+)_vert\.pqr$"


def read_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, text) of whole files."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _lines(files: DataFrame, name: str) -> DataFrame:
    """Atom lines of the files of this name, with coordinates of any width; those that have not three decimals are taken by
    column, or by field where a column holds no number."""
    rows = files.select(F.regexp_extract("path", name, 1).alias("target"), F.regexp_extract("path", name, 2).alias("number"), F.explode(F.split("text", r"\r\n|\r|\n")).alias("line"))
    rows = rows.filter((F.col("number") != "") & F.col("line").rlike("^(ATOM|HETATM)"))
    fields = F.split(F.trim("line"), r"\s+")
    fixed = [column("line", k).try_cast("double") for k in range(3)]
    whole = fixed[0].isNotNull() & fixed[1].isNotNull() & fixed[2].isNotNull()
    at, _ = places("line", [F.when(whole, fixed[k]).otherwise(fields[6 + k].cast("double")) for k in range(3)])
    return rows.select("target", F.col("number").cast("int").alias("number"), "line", F.element_at(fields, -1).alias("last"), *[x.alias(c) for c, x in zip("xyz", at, strict=True)])


def pockets(files: DataFrame, chains: list[str]) -> DataFrame:
    """(target, number, score, volume, residue, x, y, z, void_support) of files (path, text): a row a lining residue of
    these chains. A file without a score or without such residues gives nothing; a missing volume is 0. x, y, z is the
    mean of the pocket's spheres; void_support is how close the spheres' surfaces come to the residue's nearest atom,
    exp(-((distance - radius) / 0.25)^2 / 2) in the mean; both are null without a sphere file, and one without spheres
    fails. target is the folder above `pockets`."""
    found = lambda pattern: F.regexp_extract("text", pattern, 1)
    heads = files.select(F.regexp_extract("path", ATOMS, 1).alias("target"), F.regexp_extract("path", ATOMS, 2).alias("number"), found(r"Pocket Score\s+:\s+([0-9.]+)").alias("score"), found(r"Pocket volume \(Monte Carlo\)\s+:\s+([0-9.]+)").alias("volume"))
    heads = heads.filter("number != '' and score != ''").select("target", F.col("number").cast("int").alias("number"), F.col("score").cast("double").alias("score"), F.when(F.col("volume") == "", 0.0).otherwise(F.col("volume").try_cast("double")).alias("volume"))
    atoms = _lines(files, ATOMS).filter(F.trim(F.substring("line", 22, 1)).isin(chains))
    lining = atoms.groupBy("target", "number", F.trim(F.substring("line", 23, 4)).cast("int").alias("residue")).agg(F.collect_list(F.struct("x", "y", "z")).alias("atoms"))
    balls = _lines(files, SPHERES).groupBy("target", "number").agg(F.collect_list(F.struct("x", "y", "z", F.col("last").cast("double").alias("r"))).alias("balls"), *[F.avg(c).alias(c) for c in "xyz"])
    named = files.select(F.regexp_extract("path", SPHERES, 1).alias("target"), F.regexp_extract("path", SPHERES, 2).alias("number")).filter("number != ''").select("target", F.col("number").cast("int").alias("number"), F.lit(True).alias("named"))
    rows = lining.join(heads, ["target", "number"]).join(named, ["target", "number"], "left").join(balls, ["target", "number"], "left")
    far = lambda s, a: F.sqrt(sum((s[c] - a[c]) * (s[c] - a[c]) for c in "xyz"))
    close = lambda s: (F.array_min(F.transform("atoms", lambda a: far(s, a))) - s["r"]) / 0.25
    support = F.aggregate(F.transform("balls", lambda s: F.exp(-0.5 * close(s) * close(s))), F.lit(0.0), lambda a, b: a + b) / F.size("balls")
    failed = F.raise_error(F.concat(F.lit("no alpha spheres for pocket "), F.col("number").cast("string"))).cast("double")
    void = F.when(F.col("balls").isNotNull(), support).when(F.col("named"), failed)
    return rows.select("target", "number", "score", "volume", "residue", "x", "y", "z", void.alias("void_support"))
