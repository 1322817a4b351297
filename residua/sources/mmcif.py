"""mmCIF files as a table of atoms, with quoted and multi-line values, and what is selected from it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from residua.operators.geometry import near_pairs

#: The standard amino acids.
STANDARD = "ALA ARG ASN ASP CYS GLN GLU GLY HIS ILE LEU LYS MET PHE PRO SER THR TRP TYR VAL".split()
#: Columns of the table by the loop's names, with their types; those that are not asked for are not kept.
FIELDS = {
    "group": ("group_PDB", "string"), "chain": ("auth_asym_id", "string"), "resnum": ("auth_seq_id", "int"), "icode": ("pdbx_PDB_ins_code", "string"), "resname": ("auth_comp_id", "string"),
    "atom": ("auth_atom_id", "string"), "element": ("type_symbol", "string"), "occ": ("occupancy", "double"), "x": ("Cartn_x", "double"), "y": ("Cartn_y", "double"), "z": ("Cartn_z", "double"), "model": ("pdbx_PDB_model_num", "int"),
}
_QUOTED = re.compile(r"""'(?P<one>(?:[^']|'(?=\S))*)'(?=\s|$)|"(?P<two>(?:[^"]|"(?=\S))*)"(?=\s|$)|#.*|(?P<bare>\S+)""")
_BATCH = 20_000


def _values(line: str) -> list[str | None]:
    """A line's values; null for an unquoted . or ?."""
    if "'" not in line and '"' not in line and "#" not in line:
        return [None if v in ("?", ".") else v for v in line.split()]
    out = []
    for m in _QUOTED.finditer(line):
        if m["bare"] is not None:
            out.append(None if m["bare"] in ("?", ".") else m["bare"])
        elif m["one"] is not None or m["two"] is not None:
            out.append(m["one"] if m["one"] is not None else m["two"])
    return out


def atom_rows(text: str, wanted: list[str]) -> Iterator[list[str | None]]:
    """The values of the wanted names of each row of the file's atom loop."""
    names: list[str] = []
    at, values, lines = None, [], iter(text.splitlines())
    in_loop = header = False
    for line in lines:
        if line.startswith(";"):  # a value over several lines, up to a line that begins so too
            block = [line[1:]]
            for more in lines:
                if more.startswith(";"):
                    break
                block.append(more)
            new: list[str | None] = ["\n".join(block)]
        else:
            start = line.lstrip()
            if start.startswith("loop_"):
                in_loop, header, names, values = True, True, [], []
                continue
            if header and start.startswith("_"):
                names.append(start.split()[0])
                continue
            if start.startswith(("_", "data_", "#")) or not start:
                in_loop = in_loop and not start
                header = False
                continue
            new = _values(line)
        if header:
            header = False
            place = {n[len("_atom_site.") :]: k for k, n in enumerate(names) if n.startswith("_atom_site.")}
            at = [place.get(n) for n in wanted] if place else None
        if in_loop and at is not None:
            values += new
            while len(values) >= len(names):
                yield [None if k is None else values[k] for k in at]
                values = values[len(names) :]


def scanned(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """(file, at, and the columns asked for) of every atom of mmCIF files, in file order. Spark reads the files, each whole
    in one row. A name that a file's loop lacks is null; a file without the loop has no rows."""
    columns = columns or list(FIELDS)
    wanted = [FIELDS[c][0] for c in columns]
    ddl = "file string, at int, " + ", ".join(f"`{c}` string" for c in columns)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(file: str, first: int, rows: list) -> pa.RecordBatch:
            values = [pa.array(v, pa.string()) for v in zip(*rows, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([file] * len(rows)), pa.array(range(first, first + len(rows)), pa.int32()), *values], ["file", "at", *columns])

        for b in batches:
            for file, text in zip(b.column(0), b.column(1), strict=True):
                rows, first = [], 0
                for row in atom_rows(text.as_py(), wanted):
                    rows.append(row)
                    if len(rows) == _BATCH:
                        yield batch(file.as_py(), first, rows)
                        rows, first = [], first + len(rows)
                if rows:
                    yield batch(file.as_py(), first, rows)

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return files.mapInArrow(parse, ddl).select("file", "at", *[F.col(c).try_cast(FIELDS[c][1]).alias(c) for c in columns])


def atoms(spark: SparkSession, path: str) -> DataFrame:
    """Atoms of each file's first model. Of alternate locations the one of the highest occupancy stays, the first on a tie."""
    rows = scanned(spark, path).withColumn("icode", F.coalesce("icode", F.lit(""))).withColumn("model", F.coalesce("model", F.lit(1)))
    first = rows.groupBy("file").agg(F.min_by("model", "at").alias("least"))
    rows = rows.join(first, "file").filter("model = least").drop("least", "model")
    best = Window.partitionBy("file", "chain", "resnum", "icode", "resname", "atom").orderBy(F.desc("occ"), "at")
    return rows.withColumn("best", F.row_number().over(best)).filter("best = 1").drop("best")


def _required(found: DataFrame, needed: DataFrame, all_: DataFrame, what: str) -> DataFrame:
    """found, or an error for a file of all_ that has no row in needed. The error is a row of the result: as a row below a
    join it would be pruned."""
    none = all_.select("file").distinct().join(needed.select("file").distinct(), "file", "left_anti")
    failing = none.select(*[(F.raise_error(F.concat(F.lit(f"{what}: "), "file")).cast(t) if c == "file" else F.lit(None).cast(t)).alias(c) for c, t in found.dtypes])
    return found.union(failing)


def residues(atoms: DataFrame, chains: list[str] | None = None, windows: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """(file, i, residue_id, resname, x, y, z): C-alpha atoms of standard residues in file order. windows: the first and the
    last author number by chain, for the chains that have one. A file in which nothing is left is an error."""
    rows = atoms.filter((F.col("group") == "ATOM") & (F.col("atom") == "CA") & F.col("resname").isin(STANDARD))
    if chains is not None:
        rows = rows.filter(F.col("chain").isin(list(chains)))
    for chain, (first, last) in (windows or {}).items():
        rows = rows.filter((F.col("chain") != chain) | F.col("resnum").between(first, last))
    order = F.row_number().over(Window.partitionBy("file").orderBy("at")) - 1  # a file is one structure
    out = rows.select("file", order.cast("int").alias("i"), F.concat("chain", F.lit(":"), F.col("resnum").cast("string"), "icode").alias("residue_id"), "resname", "x", "y", "z")
    return _required(out, out, atoms, "no standard residues match the selection")


def heavy(atoms: DataFrame) -> DataFrame:
    """Atoms other than hydrogen and deuterium."""
    return atoms.filter(~F.upper("element").isin("H", "D"))


def ligand_contacts(atoms: DataFrame, ligand: str, radius: float = 4.5, chain: str = "A") -> DataFrame:
    """(file, residue_id, least): standard residues of a chain with a heavy atom within the radius of one of the ligand's.
    A file without the ligand is an error."""
    rows = heavy(atoms)
    own = rows.filter(F.trim("resname") == ligand)
    around = rows.filter((F.col("group") == "ATOM") & (F.col("chain") == chain) & F.col("resname").isin(STANDARD))
    around = around.withColumn("id", F.concat("chain", F.lit(":"), F.col("resnum").cast("string"), "icode"))
    point = lambda df, i: df.select(F.col("file").alias("target"), F.col(i).alias("i"), "x", "y", "z")
    found = near_pairs(point(around, "id"), point(own, "at"), radius)
    out = found.groupBy(F.col("target").alias("file"), F.col("i").alias("residue_id")).agg(F.min("d").alias("least"))
    return _required(out, own, atoms, f"ligand {ligand} is absent")
