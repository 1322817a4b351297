"""Queries that write the chains as mmCIF files and read them back, with the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from residua.operators import graph
from residua.plans.catalog import _WITH
from residua.sources import mmcif
from residua.sources.chains import chain

_HEAD = "data_chain\n_struct.title\n;\nATOM 1 C CA . GLY A 1 ? 0.0 0.0 0.0 1 CA 1\n;\nloop_\n_atom_type.symbol\nC\nN\n#\nloop_\n"
_NAMES = ("group_PDB", "id", "type_symbol", "label_atom_id", "label_alt_id", "auth_comp_id", "auth_asym_id", "auth_seq_id", "pdbx_PDB_ins_code", "Cartn_x", "Cartn_y", "Cartn_z", "occupancy", "auth_atom_id", "pdbx_PDB_model_num")


def _written(spark, sf_dir):
    """A file a target: residues with two heavy atoms and a hydrogen, every seventh in two places, every eleventh a modified
    one, and by every fortieth an atom of a ligand, under a quoted name; a second model in which all is elsewhere."""
    rows = chain(spark, sf_dir)
    place = lambda *xyz: F.concat_ws(" ", *[F.format_string("%.3f", c) for c in xyz])
    x, y, z = (F.col(c) for c in "xyz")

    def line(kind, name, element, at, resname=F.when(F.col("i") % 11 == 5, "MSE").otherwise("ALA"), alt=F.lit("."), occ=F.lit("1.00"), number=F.col("i") + 1, model="1"):
        group = F.lit("HETATM") if kind == "het" else F.when(F.col("i") % 11 == 5, "HETATM").otherwise("ATOM")
        return F.concat_ws(" ", group, F.col("i").cast("string"), F.lit(element), F.lit(name), alt, resname, F.lit("A"), number.cast("string"), F.lit("?"), at, occ, F.lit(name), F.lit(model))

    two = F.col("i") % 7 == 3
    lines = F.array(
        line("res", "CA", "C", place(x, y, z), alt=F.when(two, "A").otherwise("."), occ=F.when(two, "0.40").otherwise("1.00")),
        F.when(two, line("res", "CA", "C", place(x + 0.25, y, z), alt=F.lit("B"), occ=F.lit("0.60"))),
        line("res", "CB", "C", place(x + 1, y, z)),
        line("res", "HA", "H", place(x, y, z + 0.5)),
        F.when(F.col("i") % 40 == 8, line("het", '"O5\'"', "O", place(x + 2, y, z), resname=F.lit("LIG"), number=F.col("i") + 9001)),
        F.when(F.col("i") % 40 == 8, line("het", "\"H5'\"", "H", place(x, y, z), resname=F.lit("LIG"), number=F.col("i") + 9001)),
    )
    again = line("res", "CA", "C", place(x + 100, y, z), model="2")
    each = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("i", c.alias("l")))), lambda r: r["l"])
    body = rows.select("target", "i", F.array_compact(lines).alias("lines"), again.alias("again")).groupBy("target").agg(each(F.array_join("lines", "\n")).alias("first"), each(F.col("again")).alias("second"))
    head = _HEAD + "".join(f"_atom_site.{n}\n" for n in _NAMES)
    path = graph.scratch(spark)
    body.select("target", F.concat(F.lit(head), F.array_join("first", "\n"), F.lit("\n"), F.array_join("second", "\n"), F.lit("\n#")).alias("value")).write.partitionBy("target").text(path)
    return mmcif.atoms(spark, path)


def _named(df):
    return df.withColumn("target", F.regexp_extract("file", "target=(-?\\d+)", 1).cast("int"))


def scan_residues(spark, sf_dir):
    """Within a window of author numbers."""
    return _named(mmcif.residues(_written(spark, sf_dir), ["A"], {"A": (3, 1_000_000)})).select("target", "i", "residue_id", "x", "y", "z")


def scan_heavy_atoms(spark, sf_dir):
    rows = _named(mmcif.heavy(_written(spark, sf_dir)))
    return rows.select("target", "group", "resname", "resnum", "atom", "element", "x", "y", "z")


def scan_ligand_contacts(spark, sf_dir):
    return _named(mmcif.ligand_contacts(_written(spark, sf_dir), "LIG")).select("target", "residue_id", F.round("least", 6).alias("least"))


_ATOMS = f"""{_WITH},
ha AS (SELECT target, CASE WHEN i % 11 = 5 THEN 'HETATM' ELSE 'ATOM' END AS "group", CASE WHEN i % 11 = 5 THEN 'MSE' ELSE 'ALA' END AS resname, i + 1 AS resnum, 'CA' AS atom, 'C' AS element, i, round(x + CASE WHEN i % 7 = 3 THEN 0.25 ELSE 0 END, 3) AS x, y, z FROM chain
  UNION ALL SELECT target, CASE WHEN i % 11 = 5 THEN 'HETATM' ELSE 'ATOM' END, CASE WHEN i % 11 = 5 THEN 'MSE' ELSE 'ALA' END, i + 1, 'CB', 'C', i, round(x + 1, 3), y, z FROM chain
  UNION ALL SELECT target, 'HETATM', 'LIG', i + 9001, 'O5''', 'O', i, round(x + 2, 3), y, z FROM chain WHERE i % 40 = 8)"""
ORACLES = {
    "scan_residues": f"{_ATOMS} SELECT target, (row_number() OVER (PARTITION BY target ORDER BY i) - 1)::INT AS i, 'A:' || resnum AS residue_id, x, y, z FROM ha WHERE atom = 'CA' AND resname = 'ALA' AND resnum >= 3",
    "scan_heavy_atoms": f'{_ATOMS} SELECT target, "group", resname, resnum, atom, element, x, y, z FROM ha',
    "scan_ligand_contacts": f"{_ATOMS} SELECT target, residue_id, round(min(d), 6) AS least FROM (SELECT a.target, 'A:' || a.resnum AS residue_id, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS d FROM ha a JOIN ha b ON a.target = b.target WHERE a.resname = 'ALA' AND b.resname = 'LIG') WHERE d > 0 AND d <= 4.5 GROUP BY ALL",
}
QUERIES = {f.__name__: f for f in (scan_residues, scan_heavy_atoms, scan_ligand_contacts)}
