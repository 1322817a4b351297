"""Structure files against what was written into them."""

import os

import pytest

from residua.plans import structures
from residua.sources import mmcif
from tests.compare import oracle, shown

SF = "/root/testdata/sf0.001"
HEAD = "loop_\n" + "".join(f"_atom_site.{n}\n" for n in structures._NAMES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(structures.ORACLES))
def test_structures_equal_sql(spark, name):
    assert shown(structures.QUERIES[name](spark, SF).toPandas()) == shown(oracle(structures.ORACLES[name], SF))


def test_values_that_are_quoted_or_over_several_lines(spark, tmp_path):
    text = "data_x\n_a.b 'ATOM 1'\n" + HEAD + "ATOM 1 C 'C A' . GLY A\n5 ? 1.0 2.0 3.0 1.0\n;two\nlines\n;\n1\nATOM 2 N \"N'1\" . GLY A 5 ? 4.0 5.0 6.0 . '?' 1 # a note\n#\nloop_\n_other.x\nATOM\n"
    (tmp_path / "a.cif").write_text(text)
    got = mmcif.scanned(spark, str(tmp_path), ["atom", "x", "occ", "resnum"]).orderBy("at").select("at", "atom", "x", "occ", "resnum").collect()
    assert [tuple(r) for r in got] == [(0, "two\nlines", 1.0, 1.0, 5), (1, "?", 4.0, None, 5)]
    (tmp_path / "b.cif").write_text("data_y\n_a.b 1\n")
    assert mmcif.scanned(spark, str(tmp_path / "b.cif")).count() == 0


def test_first_model_alternates_windows_and_errors(spark, tmp_path):
    atoms = ["ATOM 1 C CA A GLY A 5 ? 1 2 3 0.4 CA 4", "ATOM 2 C CA B GLY A 5 ? 4 5 6 0.6 CA 4", "HETATM 3 C CA . CSP A 6 ? 0 0 0 1 CA 4", "ATOM 5 C CA . ALA A 7 B 7 8 9 1 CA 4", "ATOM 6 C CA . ALA B 9 ? 7 8 9 1 CA 4", "ATOM 7 C CA . ALA A 8 ? 7 8 9 1 CA 1"]
    (tmp_path / "a.cif").write_text(HEAD + "\n".join(atoms) + "\n")
    rows = mmcif.atoms(spark, str(tmp_path / "a.cif"))
    told = lambda df: [(r.i, r.residue_id, r.x) for r in df.orderBy("i").collect()]
    assert told(mmcif.residues(rows)) == [(0, "A:5", 4.0), (1, "A:7B", 7.0), (2, "B:9", 7.0)]
    assert told(mmcif.residues(rows, ["A"], {"A": (6, 8)})) == [(0, "A:7B", 7.0)]
    with pytest.raises(Exception, match="no standard residues"):
        mmcif.residues(rows, ["Z"]).collect()
    with pytest.raises(Exception, match="ligand XYZ is absent"):
        mmcif.ligand_contacts(rows, "XYZ").collect()
    assert {r.residue_id for r in mmcif.ligand_contacts(rows, "CSP", 9.0).collect()} == {"A:5"}
