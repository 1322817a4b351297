import numpy as np
import pytest
from pyspark.sql import functions as F

from residua.operators import cavity, fields
from residua.sources import pockets, results


def _average_precision(truth, score):
    order = np.argsort(-score)
    hits = np.cumsum(truth[order])
    return (hits / np.arange(1, len(truth) + 1))[truth[order] == 1].mean()


def test_random_lift_equals_numpy(spark):
    truth = np.array([0, 1, 0, 0, 1, 0, 0])
    rows = spark.createDataFrame([("t", i, int(t)) for i, t in enumerate(truth) if i != 3] + [("u", i, 0) for i in range(3)], "target string, i int, truth int")
    found = {r.target: r for r in fields.random_lift(rows, spark.createDataFrame([("t", 7), ("u", 3)], "target string, n int"), 20).collect()}
    keep = np.arange(7) != 3
    lifts = [_average_precision(truth[keep], np.random.default_rng(s).random(7)[keep]) / (2 / 6) for s in range(20)]
    assert found["t"].lift == pytest.approx(np.mean(lifts)) and found["t"].spread == pytest.approx(np.std(lifts))
    assert found["u"].lift is None and found["u"].spread is None


def test_random_lift_makes_no_row_for_each_draw_and_residue(spark):
    """Rows of one index are tied; those beyond the size and without an index have no score, but count for the floor."""
    index, truth = [0, 1, 1, 2, 4, 9, None], [1, 1, 0, 0, None, 1, 1]
    rows = spark.createDataFrame([("t", i, t) for i, t in zip(index, truth, strict=True)] + [("v", 7, 1)], "target string, i int, truth int")
    found = fields.random_lift(rows, spark.createDataFrame([("t", 5), ("u", 3), ("v", 2)], "target string, n int"), 45)
    after = found._jdf.queryExecution().executedPlan().toString().split("FlatMapGroupsInArrow")[0]
    assert "Join" not in after and "Window" not in after
    lifts = []
    for s in range(45):
        drawn = np.random.default_rng(s).random(5)
        tp, n = np.array([1, 1, 0, 0]), np.array([1, 2, 1, 1])
        order = np.argsort(-drawn[[0, 1, 2, 4]])
        tp, n = tp[order], n[order]
        lifts.append((tp / 2 * np.cumsum(tp) / np.cumsum(n)).sum() / (4 / 7))
    (r,) = found.collect()
    assert r.target == "t" and r.lift == pytest.approx(np.mean(lifts)) and r.spread == pytest.approx(np.std(lifts))


def test_families_with_centres_equal_greedy(spark):
    rng = np.random.default_rng(2)
    sets = sorted(({*rng.choice(14, rng.integers(2, 9), replace=False).tolist()} for _ in range(25)), key=lambda s: -len(s))
    at = rng.uniform(0, 8, (25, 3))
    members = spark.createDataFrame([("t", k, k, i) for k, s in enumerate(sets) for i in s], "target string, item int, rank int, i int")
    centres = spark.createDataFrame([("t", k, *map(float, p)) for k, p in enumerate(at) if k % 6], "target string, item int, x double, y double, z double")

    def alike(a, b):
        both = len(sets[a] & sets[b])
        near = a % 6 and b % 6 and np.linalg.norm(at[a] - at[b]) <= 6
        return both / len(sets[a] | sets[b]) >= 0.5 or (both / min(len(sets[a]), len(sets[b])) >= 0.5 and near)

    leaders, expected = [], {}
    for k in range(25):
        expected[k] = next((a for a in leaders if alike(a, k)), k)
        if expected[k] == k:
            leaders.append(k)
    assert {r["item"]: r.leader for r in cavity.families(members, centres=centres).collect()} == expected


def test_field_takes_the_place_of_a_lone_pocket(spark):
    centres = [("t", 0, 100.0, 0.0, 0.0), ("t", 1, 0.0, 0.0, 0.0), ("t", 2, 5.0, 0.0, 0.0), ("t", 3, 5.0, 0.0, 0.0), ("t", 4, 30.0, 0.0, 0.0)]
    members = [("t", 0, i) for i in (50, 51)] + [("t", p, i) for p in (1, 2, 3) for i in range(6)] + [("t", 4, 70)]
    got = {}
    for response in (1.0, 2.0, 0.0):  # of the lone pocket 0, which has the largest transport
        scores = [("t", 0, 0.9, response), ("t", 1, 0.8, 0.5), ("t", 2, 0.7, 0.96), ("t", 3, 0.7, 0.3), ("t", 4, 0.1, 9.0)]
        frames = [spark.createDataFrame(x, "target string, pocket int, " + y) for x, y in ((centres, "x double, y double, z double"), (members, "i int"), (scores, "transport double, mechanical double"))]
        got[response] = [(r.pocket, r.recurrent, r.nodes) for r in fields.cavity_field(*frames).collect()]
    assert got == {1.0: [(0, True, list(range(6)))], 2.0: [(0, False, [50, 51])], 0.0: [(0, False, [50, 51])]}


def test_pocket_files(spark, tmp_path):
    folder = tmp_path / "1abc_out" / "pockets"
    folder.mkdir(parents=True)
    head = "HEADER 0  - Pocket Score                      : 0.5000\n"
    atom = "ATOM      1  CA  SER {}  12       1.000   2.000   3.000  0.00  0.00\n"
    (folder / "pocket2_atm.pdb").write_text(head + "HEADER  - Pocket volume (Monte Carlo)      : 120.5\n" + atom.format("A") + atom.format("B") + "HETATM    2  C1  LIG A  13    1.0 2.0 5.0 0.00\n")
    (folder / "pocket2_vert.pqr").write_text("ATOM      1  APO STP     1       1.000   2.000   4.000  0.00     1.00\n")
    (folder / "pocket10_atm.pdb").write_text(head + atom.format("A"))
    (folder / "pocket3_atm.pdb").write_text(atom.format("A"))
    (folder / "pocket4_atm.pdb").write_text(head + atom.format("C"))
    files = pockets.read_files(spark, str(folder))
    got = [tuple(r) for r in pockets.pockets(files, ["A"]).orderBy("number", "residue").collect()]
    assert got == [("1abc_out", 2, 0.5, 120.5, 12, 1.0, 2.0, 4.0, 1.0), ("1abc_out", 2, 0.5, 120.5, 13, 1.0, 2.0, 4.0, 1.0), ("1abc_out", 10, 0.5, 0.0, 12, None, None, None, None)]
    (folder / "pocket10_vert.pqr").write_text("HEADER\n")
    with pytest.raises(Exception, match="no alpha spheres for pocket 10"):
        pockets.pockets(pockets.read_files(spark, str(folder)), ["A"]).collect()


#: Of the width of their columns, wider, and so wide that they leave no blank.
WIDE = [(1.25, -999.999, 9999.999), (-1430.123, 12.5, -3.0), (10000.5, 2.0, 17918.25), (0.0, -1430.123, -2000.5), (1.0, 2.0, -17115.125), (-100000.001, -100000.002, -100000.003)]


def test_snapshots_hold_wide_coordinates(spark, tmp_path):
    rows = [(t, 0, 7 + k, "CA", "C", "ALA", "A", 9 + k, *at) for t in (1,) for k, at in enumerate(WIDE)]
    atoms = spark.createDataFrame(rows, "target int, snapshot int, serial int, atom string, element string, resname string, chain string, resnum int, x double, y double, z double")
    results.write_snapshots(atoms, str(tmp_path / "s"))
    assert sorted(map(tuple, results.read_snapshots(spark, str(tmp_path / "s")).select(*atoms.columns).collect())) == rows


def test_pocket_files_hold_wide_coordinates(spark):
    head = "HEADER 0  - Pocket Score                      : 0.5000\n"
    atoms = "".join("ATOM  %5d  CA  RES A%4d    %8.3f%8.3f%8.3f\n" % (k, 9995 + k, *at) for k, at in enumerate(WIDE[:5]))
    for x, y, z in WIDE:
        ball = "ATOM      1  APO STP     1    %8.3f%8.3f%8.3f  0.00     1.50" % (x, y, z)
        files = spark.createDataFrame([("9/pockets/pocket1_atm.pdb", head + atoms), ("9/pockets/pocket1_vert.pqr", ball)], "path string, text string")
        got = pockets.pockets(files, ["A"]).collect()
        assert len(got) == 5 and {(r.x, r.y, r.z) for r in got} == {(x, y, z)}
    near = [("9/pockets/pocket1_atm.pdb", head + "ATOM      1  CA  RES A9995    -1430.123-1200.000-1000.000\n"), ("9/pockets/pocket1_vert.pqr", "ATOM      1  APO STP     1    -1430.123-1200.000-1001.500  0.00     1.50")]
    assert pockets.pockets(spark.createDataFrame(near, "path string, text string"), ["A"]).first().void_support == pytest.approx(1)


def test_general_form_of_doubles(spark):
    values = [0.0, 1.0, 0.5, 0.123456789, 1e-5, 2.5e-7, 100.0, 123456.789, 1e12]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r.s for r in frame.select(results.general("v").alias("s")).collect()] == ["%.10g" % v for v in values]


def test_evaluations_keep_their_nulls(spark, tmp_path):
    row = spark.createDataFrame([(1, 5, 0, 0.0, None, None, None, 0)], results.EVALUATION)
    results.write_evaluation(row, str(tmp_path / "e"))
    assert results.read_evaluation(spark, str(tmp_path / "e")).collect() == row.collect()
    assert '"ap":null' in spark.read.text(str(tmp_path / "e")).select(F.col("value")).first()[0]
