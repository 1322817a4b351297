import itertools
import math

import numpy as np
import pytest

from residua.operators import evaluate, geometry, graph, subset
from residua.sources import mmcif


def edges_of(spark, pairs, target=0):
    return spark.createDataFrame([(target, i, j) for a, b in pairs for i, j in ((a, b), (b, a))], "target int, i int, j int")


def test_near_pairs_equal_all_pairs(spark):
    p = np.random.default_rng(1).uniform(-15, 15, (60, 3)).round(3)
    rows = spark.createDataFrame([(0, i, *map(float, x)) for i, x in enumerate(p)], "target int, i int, x double, y double, z double")
    got = {(r.i, r.j) for r in geometry.near_pairs(rows, rows, 7.8).collect()}
    assert got == {(i, j) for i, j in itertools.permutations(range(60), 2) if np.linalg.norm(p[i] - p[j]) <= 7.8}
    assert {r.burial for r in geometry.burial(rows.limit(1)).collect()} == {0}


def test_hops_on_a_path_and_a_second_component(spark):
    edges = edges_of(spark, [(0, 1), (1, 2), (2, 3), (8, 9)])
    got = {r.i: r.hop for r in graph.hops(spark.createDataFrame([(0, 0)], "target int, i int"), edges).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3}


def test_quantum_walk_on_a_star(spark):
    n, t = 6, 1.3
    c = {(r.i, r.j): r.c for r in graph.quantum_walk(edges_of(spark, [(0, k) for k in range(1, n)]), [t * n / n]).collect()}
    assert c[0, 1] == pytest.approx((2 - 2 * math.cos(t)) / n**2)
    leaf = abs(1 / n - np.exp(-1j * t / n) / (n - 1) + np.exp(-1j * t) / (n * (n - 1))) ** 2
    assert c[1, 2] == pytest.approx(leaf)


def test_best_subset_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    m, k = 8, 4
    q = np.triu(rng.normal(size=(m, m)))
    rows = spark.createDataFrame([(0, i, j, float(q[i, j])) for i in range(m) for j in range(i, m)], "target int, a int, b int, q double")
    found = subset.best(subset.subsets(rows, k)).first()
    want = min(itertools.combinations(range(m), k), key=lambda s: q[np.ix_(s, s)].sum())
    assert tuple(found.members) == want and found.energy == pytest.approx(q[np.ix_(want, want)].sum())


def test_ties_share_their_step(spark):
    rows = spark.createDataFrame([(0, 0, 1.0, 1), (0, 1, 1.0, 0), (0, 2, 0.0, 1), (0, 3, 0.0, 0)], "target int, i int, score double, truth int")
    r = evaluate.evaluation(rows, 1).first()
    assert (r.ap, r.auroc, r.hits, r.lift) == (0.5, 0.5, 1, 1.0)


def test_mmcif_scan(spark, tmp_path):
    names = "group_PDB id type_symbol label_atom_id label_alt_id auth_comp_id auth_asym_id auth_seq_id pdbx_PDB_ins_code Cartn_x Cartn_y Cartn_z occupancy auth_atom_id pdbx_PDB_model_num".split()
    atoms = ["ATOM 1 C CA A GLY A 5 ? 1 2 3 0.4 CA 1", "ATOM 2 C CA B GLY A 5 ? 4 5 6 0.6 CA 1", "HETATM 3 C CA . CSP A 6 ? 0 0 0 1 CA 1", "ATOM 4 N N . ALA A 7 B 1 1 1 1 N 1", "ATOM 5 C CA . ALA A 7 B 7 8 9 1 CA 1", "ATOM 6 C CA . ALA A 8 ? 7 8 9 1 CA 2"]
    (tmp_path / "a.cif").write_text("loop_\n" + "".join(f"_atom_site.{n}\n" for n in names) + "\n".join(atoms) + "\n#\n")
    got = [(r.i, r.residue_id, r.x) for r in mmcif.residues(mmcif.atoms(spark, str(tmp_path / "a.cif"))).orderBy("i").collect()]
    assert got == [(0, "A:5", 4.0), (1, "A:7B", 7.0)]


def test_subsets_of_a_large_lining(spark):
    """Pairs of no energy: the best five are the five best alone, and no subset of the 46 is missing."""
    m, k = 46, 4
    rows = spark.createDataFrame([(0, i, j, -float((i * 7) % m) if i == j else 0.0) for i in range(m) for j in range(i, m)], "target int, a int, b int, q double")
    found = subset.subsets(rows, k).cache()
    assert found.count() == math.comb(m, k) == found.select("members").distinct().count()
    want = sorted(sorted(range(m), key=lambda i: -((i * 7) % m))[:k])
    assert list(subset.best(found).first().members) == want
    found.unpersist()


def test_settled_walk_equals_the_inverse(spark):
    links = [(0, 1), (1, 2), (2, 3), (1, 3), (3, 4)]
    edges = spark.createDataFrame([(0, i, j) for i, j in links] + [(0, j, i) for i, j in links], "target int, i int, j int")
    a = np.zeros((5, 5))
    for i, j in links:
        a[i, j] = a[j, i] = 1
    s = 0.15 * np.linalg.inv(np.eye(5) - 0.85 * a / a.sum(0))
    got = {(r.i, r.j): r.p for r in graph.settled_walk(edges).collect()}
    assert len(got) == 10 and all(p == pytest.approx((s[i, j] + s[j, i]) / 2, abs=1e-12) for (i, j), p in got.items())


def test_components_take_few_rounds(spark, monkeypatch):
    """A path of 3,000 nodes in an order that is not the path's, small rings, and a node alone."""
    rng = np.random.default_rng(4)
    order = rng.permutation(3000)
    pairs = [(int(a), int(b)) for a, b in itertools.pairwise(order)] + [(3000 + 5 * k + m, 3000 + 5 * k + (m + 1) % 5) for k in range(20) for m in range(5)]
    rows = spark.createDataFrame([(0, i) for i in range(3101)], "target int, i int")
    rounds, plain = [], graph.kept
    monkeypatch.setattr(graph, "kept", lambda df: rounds.append(1) or plain(df))
    got = {r.i: r.component for r in graph.least_labels(rows, edges_of(spark, pairs)).collect()}
    assert (len(rounds) - 2) / 2 <= 2 * math.log2(3000)
    assert got == {i: 0 if i < 3000 else 3100 if i == 3100 else i - (i - 3000) % 5 for i in range(3101)}


def test_written_steps_go(spark, tmp_path):
    """By clear(), and when the application ends."""
    import os
    import subprocess
    import sys

    graph.clear(spark)
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    before = len(os.listdir(at)) if os.path.isdir(at) else 0
    edges = edges_of(spark, [(0, 1), (1, 2)])
    assert graph.hops(spark.createDataFrame([(0, 0)], "target int, i int"), edges).count() == 3
    assert len(os.listdir(at)) > before and graph.clear(spark) > 0 and len(os.listdir(at)) == before
    code = f"""
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "{tmp_path}").getOrCreate()
from residua.operators import graph
assert graph.kept(graph.kept(s.range(3))).count() == 3
import os
assert sum(n.startswith("graph-") for n in os.listdir("{tmp_path}")) == 2
s.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import time

    for _ in range(40):  # the JVM ends after Python
        if not (left := [n for n in os.listdir(tmp_path) if n.startswith("graph-")]):
            break
        time.sleep(0.5)
    assert not left
