import numpy as np
import pytest

from residua.operators import cavity, geometry, graph


def test_families_equal_greedy(spark):
    rng = np.random.default_rng(7)
    sets = [set(rng.choice(12, rng.integers(3, 8), replace=False).tolist()) for _ in range(25)]
    rows = [("t", k, k, i) for k, s in enumerate(sets) for i in s]
    members = spark.createDataFrame(rows, "target string, item int, rank int, i int")
    leaders, expected = [], {}
    for k, s in enumerate(sets):
        first = next((a for a in leaders if len(sets[a] & s) / len(sets[a] | s) >= 0.5), None)
        if first is None:
            leaders.append(k)
        expected[k] = k if first is None else first
    assert {r["item"]: r.leader for r in cavity.families(members).collect()} == expected
    assert cavity.families(members.limit(0)).count() == 0


def test_modes_are_orthonormal_and_solve_the_hessian(spark):
    rng = np.random.default_rng(3)
    xyz = np.cumsum(rng.normal(size=(12, 3)) * 2, axis=0)
    rows = spark.createDataFrame([("t", k, *map(float, p)) for k, p in enumerate(xyz)], "target string, i int, x double, y double, z double")
    blocks = geometry.hessian_blocks(rows, 30.0)
    found = graph.low_modes(rows, blocks, 5).toPandas()
    h = np.zeros((36, 36))
    for r in blocks.collect():
        h[3 * r.i + r.k, 3 * r.j + r.l] = r.h
    u = np.array([found[found["mode"] == m].sort_values("i")[["ux", "uy", "uz"]].to_numpy().ravel() for m in range(5)])
    values = found.groupby("mode").eigenvalue.first().to_numpy()
    assert u @ u.T == pytest.approx(np.eye(5), abs=1e-9)
    assert h @ u.T == pytest.approx(u.T * values, abs=1e-9)
    assert (values > 1e-6).all()


def test_coined_walk_on_a_triangle(spark):
    edges = spark.createDataFrame([("t", i, j) for i in range(3) for j in range(3) if i != j], "target string, i int, j int")
    walk = graph.coined_walk(spark.createDataFrame([("t", 0)], "target string, i int"), edges, 1)
    assert {r.i: round(r.p, 12) for r in walk.collect()} == {1: 0.5, 2: 0.5}
