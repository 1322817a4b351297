"""Fluctuation responses, walks by Chebyshev rows, searches and branch and bound against numpy and plain Python."""

import itertools
import os
import time

import numpy as np
import pytest

from residua.operators import geometry, graph, response, subset, walks
from residua.plans import dynamics
from tests.compare import oracle, shown
from tests.test_operators import edges_of

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(dynamics.ORACLES))
def test_dynamics_equal_sql(spark, name):
    assert shown(dynamics.QUERIES[name](spark, SF).toPandas()) == shown(oracle(dynamics.ORACLES[name], SF))


def points(spark, seed, n, target=0):
    p = np.random.default_rng(seed).uniform(0, 18, (n, 3)).round(3)
    return p, spark.createDataFrame([(target, i, *map(float, x)) for i, x in enumerate(p)], "target int, i int, x double, y double, z double")


@pytest.mark.parametrize("block", [7, 64])
def test_responses_equal_dense_matrices(spark, block):
    p, rows = points(spark, 5, 40)
    modes = graph.low_modes(rows, geometry.hessian_blocks(rows, 10.0), 20)
    local = modes.toPandas().sort_values(["mode", "i"])
    values = local.groupby("mode").eigenvalue.first().to_numpy()
    u = local[["ux", "uy", "uz"]].to_numpy().reshape(len(values), 40, 3)
    green = np.einsum("mik,m,mjl->ikjl", u, 1 / values, u)
    assert np.allclose(green, green.transpose(2, 3, 0, 1))
    f = np.einsum("ikik->i", green)
    want, springs = np.zeros((40, 40)), 0
    for a, b in itertools.combinations(range(40), 2):
        d = np.linalg.norm(p[a] - p[b])
        if d <= 10:
            field = np.einsum("k,kjl->jl", (p[a] - p[b]) / d, green[a] - green[b])
            want[[a, b]] += (field**2).sum(1) / f
            springs += 1
    found = response.responses(modes, response.springs(rows), block)
    got = np.zeros((40, 40))
    for r in found.collect():
        got[r.i, r.j] = r.c
    assert springs and np.allclose(got, want, rtol=1e-7, atol=1e-10)
    far = np.linalg.norm(p[:, None] - p, axis=2)
    level = want[(far >= 9.5) & (far <= 10.5)].mean()
    hinge = {r.i: (r.threshold, r.hinge) for r in response.hinges(rows, found).collect()}
    assert {i: h for i, (_, h) in hinge.items()} == dict(enumerate((want > level).sum(1))) and hinge[0][0] == pytest.approx(level)
    assert response.responses(modes.limit(0), response.springs(rows.limit(0))).count() == 0


def dense(edges, sources, times, scale, decay=None):
    n = max(max(e) for e in edges) + 1
    a = np.zeros((n, n))
    for i, j in edges:
        a[i, j] = a[j, i] = 1
    values, v = np.linalg.eigh(np.diag(a.sum(1)) - a)
    w = np.exp(-np.array(times) / decay) if decay else np.ones(len(times))
    c = sum(k * abs((v * np.exp(-1j * values / (scale or values[-1]) * t)) @ v.T) ** 2 for k, t in zip(w, times, strict=True)) / w.sum()
    np.fill_diagonal(c, 0)
    return values[-1], c[sources]


def test_walks_equal_the_dense_kernel(spark):
    rng = np.random.default_rng(2)
    graphs = [[(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 9)], list(itertools.combinations(range(6), 2)), [(int(a), int(b)) for a, b in rng.integers(0, 30, (70, 2)) if a != b]]
    graphs = [sorted({(min(e), max(e)) for e in g}) for g in graphs]
    edges = spark.createDataFrame([(k, i, j) for k, g in enumerate(graphs) for a, b in g for i, j in ((a, b), (b, a))], "target int, i int, j int")
    at = [(k, i) for k in range(len(graphs)) for i in (0, 3)]
    sources = spark.createDataFrame([*at, (9, 0)], "target int, i int")
    times = [0.3, 2.0, 9.0]
    top = {r.target: r.scale for r in walks.largest_eigenvalues(edges).collect()}
    for decay in (None, 3.0):
        got = {(r.target, r.src, r.i): r.c for r in walks.from_sources(sources, edges, times, decay, walks.bounds(edges).withColumn("scale", walks.F.col("scale") * 0 + 40)).collect()}
        for k, g in enumerate(graphs):
            value, c = dense(g, [0, 3], times, 40, decay)
            assert top[k] == pytest.approx(value, rel=1e-6)
            for row, src in zip(c, (0, 3), strict=True):
                for i, x in enumerate(row):
                    assert abs(got.get((k, src, i), 0.0) - x) < 1e-9
        assert not any(k[0] == 9 for k in got)
    exact = {(r.target, r.src, r.i): r.c for r in walks.from_sources(sources, edges, times).collect()}
    assert all(abs(exact.get((3, 0, i), 0.0) - x) < 1e-8 for i, x in enumerate(dense(graphs[3], [0], times, None)[1][0]))


def test_one_pass_serves_every_reading(spark):
    edges = edges_of(spark, [(k, k + 1) for k in range(12)])
    start = spark.createDataFrame([(0, 4, 4, 1.0)], "target int, src int, i int, v double")
    scale = spark.createDataFrame([(0, 4.0)], "target int, scale double")
    degree = walks.degree_for(20.0)
    forms = {"short": walks.reading([0.5, 1.0], degree), "long": walks.reading([20.0], degree), "decayed": walks.reading([1.0, 5.0], degree, 2.0)}
    got = {r.i: r for r in walks.connectivity(walks.polynomials(start, edges, scale, degree), forms).collect()}
    for name, times, decay in (("short", [0.5, 1.0], None), ("long", [20.0], None), ("decayed", [1.0, 5.0], 2.0)):
        want = dense([(k, k + 1) for k in range(12)], [4], times, 4.0, decay)[1][0]
        assert all(abs(got[i][name] - x) < 1e-10 for i, x in enumerate(want))


def test_hops_equal_plain_search(spark):
    rng = np.random.default_rng(7)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 60, (70, 2)) if a != b} | {(60 + k, 61 + k) for k in range(30)}
    edges = edges_of(spark, pairs)
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = set()
    for src in (0, 5, 60, 99):
        front, seen, hop = {src}, {src}, 0
        while front:
            want |= {(src, i, hop) for i in front}
            front = {j for i in front for j in near.get(i, ())} - seen
            seen |= front
            hop += 1
    got = {(r.src, r.i, r.hop) for r in graph.hops(spark.createDataFrame([(0, s) for s in (0, 5, 60, 99)], "target int, i int"), edges).collect()}
    assert got == want


def objective(rng, m, low=0.0):
    q = np.triu(rng.uniform(low, 0.3, (m, m)), 1)
    return q - np.diag(rng.permutation(np.arange(1, m + 1)) / m)


def rows_of(spark, matrices):
    return spark.createDataFrame([(t, i, j, float(q[i, j])) for t, q in enumerate(matrices) for i in range(len(q)) for j in range(i, len(q))], "target int, a int, b int, q double")


@pytest.mark.parametrize("k,low,at_once", [(1, 0.0, 1 << 18), (2, -0.2, 1 << 18), (3, 0.0, 5), (5, 0.0, 1 << 18), (5, -0.3, 20)])
def test_branch_and_bound_equals_brute_force(spark, monkeypatch, k, low, at_once):
    monkeypatch.setattr(subset, "AT_ONCE", at_once)
    rng = np.random.default_rng(k)
    matrices = [objective(rng, m, low) for m in (k, 9, 12)] + [np.zeros((7, 7)), objective(rng, max(1, k - 1))]
    got = {(r.target, r.i): r for r in subset.marginals(rows_of(spark, matrices), k).collect()}
    assert not any(r.target == 4 for r in got.values()) or k == 1
    for t, q in enumerate(matrices[:4]):
        every = [(round(q[np.ix_(s, s)].sum(), 12), list(s)) for s in itertools.combinations(range(len(q)), k)]
        best = min(every)
        assert (got[t, -1].energy, got[t, -1].members) == (pytest.approx(best[0]), best[1])
        for i in range(len(q)):
            assert got[t, i].energy == pytest.approx(min(e for e, s in every if i in s))


def test_a_lining_of_63_residues(spark):
    """7,028,847 subsets of five."""
    q = objective(np.random.default_rng(1), 63)
    began = time.time()
    found = {r.i: r for r in subset.marginals(rows_of(spark, [q])).collect()}
    assert time.time() - began < 60 and len(found) == 64
    members = found[-1].members
    assert found[-1].energy == pytest.approx(q[np.ix_(members, members)].sum()) and found[-1].energy == min(r.energy for r in found.values())


def test_null_ranks_count_as_pairs_do(spark):
    from residua.operators import cavity

    regions = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.1), (1, 1, 0.3)], "target int, pocket int, region double")
    nulls = spark.createDataFrame([(0, 7, 0.5), (0, 8, 0.2), (0, 9, 0.2)], "target int, pocket int, region double")
    assert {(r.target, r.pocket, r.p) for r in cavity.null_pvalue(regions, nulls).collect()} == {(0, 1, 0.5), (0, 2, 1.0)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["refinement_gate", "chosen_pocket"])
def test_choice_equals_sql(spark, name):
    from residua.plans import choice

    assert shown(choice.QUERIES[name](spark, SF).toPandas()) == shown(oracle(choice.ORACLES[name], SF))


def test_gate_opens_for_a_lone_first_pocket(spark):
    from residua.operators import fields

    centres = spark.createDataFrame([(0, 1, 0.0, 0.0, 0.0), (0, 2, 5.0, 0.0, 0.0), (1, 1, 0.0, 0.0, 0.0), (1, 2, 9.0, 0.0, 0.0), (2, 1, 0.0, 0.0, 0.0), (3, 1, 0.0, 0.0, 0.0), (3, 2, 0.0, 0.0, 0.0)], "target int, pocket int, x double, y double, z double")
    ranked = spark.createDataFrame([(t, 1, 1) for t in range(4)] + [(0, 2, 2)], "target int, rank int, pocket int")
    got = {r.target: (r.candidates, r.near, r.refine) for r in fields.refinement_gate(ranked, centres).collect()}
    assert got == {0: (2, 2, False), 1: (2, 1, True), 2: (1, 1, False), 3: (2, 2, False)}


def test_mechanical_stage_replaces_a_lone_pocket(spark):
    """The direct pocket stands alone; two near one another hold the same residues and respond as strongly."""
    from residua.operators import fields

    centres = spark.createDataFrame([(0, 1, 0.0, 0.0, 0.0), (0, 2, 30.0, 0.0, 0.0), (0, 3, 32.0, 0.0, 0.0)], "target int, pocket int, x double, y double, z double")
    members = spark.createDataFrame([(0, p, i) for p, ids in ((1, range(5)), (2, range(10, 16)), (3, range(11, 17))) for i in ids], "target int, pocket int, i int")
    direct = spark.createDataFrame([(0, 1)], "target int, pocket int")
    scores = lambda m: spark.createDataFrame([(0, 1, 0.6, 1.0), (0, 2, 0.7, m), (0, 3, 0.5, 0.1)], "target int, pocket int, transport double, mechanical double")
    for m, nodes in ((0.96, list(range(10, 17))), (0.9, list(range(5)))):
        r = fields.cavity_field(centres, members, scores(m), direct=direct).first()
        assert (r.pocket, r.recurrent, r.nodes) == (1, m > 0.95, nodes)
    assert fields.cavity_field(centres, members, scores(0.96)).first().pocket == 2
