"""Steps whose rows between operators must not grow with the square of a target."""

import numpy as np
import pytest

from residua.operators import cavity, geometry, graph, modes, response, sourced, walks
from residua.operators.against import PARTS, against
from tests.test_dynamics import points


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_responses_are_final_where_they_are_made(spark):
    _, rows = points(spark, 3, 50)
    modes = graph.low_modes(rows, geometry.hessian_blocks(rows, 10.0), 3)
    springs = response.springs(rows)
    found = response.responses(modes, springs, 16)
    assert "FlatMapGroupsInArrow" in plan(found).split("Exchange")[0] and "HashAggregate" not in plan(found).split("FlatMapGroupsInArrow")[0]
    want = {(r.i, round(r.threshold, 9), r.hinge) for r in response.hinges(rows, found).collect()}
    assert len(want) == 50 and {(r.i, round(r.threshold, 9), r.hinge) for r in response.hinges_of(rows, modes, springs, block=16).collect()} == want
    few = spark.createDataFrame([(0, 3), (0, 9)], "target int, i int")
    assert {r.i for r in response.responses(modes, springs, only=few).select("i").distinct().collect()} == {3, 9}


def test_copies_of_a_table_do_not_grow_with_the_rows(spark):
    """Of 300 rows in batches of two: at most PARTS copies of the table for a target, and no batch larger."""
    import uuid

    rows = spark.createDataFrame([(t, k) for t, n in ((0, 300), (1, 3)) for k in range(n)], "target int, k int")
    table = spark.createDataFrame([(0, 5), (0, 6)], "target int, v int")

    def ready(table):
        return {"sum": 0 if table is None else sum(table.column("v").to_pylist()), "copy": uuid.uuid4().hex}

    def work(batch, sum, copy):
        return {"k": batch.column("k"), "sum": sourced.pa.array([sum] * len(batch)), "copy": sourced.pa.array([copy] * len(batch)), "size": sourced.pa.array([len(batch)] * len(batch))}

    found = against(rows, {"table": table}, work, "k int, sum long, copy string, size long", 2, ready).collect()
    assert sorted((r.target, r.k, r["sum"]) for r in found) == [(0, k, 11) for k in range(300)] + [(1, k, 0) for k in range(3)]
    assert max(r.size for r in found) == 2 and 16 < len({r.copy for r in found if r.target == 0}) <= PARTS


def close(got, want):
    got, want = ({tuple(r)[:-1]: r[-1] for r in df.collect()} for df in (got, want))
    return len(want) > 0 and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-12) for k in want)


def test_sums_over_sources_equal_those_of_rows(spark):
    """Three parts that contacts don't join, and a target without sources; a batch holds two sources."""
    rng = np.random.default_rng(4)
    at = np.concatenate([rng.uniform(0, 14, (40, 3)), rng.uniform(60, 74, (20, 3)), [[200.0, 0, 0]]]).round(3)
    rows = spark.createDataFrame([(t, i, *map(float, x), t == 0 and i % 9 in (0, 6)) for t in (0, 1) for i, x in enumerate(at)], "target int, i int, x double, y double, z double, source boolean")
    edges, sources = geometry.contacts(rows), rows.filter("source")
    members = cavity.detect(rows.withColumn("snapshot", sourced.F.lit(0))).select("target", "pocket", "i")
    walk = sourced.walked(edges, walks.bounds(edges), 12, walks.reading([0.5, 2.0], 12))
    for found in (sourced.inverse(rows), walk):
        values, distances = sourced.values(found, sources, 2), sourced.hops(sources, edges)
        assert close(sourced.hop_percentiles(found, sources, edges), graph.hop_percentiles(values, distances))
        assert close(sourced.explained(found, sources, edges), graph.explained_by_hops(values, distances))
        assert close(sourced.regions(found, sources, members), cavity.region_scores(values, members))
        assert close(sourced.distal(found, rows).drop("selected"), graph.distal_sources(values, rows).drop("selected"))
    nearest = sourced.hops(sources, edges).groupBy("target", "i").agg(sourced.F.min("hop").alias("hop"))
    assert close(sourced.nearest_hops(sources, edges), nearest)


def test_no_row_for_each_source_and_residue_is_shuffled(spark):
    _, rows = points(spark, 3, 50)
    rows = rows.withColumn("source", sourced.F.col("i") % 25 == 3)
    text = plan(sourced.regions(sourced.inverse(rows), rows.filter("source"), rows.select("target", sourced.F.lit(1).alias("pocket"), "i")))
    assert "Window" not in text.split("FlatMapGroupsInArrow")[0]


def test_copies_around_a_cube_are_not_broadcast(spark):
    _, rows = points(spark, 3, 50)
    assert "BroadcastHashJoin" not in plan(geometry.near_pairs(rows, rows, 5.0))


def test_many_small_graphs_are_taken_at_once(spark):
    """Orders of one to four lines and a pair of parts, with negative and far ids; one task has them all."""
    pairs = [(t, i - 5, j - 5) for t in range(40) for i in range(1 + t % 4) for j in range(1 + t % 4) if i != j] + [(99, 0, 7), (99, 7, 0), (99, 20, 30), (99, 30, 20)]
    edges = spark.createDataFrame(pairs, "target int, i int, j int").coalesce(1)
    found = graph.settled_walk(edges)
    assert "MapInArrow" in plan(found) and "MapInArrow" in plan(graph.quantum_walk(edges, [1.0]))
    got = {(r.target, r.i, r.j): r.p for r in found.collect()}
    assert {k for k in got if k[0] == 99} == {(99, 0, 7), (99, 20, 30)}
    for (t, _, _), p in got.items():
        n = 2 if t == 99 else 1 + t % 4
        assert p == pytest.approx((1 - 0.15 / (1 + 0.85 / (n - 1))) / n)
    walk = {(r.target, r.i, r.j): r.c for r in graph.quantum_walk(edges.filter("target < 99"), [1.0]).collect()}
    assert all(c == pytest.approx((2 - 2 * np.cos(1)) / (1 + k[0] % 4) ** 2) for k, c in walk.items()) and len(walk) == sum(k[0] < 99 for k in got)


def test_largest_eigenvalue_of_a_path_is_exact(spark):
    edges = spark.createDataFrame([(0, a + x, a + 1 - x) for a in range(99) for x in (0, 1)], "target int, i int, j int")
    assert walks.largest_eigenvalues(edges).first().scale == pytest.approx(2 + 2 * np.cos(np.pi / 100), rel=1e-12)


def test_masses_of_a_walk_are_made_without_its_values(spark):
    """Of two parts, one bipartite, with a source that has no contacts; an odd and an even degree, and batches of three."""
    rng = np.random.default_rng(5)
    pairs = {(i, j) for i, j in rng.integers(0, 40, (90, 2)).tolist() if i != j} | {(50 + k, 51 + k) for k in range(9)}
    edges = spark.createDataFrame([(0, i, j) for i, j in sorted(pairs | {(j, i) for i, j in pairs})], "target int, i int, j int")
    sources = edges.select("target", "i").union(spark.createDataFrame([(0, 99), (1, 4)], "target int, i int"))
    for time in (10.0, 20.0):
        degree = walks.degree_for(time)
        form, scale = walks.reading([1.0, time], degree), walks.largest_eigenvalues(edges)
        got = {r.src: r.c for r in sourced.masses(sources, edges, scale, degree, form, 3).filter("target = 0").collect()}
        want = sourced.values(sourced.walked(edges, scale, degree, form, None), sources).groupBy("src").agg(sourced.F.sum("c").alias("c")).collect()
        assert len(want) > 40 and got == pytest.approx({99: 0.0} | {r.src: r.c for r in want}, abs=1e-11)
    assert walks.degree_for(10.0) % 2 != walks.degree_for(20.0) % 2


def test_lines_of_sources_equal_those_of_values(spark):
    from residua.sources import results

    _, rows = points(spark, 3, 50)
    rows = rows.withColumn("source", sourced.F.col("i") % 25 == 3).withColumn("residue_id", sourced.F.concat(sourced.F.lit("A:"), "i"))
    sources = rows.filter("source")
    values = sourced.values(sourced.inverse(rows), sources).selectExpr("target", "src AS i", "i AS j", "c AS v")
    want = {tuple(r) for r in results.labelled_lines(values, rows).collect()}
    assert len(want) == 3 and {tuple(r) for r in results.named_lines(sourced.lines(sourced.inverse(rows), sources), rows).collect()} == want


def test_a_line_of_a_matrix_is_split_once(spark, tmp_path):
    """Not again for each of its cells, and no cell is shuffled on the way to its line."""
    from residua.sources import results

    _, rows = points(spark, 3, 50)
    rows = rows.withColumn("source", sourced.F.col("i") % 25 == 3)
    lines = sourced.lines(sourced.inverse(rows), rows.filter("source"), results.CELL)
    assert "HashAggregate" not in plan(lines).split("FlatMapGroupsInArrow")[0]
    results.write_matrix(lines, str(tmp_path / "m"))
    found = results.read_matrix(spark, str(tmp_path / "m"))
    assert "split(" not in plan(found).split("Generate")[0]
    want = sourced.values(sourced.inverse(rows), rows.filter("source")).collect()
    assert len(want) == 100 and {(r.target, r.i, r.j): r.v for r in found.collect()} == {(r.target, r.src, r.i): r.c for r in want}


def test_modes_by_slabs_equal_those_of_the_whole_matrix(spark):
    """A chain, one in two parts with a residue that nothing meets, and residues without any contact."""
    rng = np.random.default_rng(6)
    step = rng.standard_normal((300, 3))
    at = np.cumsum(3.8 * step / np.linalg.norm(step, axis=1)[:, None], 0).round(3)
    parts = np.concatenate([at[:60], at[100:150] + 900, [[-900.0, 0, 0]]])
    rows = spark.createDataFrame([(t, i, *map(float, x)) for t, p in ((0, at), (1, parts), (2, parts[::60])) for i, x in enumerate(p)], "target int, i int, x double, y double, z double")
    want = {(r.target, r.mode, r.i): r for r in graph.low_modes(rows, geometry.hessian_blocks(rows), 4).collect()}
    for dense in (0, 1000):
        got = {(r.target, r.mode, r.i): r for r in modes.lowest(rows, 4, dense=dense).collect()}
        assert got.keys() == want.keys() and {k[0] for k in got} == {0, 1}
        for k, r in got.items():
            assert r.eigenvalue == pytest.approx(want[k].eigenvalue, rel=1e-6, abs=1e-12) and (r.ux, r.uy, r.uz) == pytest.approx((want[k].ux, want[k].uy, want[k].uz), abs=1e-5)


def test_no_task_of_modes_has_a_whole_matrix():
    """A chain of 1,500 residues: the whole matrix would have 162 MB."""
    import tracemalloc

    step = np.random.default_rng(6).standard_normal((1500, 3)) + [0.3, 0, 0]
    at = np.cumsum(3.8 * step / np.linalg.norm(step, axis=1)[:, None], 0)
    tracemalloc.start()
    values, _ = modes._lowest(at, 12.0, 2)
    assert len(values) == 2 and tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()


def test_blocks_of_modes_are_less_than_slabs():
    """Of a chain that lies in a lump: each residue is eliminated once, and no contact joins two sides of a plane."""
    step = np.random.default_rng(6).standard_normal((4000, 3))
    at = np.cumsum(3.8 * step / np.linalg.norm(step, axis=1)[:, None], 0)
    slabs, inner, outer = modes._contacts(at, 12.0)
    i, j = (np.concatenate([s[c[k]] for s, c in zip(slabs, inner)] + [s[c[k]] for s, c in zip(slabs[k:], outer)]) for k in (0, 1))
    parts = modes._dissected(at, i, j)
    assert sorted(np.concatenate([own for own, _ in parts]).tolist()) == list(range(len(at)))
    turn, above = np.empty(len(at), int), [{k} for k in range(len(parts))]
    for k in reversed(range(len(parts))):
        turn[parts[k][0]] = k
        for c in parts[k][1]:
            assert c < k
            above[c] |= above[k]
    assert all(max(a, b) in above[min(a, b)] for a, b in zip(turn[i].tolist(), turn[j].tolist()))
    assert sum(len(own) ** 2 for own, _ in parts) < sum(len(s) ** 2 for s in slabs) / 3


def test_modes_above_many_motions_without_force():
    """A long chain bends almost without force: those motions are below what counts, and those above are found beside them."""
    at = np.stack([np.arange(400) * 3.8, np.zeros(400), np.zeros(400)], 1) + np.random.default_rng(3).uniform(-1, 1, (400, 3))
    want, product = modes._dense(at, 12.0, 4)[0], modes._network(at, 12.0)[0]
    values, v = modes._lowest(at, 12.0, 4)
    assert values == pytest.approx(want, rel=1e-6) and np.abs(product(v) - v * values).max() < 1e-9


def test_a_search_ends_with_the_last_value():
    """On a path of 1,000 nodes, the hops of values within 3 steps take 3 steps."""
    i = np.arange(999, dtype=np.int32)
    links = sourced.Contacts(sourced.pa.table({"i": np.concatenate([i, i + 1]), "j": np.concatenate([i + 1, i])}))
    steps, arcs = [], links.arcs
    links.arcs = lambda places: steps.append(1) or arcs(places)
    near, hop, c = sourced._shelled(links, 500, (np.arange(497, 504), np.arange(7.0)))
    assert near.tolist() == list(range(497, 504)) and hop.tolist() == [3, 2, 1, 0, 1, 2, 3] and c.tolist() == list(range(7)) and len(steps) == 3


def test_members_lie_by_pocket_in_rows_of_about_their_number():
    """Pockets of 1 to 33 residues."""
    rng = np.random.default_rng(2)
    code = rng.permutation(np.repeat(np.arange(34), np.arange(34)))
    tables = sourced._by_length(code, 5)
    assert sum(rows.size for _, rows in tables) <= 2 * len(code) + 5 * 34
    for pockets, rows in tables:
        for p, row in zip(pockets, rows, strict=True):
            assert sorted(row[row < len(code)]) == np.flatnonzero(code == p).tolist()


def test_few_pockets_may_be_the_best(spark):
    """In a chain of 3,000 residues; sources are members of pockets, and a target without sources has none that leads."""
    rng = np.random.default_rng(6)
    steps = rng.standard_normal((3000, 3))
    at = np.cumsum(3.8 * steps / np.linalg.norm(steps, axis=1)[:, None], 0).round(3)
    rows = graph.kept(spark.createDataFrame([(t, i, *map(float, x), t == 0 and i % 25 == 3) for t in (0, 1) for i, x in enumerate(at)], "target int, i int, x double, y double, z double, source boolean"))
    members = graph.kept(cavity.detect(rows.withColumn("snapshot", sourced.F.lit(0))).select("target", "pocket", "i"))
    regions = {r.pocket: r.region for r in sourced.regions(sourced.inverse(rows), rows.filter("source"), members).collect()}
    for reach in (40.0, 16.0):
        left = [tuple(r) for r in sourced.leading(rows, rows.filter("source"), members, reach=reach).collect()]
        assert (0, max(regions, key=regions.get)) in left and len(left) < len(regions) / 10 and all(t == 0 for t, _ in left)


def test_tied_pockets_all_lead(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (0.0, 4.0), (4.0, 4.0)]
    rows = spark.createDataFrame([(0, 4 * k + n, x + 500.0 * k, y, 0.0, n == 0) for k in range(3) for n, (x, y) in enumerate(square[: 4 - k // 2])], "target int, i int, x double, y double, z double, source boolean")
    members = rows.select("target", sourced.F.floor(sourced.F.col("i") / 4).cast("int").alias("pocket"), "i").filter("pocket < 2")
    assert {r.pocket for r in sourced.leading(rows, rows.filter("source and i < 8"), members).collect()} == {0, 1}


def test_coined_walks_are_made_in_tasks(spark):
    """Against dense arcs; two targets, a source without contacts, and batches of two sources."""
    rng = np.random.default_rng(9)
    pairs = {t: {(i, j) for i, j in rng.integers(0, 30, (45, 2)).tolist() if i != j} for t in (0, 1)}
    pairs = {t: sorted(p | {(j, i) for i, j in p}) for t, p in pairs.items()}
    edges = spark.createDataFrame([(t, 3 * i, 3 * j) for t, p in pairs.items() for i, j in p], "target int, i int, j int")
    sources = spark.createDataFrame([(t, 3 * i) for t in (0, 1) for i in (0, 4, 7, 11, 12, 40)], "target int, i int")
    found = graph.coined_walk(sources, edges, 3, 2)
    assert "Join" not in plan(found).split("FlatMapGroupsInArrow")[0]
    want = {}
    for t, arcs in pairs.items():
        out = {i: [b for b, arc in enumerate(arcs) if arc[0] == i] for i, _ in arcs}
        for src in (s for s in (0, 4, 7, 11, 12) if s in out):
            a, reached = np.zeros(len(arcs)), {src}
            a[out[src]] = 1 / np.sqrt(len(out[src]))
            for _ in range(3):
                coined = np.zeros(len(arcs))
                for own in out.values():
                    coined[own] = 2 * a[own].mean() - a[own]
                a = np.array([coined[arcs.index((j, i))] for i, j in arcs])
                reached |= {j for i, j in arcs if i in reached}
                for i in out:
                    want[t, 3 * src, 3 * i] = want.get((t, 3 * src, 3 * i), 0) + (a[out[i]] ** 2).sum() / 3
            want = {k: p for k, p in want.items() if k[:2] != (t, 3 * src) or (k[2] != 3 * src and k[2] // 3 in reached)}
    got = {tuple(r)[:-1]: r.p for r in found.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
