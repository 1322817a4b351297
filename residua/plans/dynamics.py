"""Queries on fluctuation responses, walks by Chebyshev rows and the chosen pocket, with the SQL that each must equal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from residua.operators import cavity, evaluate, graph, response, sourced, subset, walks
from residua.plans.catalog import _HOPS, _QUBO, _VALUES, _WITH, _edges
from residua.plans.catalog import ORACLES as _PLAIN
from residua.plans.ensemble import ORACLES as _STABLE
from residua.plans.ensemble import _FIELDS, _modes, _native
from residua.sources.chains import chain

#: The walk's times, in units of the inverse of a graph's bound, and the time by which their weights fall.
TIMES = [0.02 * 1000 ** (k / 11) for k in range(12)]
DECAY = 14.0
DEGREE = walks.degree_for(max(TIMES))
#: Readings of time: a geometric grid with falling weights, an even grid, and one late instant.
CONVENTIONS = {"weighted": (TIMES, DECAY), "even": ([0.5 * k for k in range(1, 41)], None), "instant": ([20.0], None)}


def _softness(modes):
    """Mode fields with eigenvalues a half apart, as the fields come without any."""
    return modes.withColumn("eigenvalue", (F.col("mode") + 1) / F.lit(2.0))


def _network(spark, sf_dir):
    rows = graph.kept(chain(spark, sf_dir))
    return rows, _softness(_modes(spark, sf_dir)), response.springs(rows)


def anm_response(spark, sf_dir):
    return response.responses(*_network(spark, sf_dir)[1:]).select("target", "i", "j", F.round("c", 6).alias("c"))


def hinge_scores(spark, sf_dir):
    out = response.hinges_of(*_network(spark, sf_dir))
    return out.select("target", "i", F.round("threshold", 6).alias("threshold"), "hinge")


def _graph(spark, sf_dir):
    rows, edges = _edges(spark, sf_dir)
    return graph.kept(rows), graph.kept(edges)


def _walked(sources, edges):
    """(target, src, i, c) of the walk from sources, with the bound as the graph's scale, to 12 digits."""
    return sourced.values(_walk(edges), sources)


def _walk(edges, times=TIMES, decay=DECAY):
    """The walk's values, for what is told of them without a row for each."""
    return sourced.walked(edges, graph.kept(walks.bounds(edges)), DEGREE, walks.reading(times, DEGREE, decay))


def ctqw_sources(spark, sf_dir):
    """Without a matrix: rows of the nodes that each source reaches."""
    rows, edges = _graph(spark, sf_dir)
    return _walked(rows.filter("source"), edges).select("target", "src", "i", F.round("c", 9).alias("c"))


def ctqw_exact(spark, sf_dir):
    """With each graph's largest eigenvalue as its scale."""
    rows, edges = _graph(spark, sf_dir)
    return walks.from_sources(rows.filter("source"), edges, TIMES, DECAY).select("target", "src", "i", F.round("c", 7).alias("c"))


def ctqw_hop_percentiles(spark, sf_dir):
    rows, edges = _graph(spark, sf_dir)
    out = sourced.hop_percentiles(_walk(edges), rows.filter("source"), edges)
    return out.select("target", "i", F.round("score", 9).alias("score"))


def ctqw_explained(spark, sf_dir):
    rows, edges = _graph(spark, sf_dir)
    out = sourced.explained(_walk(edges), rows.filter("source"), edges)
    return out.select("target", F.round("explained", 6).alias("explained"))


def ctqw_distal_source(spark, sf_dir):
    rows, edges = _graph(spark, sf_dir)
    return sourced.distal(_walk(edges), rows)


def ctqw_regions(spark, sf_dir):
    rows, edges = _graph(spark, sf_dir)
    return sourced.regions(_walk(edges), rows.filter("source"), _native(spark, sf_dir)).select("target", "pocket", F.round("region", 9).alias("region"))


def ctqw_hit_list(spark, sf_dir):
    """Subsets of the best plausible pocket's lining, with the walk between its residues as their connectivity."""
    rows, edges = _graph(spark, sf_dir)
    members = graph.kept(cavity.detect(rows.withColumn("snapshot", F.lit(0))))
    fit = members.join(cavity.plausible(members), cavity.POCKET, "left_semi").select("target", "pocket", "i")
    best = sourced.regions(_walk(edges), rows.filter("source"), fit).groupBy("target").agg(F.min(F.struct((-F.round("region", 12)).alias("minus"), "pocket"))["pocket"].alias("pocket"))
    picked = graph.kept(rows.join(fit.join(best, ["target", "pocket"]).select("target", "i"), ["target", "i"]))
    linked = _walked(picked.select("target", "i"), edges).select("target", F.col("src").alias("i"), F.col("i").alias("j"), "c")
    at = lambda n: picked.select("target", F.col("i").alias(n), *[F.col(c).alias(f"{n}{c}") for c in "xyz"])
    d = F.sqrt(sum((F.col(f"i{c}") - F.col(f"j{c}")) * (F.col(f"i{c}") - F.col(f"j{c}")) for c in "xyz"))
    # all pairs of one pocket's lining, which has 60 residues at most
    pairs = at("i").join(at("j"), "target").filter("i < j").join(linked, ["target", "i", "j"], "left").select("target", "i", "j", F.coalesce("c", F.lit(0.0)).alias("c"), d.alias("d"))
    q = graph.kept(subset.objective(picked.select("target", "i", F.col("score").alias("support")), pairs))
    return subset.hit_list(subset.scores(rows, subset.marginals(q))).withColumn("score", F.round("score", 6))


def time_grid(spark, sf_dir):
    """The times at which each graph's walk is read, in units of its own Laplacian, with their weights."""
    weigh = lambda ts, decay: [1.0] * len(ts) if decay is None else [float(walks.np.exp(-t / decay)) for t in ts]
    grid = [(name, k, float(t), w) for name, (ts, decay) in CONVENTIONS.items() for k, (t, w) in enumerate(zip(ts, weigh(ts, decay), strict=True))]
    points = F.explode(F.array(*(F.struct(F.lit(n).alias("convention"), F.lit(k).alias("k"), F.lit(t).alias("t"), F.lit(w).alias("w")) for n, k, t, w in grid)))
    rows = walks.bounds(_edges(spark, sf_dir)[1]).select("target", "scale", points.alias("p")).select("target", "p.convention", "p.k", (F.col("p.t") / F.col("scale")).alias("t"), "p.w")
    share = F.col("w") / F.sum("w").over(Window.partitionBy("target", "convention"))
    return rows.select("target", "convention", "k", F.round("t", 9).alias("t"), F.round(share, 9).alias("weight"))


def time_convention(spark, sf_dir):
    """Lift, hits and the five best residues under each reading of time."""
    rows, edges = _graph(spark, sf_dir)
    told = [sourced.hop_percentiles(_walk(edges, *how), rows.filter("source"), edges).select("target", F.lit(n).alias("convention"), "i", F.round("score", 9).alias("score")) for n, how in CONVENTIONS.items()]
    scored = graph.kept(reduce(DataFrame.union, told))
    scope = evaluate.scope(rows).select("target", "i", "residue_id", "truth").join(scored, ["target", "i"]).withColumn("target", F.struct("target", "convention"))
    best = scope.withColumn("k", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("score"), "i"))).filter("k <= 5")
    told = F.concat_ws(" | ", F.transform(F.sort_array(F.collect_list(F.struct("k", "residue_id"))), lambda x: x["residue_id"]))
    out = evaluate.evaluation(scope).join(best.groupBy("target").agg(told.alias("top_five")), "target")
    return out.select("target.target", "target.convention", F.round("lift", 9).alias("lift"), "hits", "top_five")


_RESPONSE = f"""{_FIELDS},
sp AS (SELECT d.target, d.i AS a, d.j AS b, (p.x-q.x)/d.d AS dx, (p.y-q.y)/d.d AS dy, (p.z-q.z)/d.d AS dz FROM dist d JOIN chain p ON p.target = d.target AND p.i = d.i JOIN chain q ON q.target = d.target AND q.i = d.j WHERE d.d > 0 AND d.d <= 10 AND d.i < d.j),
sw AS (SELECT sp.target, a, b, m.mode, (dx * (m.ux - n.ux) + dy * (m.uy - n.uy) + dz * (m.uz - n.uz)) / ((m.mode + 1) / 2::DOUBLE) AS w FROM sp JOIN md m ON m.target = sp.target AND m.i = sp.a JOIN md n ON n.target = sp.target AND n.i = sp.b AND n.mode = m.mode),
sf AS (SELECT target, i, greatest(sum((ux*ux + uy*uy + uz*uz) / ((mode + 1) / 2::DOUBLE)), 1e-15) AS f FROM md GROUP BY ALL),
sg AS (SELECT sw.target, a, b, md.i AS j, sum(w * ux) AS gx, sum(w * uy) AS gy, sum(w * uz) AS gz FROM sw JOIN md ON md.target = sw.target AND md.mode = sw.mode GROUP BY ALL),
sr AS (SELECT sg.target, a, b, j, (gx*gx + gy*gy + gz*gz) / f AS c FROM sg JOIN sf ON sf.target = sg.target AND sf.i = sg.j),
re AS (SELECT target, i, j, sum(c) AS c FROM (SELECT target, a AS i, j, c FROM sr UNION ALL SELECT target, b, j, c FROM sr) GROUP BY ALL)"""
_HINGES = f"""{_RESPONSE},
th AS (SELECT re.target, round(avg(c), 12) AS t FROM re JOIN dist d ON d.target = re.target AND d.i = re.i AND d.j = re.j WHERE d.d BETWEEN 9.5 AND 10.5 GROUP BY ALL)"""


def _walk_sql(sources: str, name: str = "vals", p: str = "w", forms: dict | None = None) -> str:
    """CTEs that end in name (target, src, i, c): the recurrence unrolled, Bessel functions as means over even angles.
    sources: a query of (target, i). forms: readings by name (a column more), or the default one."""
    n = 4 * (DEGREE + 1 + 10) + 64
    grid = ", ".join(f"('{k}', {t!r}::DOUBLE, {1.0 if decay is None else float(walks.np.exp(-t / decay))!r}::DOUBLE)" for k, (ts, decay) in (forms or {"": (TIMES, DECAY)}).items() for t in ts)
    parts = [
        f"{p}n AS MATERIALIZED (SELECT target, i, count(*) AS n FROM edges GROUP BY ALL)",
        f"{p}b AS MATERIALIZED (SELECT e.target, 2 / max(a.n + b.n)::DOUBLE AS s FROM edges e JOIN {p}n a ON a.target = e.target AND a.i = e.i JOIN {p}n b ON b.target = e.target AND b.i = e.j GROUP BY ALL)",
        f"{p}d AS MATERIALIZED (SELECT n.target, n.i, n.n * s - 1 AS own, s FROM {p}n n JOIN {p}b b ON b.target = n.target)",
        f"{p}0 AS MATERIALIZED (SELECT d.target, d.i AS src, d.i, 1.0::DOUBLE AS v FROM {p}d d JOIN ({sources}) q ON q.target = d.target AND q.i = d.i)",
    ]
    for k in range(DEGREE):
        twice = 1 if k == 0 else 2
        before = f" UNION ALL SELECT target, src, i, -v FROM {p}{k - 1}" if k else ""
        parts.append(f"""{p}{k + 1} AS MATERIALIZED (SELECT target, src, i, sum(v) AS v FROM (
  SELECT w.target, w.src, w.i, {twice} * d.own * w.v AS v FROM {p}{k} w JOIN {p}d d ON d.target = w.target AND d.i = w.i
  UNION ALL SELECT w.target, w.src, e.j, -{twice} * d.s * w.v FROM {p}{k} w JOIN {p}d d ON d.target = w.target AND d.i = w.i JOIN edges e ON e.target = w.target AND e.i = w.i{before}) GROUP BY ALL)""")
    every = " UNION ALL ".join(f"SELECT *, {k} AS k FROM {p}{k}" for k in range(DEGREE + 1))
    parts += [
        f"{p}t AS MATERIALIZED (SELECT * FROM (VALUES {grid}) AS g(form, t, w))",
        f"{p}j AS MATERIALIZED (SELECT k, t, avg(cos(k * x - t / 2 * sin(x))) * CASE WHEN k > 0 THEN 2 ELSE 1 END AS j FROM range({DEGREE + 1}) r(k), (SELECT DISTINCT t FROM {p}t), (SELECT 2 * pi() * m / {n} AS x FROM range({n}) r(m)) GROUP BY k, t)",
        f"{p}u AS MATERIALIZED ({every})",
        f"{p}a AS MATERIALIZED (SELECT target, src, i, t, sum(v * j * CASE k % 4 WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END) AS re, sum(v * j * CASE k % 4 WHEN 1 THEN -1 WHEN 3 THEN 1 ELSE 0 END) AS im FROM {p}u JOIN {p}j USING (k) GROUP BY ALL)",
        f"{name} AS MATERIALIZED (SELECT target, src, i, {'form AS convention, ' if forms else ''}CASE WHEN i = src THEN 0 ELSE round(sum(w * (re * re + im * im)) / sum(w), 12) END AS c FROM {p}a JOIN {p}t USING (t) GROUP BY target, src, i, form)",
    ]
    return ",\n" + ",\n".join(parts)


_WALK = _walk_sql("SELECT target, i FROM chain WHERE source")
#: The objective on the lining of the best pocket, with the walk from each of its residues.
_LINING = _QUBO[len(_VALUES) :]
_LINKED = _LINING.replace("picked AS (", "picked AS MATERIALIZED (").replace("pc AS (SELECT *, round(1 / (1 + d * d), 9) AS c FROM pd)", _walk_sql("SELECT target, i FROM picked", "lk", "v")[2:] + ",\npc AS (SELECT pd.*, coalesce(lk.c, 0) AS c FROM pd LEFT JOIN lk ON lk.target = pd.target AND lk.src = pd.i AND lk.i = pd.j)")
_READINGS = f"""{_WITH}{_HOPS}{_walk_sql("SELECT target, i FROM chain WHERE source", forms=CONVENTIONS)},
hp AS (SELECT v.target, convention, v.src, v.i, c, hop FROM vals v JOIN hops h ON h.target = v.target AND h.src = v.src AND h.i = v.i),
hq AS (SELECT target, convention, i, (rank() OVER (PARTITION BY target, convention, src, hop ORDER BY c) + (count(*) OVER (PARTITION BY target, convention, src, hop, c) - 1) / 2.0::DOUBLE)::DOUBLE / count(*) OVER (PARTITION BY target, convention, src, hop) AS p FROM hp WHERE hop > 0 UNION ALL SELECT target, convention, i, 0 FROM hp WHERE hop = 0),
sv AS (SELECT q.target, convention, q.i, c.truth, c.residue_id, round(avg(p), 9) AS score FROM hq q JOIN chain c ON c.target = q.target AND c.i = q.i WHERE NOT c.source GROUP BY ALL),
sp AS (SELECT target, convention, count(*) AS n, sum(truth)::BIGINT AS p FROM sv GROUP BY ALL),
ss AS (SELECT target, convention, score, sum(truth) AS tp, count(*) AS n FROM sv GROUP BY ALL),
su AS (SELECT target, convention, tp, sum(tp) OVER w AS a, sum(n) OVER w AS b FROM ss WINDOW w AS (PARTITION BY target, convention ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
sa AS (SELECT su.target, su.convention, sum(tp::DOUBLE / p * a / b) / any_value(p / n::DOUBLE) AS lift FROM su JOIN sp ON sp.target = su.target AND sp.convention = su.convention WHERE p > 0 AND p < n GROUP BY ALL),
sh AS (SELECT target, convention, sum(truth)::BIGINT AS hits, string_agg(residue_id, ' | ' ORDER BY k) AS top_five FROM (SELECT *, row_number() OVER (PARTITION BY target, convention ORDER BY score DESC, i) AS k FROM sv) WHERE k <= 5 GROUP BY ALL)
SELECT sa.target, sa.convention, round(lift, 9) AS lift, hits, top_five FROM sa JOIN sh ON sh.target = sa.target AND sh.convention = sa.convention"""
_GRID = " UNION ALL ".join(f"SELECT '{n}' AS convention, {k} AS k, {t!r}::DOUBLE AS t, {'1::DOUBLE' if decay is None else f'exp(-{t!r}::DOUBLE / {decay})'} AS w" for n, (ts, decay) in CONVENTIONS.items() for k, t in enumerate(ts))


def _on_walk(sql: str) -> str:
    return sql.replace(_VALUES, _WALK)


ORACLES = {
    "anm_response": f"{_WITH}{_RESPONSE} SELECT target, i, j, round(c, 6) AS c FROM re",
    "hinge_scores": f"{_WITH}{_HINGES} SELECT re.target, re.i, round(any_value(t), 6) AS threshold, count(*) FILTER (round(c, 12) > t) AS hinge FROM re JOIN th ON th.target = re.target GROUP BY ALL",
    "ctqw_sources": f"{_WITH}{_WALK} SELECT target, src, i, round(c, 9) AS c FROM vals",
    "ctqw_hop_percentiles": _on_walk(_PLAIN["hop_percentiles"]),
    "ctqw_explained": _on_walk(_PLAIN["hop_explained_variance"]),
    "ctqw_distal_source": _on_walk(_PLAIN["distal_source"]),
    "ctqw_regions": _on_walk(_STABLE["region_scores"]),
    "ctqw_hit_list": _PLAIN["hit_list"].replace(_QUBO, _WALK + _LINKED),
    "time_grid": f"{_WITH}{_walk_sql('SELECT target, i FROM chain WHERE source').split('wd AS')[0].rstrip(', ').rstrip().rstrip(',')}, tg AS ({_GRID}) SELECT target, convention, k, round(t * s / 2, 9) AS t, round(w / sum(w) OVER (PARTITION BY target, convention), 9) AS weight FROM wb, tg",
    "time_convention": _READINGS,
}
QUERIES = {f.__name__: f for f in (anm_response, hinge_scores, ctqw_sources, ctqw_exact, ctqw_hop_percentiles, ctqw_explained, ctqw_distal_source, ctqw_regions, ctqw_hit_list, time_grid, time_convention)}
