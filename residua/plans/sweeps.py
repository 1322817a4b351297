"""Queries on snapshots with all atoms, lining modes and the sweep of cutoffs, with the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from residua.operators import cavity, evaluate, geometry, graph, sourced, subset
from residua.plans.catalog import _VALUES, _WITH
from residua.plans.ensemble import _FIELDS, _modes
from residua.plans.records import ORACLES as _KEPT
from residua.plans.records import family_residues, void_support
from residua.sources import results
from residua.sources.chains import chain

CUTOFFS = (6.5, 7.8, 8.5)


def snapshot_atoms(spark, sf_dir):
    """Two atoms a residue through all snapshots, written as atom lines and read back."""
    rows = chain(spark, sf_dir)
    own = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(n).alias("atom"), F.lit(float(k)).alias("off")) for k, n in enumerate(("CA", "CB")))))
    atoms = rows.select("target", "i", own.alias("a"), *"xyz").select("target", "i", (2 * F.col("i") + F.col("a.k")).alias("serial"), "a.atom", F.lit("C").alias("element"), F.lit("ALA").alias("resname"), F.lit("A").alias("chain"), (F.col("i") + 1).alias("resnum"), F.round(F.col("x") + F.col("a.off"), 3).alias("x"), "y", "z")
    path = graph.scratch(spark)
    results.write_snapshots(cavity.snapshot_atoms(atoms, cavity.displacements(_modes(spark, sf_dir))), path)
    return results.read_snapshots(spark, path).select("target", "snapshot", "serial", "atom", "resname", "resnum", *"xyz")


def lining_modes(spark, sf_dir):
    """Of every family: the void's support and how often a residue lines it."""
    seen = family_residues(spark, sf_dir).join(void_support(spark, sf_dir), ["target", "i"])
    found = subset.lining(seen.select(F.struct("target", "scout").alias("target"), "i", "support", F.col("persistence").alias("frequency")))
    return found.select("target.target", "target.scout", "i", "mode", F.round("g", 9).alias("g"))


def cutoff_profile(spark, sf_dir):
    """Edges, mean degree, components, lift, hits and the five best residues of the graph of each cutoff."""
    rows = graph.kept(chain(spark, sf_dir))
    key = F.struct("target", "cutoff").alias("target")
    cuts = F.explode(F.array(*map(F.lit, CUTOFFS))).alias("cutoff")
    edges = graph.kept(geometry.contacts(rows, max(CUTOFFS)).select("target", "i", "j", "d", cuts).filter("d <= cutoff").select(key, "i", "j"))
    nodes = graph.kept(rows.select("target", "i", "residue_id", "truth", "source", *"xyz", cuts).select(key, "i", "residue_id", "truth", "source", *"xyz"))
    parts = graph.least_labels(nodes, edges).groupBy("target").agg(F.count_distinct("component").alias("components"))
    scored = sourced.hop_percentiles(sourced.inverse(nodes), nodes.filter("source"), edges).withColumn("score", F.round("score", 9))
    scope = graph.kept(nodes.filter(~F.col("source")).join(scored, ["target", "i"]))
    best = scope.withColumn("k", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("score"), "i"))).filter("k <= 5")
    told = F.concat_ws(";", F.transform(F.sort_array(F.collect_list(F.struct("k", "residue_id"))), lambda x: x["residue_id"]))
    out = geometry.graph_stats(nodes, edges).join(parts, "target").join(best.groupBy("target").agg(told.alias("top_five")), "target")
    out = out.join(evaluate.evaluation(scope).select("target", "lift", "hits"), "target")
    return out.select("target.target", "target.cutoff", "edges", F.round("mean_degree", 9).alias("mean_degree"), "components", F.round("lift", 9).alias("lift"), "hits", "top_five")


_CUTS = ", ".join(f"{c}" for c in CUTOFFS)
_PROFILE = f"""{_WITH}{_VALUES}, cu AS (SELECT unnest([{_CUTS}]::DOUBLE[]) AS cutoff),
ec AS MATERIALIZED (SELECT target, cutoff, i, j FROM dist, cu WHERE d > 0 AND d <= cutoff),
hc AS MATERIALIZED (SELECT target, cutoff, src, i, hop FROM (
  WITH RECURSIVE f(target, cutoff, src, i, hop) USING KEY (target, cutoff, src, i) AS (
    SELECT target, cutoff, i, i, 0 FROM chain, cu WHERE source
    UNION SELECT DISTINCT f.target, f.cutoff, f.src, e.j, f.hop + 1 FROM f JOIN ec e ON f.target = e.target AND f.cutoff = e.cutoff AND f.i = e.i
      LEFT JOIN recurring.f k ON k.target = f.target AND k.cutoff = f.cutoff AND k.src = f.src AND k.i = e.j WHERE k.i IS NULL)
  SELECT * FROM f)),
rc AS (SELECT target, cutoff, i, i AS j FROM chain, cu UNION SELECT r.target, r.cutoff, r.i, e.j FROM rc r JOIN ec e ON e.target = r.target AND e.cutoff = r.cutoff AND e.i = r.j),
pc AS (SELECT target, cutoff, count(DISTINCT m) AS components FROM (SELECT target, cutoff, i, min(j) AS m FROM rc GROUP BY ALL) GROUP BY ALL),
hp AS (SELECT v.target, cutoff, v.src, v.i, c, hop FROM vals v JOIN hc h ON h.target = v.target AND h.src = v.src AND h.i = v.i),
hq AS (SELECT target, cutoff, i, (rank() OVER (PARTITION BY target, cutoff, src, hop ORDER BY c) + (count(*) OVER (PARTITION BY target, cutoff, src, hop, c) - 1) / 2.0::DOUBLE)::DOUBLE / count(*) OVER (PARTITION BY target, cutoff, src, hop) AS p FROM hp WHERE hop > 0 UNION ALL SELECT target, cutoff, i, 0 FROM hp WHERE hop = 0),
sv AS MATERIALIZED (SELECT q.target, cutoff, q.i, c.truth, c.residue_id, round(avg(p), 9) AS score FROM hq q JOIN chain c ON c.target = q.target AND c.i = q.i WHERE NOT c.source GROUP BY ALL),
sp AS (SELECT target, cutoff, count(*) AS n, sum(truth)::BIGINT AS p FROM sv GROUP BY ALL),
ss AS (SELECT target, cutoff, score, sum(truth) AS tp, count(*) AS n FROM sv GROUP BY ALL),
su AS (SELECT target, cutoff, tp, sum(tp) OVER w AS a, sum(n) OVER w AS b FROM ss WINDOW w AS (PARTITION BY target, cutoff ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
sa AS (SELECT su.target, su.cutoff, sum(tp::DOUBLE / p * a / b) / any_value(p / n::DOUBLE) AS lift FROM su JOIN sp ON sp.target = su.target AND sp.cutoff = su.cutoff WHERE p > 0 AND p < n GROUP BY ALL),
sh AS (SELECT target, cutoff, sum(truth)::BIGINT AS hits, string_agg(residue_id, ';' ORDER BY k) AS top_five FROM (SELECT *, row_number() OVER (PARTITION BY target, cutoff ORDER BY score DESC, i) AS k FROM sv) WHERE k <= 5 GROUP BY ALL),
gs AS (SELECT c.target, c.cutoff, coalesce(m, 0) // 2 AS edges, coalesce(m, 0) / n::DOUBLE AS mean_degree FROM (SELECT target, cutoff, count(*) AS n FROM chain, cu GROUP BY ALL) c LEFT JOIN (SELECT target, cutoff, count(*) AS m FROM ec GROUP BY ALL) e ON e.target = c.target AND e.cutoff = c.cutoff)
SELECT gs.target, gs.cutoff, edges, round(mean_degree, 9) AS mean_degree, components, round(lift, 9) AS lift, hits, top_five FROM gs JOIN pc ON pc.target = gs.target AND pc.cutoff = gs.cutoff JOIN sa ON sa.target = gs.target AND sa.cutoff = gs.cutoff JOIN sh ON sh.target = gs.target AND sh.cutoff = gs.cutoff"""
ORACLES = {
    "snapshot_atoms": f"""{_WITH}{_FIELDS}, ao AS (SELECT target, i, 2 * i + k AS serial, CASE k WHEN 0 THEN 'CA' ELSE 'CB' END AS atom, round(x + k, 3) AS x, y, z FROM chain, (SELECT unnest([0, 1]) AS k)),
al AS (SELECT target, 0 AS snapshot, i, serial, atom, x, y, z FROM ao UNION ALL SELECT ao.target, snapshot, ao.i, serial, atom, round(x + dx, 3), round(y + dy, 3), round(z + dz, 3) FROM ao JOIN dp ON dp.target = ao.target AND dp.i = ao.i)
SELECT target, snapshot, serial % 100000 AS serial, atom, 'ALA' AS resname, (i + 1) % 10000 AS resnum, x, y, z FROM al""",
    "lining_modes": f"""WITH lr AS (SELECT f.target, f.scout, f.i, support, persistence AS q FROM ({_KEPT["family_residues"]}) f JOIN ({_KEPT["void_support"]}) v ON v.target = f.target AND v.i = f.i),
lv AS (SELECT target, scout, i, mode, round(support * CASE mode WHEN 'support' THEN 1 WHEN 'persistent' THEN sqrt(q) ELSE sqrt(1 - q) END, 12) AS v FROM lr, (SELECT unnest(['support', 'persistent', 'variable']) AS mode)),
lm AS (SELECT *, max(v) OVER (PARTITION BY target, scout, mode) AS most FROM lv)
SELECT target, scout, i, mode, round((rank() OVER (PARTITION BY target, scout, mode ORDER BY v) + (count(*) OVER (PARTITION BY target, scout, mode, v) - 1) / 2.0::DOUBLE)::DOUBLE / count(*) OVER (PARTITION BY target, scout, mode), 9) AS g FROM lm WHERE most > 0""",
    "cutoff_profile": _PROFILE,
}
QUERIES = {f.__name__: f for f in (snapshot_atoms, lining_modes, cutoff_profile)}
