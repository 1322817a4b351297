"""Queries on result files, eligibility, guards and tiers, with the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from residua.operators import cavity, eligibility, evaluate, geometry, graph, sourced
from residua.plans.catalog import _EVAL, _HOPS, _VALUES, _WITH, _edges
from residua.plans.ensemble import _CONTROLS, _FIELDS, _native, _observed, _snapshots
from residua.sources import results
from residua.sources.chains import chain

CUTOFFS = (3.5, 4.5, 6.5, 7.8, 8.5, 10.0)
_joined = lambda c: F.concat_ws(",", F.transform(F.sort_array(c), lambda x: x.cast("string")))


def _top(rows, order="score", size=5):
    best = F.row_number().over(Window.partitionBy("target").orderBy(F.desc(order), "i"))
    return rows.withColumn("rank", best.cast("int")).filter(F.col("rank") <= size)


def scan_scores(spark, sf_dir):
    path = graph.scratch(spark)
    rows = chain(spark, sf_dir)
    results.write_table(rows.select("target", F.col("i").alias("matrix_index"), F.lit("A").alias("chain_id"), (F.col("i") + 1).alias("residue_number"), F.lit("").alias("insertion_code"), F.col("score").alias("quantum_score"), (~F.col("source")).cast("int").alias("eligible")), path)
    return results.read_scores(spark, path)


def scan_hits(spark, sf_dir):
    path = graph.scratch(spark)
    results.write_table(_top(chain(spark, sf_dir)).select("target", "rank", F.col("i").alias("matrix_index"), "residue_id", "score"), path)
    return results.read_hits(spark, path)


def matrix_roundtrip(spark, sf_dir):
    """A source's values by residue, as the lines of a matrix."""
    path = graph.scratch(spark)
    rows = chain(spark, sf_dir)
    results.write_matrix(sourced.lines(sourced.inverse(rows), rows.filter("source"), results.CELL), path)
    return results.read_matrix(spark, path)


def method_roundtrip(spark, sf_dir):
    """Odd targets are written with the older names of the pocket's fields."""
    path = graph.scratch(spark)
    rows = chain(spark, sf_dir)
    ids = F.transform(F.sort_array(F.collect_list(F.struct("i", "residue_id"))), lambda x: x["residue_id"])
    own = F.sort_array(F.collect_list(F.when(F.col("source"), F.col("residue_id"))))
    out = rows.groupBy("target").agg(ids.alias("ids"), own.alias("own"), F.count(F.lit(1)).alias("n"), F.max("score").alias("best"), F.sort_array(F.collect_list(F.when(F.col("source"), F.col("i")))).alias("at"))
    old = F.col("target") % 2 == 1
    pocket = F.struct(F.lit(1).alias("number"), F.when(~old, F.col("best")).alias("geometry_score"), F.when(old, F.col("best")).alias("score"), F.when(~old, F.col("at")).alias("residue_numbers"), F.when(old, F.col("at")).alias("residues"))
    results.write_method(out.select("target", F.lit(1).alias("schema_version"), F.sha2(F.concat_ws(",", "ids"), 256).alias("input_sha256"), F.struct(F.col("n").alias("residues"), F.col("own").alias("orthosteric")).alias("scope"), F.struct(F.lit(7.8).alias("cutoff"), F.lit(5).alias("top_k")).alias("parameters"), pocket.alias("pocket")), path)
    return results.read_method(spark, path).select("target", "schema_version", "input_sha256", F.col("scope.residues").alias("residues"), F.concat_ws(",", "scope.orthosteric").alias("orthosteric"), F.col("parameters.cutoff").alias("cutoff"), "geometry_score", F.concat_ws(",", F.transform("residue_numbers", lambda x: x.cast("string"))).alias("residue_numbers"))


def domain_residues(spark, sf_dir):
    """Residues inside a window per target, given as text."""
    rows = chain(spark, sf_dir)
    specs = rows.groupBy("target").agg(F.count(F.lit(1)).alias("n")).select("target", F.concat(F.lit("A:"), (F.col("target") % 7 + 2).cast("string"), F.lit("-"), F.floor(F.col("n") * 2 / 3).cast("string")).alias("spec"))
    at = results.windows(specs)
    return rows.join(at, "target").filter((F.split("residue_id", ":")[0] == F.col("chain")) & (F.col("i") + 1).between(F.col("first"), F.col("last"))).select("target", "i", "residue_id")


def resolve_sources(spark, sf_dir):
    rows = chain(spark, sf_dir)
    asked = rows.filter("source").groupBy("target").agg(F.sort_array(F.collect_list("residue_id")).alias("ids"))
    asked = asked.select("target", F.posexplode(F.concat("ids", F.slice("ids", 1, 2), F.array(F.lit("B:1")))).alias("ord", "residue_id"))
    return results.resolved(asked, rows)


def label_join(spark, sf_dir):
    rows = chain(spark, sf_dir)
    found = rows.filter("truth = 1 and i % 2 = 0").select("target", "residue_id", F.lit(1).alias("label"))
    return rows.select("target", "i", "residue_id").join(found, ["target", "residue_id"], "left").fillna(0, ["label"])


def _valid(spark, sf_dir):
    rows, edges = _edges(spark, sf_dir)
    members = _native(spark, sf_dir)
    return rows, members, eligibility.valid_observations(members, rows.filter("source"), graph.shell(rows, edges))


def valid_observations(spark, sf_dir):
    return _valid(spark, sf_dir)[2].withColumn("shell_share", F.round("shell_share", 9))


def eligible_pockets(spark, sf_dir):
    rows, members, valid = _valid(spark, sf_dir)
    out = eligibility.eligible_pockets(members, valid, graph.sequence_mask(rows, 1).filter("masked"))
    return out.groupBy("target", "pocket").agg(_joined(F.collect_list("i")).alias("members"))


def best_family(spark, sf_dir):
    return eligibility.best_family(_native(spark, sf_dir), _top(chain(spark, sf_dir)))


def family_residues(spark, sf_dir):
    """Of a family's events, the share whose scout pocket holds a residue."""
    moved, at = _snapshots(spark, sf_dir)
    events = moved.filter("amplitude = 2.0").select("target", "snapshot", "mode", "sign").distinct()
    members = cavity.detect(at).join(events, ["target", "snapshot"]).select("target", "mode", "sign", F.col("pocket").alias("scout"), "i")
    seen = _observed(spark, sf_dir).select("target", "mode", "sign", "scout")
    count = seen.groupBy("target", "scout").agg(F.count(F.lit(1)).alias("events"))
    held = members.join(seen, ["target", "mode", "sign", "scout"]).groupBy("target", "scout", "i").agg(F.count(F.lit(1)).alias("held"))
    return held.join(count, ["target", "scout"]).select("target", "scout", "i", F.round(F.col("held") / F.col("events"), 9).alias("persistence"))


def control_eligible(spark, sf_dir):
    rows, edges = _edges(spark, sf_dir)
    near = sourced.nearest_hops(rows.filter("source"), edges)
    scope = evaluate.scope(rows).select("target", "i", "truth").join(geometry.burial(rows), ["target", "i"]).join(near, ["target", "i"])
    return eligibility.matched_controls(scope)


def evaluate_tiers(spark, sf_dir):
    """Every fifth target without any truth: its measures are null."""
    rows = evaluate.scope(chain(spark, sf_dir)).withColumn("truth", F.when(F.col("target") % 5 == 0, 0).otherwise(F.col("truth")))
    measured = evaluate.evaluation(rows).select("target", *[F.round(c, 9).alias(c) for c in ("ap", "lift", "auroc")])
    return rows.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.sum("truth").alias("positives")).join(measured, "target", "left")


def replay_guard(spark, sf_dir):
    """Against a table that renames every fiftieth residue of odd targets."""
    rows = chain(spark, sf_dir)
    other = rows.withColumn("residue_id", F.when((F.col("target") % 2 == 1) & (F.col("i") % 50 == 7), F.lit("B:1")).otherwise(F.col("residue_id")))
    return results.replayed(rows, other)


def top_five_guard(spark, sf_dir):
    """The five best residues by the score, and by the score to one digit."""
    rows = chain(spark, sf_dir)
    told = lambda df, name: df.groupBy("target").agg(_joined(F.collect_list("i")).alias(name))
    both = told(_top(rows), "published").join(told(_top(rows.withColumn("rough", F.round("score", 1)), "rough"), "again"), "target")
    return both.withColumn("same", F.col("published") == F.col("again"))


def rank_probe(spark, sf_dir):
    """Ranks of the five best residues by score, and by burial."""
    rows = chain(spark, sf_dir).join(geometry.burial(chain(spark, sf_dir)), ["target", "i"])
    by = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("burial"), "i"))
    return _top(rows.withColumn("by_burial", by.cast("int"))).select("target", "residue_id", "rank", "by_burial")


def set_ops_residues(spark, sf_dir):
    rows, edges = _edges(spark, sf_dir)
    every = graph.shell(rows, edges).withColumn("shell", F.lit(True)).join(rows.select("target", "i", (F.col("truth") == 1).alias("truth"), "source"), ["target", "i"], "right").fillna(False, ["shell"])
    s, t = F.col("shell"), F.col("truth")
    return every.groupBy("target").agg(F.count_if(s & t).alias("both"), F.count_if(s | t).alias("either"), F.count_if(s & ~t).alias("only_shell"), F.count_if(s & ~F.col("source")).alias("around"))


def void_support(spark, sf_dir):
    """Mean over a target's sources of a narrow Gaussian of the distance, around 3.8."""
    d = F.sqrt(sum((F.col(c) - F.col(f"{c}s")) * (F.col(c) - F.col(f"{c}s")) for c in "xyz"))
    rows = chain(spark, sf_dir)
    own = rows.filter("source").select("target", *[F.col(c).alias(f"{c}s") for c in "xyz"])
    z = (d - 3.8) / 0.25
    return rows.join(own, "target").groupBy("target", "i").agg(F.round(F.avg(F.exp(-0.5 * z * z)), 9).alias("support"))


def cutoff_errors(spark, sf_dir):
    """Edges under each cutoff; where a residue is left alone, the number of such residues instead."""
    rows = chain(spark, sf_dir)
    cuts = F.explode(F.array(*map(F.lit, CUTOFFS)))
    degree = geometry.contacts(rows, max(CUTOFFS)).withColumn("cutoff", cuts).filter("d <= cutoff").groupBy("target", "i", "cutoff").agg(F.count(F.lit(1)).alias("degree"))
    every = rows.select("target", "i", cuts.alias("cutoff")).join(degree, ["target", "i", "cutoff"], "left").fillna(0, ["degree"])
    out = every.groupBy("target", "cutoff").agg((F.sum("degree") / 2).cast("long").alias("edges"), F.count_if(F.col("degree") == 0).alias("isolated"))
    return out.select("target", "cutoff", F.when(F.col("isolated") == 0, F.col("edges")).alias("edges"), "isolated")


_NATIVE = f"{_WITH}{_FIELDS}, nat AS (SELECT target, pocket, i FROM pt WHERE snapshot = 0)"
_SHELL = "sh AS (SELECT target, i FROM chain WHERE source UNION SELECT e.target, e.j FROM edges e JOIN chain s ON s.source AND s.target = e.target AND s.i = e.i)"
_VALID = f"{_NATIVE}, {_SHELL}, va AS (SELECT n.target, n.pocket, count(*) AS size, count(sh.i) / count(*)::DOUBLE AS shell_share FROM nat n JOIN chain c ON c.target = n.target AND c.i = n.i LEFT JOIN sh ON sh.target = n.target AND sh.i = n.i GROUP BY ALL HAVING count(*) >= 5 AND count(*) FILTER (c.source) = 0 AND count(sh.i) / count(*)::DOUBLE < 0.5)"
_TOP = "tp AS (SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY target ORDER BY score DESC, i))::INT AS rank FROM chain) WHERE rank <= 5)"
_SCOPED = "scope AS (SELECT * REPLACE (CASE WHEN target % 5 = 0 THEN 0 ELSE truth END AS truth) FROM chain WHERE NOT source)"
ORACLES = {
    "scan_scores": f"{_WITH} SELECT target, i AS matrix_index, 'A' AS chain_id, i + 1 AS residue_number, '' AS insertion_code, score AS quantum_score, (NOT source)::INT AS eligible FROM chain",
    "scan_hits": f"{_WITH}, {_TOP} SELECT target, rank, i AS matrix_index, residue_id, score FROM tp",
    "matrix_roundtrip": f"{_WITH}{_VALUES} SELECT target, src AS i, i AS j, c AS v FROM vals",
    "method_roundtrip": f"{_WITH} SELECT target, 1 AS schema_version, sha256(string_agg(residue_id, ',' ORDER BY i)) AS input_sha256, count(*) AS residues, coalesce(string_agg(residue_id, ',' ORDER BY residue_id) FILTER (source), '') AS orthosteric, 7.8::DOUBLE AS cutoff, max(score) AS geometry_score, coalesce(string_agg(i::VARCHAR, ',' ORDER BY i) FILTER (source), '') AS residue_numbers FROM chain GROUP BY target",
    "domain_residues": f"{_WITH} SELECT target, i, residue_id FROM (SELECT *, count(*) OVER (PARTITION BY target) AS n FROM chain) WHERE i + 1 BETWEEN target % 7 + 2 AND n * 2 // 3",
    "resolve_sources": f"{_WITH}, o AS (SELECT target, residue_id, i, (row_number() OVER (PARTITION BY target ORDER BY residue_id) - 1)::INT AS ord, count(*) OVER (PARTITION BY target) AS n FROM chain WHERE source) SELECT target, residue_id, ord, i, false AS missing FROM o UNION ALL SELECT DISTINCT target, 'B:1', (n + least(n, 2))::INT, NULL, true FROM o",
    "label_join": f"{_WITH} SELECT target, residue_id, i, (truth = 1 AND i % 2 = 0)::INT AS label FROM chain",
    "valid_observations": f"{_VALID} SELECT target, pocket, size, round(shell_share, 9) AS shell_share FROM va",
    "eligible_pockets": f"{_VALID}, ms AS (SELECT DISTINCT c.target, c.i FROM chain c JOIN chain s ON s.source AND s.target = c.target AND abs(s.i - c.i) <= 1) SELECT n.target, n.pocket, string_agg(n.i::VARCHAR, ',' ORDER BY n.i) AS members FROM nat n JOIN va ON va.target = n.target AND va.pocket = n.pocket LEFT JOIN ms ON ms.target = n.target AND ms.i = n.i WHERE ms.i IS NULL GROUP BY ALL HAVING count(*) >= 5",
    "best_family": f"{_NATIVE}, {_TOP}, bf AS (SELECT n.target, n.pocket, round(count(tp.i) / (count(*) + 5 - count(tp.i))::DOUBLE, 9) AS jaccard FROM nat n LEFT JOIN tp ON tp.target = n.target AND tp.i = n.i GROUP BY ALL) SELECT target, pocket, jaccard FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY jaccard DESC, pocket) AS k FROM bf) WHERE k = 1",
    "family_residues": f"{_WITH}{_FIELDS}, fr AS (SELECT st.target, st.scout, unnest(ob.m) AS i FROM st JOIN ob ON ob.target = st.target AND ob.mode = st.mode AND ob.sign = st.sign AND ob.pocket = st.scout AND ob.amplitude = 2) SELECT fr.target, fr.scout, fr.i, round(count(*) / max(fm.seen)::DOUBLE, 9) AS persistence FROM fr JOIN fm ON fm.target = fr.target AND fm.scout = fr.scout GROUP BY ALL",
    "control_eligible": _CONTROLS[: _CONTROLS.index("ct AS")] + "aa AS (SELECT b.*, nh.hop FROM bu b JOIN nh ON nh.target = b.target AND nh.i = b.i), mm AS (SELECT target, avg(burial) AS mb, avg(hop) AS mh FROM aa WHERE truth = 1 GROUP BY target) SELECT aa.target, aa.i FROM aa JOIN mm ON mm.target = aa.target WHERE truth = 0 AND abs(burial - mb) <= 0.3::DOUBLE * greatest(mb, 1) AND abs(hop - mh) <= 0.3::DOUBLE * greatest(mh, 1)",
    "evaluate_tiers": f"{_WITH}, {_SCOPED}{_EVAL.replace('FROM chain', 'FROM scope')} SELECT pos.target, n, p AS positives, round(CASE WHEN p > 0 AND p < n THEN ap END, 9) AS ap, round(CASE WHEN p > 0 AND p < n THEN ap / (p / n::DOUBLE) END, 9) AS lift, round(CASE WHEN p > 0 AND p < n THEN auroc END, 9) AS auroc FROM pos LEFT JOIN ap ON ap.target = pos.target LEFT JOIN au ON au.target = pos.target",
    "replay_guard": f"{_WITH} SELECT target, count(*) AS n, count(*) FILTER (target % 2 = 1 AND i % 50 = 7) AS unlike, count(*) FILTER (target % 2 = 1 AND i % 50 = 7) = 0 AS same FROM chain GROUP BY target",
    "top_five_guard": f"{_WITH}, {_TOP}, ro AS (SELECT target, i FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(score, 1) DESC, i) AS k FROM chain) WHERE k <= 5), a AS (SELECT target, string_agg(i::VARCHAR, ',' ORDER BY i) AS m FROM tp GROUP BY target), b AS (SELECT target, string_agg(i::VARCHAR, ',' ORDER BY i) AS m FROM ro GROUP BY target) SELECT a.target, a.m AS published, b.m AS again, a.m = b.m AS same FROM a JOIN b ON a.target = b.target",
    "rank_probe": f"{_WITH}, bu AS (SELECT c.target, c.i, count(d.j) AS burial FROM chain c LEFT JOIN dist d ON d.target = c.target AND d.i = c.i AND d.d > 0 AND d.d <= 10 GROUP BY ALL), rb AS (SELECT *, (row_number() OVER (PARTITION BY target ORDER BY burial DESC, i))::INT AS by_burial FROM bu), {_TOP} SELECT tp.target, tp.residue_id, tp.rank, rb.by_burial FROM tp JOIN rb ON rb.target = tp.target AND rb.i = tp.i",
    "set_ops_residues": f"{_WITH}, {_SHELL} SELECT c.target, count(*) FILTER (sh.i IS NOT NULL AND truth = 1) AS \"both\", count(*) FILTER (sh.i IS NOT NULL OR truth = 1) AS either, count(*) FILTER (sh.i IS NOT NULL AND truth = 0) AS only_shell, count(*) FILTER (sh.i IS NOT NULL AND NOT source) AS around FROM chain c LEFT JOIN sh ON sh.target = c.target AND sh.i = c.i GROUP BY c.target",
    "void_support": f"{_WITH} SELECT c.target, c.i, round(avg(exp(-0.5::DOUBLE * pow((sqrt((c.x-s.x)*(c.x-s.x) + (c.y-s.y)*(c.y-s.y) + (c.z-s.z)*(c.z-s.z)) - 3.8::DOUBLE) / 0.25::DOUBLE, 2))), 9) AS support FROM chain c JOIN chain s ON s.source AND s.target = c.target GROUP BY ALL",
    "cutoff_errors": f"{_WITH}, k AS (SELECT unnest([{', '.join(map(str, CUTOFFS))}]::DOUBLE[]) AS cutoff), g AS (SELECT c.target, c.i, k.cutoff, count(d.j) AS degree FROM chain c CROSS JOIN k LEFT JOIN dist d ON d.target = c.target AND d.i = c.i AND d.d > 0 AND d.d <= k.cutoff GROUP BY ALL) SELECT target, cutoff, CASE WHEN count(*) FILTER (degree = 0) = 0 THEN (sum(degree) // 2)::BIGINT END AS edges, count(*) FILTER (degree = 0) AS isolated FROM g GROUP BY ALL",
}
QUERIES = {
    f.__name__: f
    for f in (
        scan_scores, scan_hits, matrix_roundtrip, method_roundtrip, domain_residues, resolve_sources, label_join, valid_observations, eligible_pockets, best_family, family_residues,
        control_eligible, evaluate_tiers, replay_guard, top_five_guard, rank_probe, set_ops_residues, void_support, cutoff_errors,
    )
}
