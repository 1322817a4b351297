"""Queries on snapshots, pockets, patches, walks and controls, with the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from residua.operators import cavity, evaluate, geometry, graph, modes, sourced, subset
from residua.plans.catalog import ORACLES as _PLAIN
from residua.plans.catalog import _CLIQUES, _EVAL, _HOPS, _SUBSETS, _VALUES, _WITH, _candidates, _cliques, _edges, _regions, hop_explained_variance
from residua.sources.chains import STEP, chain

WEIGHTS = (0.0, 0.05, 0.1, 0.2, 0.5)


def _modes(spark, sf_dir):
    """Two mode fields from components 9 to 14 of each vector."""
    rows = chain(spark, sf_dir).select("target", "i", "vec_id")
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    fields = F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), *[F.col("embedding")[8 + 3 * m + k].cast("double").alias(f"u{c}") for k, c in enumerate("xyz")]) for m in (0, 1))))
    return rows.join(e, "vec_id").select("target", "i", fields.alias("m")).select("target", "m.mode", "i", "m.ux", "m.uy", "m.uz")


def _snapshots(spark, sf_dir):
    moved = cavity.displacements(_modes(spark, sf_dir))
    return moved, cavity.snapshots(chain(spark, sf_dir), moved)


def _observed(spark, sf_dir):
    moved, at = _snapshots(spark, sf_dir)
    members = cavity.detect(at)
    events = moved.select("target", "snapshot", "mode", "sign", "amplitude").distinct()
    rows = members.join(cavity.plausible(members), cavity.POCKET, "left_semi").join(events, ["target", "snapshot"])
    return cavity.stable(rows.filter("amplitude = 2.0"), rows.filter("amplitude = 2.5"))


def enm_displacements(spark, sf_dir):
    return cavity.displacements(_modes(spark, sf_dir)).select("target", "snapshot", "mode", "sign", "amplitude", "i", *[F.round(f"d{c}", 6).alias(f"d{c}") for c in "xyz"])


def snapshot_coords(spark, sf_dir):
    return _snapshots(spark, sf_dir)[1]


def detect_patches(spark, sf_dir):
    return cavity.detect(_snapshots(spark, sf_dir)[1]).withColumn("d", F.round("d", 6))


def plausible_cavities(spark, sf_dir):
    return cavity.plausible(cavity.detect(_snapshots(spark, sf_dir)[1]))


def stable_observations(spark, sf_dir):
    return _observed(spark, sf_dir)


def family_stats(spark, sf_dir):
    return cavity.persistence(_observed(spark, sf_dir), 4)


def recurrence_p(spark, sf_dir):
    return cavity.recurrence(cavity.persistence(_observed(spark, sf_dir), 4)).withColumn("p", F.round("p", 9))


def knn_patch(spark, sf_dir):
    return cavity.nearest(chain(spark, sf_dir), 5)


def null_patches(spark, sf_dir):
    rows = chain(spark, sf_dir)
    best = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("score"), "i"))
    found = cavity.null_patches(rows, rows.withColumn("k", best).filter("k <= 5").select("target", "i"))
    return found.select("target", F.concat_ws(",", F.transform("members", lambda m: m.cast("string"))).alias("members"))


def contact_labels(spark, sf_dir):
    """Residues within 4.5 of a second chain's, which is made of components 4 to 6."""
    rows = chain(spark, sf_dir)
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", *[F.col("embedding")[k].cast("double").alias(f"f{k}") for k in (3, 4, 5)])
    r = F.sqrt(F.col("f3") * F.col("f3") + F.col("f4") * F.col("f4") + F.col("f5") * F.col("f5"))
    before = Window.partitionBy("target").orderBy("vec_id").rowsBetween(Window.unboundedPreceding, 0)
    ligand = rows.select("target", "i", "vec_id").join(e, "vec_id").select("target", "i", *[F.round(F.sum(STEP * F.col(f"f{3 + k}") / r).over(before), 3).alias(c) for k, c in enumerate("xyz")])
    return geometry.near_pairs(rows, ligand, 4.5).groupBy("target", "i").agg(F.round(F.min("d"), 6).alias("least"))


def components(spark, sf_dir):
    """Of the contacts within 6.5 that are no neighbours of the chain."""
    rows = chain(spark, sf_dir)
    return graph.least_labels(rows, geometry.contacts(rows, 6.5).filter(F.abs(F.col("i") - F.col("j")) > 1))


def coined_walk_k(spark, sf_dir):
    rows, edges = _edges(spark, sf_dir)
    return graph.coined_walk(rows.filter("source"), edges, 3).select("target", "src", "i", (F.round("p", 6) + 0.0).alias("p"))


def subset_marginals(spark, sf_dir):
    found = subset.marginals(_candidates(spark, sf_dir)[1])
    return found.filter("i >= 0").select("target", "i", F.round(-F.col("energy"), 9).alias("marginal"))


def pair_weight_sweep(spark, sf_dir):
    """The best subset under each pair weight: pair terms of weight 0.1, scaled."""
    q = _candidates(spark, sf_dir)[1].withColumn("weight", F.explode(F.array(*map(F.lit, WEIGHTS))))
    q = q.select(F.struct("target", "weight").alias("target"), "a", "b", F.when(F.col("a") == F.col("b"), F.col("q")).otherwise(F.col("q") * F.col("weight") / 0.1).alias("q"))
    best = subset.chosen(subset.marginals(q))
    return best.select("target.target", "target.weight", F.concat_ws(",", F.transform("members", lambda m: m.cast("string"))).alias("members"), F.round("energy", 9).alias("energy"))


def evaluate_scoped(spark, sf_dir):
    out = evaluate.evaluation(evaluate.scope(chain(spark, sf_dir)))
    return out.select("target", "n", "positives", *[F.round(c, 9).alias(c) for c in ("floor", "ap", "lift", "auroc")], "hits")


def control_lifts(spark, sf_dir):
    """Average precision of the truth itself, of the burial and of minus the hops from the nearest source."""
    rows, edges = _edges(spark, sf_dir)
    near = sourced.nearest_hops(rows.filter("source"), edges)
    all_ = evaluate.scope(rows).select("target", "i", "truth").join(geometry.burial(rows), ["target", "i"]).join(near, ["target", "i"])
    kinds = F.explode(F.array(*(F.struct(F.lit(n).alias("control"), F.col(c).cast("double").alias("score")) for n, c in (("perfect", "truth"), ("burial", "burial"), ("distance", "minus")))))
    long = all_.withColumn("minus", -F.col("hop")).select("target", "i", "truth", kinds.alias("k")).select(F.struct("target", "k.control").alias("target"), "i", "truth", "k.score")
    return evaluate.evaluation(long).select("target.target", "target.control", F.round("ap", 9).alias("ap"), F.round("lift", 9).alias("lift"))


def top_five_string(spark, sf_dir):
    rows, q = _candidates(spark, sf_dir)
    hits = subset.hit_list(subset.scores(rows, subset.marginals(q)))
    return hits.groupBy("target").agg(F.concat_ws(" | ", F.transform(F.sort_array(F.collect_list(F.struct("rank", "residue_id"))), lambda x: x["residue_id"])).alias("top_five"))


def _native(spark, sf_dir):
    """Pockets of the native coordinates."""
    return cavity.detect(chain(spark, sf_dir).withColumn("snapshot", F.lit(0))).select("target", "pocket", "i")


def region_scores(spark, sf_dir):
    return _regions(chain(spark, sf_dir), _native(spark, sf_dir)).select("target", "pocket", F.round("region", 9).alias("region"))


def rank_cavities(spark, sf_dir):
    regions = _regions(chain(spark, sf_dir), _native(spark, sf_dir))
    seen = cavity.persistence(_observed(spark, sf_dir), 4).withColumnRenamed("scout", "pocket")
    return cavity.ranked(regions, seen).withColumn("selection", F.round("selection", 9))


def null_pvalue(spark, sf_dir):
    """Pockets against the null patches of the five best residues."""
    rows = chain(spark, sf_dir)
    best = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("score"), "i"))
    found = cavity.null_patches(rows, rows.withColumn("k", best).filter("k <= 5").select("target", "i"))
    nulls = found.select("target", F.concat_ws(",", F.transform("members", lambda m: m.cast("string"))).alias("pocket"), F.explode("members").alias("i"))
    return cavity.null_pvalue(_regions(rows, _native(spark, sf_dir)), _regions(rows, nulls)).withColumn("p", F.round("p", 9))


def leader_families(spark, sf_dir):
    """Native pockets, largest first."""
    return cavity.families(cavity.by_size(_native(spark, sf_dir)))


def rwr_exact(spark, sf_dir):
    return graph.settled_walk(_cliques(spark, sf_dir)).select("target", "i", "j", F.round("p", 9).alias("p"))


def combined_p(spark, sf_dir):
    """Null p-value and recurrence of the native pockets that are seen again."""
    seen = recurrence_p(spark, sf_dir).withColumnRenamed("scout", "pocket")
    found = cavity.combined(null_pvalue(spark, sf_dir), seen, hop_explained_variance(spark, sf_dir))
    return found.select("target", "pocket", *[F.round(c, 9).alias(c) for c in ("combined_p", "ranking_p")])


def merged_families(spark, sf_dir):
    """A family is what one residue's pocket becomes in the events that show it again."""
    moved, at = _snapshots(spark, sf_dir)
    members = cavity.detect(at)
    centres = members.select(*cavity.POCKET, "i").join(at, ["target", "snapshot", "i"]).groupBy(*cavity.POCKET).agg(*[F.avg(c).alias(c) for c in "xyz"])
    events = moved.filter("amplitude = 2.0").select("target", "snapshot", "mode", "sign").distinct()
    rows = _observed(spark, sf_dir).select("target", "mode", "sign", F.col("scout").alias("pocket")).join(events, ["target", "mode", "sign"])
    rows = rows.join(cavity.plausible(members), cavity.POCKET).join(centres, cavity.POCKET)
    return cavity.merged(rows, 4).select("target", "pocket", "observations", "persistence", "volume", *[F.round(c, 6).alias(c) for c in "xyz"])


def anm_modes(spark, sf_dir):
    return modes.lowest(chain(spark, sf_dir), 4).groupBy("target", "mode").agg(F.round(F.max("eigenvalue"), 6).alias("eigenvalue"), F.round(F.sum(F.col("ux") ** 2 + F.col("uy") ** 2 + F.col("uz") ** 2), 6).alias("norm"))


_FIELDS = """,
md AS (SELECT c.target, m.mode, c.i, e.embedding[9 + 3 * m.mode]::DOUBLE AS ux, e.embedding[10 + 3 * m.mode]::DOUBLE AS uy, e.embedding[11 + 3 * m.mode]::DOUBLE AS uz FROM chain c JOIN embeddings e ON e.vec_id = c.vec_id, (SELECT unnest([0, 1]) AS mode) m),
sc AS (SELECT target, mode, sqrt(avg(ux*ux + uy*uy + uz*uz)) AS r FROM md GROUP BY ALL),
mv AS (SELECT md.target, (1 + (k * 2 + md.mode) * 2 + CASE WHEN sign > 0 THEN 0 ELSE 1 END)::INT AS snapshot, md.mode, sign, CASE WHEN k = 0 THEN 2.0::DOUBLE ELSE 2.5::DOUBLE END AS amplitude, md.i,
  ux, uy, uz, r FROM md JOIN sc ON sc.target = md.target AND sc.mode = md.mode, (SELECT unnest([0, 1]) AS k), (SELECT unnest([1, -1]) AS sign)),
dp AS (SELECT *, ux * sign * amplitude / r AS dx, uy * sign * amplitude / r AS dy, uz * sign * amplitude / r AS dz FROM mv),
sn AS (SELECT target, 0 AS snapshot, i, x, y, z FROM chain UNION ALL SELECT c.target, snapshot, c.i, round(x + dx, 3), round(y + dy, 3), round(z + dz, 3) FROM chain c JOIN dp ON dp.target = c.target AND dp.i = c.i),
dt AS (SELECT a.target, a.snapshot, a.i AS pocket, b.i, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS d FROM sn a JOIN sn b ON a.target = b.target AND a.snapshot = b.snapshot WHERE a.i % 5 = 0),
pt AS (SELECT * FROM dt WHERE d <= 8),
pl AS (SELECT * FROM (SELECT target, snapshot, pocket, count(*) AS lining, round(4 / 3::DOUBLE * 3.141592653589793::DOUBLE * pow(avg(d), 3), 6) AS volume FROM pt GROUP BY ALL) WHERE lining BETWEEN 4 AND 60 AND volume BETWEEN 30 AND 2500),
ev AS (SELECT DISTINCT target, snapshot, mode, sign, amplitude FROM dp),
ob AS (SELECT pt.target, mode, sign, amplitude, pt.pocket, list(pt.i) AS m FROM pt JOIN pl ON pl.target = pt.target AND pl.snapshot = pt.snapshot AND pl.pocket = pt.pocket JOIN ev ON ev.target = pt.target AND ev.snapshot = pt.snapshot GROUP BY ALL),
jc AS (SELECT a.target, a.mode, a.sign, a.pocket AS scout, b.pocket AS refinement, len(list_intersect(a.m, b.m)) AS k, len(a.m) + len(b.m) AS n FROM ob a JOIN ob b ON a.target = b.target AND a.mode = b.mode AND a.sign = b.sign WHERE a.amplitude = 2 AND b.amplitude = 2.5),
st AS (SELECT * EXCLUDE (q) FROM (SELECT target, mode, sign, scout, refinement, round(k / (n - k)::DOUBLE, 12) AS jaccard, row_number() OVER (PARTITION BY target, mode, sign, scout ORDER BY round(k / (n - k)::DOUBLE, 12) DESC, refinement) AS q FROM jc) WHERE q = 1 AND jaccard >= 0.5),
fm AS (SELECT target, scout, count(*) AS seen, count(*) / 4::DOUBLE AS persistence FROM st GROUP BY ALL)"""
_REGIONS = """,
rg AS (SELECT target, pocket, avg(m) AS region FROM (SELECT target, src, pocket, avg(c) AS m FROM (
  SELECT v.target, v.src, p.pocket, v.c, row_number() OVER (PARTITION BY v.target, v.src, p.pocket ORDER BY v.c DESC, v.i) AS k FROM vals v JOIN pt p ON p.target = v.target AND p.i = v.i WHERE p.snapshot = 0)
  WHERE k <= 5 GROUP BY ALL) GROUP BY ALL)"""
_NEAREST = """,
kn AS (SELECT target, i, rank::INT AS rank, j FROM (SELECT *, row_number() OVER (PARTITION BY target, i ORDER BY d, j) AS rank FROM (SELECT target, i, j, round(d, 9) AS d FROM dist UNION ALL SELECT target, i, i, -1 FROM chain)) WHERE rank <= 5)"""
_PATCHES = """, po AS (SELECT target, i FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, i) AS k FROM chain) WHERE k <= 5),
ce AS (SELECT c.target, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM chain c JOIN po ON po.target = c.target AND po.i = c.i GROUP BY ALL),
ai AS (SELECT c.target, min(sqrt((c.x-s.x)**2 + (c.y-s.y)**2 + (c.z-s.z)**2)) AS aim FROM ce c JOIN chain s ON s.target = c.target AND s.source GROUP BY ALL),
ow AS (SELECT c.target, c.i, min(sqrt((c.x-s.x)**2 + (c.y-s.y)**2 + (c.z-s.z)**2)) AS own FROM chain c JOIN chain s ON s.target = c.target AND s.source GROUP BY ALL),
pa AS (SELECT kn.target, kn.i, list_sort(list(kn.j)) AS m, count(*) FILTER (c.source) AS s, count(po.i) AS p FROM kn JOIN chain c ON c.target = kn.target AND c.i = kn.j LEFT JOIN po ON po.target = kn.target AND po.i = kn.j JOIN ow ON ow.target = kn.target AND ow.i = kn.i JOIN ai ON ai.target = kn.target WHERE abs(own - aim) <= 4 GROUP BY ALL),
np AS (SELECT DISTINCT target, m FROM pa WHERE s = 0 AND p <= 3)"""
_COIN = ", ar AS (SELECT target, i, j, count(*) OVER (PARTITION BY target, i) AS n FROM edges), w0 AS (SELECT c.target, c.i AS src, ar.i, ar.j, 1 / sqrt(n) AS a FROM chain c JOIN ar ON ar.target = c.target AND ar.i = c.i WHERE c.source)" + "".join(
    f", t{k} AS (SELECT target, src, i, sum(a) AS t FROM w{k} GROUP BY ALL), w{k + 1} AS (SELECT t.target, t.src, ar.j AS i, ar.i AS j, 2 * t / n - coalesce(w.a, 0) AS a FROM t{k} t JOIN ar ON ar.target = t.target AND ar.i = t.i LEFT JOIN w{k} w ON w.target = t.target AND w.src = t.src AND w.i = ar.i AND w.j = ar.j)"
    for k in range(3)
)
_EVAL_OUT = "SELECT pos.target, n, p AS positives, round(p / n::DOUBLE, 9) AS floor, round(ap, 9) AS ap, round(ap / (p / n::DOUBLE), 9) AS lift, round(auroc, 9) AS auroc, hits FROM pos JOIN ap ON ap.target = pos.target JOIN au ON au.target = pos.target JOIN ht ON ht.target = pos.target WHERE p > 0 AND p < n"
_CONTROLS = f"""{_WITH}{_HOPS}, nh AS (SELECT target, i, min(hop) AS hop FROM hops GROUP BY ALL),
bu AS (SELECT c.target, c.i, c.truth, count(d.j) AS burial FROM chain c LEFT JOIN dist d ON d.target = c.target AND d.i = c.i AND d.d > 0 AND d.d <= 10 WHERE NOT c.source GROUP BY ALL),
ct AS (SELECT b.target, b.truth, k AS control, CASE k WHEN 'perfect' THEN truth WHEN 'burial' THEN burial ELSE -hop END AS score FROM bu b JOIN nh ON nh.target = b.target AND nh.i = b.i, (SELECT unnest(['perfect', 'burial', 'distance']) AS k)),
cp AS (SELECT target, control, count(*) AS n, sum(truth) AS p FROM ct GROUP BY ALL), cs AS (SELECT target, control, score, sum(truth) AS tp, count(*) AS n FROM ct GROUP BY ALL),
cc AS (SELECT target, control, tp, sum(tp) OVER w AS a, sum(n) OVER w AS b FROM cs WINDOW w AS (PARTITION BY target, control ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ca AS (SELECT cc.target, cc.control, p / n::DOUBLE AS floor, sum(tp::DOUBLE / p * a / b) AS ap FROM cc JOIN cp ON cp.target = cc.target AND cp.control = cc.control WHERE p > 0 AND p < n GROUP BY ALL)
SELECT target, control, round(ap, 9) AS ap, round(ap / floor, 9) AS lift FROM ca"""

ORACLES = {
    "enm_displacements": f"{_WITH}{_FIELDS} SELECT target, snapshot, mode, sign, amplitude, i, round(dx, 6) AS dx, round(dy, 6) AS dy, round(dz, 6) AS dz FROM dp",
    "snapshot_coords": f"{_WITH}{_FIELDS} SELECT * FROM sn",
    "detect_patches": f"{_WITH}{_FIELDS} SELECT target, snapshot, pocket, i, round(d, 6) AS d FROM pt",
    "plausible_cavities": f"{_WITH}{_FIELDS} SELECT * FROM pl",
    "stable_observations": f"{_WITH}{_FIELDS} SELECT * FROM st",
    "family_stats": f"{_WITH}{_FIELDS} SELECT * FROM fm",
    "recurrence_p": f"{_WITH}{_FIELDS} SELECT a.target, a.scout, round((1 + count(*) FILTER (b.seen >= a.seen)) / (1 + count(*))::DOUBLE, 9) AS p FROM fm a JOIN fm b ON a.target = b.target GROUP BY ALL",
    "knn_patch": f"{_WITH}{_NEAREST} SELECT * FROM kn",
    "null_patches": f"{_WITH}{_NEAREST}{_PATCHES} SELECT target, array_to_string(m, ',') AS members FROM np",
    "null_pvalue": f"{_WITH}{_VALUES}{_FIELDS}{_REGIONS}{_NEAREST}{_PATCHES}, ni AS (SELECT target, m, unnest(m) AS i FROM np), nk AS (SELECT v.target, v.src, ni.m, v.c, row_number() OVER (PARTITION BY v.target, v.src, ni.m ORDER BY v.c DESC, v.i) AS k FROM vals v JOIN ni ON ni.target = v.target AND ni.i = v.i), nr AS (SELECT target, m, avg(a) AS region FROM (SELECT target, src, m, avg(c) AS a FROM nk WHERE k <= 5 GROUP BY ALL) GROUP BY ALL) SELECT rg.target, rg.pocket, round((1 + count(*) FILTER (round(nr.region, 12) >= round(rg.region, 12))) / (1 + count(*))::DOUBLE, 9) AS p FROM rg JOIN nr ON nr.target = rg.target GROUP BY ALL",
    "region_scores": f"{_WITH}{_VALUES}{_FIELDS}{_REGIONS} SELECT target, pocket, round(region, 9) AS region FROM rg",
    "rank_cavities": f"{_WITH}{_VALUES}{_FIELDS}{_REGIONS}, se AS (SELECT rg.target, pocket, round(region + persistence / (1 + count(*) OVER (PARTITION BY rg.target)), 12) AS selection, persistence FROM rg JOIN fm ON fm.target = rg.target AND fm.scout = rg.pocket) SELECT target, (row_number() OVER (PARTITION BY target ORDER BY selection DESC, persistence DESC, pocket))::INT AS rank, pocket, round(selection, 9) AS selection, persistence FROM se",
    "rwr_exact": f"{_CLIQUES} SELECT a.target, a.i, b.i AS j, round((1 - 0.15::DOUBLE / (1 + 0.85::DOUBLE / (a.n - 1))) / a.n, 9) AS p FROM n a JOIN n b ON a.target = b.target AND a.i < b.i",
    "merged_families": f"{_WITH}{_FIELDS}, ct AS (SELECT pt.target, pt.snapshot, pt.pocket, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM pt JOIN sn ON sn.target = pt.target AND sn.snapshot = pt.snapshot AND sn.i = pt.i GROUP BY ALL) SELECT st.target, st.scout AS pocket, count(*) AS observations, count(*) / 4::DOUBLE AS persistence, max(volume) AS volume, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM st JOIN ev ON ev.target = st.target AND ev.mode = st.mode AND ev.sign = st.sign AND ev.amplitude = 2.0 JOIN pl ON pl.target = st.target AND pl.snapshot = ev.snapshot AND pl.pocket = st.scout JOIN ct ON ct.target = st.target AND ct.snapshot = ev.snapshot AND ct.pocket = st.scout GROUP BY ALL",
    "contact_labels": f"""{_WITH}, f0 AS (SELECT label AS target, vec_id, embedding[4]::DOUBLE AS a, embedding[5]::DOUBLE AS b, embedding[6]::DOUBLE AS c FROM embeddings), f1 AS (SELECT *, sqrt(a*a + b*b + c*c) AS r FROM f0),
lg AS (SELECT target, round(sum(3.8::DOUBLE * a / r) OVER u, 3) AS x, round(sum(3.8::DOUBLE * b / r) OVER u, 3) AS y, round(sum(3.8::DOUBLE * c / r) OVER u, 3) AS z FROM f1 WINDOW u AS (PARTITION BY target ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
dl AS (SELECT c.target, c.i, sqrt((c.x-l.x)*(c.x-l.x) + (c.y-l.y)*(c.y-l.y) + (c.z-l.z)*(c.z-l.z)) AS d FROM chain c JOIN lg l ON l.target = c.target)
SELECT target, i, round(min(d), 6) AS least FROM dl WHERE d > 0 AND d <= 4.5 GROUP BY ALL""",
    "components": f"{_WITH}, cl AS (SELECT target, i, j FROM dist WHERE d <= 6.5 AND abs(i - j) > 1), rc AS (SELECT target, i, i AS j FROM chain UNION SELECT r.target, r.i, c.j FROM rc r JOIN cl c ON c.target = r.target AND c.i = r.j) SELECT target, i, min(j) AS component FROM rc GROUP BY ALL",
    "coined_walk_k": f"{_WITH}{_COIN} SELECT target, src, i, round(sum(a * a) / 3, 6) + 0.0 AS p FROM (SELECT * FROM w1 UNION ALL SELECT * FROM w2 UNION ALL SELECT * FROM w3) WHERE i <> src GROUP BY ALL",
    "subset_marginals": f"{_WITH}{_SUBSETS} SELECT target, i, round(v, 9) AS marginal FROM marg",
    "pair_weight_sweep": " UNION ALL ".join(f"SELECT target, {w}::DOUBLE AS weight, members, energy FROM ({_WITH}{_SUBSETS.replace('0.1::DOUBLE', f'{w}::DOUBLE')} SELECT target, array_to_string(m, ',') AS members, round(e, 9) AS energy FROM best)" for w in WEIGHTS),
    "evaluate_scoped": f"{_WITH}{_EVAL.replace('FROM chain', 'FROM chain WHERE NOT source')} {_EVAL_OUT}",
    "control_lifts": _CONTROLS,
    "top_five_string": f"{_WITH}{_SUBSETS} SELECT target, string_agg(residue_id, ' | ' ORDER BY k) AS top_five FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, i) AS k FROM scored) WHERE k <= 5 GROUP BY target",
}
ORACLES["combined_p"] = f"""SELECT target, pocket, round(c, 9) AS combined_p, round(CASE WHEN explained >= 0.8 THEN c ELSE p END, 9) AS ranking_p FROM (
  SELECT n.target, n.pocket, n.p, e.explained, least(1, n.p * r.p * (1 - ln(n.p * r.p))) AS c FROM ({ORACLES["null_pvalue"]}) n JOIN ({ORACLES["recurrence_p"]}) r ON r.target = n.target AND r.scout = n.pocket JOIN ({_PLAIN["hop_explained_variance"]}) e ON e.target = n.target)"""
QUERIES = {
    f.__name__: f
    for f in (
        enm_displacements, snapshot_coords, detect_patches, plausible_cavities, stable_observations, family_stats, recurrence_p, knn_patch, null_patches, contact_labels,
        components, coined_walk_k, subset_marginals, pair_weight_sweep, evaluate_scoped, control_lifts, top_five_string,
        region_scores, rank_cavities, null_pvalue, leader_families, rwr_exact, anm_modes, combined_p, merged_families,
    )
}
