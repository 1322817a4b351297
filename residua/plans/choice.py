"""Queries on the choice of a pocket, from walks to the mechanical stage, with the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from residua.operators import cavity, choice, eligibility, fields, graph, response, sourced
from residua.plans.catalog import ORACLES as _PLAIN
from residua.plans.catalog import _WITH
from residua.plans.dynamics import _RESPONSE, _WALK, _graph, _softness, _walk
from residua.plans.dynamics import ORACLES as _MOVING
from residua.plans.ensemble import ORACLES as _STABLE
from residua.plans.ensemble import _modes, _native, _observed
from residua.plans.records import ORACLES as _KEPT


def _ranked(spark, sf_dir):
    """Rows, edges, and the eligible pockets that are seen again, with their regions, ranks and centres."""
    rows, edges = _graph(spark, sf_dir)
    sources = rows.filter("source")
    members = _native(spark, sf_dir)
    valid = eligibility.valid_observations(members, sources, graph.shell(rows, edges))
    fit = eligibility.eligible_pockets(members, valid, graph.sequence_mask(rows, 1).filter("masked"))
    seen = graph.kept(cavity.persistence(_observed(spark, sf_dir), 4).select("target", F.col("scout").alias("pocket"), "persistence"))
    fit = graph.kept(fit.join(seen.select("target", "pocket"), ["target", "pocket"], "left_semi"))
    values = _walk(edges)
    regions = graph.kept(choice.regions(values, sources, edges, fit, sourced.explained(values, sources, edges)))
    centres = graph.kept(fit.join(rows, ["target", "i"]).groupBy("target", "pocket").agg(*[F.round(F.avg(c), 6).alias(c) for c in "xyz"]))
    return rows, edges, fit, regions, graph.kept(cavity.ranked(regions, seen)), centres


def refinement_gate(spark, sf_dir):
    *_, ranked, centres = _ranked(spark, sf_dir)
    return fields.refinement_gate(ranked, centres)


def chosen_pocket(spark, sf_dir):
    rows, edges, fit, regions, ranked, centres = _ranked(spark, sf_dir)
    gate = fields.refinement_gate(ranked, centres)
    out = choice.chosen(ranked, regions, centres, fit, gate, _softness(_modes(spark, sf_dir)), response.springs(rows), rows.filter("source"), edges)
    return out.select("target", "pocket", "refined", "recurrent", F.concat_ws(",", F.transform("nodes", lambda n: n.cast("string"))).alias("nodes"))


_HOP_RANK = "SELECT v.target, v.src, v.i, CASE WHEN hop = 0 THEN 0 ELSE (rank() OVER (PARTITION BY v.target, v.src, hop ORDER BY v.c) + (count(*) OVER (PARTITION BY v.target, v.src, hop, v.c) - 1) / 2.0::DOUBLE)::DOUBLE / count(*) OVER (PARTITION BY v.target, v.src, hop) END AS c FROM {values} v JOIN hh ON hh.target = v.target AND hh.src = v.src AND hh.i = v.i"
_REGION = "SELECT target, pocket, avg(m) AS region FROM (SELECT target, src, pocket, avg(c) AS m FROM (SELECT v.target, v.src, p.pocket, v.c, row_number() OVER (PARTITION BY v.target, v.src, p.pocket ORDER BY v.c DESC, v.i) AS k FROM {values} v JOIN ep p ON p.target = v.target AND p.i = v.i) WHERE k <= 5 GROUP BY ALL) GROUP BY ALL"
_CHOICE = f"""WITH fm AS ({_STABLE["family_stats"]}),
ep AS MATERIALIZED (SELECT target, pocket, unnest(string_split(members, ','))::INT AS i FROM ({_KEPT["eligible_pockets"]}) e WHERE EXISTS (SELECT 1 FROM fm WHERE fm.target = e.target AND fm.scout = e.pocket)),
vs AS MATERIALIZED ({_WITH}{_WALK} SELECT * FROM vals),
hh AS MATERIALIZED ({_PLAIN["hops_from_source"]}),
ex AS MATERIALIZED ({_MOVING["ctqw_explained"]}),
pr AS MATERIALIZED ({_HOP_RANK.format(values="vs")}),
mx AS (SELECT target, 0 AS src, i, round(avg(c), 12) AS c FROM vs GROUP BY ALL),
rg AS MATERIALIZED (SELECT a.* FROM ({_REGION.format(values="pr")}) a JOIN ex ON ex.target = a.target WHERE explained >= 0.8 UNION ALL SELECT a.* FROM ({_REGION.format(values="mx")}) a JOIN ex ON ex.target = a.target WHERE explained < 0.8),
se AS (SELECT rg.target, pocket, persistence, round(region + persistence / (1 + count(*) OVER (PARTITION BY rg.target)), 12) AS selection FROM rg JOIN fm ON fm.target = rg.target AND fm.scout = rg.pocket),
di AS MATERIALIZED (SELECT target, pocket FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY selection DESC, persistence DESC, pocket) AS k FROM se) WHERE k = 1),
ch AS MATERIALIZED ({_PLAIN["residue_id"]}),
ce AS MATERIALIZED (SELECT ep.target, pocket, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM ep JOIN ch ON ch.target = ep.target AND ch.i = ep.i GROUP BY ALL),
hd AS MATERIALIZED (SELECT a.target, a.pocket AS anchor, b.pocket FROM ce a JOIN ce b ON a.target = b.target AND sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) <= 8),
gt AS MATERIALIZED (SELECT di.target, di.pocket, (SELECT count(*) FROM ce WHERE ce.target = di.target) AS candidates, count(*) AS near, count(*) = 1 AND (SELECT count(*) FROM ce WHERE ce.target = di.target) > 1 AS refine FROM di JOIN hd ON hd.target = di.target AND hd.anchor = di.pocket GROUP BY di.target, di.pocket)"""
_CHOSEN = f"""{_CHOICE},
me AS MATERIALIZED (SELECT target, i AS src, j AS i, round(c, 9) AS c FROM ({_WITH}{_RESPONSE} SELECT * FROM re) WHERE target IN (SELECT target FROM gt WHERE refine)),
mr AS MATERIALIZED ({_HOP_RANK.format(values="me")}),
fs AS MATERIALIZED (SELECT rg.target, rg.pocket, round(rg.region, 9) AS transport, round(m.region, 9) AS mechanical FROM rg JOIN ({_REGION.format(values="mr")}) m ON m.target = rg.target AND m.pocket = rg.pocket),
fh AS MATERIALIZED (SELECT hd.*, transport, mechanical FROM hd JOIN fs ON fs.target = hd.target AND fs.pocket = hd.pocket),
fe AS (SELECT target, anchor, list_sort(list(pocket)) AS pockets, max(mechanical) AS mechanical FROM fh GROUP BY ALL),
fl AS (SELECT target, pockets, min(anchor) AS anchor, any_value(mechanical) AS mechanical FROM fe GROUP BY ALL),
fn AS (SELECT target, anchor, avg(s) AS strong FROM (SELECT *, row_number() OVER (PARTITION BY target, anchor ORDER BY s DESC, i) AS k FROM (SELECT fh.target, fh.anchor, ep.i, sum(transport) AS s FROM fh JOIN ep ON ep.target = fh.target AND ep.pocket = fh.pocket GROUP BY ALL)) WHERE k <= 5 GROUP BY ALL),
ff AS (SELECT * FROM (SELECT fl.target, fl.anchor, mechanical, row_number() OVER (PARTITION BY fl.target ORDER BY round(strong / sqrt(len(pockets)), 9) DESC, fl.anchor) AS k FROM fl JOIN fn ON fn.target = fl.target AND fn.anchor = fl.anchor) WHERE k = 1),
fu AS (SELECT g.target, g.pocket, ff.anchor, refine, coalesce(refine AND len(fe.pockets) = 1 AND d.mechanical > 0 AND ff.mechanical >= 0.95::DOUBLE * d.mechanical, false) AS recurrent FROM gt g LEFT JOIN ff ON ff.target = g.target LEFT JOIN fs d ON d.target = g.target AND d.pocket = g.pocket LEFT JOIN fe ON fe.target = g.target AND fe.anchor = g.pocket)
SELECT target, pocket, refine AS refined, recurrent, string_agg(i::VARCHAR, ',' ORDER BY i) AS nodes FROM (
  SELECT DISTINCT fu.target, fu.pocket, refine, recurrent, ep.i FROM fu JOIN hd ON hd.target = fu.target AND hd.anchor = CASE WHEN recurrent THEN fu.anchor ELSE fu.pocket END AND (recurrent OR hd.pocket = fu.pocket) JOIN ep ON ep.target = hd.target AND ep.pocket = hd.pocket) GROUP BY ALL"""

ORACLES = {"refinement_gate": f"{_CHOICE} SELECT * FROM gt", "chosen_pocket": _CHOSEN}
QUERIES = {f.__name__: f for f in (refinement_gate, chosen_pocket)}
