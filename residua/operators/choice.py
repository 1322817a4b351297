"""The choice of a target's pocket: ranking, the gate to the mechanical stage, and the stage itself, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.operators import fields, graph, response, sourced


def regions(values: sourced.Values, sources: DataFrame, edges: DataFrame, members: DataFrame, explained: DataFrame, least: float = 0.8) -> DataFrame:
    """(target, pocket, region): where hops explain at least this share of a target's variance, each source ranks residues
    within its hop shells and a pocket has the mean of what its strongest residues are to each source; elsewhere, the
    strongest of the mean over the sources. values: of sources (target, i); explained: (target, explained)."""
    by_rank = sourced.regions(sourced.hop_ranked(values, edges), sources, members).select("target", "pocket", F.lit(True).alias("dominated"), "region")
    mixed = fields.mixed_regions(sourced.means(values, sources), members).select("target", "pocket", F.lit(False).alias("dominated"), "region")
    which = explained.select("target", (F.round("explained", 9) >= least).alias("dominated"))
    return by_rank.union(mixed).join(which, ["target", "dominated"]).select("target", "pocket", "region")


def mechanical(modes: DataFrame, springs: DataFrame, sources: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """(target, pocket, mechanical): the mean over the sources of a pocket's strongest residues by the response to a
    source's springs, ranked within the source's hop shells."""
    return sourced.regions(sourced.hop_ranked(response.of_sources(modes, springs), edges), sources, members).withColumnRenamed("region", "mechanical")


def chosen(ranked: DataFrame, scores: DataFrame, centres: DataFrame, members: DataFrame, gate: DataFrame, modes: DataFrame, springs: DataFrame, sources: DataFrame, edges: DataFrame) -> DataFrame:
    """(target, pocket, refined, recurrent, nodes): each target's first pocket, or the field of cavities around one centre
    that the mechanical stage puts in its place. Only the modes and springs of targets that pass the gate (target, refine)
    go to that stage; scores: (target, pocket, region)."""
    open_ = graph.kept(gate.filter("refine").select("target", "pocket"))
    only = lambda df: df.join(open_.select("target"), "target", "left_semi")
    response_of = mechanical(only(modes), only(springs), only(sources), only(edges), only(members))
    both = only(scores).join(response_of, ["target", "pocket"]).select("target", "pocket", F.round("region", 9).alias("transport"), F.round("mechanical", 9).alias("mechanical"))
    refined = fields.cavity_field(only(centres), only(members), both, direct=open_)
    plain = ranked.filter("rank = 1").select("target", "pocket").join(open_, "target", "left_anti").join(members, ["target", "pocket"])
    plain = plain.groupBy("target", "pocket").agg(F.sort_array(F.collect_set("i")).alias("nodes"))
    return refined.select("target", "pocket", F.lit(True).alias("refined"), "recurrent", "nodes").union(plain.select("target", "pocket", F.lit(False), F.lit(False), "nodes"))
