"""A Merkle manifest of a dataset: a content-addressed DAG, and inclusion proofs by descending it.

Each row is a leaf; the leaves of a group (a source) ascend by id and every FANOUT consecutive nodes become the digest of
their digests, until one is left, the group's subroot; the subroots, in order of their groups, become the root in the
same way. What is kept is a store of records, a digest and its children, one table a height. A request names a leaf by its
group and its rank; its digits in base FANOUT are its path. Requests go down from the root together, one join with the
records of a height at a time: those that share a node are one row until they part, and each takes the child that its
digit selects and collects the others. The segments that they have at the leaves, from the root down, reversed, are the
proofs. Everything is DataFrame functions; no join is on a group alone, so a group with a third of all rows spreads as
the others do.

Defined cases: a null value is told from any other; a null group comes first; null ids come first in their group; rows of
one id in one group ascend by their digests, and rows that are equal throughout are leaves side by side with one digest;
a lone leaf is its group's subroot and a lone subroot is the root, with no segments of proof; an empty table has no rows,
no records and no root; texts of any length are hashed whole; other columns take no part.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from residua.llm.common import written

#: Children of a node; a digit of a path has DIGIT bits.
DIGIT = 4
FANOUT = 1 << DIGIT
#: Bytes of a digest.
WIDE = 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_SEGMENTS = "array<struct<left: binary, right: binary>>"


def digest_of(data: Column) -> Column:
    """The sha256 of a string or binary, as binary."""
    return F.unhex(F.sha2(data, 256))


def hexed(data: Column) -> Column:
    return F.lower(F.hex(data))


def leaf(*values: Column) -> Column:
    """The digest of a row: each value as `-` if null, else the number of its UTF-8 bytes, `:`, and itself."""
    text = [v.cast("string") for v in values]
    return digest_of(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]))


@dataclass
class Manifest:
    """leaves: group (number), rank, n (leaves of the group), digest, source, id and what was carried; groups: group, source,
    height and subroot; lower and upper: records (group, at, digest, children) of the groups' trees and of the tree over
    the subroots, by height from 1 on; roots: the root's one row."""

    leaves: DataFrame
    groups: DataFrame
    roots: DataFrame
    lower: list[DataFrame] = field(default_factory=list)
    upper: list[DataFrame] = field(default_factory=list)

    def store(self) -> DataFrame:
        """(digest, children) of every node, each digest once: children is their digests one after the other."""
        levels = [level.select("digest", "children") for level in (*self.lower, *self.upper)]
        if not levels:
            return self.leaves.select("digest", F.col("digest").alias("children")).limit(0)
        return reduce(DataFrame.union, levels).dropDuplicates(["digest"])


def _placed(rows: DataFrame, group: list[str], order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """rows in order, as a table with their partition and place there; and the runs of a group in a partition: its first
    place, what the group has in partitions before, and in all."""
    keys = [*group, *order]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    rows = written(rows, name).withColumn("_part", F.shiftright("_at", 33)).withColumn("_place", F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at")
    runs = rows.groupBy("_part", *group).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_count"))
    whole = Window.partitionBy(*(group or [F.lit(0)]))  # a group has a run a partition, not a row
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return rows, runs.select("_part", *group, "_first", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_before"), F.sum("_count").over(whole).alias("n"))


def _rank() -> Column:
    return (F.col("_place") - F.col("_first") + F.col("_before")).alias("rank")


def _tree(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Records by height over nodes (group, at, n, digest), and each group's last node (group, height, digest)."""
    size = nodes.agg(F.max("n")).first()[0] or 0
    levels, tops = [], [nodes.filter("n = 1").select("group", F.lit(0).alias("height"), "digest")]
    while size > 1:
        up = nodes.filter("n > 1").groupBy("group", F.shiftright("at", DIGIT).alias("at"), F.ceil(F.col("n") / FANOUT).alias("n"))
        run = F.array_sort(F.collect_list(F.struct("at", "digest")))
        up = up.agg(F.array_join(F.transform(run, lambda x: hexed(x["digest"])), "").alias("text"))
        nodes = written(up.select("group", "at", "n", digest_of(F.col("text")).alias("digest"), F.unhex("text").alias("children")), f"{name}-{len(levels) + 1}")
        levels.append(nodes)
        tops.append(nodes.filter("n = 1").select("group", F.lit(len(levels)).alias("height"), "digest"))
        size = -(-size // FANOUT)
    return levels, reduce(DataFrame.union, tops)


def build(docs: DataFrame, *, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = FIELDS, carry: dict[str, Column] | None = None) -> Manifest:
    """The manifest of docs. carry: further columns of the leaves by name."""
    rows = docs.select(F.col(group).alias("source"), F.col(key).alias("id"), leaf(*[F.col(c) for c in fields]).alias("digest"), *[c.alias(n) for n, c in (carry or {}).items()])
    rows, runs = _placed(written(rows, "merkle-leaves"), ["source"], ["id", "digest"], "merkle-ranked")
    groups, parts = _placed(runs.select("source", "n").distinct(), [], ["source"], "merkle-groups")
    groups = groups.join(parts.withColumnRenamed("n", "groups"), "_part").select(F.col("source"), "n", "groups", _rank().alias("group"))
    groups = written(groups, "merkle-sources")
    runs = runs.drop("n").join(groups.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).select("_part", "_source", "_first", "_before", "group", "n")
    rows = rows.withColumnRenamed("_part", "_of").join(runs, (F.col("_of") == F.col("_part")) & F.col("source").eqNullSafe(F.col("_source")))
    leaves = written(rows.select("group", _rank(), "n", "digest", "source", "id", *(carry or {})), "merkle-places")
    lower, subroots = _tree(leaves.select("group", F.col("rank").alias("at"), "n", "digest"), "merkle-lower")
    subroots = written(subroots.join(groups.drop("n"), "group"), "merkle-subroots")
    upper, roots = _tree(subroots.select(F.lit(0).alias("group"), F.col("group").alias("at"), F.col("groups").alias("n"), "digest"), "merkle-upper")
    return Manifest(leaves, subroots.drop("groups"), roots, lower, upper)


def _opened(front: DataFrame, below: DataFrame, more: list[str]) -> DataFrame:
    """The nodes below (group, at and more) under the front's (group, at, children, segments and what they carry): each
    gets the child that its last digit selects and, as one more segment, the children beside it."""
    names = [c for c in front.columns if c not in ("group", "at", "children", "segments", "digest")]
    front = front.withColumnsRenamed({"group": "_group", "at": "_at"})
    met = below.join(front, (F.col("group") == F.col("_group")) & (F.shiftright("at", DIGIT) == F.col("_at")))
    digit = (F.col("at").bitwiseAND(FANOUT - 1) * WIDE).cast("int")
    child, whole = F.col("children"), F.octet_length("children")
    beside = F.struct(F.substring(child, F.lit(1), digit).alias("left"), F.substring(child, digit + WIDE + 1, whole).alias("right"))
    inner = child.isNotNull()  # a group of one leaf has no record
    return met.select("group", "at", F.when(inner, F.substring(child, digit + 1, F.lit(WIDE))).otherwise(F.col("digest")).alias("digest"), F.when(inner, F.array_append("segments", beside)).otherwise(F.col("segments")).alias("segments"), *names, *more)


def _descended(tops: DataFrame, levels: list[DataFrame], requests: DataFrame, name: str) -> DataFrame:
    """The nodes just above the requested leaves (group, at), with their children, from each group's top (group, height,
    digest, segments and what they carry)."""
    wanted = [written(requests.select("group", F.shiftright("at", DIGIT).alias("at")).distinct(), name)]
    for _ in levels[1:]:
        wanted.append(wanted[-1].select("group", F.shiftright("at", DIGIT).alias("at")).distinct())
    rest = [c for c in tops.columns if c != "height"]
    start = tops.withColumn("at", F.lit(0).cast("long"))
    front = None
    for height in range(len(levels), 0, -1):
        here = start.filter(F.col("height") == height).select("at", *rest)
        front = here if front is None else front.select("at", *rest).union(here)
        records = levels[height - 1].groupBy("digest").agg(F.first("children").alias("children"))
        front = front.join(records, "digest")
        if height > 1:
            front = _opened(front, wanted[height - 2], [])
    alone = start.filter("height = 0").select("at", *rest).withColumn("children", F.lit(None).cast("binary"))
    return alone if front is None else front.select(alone.columns).union(alone)


def proofs(manifest: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """(source, id, leaf, segments, subroot, root and what was carried) of requested leaves, rows of manifest.leaves (null:
    all of them). segments: the digests left and right of the path, from the leaf up."""
    asked = manifest.leaves if requests is None else requests
    asked = asked.drop("digest").withColumnRenamed("rank", "at")
    of_groups = asked.select(F.lit(0).alias("group"), F.col("group").alias("at")).distinct()
    tops = manifest.roots.withColumn("root", F.col("digest")).withColumn("segments", F.array().cast(_SEGMENTS))
    sources = manifest.groups.select(F.lit(0).alias("group"), F.col("group").alias("at"), "height")
    sources = _opened(_descended(tops, manifest.upper, of_groups, "merkle-asked"), sources, ["height"])
    sources = sources.select(F.col("at").alias("group"), "height", "digest", "segments", "root", F.col("digest").alias("subroot"))
    front = _descended(written(sources, "merkle-tops"), manifest.lower, asked, "merkle-wanted")
    more = [c for c in asked.columns if c not in ("group", "at", "n")]
    found = _opened(front, asked, more)
    return found.select(*more, F.col("digest").alias("leaf"), F.reverse("segments").alias("segments"), "subroot", "root")


def proof_digest(segments: Column) -> Column:
    """The digest of a proof: of the siblings' digests in hex, level by level."""
    return digest_of(F.array_join(F.transform(segments, lambda s: hexed(F.concat(s["left"], s["right"]))), ""))


def folded(digest: Column, segments: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(segments, digest, lambda node, s: digest_of(hexed(F.concat(s["left"], node, s["right"]))))
