"""Near-duplicate documents by an inverted join of signature coordinates.

A document's set holds the hashes of its distinct word shingles. Documents with one set form a class, named by a 64-bit
hash of the set. A class has a signature of HASHES MinHash values; a coordinate reads three of them together (COORDS
coordinates, so that unrelated texts, which share a few per cent of their shingles, hardly ever share a value), and the
class is posted under each (coordinate, value). Values that no other class has are skipped at once, and so are classes
with fewer than MATCH shared values. Pairs with at least MATCH equal coordinates meet at least LEAST times in what is
left of a class's postings without its MATCH - LEAST most common ones (prefix), so only these are kept.

In each posting list every class meets the list's most central class (that whose values are most common); pairs above
the match threshold on whole signatures (SAME of HASHES values) are confirmed on full sets and joined to components. Lists
within one component are done (skip). What the others leave open has an exact way, which never lists the pairs of a
group: classes of different components in the lists of one component's leaders are told by their differences from its
most central class, the hub. For a hub of n shingles and a class that lacks m of them and has x others, let
W = 100 m + percent x: the class is linked with the hub if W <= (100 - percent) n, and two classes are linked only if
their differences have at least (W + W' - (100 - percent) n) / (100 + percent) elements in common. Unless both are linked
with the hub, this is more than W' / (100 + percent) for one W'; so the two share one of the rarest differences of each
(prefix), of which so many must be left that they can have enough in common; copies with edits of their own meet no one. Classes far from the hub (a distance over one half; as distances
of linked classes from it differ by 1 - percent / 100 at most, those around one half are settled in both ways) meet by
the rarest of their own shingles instead. Those that meet go through the match threshold and full sets as well. No list is cut, and
every link between different texts that can change a component is confirmed on full sets. A pair at a similarity of 0.8
has fewer than MATCH equal coordinates with a chance of 9e-8, fewer than SAME equal values with a chance of 2e-8.

Defined cases: null, empty and blank texts have no set and are linked with nothing; a text with fewer words than a
shingle is one shingle; rows of one id are one document: if their texts differ, these count as linked; rows of one id
are kept or dropped together; null ids are linked with nothing and kept; other columns pass through under their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from residua.llm.common import arrow_schema, batch, blobs, free, hashes, lists, mixed, run_hashes, sliced, words, written
from residua.llm.components import components

HASHES, SAME = 64, 32
COORDS, MATCH, LEAST = 42, 3, 2
#: Ids that may be broadcast: 8 MB of them; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_rng = np.random.default_rng(20240229)
_XOR, _MUL = _rng.integers(0, 1 << 63, HASHES, np.uint64), _rng.integers(0, 1 << 63, HASHES, np.uint64) | np.uint64(1)
#: Each value is in as many coordinates as any other, but for one left over in each half.
_TRIPLES = np.concatenate([_rng.permutation(HASHES)[: 3 * (COORDS // 2)].reshape(-1, 3) for _ in range(2)]).tolist()
SETS = "id bigint, n int, class bigint, sig array<int>"
FULL = "class bigint, n int, members binary"


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of each text's distinct shingles, one text after the other, and offsets."""
    codes, offsets, distinct = words(pc.ascii_lower(pc.fill_null(texts, "")))
    h = hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    runs = run_hashes(h, width)
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(runs[a : b - width + 1]))
        elif b > a:  # the whole sequence
            short = np.uint64(b - a)
            for x in h[a:b]:
                short = mixed(np.array([short ^ x], np.uint64))[0]
            out.append(np.array([short]))
        else:
            out.append(np.zeros(0, np.uint64))
    return np.concatenate([np.zeros(0, np.uint64), *out]), np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)


def _pack(u: np.ndarray) -> np.ndarray:
    """The low 48 bits, as rows of 6 bytes, kept in order."""
    return np.ascontiguousarray((u & np.uint64((1 << 48) - 1)).view(np.uint8).reshape(-1, 8)[:, :6])


def _unpack(b) -> np.ndarray:
    raw = np.frombuffer(b, np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :6] = raw
    return wide.view(np.uint64).ravel()


def _classes(u: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    out, full = np.zeros(len(offsets) - 1, np.uint64), np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = mixed(np.add.reduceat(mixed(u ^ _XOR[0]), offsets[:-1][full]))
    return out.view(np.int64)


def signatures(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    schema = arrow_schema(SETS)

    def rows(b: pa.RecordBatch) -> pa.RecordBatch:
        u, offsets = shingles(b.column(1), width)
        n = np.diff(offsets)
        full = np.flatnonzero(n)
        starts = offsets[:-1][full]
        sig = np.zeros((len(full), HASHES), np.int32)
        if len(full):
            for k in range(HASHES):
                sig[:, k] = (np.minimum.reduceat((u ^ _XOR[k]) * _MUL[k], starts) >> np.uint64(32)).astype(np.uint32).view(np.int32)
        ends = np.concatenate([[0], np.cumsum(np.where(n > 0, HASHES, 0))])
        return batch(schema, b.column(0), n.astype(np.int32), _classes(u, offsets), lists(sig.ravel(), ends))

    picked = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return picked.mapInArrow(sliced(rows), SETS)


def full_sets(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    schema = arrow_schema(FULL)

    def rows(b: pa.RecordBatch) -> pa.RecordBatch:
        u, offsets = shingles(b.column(1), width)
        packed = np.concatenate([np.zeros(0, np.uint64), *(np.sort(u[i:j] & np.uint64((1 << 48) - 1)) for i, j in zip(offsets[:-1], offsets[1:], strict=True))])
        return batch(schema, _classes(u, offsets), np.diff(offsets).astype(np.int32), blobs(_pack(packed).view("V6").ravel(), offsets))

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(sliced(rows), FULL)


def among(df: DataFrame, ids: DataFrame, count: int, on: str) -> DataFrame:
    """Rows of df whose `on` is in ids (distinct): by broadcast where ids are few enough, else by a shuffle."""
    return df.join(F.broadcast(ids) if count <= BROADCAST_IDS else ids, on, "left_semi")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes with 100 * intersection >= percent * union, on full sets."""

    @F.arrow_udf(T.IntegerType())
    def shared(x: pa.Array, y: pa.Array) -> pa.Array:
        both = ((_unpack(p.as_buffer()), _unpack(q.as_buffer())) for p, q in zip(x, y, strict=True))
        return pa.array([len(np.intersect1d(p, q, assume_unique=True)) for p, q in both], pa.int32())

    one = sets.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("members").alias("ma"))
    two = sets.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("members").alias("mb"))
    rows = pairs.join(one, "a").join(two, "b").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    rows = rows.select("a", "b", "na", "nb", shared("ma", "mb").alias("both"))
    return rows.filter(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def _matches(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, v: s + v)


def _cells(n: str, percent: int) -> list[Column]:
    """The two neighbouring cells of a set's size; sizes that allow the similarity share at least one."""
    at = F.floor(F.log(F.col(n)) / (math.log(100 / percent) * (1 + 1e-9)) if percent < 100 else F.col(n))
    return [at, at + 1]


def _meeting(spots: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) with hubs, and candidate pairs (a, b) of classes of different roots whose differences from one hub have
    enough in common. spots: (hub, class, root)."""

    least, most = 0.5 - (100 - percent) / 200, 0.5 + (100 - percent) / 200

    @F.arrow_udf("struct<lost: int, extra: int, near: array<bigint>, far: array<bigint>>")
    def differences(x: pa.Array, y: pa.Array) -> pa.Array:
        lost, extra, near, far, given = [], [], [], [], [[], []]
        for p, q in zip(x, y, strict=True):
            p, q = _unpack(p.as_buffer()), _unpack(q.as_buffer())
            gone, new = np.setdiff1d(p, q, assume_unique=True), np.setdiff1d(q, p, assume_unique=True)
            lost.append(len(gone))
            extra.append(len(new))
            away = (len(gone) + len(new)) / (len(p) + len(new))
            given[0].append(away <= most)
            given[1].append(away >= least)
            near.append(np.concatenate([gone, new | np.uint64(1 << 48)]) if away <= most else gone[:0])
            far.append(q if away >= least else gone[:0])
        told = []
        for rows, there in zip((near, far), given, strict=True):
            ends = np.concatenate([[0], np.cumsum([len(d) for d in rows])]).astype(np.int32)
            values = np.concatenate([np.zeros(0, np.uint64), *rows]).view(np.int64)
            told.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(values), mask=pa.array(~np.array(there, bool))))
        return pa.StructArray.from_arrays([pa.array(lost, pa.int32()), pa.array(extra, pa.int32()), *told], ["lost", "extra", "near", "far"])

    hub = sets.select(F.col("class").alias("hub"), F.col("n").alias("np"), F.col("members").alias("mp"))
    told = spots.join(sets, "class").join(hub, "hub").select("hub", "class", "root", "n", "np", differences("mp", "members").alias("d"))
    weight = 100 * F.col("d.lost") + percent * F.col("d.extra")
    spare = (100 - percent) * F.col("np")
    size = F.size("d.near")
    short = size - F.floor(weight / (100 + percent))
    long = F.when(weight > spare, size - F.greatest(F.lit(1), F.ceil((weight - spare) / (100 + percent))) + 1).otherwise(short)
    whole = F.col("n") - F.ceil(percent * F.col("n") / 100 - F.lit(1e-9)) + 1
    way = lambda far, out, w, spare, size, short, long, e: F.struct(F.lit(far).alias("far"), out.alias("out"), w.cast("long").alias("w"), spare.cast("long").alias("spare"), size.alias("size"), short.cast("int").alias("short"), long.cast("int").alias("long"), e.alias("diff"))
    ways = F.array(way(False, weight > spare, weight, spare, size, short, long, F.col("d.near")), way(True, F.lit(True), percent * F.col("n"), F.lit(0), F.col("n"), whole, whole, F.col("d.far")))
    told = told.select("hub", "class", "root", F.explode(ways).alias("w")).select("hub", "class", "root", "w.*").filter("diff is not null")
    told = written(told, "differences")
    each = told.select(F.xxhash64("hub", "far").alias("group"), "class", "root", "out", "w", "spare", "size", "short", "long", F.explode("diff").alias("e"))
    common = each.groupBy("group", "e").agg(F.count(F.lit(1)).alias("c"), F.min("root").alias("r"), F.max("root").alias("s")).filter("c > 1")
    mine = Window.partitionBy("group", "class")
    rare = each.join(common, ["group", "e"]).withColumn("at", F.row_number().over(mine.orderBy("c", "e")) + F.col("size") - F.count(F.lit(1)).over(mine))
    rare = written(rare.filter("at <= long and r < s").select("group", "e", "class", "root", "out", "w", "spare", (F.col("size") - F.col("at")).alias("rest"), (F.col("at") <= F.col("short")).alias("short")), "rare")
    p, q = rare.alias("p"), rare.alias("q")
    meet = (
        (F.col("p.group") == F.col("q.group"))
        & (F.col("p.e") == F.col("q.e"))
        & (F.col("p.root") != F.col("q.root"))
        & (F.col("p.class") < F.col("q.class"))
        & (F.col("p.w") + F.col("q.w") - F.col("p.spare") <= (100 + percent) * (1 + F.least("p.rest", "q.rest")))
        & (F.col("p.out") | F.col("q.out"))
        & (F.col("p.short") & F.col("q.short") | F.col("p.short") & ~F.col("p.out") & F.col("q.out") | F.col("q.short") & ~F.col("q.out") & F.col("p.out"))
    )
    sure = told.filter("not far and not out and class <> hub").select(F.col("class").alias("a"), F.col("hub").alias("b"))
    return sure, p.join(q, meet).select(F.col("p.class").alias("a"), F.col("q.class").alias("b")).distinct()


def _posted(classes: DataFrame) -> DataFrame:
    """(token, class, n, central) of the postings that the prefix keeps; central: how common all values of the class are."""
    values = [F.xxhash64(F.lit(k), *(F.col("sig")[i] for i in at)) for k, at in enumerate(_TRIPLES)]
    posted = classes.select("class", "n", F.explode(F.array(*values)).alias("token"))
    counts = posted.groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    mine = Window.partitionBy("class")
    met = posted.join(counts, "token").withColumn("order", F.row_number().over(mine.orderBy(F.desc("c"), F.desc("token"))))
    met = met.withColumn("central", F.sum("c").over(mine)).withColumn("shared", F.count(F.lit(1)).over(mine))
    return met.filter((F.col("shared") >= MATCH) & (F.col("order") > MATCH - LEAST)).select("token", "class", "n", "central")


def components_of(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(id, n, component): a row per row of docs; component is the smallest id reachable."""
    sets = written(signatures(docs, key, text, width), "signatures")
    some = sets.filter("n > 0 and id is not null").select("id", "n", "class")
    # rows of one id
    repeated = written(some.groupBy("id").agg(F.count(F.lit(1)).alias("c"), F.min("class").alias("b")).filter("c > 1"), "repeated")
    repeats = repeated.count()
    same = some.join(repeated.select("id", "b"), "id").filter("class <> b").select(F.col("class").alias("a"), "b").distinct()
    firsts = written(some.groupBy("class").agg(F.min("id").alias("first")), "firsts")
    classes = written(sets.filter("n > 0 and id is not null").select("class", "n", "sig").dropDuplicates(["class"]), "classes")
    prefix = written(_posted(classes), "postings")
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))

    lists_ = prefix.groupBy("token").agg(F.max(F.struct("central", "class")).alias("top"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    met = written(prefix.join(lists_.select("token", F.col("top.class").alias("leader")), "token").select("token", "class", "n", "leader"), "met")
    ids = written(met.select("class").distinct().join(firsts, "class").select(F.col("first").alias("id")).distinct(), "ids")
    full = full_sets(among(texts, ids, ids.count(), "id"), "id", "text", width)
    full = written(full.dropDuplicates(["class"]) if repeats else full, "sets")

    def linked(pairs: DataFrame) -> DataFrame:
        """The links among candidate pairs (a, b): above the match threshold of signatures, and on full sets."""
        pairs = written(pairs, "candidates")
        wanted = written(pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct(), "ids")
        sig = among(classes.select("class", "sig"), wanted, wanted.count(), "class")
        both = pairs.join(sig.select(F.col("class").alias("a"), F.col("sig").alias("x")), "a").join(sig.select(F.col("class").alias("b"), F.col("sig").alias("y")), "b")
        return written(confirmed(both.filter(_matches(F.col("x"), F.col("y")) >= SAME).select("a", "b"), full, percent), "links")

    links = linked(met.filter("class <> leader").select(F.col("class").alias("a"), F.col("leader").alias("b")).distinct()).union(same)
    root = written(components(links), "roots")

    # lists that hold, beside their leader, classes of several components and of about one size
    rooted = met.filter("class <> leader").join(root.withColumnRenamed("id", "class"), "class", "left")
    rooted = rooted.select("token", "class", "leader", F.coalesce("root", "class").alias("root"), F.explode(F.array(*_cells("n", percent))).alias("cell"))
    several = rooted.groupBy("token", "cell").agg(F.min("root").alias("r"), F.max("root").alias("s")).filter("r < s").select("token", "cell")
    central = prefix.select("class", "central").distinct().join(root.withColumnRenamed("id", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    hubs = central.groupBy("root").agg(F.max(F.struct("central", "class")).alias("top")).select("root", F.col("top.class").alias("hub"))
    hubs = central.select(F.col("class").alias("leader"), "root").join(hubs, "root").select("leader", "hub")
    spots = rooted.join(several, ["token", "cell"], "left_semi").select("leader", "class", "root").distinct()
    spots = written(spots.join(hubs, "leader").select("hub", "class", "root").distinct(), "open")
    sure, pairs = _meeting(spots, full, percent)
    more = sure.union(linked(pairs))
    root = written(components(root.select(F.col("id").alias("a"), F.col("root").alias("b")).union(more)), "roots")

    named = firsts.join(root.withColumnRenamed("id", "class"), "class", "left").select("class", "first", F.coalesce("root", "class").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    named = named.join(least, "root").select("class", "component")
    return sets.drop("sig").join(named, "class", "left").select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component"))


def kept(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """docs without all but the smallest id of each component."""
    found = components_of(docs, key=key, text=text, width=width, percent=percent)
    (gone,) = free(docs, "gone")
    return docs.join(found.filter("id <> component").select(F.col("id").alias(gone)).distinct(), F.col(key) == F.col(gone), "left_anti")
