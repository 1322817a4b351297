"""Displaced snapshots, pockets that stay through them, and patches to hold a pocket against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from residua.operators.geometry import near_pairs
from residua.operators.graph import kept
from residua.operators.sourced import nearest_distance

POCKET = ["target", "snapshot", "pocket"]


def displacements(modes: DataFrame, amplitudes: tuple[float, ...] = (2.0, 2.5)) -> DataFrame:
    """(target, snapshot, mode, sign, amplitude, i, dx, dy, dz) from modes (target, mode, i, ux, uy, uz), mode from 0: each
    mode scaled to the amplitude's root mean square, both ways. Snapshots count from 1, by amplitude, mode, then sign."""
    every = Window.partitionBy("target", "mode")
    scale = F.sqrt(F.avg(F.col("ux") * F.col("ux") + F.col("uy") * F.col("uy") + F.col("uz") * F.col("uz")).over(every))
    count = F.max("mode").over(Window.partitionBy("target")) + 1
    ways = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(a)).alias("amplitude"), F.lit(s).alias("sign")) for k, a in enumerate(amplitudes) for s in (1, -1))))
    rows = modes.select("*", scale.alias("r"), count.alias("m")).withColumn("w", ways)
    number = 1 + (F.col("w.k") * F.col("m") + F.col("mode")) * 2 + F.when(F.col("w.sign") > 0, 0).otherwise(1)
    moved = [(F.col(f"u{c}") * F.col("w.sign") * F.col("w.amplitude") / F.col("r")).alias(f"d{c}") for c in "xyz"]
    return rows.select("target", number.cast("int").alias("snapshot"), "mode", "w.sign", "w.amplitude", "i", *moved)


def snapshots(residues: DataFrame, moved: DataFrame) -> DataFrame:
    """(target, snapshot, i, x, y, z): the native coordinates as snapshot 0 and all displaced ones, to 3 digits."""
    native = residues.select("target", F.lit(0).alias("snapshot"), "i", "x", "y", "z")
    place = [F.round(F.col(c) + F.col(f"d{c}"), 3).alias(c) for c in "xyz"]
    return native.union(residues.join(moved, ["target", "i"]).select("target", "snapshot", "i", *place))


def snapshot_atoms(atoms: DataFrame, moved: DataFrame) -> DataFrame:
    """(snapshot and the columns of atoms, with x, y, z to 3 digits): all atoms of a residue (target, i) moved as one by its
    residue's displacement; snapshot 0 has them as they are. Residues that no mode moves are in snapshot 0 only."""
    names = [c for c in atoms.columns if c not in "xyz"]
    shift = moved.select("target", "snapshot", "i", "dx", "dy", "dz")
    place = [F.round(F.col(c) + F.col(f"d{c}"), 3).alias(c) for c in "xyz"]
    return atoms.select(F.lit(0).alias("snapshot"), *names, *"xyz").union(atoms.join(shift, ["target", "i"]).select("snapshot", *names, *place))


def detect(coordinates: DataFrame, radius: float = 8.0, every: int = 5) -> DataFrame:
    """(target, snapshot, pocket, i, d): the surrogate detector. A pocket is the residues within the radius of every
    fifth residue, itself included; d is the distance from it."""
    rows = coordinates.withColumn("target", F.struct("target", "snapshot"))
    centres = rows.filter(F.col("i") % every == 0)
    found = near_pairs(centres, rows, radius).select("target.target", "target.snapshot", F.col("i").alias("pocket"), F.col("j").alias("i"), "d")
    return found.union(centres.select("target.target", "target.snapshot", F.col("i").alias("pocket"), "i", F.lit(0.0).alias("d")))


def plausible(members: DataFrame) -> DataFrame:
    """(target, snapshot, pocket, lining, volume) of pockets with 4 to 60 residues and 30 to 2500 cubic angstroms, the
    volume being that of a sphere of the members' mean distance."""
    ball = 4 / 3 * 3.141592653589793 * F.pow(F.avg("d"), 3)
    return members.groupBy(*POCKET).agg(F.count(F.lit(1)).alias("lining"), F.round(ball, 6).alias("volume")).filter(F.col("lining").between(4, 60) & F.col("volume").between(30, 2500))


def stable(scouts: DataFrame, refinements: DataFrame, least: float = 0.5) -> DataFrame:
    """(target, mode, sign, scout, refinement, jaccard): each scout's most alike refinement of the same mode and sign, the
    first on ties, if at least this alike. Both hold rows (target, mode, sign, pocket, i)."""
    event = ["target", "mode", "sign"]
    sized = lambda m, n: m.select(*event, F.col("pocket").alias(n), "i", F.count(F.lit(1)).over(Window.partitionBy(*event, "pocket")).alias(f"n_{n}"))
    met = sized(scouts, "scout").join(sized(refinements, "refinement"), [*event, "i"]).groupBy(*event, "scout", "refinement", "n_scout", "n_refinement").agg(F.count(F.lit(1)).alias("both"))
    alike = F.round(F.col("both") / (F.col("n_scout") + F.col("n_refinement") - F.col("both")), 12)
    best = met.withColumn("jaccard", alike).groupBy(*event, "scout").agg(F.min(F.struct((-F.col("jaccard")).alias("minus"), "refinement")).alias("b"))
    return best.select(*event, "scout", "b.refinement", (-F.col("b.minus")).alias("jaccard")).filter(F.col("jaccard") >= least)


def persistence(observed: DataFrame, events: int) -> DataFrame:
    """(target, scout, seen, persistence): the share of the events in which a pocket is seen again."""
    return observed.groupBy("target", "scout").agg(F.count_distinct(F.struct("mode", "sign")).alias("seen")).withColumn("persistence", F.col("seen") / events)


def recurrence(seen: DataFrame) -> DataFrame:
    """(target, scout, p): one more than the pockets at least as persistent, itself among them, over one more than all."""
    by = Window.partitionBy("target").orderBy(F.desc("seen"))
    every = F.count(F.lit(1)).over(Window.partitionBy("target"))
    return seen.select("target", "scout", ((1 + F.count(F.lit(1)).over(by)) / (1 + every)).alias("p"))


def nearest(residues: DataFrame, k: int, step: float = 3.8) -> DataFrame:
    """(target, i, rank, j): the k residues nearest to each, itself first, ties to the lower index. Neighbours of a chain
    are one step apart, so k - 1 others lie within k steps and no product of all residues is needed."""
    pairs = near_pairs(residues, residues, step * k).select("target", "i", "j", F.round("d", 9).alias("d"))
    both = pairs.union(residues.select("target", "i", F.col("i").alias("j"), F.lit(-1.0).alias("d")))
    rank = F.row_number().over(Window.partitionBy("target", "i").orderBy("d", "j"))
    return both.withColumn("rank", rank).filter(F.col("rank") <= k).select("target", "i", "rank", "j")


def null_patches(residues: DataFrame, pocket: DataFrame, size: int = 5, tolerance: float = 4.0) -> DataFrame:
    """(target, members): patches of the pocket's size around residues that are about as far from the nearest source as
    the pocket's centre is, without sources and with at most max(3, size // 5) of the pocket's residues; each set once.
    pocket: (target, i), size rows a target."""
    source = residues.filter("source").select("target", *[F.col(c).alias(f"{c}s") for c in "xyz"])
    away = F.sqrt(sum((F.col(c) - F.col(f"{c}s")) * (F.col(c) - F.col(f"{c}s")) for c in "xyz"))
    centre = residues.join(pocket, ["target", "i"], "left_semi").groupBy("target").agg(*[F.avg(c).alias(c) for c in "xyz"])
    aim = centre.join(source, "target").groupBy("target").agg(F.min(away).alias("aim"))
    own = nearest_distance(residues, residues.filter("source"))
    centres = own.join(aim, "target").filter(F.abs(F.col("own") - F.col("aim")) <= tolerance).select("target", "i")
    marks = residues.select("target", F.col("i").alias("j"), F.col("source").cast("int").alias("s")).join(pocket.select("target", F.col("i").alias("j"), F.lit(1).alias("p")), ["target", "j"], "left")
    patches = nearest(residues, size).join(centres, ["target", "i"], "left_semi").join(marks, ["target", "j"])
    grouped = patches.groupBy("target", "i").agg(F.sort_array(F.collect_list("j")).alias("members"), F.sum("s").alias("s"), F.count("p").alias("p"))
    return grouped.filter((F.col("s") == 0) & (F.col("p") <= max(3, size // 5))).select("target", "members").distinct()


def region_scores(values: DataFrame, members: DataFrame, k: int = 5) -> DataFrame:
    """(target, pocket, region): mean over the sources of the mean of a pocket's k largest values. values: (target, src,
    i, c); members: (target, pocket, i)."""
    best = F.row_number().over(Window.partitionBy("target", "src", "pocket").orderBy(F.desc("c"), "i"))
    top = values.join(members, ["target", "i"]).withColumn("k", best).filter(F.col("k") <= k)
    return top.groupBy("target", "src", "pocket").agg(F.avg("c").alias("m")).groupBy("target", "pocket").agg(F.avg("m").alias("region"))


def ranked(regions: DataFrame, seen: DataFrame) -> DataFrame:
    """(target, rank, pocket, selection, persistence): by region score plus persistence over one more than the pockets,
    then persistence, then the pocket's number. seen: (target, pocket, persistence)."""
    rows = regions.join(seen, ["target", "pocket"])
    count = F.count(F.lit(1)).over(Window.partitionBy("target"))
    rows = rows.withColumn("selection", F.round(F.col("region") + F.col("persistence") / (count + 1), 12))
    order = Window.partitionBy("target").orderBy(F.desc("selection"), F.desc("persistence"), "pocket")
    return rows.select("target", F.row_number().over(order).alias("rank"), "pocket", "selection", "persistence")


def null_pvalue(regions: DataFrame, nulls: DataFrame) -> DataFrame:
    """(target, pocket, p): one more than the null regions at least as large, over one more than all of them."""
    # one order of both kinds of rows: a pocket's rank tells the nulls at or above it, and no pair is made
    both = regions.select("target", "pocket", F.round("region", 12).alias("r"), F.lit(0).alias("drawn")).union(nulls.select("target", F.lit(None), F.round("region", 12), F.lit(1)))
    every, order = Window.partitionBy("target"), Window.partitionBy("target").orderBy(F.desc("r"))
    ranked = both.withColumn("above", F.sum("drawn").over(order)).withColumn("all", F.sum("drawn").over(every))
    return ranked.filter("drawn = 0 and `all` > 0").select("target", "pocket", ((1 + F.col("above")) / (1 + F.col("all"))).alias("p"))


def combined(transport: DataFrame, seen_again: DataFrame, explained: DataFrame, least: float = 0.8) -> DataFrame:
    """(target, pocket, combined_p, ranking_p): the product of both p-values as a p-value of its own; pockets rank by it
    where hops explain at least this share of the variance, by the transport's p elsewhere. transport, seen_again:
    (target, pocket, p), which is above 0; explained: (target, explained)."""
    rows = transport.join(seen_again.withColumnRenamed("p", "r"), ["target", "pocket"]).join(explained, "target")
    product = F.col("p") * F.col("r")
    rows = rows.withColumn("combined_p", F.least(F.lit(1.0), product * (1 - F.log(product))))
    return rows.select("target", "pocket", "combined_p", F.when(F.col("explained") >= least, F.col("combined_p")).otherwise(F.col("p")).alias("ranking_p"))


def merged(observations: DataFrame, events: int) -> DataFrame:
    """(target, pocket, observations, persistence, volume, x, y, z): one row a family: the share of the events that show
    it, its largest volume and its mean centre. observations: (target, pocket, mode, sign, volume, x, y, z)."""
    seen = F.count_distinct(F.struct("mode", "sign")) / events
    return observations.groupBy("target", "pocket").agg(F.count(F.lit(1)).alias("observations"), seen.alias("persistence"), F.max("volume").alias("volume"), *[F.avg(c).alias(c) for c in "xyz"])


def by_size(members: DataFrame) -> DataFrame:
    """(target, item, rank, i) of pockets (target, pocket, i), the largest first, then by number."""
    sizes = members.groupBy("target", "pocket").agg(F.count(F.lit(1)).alias("n"))
    order = sizes.select("target", "pocket", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("n"), "pocket")).alias("rank"))
    return members.join(order, ["target", "pocket"]).select("target", F.col("pocket").alias("item"), "rank", "i")


def families(members: DataFrame, least: float = 0.5, centres: DataFrame | None = None, tolerance: float = 6.0) -> DataFrame:
    """(target, item, leader): in order of rank, an item joins the first leader that it is alike to (Jaccard), or leads
    itself. members: (target, item, rank, i), rank unique in a target. With centres (target, item, x, y, z), items are also
    alike if as much of the smaller lies in the larger and their centres within the tolerance. Each round makes leaders of the open items that no
    open item before them is alike to, and closes what is alike to these; rounds are bounded by the longest chain of
    alike items, not by the number of items."""
    sized = members.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("target", "item")))
    one = sized.select("target", "i", F.col("item").alias("a"), F.col("rank").alias("ra"), F.col("n").alias("na"))
    two = sized.select("target", "i", F.col("item").alias("b"), F.col("rank").alias("rb"), F.col("n").alias("nb"))
    both = one.join(two, ["target", "i"]).filter("ra < rb").groupBy("target", "a", "b", "ra", "na", "nb").agg(F.count(F.lit(1)).alias("k"))
    meets = F.round(F.col("k") / (F.col("na") + F.col("nb") - F.col("k")), 12) >= least
    if centres is not None:
        at = lambda n: centres.select("target", F.col("item").alias(n), F.struct("x", "y", "z").alias(f"c{n}"))
        both = both.join(at("a"), ["target", "a"], "left").join(at("b"), ["target", "b"], "left")
        apart = F.sqrt(sum((F.col(f"ca.{c}") - F.col(f"cb.{c}")) * (F.col(f"ca.{c}") - F.col(f"cb.{c}")) for c in "xyz"))
        meets = meets | ((F.round(F.col("k") / F.least("na", "nb"), 12) >= least) & F.coalesce(apart <= tolerance, F.lit(False)))
    alike = kept(both.filter(meets).select("target", "a", "b", "ra"))
    still = kept(members.select("target", "item").distinct())
    leaders = None
    while still.limit(1).count():
        live = alike.join(still.withColumnRenamed("item", "a"), ["target", "a"], "left_semi").select("target", F.col("b").alias("item"))
        new = kept(still.join(live, ["target", "item"], "left_anti"))
        leaders = new if leaders is None else leaders.union(new)
        closed = alike.join(new.withColumnRenamed("item", "a"), ["target", "a"], "left_semi").select("target", F.col("b").alias("item"))
        still = kept(still.join(new, ["target", "item"], "left_anti").join(closed, ["target", "item"], "left_anti"))
    if leaders is None:
        leaders = still
    joined = alike.join(leaders.withColumnRenamed("item", "a"), ["target", "a"], "left_semi").groupBy("target", "b").agg(F.min_by("a", "ra").alias("leader"))
    followers = joined.withColumnRenamed("b", "item").join(leaders, ["target", "item"], "left_anti").select("target", "item", "leader")
    return followers.union(leaders.select("target", "item", F.col("item").alias("leader")))
