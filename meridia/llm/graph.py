"""Links between near duplicates: star edges inside buckets and connected components.

Nothing is collected: links, labels and components stay distributed, and every
round ends in a table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import drop, materialize, tidy

Measure = Callable[[DataFrame], DataFrame]

#: A table of at most so many narrow rows (two or three numbers) may be broadcast; larger ones are shuffled.
BROADCAST_ROWS = 1_000_000
#: Buckets are compared pair by pair where they hold so many pairs per member, on the whole, or fewer.
PAIRS_PER_MEMBER = 16
#: Longs of a bit mask of novel shingles.
MASKS = 6
#: Hashes of sets that are counted together.
VOTES = 1 << 20
#: The nodes of a star of at most so many are compared with each other directly.
SMALL_GROUP = 8


def broadcast_if_small(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting a (written) table; beyond the bound Spark shuffles."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def connected_components(links: DataFrame) -> DataFrame:
    """Distributed union-find over links ``(a, b)``: ``(node, component)`` for each linked node.

    Alternates large-star and small-star steps until the links are stars, each
    around the smallest node of its component.  Steps are
    aggregations and joins, so a node with very many links is pre-aggregated
    and its rows can be split.  No links: an empty table.
    """
    kind = links.schema["a"].dataType
    edges = materialize(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct())
    while True:
        # large star: a node's larger neighbours move to its smallest neighbour (or itself)
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        # small star: a node's smaller neighbours and itself move to the smallest of them
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(low, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        after = materialize(low.select("hi", F.col("m").alias("lo")).union(moved).distinct())
        drop(edges)
        edges = after
        # stars: every larger node has one edge, and none is the smaller node of another
        sides = edges.select(F.col("hi").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("lo", F.lit(0), F.lit(1)))
        uneven = sides.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1")
        if uneven.isEmpty():
            break
    nodes = edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
    return nodes.select(F.col("node").cast(kind), F.col("component").cast(kind))


def linked_components(members: DataFrame, bodies: DataFrame, percent: int, measure: Measure, shingles: Measure) -> DataFrame:
    """Components of the links between nodes that share a bucket: ``(node, component)``.

    ``members``: a written table ``(bucket, node)`` of buckets with two nodes or
    more; ``bodies``: a written table ``(node, body)`` with what shingles come
    from.  ``measure`` turns pairs ``(a, b, x, y)`` with bodies x and y into
    ``(a, b, na, nb, common)``, the sizes of both sets and of their
    intersection; ``shingles`` turns a column ``body`` into ``x``, the distinct
    hashes.  A link needs ``100 * intersection >= percent * union``.

    Each bucket gives a star around its most central node, its hub; the hub is
    compared with all others on full sets.  What verified stars connect needs no
    further pair.  For two other nodes x and y of a group, let its core be what
    most of its nodes have, e the core's shingles that a node lacks and n its
    novel ones, which the core lacks (small groups are compared pair by pair):

    * without a common novel shingle, their similarity is at most
      ``(core - max(e)) / (core - min(e) + n_x + n_y)``.  The classes of equal
      sizes, e and n are held against each other, and nodes of classes that reach
      the threshold by this bound are compared on full sets, unless they are in
      the same part already: so all but the nodes of a group's largest part, its
      strays, meet the nodes of such classes.  Where these are many, stars among the strays of each class,
      and between the classes, come first, as long as they find links.
    * otherwise they have as many novel shingles in common as the threshold
      leaves open, and so one among the first few by hash.  Those shingles are
      the next buckets.  Where these hold few pairs for their members, the pairs
      are compared on full sets; else they give stars again.

    So no link within a bucket is lost, and a large group of copies costs stars,
    not the square of its size.  Rounds end: buckets of the first round with one
    hub are one group, later each is its own, and half of a group's nodes at most
    have a shingle that its core lacks, so every further round halves the groups.
    """
    enough = lambda common, union: common * 100 >= union * percent

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Pairs and the sizes of their sets, measured on full sets."""
        both = pairs.join(bodies.select(F.col("node").alias("b"), F.col("body").alias("y")), "b").join(bodies.select(F.col("node").alias("a"), F.col("body").alias("x")), "a")
        return measure(both.select("a", "b", "x", "y"))

    link = enough(F.col("common"), F.col("na") + F.col("nb") - F.col("common"))
    parts, first = None, True
    while True:
        sizes = members.groupBy("bucket").agg(F.count("*").alias("n"))
        degree = members.join(sizes, "bucket").groupBy("node").agg(F.sum("n").alias("degree"))
        hubs = members.join(degree, "node").groupBy("bucket").agg(F.max(F.struct("degree", "node")).alias("hub")).select("bucket", F.col("hub.node").alias("hub"))
        spokes = members.join(hubs, "bucket").where("node <> hub")
        groups = materialize(spokes.select(F.col("hub" if first else "bucket").alias("g"), "hub", "node").distinct())
        star = materialize(confirmed(groups.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()))
        parts = _joined(star.where(link).select("a", "b"), parts)
        if not first:
            drop(members)
        rest = groups.join(star.select(F.col("a").alias("hub"), F.col("b").alias("node"), F.col("nb").alias("nx")), ["hub", "node"]).select("g", "node", "nx")
        rest = _in_parts(rest, parts)
        mixed = rest.groupBy("g").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count("*").alias("of")).where("p <> q").select("g", "of")
        mixed = materialize(rest.join(mixed, "g"))
        few = _pairs(mixed.where(F.col("of") <= SMALL_GROUP), percent)
        # a large group's core: what most of its nodes have
        large = mixed.where(F.col("of") > SMALL_GROUP)
        held = shingles(large.join(bodies, "node").select("g", "node", "nx", "part", "of", "body"))
        votes = held.select("g", "of", "x").mapInArrow(tidy(_votes), "g long, of long, s long, votes long")
        votes = votes.groupBy("g", "s").agg(F.sum("votes").alias("votes"), F.max("of").alias("of")).where("2 * votes > of")
        core = votes.groupBy("g").agg(F.collect_list("s").alias("core"))
        rest = held.join(core, "g", "left").withColumn("core", F.coalesce("core", F.array().cast("array<long>")))
        rest = rest.select("g", "node", "part", "nx", F.size("core").alias("nh"), F.array_sort(F.array_except("x", "core")).alias("novel"))
        rest = rest.withColumn("n", F.size("novel")).withColumn("e", F.col("nh") - F.col("nx") + F.col("n"))
        rest = rest.select("*", *(_mask("novel", k).alias(f"mask{k}") for k in range(MASKS)))
        # novel shingles that share their bit with another one
        rest = materialize(rest.withColumn("loose", F.col("n") - sum((F.bit_count(f"mask{k}") for k in range(MASKS)), F.lit(0))))
        while _many_core_pairs(rest, percent):  # strays that are alike meet as stars first
            alike = materialize(confirmed(_class_stars(rest, percent).distinct()).where(link).select("a", "b"))
            if alike.isEmpty():
                break
            parts = _joined(alike, parts)
            after = materialize(_in_parts(rest.drop("part"), parts))
            drop(alike)
            drop(rest)
            rest = after
        more = materialize(confirmed(few.union(_core_pairs(rest, percent)).distinct()).where(link).select("a", "b"))
        if not more.isEmpty():
            parts = _joined(more, parts)
            rest = _in_parts(rest.drop("part"), parts)

        # links need `least` common novel shingles or more, so the first n - least + 1 of each, by hash, share one
        least = F.greatest(F.lit(1), F.ceil(F.col("nx") * percent / F.lit(100)).cast("int") - (F.col("nx") - F.col("n")))
        prefix = F.slice("novel", F.lit(1), F.greatest(F.lit(0), F.col("n") - least + 1))
        carried = ["node", "nx", "part", "nh", "e", "loose", *(f"mask{k}" for k in range(MASKS))]
        shared = rest.select("g", *carried, F.explode(prefix).alias("s")).withColumn("bucket", F.xxhash64("g", "s")).drop("g", "s")
        split = shared.groupBy("bucket").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("bucket")
        members, first = materialize(shared.join(split, "bucket", "left_semi")), False
        total = members.groupBy("bucket").count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2), F.sum("count")).first()
        for used in (groups, star, mixed, rest, more):
            drop(used)
        if not total[1]:
            return parts
        if total[0] <= PAIRS_PER_MEMBER * total[1]:
            break
    # novel shingles of both that a mask can't tell apart bound the intersection
    novel = sum((F.bit_count(F.col(f"mask{k}_x").bitwiseAND(F.col(f"mask{k}_y"))) for k in range(MASKS)), F.lit(0))
    common = F.col("nh_x") - F.greatest("e_x", "e_y") + F.least("loose_x", "loose_y") + novel
    bound = common * 100 >= (F.col("nx_x") + F.col("nx_y") - common) * percent
    pairs = _pairs(members.withColumnRenamed("bucket", "g"), percent, bound, "nh", "e", "loose", *(f"mask{k}" for k in range(MASKS))).distinct()
    return _joined(confirmed(pairs).where(link).select("a", "b"), parts)


def _in_parts(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Adds ``part``: the component of each node so far, or itself."""
    return rows.join(parts.select("node", F.col("component").alias("part")), "node", "left").withColumn("part", F.coalesce("part", "node"))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups and sets ``(g, of, x)``: how many of a batch's sets of a group hold each hash, for some rows at a time."""
    for batch in batches:
        i = 0
        at = np.asarray(batch.column("x").offsets)
        values = np.asarray(batch.column("x").values)
        group, of = (np.asarray(batch.column(c)) for c in ("g", "of"))
        while i < len(batch):
            j = max(i + 1, int(np.searchsorted(at, at[i] + VOTES, side="right")) - 1)
            names, number = np.unique(group[i:j], return_inverse=True)
            size = np.zeros(len(names), np.int64)
            size[number] = of[i:j]
            owner = np.repeat(number, np.diff(at[i : j + 1]))
            held = values[at[i] : at[j]]
            order = np.argsort(owner, kind="stable")
            owner, held = owner[order], held[order].copy()
            cut = np.searchsorted(owner, np.arange(len(names) + 1))
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                held[a:b].sort()
            first = np.flatnonzero(np.append(True, (held[1:] != held[:-1]) | (owner[1:] != owner[:-1]))[: len(held)])
            columns = [names[owner[first]], size[owner[first]], held[first], np.diff(np.append(first, len(held)))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["g", "of", "s", "votes"])
            i = j


def _mask(values: str, k: int) -> Column:
    """A set of hashes as 64 bits: each sets one."""
    bit = lambda acc, v: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftrightunsigned(v, 8), F.lit(64)).cast("int")))
    mine = F.filter(values, lambda v: F.pmod(v, F.lit(MASKS)) == k)
    return F.aggregate(mine, F.lit(0).cast("long"), bit)


def _pairs(rows: DataFrame, percent: int, bound: Column | None = None, *more: str) -> DataFrame:
    """Pairs ``(a, b)`` of a group's nodes in different parts whose sizes ``nx`` (and columns ``more``) allow a link."""
    side = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("node", "nx", "part", *more)]
    pairs = rows.select("g", *side("x")).join(rows.select("g", *side("y")), "g").where("node_x < node_y and part_x <> part_y")
    pairs = pairs.where(F.least("nx_x", "nx_y") * 100 >= F.greatest("nx_x", "nx_y") * percent)
    return (pairs if bound is None else pairs.where(bound)).select(F.col("node_x").alias("a"), F.col("node_y").alias("b"))


_CLASS = ("nx", "n", "e")


def _side(s: str, *more: str) -> list[Column]:
    return [F.col(c).alias(f"{c}_{s}") for c in (*_CLASS, *more)]


def _met_classes(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes ``(nx, n, e)`` of a group, with nodes in different parts, that may be linked without a common novel shingle.

    Classes are few however large a group is.
    """
    classes = rows.groupBy("g", "nh", *_CLASS).agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count("*").alias("of"))
    met = classes.select("g", "nh", *_side("x", "p", "q")).join(classes.select("g", *_side("y", "p", "q", "of")), "g")
    common = F.col("nh") - F.greatest("e_x", "e_y")
    union = F.col("nh") - F.least("e_x", "e_y") + F.col("n_x") + F.col("n_y")
    met = met.where((common * 100 >= union * percent) & (F.least("p_x", "p_y") != F.greatest("q_x", "q_y")))
    met = met.where(F.least("nx_x", "nx_y") * 100 >= F.greatest("nx_x", "nx_y") * percent)
    return met.select("g", *[f"{c}_{s}" for s in "xy" for c in _CLASS], "of_y")


def _strays(rows: DataFrame) -> DataFrame:
    """Nodes that aren't in their group's largest part."""
    main = rows.groupBy("g", "part").count().groupBy("g").agg(F.max_by("part", F.struct("count", "part")).alias("main"))
    return rows.join(main, "g").where("part <> main")


def _many_core_pairs(rows: DataFrame, percent: int) -> bool:
    """Whether strays would meet more nodes than ``PAIRS_PER_MEMBER`` each, on the whole."""
    stray = _strays(rows).groupBy("g", *_CLASS).agg(F.count("*").alias("strays"))
    met = stray.select("g", *_side("x", "strays")).join(_met_classes(rows, percent), ["g", *[f"{c}_x" for c in _CLASS]])
    pairs = met.agg(F.sum(F.col("strays_x") * F.col("of_y"))).first()[0]
    return (pairs or 0) > PAIRS_PER_MEMBER * (stray.agg(F.sum("strays")).first()[0] or 0)


def _class_stars(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` in different parts: each stray with a node of its class's largest part of strays, and such nodes of classes that meet."""
    stray = _strays(rows)
    hubs = stray.groupBy("g", *_CLASS, "part").agg(F.count("*").alias("of"), F.min("node").alias("hub"))
    hubs = hubs.groupBy("g", *_CLASS).agg(F.max(F.struct("of", "part", "hub")).alias("h")).select("g", *_CLASS, F.col("h.part").alias("at"), F.col("h.hub").alias("hub"))
    spokes = stray.join(hubs, ["g", *_CLASS]).where("part <> at").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    met = _met_classes(rows, percent).join(hubs.select("g", *_side("x", "at", "hub")), ["g", *[f"{c}_x" for c in _CLASS]]).join(hubs.select("g", *_side("y", "at", "hub")), ["g", *[f"{c}_y" for c in _CLASS]])
    return spokes.union(met.where("at_x <> at_y").select(F.least("hub_x", "hub_y").alias("a"), F.greatest("hub_x", "hub_y").alias("b")))


def _core_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` in different parts that may be links without a common novel shingle.

    Only classes that reach the threshold are expanded.  Of two nodes in different parts, one at
    least is not in the group's largest part.
    """
    stray = _strays(rows).select("g", *_side("x", "node", "part"))
    met = _met_classes(rows, percent).drop("of_y")
    pairs = stray.join(met, ["g", *[f"{c}_x" for c in _CLASS]]).join(rows.select("g", *_side("y", "node", "part")), ["g", *[f"{c}_y" for c in _CLASS]])
    return pairs.where("part_x <> part_y").select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b"))


def _joined(links: DataFrame, parts: DataFrame | None) -> DataFrame:
    """The components so far and new links: components, as a written table; the old one is deleted.

    New links are contracted to the components that they join first, so only those take part in the rounds.
    """
    if parts is None:
        return materialize(connected_components(links))
    at = parts.select("node", "component")
    ends = links.join(at.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(at.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    cross = materialize(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct())
    if cross.isEmpty():
        drop(cross)
        return parts
    merged = materialize(connected_components(cross))
    moved = at.join(merged.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    after = materialize(moved.union(merged.select("node", "component").join(at, "node", "left_anti")))
    for used in (parts, cross, merged):
        drop(used)
    return after
