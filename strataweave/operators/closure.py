"""Reachability over a condensed graph, and its maintenance when edges change.

A path whose inner nodes have one edge in and one out is one node of the condensed graph: its nodes
are ranked by pointer jumping, in a number of rounds that grows with the logarithm of its length, and a
key that reaches its head reaches all of it. So long chains and cycles cost a few rounds; what is left of the
graph is walked level by level. Edges are read once. Tables that are written on the way are removed again.

A closure that is kept is maintained by deleting and rederiving: pairs that a removed edge or seed may have carried are
taken out along the old edges, those with another way back are found along the new ones. Keys that no changed
edge reaches take no part but for the joins that find that out.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.operators import sets
from strataweave.staging import ROWS, Cuts, cut, tasks

#: Levels of a walk after which what was seen is written as one table.
COMPACT = 4
#: Positions of a path and keys on it that one row of its pairs holds at most, and the pairs of a task, about.
BLOCK, PART, PAIRS = 2048, 1024, 4_000_000
#: Of how many nodes one is a stop that pointers don't jump over, and links from which on there are stops.
STRIDE, MANY = 16, 1_000_000


def united(each: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, each)


def jumped(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pointers (node, up, dist, low, last, ended) moved on till they end, and those of cycles that have no end, whose ``low`` is their smallest node then.

    Each round doubles what a pointer spans and writes what still moved. A path that is not at its end yet has a node that ends in the round, so a
    round in which none ends has left cycles only; they are through when their smallest nodes stay the same.
    """
    done, moving, paths = [own.filter("ended")], own.filter("NOT ended"), True
    left = moving.count()
    if not left:
        return done[0], moving
    while True:
        far = united([*done, moving] if paths else [moving])
        far = far.select(F.col("node").alias("at"), F.col("up").alias("far"), F.col("dist").alias("more"), F.col("low").alias("lower"), F.col("last").alias("far_last"), F.col("ended").alias("far_ended"))
        # Few pointers are hashed, so the nodes that they may meet need no sort.
        moved = (moving.hint("shuffle_hash") if left <= ROWS else moving).join(far, F.col("up") == F.col("at"))
        moved = cut(moved.select("node", F.col("far").alias("up"), (F.col("dist") + F.col("more")).alias("dist"), F.least("low", "lower").alias("low"), F.col("far_last").alias("last"), F.col("far_ended").alias("ended"), (F.col("low") != F.col("lower")).alias("news")))
        has = lambda c: F.coalesce(F.max(F.expr(c)), F.lit(False))
        paths, left, news = moved.agg(has("ended"), F.count_if(F.expr("NOT ended")), has("NOT ended AND news")).first()
        moved = moved.drop("news")
        if paths:
            done.append(moved.filter("ended"))
        moving = moved.filter("NOT ended")
        if not left or not (paths or news):
            return united(done), moving


def ranked_links(links: DataFrame, many: bool) -> tuple[DataFrame, DataFrame]:
    """Of links (node, up) to the node before, each once: (node, head, pos) of those that end at a head, and the rest
    with the smallest node of its cycle (node, up, low).

    Pointers jump over each other (``jumped``). Of ``many`` links they jump up to the next stop, one node of ``STRIDE`` by its hash, and only the stops'
    pointers go all the way: so a long path takes a few rounds of all its nodes, and its logarithm of a small part of them.
    """
    stop = lambda c: F.pmod(F.xxhash64(c), F.lit(STRIDE)) == 0 if many else F.lit(False)
    own = links.join(links.select(F.col("node").alias("at")), F.col("up") == F.col("at"), "left")
    own = own.select("node", "up", F.lit(1).cast("long").alias("dist"), F.least("node", "up").alias("low"), F.col("at").isNull().alias("last"))
    ended, endless = jumped(cut(own.withColumn("ended", F.col("last") | stop("up"))))
    found, rest = ended.filter("last").select("node", F.col("up").alias("head"), F.col("dist").alias("pos")), endless.select("node", "low")
    if many:
        ended = cut(ended)
        far, cyclic = jumped(ended.filter(stop("node")).withColumn("ended", F.col("last")))
        far = far.withColumn("cyclic", F.lit(False)).unionByName(cyclic.withColumn("cyclic", F.lit(True)))
        far = far.select(F.col("node").alias("at"), F.col("up").alias("head"), F.col("dist").alias("more"), F.col("low").alias("lower"), "cyclic")
        on = cut(ended.filter("NOT last").join(far, F.col("up") == F.col("at")).select("node", "head", (F.col("dist") + F.col("more")).alias("pos"), F.col("lower").alias("low"), "cyclic"))
        found = ended.filter("last").select("node", F.col("up").alias("head"), F.col("dist").alias("pos")).unionByName(on.filter("NOT cyclic").select("node", "head", "pos"))
        rest = rest.unionByName(on.filter("cyclic").select("node", "low"))
    return found, links.join(rest, "node")


def chains(step: DataFrame) -> DataFrame:
    """(node, head, pos) of nodes whose one edge in is the one edge out of the node before; ``step`` (src, dst) is distinct.

    Heads have no row. A cycle without another way in begins at its smallest node.
    """
    out = step.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("dst")).filter("n = 1 AND src <> dst").select("src", "dst")
    into = step.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("dst")
    links = cut(out.join(into, "dst", "left_semi").select(F.col("dst").alias("node"), F.col("src").alias("up")))
    n = links.count()
    if not n:
        return links.select("node", F.col("up").alias("head"), F.lit(1).cast("long").alias("pos"))
    found, cyclic = ranked_links(links, n >= MANY)
    open_ = cut(cyclic.filter("node <> low").select("node", "up"))
    if not open_.isEmpty():
        found = found.unionByName(ranked_links(open_, n >= MANY)[0])
    return cut(found)


def spread(start: DataFrame, step: DataFrame, seen: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(key, node) that ``start`` reaches along ``step`` (src, dst) without passing pairs of ``seen``; ``start`` included."""
    frontier = cut(start.select("key", "node").distinct())
    found, levels = frontier, 0
    if frontier.isEmpty():
        return found
    while most is None or levels < most:
        near = frontier.join(step, frontier.node == step.src).select("key", F.col("dst").alias("node")).distinct()
        near = near.join(found, ["key", "node"], "left_anti")
        if seen is not None:
            near = near.join(seen, ["key", "node"], "left_anti")
        frontier = cut(near)
        if frontier.isEmpty():
            break
        levels += 1
        found = found.unionByName(frontier)
        if levels % COMPACT == 0:
            found = cut(found)
    return found


def cells(inner: DataFrame, place: DataFrame) -> tuple[DataFrame, int]:
    """(keys, nodes, first) of the paths of ``inner`` (key, head, from), each key with its ``from`` and ``first`` the nodes' first position, and the number of tasks to deal their pairs among.

    A path is cut into blocks of positions and the keys on a block into parts, so neither a long path nor one that many
    keys lie on makes a large row; keys meet no block before their own. What is held grows with nodes and keys, and with a thousandth or so of their pairs.
    """
    block = lambda c: F.expr(f"`{c}` div {BLOCK}")
    cell, spark = ["head", "block"], place.sparkSession
    blocks = place.groupBy("head", block("pos").alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "node"))).alias("nodes"))
    blocks = cut(blocks.select(*cell, F.size("nodes").cast("long").alias("size"), F.col("nodes")[0]["pos"].alias("first"), F.col("nodes.node").alias("nodes")))
    ends = blocks.groupBy("head").agg(F.max("block").alias("last"))
    keys = inner.join(ends, "head").filter(block("from") <= F.col("last")).select("key", "head", "from", F.explode(F.sequence(block("from"), "last")).alias("block"))
    parts = keys.groupBy(*cell).agg(F.count(F.lit(1)).alias("keys")).join(blocks.select(*cell, "size"), cell)
    parts = cut(parts.select(*cell, F.ceil(F.col("keys") / PART).alias("parts"), "size", "keys"))
    pairs, held = parts.agg(F.sum(F.col("keys") * F.col("size")), F.sum(F.col("parts") * F.col("size"))).first()
    # A number of tasks that is given isn't lowered for the few bytes that they read.
    dealt = max(tasks(spark, pairs or 0, PAIRS), tasks(spark, held or 0))
    parts = parts.select(*cell, "parts")
    asked = keys.join(parts, cell).withColumn("part", F.pmod(F.xxhash64("key"), "parts")).drop("parts")
    held = blocks.join(parts, cell).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts", "size")
    asked, held = (d.repartition(dealt, *cell, "part") for d in (asked, held))
    asked = asked.groupBy(*cell, "part").agg(F.collect_list(F.struct("key", "from")).alias("keys"))
    return asked.join(held, [*cell, "part"]).select("keys", "nodes", "first"), dealt


def unfolded(folded: DataFrame, dealt: int) -> DataFrame:
    """(key, node) of the rows of ``cells``, made as they are read.

    The function of an array in the outer explode keeps the two from being compiled as one loop, which would hold all pairs of a row before it gives one.
    """
    skip = lambda k: F.greatest(k["from"] - F.col("first"), F.lit(0)).cast("int")
    keys = F.transform("keys", lambda k: F.struct(k["key"].alias("key"), skip(k).alias("skip")))
    each = folded.repartition(dealt).select(F.explode(keys).alias("k"), "nodes")
    rest = F.when(F.col("k.skip") == 0, F.col("nodes")).otherwise(F.slice("nodes", F.col("k.skip") + 1, F.size("nodes")))
    return each.select(F.col("k.key").alias("key"), F.explode(rest).alias("node"))


def along(inner: DataFrame, place: DataFrame) -> DataFrame:
    """(key, node) of the nodes of ``place`` (node, head, pos) that lie on the paths of ``inner`` (key, head, from) at ``from`` or after."""
    return unfolded(*cells(inner, place))


def closure(edges: DataFrame, seeds: DataFrame, written: bool = True, named: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """(key, node) of all nodes that each key's seeds (key, node) reach along ``edges`` (src, dst), the seeds included.

    Keys and nodes come out as ``named``. If the pairs are not to be ``written``, what is is one table of whole paths and
    their keys, and its pairs are made whenever they are read; the planner takes them for few, so they are not for joins.
    """
    with Cuts(edges.sparkSession) as cuts:
        step = cut(edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct())
        place = chains(step)
        own = seeds.select("key", "node").distinct()
        last = lambda pairs: pairs.select(named(F.col("key")).alias("key"), named(F.col("node")).alias("node"))
        if place.isEmpty():
            return cuts.keep(last(spread(own, step)))
        into_heads = step.join(place.select(F.col("node").alias("dst")), "dst", "left_anti")
        of_src = place.select(F.col("node").alias("src"), "head")
        outer = cut(into_heads.join(of_src, "src", "left").select(F.coalesce("head", "src").alias("src"), "dst").distinct())
        at = own.join(place, "node", "left").select("key", F.coalesce("head", "node").alias("head"), F.coalesce("pos", F.lit(0)).alias("pos"))
        at = cut(at.groupBy("key", "head").agg(F.min("pos").alias("pos")))
        tails = at.select("key", F.col("head").alias("node"))
        # Heads that are reached anew; a chain that a seed lies on goes on from its end whether or not its head is reached.
        after = tails.join(outer, tails.node == outer.src).select("key", F.col("dst").alias("node"))
        whole = spread(after.union(at.filter("pos = 0").select("key", "head")), outer)
        part = at.filter("pos > 0").join(whole.select("key", F.col("node").alias("head")), ["key", "head"], "left_anti")
        inner = whole.select("key", F.col("node").alias("head"), F.lit(0).cast("long").alias("from")).unionByName(part.select("key", "head", F.col("pos").alias("from")))
        folded, dealt = cells(inner, place)
        folded = folded.select(F.transform("keys", lambda k: F.struct(named(k["key"]).alias("key"), k["from"].alias("from"))).alias("keys"), F.transform("nodes", named).alias("nodes"), "first")
        if written:
            return cuts.keep(last(whole).union(unfolded(folded, dealt)))
        # One table of both: rows of pairs and rows of paths.
        both = cuts.keep(last(whole).unionByName(folded, allowMissingColumns=True).withColumn("path", F.col("nodes").isNotNull()))
        return both.filter("NOT path").select("key", "node").union(unfolded(both.filter("path").select("keys", "nodes", "first"), dealt))


class Change(NamedTuple):
    """What maintenance does to a closure: pairs (key, node) that stay, that go and that come."""

    kept: DataFrame
    gone: DataFrame
    new: DataFrame

    def closure(self) -> DataFrame:
        return self.kept.union(self.new)

    def keys(self) -> DataFrame:
        return self.gone.select("key").union(self.new.select("key")).distinct()


def maintained(pairs: DataFrame, edges: tuple[DataFrame, DataFrame], seeds: tuple[DataFrame, DataFrame]) -> Change:
    """The change of a closure (key, node) when old ``edges`` (src, dst) become new ones and old ``seeds`` (key, node) new ones."""
    with Cuts(pairs.sparkSession) as cuts:
        was, now = (s.select("key", "node").distinct() for s in seeds)
        pair, edge = ["key", "node"], ["src", "dst"]
        # One aggregate makes the edges of both graphs distinct and tells which graph has them.
        sides = (e.select(*edge, F.lit(k).alias("old"), F.lit(not k).alias("new")).filter("src IS NOT NULL AND dst IS NOT NULL") for e, k in zip(edges, (True, False), strict=True))
        both = cut(next(sides).union(next(sides)).groupBy(*edge).agg(F.max("old").alias("old"), F.max("new").alias("new")))
        old, new = (both.filter(k).select(*edge) for k in ("old", "new"))
        removed, added = (cut(both.filter(k).select(*edge)) for k in ("NOT new", "NOT old"))
        if removed.isEmpty() and added.isEmpty() and sets.differing(was, now).isEmpty():
            none = pairs.sparkSession.createDataFrame([], pairs.select(*pair).schema)
            return Change(pairs.select(*pair), none, none)
        cutoff = pairs.join(removed, pairs.node == removed.src).select("key", F.col("dst").alias("node"))
        doubtful = cut(spread(cutoff.union(was.join(now, pair, "left_anti")), old))
        # Written once, as every level of what follows asks for it; what comes back from doubt is added to it.
        kept = cuts.keep(pairs.select(*pair).join(doubtful, pair, "left_anti"))
        # Ways into doubtful pairs from pairs that stay, new edges out of those, and seeds.
        another = doubtful.join(new, doubtful.node == new.dst).select("key", F.col("src").alias("from"), "node")
        another = another.join(kept.select("key", F.col("node").alias("from")), ["key", "from"], "left_semi").select(*pair)
        begun = kept.join(added, kept.node == added.src).select("key", F.col("dst").alias("node"))
        start = cut(another.union(begun).union(now).distinct().join(kept, pair, "left_anti"))
        back = cut(spread(start, new, kept))
        gone, come = doubtful.join(back, pair, "left_anti"), back.join(doubtful, pair, "left_anti")
        stays = cuts.keep(back.join(doubtful, pair, "left_semi"))
        gone, come = cuts.keep(gone), cuts.keep(come)
    return Change(kept.unionByName(stays), gone, come)
