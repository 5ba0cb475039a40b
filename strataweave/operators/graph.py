"""Reachability, neighbourhoods, components and contraction over edge tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.operators.closure import COMPACT
from strataweave.staging import Cuts, cut


def reachable(edges: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """(key, node, depth) of all nodes that each key's seeds reach along ``edges`` (src, dst), and by how many edges at least.

    ``seeds`` has (key, node); a seed is reached at depth 0 even if no edge knows it. Level by
    level: a round joins the frontier only, drops what was reached before and writes what is new, so cycles end. Edges
    are read once. Where depths don't matter ``closure.closure`` goes by long paths at once.
    """
    with Cuts(edges.sparkSession) as cuts:
        step = cut(edges.select("src", "dst").distinct())
        frontier = cut(seeds.select("key", "node").distinct().withColumn("depth", F.lit(0)))
        seen, depth = frontier, 0
        while most is None or depth < most:
            depth += 1
            near = frontier.join(step, frontier.node == step.src).select("key", F.col("dst").alias("node")).distinct()
            frontier = cut(near.join(seen, ["key", "node"], "left_anti").withColumn("depth", F.lit(depth)))
            if frontier.isEmpty():
                break
            seen = seen.unionByName(frontier)
            if depth % COMPACT == 0:
                seen = cut(seen)
        return cuts.keep(seen)


def call_edges(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, confidence) of resolved calls whose target is in the graph, once for a pair.

    The first resolution in call order, then resolution order, gives a pair its certainty.
    """
    each = calls.select(F.col("caller_id").alias("src"), "call_ix", F.posexplode("resolutions").alias("res_ix", "r"))
    each = each.select("src", F.col("r.symbol_id").alias("dst"), "call_ix", "res_ix", F.col("r.confidence").alias("certainty"))
    known = nodes.select(F.col("symbol_id").alias("dst")).distinct()
    return each.join(known, "dst", "left_semi").groupBy("src", "dst").agg(F.min_by("certainty", F.struct("call_ix", "res_ix")).alias("certainty"))


def unresolved_calls(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """Calls that are no callbacks and have no resolution in the graph."""
    key = ["caller_id", "call_ix"]
    known = nodes.select("symbol_id").distinct()
    hit = calls.select(*key, F.explode("resolutions.symbol_id").alias("symbol_id")).join(known, "symbol_id", "left_semi").select(*key).distinct()
    return calls.filter(~F.coalesce("is_callback", F.lit(False))).join(hit, key, "left_anti")


def neighborhood(nodes: DataFrame, edges: DataFrame, seed: str, depth: int) -> tuple[DataFrame, DataFrame]:
    """Live nodes within ``depth`` undirected steps of ``seed``, and the edges met on the way.

    Deleted edges are not followed; the walk goes through missing and deleted nodes, whose
    edges come back though they don't. Depth 0 is the seed alone, without edges.
    """
    spark = nodes.sparkSession
    live = edges.filter("deleted_at IS NULL")
    both = live.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst")).union(live.select(F.col("dst_id").alias("src"), F.col("src_id").alias("dst")))
    start = spark.createDataFrame([("", seed)], "key string, node string")
    near = reachable(both, start, depth) if depth else start.withColumn("depth", F.lit(0))
    own = nodes.filter("deleted_at IS NULL").join(near.select(F.col("node").alias("id")), "id", "left_semi")
    inner = near.filter(F.col("depth") < depth).select("node")
    by_src = live.join(inner, live.src_id == inner.node, "left_semi")
    by_dst = live.join(inner, live.dst_id == inner.node, "left_semi")
    return own, by_src.unionByName(by_dst).dropDuplicates(["key"])


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, root): undirected components, named by their smallest node. Isolated ``nodes`` are their own.

    Each round contracts the graph: a node goes to the one within two steps that a hash of the round puts first, so about a
    third of the nodes of a path and one of a star are left, whatever their names and order, and the rounds grow with the logarithm
    of the longest path. What is left shrinks, so all rounds together move a few times the edges; then the rounds are gone back.
    """
    with Cuts(edges.sparkSession) as cuts:
        links = edges.filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        links, moves = cut(links.distinct()), []
        while not links.isEmpty():
            first = lambda c, n=len(moves): F.struct(F.xxhash64(c, F.lit(n)).alias("rank"), F.col(c).alias("node"))
            both = links.union(links.select("dst", "src"))
            near = both.groupBy("src").agg(F.min(first("dst")).alias("near")).select(F.col("src").alias("dst"), F.least(first("src"), "near").alias("near"))
            to = cut(both.join(near, "dst").groupBy(F.col("src").alias("node")).agg(F.min("near")["node"].alias("to")))
            moves.append(to)
            a, b = (to.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")) for c in ("src", "dst"))
            moved = links.join(a, "src").join(b, "dst").filter("src_to <> dst_to")
            links = cut(moved.select(F.least("src_to", "dst_to").alias("src"), F.greatest("src_to", "dst_to").alias("dst")).distinct())
        own = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
        own = (own.union(nodes.select("node")) if nodes is not None else own).filter("node IS NOT NULL").distinct()
        if not moves:
            return cuts.keep(own.withColumn("root", F.col("node")))
        ends = moves.pop()
        while moves:
            further = ends.select(F.col("node").alias("to"), F.col("to").alias("end"))
            ends = moves.pop().join(further, "to", "left").select("node", F.coalesce("end", "to").alias("to"))
            if len(moves) % COMPACT == 0:
                ends = cut(ends)
        ends = cut(ends)
        roots = ends.groupBy("to").agg(F.min("node").alias("root"))
        named = ends.join(roots, "to").select("node", "root")
        return cuts.keep(own.join(named, "node", "left").select("node", F.coalesce("root", "node").alias("root")))


def contract(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges between leaves lifted to their groups (leaf, group): once for a pair, none within a group, confidence 1."""
    a, b = groups.select(F.col("leaf").alias("src"), F.col("group").alias("src_group")), groups.select(F.col("leaf").alias("dst"), F.col("group").alias("dst_group"))
    lifted = edges.join(a, "src").join(b, "dst").filter("src_group <> dst_group")
    return lifted.select(F.col("src_group").alias("src"), F.col("dst_group").alias("dst")).distinct().withColumn("confidence", F.lit(1.0))


def without_dangling(edges: DataFrame, nodes: DataFrame, src: str = "src_id", dst: str = "dst_id") -> DataFrame:
    """Edges whose both ends are in ``nodes`` (id)."""
    ids = nodes.select("id").distinct()
    return edges.join(ids, edges[src] == ids.id, "left_semi").join(ids, edges[dst] == ids.id, "left_semi")


def one_hop(visible: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``visible`` (node) with all neighbours, and the edges (src, dst) among them."""
    out = edges.join(visible, edges.src == visible.node, "left_semi").select(F.col("dst").alias("node"))
    into = edges.join(visible, edges.dst == visible.node, "left_semi").select(F.col("src").alias("node"))
    near = visible.select("node").union(out).union(into).distinct()
    ids = near.withColumnRenamed("node", "id")
    return near, without_dangling(edges, ids, "src", "dst")


def first_neighbor(edges: DataFrame, direction: str = "out") -> DataFrame:
    """(node, neighbor): of each node's edges (src, dst, pos) the first one's other end."""
    a, b = ("src", "dst") if direction == "out" else ("dst", "src")
    return edges.groupBy(F.col(a).alias("node")).agg(F.min_by(b, "pos").alias("neighbor"))


def nearest_marked_dir(paths: DataFrame, markers: DataFrame) -> DataFrame:
    """(path, dir): the nearest directory at or above each path's that ``markers`` (dir) names; the root is ''."""
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    each = paths.select("path").distinct().select("path", F.explode(ups).alias("dir"))
    return each.join(markers.select("dir").distinct(), "dir", "left_semi").groupBy("path").agg(F.max_by("dir", F.length("dir")).alias("dir"))


def edge_containers(edges: DataFrame, module_of: DataFrame, parts: int | None = None) -> DataFrame:
    """Edges (src, dst) with the container that lays them out: their module if both ends share it, else the root ('').

    ``parts`` is the number of tasks that edges are dealt among, by ``src`` and then by ``dst``; without it the planner sees to that.
    """
    a, b = module_of.select(F.col("node").alias("src"), F.col("module").alias("a")), module_of.select(F.col("node").alias("dst"), F.col("module").alias("b"))
    dealt = lambda d, c: d.repartition(parts, c) if parts else d
    both = dealt(dealt(edges, "src").join(a, "src", "left"), "dst").join(b, "dst", "left")
    return both.withColumn("container", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.lit(""))).drop("a", "b")


def grouped_by(leaves: DataFrame, group_for: Callable[[], Column] | Column) -> DataFrame:
    """(leaf, group) under a grouping expression; the expression is the extension point."""
    key = group_for() if callable(group_for) else group_for
    return leaves.select("leaf", key.alias("group"))
