"""Flows: skeletons by reachability, ranking, assembly of stored flows, scaffolds and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.functions import bag
from strataweave.functions.identity import EXTERNAL_GROUP, UNATTRIBUTED, edge_key, flow_path, group_id
from strataweave.functions.predicates import confidence
from strataweave.operators.closure import closure
from strataweave.operators.graph import call_edges, contract

#: What one view may hold before leaves collapse to modules.
NODE_BUDGET, EDGE_BUDGET = 200, 400


def path_index(nodes: DataFrame) -> DataFrame:
    """(path, symbol_id): flow paths of call-graph nodes; of several symbols on one path the smallest id stands."""
    path = flow_path(F.col("file_path"), F.col("name"), F.col("kind"))
    return nodes.select(path.alias("path"), "symbol_id").groupBy("path").agg(F.min("symbol_id").alias("symbol_id"))


def paths_of(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, paths): the sorted distinct flow paths of each key's nodes (key, node)."""
    named = nodes.select(F.col("symbol_id").alias("node"), flow_path(F.col("file_path"), F.col("name"), F.col("kind")).alias("path"))
    return ids.join(named, "node").groupBy("key").agg(F.array_sort(F.collect_set("path")).alias("paths"))


def skeleton_flows(nodes: DataFrame, edges: DataFrame, entry_points: DataFrame) -> DataFrame:
    """One flow for each entry point, and the remainder that none reaches.

    ``nodes`` (symbol_id, flow_id), ``edges`` (src, dst), ``entry_points`` (symbol_id). Returns
    flow_id, entry_point, member_count, is_unattributed, position: by member count, then id; of
    entry points with one flow id the larger flow stands, then the first entry point.
    """
    ids = nodes.select("symbol_id", "flow_id").distinct()
    starts = entry_points.join(ids, "symbol_id")
    reach = closure(edges, starts.select(F.col("symbol_id").alias("key"), F.col("symbol_id").alias("node")))
    counts = reach.groupBy(F.col("key").alias("symbol_id")).agg(F.count(F.lit(1)).alias("member_count"))
    flows = starts.join(counts, "symbol_id").groupBy("flow_id").agg(F.min(F.struct((-F.col("member_count")).alias("less"), "symbol_id")).alias("best"))
    rest = ids.join(reach.select(F.col("node").alias("symbol_id")).distinct(), "symbol_id", "left_anti").agg(F.count(F.lit(1)).alias("member_count")).filter("member_count > 0")
    listed = flows.select("flow_id", F.col("best.symbol_id").alias("entry_point"), (-F.col("best.less")).alias("member_count"), F.lit(False).alias("is_unattributed"))
    remainder = rest.select(F.lit(UNATTRIBUTED).alias("flow_id"), F.lit(None).cast("string").alias("entry_point"), "member_count", F.lit(True).alias("is_unattributed"))
    return listed.unionByName(remainder)


def ranked(flows: DataFrame) -> DataFrame:
    """Display order: larger first, then by id, the remainder last."""
    return flows.orderBy("is_unattributed", F.desc("member_count"), "flow_id", "entry_point")


def unattributed(nodes: DataFrame, edges: DataFrame, entry_points: DataFrame) -> DataFrame:
    """Nodes (symbol_id) that no entry point reaches."""
    reach = closure(edges, entry_points.select(F.lit("").alias("key"), F.col("symbol_id").alias("node")))
    return nodes.select("symbol_id").join(reach.select(F.col("node").alias("symbol_id")), "symbol_id", "left_anti")


def summaries(skeletons: DataFrame) -> DataFrame:
    """Skeletons as list rows, constants filled in."""
    return skeletons.withColumns({"state": F.lit("skeleton"), "label": F.col("flow_id"), "last_synced_at": F.lit(None).cast("string")})


def induced_members(flows: DataFrame, edges: DataFrame, bridges: DataFrame, docs: DataFrame) -> DataFrame:
    """(key, node): what each flow's seeds reach, its bridges' targets and what those reach, and its documents.

    ``flows`` (key, node) seeds; ``bridges`` (key, src, dst); ``docs`` (key, node).
    """
    seeds = flows.select("key", "node").union(bridges.select("key", F.col("dst").alias("node")))
    return closure(edges, seeds).union(docs.select("key", "node")).distinct()


def flows_of_leaf(members: DataFrame, leaf: str) -> DataFrame:
    return members.filter(F.col("node") == leaf).select("key").distinct()


def stored_flows(nodes: DataFrame) -> DataFrame:
    """Live flow nodes with their bag as typed columns."""
    return nodes.filter((F.col("kind") == "agentic.flow") & F.col("deleted_at").isNull()).select("id", "layer", bag.flow_fields(F.col("id"), F.col("attributes")).alias("f")).select("id", "layer", "f.*")


def assembled(flows: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Member edges of each flow (flow_id, member_id), and the bridges on either end of a member.

    A bridge between two flows belongs to both. The either-end condition is two equi-joins.
    """
    live = edges.filter("deleted_at IS NULL")
    ids = flows.select(F.col("id").alias("flow_id"))
    of_flow = live.filter("kind = 'agentic.flow.member'").join(ids, F.col("src_id") == F.col("flow_id")).select("flow_id", F.col("dst_id").alias("member_id"))
    named = flows.select(F.col("id").alias("flow_id"), F.explode("anchor_set").alias("member_id"))
    return of_flow, incident_bridges(live, named.union(of_flow.select("flow_id", "member_id")).distinct())


def incident_bridges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(flow_id, key, src_id, dst_id) of live bridges with an end among a flow's members (flow_id, member_id)."""
    bridges = edges.filter("kind = 'agentic.bridge' AND deleted_at IS NULL").select("key", "src_id", "dst_id")
    one = bridges.join(members, bridges.src_id == members.member_id).select("flow_id", "key", "src_id", "dst_id")
    two = bridges.join(members, bridges.dst_id == members.member_id).select("flow_id", "key", "src_id", "dst_id")
    return one.union(two).distinct()


def reconstructed(paths: DataFrame, index: DataFrame) -> DataFrame:
    """(key, path, symbol_id, is_doc): stored paths joined to the symbols of today; unmatched ones are linked documents."""
    return paths.join(index, "path", "left").select("key", "path", "symbol_id", F.col("symbol_id").isNull().alias("is_doc"))


def claimed(hydrated: DataFrame) -> DataFrame:
    """Flow paths that hydrated flows claim, as id or as seed."""
    return hydrated.select(F.col("id").alias("flow_id")).union(hydrated.select(F.explode("entry_points").alias("flow_id"))).distinct()


def ordered(hydrated: DataFrame, skeletons: DataFrame) -> DataFrame:
    """Hydrated flows, last synced first and unsynced last, then skeletons that none of them claims; ``position`` says the order."""
    left = skeletons.join(claimed(hydrated), "flow_id", "left_anti")
    one = hydrated.select(F.col("id").alias("flow_id"), F.lit(0).alias("rank"), "last_synced_at", F.lit(False).alias("is_unattributed"), F.lit(0).cast("long").alias("n"))
    two = left.select("flow_id", F.lit(1).alias("rank"), F.lit(None).cast("string").alias("last_synced_at"), "is_unattributed", F.col("member_count").alias("n"))
    return one.union(two).orderBy("rank", F.desc_nulls_last("last_synced_at"), "is_unattributed", F.desc("n"), "flow_id").select("flow_id", F.when(F.col("rank") == 0, "hydrated").otherwise("skeleton").alias("state"), "last_synced_at")


def with_twins(hydrated: DataFrame, skeletons: DataFrame) -> DataFrame:
    """Hydrated flows with the seed location and member count of the skeleton of the same id, where there is one."""
    twin = skeletons.select(F.col("flow_id").alias("id"), F.col("seed_location").alias("twin_location"), F.col("member_count").alias("twin_count"))
    joined = hydrated.join(twin, "id", "left")
    return joined.withColumns({"seed_location": F.coalesce("twin_location", "seed_location"), "member_count": F.coalesce("twin_count", "member_count")}).drop("twin_location", "twin_count")


def file_group(path: Column, root: str = "") -> Column:
    """The group of a leaf by file; files outside the root share a sentinel."""
    inside = F.lit(True) if root == "" else (path == root) | F.startswith(path, F.lit(root + "/"))
    return group_id(F.when(inside, path).otherwise(F.lit(EXTERNAL_GROUP)))


def module_scaffold(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Module rows and contains edges of leaves (leaf, group); members sorted, keys deterministic."""
    modules = leaves.groupBy("group").agg(F.array_sort(F.collect_set("leaf")).alias("members"), F.count_distinct("leaf").alias("member_count"))
    edges = leaves.select("group", "leaf").distinct().select(edge_key(F.lit("code.contains"), F.col("group"), F.col("leaf")).alias("key"), F.col("group").alias("src_id"), F.col("leaf").alias("dst_id"))
    return module_rows(modules), edges


def module_rows(modules: DataFrame) -> DataFrame:
    path = F.substring_index("group", ":", -1)
    outside = path == EXTERNAL_GROUP
    return modules.select(F.col("group").alias("id"), F.lit("code.module").alias("kind"), F.when(outside, "").otherwise(path).alias("path"), F.when(outside, EXTERNAL_GROUP).otherwise(F.element_at(F.split(path, "/"), -1)).alias("label"), "members", "member_count")


def flow_rows(flows: DataFrame) -> DataFrame:
    """Store rows of flows (id, label, entry_points, anchor_set, rationale, last_synced_at, and skill_root of bundles); what is null is left out of the bag."""
    anchors = F.array_sort("anchor_set")
    more = ["skill_root"] if "skill_root" in flows.columns else []
    bag_ = F.to_json(F.struct("label", "entry_points", anchors.alias("anchor_set"), F.size(anchors).alias("member_count"), "rationale", "last_synced_at", *more))
    return flows.select(
        "id", F.lit("agentic.flow").alias("kind"), F.lit("").alias("path"), F.lit(None).cast("string").alias("anchor"), F.lit("agentic").alias("layer"), bag_.alias("attributes"),
        F.lit(None).cast("map<string,string>").alias("field_ownership"), F.lit("agentic").alias("origin"), F.lit("flow").alias("intent_source"), F.lit(None).cast("string").alias("deleted_at"),
    )


def member_edge_rows(members: DataFrame) -> DataFrame:
    """Store rows of member edges (flow_id, member_id)."""
    null = lambda t: F.lit(None).cast(t)
    return members.distinct().select(
        edge_key(F.lit("agentic.flow.member"), F.col("flow_id"), F.col("member_id")).alias("key"), F.col("flow_id").alias("src_id"), F.col("member_id").alias("dst_id"), F.lit("agentic.flow.member").alias("kind"),
        F.lit(1.0).alias("confidence"), F.lit("agentic").alias("layer"), F.lit("{}").alias("attributes"), null("map<string,string>").alias("field_ownership"), F.lit("agentic").alias("origin"),
        F.lit("flow").alias("intent_source"), null("string").alias("adjudication"), null("string").alias("deleted_at"),
    )


def projected(members: DataFrame, nodes: DataFrame, calls: DataFrame, seeds: DataFrame, docs: DataFrame | None = None, node_budget: int = NODE_BUDGET, edge_budget: int = EDGE_BUDGET) -> tuple[DataFrame, DataFrame]:
    """Rows of one flow's view: nodes (id, kind, group, is_entry_point) and edges (src, dst, confidence).

    Functions with deduplicated calls among them; with ``docs`` (node) also documents that are
    members. Beyond either budget leaves collapse to their modules, rather than being cut off.
    """
    own = nodes.join(members.select(F.col("node").alias("symbol_id")).distinct(), "symbol_id", "left_semi")
    among = call_edges(calls.join(own.select(F.col("symbol_id").alias("caller_id")), "caller_id", "left_semi"), own)
    edges = among.select("src", "dst", confidence(F.col("certainty")).alias("confidence"))
    starts = seeds.select(F.col("symbol_id")).distinct().withColumn("is_entry_point", F.lit(True))
    rows = own.join(starts, "symbol_id", "left").select(F.col("symbol_id").alias("id"), F.lit("code.function").alias("kind"), file_group(F.col("file_path")).alias("group"), F.coalesce("is_entry_point", F.lit(False)).alias("is_entry_point"))
    if docs is not None:
        linked = docs.join(members.select("node"), "node", "left_semi").select(F.col("node").alias("id"), F.lit("doc").alias("kind"), F.lit(None).cast("string").alias("group"), F.lit(False).alias("is_entry_point"))
        rows = rows.unionByName(linked.distinct())
    # Two counts decide; both are cheap beside the traversal that made the members.
    if rows.limit(node_budget + 1).count() <= node_budget and edges.limit(edge_budget + 1).count() <= edge_budget:
        return rows, edges
    groups = rows.select(F.col("id").alias("leaf"), "group").filter("group IS NOT NULL")
    modules = rows.filter("group IS NOT NULL").groupBy("group").agg(F.max("is_entry_point").alias("is_entry_point"))
    rows = modules.select(F.col("group").alias("id"), F.lit("code.module").alias("kind"), F.lit(None).cast("string").alias("group"), "is_entry_point")
    return rows, contract(edges, groups)


def first_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key: an aggregate, combined on the map side."""
    rest = [c for c in df.columns if c not in key]
    first = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return first.select(*(F.col(c) if c in key else F.col(f"__r.{c}").alias(c) for c in df.columns))


def last_wins(df: DataFrame, key: list[str], pos: str) -> DataFrame:
    """The last row of each key: an aggregate, combined on the map side."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), pos).alias("__r")).select(*key, *(F.col(f"__r.{c}").alias(c) for c in rest))
