"""Authored input: stitching flows, describing members, and scoring a store against expectations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataweave.functions.text import name_restatement
from strataweave.functions.identity import member_name
from strataweave.operators import flows as fl
from strataweave.operators.bridges import corroborated
from strataweave.operators.closure import closure
from strataweave.operators.graph import call_edges, unresolved_calls
from strataweave.operators.sets import classes

STITCH = "umbrellas array<struct<label:string,seeds:array<string>,bridges:array<struct<src_id:string,dst_id:string,file:string,line:int,rationale:string>>,rationale:string>>"
DESCRIPTIONS = "descriptions array<struct<symbol_path:string,text:string>>"


def payload(rows: DataFrame, schema: str, required: str, col: str = "json") -> DataFrame:
    """Parsed payloads; one whose required list is missing raises."""
    r = F.from_json(col, schema)
    broken = F.raise_error(F.concat(F.lit("malformed payload: no "), F.lit(required))).cast(r_type(schema))
    return rows.select(F.when(r[required].isNotNull(), r).otherwise(broken).alias("r")).select("r.*")


def r_type(schema: str) -> str:
    return "struct<" + schema.replace(" ", ":", 1) + ">"


def umbrellas(rows: DataFrame) -> DataFrame:
    """(umbrella, label, seeds, bridges, rationale) of a stitch payload; umbrellas of fewer than two seeds are no merge and raise."""
    each = payload(rows, STITCH, "umbrellas").select(F.posexplode("umbrellas").alias("umbrella", "u")).select("umbrella", "u.*")
    ok = F.coalesce(F.size("seeds"), F.lit(0)) >= 2
    return each.withColumn("label", F.when(ok, F.col("label")).otherwise(F.raise_error(F.lit("an umbrella needs two seeds")).cast("string")))


def stitched(found: DataFrame, nodes: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Flows of umbrellas (umbrella, label, entry_points, anchor_set), their borne-out bridges, and the claims turned down.

    Seeds are flow paths; those of no symbol are left out. Members are what the seeds and the
    targets of borne-out bridges reach.
    """
    index = fl.path_index(nodes)
    seeds = found.select("umbrella", F.explode("seeds").alias("path")).join(index, "path")
    edges = call_edges(calls, nodes).select("src", "dst")
    start = seeds.select(F.col("umbrella").cast("string").alias("key"), F.col("symbol_id").alias("node"))
    reach = closure(edges, start)
    claims = found.select(F.col("umbrella").cast("string").alias("flow_id"), F.inline("bridges"))
    good, rest = corroborated(claims, reach.select(F.col("key").alias("flow_id"), "node"), calls, nodes)
    more = good.join(index.withColumnRenamed("path", "dst_id"), "dst_id").select(F.col("flow_id").alias("key"), F.col("symbol_id").alias("node"))
    members = fl.paths_of(closure(edges, start.union(more)), nodes)
    out = found.select(F.col("umbrella").cast("string").alias("key"), "label", "rationale", F.array_sort("seeds").alias("entry_points")).join(members, "key").withColumnRenamed("paths", "anchor_set")
    return out, good, rest


def absorbed(flows: DataFrame, found: DataFrame) -> DataFrame:
    """(flow_id) of single-seed flows whose seed an umbrella takes."""
    taken = found.select(F.explode("seeds").alias("seed")).distinct()
    one = flows.filter(F.size("entry_points") == 1).withColumn("seed", F.element_at("entry_points", 1))
    return one.join(taken, "seed", "left_semi").select("flow_id")


def described(rows: DataFrame, index: DataFrame, symbols: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Authored texts (symbol_path, content_hash, text, source) to write, and paths that no symbol has.

    Payload paths are flow paths; they lead by symbol id to the enclosing-qualified path that
    descriptions go by. The last text for a path stands; blank ones are left out, as are texts
    already stored for the same content.
    """
    each = payload(rows, DESCRIPTIONS, "descriptions").select(F.posexplode("descriptions").alias("pos", "d"))
    last = fl.last_wins(each.select(F.col("d.symbol_path").alias("path"), F.trim("d.text").alias("text"), "pos"), ["path"], "pos").filter("text <> ''")
    linked = last.join(index, "path", "left")
    good = linked.filter("symbol_id IS NOT NULL").join(symbols.select("symbol_id", "symbol_path", "content_hash"), "symbol_id")
    same = existing.filter("source = 'llm'").select("symbol_path", "content_hash", "text")
    out = good.select("symbol_path", "content_hash", "text").join(same, ["symbol_path", "content_hash", "text"], "left_anti")
    return out.withColumn("source", F.lit("llm")), linked.filter("symbol_id IS NULL").select("path")


def inventory(nodes: DataFrame, calls: DataFrame, entry_points: DataFrame, described_paths: DataFrame) -> DataFrame:
    """(key, member_count, described, sites): each entry point's members, how many have a description, and unresolved calls in order of place."""
    members = closure(call_edges(calls, nodes).select("src", "dst"), entry_points.select(F.col("symbol_id").alias("key"), F.col("symbol_id").alias("node")))
    told = described_paths.select(F.col("symbol_id").alias("node")).distinct().withColumn("told", F.lit(1))
    counts = members.join(told, "node", "left").groupBy("key").agg(F.count(F.lit(1)).alias("member_count"), F.coalesce(F.sum("told"), F.lit(0)).alias("described"))
    sites = members.join(unresolved_calls(calls, nodes), F.col("node") == F.col("caller_id")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("file", F.col("start_line").alias("line"), "name", "caller_id"))).alias("sites"))
    return counts.join(sites, "key", "left")


def umbrella_score(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """(side, members) of failures: expected sets (pos, members) that no observed flow (flow_id, anchor_set, entry_points) equals, and surplus flows.

    An exact partition: each observed flow of two seeds on serves one expectation at most. Sets are told apart by
    classes of equal members, not by their lists; a list is made of the failures only.
    """
    none = F.lit(None).cast("string")
    want = expected.select(F.concat(F.lit("want "), F.col("pos").cast("string")).alias("key"), F.lit("missing").alias("side"), F.struct("pos", none.alias("flow_id")).alias("turn"), F.col("members").alias("m"))
    have = observed.filter(F.size("entry_points") >= 2).select(F.concat(F.lit("have "), F.col("flow_id").cast("string")).alias("key"), F.lit("surplus").alias("side"), F.struct(F.lit(None).cast(expected.schema["pos"].dataType).alias("pos"), F.col("flow_id").cast("string").alias("flow_id")).alias("turn"), F.col("anchor_set").alias("m"))
    both = want.unionByName(have)
    found = both.select("key", "side", "turn").join(classes(both.select("key", F.explode("m").alias("node"))), "key", "left")
    # Of each class as many are met as there are on the side with fewer; a set without members is a class too.
    ranked = found.withColumn("first", F.coalesce("first", F.lit(""))).withColumn("n", F.row_number().over(Window.partitionBy("first", "side").orderBy("turn")))
    sizes = ranked.groupBy("first").agg(F.least(F.count_if(F.col("side") == "missing"), F.count_if(F.col("side") == "surplus")).alias("met"))
    failed = ranked.join(sizes, "first").filter("n > met").select("key")
    return both.join(failed, "key", "left_semi").select("side", F.array_join(F.array_sort(F.array_distinct("m")), "\n").alias("members"))


def floor_score(flows: DataFrame, bridges: DataFrame, descriptions: DataFrame, expected_flows: int) -> DataFrame:
    """(check, ok) of a deterministic pass: the pinned number of flows, no bridge, no authored description."""
    one = flows.agg(F.count(F.lit(1)).alias("f")).crossJoin(bridges.agg(F.count(F.lit(1)).alias("b"))).crossJoin(descriptions.agg(F.count_if(F.col("source") == "llm").alias("d")))
    tests = {"flow_count": F.col("f") == expected_flows, "no_bridges": F.col("b") == 0, "no_authored_descriptions": F.col("d") == 0}
    return one.select(F.inline(F.array(*(F.struct(F.lit(k).alias("check"), v.alias("ok")) for k, v in tests.items()))))


def description_score(anchors: DataFrame, descriptions: DataFrame) -> DataFrame:
    """(symbol_path, failure) of expected descriptions that are absent, not authored, or only restate the name."""
    both = anchors.join(descriptions, "symbol_path", "left")
    bad = F.when(F.col("source").isNull() | (F.col("source") != "llm") | (F.trim("text") == ""), "not authored").when(name_restatement(member_name(F.col("symbol_path")), F.col("text")), "restates its name")
    return both.withColumn("failure", bad).filter("failure IS NOT NULL").select("symbol_path", "failure")


def store_view(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Live flows sorted by id and live bridges, for scoring."""
    return fl.stored_flows(nodes).orderBy("id"), edges.filter("kind = 'agentic.bridge' AND deleted_at IS NULL").select("src_id", "dst_id")
