"""Store inspection: summaries, anomalies, differences, listings and rendered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.functions import bag
from strataweave.operators.descriptions import SOURCES, breakdown
from strataweave.operators.sets import differing

#: When name-only descriptions are too many.
PLACEHOLDER_MIN, PLACEHOLDER_RATIO = 5, 0.5


def flow_summaries(flows: DataFrame, descriptions: DataFrame, bridges: DataFrame) -> DataFrame:
    """A row for each flow (flow_id, live, anchor_set, entry_points, …): members, breakdown of their descriptions, bridges.

    Membership is the flow's own anchor set. ``descriptions`` (symbol_path, source), ``bridges``
    (src_id, dst_id).
    """
    members = flows.select("flow_id", F.explode("anchor_set").alias("symbol_path")).distinct()
    told = breakdown(members.join(descriptions, "symbol_path", "left"), ["flow_id"])
    ends = bridges.select("src_id", "dst_id").distinct()
    hit = lambda c: ends.join(members, ends[c] == members.symbol_path).select("flow_id", "src_id", "dst_id")
    # A bridge within a flow counts at its source only; pairs and members are distinct, so no triple needs to be made so again.
    own = members.select(F.col("flow_id").alias("__f"), F.col("symbol_path").alias("__m"))
    into = hit("dst_id").join(own, (F.col("flow_id") == F.col("__f")) & (F.col("src_id") == F.col("__m")), "left_anti")
    touching = hit("src_id").select("flow_id").union(into.select("flow_id")).groupBy("flow_id").agg(F.count(F.lit(1)).alias("bridge_count"))
    out = flows.withColumn("member_count", F.size("anchor_set")).join(told, "flow_id", "left").join(touching, "flow_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in (*SOURCES, "none", "total", "bridge_count")})


def listed(summaries: DataFrame) -> DataFrame:
    return summaries.orderBy(F.desc("live"), "flow_id")


def store_summary(summaries: DataFrame, descriptions: DataFrame, bridges: DataFrame, deferred: DataFrame) -> DataFrame:
    """One row of store-wide counts."""
    flows = summaries.agg(F.count_if("live").alias("live_flows"), F.count_if(~F.col("live")).alias("retired_flows"))
    told = breakdown(descriptions, [])
    return flows.crossJoin(told).crossJoin(bridges.agg(F.count(F.lit(1)).alias("bridges"))).crossJoin(deferred.agg(F.count(F.lit(1)).alias("deferred")))


def flow_detail(flow_id: str, flows: DataFrame, descriptions: DataFrame, bridges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of one flow with their texts, and the bridges that touch them."""
    members = flows.filter(F.col("flow_id") == flow_id).select(F.explode("anchor_set").alias("symbol_path")).distinct()
    ids = members.withColumnRenamed("symbol_path", "__m")
    one = bridges.join(ids, bridges.src_id == ids["__m"], "left_semi")
    two = bridges.join(ids, bridges.dst_id == ids["__m"], "left_semi")
    return members.join(descriptions, "symbol_path", "left"), one.unionByName(two).distinct()


def proposed_bridges(stitch: DataFrame) -> DataFrame:
    """``stitch`` (json) with how many bridges it proposes: null if absent or no JSON, 0 in any other wrong shape."""
    v = F.try_parse_json("json")
    umbrellas = F.try_variant_get(v, "$.umbrellas", "array<variant>")
    each = F.transform(F.coalesce(umbrellas, F.array().cast("array<variant>")), lambda u: F.coalesce(F.size(F.try_variant_get(u, "$.bridges", "array<variant>")), F.lit(0)))
    return stitch.withColumn("proposed", F.when(v.isNotNull(), F.aggregate(each, F.lit(0), lambda a, x: a + F.greatest(x, F.lit(0)))))


def anomalies(summaries: DataFrame, totals: DataFrame) -> DataFrame:
    """(code, flow_id, message): empty live flows, proposed bridges of which none is stored, too many name-only descriptions.

    ``totals`` is one row: proposed, bridges, provisional, placeholder, llm.
    """
    empty = summaries.filter("live AND member_count = 0").select(F.lit("empty_flow").alias("code"), "flow_id", F.format_string("flow %s has 0 members", "flow_id").alias("message"))
    none = F.lit(None).cast("string").alias("flow_id")
    lost = totals.filter("proposed > 0 AND bridges = 0").select(F.lit("unpersisted_bridges").alias("code"), none, F.format_string("%d bridge(s) proposed but 0 are persisted", "proposed").alias("message"))
    names = F.col("provisional") + F.col("placeholder")
    owned = names + F.col("llm")
    high = totals.filter((owned >= PLACEHOLDER_MIN) & (names / owned >= PLACEHOLDER_RATIO))
    text = F.format_string("%d/%d agentic descriptions are placeholders (%d%%)", names, owned, F.floor(names * 100 / owned + 0.5))
    return empty.unionAll(lost).unionAll(high.select(F.lit("high_placeholder_ratio").alias("code"), none, text.alias("message")))


def flow_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(flow_id, change) between two summaries: added, removed, changed.

    Changed is another state, bridge count, member set, seed set or breakdown; order in the lists
    doesn't matter. Sets are compared by their members, spread over tasks.
    """
    cols = ["live", "bridge_count", *SOURCES, "none"]
    shape = lambda d, k: d.select("flow_id", F.struct(*cols).alias(k))
    both = shape(before, "a").join(shape(after, "b"), "flow_id", "full_outer")

    def each(d: DataFrame) -> DataFrame:
        lists = [d.select(F.col("flow_id").alias("key"), F.explode(c).alias("member")).select("key", F.struct(F.lit(c).alias("list"), "member").alias("node")) for c in ("anchor_set", "entry_points")]
        return lists[0].union(lists[1])

    moved = differing(each(before), each(after)).select(F.col("key").alias("flow_id")).distinct().withColumn("moved", F.lit(True))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when((F.col("a") != F.col("b")) | F.coalesce("moved", F.lit(False)), "changed")
    return both.join(moved, "flow_id", "left").select("flow_id", change.alias("change")).filter("change IS NOT NULL")


def set_changes(before: DataFrame, after: DataFrame, key: str, col: str) -> DataFrame:
    """(key, gained, lost) of array columns that differ as sets, for keys on both sides; only what differs is listed."""
    shared = before.select(key).join(after.select(key), key, "left_semi").distinct()
    each = lambda d: d.join(shared, key, "left_semi").select(F.col(key).alias("key"), F.explode(col).alias("node"))
    listed = lambda side: F.array_sort(F.collect_list(F.when(F.col("side") == side, F.col("node"))))
    return differing(each(before), each(after)).groupBy(F.col("key").alias(key)).agg(listed("b").alias("gained"), listed("a").alias("lost"))


def bridge_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(src_id, dst_id, change) of bridges, compared by both ends."""
    k = ["src_id", "dst_id"]
    gone = before.select(*k).distinct().join(after.select(*k), k, "left_anti").withColumn("change", F.lit("removed"))
    return gone.unionByName(after.select(*k).distinct().join(before.select(*k), k, "left_anti").withColumn("change", F.lit("added")))


def same_breakdown(a: str, b: str):
    """Whether two breakdown structs agree in all buckets."""
    return F.col(a) == F.col(b)


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """(action, n) of run outcomes (action, pos), in the order of first appearance."""
    return outcomes.groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first")).orderBy("first").select("action", "n")


def ungraded(runs: DataFrame, grades: DataFrame) -> DataFrame:
    return runs.join(grades.select("run_id").distinct(), "run_id", "left_anti")


def description_nodes(nodes: DataFrame) -> DataFrame:
    """(symbol_path, source, text) of live description nodes."""
    rows = nodes.filter("kind = 'agentic.description' AND deleted_at IS NULL")
    path = F.regexp_extract("anchor", r"^(.+):[0-9a-f]{64}$", 1)
    return rows.select(path.alias("symbol_path"), bag.string_at(F.col("attributes"), "description_source").alias("source"), bag.string_at(F.col("attributes"), "description").alias("text"))


def summary_lines(summaries: DataFrame) -> DataFrame:
    """One rendered line for each flow."""
    state = F.when(F.col("live"), "live").otherwise("retired")
    return summaries.select("flow_id", F.format_string("%s  [%s] members=%d bridges=%d docstring=%d provisional=%d placeholder=%d llm=%d none=%d", "flow_id", state, "member_count", "bridge_count", *SOURCES, "none").alias("line"))


def diff_lines(diff: DataFrame) -> DataFrame:
    sign = F.when(F.col("change") == "added", "+").when(F.col("change") == "removed", "-").otherwise("~")
    return diff.select("flow_id", F.concat(sign, F.lit(" "), "flow_id").alias("line"))


def grading_screen(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """(run_id, screen): a header of grouped outcomes (run_id, action, n, pos) and the instruction, as text."""
    head = counts.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "action", "n"))), lambda x: F.concat(x["n"].cast("string"), F.lit(" "), x["action"])), ", ").alias("head"))
    return runs.join(head, "run_id", "left").select("run_id", F.concat_ws("\n", F.concat(F.lit("run "), "run_id"), F.coalesce("head", F.lit("no outcomes")), F.coalesce("instruction", F.lit(""))).alias("screen"))
