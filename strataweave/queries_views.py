"""Registered queries of scalar functions, predicates, transcripts, flow views and composites, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.functions import identity, predicates, text
from strataweave.operators import bridges, descriptions, flows, inspect, ladder, resolve, trajectory, view
from strataweave.plans import reconcile, stitch
from strataweave.plans.star_graph import table
from strataweave.queries import query, s
from strataweave.queries_incremental import of
from strataweave.sources import logs, transcripts
from strataweave.staging import tasks
from strataweave.streaming import incremental


def null() -> Column:
    return F.lit(None).cast("string")


# -- scalar functions --------------------------------------------------------


@query("""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l, (doc_id % 4 + 1)::INT AS a, (doc_id % 4 + 1 + doc_id % 3)::INT AS b, (doc_id % 5)::INT AS c, (doc_id % 11)::INT AS d FROM documents),
p AS (SELECT doc_id, c, d, l[a:b] AS p, list_last(l) AS e FROM l)
SELECT doc_id, array_to_string(list_transform(p, lambda x, i: CASE WHEN i = 1 AND len(p) = 1 THEN substr(x, c + 1, greatest(d - c, 0)) WHEN i = 1 THEN substr(x, c + 1) WHEN i = len(p) THEN left(x, d) ELSE x END), chr(10)) AS slice FROM p""")
def text_slices(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id")
    own = table(spark, sf, "documents").select("doc_id", "text", *((e % m + b).cast("int").alias(n) for e, m, b, n in ((k, 4, 1, "a"), (k, 5, 0, "c"), (k, 11, 0, "d"))))
    own = own.withColumn("b", (F.col("a") + k % 3).cast("int"))
    return own.select("doc_id", identity.slice_lines(F.col("text"), F.col("a"), F.col("c"), F.col("b"), F.col("d")).alias("slice"))


@query(r"""
WITH w AS (SELECT doc_id, text, 'w' || doc_id % 7 AS name FROM documents)
SELECT doc_id, sha256(trim(regexp_replace(trim(replace(text || ' ' || name || '() x' || name, chr(13) || chr(10), chr(10)), ' ' || chr(9) || chr(10) || chr(13)), '\bw' || doc_id % 7 || '\b', '', 'g'), ' ' || chr(9) || chr(10) || chr(13))) AS content_hash,
  left(sha256(text), 12) AS short, CASE WHEN length(text) > 200 THEN left(text, 200) || '…' ELSE text END AS shown FROM w""")
def content_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies without their own identifier, short hashes, shortened texts."""
    name = F.concat(F.lit("w"), (F.col("doc_id") % 7).cast("string"))
    body = F.concat("text", F.lit(" "), name, F.lit("() x"), name)
    return table(spark, sf, "documents").select("doc_id", text.content_hash(body, name).alias("content_hash"), identity.short_hash(F.col("text")).alias("short"), text.shortened(F.col("text")).alias("shown"))


@query("""
WITH p AS (SELECT page_id, split_part(url, '://', 2) AS u FROM pages), s AS (SELECT page_id, u, list_filter(string_split(u || '/./a//../b/c/..', '/'), lambda x: x NOT IN ('', '.')) AS p FROM p)
SELECT page_id, array_to_string(p[1:len(p) - 5], '/') || '/b' AS path, '/r/' || u AS absolute, '/t/' || regexp_replace(u, '[^A-Za-z0-9]', '-', 'g') || '/' || page_id || '.jsonl' AS transcript FROM s""")
def normal_paths(spark: SparkSession, sf: str) -> DataFrame:
    u = F.split_part("url", F.lit("://"), F.lit(2))
    return table(spark, sf, "pages").select(
        "page_id", identity.posix_normalize(F.concat(u, F.lit("/./a//../b/c/.."))).alias("path"), identity.absolute(u, "/r").alias("absolute"), identity.transcript_file("/t", u, s("page_id")).alias("transcript")
    )


@query("""
WITH c AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'G ' || c_name WHEN 1 THEN 'bad' WHEN 2 THEN ' mixed  ' || c_mktsegment WHEN 3 THEN 's' WHEN 4 THEN 'quit' ELSE 'what ' || c_name END AS l FROM customer)
SELECT c_custkey, CASE c_custkey % 6 WHEN 3 THEN 'skip' WHEN 4 THEN 'quit' WHEN 1 THEN 'invalid' WHEN 5 THEN 'invalid' ELSE 'verdict' END AS kind,
  CASE c_custkey % 6 WHEN 0 THEN 'good' WHEN 2 THEN 'mixed' END AS verdict, CASE c_custkey % 6 WHEN 0 THEN substr(l, 3) WHEN 2 THEN substr(l, 9) END AS reason FROM c""")
def grade_lines(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey") % 6
    line = F.when(k == 0, F.concat(F.lit("G "), "c_name")).when(k == 1, "bad").when(k == 2, F.concat(F.lit(" mixed  "), "c_mktsegment")).when(k == 3, "s").when(k == 4, "quit").otherwise(F.concat(F.lit("what "), "c_name"))
    return table(spark, sf, "customer").select("c_custkey", text.grade_line(line).alias("g")).select("c_custkey", "g.*")


@query("""
WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 > 0 THEN '2024-0' || (s_suppkey % 9 + 1) END AS a, CASE WHEN s_suppkey % 4 > 1 THEN '2024-0' || (s_suppkey % 7 + 1) END AS b, CASE WHEN s_suppkey % 10 = 0 THEN 'e' END AS e FROM supplier)
SELECT s_suppkey, CASE WHEN a IS NULL AND b IS NULL AND e IS NULL THEN 'never' WHEN e IS NOT NULL THEN 'unhealthy' WHEN a IS NOT NULL AND (b IS NULL OR a > b) THEN 'in_flight' ELSE 'healthy' END AS state,
  starts_with('cursor-' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '.json' ELSE '.txt' END, 'cursor-') AND s_suppkey % 2 = 0 AND s_suppkey % 13 > 7 AS stale FROM s""")
def sync_states(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    month = lambda n: F.concat(F.lit("2024-0"), (k % n + 1).cast("string"))
    state = predicates.sync_state(F.when(k % 3 > 0, month(9)), F.when(k % 4 > 1, month(7)), F.when(k % 10 == 0, "e"))
    name = F.concat(F.lit("cursor-"), s("s_suppkey"), F.when(k % 2 == 0, ".json").otherwise(".txt"))
    return table(spark, sf, "supplier").select("s_suppkey", state.alias("state"), predicates.stale_cursor(name, k % 13, "cursor-", ".json").alias("stale"))


# -- transcripts -------------------------------------------------------------

EDITS_SQL = """
t AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN CASE WHEN turn % 4 = 1 THEN 'Edit' ELSE 'Read' END END AS tool, 'f' || conv_id % 50 || '/' || turn || '.ts' AS path FROM conversations)"""


def _transcript(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as transcript lines: each second turn edits or reads a file."""
    k, turn = F.col("conv_id"), F.col("turn")
    call = F.struct(F.lit("tool_use").alias("type"), F.when(turn % 4 == 1, "Edit").otherwise("Read").alias("name"), F.concat(F.lit("t"), k.cast("string"), F.lit("-"), turn.cast("string")).alias("id"), F.struct(F.concat(F.lit("f"), (k % 50).cast("string"), F.lit("/"), turn.cast("string"), F.lit(".ts")).alias("file_path")).alias("input"))
    said = F.struct(F.when(turn % 2 == 1, "assistant").otherwise("user").alias("type"), F.lit("2024-01-01").alias("timestamp"), F.struct(F.lit("x").alias("role"), F.array(call).alias("content")).alias("message"))
    torn = F.when(k % 17 == 0, F.lit('{"torn')).otherwise(F.to_json(said))
    return table(spark, sf, "conversations").select((k * 1000 + turn).alias("line_no"), torn.alias("line"))


@query(f"WITH {EDITS_SQL} SELECT path, min(conv_id * 1000 + turn) AS first FROM t WHERE tool = 'Edit' AND conv_id % 17 <> 0 GROUP BY 1")
def edited_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files that editing tools wrote, with the first line that names each; torn lines are left out."""
    return transcripts.edited_files(_transcript(spark, sf)).select("path", F.col("pos.line_no").alias("first"))


@query(f"WITH {EDITS_SQL} SELECT conv_id * 1000 + turn AS line_no, tool, path AS target FROM t WHERE tool IS NOT NULL AND conv_id % 17 <> 0")
def context_steps(spark: SparkSession, sf: str) -> DataFrame:
    return transcripts.context_steps(_transcript(spark, sf)).select("line_no", "tool", "target")


@query("""
SELECT e.event_id, coalesce(CASE WHEN e.event_id % 3 = 0 THEN 'own' END, m.agent) AS agent_id FROM events e LEFT JOIN (SELECT user_id, min(event_type) AS agent FROM events WHERE event_id % 5 = 0 GROUP BY 1) m ON m.user_id = e.user_id""")
def spans_with_agents(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    spans = e.select("event_id", s("user_id").alias("tool_use_id"), F.when(F.col("event_id") % 3 == 0, "own").alias("agent_id"))
    return trajectory.with_agent(spans, e.filter("event_id % 5 = 0").select(s("user_id").alias("tool_use_id"), F.col("event_type").alias("agent_id"))).select("event_id", "agent_id")


@query("SELECT event_id, row_number() OVER (ORDER BY event_type <> 'error', event_id) - 1 AS ordinal FROM events WHERE event_type IN ('error', 'click')")
def spine_ordinals(spark: SparkSession, sf: str) -> DataFrame:
    """Two kinds of steps in one order with contiguous numbers."""
    e = table(spark, sf, "events")
    parts = [e.filter(F.col("event_type") == k).select(F.col("event_id").alias("pos"), F.lit(k).alias("kind"), null().alias("at"), s("event_id").alias("summary"), F.lit("").alias("detail")) for k in ("error", "click")]
    return trajectory.spine("r", parts).select(F.col("summary").cast("long").alias("event_id"), F.col("ordinal").cast("long").alias("ordinal"))


@query("SELECT 'p' || p_partkey AS module, (row_number() OVER (ORDER BY p_retailprice, 'p' || p_partkey) - 1)::INT AS cluster FROM part")
def cluster_ordinals(spark: SparkSession, sf: str) -> DataFrame:
    return view.cluster_numbers(table(spark, sf, "part").select(of("p", "p_partkey").alias("module"), F.col("p_retailprice").alias("pos")))


# -- flows and views ---------------------------------------------------------


@query("""
WITH m AS (SELECT c_nationkey AS n, count(*) AS members FROM customer GROUP BY 1), f AS (SELECT DISTINCT c_nationkey AS n FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000)
SELECT 'n' || n_nationkey AS key FROM nation JOIN f ON n = n_nationkey WHERE n_nationkey % 5 > 0""")
def touched_entry_points(spark: SparkSession, sf: str) -> DataFrame:
    """Entry points that are no tests and whose members lie in a changed file."""
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    members = c.select(of("n", "c_nationkey").alias("key"), of("c", "c_custkey").alias("node"))
    nodes = c.select(of("c", "c_custkey").alias("symbol_id"), F.when(F.col("c_acctbal") > 9000, F.col("c_mktsegment")).otherwise("x").alias("file_path"), F.lit(False).alias("is_test"))
    nodes = nodes.union(n.select(of("n", "n_nationkey"), F.lit("n"), F.col("n_nationkey") % 5 == 0))
    return reconcile.touched_skeletons(members, nodes, spark.createDataFrame([("BUILDING",)], "path string"), n.select(of("n", "n_nationkey").alias("symbol_id")))


@query("""
WITH s AS (SELECT o_custkey, count(*) AS n, bool_and(o_orderpriority <> '1-URGENT') AS t FROM orders GROUP BY 1)
SELECT 'f' || o_custkey AS flow_id FROM s JOIN customer ON c_custkey = o_custkey WHERE t AND n = CASE WHEN c_acctbal < 0 THEN n + 1 ELSE n END""")
def test_rooted_flows(spark: SparkSession, sf: str) -> DataFrame:
    """Flows all of whose stored seeds resolve, to tests only; in debt one seed more is asked for than there is."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    nodes = o.select(of("o", "o_orderkey").alias("symbol_id"), (F.col("o_orderpriority") != "1-URGENT").alias("is_test"))
    asked = o.join(c, F.col("c_custkey") == F.col("o_custkey")).groupBy("o_custkey").agg(F.collect_list(of("o", "o_orderkey")).alias("e"), F.max(F.col("c_acctbal") < 0).alias("debt"))
    own = asked.select(of("f", "o_custkey").alias("flow_id"), F.when(F.col("debt"), F.concat("e", F.array(F.lit("lost")))).otherwise(F.col("e")).alias("entry_points"))
    return reconcile.test_rooted(own, o.select(of("f", "o_custkey").alias("flow_id"), of("o", "o_orderkey").alias("symbol_id")), nodes)


@query("SELECT DISTINCT o_custkey AS key FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_partkey = 7")
def flows_of_a_leaf(spark: SparkSession, sf: str) -> DataFrame:
    o, line = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    members = o.join(line, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("key"), F.col("l_partkey").cast("string").alias("node"))
    return flows.flows_of_leaf(members, "7")


@query("""
WITH m AS (SELECT o_custkey AS key, p_brand || '#' || p_name || ':' || p_type AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey)
SELECT key, count(DISTINCT p) AS n, array_to_string(list_sort(list(DISTINCT p)), ';') AS paths FROM m GROUP BY 1""")
def paths_of_flows(spark: SparkSession, sf: str) -> DataFrame:
    o, line, part = (table(spark, sf, t) for t in ("orders", "lineitem", "part"))
    ids = o.join(line, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("key"), s("l_partkey").alias("node"))
    out = flows.paths_of(ids, part.select(s("p_partkey").alias("symbol_id"), F.col("p_brand").alias("file_path"), F.col("p_name").alias("name"), F.col("p_type").alias("kind")))
    return out.select("key", F.size("paths").cast("long").alias("n"), F.array_join("paths", ";").alias("paths"))


@query("""
WITH m AS (SELECT DISTINCT l_partkey AS p FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT'),
g AS (SELECT p_brand AS g, bool_or(p_size = 1) AS e FROM part JOIN m ON p = p_partkey GROUP BY 1),
c AS (SELECT DISTINCT a.p_brand AS s, b.p_brand AS d FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_partkey IN (SELECT p FROM m) AND b.p_partkey IN (SELECT p FROM m) AND a.p_brand <> b.p_brand)
SELECT 'node' AS what, 'file:' || g AS id, '' AS dst, e AS entry FROM g UNION ALL SELECT 'edge', 'file:' || s, 'file:' || d, false FROM c""")
def projected_view(spark: SparkSession, sf: str) -> DataFrame:
    """A flow beyond the budget: its leaves collapse to their modules, with calls lifted to them."""
    o, line, part = (table(spark, sf, t) for t in ("orders", "lineitem", "part"))
    members = line.join(o.filter("o_orderpriority = '1-URGENT'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select(s("l_partkey").alias("node")).distinct()
    nodes = part.select(s("p_partkey").alias("symbol_id"), F.col("p_brand").alias("file_path"))
    to = F.array(F.struct((F.col("p_partkey") + 1).cast("string").alias("symbol_id"), F.lit("certain").alias("confidence"), null().alias("reason")))
    calls = part.select(s("p_partkey").alias("caller_id"), F.lit(0).alias("call_ix"), to.alias("resolutions"))
    seeds = part.filter("p_size = 1").select(s("p_partkey").alias("symbol_id"))
    rows, edges = flows.projected(members, nodes, calls, seeds)
    prefix = F.regexp_replace("id", f"^{identity.GROUP_PREFIX}", "file:")
    lifted = lambda c: F.regexp_replace(c, f"^{identity.GROUP_PREFIX}", "file:")
    return rows.select(F.lit("node").alias("what"), prefix.alias("id"), F.lit("").alias("dst"), F.col("is_entry_point").alias("entry")).union(edges.select(F.lit("edge"), lifted("src"), lifted("dst"), F.lit(False)))


@query("""
WITH m AS (SELECT c_nationkey AS n, c_custkey AS c, row_number() OVER (PARTITION BY c_nationkey ORDER BY 'c' || c_custkey) - 1 AS i, ceil(sqrt(count(*) OVER (PARTITION BY c_nationkey))) AS w, min('c' || c_custkey) OVER (PARTITION BY c_nationkey) AS r FROM customer)
SELECT 'c' || c AS node, r AS component, (i % w * 250)::DOUBLE AS x, (floor(i / w) * 250)::DOUBLE AS y FROM m""")
def component_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Each nation's customers, linked to the first, in a square."""
    c = table(spark, sf, "customer")
    low = c.groupBy("c_nationkey").agg(F.min("c_custkey").alias("low"))
    edges = c.join(low, "c_nationkey").filter("c_custkey <> low").select(of("c", "low").alias("src"), of("c", "c_custkey").alias("dst"))
    return view.grid(c.select(of("c", "c_custkey").alias("node")), edges).withColumns({k: F.col(k).cast("double") for k in ("x", "y")})


@query("""
WITH t AS (SELECT s_nationkey AS n, s_suppkey AS k, (s_suppkey % 100 * 10)::DOUBLE AS x, (s_suppkey % 37 * 7)::DOUBLE AS y FROM supplier)
SELECT k, x - (min(x) OVER (PARTITION BY n) - 20) AS x, y - (min(y) OVER (PARTITION BY n) - 60) AS y FROM t""")
def relative_boxes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    boxes = table(spark, sf, "supplier").select(k.alias("k"), s("s_nationkey").alias("parent"), (k % 100 * 10).cast("double").alias("x"), (k % 37 * 7).cast("double").alias("y"), F.lit(200.0).alias("width"), F.lit(100.0).alias("height"))
    return view.moved_into(boxes, view.bounding_boxes(boxes)).select("k", "x", "y")


@query("SELECT event_type AS severity, count(*) AS n FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 100) GROUP BY 1")
def newest_errors(spark: SparkSession, sf: str) -> DataFrame:
    return view.error_counts(table(spark, sf, "events").select(F.col("event_id").alias("pos"), F.col("event_type").alias("severity")))


# -- composites --------------------------------------------------------------


@query("""
WITH c AS (SELECT c_custkey, 'd:' || c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'gone' WHEN c_custkey % 4 = 1 THEN 'moved' ELSE 'same' END AS what FROM customer)
SELECT 'agentic.description:f#c' || c_custkey || ':function' AS id, CASE what WHEN 'gone' THEN 'delete' WHEN 'moved' THEN 'rekey' ELSE 'keep' END AS action, CASE WHEN what = 'moved' THEN 'agentic.description:f#m' || c_custkey || ':function' END AS new_id FROM c""")
def node_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """What becomes of descriptions whose symbols stay, move or go."""
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    path = lambda p: F.concat(F.lit(f"f#{p}"), s("c_custkey"), F.lit(":function"))
    nodes = c.select(identity.description_id(path("c")).alias("id"), path("c").alias("symbol_path"), F.sha2("c_name", 256).alias("content_hash"))
    fresh = c.filter(k % 4 > 0).select(F.when(k % 4 == 1, path("m")).otherwise(path("c")).alias("symbol_path"), F.sha2("c_name", 256).alias("content_hash"))
    return resolve.verdicts(nodes, fresh).select("id", "action", "new_id")


@query("""
WITH d AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'docstring' WHEN lang = 'de' THEN 'llm' WHEN lang = 'fr' THEN 'placeholder' ELSE 'cached' END AS b, source FROM documents)
SELECT 'd' || doc_id AS symbol_path, CASE WHEN b = 'docstring' THEN 'told' ELSE coalesce(source, 'none') END AS text, CASE WHEN b = 'llm' THEN 'provisional' ELSE b END AS source FROM d WHERE b <> 'cached'""")
def resolved_texts(spark: SparkSession, sf: str) -> DataFrame:
    bucket = F.when(F.col("lang") == "en", "docstring").when(F.col("lang") == "de", "llm").when(F.col("lang") == "fr", "placeholder").otherwise("cached")
    plan = table(spark, sf, "documents").select(of("d", "doc_id").alias("symbol_path"), null().alias("content_hash"), F.lit("told").alias("docstring"), F.coalesce("source", F.lit("none")).alias("name"), bucket.alias("bucket"))
    return descriptions.resolved(plan).select("symbol_path", "text", "source")


@query("SELECT CASE WHEN lang = 'en' THEN 'docstring' ELSE coalesce(lang, 'none') END AS source, count(*) AS n FROM documents GROUP BY 1")
def description_counts(spark: SparkSession, sf: str) -> DataFrame:
    told = F.when(F.col("lang") == "en", "docstring").otherwise(F.coalesce("lang", F.lit("none")))
    return descriptions.counts_by_source(table(spark, sf, "documents").select(told.alias("source")))


@query("""
WITH e AS (SELECT user_id, event_type, event_id FROM events WHERE event_type IN ('click', 'error')), l AS (SELECT user_id, max(event_id) FILTER (event_type = 'error') AS r FROM e GROUP BY 1)
SELECT event_id FROM e JOIN l USING (user_id) WHERE r IS NULL OR event_id >= r""")
def folded_change_log(spark: SparkSession, sf: str) -> DataFrame:
    """Changes that no later full write of their target made void."""
    log = table(spark, sf, "events").filter("event_type IN ('click', 'error')").select(F.col("user_id").alias("target"), F.when(F.col("event_type") == "error", "upsert").otherwise("set").alias("op"), F.col("event_id").alias("seq"))
    return ladder.folded_changes(log).select(F.col("seq").alias("event_id"))


@query("""
WITH o AS (SELECT 'f' || c_custkey AS flow_id, 'old' || c_nationkey AS reason FROM customer WHERE c_acctbal < 2000), n AS (SELECT 'f' || c_custkey AS flow_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'defer' ELSE 'retire' END AS action, c_mktsegment AS reason FROM customer WHERE c_acctbal < 0)
SELECT flow_id, reason FROM o WHERE flow_id NOT IN (SELECT flow_id FROM n) UNION ALL SELECT flow_id, reason FROM n WHERE action = 'defer'""")
def deferrals(spark: SparkSession, sf: str) -> DataFrame:
    """Deferrals that are still open after a turn."""
    c = table(spark, sf, "customer")
    old = c.filter("c_acctbal < 2000").select(of("f", "c_custkey").alias("flow_id"), of("old", "c_nationkey").alias("reason"))
    now = c.filter("c_acctbal < 0").select(of("f", "c_custkey").alias("flow_id"), F.when(F.col("c_mktsegment") == "BUILDING", "defer").otherwise("retire").alias("action"), F.col("c_mktsegment").alias("reason"))
    return reconcile.deferred_again(old, now)


@query("""
WITH f AS (SELECT 'n' || s_nationkey AS flow_id, s_nationkey AS n, count(*) AS b, list(DISTINCT 's' || s_suppkey % 50) AS m FROM supplier GROUP BY 1, 2)
SELECT count(*) AS flows, (SELECT count(DISTINCT x) FROM (SELECT unnest(m) AS x FROM f WHERE n % 2 = 0 AND n < 20)) AS members, sum(b)::BIGINT AS bridges FROM f WHERE n % 2 = 0 AND n < 20""")
def harvested(spark: SparkSession, sf: str) -> DataFrame:
    """What the live flows of one run hold."""
    own = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.collect_set(of("s", F.col("s_suppkey") % 50)).alias("anchor_set"), F.count(F.lit(1)).alias("bridge_count"))
    own = own.select(of("n", "s_nationkey").alias("flow_id"), (F.col("s_nationkey") < 20).alias("live"), "anchor_set", "bridge_count")
    ids = F.collect_list(F.struct(of("n", "n_nationkey").alias("flow_id")))
    runs = table(spark, sf, "nation").groupBy((F.col("n_nationkey") % 2).cast("string").alias("run_id")).agg(F.struct(ids.alias("outcomes")).alias("detail"))
    out = logs.harvest(runs, own, "0")
    return out.select("flows", F.size("members").cast("long").alias("members"), "bridges")


@query("""
WITH p AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN '{"umbrellas": [{"bridges": [1, 2]}, {"bridges": [' || turn || ']}, {}]}' WHEN conv_id % 3 = 1 THEN '{"umbrellas": 7}' END AS j FROM conversations)
SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN 3 WHEN conv_id % 3 = 1 THEN 0 END AS proposed FROM p""")
def proposed_bridges(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("conv_id") % 3
    text_ = F.when(k == 0, F.concat(F.lit('{"umbrellas": [{"bridges": [1, 2]}, {"bridges": ['), s("turn"), F.lit("]}, {}]}"))).when(k == 1, '{"umbrellas": 7}')
    return inspect.proposed_bridges(table(spark, sf, "conversations").select("conv_id", "turn", text_.alias("json"))).select("conv_id", "turn", F.col("proposed").cast("int").alias("proposed"))


@query("""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN 'placeholder' ELSE 'llm' END AS s, CASE WHEN doc_id % 7 = 0 THEN 'sum value' ELSE 'counts the ' || coalesce(lang, 'xx') || ' pages' END AS t FROM documents)
SELECT 'f#sumValue' || doc_id || ':function' AS symbol_path, CASE WHEN s IS NULL OR s <> 'llm' THEN 'not authored' ELSE 'restates its name' END AS failure FROM d WHERE s IS NULL OR s <> 'llm' OR doc_id % 7 = 0""")
def description_failures(spark: SparkSession, sf: str) -> DataFrame:
    """Expected descriptions that are absent, not authored, or only restate the name."""
    k = F.col("doc_id")
    path = F.concat(F.lit("f#sumValue"), s("doc_id"), F.lit(":function")).alias("symbol_path")
    d = table(spark, sf, "documents")
    told = d.filter(k % 5 > 0).select(path, F.when(k % 5 == 1, "placeholder").otherwise("llm").alias("source"), F.when(k % 7 == 0, "sum value").otherwise(F.concat(F.lit("counts the "), F.coalesce("lang", F.lit("xx")), F.lit(" pages"))).alias("text"))
    return stitch.description_score(d.select(path), told)


@query("""
WITH p AS (SELECT l_suppkey || '>' || l_partkey AS k, 'o' || l_orderkey AS f, arg_min(l_returnflag, l_linenumber * 10000000 + l_quantity * 1000 + l_discount * 100) AS e FROM lineitem GROUP BY 1, 2)
SELECT k AS edge_key, count(*) AS n FROM p GROUP BY 1""")
def provenance_by_file(spark: SparkSession, sf: str) -> DataFrame:
    """Provenance of edges is one row for each file, whatever extractor saw it."""
    line = table(spark, sf, "lineitem")
    rows = line.select(s("l_suppkey").alias("src_id"), s("l_partkey").alias("dst_id"), null().alias("inference_rationale"), of("o", "l_orderkey").alias("source_file"), F.lit("1:0-1:0").alias("source_range"), F.col("l_returnflag").alias("extractor_id"), F.lit("1").alias("extractor_version"), F.struct("l_linenumber", "l_quantity", "l_discount", "l_returnflag").alias("ordinal"))
    prov = bridges.build(rows, "k", ("source_file",), tasks(spark, line.count()))[1]
    key = F.regexp_replace(F.regexp_replace("edge_key", "^k:", ""), "->", ">")
    return prov.groupBy("edge_key").agg(F.count(F.lit(1)).alias("n")).select(key.alias("edge_key"), "n")


@query("""
SELECT 'cursor-' || user_id || '.json' AS name, max(event_id) % 15 AS age_days FROM events GROUP BY user_id HAVING max(event_id) % 15 > 7""")
def expired_cursors(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "events").groupBy("user_id").agg((F.max("event_id") % 15).alias("age_days"))
    return incremental.expired_cursors(own.select(F.concat(F.lit("cursor-"), s("user_id"), F.lit(".json")).alias("name"), "age_days"))
