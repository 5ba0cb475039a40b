"""Registered queries over the star-schema and document tables, each with the same question in SQL.

Every query is an operator of this package applied to whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.functions import bag, identity, predicates, text
from strataweave.operators import agreement, bridges, closure, descriptions, flows, graph, inspect, ladder, resolve, search, trajectory, view
from strataweave.plans import reconcile, star_graph, stitch
from strataweave.plans.star_graph import table
from strataweave.staging import tasks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# The graph adapter in SQL, shared by several oracles.
EDGES_SQL = """
  SELECT 'r:' || n_regionkey AS src, 'n:' || n_nationkey AS dst FROM nation
  UNION ALL SELECT 'n:' || c_nationkey, 'c:' || c_custkey FROM customer
  UNION ALL SELECT 'n:' || s_nationkey, 's:' || s_suppkey FROM supplier
  UNION ALL SELECT 'c:' || o_custkey, 'o:' || o_orderkey FROM orders"""
NODES_SQL = """
  SELECT 'r:' || r_regionkey AS node FROM region UNION ALL SELECT 'n:' || n_nationkey FROM nation
  UNION ALL SELECT 'c:' || c_custkey FROM customer UNION ALL SELECT 's:' || s_suppkey FROM supplier
  UNION ALL SELECT 'o:' || o_orderkey FROM orders"""


def s(col: str):
    return F.col(col).cast("string")


# -- graph -------------------------------------------------------------------


@query(f"""
WITH RECURSIVE e AS ({EDGES_SQL}), r AS (
  SELECT 'r:' || r_regionkey AS key, 'r:' || r_regionkey AS node FROM region
  UNION SELECT r.key, e.dst FROM r JOIN e ON e.src = r.node)
SELECT key, node FROM r""")
def reachable_from(spark: SparkSession, sf: str) -> DataFrame:
    roots = table(spark, sf, "region").select(F.concat(F.lit("r:"), s("r_regionkey")).alias("key")).withColumn("node", F.col("key"))
    return closure.closure(star_graph.edges(spark, sf), roots)


@query(f"""
WITH RECURSIVE e AS ({EDGES_SQL}), r AS (
  SELECT 'r:' || r_regionkey AS key, 'r:' || r_regionkey AS node FROM region
  UNION SELECT r.key, e.dst FROM r JOIN e ON e.src = r.node)
SELECT key, node FROM r""")
def layered_closure(spark: SparkSession, sf: str) -> DataFrame:
    """The same closure where the layers are known: one plan of joins, nothing materialised between."""
    roots = table(spark, sf, "region").select(F.concat(F.lit("r:"), s("r_regionkey")).alias("key")).withColumn("node", F.col("key"))
    return star_graph.walk(roots, star_graph.layers(spark, sf))


@query(f"""
WITH e AS (SELECT src, dst, 'calls:' || src || '->' || dst AS key FROM ({EDGES_SQL})),
b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e),
d1 AS (SELECT 'c:1' AS node UNION SELECT dst FROM b WHERE src = 'c:1'),
d2 AS (SELECT node FROM d1 UNION SELECT b.dst FROM b JOIN d1 ON b.src = d1.node)
SELECT 'node' AS what, node AS id FROM d2
UNION ALL SELECT DISTINCT 'edge', key FROM e WHERE src IN (SELECT node FROM d1) OR dst IN (SELECT node FROM d1)""")
def neighborhood_depth2(spark: SparkSession, sf: str) -> DataFrame:
    null = F.lit(None).cast("string").alias("deleted_at")
    nodes = star_graph.nodes(spark, sf).select(F.col("node").alias("id"), null)
    edges = star_graph.edges(spark, sf).select(identity.edge_key(F.lit("calls"), F.col("src"), F.col("dst")).alias("key"), F.col("src").alias("src_id"), F.col("dst").alias("dst_id"), null)
    near, among = graph.neighborhood(nodes, edges, "c:1", 2)
    return near.select(F.lit("node").alias("what"), "id").union(among.select(F.lit("edge"), "key"))


@query(f"""
WITH RECURSIVE e AS ({EDGES_SQL}), r AS (
  SELECT 'n:' || n_nationkey AS key, 'n:' || n_nationkey AS node FROM nation
  UNION SELECT r.key, e.dst FROM r JOIN e ON e.src = r.node)
SELECT key AS flow_id, key AS entry_point, count(*) AS member_count, false AS is_unattributed FROM r GROUP BY key
UNION ALL SELECT 'agentic.flow:unattributed', NULL, count(*), true FROM ({NODES_SQL}) n WHERE node NOT IN (SELECT node FROM r) HAVING count(*) > 0""")
def skeleton_flows(spark: SparkSession, sf: str) -> DataFrame:
    nodes = star_graph.nodes(spark, sf).select(F.col("node").alias("symbol_id"), F.col("node").alias("flow_id"))
    starts = table(spark, sf, "nation").select(F.concat(F.lit("n:"), s("n_nationkey")).alias("symbol_id"))
    return flows.ranked(flows.skeleton_flows(nodes, star_graph.edges(spark, sf), starts))


@query(f"""
WITH RECURSIVE e AS ({EDGES_SQL}), r AS (
  SELECT 'n:' || n_nationkey AS node FROM nation WHERE n_regionkey = 0
  UNION SELECT e.dst FROM r JOIN e ON e.src = r.node)
SELECT node AS symbol_id FROM ({NODES_SQL}) n WHERE node NOT IN (SELECT node FROM r)""")
def unattributed_nodes(spark: SparkSession, sf: str) -> DataFrame:
    starts = table(spark, sf, "nation").filter("n_regionkey = 0").select(F.concat(F.lit("n:"), s("n_nationkey")).alias("symbol_id"))
    return flows.unattributed(star_graph.nodes(spark, sf).withColumnRenamed("node", "symbol_id"), star_graph.edges(spark, sf), starts)


@query("""
WITH m AS (SELECT o_custkey AS c, min('o:' || o_orderkey) AS low FROM orders GROUP BY 1)
SELECT 'o:' || o_orderkey AS node, 'c:' || o_custkey AS root FROM orders
UNION ALL SELECT 'c:' || c, 'c:' || c FROM m""")
def connected_components(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "orders").select(F.concat(F.lit("o:"), s("o_orderkey")).alias("src"), F.concat(F.lit("c:"), s("o_custkey")).alias("dst"))
    return graph.components(own)


@query("""
SELECT DISTINCT 'n:' || c_nationkey AS src, 'n:' || s_nationkey AS dst, 1.0::DOUBLE AS confidence
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
WHERE c_nationkey <> s_nationkey""")
def contract_edges(spark: SparkSession, sf: str) -> DataFrame:
    edges = table(spark, sf, "lineitem").select(F.concat(F.lit("o:"), s("l_orderkey")).alias("src"), F.concat(F.lit("s:"), s("l_suppkey")).alias("dst"))
    nation = lambda c: F.concat(F.lit("n:"), s(c)).alias("group")
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.concat(F.lit("o:"), s("o_orderkey")).alias("leaf"), nation("c_nationkey"))
    suppliers = table(spark, sf, "supplier").select(F.concat(F.lit("s:"), s("s_suppkey")).alias("leaf"), nation("s_nationkey"))
    return graph.contract(edges, orders.union(suppliers))


@query("""
WITH v AS (SELECT 's:' || s_suppkey AS node FROM supplier WHERE s_acctbal > 5000),
e AS (SELECT 's:' || s_suppkey AS src, 'n:' || s_nationkey AS dst FROM supplier)
SELECT node FROM v UNION SELECT dst FROM e WHERE src IN (SELECT node FROM v) UNION SELECT src FROM e WHERE dst IN (SELECT node FROM v)""")
def one_hop(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "supplier")
    edges = own.select(F.concat(F.lit("s:"), s("s_suppkey")).alias("src"), F.concat(F.lit("n:"), s("s_nationkey")).alias("dst"))
    return graph.one_hop(own.filter("s_acctbal > 5000").select(F.concat(F.lit("s:"), s("s_suppkey")).alias("node")), edges)[0]


@query("SELECT user_id AS node, arg_min(event_type, event_id) AS neighbor FROM events GROUP BY 1")
def first_neighbor(spark: SparkSession, sf: str) -> DataFrame:
    return graph.first_neighbor(table(spark, sf, "events").select(F.col("user_id").alias("src"), F.col("event_type").alias("dst"), F.col("event_id").alias("pos")))


@query("""
SELECT l_orderkey AS src, l_suppkey AS dst, CASE WHEN c_nationkey = s_nationkey THEN c_nationkey::VARCHAR ELSE '' END AS container, count(*) AS n
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL""")
def edge_containers(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem")
    edges = line.select(F.concat(F.lit("o:"), s("l_orderkey")).alias("src"), F.concat(F.lit("s:"), s("l_suppkey")).alias("dst"))
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.concat(F.lit("o:"), s("o_orderkey")).alias("node"), s("c_nationkey").alias("module"))
    modules = orders.union(table(spark, sf, "supplier").select(F.concat(F.lit("s:"), s("s_suppkey")), s("s_nationkey")))
    key = lambda c: F.substring(c, F.lit(3), F.length(c)).cast("long").alias(c)
    # Counted where the edges lie, by the ends as they are; numbers are made of them afterwards.
    boxes = graph.edge_containers(edges, modules, tasks(spark, line.count()))
    return boxes.groupBy("src", "dst", "container").agg(F.count(F.lit(1)).alias("n")).select(key("src"), key("dst"), "container", "n")


@query("""
SELECT p_brand AS src_id, p_partkey::VARCHAR AS dst_id, 'code.contains:' || p_brand || '->' || p_partkey AS key FROM part""")
def module_scaffold(spark: SparkSession, sf: str) -> DataFrame:
    return flows.module_scaffold(table(spark, sf, "part").select(s("p_partkey").alias("leaf"), F.col("p_brand").alias("group")))[1]


@query("SELECT p_brand AS module, count(*) AS n FROM part GROUP BY 1")
def module_member_count(spark: SparkSession, sf: str) -> DataFrame:
    return view.member_counts(table(spark, sf, "part").select(F.col("p_brand").alias("src_id"), s("p_partkey").alias("dst_id")))


# -- joins -------------------------------------------------------------------


@query("SELECT o_orderkey::VARCHAR AS key FROM orders WHERE EXISTS (SELECT 1 FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey = o_orderkey AND p_size <= 3)")
def edges_by_file(spark: SparkSession, sf: str) -> DataFrame:
    from strataweave.sources.store import edges_for_files

    prov = table(spark, sf, "lineitem").select(s("l_orderkey").alias("edge_key"), s("l_partkey").alias("source_file"))
    files = table(spark, sf, "part").filter("p_size <= 3").select(s("p_partkey").alias("path"))
    return edges_for_files(table(spark, sf, "orders").select(s("o_orderkey").alias("key")), prov, files)


@query("SELECT o_orderkey::VARCHAR AS path FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def orphans(spark: SparkSession, sf: str) -> DataFrame:
    starts = table(spark, sf, "orders").select(s("o_orderkey").alias("path"), F.lit(False).alias("is_test"))
    docs = table(spark, sf, "lineitem").select(F.lit("code.literal-doc").alias("kind"), s("l_orderkey").alias("src_id"), F.concat(F.lit("p:"), s("l_partkey")).alias("dst_id"), F.lit(None).cast("string").alias("deleted_at"))
    return bridges.orphan_entry_points(starts, docs)


@query("SELECT event_id::VARCHAR AS run_id, event_type FROM events WHERE event_id NOT IN (SELECT doc_id FROM labels)")
def ungraded_queue(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "events").select(s("event_id").alias("run_id"), "event_type")
    return inspect.ungraded(runs, table(spark, sf, "labels").select(s("doc_id").alias("run_id")))


@query("""
WITH r AS (SELECT event_id AS record_id, user_id, ts FROM events WHERE event_type = 'error'),
p AS (SELECT event_id AS pos, user_id, ts AS launch_at, ts + INTERVAL 1 HOUR AS result_at FROM events WHERE event_type = 'click'),
j AS (SELECT record_id, pos, launch_at,
  CASE WHEN pos IS NULL THEN NULL WHEN ts BETWEEN launch_at AND result_at THEN 2 WHEN launch_at <= ts THEN 1 ELSE 0 END AS match
  FROM r LEFT JOIN p ON p.user_id = r.user_id),
n AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY match DESC NULLS LAST, CASE WHEN match = 1 THEN epoch_us(launch_at) ELSE 0 END DESC, pos DESC NULLS LAST) AS n FROM j)
SELECT record_id, pos AS span, match FROM n WHERE n = 1""")
def span_asof(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    records = e.filter("event_type = 'error'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("record_id"))
    spans = e.filter("event_type = 'click'").select("user_id", F.col("ts").alias("launch_at"), F.expr("ts + INTERVAL 1 HOUR").alias("result_at"), F.col("event_id").alias("pos"))
    return trajectory.match_spans(records, spans, ["user_id"]).select("record_id", F.col("span.pos").alias("span"), "match")


@query("""
WITH m AS (SELECT DISTINCT l_suppkey AS f, l_partkey AS node FROM lineitem), big AS (
  SELECT DISTINCT l_partkey AS node FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey < 20)
SELECT s_suppkey::VARCHAR AS flow_id FROM supplier WHERE s_acctbal >= 0 AND s_suppkey IN (SELECT f FROM m)
  AND NOT EXISTS (SELECT 1 FROM m WHERE f = s_suppkey AND node NOT IN (SELECT node FROM big))""")
def flow_subsumption(spark: SparkSession, sf: str) -> DataFrame:
    line, supp = table(spark, sf, "lineitem"), table(spark, sf, "supplier")
    members = line.select(s("l_suppkey").alias("flow_id"), s("l_partkey").alias("node")).distinct()
    new = line.join(supp.filter("s_nationkey < 20"), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").select(s("l_partkey").alias("node"))
    seeds = members.select("flow_id", F.col("flow_id").alias("symbol_id")).distinct()
    odd = supp.filter("s_acctbal < 0").select(s("s_suppkey").alias("symbol_id"))
    none = members.select("flow_id").limit(0)
    return reconcile.subsumed(supp.select(s("s_suppkey").alias("flow_id")), members, new, seeds, odd, none)


# -- resolution --------------------------------------------------------------

FRESH_SQL = """
base AS (SELECT 'd' || doc_id AS symbol_path, sha256(text) AS content_hash FROM documents),
fresh AS (SELECT CASE WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 THEN 'm' ELSE 'd' END || doc_id AS symbol_path,
  sha256(CASE WHEN doc_id % 5 = 0 OR doc_id % 11 = 0 THEN text || 'x' ELSE text END) AS content_hash FROM documents),
v AS (SELECT b.symbol_path, b.content_hash, f.content_hash AS now,
  (SELECT min(o.symbol_path) FROM fresh o WHERE o.content_hash = b.content_hash AND o.symbol_path <> b.symbol_path) AS moved
  FROM base b LEFT JOIN fresh f ON f.symbol_path = b.symbol_path),
r AS (SELECT symbol_path,
  CASE WHEN now = content_hash THEN 'hit' WHEN now IS NOT NULL OR moved IS NOT NULL THEN 'downgrade' ELSE 'miss' END AS status,
  CASE WHEN now <> content_hash THEN 'body-changed' WHEN now IS NULL AND moved IS NOT NULL THEN 'relocated' END AS reason,
  CASE WHEN now IS NOT NULL THEN symbol_path ELSE moved END AS new_path FROM v)"""


def _states(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf, "documents")
    base = d.select(F.concat(F.lit("d"), s("doc_id")).alias("symbol_path"), text.span_hash(F.col("text")).alias("content_hash"))
    moved = F.when((F.col("doc_id") % 7 == 0) | (F.col("doc_id") % 11 == 0), "m").otherwise("d")
    body = F.when((F.col("doc_id") % 5 == 0) | (F.col("doc_id") % 11 == 0), F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    return base, d.select(F.concat(moved, s("doc_id")).alias("symbol_path"), text.span_hash(body).alias("content_hash"))


@query(f"WITH {FRESH_SQL} SELECT * FROM r")
def resolve_anchor(spark: SparkSession, sf: str) -> DataFrame:
    base, fresh = _states(spark, sf)
    return resolve.resolve_anchors(base, fresh).select("symbol_path", "status", "reason", "new_path")


@query(f"""
WITH {FRESH_SQL}
SELECT CASE WHEN status = 'miss' THEN 'removed' WHEN reason = 'relocated' THEN 'relocated' ELSE 'modified' END AS bucket,
  symbol_path, CASE WHEN reason = 'relocated' THEN new_path END AS to_path FROM r WHERE status <> 'hit'
UNION ALL SELECT 'added', symbol_path, NULL FROM fresh
WHERE symbol_path NOT IN (SELECT symbol_path FROM base) AND symbol_path NOT IN (SELECT new_path FROM r WHERE reason = 'relocated')""")
def symbol_delta(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.symbol_delta(*_states(spark, sf))


@query(f"""
WITH {FRESH_SQL}, w AS (SELECT new_path AS new_id, min(symbol_path) AS id FROM r WHERE reason = 'relocated' GROUP BY 1)
SELECT id, new_id FROM w WHERE new_id NOT IN (SELECT symbol_path FROM r WHERE status <> 'miss')""")
def rekey_plan(spark: SparkSession, sf: str) -> DataFrame:
    base, fresh = _states(spark, sf)
    nodes = base.select(F.col("symbol_path").alias("id"), "symbol_path", "content_hash")
    return resolve.rekeys(resolve.verdicts(nodes, fresh), nodes)[0].select("id", "new_id")


@query("SELECT sha256(text) AS content_hash, min('d' || doc_id) AS first, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_groups(spark: SparkSession, sf: str) -> DataFrame:
    states = table(spark, sf, "documents").select(F.concat(F.lit("d"), s("doc_id")).alias("symbol_path"), text.span_hash(F.col("text")).alias("content_hash"))
    pairs = resolve.by_content(states).filter("second IS NOT NULL").select("content_hash", "first")
    return pairs.join(states.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n")), "content_hash")


@query("SELECT p_name AS symbol_path, min(p_partkey) AS p_partkey, count(*) - 1 AS dropped FROM part GROUP BY 1")
def first_wins_index(spark: SparkSession, sf: str) -> DataFrame:
    kept, dropped = resolve.deduplicated_index(table(spark, sf, "part").select(F.col("p_name").alias("symbol_path"), "p_partkey"), "p_partkey")
    n = dropped.groupBy("symbol_path").agg(F.count(F.lit(1)).alias("dropped"))
    return kept.join(n, "symbol_path", "left").withColumn("dropped", F.coalesce("dropped", F.lit(0)))


# -- tiers and layers --------------------------------------------------------


@query("""
WITH c AS (SELECT c_custkey::VARCHAR AS target, c_mktsegment AS old, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'raw' WHEN 2 THEN 'agentic' ELSE 'user' END AS owner,
  CASE c_custkey % 3 WHEN 0 THEN 'raw' WHEN 1 THEN 'agentic' ELSE 'user' END AS tier FROM customer),
k AS (SELECT *, CASE tier WHEN 'user' THEN 2 WHEN 'agentic' THEN 1 ELSE 0 END >= CASE owner WHEN 'user' THEN 2 WHEN 'agentic' THEN 1 ELSE 0 END AS landed FROM c)
SELECT target, 'segment' AS field, CASE WHEN landed THEN 'new-' || target ELSE old END AS value, CASE WHEN landed THEN tier ELSE owner END AS owner, landed FROM k""")
def ladder_write(spark: SparkSession, sf: str) -> DataFrame:
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    owner = F.when(k % 4 == 1, "raw").when(k % 4 == 2, "agentic").when(k % 4 == 3, "user")
    tier = F.when(k % 3 == 0, "raw").when(k % 3 == 1, "agentic").otherwise("user")
    now = c.select(s("c_custkey").alias("target"), F.lit("segment").alias("field"), F.col("c_mktsegment").alias("value"), owner.alias("owner"))
    return ladder.ladder_write(now, c.select(s("c_custkey").alias("target"), F.lit("segment").alias("field"), F.concat(F.lit("new-"), s("c_custkey")).alias("value"), tier.alias("tier")))


@query("""
WITH f AS (
  SELECT c_custkey AS id, 'name' AS field, c_name AS value, 0 AS ord FROM customer UNION ALL SELECT c_custkey, 'segment', c_mktsegment, 0 FROM customer
  UNION ALL SELECT c_custkey, 'segment', 'OVERLAY', 1 FROM customer WHERE c_mktsegment = 'BUILDING'
  UNION ALL SELECT c_custkey, 'note', 'user', 2 FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, 'segment', 'USER', 2 FROM customer WHERE c_acctbal < 0)
SELECT id, field, arg_max(value, ord) AS value FROM f GROUP BY ALL""")
def layer_fold(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    f = lambda d, field, value, ord_: d.select(F.col("c_custkey").alias("id"), F.lit(field).alias("field"), value.alias("value"), F.lit(ord_).alias("ord"))
    four, six = c.filter("c_mktsegment = 'BUILDING'"), c.filter("c_acctbal < 0")
    parts = [f(c, "name", F.col("c_name"), 0), f(c, "segment", F.col("c_mktsegment"), 0), f(four, "segment", F.lit("OVERLAY"), 1), f(six, "note", F.lit("user"), 2), f(six, "segment", F.lit("USER"), 2)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return ladder.fold_fields(out)


# -- descriptions and inspection ---------------------------------------------


@query("""
WITH m AS (SELECT d.doc_id, 'd' || lpad(d.doc_id::VARCHAR, 12, '0') AS symbol_path, quality = 1 AND toxic = 0 AS doc, toxic = 1 AS cached FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
o AS (SELECT symbol_path, row_number() OVER (ORDER BY symbol_path) AS n FROM m WHERE NOT coalesce(doc, false) AND NOT coalesce(cached, false))
SELECT m.symbol_path, CASE WHEN cached THEN 'cached' WHEN doc THEN 'docstring' WHEN o.n <= 200 THEN 'llm' ELSE 'placeholder' END AS bucket
FROM m LEFT JOIN o ON o.symbol_path = m.symbol_path""")
def describe_plan(spark: SparkSession, sf: str) -> DataFrame:
    path = lambda: F.concat(F.lit("d"), F.lpad(s("doc_id"), 12, "0")).alias("symbol_path")
    d, labels = table(spark, sf, "documents").select("doc_id", "text", "source"), table(spark, sf, "labels")
    rows = d.join(labels, "doc_id", "left")
    told = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), F.col("source"))
    members = rows.select(path(), text.span_hash(F.col("text")).alias("content_hash"), F.col("source").alias("name"), told.alias("docstring"))
    known = rows.filter("toxic = 1").select(path(), text.span_hash(F.col("text")).alias("content_hash"))
    return descriptions.plan(members, known).select("symbol_path", "bucket")


@query("""
WITH b AS (SELECT source AS key, CASE lang WHEN 'en' THEN 'docstring' WHEN 'de' THEN 'llm' WHEN 'fr' THEN 'placeholder' ELSE 'none' END AS k FROM documents)
SELECT key, count(*) FILTER (k = 'docstring') AS docstring, count(*) FILTER (k = 'provisional') AS provisional, count(*) FILTER (k = 'placeholder') AS placeholder,
  count(*) FILTER (k = 'llm') AS llm, count(*) FILTER (k = 'none') AS none, count(*) AS total FROM b GROUP BY 1""")
def description_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("lang") == "en", "docstring").when(F.col("lang") == "de", "llm").when(F.col("lang") == "fr", "placeholder").otherwise("other")
    return descriptions.breakdown(table(spark, sf, "documents").select(F.col("source").alias("key"), kind.alias("source")), ["key"])


@query("""
WITH c AS (SELECT n_nationkey, count(c_custkey) FILTER (c_acctbal > 9900) AS member_count, n_nationkey % 2 = 0 AS live FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL),
t AS (SELECT count(*) FILTER (lang = 'fr') AS names, count(*) FILTER (lang = 'de') AS llm FROM documents)
SELECT 'empty_flow' AS code, 'n' || n_nationkey AS flow_id, 'flow n' || n_nationkey || ' has 0 members' AS message FROM c WHERE live AND member_count = 0
UNION ALL SELECT 'unpersisted_bridges', NULL, '3 bridge(s) proposed but 0 are persisted'
UNION ALL SELECT 'high_placeholder_ratio', NULL, names || '/' || (names + llm) || ' agentic descriptions are placeholders (' || floor(names * 100 / (names + llm) + 0.5)::BIGINT || '%)' FROM t
WHERE names + llm >= 5 AND names / (names + llm) >= 0.5""")
def anomalies(spark: SparkSession, sf: str) -> DataFrame:
    rich = table(spark, sf, "customer").filter("c_acctbal > 9900").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    nations = table(spark, sf, "nation").join(rich, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    summaries = nations.select(F.concat(F.lit("n"), s("n_nationkey")).alias("flow_id"), (F.col("n_nationkey") % 2 == 0).alias("live"), F.coalesce("n", F.lit(0)).alias("member_count"))
    d = table(spark, sf, "documents")
    totals = d.agg(F.count_if(F.lit(False)).alias("provisional"), F.count_if(F.col("lang") == "fr").alias("placeholder"), F.count_if(F.col("lang") == "de").alias("llm"), F.lit(3).alias("proposed"), F.lit(0).alias("bridges"))
    return inspect.anomalies(summaries, totals)


@query("""
WITH w AS (SELECT o_custkey, o_orderdate < TIMESTAMP '1995-06-01' AS early, list_sort(list(DISTINCT o_orderpriority)) AS p, count(*) AS n FROM orders GROUP BY ALL),
a AS (SELECT * FROM w WHERE early), b AS (SELECT * FROM w WHERE NOT early)
SELECT coalesce(a.o_custkey, b.o_custkey)::VARCHAR AS flow_id, CASE WHEN a.o_custkey IS NULL THEN 'added' WHEN b.o_custkey IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.o_custkey = b.o_custkey WHERE a.o_custkey IS NULL OR b.o_custkey IS NULL OR a.p <> b.p OR a.n <> b.n""")
def flow_diff(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    zero = [F.lit(0).cast("long").alias(c) for c in (*descriptions.SOURCES, "none")]

    def summary(rows: DataFrame) -> DataFrame:
        got = rows.groupBy(s("o_custkey").alias("flow_id")).agg(F.collect_set("o_orderpriority").alias("anchor_set"), F.count(F.lit(1)).alias("bridge_count"))
        return got.select("*", F.lit(True).alias("live"), F.array().cast("array<string>").alias("entry_points"), *zero)

    return inspect.flow_diff(summary(o.filter("o_orderdate < TIMESTAMP '1995-06-01'")), summary(o.filter("o_orderdate >= TIMESTAMP '1995-06-01'")))


@query("""
WITH x AS (SELECT DISTINCT s_nationkey AS src_id, p FROM (SELECT s_nationkey, s_suppkey % 5 AS p, (s_acctbal < 0)::INT AS h FROM supplier) WHERE h = 0),
y AS (SELECT DISTINCT s_nationkey AS src_id, p FROM (SELECT s_nationkey, s_suppkey % 5 AS p, (s_acctbal < 0)::INT AS h FROM supplier) WHERE h = 1)
SELECT src_id, p AS dst_id, 'removed' AS change FROM (SELECT * FROM x EXCEPT SELECT * FROM y) UNION ALL SELECT src_id, p, 'added' FROM (SELECT * FROM y EXCEPT SELECT * FROM x)""")
def bridge_diff(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("src_id"), (F.col("s_suppkey") % 5).alias("dst_id"), (F.col("s_acctbal") < 0).cast("int").alias("h"))
    return inspect.bridge_diff(own.filter("h = 0").drop("h"), own.filter("h = 1").drop("h"))


@query("SELECT event_type AS action, count(*) AS n FROM events GROUP BY 1")
def outcome_counts(spark: SparkSession, sf: str) -> DataFrame:
    return inspect.outcome_counts(table(spark, sf, "events").select(F.col("event_type").alias("action"), F.col("event_id").alias("pos")))


# -- agreement, logs ---------------------------------------------------------

GRADES_SQL = """
h AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS v FROM labels),
j AS (SELECT doc_id, CASE WHEN lang IS NULL THEN 'mixed' WHEN length(text) < 1500 THEN 'bad' ELSE 'good' END AS v FROM documents)"""


def _grades(spark: SparkSession, sf: str) -> DataFrame:
    human = table(spark, sf, "labels").select(s("doc_id").alias("run_id"), F.when(F.col("quality") == 1, "good").otherwise("bad").alias("verdict"))
    told = F.when(F.col("lang").isNull(), "mixed").when(F.length("text") < 1500, "bad").otherwise("good")
    judge = table(spark, sf, "documents").select(s("doc_id").alias("run_id"), told.alias("verdict"))
    return agreement.joined(human, judge)


@query(f"WITH {GRADES_SQL} SELECT h.v || '->' || j.v AS cell, count(*) AS n FROM h JOIN j ON h.doc_id = j.doc_id GROUP BY 1")
def calibration(spark: SparkSession, sf: str) -> DataFrame:
    return agreement.confusion(_grades(spark, sf))


@query(f"""
WITH {GRADES_SQL}, f AS (SELECT h.v AS a, j.v AS b FROM h FULL JOIN j ON h.doc_id = j.doc_id)
SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS joined, count(*) FILTER (a = b) AS agreed,
  round(count(*) FILTER (a = b) / count(*) FILTER (a IS NOT NULL AND b IS NOT NULL), 4) AS agreement,
  count(*) FILTER (b IS NULL) AS human_only, count(*) FILTER (a IS NULL) AS judge_only FROM f""")
def calibration_report(spark: SparkSession, sf: str) -> DataFrame:
    return agreement.report(_grades(spark, sf)).withColumn("agreement", F.round("agreement", 4))


@query("""
WITH k AS (SELECT *, struct_pack(ts := ts, event_id := event_id) AS k FROM events)
SELECT user_id, arg_max(event_type, k) AS event_type, max(k).event_id AS event_id FROM k GROUP BY 1""")
def last_wins_register(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", "event_type", "event_id", F.struct("ts", "event_id").alias("pos"))
    return flows.last_wins(rows, ["user_id"], "pos").select("user_id", "event_type", "event_id")


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def latest_run(spark: SparkSession, sf: str) -> DataFrame:
    from strataweave.sources.logs import latest

    return latest(table(spark, sf, "events").withColumn("line_no", F.struct("ts", "event_id"))).select("event_id", "event_type")


@query("SELECT conv_id, role, min(turn) AS first_turn FROM conversations WHERE turn >= 1 GROUP BY ALL")
def worked_on_since(spark: SparkSession, sf: str) -> DataFrame:
    from strataweave.streaming.incremental import first_seen

    return first_seen(table(spark, sf, "conversations").select("conv_id", "role", "turn"), ["conv_id", "role"], "turn", 1).withColumnRenamed("first", "first_turn")


# -- documents, search, bags -------------------------------------------------


@query("""SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"#]*)', 1)) AS target FROM pages""")
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"#]*)'), F.lit(1))).alias("target"))


@query("""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"#]*)', 1)) AS t FROM pages)
SELECT page_id, count(*) FILTER (regexp_matches(t, '^(~|/|[a-zA-Z][a-zA-Z0-9+.-]*:)')) AS outside, count(*) FILTER (NOT regexp_matches(t, '^(~|/|[a-zA-Z][a-zA-Z0-9+.-]*:)')) AS inside FROM l GROUP BY 1""")
def external_targets(spark: SparkSession, sf: str) -> DataFrame:
    out = predicates.external_target(F.col("target"))
    return page_links(spark, sf).groupBy("page_id").agg(F.count_if(out).alias("outside"), F.count_if(~out).alias("inside"))


SCORE_SQL = "CASE WHEN n = 'ring' THEN 100 WHEN n LIKE 'ring%' THEN 80 WHEN n LIKE '%ring%' THEN 60 WHEN d LIKE '%ring%' THEN 40 WHEN n LIKE '%r%i%n%g%' THEN 30 ELSE 0 END::DOUBLE"


@query(f"""
SELECT p_partkey, p_name, {SCORE_SQL} AS score FROM (SELECT p_partkey, p_name, lower(p_name) AS n, lower(p_type) AS d FROM part)
WHERE {SCORE_SQL} > 0 ORDER BY score DESC, p_partkey LIMIT 10""")
def search_topk(spark: SparkSession, sf: str) -> DataFrame:
    return search.top_k(table(spark, sf, "part").select("p_partkey", "p_name", "p_type"), "ring", "p_name", "p_type", "p_partkey").select("p_partkey", "p_name", "score")


TOKENS_SQL = r"list_filter(regexp_split_to_array(lower(regexp_replace({}, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda x: len(x) > 1)"
STOP_SQL = "[" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + "]"


@query(f"""
WITH t AS (SELECT page_id, {TOKENS_SQL.format("url")} AS names, {TOKENS_SQL.format("html")} AS words FROM pages)
SELECT page_id, len(words) AS n_tokens, len(list_filter(words, lambda w: NOT list_contains({STOP_SQL}, w) AND len(list_filter(names, lambda n: n = w
  OR (least(len(n), len(w)) >= 3 AND (starts_with(w, n) OR starts_with(n, w))) OR (least(len(n), len(w)) >= 4 AND left(n, 4) = left(w, 4)))) = 0)) = 0 AS restates FROM t""")
def name_restatement(spark: SparkSession, sf: str) -> DataFrame:
    name, told = F.col("url"), F.col("html")
    return table(spark, sf, "pages").select("page_id", F.size(text.tokens(told)).cast("long").alias("n_tokens"), text.name_restatement(name, told).alias("restates"))


@query("SELECT event_id, (props->>'k')::DOUBLE AS k, CASE WHEN json_type(props, '$.k') = 'VARCHAR' THEN props->>'k' END AS k_text FROM events")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", bag.number_at(F.col("props"), "k").alias("k"), bag.string_at(F.col("props"), "k").alias("k_text"))


# -- caps, views, incremental ------------------------------------------------


@query("""
WITH b AS (SELECT 'b:' || lpad(l_orderkey::VARCHAR, 10, '0') AS key, max(l_returnflag) AS f FROM lineitem GROUP BY 1),
n AS (SELECT *, row_number() OVER (ORDER BY key) AS n FROM b)
SELECT key, CASE WHEN n > 500 THEN 'truncated' WHEN f = 'R' THEN 'preserved' ELSE 'write' END AS outcome FROM n""")
def write_caps(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").groupBy(F.concat(F.lit("b:"), F.lpad(s("l_orderkey"), 10, "0")).alias("key")).agg(F.max("l_returnflag").alias("f"))
    null = F.lit(None).cast("string")
    kept = rows.filter("f = 'R'").select("key", F.lit("user").alias("layer"), null.alias("adjudication"), null.alias("deleted_at"))
    return bridges.accepted(rows.select("key"), kept).select("key", "outcome")


@query("""
WITH n AS (SELECT 'f' || lpad(p_partkey::VARCHAR, 9, '0') AS flow_id FROM part)
SELECT flow_id, CASE WHEN row_number() OVER (ORDER BY flow_id) <= 50 THEN 'full' ELSE 'stub' END AS mode FROM n""")
def hydration_cap(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile.hydration_plan(table(spark, sf, "part").select(F.concat(F.lit("f"), F.lpad(s("p_partkey"), 9, "0")).alias("flow_id")))


@query("""
SELECT 'agentic.bridge:' || l_suppkey || '->' || l_partkey AS key, l_suppkey::VARCHAR AS src_id, l_partkey::VARCHAR AS dst_id, arg_min(l_returnflag, o) AS inference_rationale,
  count(DISTINCT l_orderkey) AS provenance
FROM (SELECT *, struct_pack(a := l_orderkey, b := l_linenumber, c := l_extendedprice, d := l_returnflag) AS o FROM lineitem) GROUP BY ALL""")
def bridge_builder(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem")
    rows = line.select(s("l_suppkey").alias("src_id"), s("l_partkey").alias("dst_id"), F.col("l_returnflag").alias("inference_rationale"), s("l_orderkey").alias("source_file"), F.lit("1:0-1:0").alias("source_range"),
                       F.lit("x").alias("extractor_id"), F.lit("1").alias("extractor_version"), F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag").alias("ordinal"))
    edges, prov = bridges.build(rows)
    n = prov.groupBy(F.col("edge_key").alias("key")).agg(F.count(F.lit(1)).alias("provenance"))
    return edges.drop("kind").join(n, "key")


@query("""
WITH t AS (SELECT s_nationkey::VARCHAR AS parent, s_suppkey % 100 * 10.0 AS x, s_suppkey % 37 * 7.0 AS y, 200.0 AS w, 100.0 AS h FROM supplier)
SELECT parent, min(x) - 20 AS x, min(y) - 60 AS y, max(x + w) - min(x) + 40 AS width, max(y + h) - min(y) + 80 AS height FROM t GROUP BY 1""")
def bounding_boxes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    boxes = table(spark, sf, "supplier").select(s("s_nationkey").alias("parent"), (k % 100 * 10.0).alias("x"), (k % 37 * 7.0).alias("y"), F.lit(200.0).alias("width"), F.lit(100.0).alias("height"))
    return view.bounding_boxes(boxes)


@query("SELECT p_partkey FROM part WHERE p_size * 50 + 200 >= 400 AND p_size * 50 <= 1600 AND p_retailprice + 100 >= 900 AND p_retailprice <= 1600")
def viewport_cull(spark: SparkSession, sf: str) -> DataFrame:
    null = F.lit(None).cast("double")
    boxes = table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 50).alias("x"), F.col("p_retailprice").alias("y"), null.alias("width"), null.alias("height"))
    return view.culled(boxes, (500, 1000, 1500, 1500)).select("p_partkey")


@query("""
WITH s AS (SELECT s_suppkey, list_sort(list(DISTINCT l_partkey::VARCHAR)) AS m FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1),
n AS (SELECT s_suppkey, list_sort(list(DISTINCT l_partkey::VARCHAR)) AS m FROM supplier JOIN lineitem ON l_suppkey = s_suppkey WHERE l_returnflag <> 'R' OR s_suppkey % 2 = 0 GROUP BY 1),
b AS (SELECT DISTINCT l_suppkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size = 1 AND (l_returnflag <> 'R' OR l_suppkey % 2 = 0))
SELECT s.s_suppkey::VARCHAR AS flow_id, CASE WHEN b.l_suppkey IS NOT NULL AND n.m IS DISTINCT FROM s.m THEN 'body,membership' WHEN b.l_suppkey IS NOT NULL THEN 'body' ELSE 'membership' END AS reasons
FROM s LEFT JOIN n ON n.s_suppkey = s.s_suppkey LEFT JOIN b ON b.l_suppkey = s.s_suppkey WHERE b.l_suppkey IS NOT NULL OR n.m IS DISTINCT FROM s.m""")
def affected_flows(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem")
    members = lambda d: d.select(s("l_suppkey").alias("flow_id"), s("l_partkey").alias("path")).distinct()
    changed = table(spark, sf, "part").filter("p_size = 1").select(s("p_partkey").alias("path"))
    hit = reconcile.affected_members(members(line), members(line.filter("l_returnflag <> 'R' OR l_suppkey % 2 = 0")), changed)
    return reconcile.reasons_of(hit).select("flow_id", F.array_join("reasons", ",").alias("reasons"))


@query("""
WITH t AS (SELECT event_id, user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 12 HOUR, true) AS fresh FROM events WHERE user_id IS NOT NULL),
g AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS burst FROM t)
SELECT user_id, min(ts) AS first, count(*) AS events FROM g GROUP BY user_id, burst""")
def debounced_bursts(spark: SparkSession, sf: str) -> DataFrame:
    from strataweave.streaming.incremental import debounced

    return debounced(table(spark, sf, "events").select("user_id", "ts"), "12 hours", "user_id", "ts").select("user_id", "first", "events")


@query("""
WITH w AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS k FROM orders WHERE o_custkey <= 200 GROUP BY 1),
v AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS k FROM orders WHERE o_custkey > 200 GROUP BY 1),
wn AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY o_custkey) AS n FROM w), vn AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY o_custkey) AS n FROM v)
SELECT 'missing' AS side, array_to_string(k, chr(10)) AS members, count(*) AS n FROM wn WHERE NOT EXISTS (SELECT 1 FROM vn WHERE vn.k = wn.k AND vn.n = wn.n) GROUP BY ALL
UNION ALL SELECT 'surplus', array_to_string(k, chr(10)), count(*) FROM vn WHERE NOT EXISTS (SELECT 1 FROM wn WHERE vn.k = wn.k AND vn.n = wn.n) GROUP BY ALL""")
def umbrella_score(spark: SparkSession, sf: str) -> DataFrame:
    sets = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("m"))
    want = sets.filter("o_custkey <= 200").select(F.col("o_custkey").alias("pos"), F.col("m").alias("members"))
    have = sets.filter("o_custkey > 200").select(F.col("o_custkey").alias("flow_id"), F.col("m").alias("anchor_set"), F.array(F.lit("a"), F.lit("b")).alias("entry_points"))
    return stitch.umbrella_score(want, have).groupBy("side", "members").agg(F.count(F.lit(1)).alias("n"))


from strataweave import queries_incremental, queries_more, queries_store, queries_views  # noqa: E402, F401  (register their queries)
