"""Registered queries of the store's writes and lookups, flows, claims and views, each with its SQL.

Stores begin with rows, so that replacing, revival and invalidation have something to work on.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.operators import bridges, flows, graph, inspect, resolve
from strataweave.plans import stitch
from strataweave.plans.star_graph import table
from strataweave.queries import query, s
from strataweave.queries_incremental import of
from strataweave.sources.store import TABLES, GraphStore
from strataweave.staging import shared_folder
from strataweave.streaming import follow

LATER = "2024-01-01T00:00:00Z"


def null() -> Column:
    return F.lit(None).cast("string")


def _store(spark: SparkSession) -> GraphStore:
    return GraphStore.open(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")


def _rows(df: DataFrame, name: str) -> DataFrame:
    """``df`` as rows of a store's table; columns that it lacks are null, bags are empty."""
    given = {"attributes": F.lit("{}"), "origin": F.lit("x"), "intent_source": F.lit("y"), "confidence": F.lit(1.0)}
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[name].fields))


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    layer = F.when(F.col("c_nationkey") < 8, "raw").when(F.col("c_nationkey") < 16, "agentic").otherwise("user")
    return table(spark, sf, "customer").select("c_acctbal", "c_nationkey", of("c:", "c_custkey").alias("id"), F.lit("code.function").alias("kind"), F.col("c_mktsegment").alias("path"), layer.alias("layer"))


# -- writes and lookups ------------------------------------------------------


@query(f"""
WITH c AS (SELECT 'c:' || c_custkey AS id, c_mktsegment AS path, CASE WHEN c_nationkey < 8 THEN 'raw' WHEN c_nationkey < 16 THEN 'agentic' ELSE 'user' END AS layer, c_acctbal AS b, c_nationkey AS n FROM customer)
SELECT id, CASE WHEN n % 2 = 0 THEN 'moved' ELSE path END AS path, layer, CASE WHEN b < 0 AND layer <> 'raw' AND n % 2 <> 0 THEN '{LATER}' END AS deleted_at FROM c""")
def revived_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes are written, some deleted, and half of them written again elsewhere, which replaces them and brings deleted ones back."""
    own, rows = _store(spark), _customers(spark, sf)
    own.upsert_nodes(_rows(rows, "nodes"))
    own.soft_delete(rows.filter("c_acctbal < 0").select("id"), LATER)
    own.upsert_nodes(_rows(rows.filter("c_nationkey % 2 = 0").withColumn("path", F.lit("moved")), "nodes"))
    return own.nodes(include_deleted=True).select("id", "path", "layer", "deleted_at")


STORED_EDGES_SQL = """
l AS (SELECT DISTINCT l_suppkey, l_partkey, 'f' || l_linenumber AS file FROM lineitem),
e AS (SELECT l_suppkey || '>' || l_partkey AS key, CASE WHEN l_partkey % 3 = 0 THEN 'agentic' ELSE 'raw' END AS layer, l_partkey FROM l GROUP BY ALL),
p AS (SELECT DISTINCT l_suppkey || '>' || l_partkey AS key, CASE WHEN l_partkey % 5 = 0 THEN 'new' ELSE file END AS source_file FROM l)"""


def _edge_store(spark: SparkSession, sf: str) -> GraphStore:
    """Edges of suppliers and parts with provenance by line number; those of each fifth part are written again with other provenance."""
    own, line = _store(spark), table(spark, sf, "lineitem")
    layer = F.when(F.col("l_partkey") % 3 == 0, "agentic").otherwise("raw")
    key = F.concat(s("l_suppkey"), F.lit(">"), s("l_partkey"))
    # Numbers are made distinct and texts made of them afterwards, so numbers only cross the network.
    one, each = (line.select("l_suppkey", "l_partkey", *more).distinct() for more in ((), ("l_linenumber",)))
    edges = one.select(key.alias("key"), s("l_suppkey").alias("src_id"), s("l_partkey").alias("dst_id"), F.lit("code.calls").alias("kind"), layer.alias("layer"), "l_partkey")
    prov = each.select(key.alias("edge_key"), of("f", "l_linenumber").alias("source_file"), F.lit("1:0-1:1").alias("source_range"), F.lit("x").alias("extractor_id"), F.lit("1").alias("extractor_version"), "l_partkey")
    own.upsert_edges(_rows(edges, "edges"), _rows(prov, "edge_provenance"))
    again = lambda d: d.filter("l_partkey % 5 = 0")
    new = again(edges).select(F.col("key").alias("edge_key"), F.lit("new").alias("source_file"), *(F.lit(v).alias(c) for c, v in (("source_range", "1:0-1:1"), ("extractor_id", "x"), ("extractor_version", "1"))))
    own.upsert_edges(_rows(again(edges), "edges"), _rows(new, "edge_provenance"))
    return own


@query(f"WITH {STORED_EDGES_SQL} SELECT e.key, layer, count(*) AS provenance, min(source_file) AS first FROM e JOIN p ON p.key = e.key GROUP BY ALL")
def stored_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges and all their provenance are replaced by a later write."""
    own = _edge_store(spark, sf)
    prov = own.table("edge_provenance").groupBy(F.col("edge_key").alias("key")).agg(F.count(F.lit(1)).alias("provenance"), F.min("source_file").alias("first"))
    return own.edges().join(prov, "key").select("key", "layer", "provenance", "first")


@query(f"""
WITH {STORED_EDGES_SQL}, g AS (SELECT DISTINCT p.key FROM p JOIN e ON e.key = p.key WHERE layer = 'raw' AND source_file IN ('f1', 'new'))
SELECT 'edge' AS what, key, 1 AS n FROM e WHERE key NOT IN (SELECT key FROM g) UNION ALL SELECT 'provenance', key, count(*) FROM p WHERE key NOT IN (SELECT key FROM g) GROUP BY key""")
def invalidated_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Raw edges with any provenance in given files go, with their provenance; upper tiers stay."""
    own = _edge_store(spark, sf)
    own.invalidate_edges(spark.createDataFrame([("f1",), ("new",)], "path string"))
    kept = own.edges().select(F.lit("edge").alias("what"), "key", F.lit(1).cast("long").alias("n"))
    return kept.unionByName(own.table("edge_provenance").groupBy(F.col("edge_key").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("provenance").alias("what"), "key", "n"))


@query(f"""
WITH {STORED_EDGES_SQL} SELECT DISTINCT e.key, p.source_file FROM e JOIN p ON p.key = e.key WHERE e.key IN (SELECT key FROM p WHERE source_file IN ('f2', 'f3'))""")
def edges_and_their_files(spark: SparkSession, sf: str) -> DataFrame:
    """Live edges with provenance in given files, and all files of each."""
    own = _edge_store(spark, sf)
    found = own.edges_for_files(spark.createDataFrame([("f2",), ("f3",)], "path string"))
    return found.join(own.table("edge_provenance"), F.col("key") == F.col("edge_key")).select("key", "source_file").distinct()


@query("""
WITH c AS (SELECT 'c:' || c_custkey AS id, CASE WHEN c_nationkey < 8 THEN 'raw' WHEN c_nationkey < 16 THEN 'agentic' ELSE 'user' END AS layer FROM customer)
SELECT id, layer FROM c WHERE layer <> 'agentic' UNION ALL SELECT 's:' || s_suppkey, 'agentic' FROM supplier""")
def rebuilt_layer(spark: SparkSession, sf: str) -> DataFrame:
    """One tier is dropped and filled anew in one version; the others stay."""
    own = _store(spark)
    own.upsert_nodes(_rows(_customers(spark, sf), "nodes"))
    fresh = table(spark, sf, "supplier").select(of("s:", "s_suppkey").alias("id"), F.lit("code.function").alias("kind"), F.lit("p").alias("path"), F.lit("agentic").alias("layer"))
    own.rebuild_layer("agentic", lambda st: st.upsert_nodes(_rows(fresh, "nodes")))
    return own.nodes().select("id", "layer")


@query("""
WITH a AS (SELECT 'c:' || c_custkey AS key, c_mktsegment AS p FROM customer WHERE c_acctbal > -500), b AS (SELECT 'c:' || c_custkey AS key, CASE WHEN c_nationkey = 3 THEN 'moved' ELSE c_mktsegment END AS p FROM customer WHERE c_acctbal > -500 AND c_nationkey <> 5 UNION ALL SELECT 's:' || s_suppkey, 'p' FROM supplier)
SELECT 'nodes' AS "table", coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.key = b.key WHERE a.p IS DISTINCT FROM b.p""")
def version_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Net changes over three commits: one moves rows, one adds some and some that go again, one removes."""
    own, rows = _store(spark), _customers(spark, sf).filter("c_acctbal > -500")
    own.upsert_nodes(_rows(rows.withColumn("layer", F.lit("raw")), "nodes"))
    was = own.version
    own.upsert_nodes(_rows(rows.filter("c_nationkey = 3").withColumns({"layer": F.lit("raw"), "path": F.lit("moved")}), "nodes"))
    more = table(spark, sf, "supplier").select(of("s:", "s_suppkey").alias("id"), F.lit("code.function").alias("kind"), F.lit("p").alias("path"), F.lit("raw").alias("layer"))
    own.upsert_nodes(_rows(more.unionByName(more.withColumns({"id": F.concat("id", F.lit("x")), "path": F.lit("gone")})), "nodes"))
    gone = rows.filter("c_nationkey = 5").select("id", F.col("id").alias("path"))
    own.commit(lambda t: {"nodes": t["nodes"].join(gone.select("id"), "id", "left_anti")})
    own.invalidate_nodes(spark.createDataFrame([("gone",)], "path string"))
    return own.diff(was)


# -- resolution and flows ----------------------------------------------------


@query("SELECT 'c:' || c_custkey AS id FROM customer WHERE c_nationkey >= 8 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal > 0")
def preserved_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Anchored nodes above the raw tier in changed files."""
    rows = _customers(spark, sf).withColumn("anchor", F.when(F.col("c_acctbal") > 0, F.concat("id", F.lit(":h"))))
    return resolve.preserved_in(rows, spark.createDataFrame([("BUILDING",), ("MACHINERY",)], "path string")).select("id")


@query("SELECT DISTINCT l_suppkey || '>' || l_partkey AS key FROM lineitem WHERE l_suppkey || '>' || l_partkey NOT IN (SELECT l_suppkey || '>' || l_partkey FROM lineitem WHERE l_returnflag <> 'R')")
def stale_edges(spark: SparkSession, sf: str) -> DataFrame:
    key = F.concat(s("l_suppkey"), F.lit(">"), s("l_partkey")).alias("key")
    line = table(spark, sf, "lineitem")
    return resolve.stale_edges(line.select(key).distinct(), line.filter("l_returnflag <> 'R'").select(key))


@query("""
WITH m AS (SELECT 'n' || s_nationkey AS flow_id, 's:' || s_suppkey AS member_id FROM supplier),
x AS (SELECT flow_id, member_id FROM m UNION SELECT 'n' || n_nationkey, 'r:' || n_regionkey FROM nation),
b AS (SELECT DISTINCT 's:' || l_suppkey AS src_id, 'p:' || l_partkey AS dst_id FROM lineitem)
SELECT 'member' AS what, flow_id, member_id AS id FROM m UNION ALL SELECT DISTINCT 'bridge', flow_id, src_id || dst_id FROM b JOIN x ON x.member_id = b.src_id""")
def flow_assembly(spark: SparkSession, sf: str) -> DataFrame:
    """Flows with member edges and the bridges on members that edges or stored sets name."""
    nation = table(spark, sf, "nation").select(of("n", "n_nationkey").alias("id"), F.array(of("r:", "n_regionkey")).alias("anchor_set"))
    member = table(spark, sf, "supplier").select(of("n", "s_nationkey").alias("src_id"), of("s:", "s_suppkey").alias("dst_id"), F.lit("agentic.flow.member").alias("kind"))
    bridge = table(spark, sf, "lineitem").select(of("s:", "l_suppkey").alias("src_id"), of("p:", "l_partkey").alias("dst_id"), F.lit("agentic.bridge").alias("kind")).distinct()
    edges = member.union(bridge).select(F.concat("src_id", "dst_id").alias("key"), "src_id", "dst_id", "kind", null().alias("deleted_at"))
    own, found = flows.assembled(nation, edges)
    return own.select(F.lit("member").alias("what"), "flow_id", F.col("member_id").alias("id")).union(found.select(F.lit("bridge"), "flow_id", "key"))


@query("""
WITH h AS (SELECT 'n' || n_nationkey AS id, 'n' || (n_nationkey + 1) AS seed, CASE WHEN n_nationkey % 3 > 0 THEN '2024-0' || (n_nationkey % 9 + 1) END AS synced FROM nation WHERE n_nationkey < 10),
k AS (SELECT 'n' || c_nationkey AS flow_id, count(*) AS n FROM customer GROUP BY 1)
SELECT id AS flow_id, 'hydrated' AS state, synced AS last_synced_at FROM h UNION ALL SELECT flow_id, 'skeleton', NULL FROM k WHERE flow_id NOT IN (SELECT id FROM h UNION SELECT seed FROM h)""")
def ordered_flows(spark: SparkSession, sf: str) -> DataFrame:
    """Hydrated flows and the skeletons that none of them claims, as id or as seed."""
    n = F.col("n_nationkey")
    hydrated = table(spark, sf, "nation").filter("n_nationkey < 10").select(of("n", "n_nationkey").alias("id"), F.array(of("n", n + 1)).alias("entry_points"), F.when(n % 3 > 0, F.concat(F.lit("2024-0"), (n % 9 + 1).cast("string"))).alias("last_synced_at"))
    skeletons = table(spark, sf, "customer").groupBy(of("n", "c_nationkey").alias("flow_id")).agg(F.count(F.lit(1)).alias("member_count")).withColumn("is_unattributed", F.lit(False))
    return flows.ordered(hydrated, skeletons)


@query("""
WITH k AS (SELECT c_nationkey AS n, count(*) AS m, min(c_name) AS place FROM customer WHERE c_acctbal > 5000 GROUP BY 1)
SELECT 'n' || n_nationkey AS id, coalesce(place, n_name) AS seed_location, coalesce(m, 7)::BIGINT AS member_count FROM nation LEFT JOIN k ON n = n_nationkey""")
def flow_twins(spark: SparkSession, sf: str) -> DataFrame:
    """Hydrated flows take place and count from the skeleton of the same id, where there is one."""
    rich = table(spark, sf, "customer").filter("c_acctbal > 5000").groupBy(of("n", "c_nationkey").alias("flow_id")).agg(F.min("c_name").alias("seed_location"), F.count(F.lit(1)).alias("member_count"))
    own = table(spark, sf, "nation").select(of("n", "n_nationkey").alias("id"), F.col("n_name").alias("seed_location"), F.lit(7).cast("long").alias("member_count"))
    return flows.with_twins(own, rich).select("id", "seed_location", "member_count")


@query("""
WITH RECURSIVE e AS (SELECT 'n:' || c_nationkey AS src, 'c:' || c_custkey AS dst FROM customer UNION ALL SELECT 'c:' || o_custkey, 'o:' || o_orderkey FROM orders),
b AS (SELECT 'r:' || n_regionkey AS key, 'n:' || n_nationkey AS node FROM nation WHERE n_nationkey % 2 = 0 UNION SELECT 'r:' || n_regionkey, 'c:' || c_custkey FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal > 9900),
r AS (SELECT key, node FROM b UNION SELECT r.key, e.dst FROM r JOIN e ON e.src = r.node)
SELECT key, node FROM r UNION SELECT 'r:' || r_regionkey, 'doc:' || r_name FROM region""")
def induced_flows(spark: SparkSession, sf: str) -> DataFrame:
    """What seeds reach, what bridges lead to and reach, and linked documents."""
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    edges = c.select(of("n:", "c_nationkey").alias("src"), of("c:", "c_custkey").alias("dst")).union(table(spark, sf, "orders").select(of("c:", "o_custkey"), of("o:", "o_orderkey")))
    seeds = n.filter("n_nationkey % 2 = 0").select(of("r:", "n_regionkey").alias("key"), of("n:", "n_nationkey").alias("node"))
    bridge = n.join(c.filter("c_acctbal > 9900"), F.col("n_nationkey") == F.col("c_nationkey")).select(of("r:", "n_regionkey").alias("key"), of("n:", "n_nationkey").alias("src"), of("c:", "c_custkey").alias("dst"))
    docs = table(spark, sf, "region").select(of("r:", "r_regionkey").alias("key"), of("doc:", "r_name").alias("node"))
    return flows.induced_members(seeds, edges, bridge, docs)


CALLS_SQL = """
k AS (SELECT l_orderkey AS caller, l_linenumber AS ix, l_suppkey AS line, l_linestatus AS name, CASE WHEN l_returnflag = 'A' THEN l_partkey END AS to_id FROM lineitem),
h AS (SELECT DISTINCT caller, ix FROM k WHERE to_id IN (SELECT p_partkey FROM part WHERE p_size > 10)),
u AS (SELECT k.* FROM k LEFT JOIN h ON h.caller = k.caller AND h.ix = k.ix WHERE h.ix IS NULL)"""


def _calls(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (parts of some size and orders) and calls of orders, of which a part of the graph resolves some."""
    line = table(spark, sf, "lineitem")
    to = F.array(F.struct(of("p", "l_partkey").alias("symbol_id"), F.lit("certain").alias("confidence"), null().alias("reason")))
    calls = line.select(of("o", "l_orderkey").alias("caller_id"), F.col("l_linenumber").alias("call_ix"), F.col("l_linestatus").alias("name"), of("o", "l_orderkey").alias("file"), F.col("l_suppkey").alias("start_line"), F.lit(False).alias("is_callback"), F.when(F.col("l_returnflag") == "A", to).otherwise(F.array().cast(to_type(to, line))).alias("resolutions"))
    nodes = table(spark, sf, "part").filter("p_size > 10").select(of("p", "p_partkey").alias("symbol_id")).union(table(spark, sf, "orders").select(of("o", "o_orderkey")))
    return nodes, calls


def to_type(col: Column, df: DataFrame):
    return df.select(col.alias("x")).schema["x"].dataType


@query(f"""
WITH {CALLS_SQL}, m AS (SELECT 'f' || o_custkey AS flow_id, o_orderkey AS o FROM orders),
c AS (SELECT DISTINCT 'f' || o_custkey AS flow_id, 'o' || o_orderkey AS file, l_suppkey AS line FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 10),
w AS (SELECT flow_id, 'o' || caller AS file, line, min(struct_pack(a := 'o' || caller, b := name)) AS w FROM u JOIN m ON m.o = u.caller GROUP BY ALL)
SELECT c.flow_id, c.file, c.line, w.a AS witness, w.b AS call_name FROM c LEFT JOIN w ON w.flow_id = c.flow_id AND w.file = c.file AND w.line = c.line""")
def corroborated_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Claims of bridges at a place, and the unresolved call of a member that bears each out."""
    nodes, calls = _calls(spark, sf)
    orders = table(spark, sf, "orders")
    members = orders.select(of("f", "o_custkey").alias("flow_id"), of("o", "o_orderkey").alias("node"))
    claims = orders.join(table(spark, sf, "lineitem").filter("l_quantity > 10"), F.col("l_orderkey") == F.col("o_orderkey"))
    claims = claims.select(of("f", "o_custkey").alias("flow_id"), null().alias("src_id"), null().alias("dst_id"), of("o", "o_orderkey").alias("file"), F.col("l_suppkey").alias("line")).distinct()
    good, rest = bridges.corroborated(claims, members, calls, nodes)
    return good.select("flow_id", "file", "line", "witness", "call_name").union(rest.select("flow_id", "file", "line", null(), null()))


@query(f"""
WITH {CALLS_SQL}, e AS (SELECT DISTINCT caller, to_id FROM k WHERE to_id IN (SELECT p_partkey FROM part WHERE p_size > 10)), s AS (SELECT o_orderkey AS o FROM orders WHERE o_orderpriority = '1-URGENT'),
m AS (SELECT o AS key, 'o' || o AS node FROM s UNION SELECT caller, 'p' || to_id FROM e JOIN s ON s.o = caller),
d AS (SELECT 'p' || p_partkey AS node FROM part WHERE p_retailprice > 1500)
SELECT 'o' || key AS key, count(*) AS member_count, count(*) FILTER (node IN (SELECT node FROM d)) AS described, (SELECT count(*) FROM u WHERE u.caller = m.key) AS sites FROM m GROUP BY key""")
def flow_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Members of each entry point, how many are described, and the unresolved calls among them."""
    nodes, calls = _calls(spark, sf)
    entry = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(of("o", "o_orderkey").alias("symbol_id"))
    told = table(spark, sf, "part").filter("p_retailprice > 1500").select(of("p", "p_partkey").alias("symbol_id"))
    out = stitch.inventory(nodes, calls, entry, told)
    return out.select("key", "member_count", "described", F.coalesce(F.size("sites"), F.lit(0)).cast("long").alias("sites"))


@query("""
WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages), u AS (
  SELECT path, array_to_string(string_split(path, '/')[1:k], '/') AS dir FROM p, range(0, 12) r(k) WHERE k < len(string_split(path, '/'))),
m AS (SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS dir FROM p WHERE page_id % 3 = 0 UNION SELECT DISTINCT split_part(path, '/', 1) FROM p WHERE page_id % 3 = 1)
SELECT path, arg_max(dir, length(dir)) AS dir FROM u WHERE dir IN (SELECT dir FROM m) GROUP BY path""")
def nearest_marked_dir(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest marked directory at or above each page's path."""
    pages = table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    part = lambda k: F.split_part("path", F.lit("/"), F.lit(k))
    deep = pages.filter("page_id % 3 = 0").select(F.concat(part(1), F.lit("/"), part(2)).alias("dir"))
    return graph.nearest_marked_dir(pages, deep.union(pages.filter("page_id % 3 = 1").select(part(1))))


@query("""
WITH m AS (SELECT 's:' || s_suppkey AS symbol_path FROM supplier WHERE s_nationkey = 3), b AS (SELECT DISTINCT 's:' || l_suppkey AS src_id, 'p:' || l_partkey AS dst_id FROM lineitem)
SELECT 'member' AS what, m.symbol_path AS id, s_name AS text FROM m LEFT JOIN supplier ON 's:' || s_suppkey = m.symbol_path AND s_acctbal > 0 UNION ALL SELECT 'bridge', src_id || dst_id, NULL FROM b WHERE src_id IN (SELECT symbol_path FROM m)""")
def flow_details(spark: SparkSession, sf: str) -> DataFrame:
    """One flow's members with their texts, and the bridges that touch them."""
    own = table(spark, sf, "supplier").groupBy(of("n", "s_nationkey").alias("flow_id")).agg(F.collect_set(of("s:", "s_suppkey")).alias("anchor_set"))
    told = table(spark, sf, "supplier").filter("s_acctbal > 0").select(of("s:", "s_suppkey").alias("symbol_path"), F.col("s_name").alias("text"))
    bridge = table(spark, sf, "lineitem").select(of("s:", "l_suppkey").alias("src_id"), of("p:", "l_partkey").alias("dst_id")).distinct()
    members, found = inspect.flow_detail("n3", own, told, bridge)
    return members.select(F.lit("member").alias("what"), F.col("symbol_path").alias("id"), "text").union(found.select(F.lit("bridge"), F.concat("src_id", "dst_id"), null()))


# -- cursors -----------------------------------------------------------------


@query("""
WITH e AS (SELECT user_id::VARCHAR AS path, ts, event_id * 7919 % 1000 AS lines FROM events WHERE event_type <> 'view'),
l AS (SELECT *, lag(lines) OVER w AS was, lag(ts) OVER w AS before FROM e WINDOW w AS (PARTITION BY path ORDER BY ts, lines))
SELECT path, ts, CASE WHEN was IS NULL OR lines < was OR ts > before + INTERVAL 7 DAYS THEN 0 ELSE was END AS from_line, lines AS to_line FROM l""")
def cursor_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """What is read of each user's log at each of their events, from where the last reading ended."""
    own = table(spark, sf, "events").filter("event_type <> 'view'").select(s("user_id").alias("path"), F.col("ts").alias("at"), (F.col("event_id") * 7919 % 1000).alias("lines"))
    return follow.read_ranges(own).withColumnRenamed("at", "ts")
