"""Registered queries of closures, their maintenance, set comparisons and a whole turn, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.operators import closure, ordinals, sets
from strataweave.plans import reconcile, star_graph
from strataweave.plans.star_graph import table
from strataweave.queries import EDGES_SQL, query, s
from strataweave.sources.files import CallGraphSource
from strataweave.staging import shared_folder


def of(prefix: str, col: Column | str) -> Column:
    return F.concat(F.lit(prefix), (F.col(col) if isinstance(col, str) else col).cast("string"))


# -- long paths and cycles ---------------------------------------------------

LONG_SQL = """
  SELECT 'p:' || p_partkey AS src, 'p:' || lead(p_partkey) OVER (ORDER BY p_partkey) AS dst FROM part
  UNION ALL SELECT 'e:' || event_id, 'e:' || coalesce(lead(event_id) OVER w, first_value(event_id) OVER w) FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
  UNION ALL SELECT 'u:' || user_id, 'e:' || event_id FROM events WHERE event_type = 'error'"""


@query(f"""
WITH RECURSIVE e AS (SELECT * FROM ({LONG_SQL}) WHERE dst IS NOT NULL), r AS (
  SELECT key, key AS node FROM (SELECT DISTINCT 'u:' || user_id AS key FROM events UNION ALL SELECT 'p:' || p_partkey FROM part WHERE p_partkey % 1000 = 1)
  UNION SELECT r.key, e.dst FROM r JOIN e ON e.src = r.node)
SELECT key, node FROM r""")
def condensed_closure(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as one long chain, each user's events as a cycle with ways in at its errors."""
    part, events = table(spark, sf, "part"), table(spark, sf, "events")
    # Nodes are walked as numbers, their kind in the last digits; the few ids that are too large for that are walked as texts.
    top = [d.agg(*(f(c) for c in cols for f in (F.min, F.max))).first() for d, cols in ((part, ["p_partkey"]), (events, ["event_id", "user_id"]))]
    if any(abs(v or 0) >= 1 << 60 for row in top for v in row):
        node, named = (lambda prefix, c: of(f"{prefix}:", c)), (lambda c: c)
    else:
        node = lambda prefix, c: F.col(c) * 4 + "peu".index(prefix)
        named = lambda c: F.concat(F.element_at(F.array(*map(F.lit, ("p:", "e:", "u:"))), (F.pmod(c, F.lit(4)) + 1).cast("int")), F.shiftright(c, 2).cast("string"))
    # The next part is found by a join of numbered rows, not a window over all.
    placed = ordinals.numbered(part.select("p_partkey"), ["p_partkey"], "n")
    following = placed.select((F.col("n") - 1).alias("n"), F.col("p_partkey").alias("next"))
    chain = placed.join(following, "n").select(node("p", "p_partkey").alias("src"), node("p", "next").alias("dst"))
    w = F.expr("lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id)")
    around = events.select("event_id", F.coalesce(w, F.expr("min(event_id) OVER (PARTITION BY user_id)")).alias("next"))
    ring = around.select(node("e", "event_id").alias("src"), node("e", "next").alias("dst"))
    into = events.filter("event_type = 'error'").select(node("u", "user_id").alias("src"), node("e", "event_id").alias("dst"))
    seeds = events.select(node("u", "user_id").alias("key")).distinct().union(part.filter("p_partkey % 1000 = 1").select(node("p", "p_partkey")))
    return closure.closure(chain.union(ring).union(into), seeds.select("key", F.col("key").alias("node")), written=False, named=named)


# -- maintenance -------------------------------------------------------------

CHANGED_SQL = """
  SELECT 'r:' || n_regionkey AS src, 'n:' || n_nationkey AS dst FROM nation WHERE n_nationkey <> 3
  UNION ALL SELECT 'n:' || CASE WHEN c_acctbal < 0 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END, 'c:' || c_custkey FROM customer
  UNION ALL SELECT 'n:' || s_nationkey, 's:' || s_suppkey FROM supplier WHERE s_acctbal > 0
  UNION ALL SELECT 'c:' || o_custkey, 'o:' || o_orderkey FROM orders
  UNION ALL SELECT 's:' || s_suppkey, 'n:' || (s_nationkey + 7) % 25 FROM supplier WHERE s_acctbal > 9500"""


def changed_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The star graph after a change: a nation leaves its region, customers in debt move on, suppliers in debt go, rich ones lead to another nation."""
    t = lambda n: table(spark, sf, n)
    out = t("nation").filter("n_nationkey <> 3").select(of("r:", "n_regionkey").alias("src"), of("n:", "n_nationkey").alias("dst"))
    to = F.when(F.col("c_acctbal") < 0, (F.col("c_nationkey") + 1) % 25).otherwise(F.col("c_nationkey"))
    out = out.union(t("customer").select(of("n:", to), of("c:", "c_custkey")))
    out = out.union(t("supplier").filter("s_acctbal > 0").select(of("n:", "s_nationkey"), of("s:", "s_suppkey")))
    out = out.union(t("orders").select(of("c:", "o_custkey"), of("o:", "o_orderkey")))
    return out.union(t("supplier").filter("s_acctbal > 9500").select(of("s:", "s_suppkey"), of("n:", (F.col("s_nationkey") + 7) % 25)))


@query(f"""
WITH RECURSIVE e AS ({EDGES_SQL}), f AS ({CHANGED_SQL}), a AS (
  SELECT 'r:' || r_regionkey AS key, 'r:' || r_regionkey AS node FROM region UNION SELECT a.key, e.dst FROM a JOIN e ON e.src = a.node), b AS (
  SELECT 'r:' || r_regionkey AS key, 'r:' || r_regionkey AS node FROM region WHERE r_regionkey <> 4 UNION SELECT b.key, f.dst FROM b JOIN f ON f.src = b.node)
SELECT coalesce(a.key, b.key) AS key, coalesce(a.node, b.node) AS node, CASE WHEN a.key IS NULL THEN 'new' WHEN b.key IS NULL THEN 'gone' ELSE 'kept' END AS state
FROM a FULL JOIN b ON a.key = b.key AND a.node = b.node""")
def closure_maintenance(spark: SparkSession, sf: str) -> DataFrame:
    """The regions' closure before a change of edges and seeds, maintained; every pair and what became of it."""
    region = table(spark, sf, "region").select("r_regionkey", of("r:", "r_regionkey").alias("key")).withColumn("node", F.col("key"))
    old, was, now = star_graph.edges(spark, sf), region.select("key", "node"), region.filter("r_regionkey <> 4").select("key", "node")
    change = closure.maintained(closure.closure(old, was), (old, changed_edges(spark, sf)), (was, now))
    states = {"kept": change.kept, "new": change.new, "gone": change.gone}
    out = [d.select("key", "node", F.lit(k).alias("state")) for k, d in states.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


# -- sets --------------------------------------------------------------------


@query("""
WITH m AS (SELECT DISTINCT 'o:' || l_orderkey AS key, l_suppkey % 40 AS node FROM lineitem), b AS (SELECT DISTINCT 's:' || s_nationkey AS other, s_suppkey % 40 AS node FROM supplier),
z AS (SELECT key, count(*) AS n FROM m GROUP BY 1)
SELECT m.key, b.other FROM m JOIN b ON b.node = m.node JOIN z ON z.key = m.key GROUP BY m.key, b.other, z.n HAVING count(*) = z.n""")
def set_containments(spark: SparkSession, sf: str) -> DataFrame:
    """Orders all of whose suppliers' classes some nation has."""
    orders = table(spark, sf, "lineitem").select(of("o:", "l_orderkey").alias("key"), (F.col("l_suppkey") % 40).cast("string").alias("node"))
    nations = table(spark, sf, "supplier").select(of("s:", "s_nationkey").alias("key"), (F.col("s_suppkey") % 40).cast("string").alias("node"))
    return sets.containments(orders, nations)


@query("""
WITH m AS (SELECT l_orderkey AS key, list_sort(list(DISTINCT l_returnflag || l_linestatus || l_linenumber % 3)) AS m FROM lineitem GROUP BY 1)
SELECT key, min(key) OVER (PARTITION BY m) AS first FROM m""")
def equal_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Orders by the first one whose lines have the same set of states."""
    state = F.concat("l_returnflag", "l_linestatus", (F.col("l_linenumber") % 3).cast("string"))
    return sets.classes(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), state.alias("node")))


@query("""
WITH a AS (SELECT DISTINCT l_suppkey AS key, l_partkey AS node FROM lineitem WHERE l_shipdate < DATE '1996-01-01'), b AS (SELECT DISTINCT l_suppkey AS key, l_partkey AS node FROM lineitem WHERE l_shipdate >= DATE '1995-01-01')
SELECT key, node, 'a' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT key, node, 'b' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def set_differences(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_partkey").alias("node"), "l_shipdate")
    return sets.differing(own.filter("l_shipdate < DATE '1996-01-01'"), own.filter("l_shipdate >= DATE '1995-01-01'"))


# -- a turn ------------------------------------------------------------------

PATH_SQL = "'{0}' || {1} || '.ts#{0}' || {1} || ':function'"


def _source(spark: SparkSession, sf: str, later: bool) -> CallGraphSource:
    """Nations call their customers and suppliers. Later customers of one segment have other bodies, those in debt
    are called by the next nation, and the nations of the first region are called by it, so they are entry points no more."""
    c, n, p = (table(spark, sf, t) for t in ("customer", "nation", "supplier"))
    body = lambda name, changed: F.concat(F.lit("return "), name, F.when(changed & F.lit(later), F.lit(" + 1")).otherwise(F.lit("")))
    nobody = F.lit(False)
    rows = [
        c.select(of("c", "c_custkey").alias("name"), body(F.col("c_name"), F.col("c_mktsegment") == "BUILDING").alias("body_source"), of("n", F.when((F.col("c_acctbal") < 0) & F.lit(later), (F.col("c_nationkey") + 1) % 25).otherwise(F.col("c_nationkey"))).alias("caller")),
        p.select(of("s", "s_suppkey").alias("name"), body(F.col("s_name"), nobody).alias("body_source"), of("n", "s_nationkey").alias("caller")),
        n.select(of("n", "n_nationkey").alias("name"), body(F.col("n_name"), nobody).alias("body_source"), F.when((F.col("n_regionkey") == 0) & F.lit(later), F.lit("r0")).alias("caller")),
    ]
    if later:
        rows.append(table(spark, sf, "region").filter("r_regionkey = 0").select(of("r", "r_regionkey").alias("name"), body(F.col("r_name"), nobody).alias("body_source"), F.lit(None).cast("string").alias("caller")))
    own = rows[0]
    for r in rows[1:]:
        own = own.unionByName(r)
    null = F.lit(None).cast("string")
    nodes = own.select(
        F.col("name").alias("symbol_id"), "name", F.concat("name", F.lit(".ts")).alias("file_path"), F.lit(1).alias("start_line"), F.lit("function").alias("kind"),
        F.array().cast("array<string>").alias("enclosing"), F.lit(False).alias("is_test"), null.alias("docstring"), "body_source",
    )
    to = F.array(F.struct(F.col("name").alias("symbol_id"), F.lit("certain").alias("confidence"), null.alias("reason")))
    calls = own.filter("caller IS NOT NULL").select(
        F.col("caller").alias("caller_id"), F.hash("name").alias("call_ix"), "name", F.concat("caller", F.lit(".ts")).alias("file"), F.lit(1).alias("start_line"), F.lit(False).alias("is_callback"), to.alias("resolutions"),
    )
    entry = n.filter("n_regionkey <> 0").select(of("n", "n_nationkey").alias("symbol_id"))
    entry = entry.union(own.filter("name = 'r0'").select("name")) if later else n.select(of("n", "n_nationkey").alias("symbol_id"))
    return CallGraphSource(nodes, calls, entry, nodes.select(F.col("file_path").alias("path"), F.lit("x").cast("binary").alias("content")))


@query(f"""
WITH m AS (SELECT c_nationkey AS was, CASE WHEN c_acctbal < 0 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END AS now, c_mktsegment = 'BUILDING' AS body FROM customer),
b AS (SELECT DISTINCT now AS n FROM m WHERE body), g AS (SELECT was AS n FROM m WHERE was <> now UNION SELECT now FROM m WHERE was <> now),
f AS (SELECT n_nationkey AS n, n_regionkey = 0 AS gone, concat_ws(',', CASE WHEN n_nationkey IN (SELECT n FROM b) THEN 'body' END, CASE WHEN n_nationkey IN (SELECT n FROM g) THEN 'membership' END) AS reason FROM nation)
SELECT {PATH_SQL.format("n", "n")} AS flow_id, CASE WHEN gone THEN 'retire' ELSE 'resync' END AS action, CASE WHEN gone THEN 'seed entrypoint demoted; subsumed by ' || {PATH_SQL.format("r", "0")} ELSE reason END AS reason FROM f WHERE gone OR reason <> ''
UNION ALL SELECT {PATH_SQL.format("r", "r_regionkey")}, 'hydrate-full', 'touched' FROM region WHERE r_regionkey = 0""")
def reconcile_turn(spark: SparkSession, sf: str) -> DataFrame:
    """A second turn over all files of a changed graph: what becomes of each flow."""
    from strataweave.sources.store import GraphStore

    store = GraphStore.open(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    first, then = (_source(spark, sf, later) for later in (False, True))
    every = lambda src: src.files.select("path")
    reconcile.reconcile(store, first, every(first), "2024-01-01T00:00:00Z")
    return reconcile.reconcile(store, then, every(then), "2024-01-02T00:00:00Z")
