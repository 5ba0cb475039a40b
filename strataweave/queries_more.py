"""Further registered queries: identities and predicates, the store, layers, flows and summaries, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataweave.functions import bag, identity, predicates, text
from strataweave.operators import flows, graph, inspect, ladder, resolve
from strataweave.plans.star_graph import table
from strataweave.queries import query, s
from strataweave.staging import shared_folder

NODE_NULLS = {"anchor": "string", "field_ownership": "map<string,string>", "intent_source": "string", "deleted_at": "string"}


# -- identities --------------------------------------------------------------


@query("""
WITH p AS (SELECT p_partkey, p_brand || '#' || p_type || '.' || p_name || ':fn' AS path, sha256(p_name) AS h FROM part),
q AS (SELECT *, split_part(regexp_replace(path, '^[^#]*#', ''), ':', 1) AS bare FROM p)
SELECT p_partkey, path || ':' || h AS anchor, path AS symbol_path, h AS content_hash, split_part(path, '#', 1) AS file, list_last(string_split(bare, '.')) AS name FROM q""")
def anchors(spark: SparkSession, sf: str) -> DataFrame:
    path = identity.symbol_path(F.col("p_brand"), F.array("p_type"), F.col("p_name"), F.lit("fn"))
    rows = table(spark, sf, "part").select("p_partkey", identity.anchor(path, text.span_hash(F.col("p_name"))).alias("anchor"))
    parsed = rows.withColumn("x", identity.parse_anchor(F.col("anchor"))).select("p_partkey", "anchor", "x.*")
    return parsed.select("*", identity.file_of(F.col("symbol_path")).alias("file"), identity.member_name(F.col("symbol_path")).alias("name"))


@query("""
SELECT s_suppkey, 'calls:n' || s_nationkey || '->s' || s_suppkey AS edge, 'agentic.group:file:s' || s_suppkey AS grp, 'agentic.description:s' || s_suppkey AS description,
  'agentic.flow:skill:s' || s_suppkey AS skill, 's' || s_suppkey || '/a.md#doc' AS doc, true AS is_skill FROM supplier""")
def stored_ids(spark: SparkSession, sf: str) -> DataFrame:
    own, nation = F.concat(F.lit("s"), s("s_suppkey")), F.concat(F.lit("n"), s("s_nationkey"))
    skill = identity.skill_flow_id(own)
    return table(spark, sf, "supplier").select(
        "s_suppkey", identity.edge_key(F.lit("calls"), nation, own).alias("edge"), identity.group_id(own).alias("grp"), identity.description_id(own).alias("description"),
        skill.alias("skill"), identity.doc_node_id(own, F.lit("a.md")).alias("doc"), identity.is_skill_flow(skill).alias("is_skill"),
    )


@query("SELECT event_id, '20240101T00' || event_id || '00000Z-' || left(sha256(event_id::VARCHAR), 8) AS run_id, left(sha256(event_type), 12) AS pinned FROM events")
def run_ids(spark: SparkSession, sf: str) -> DataFrame:
    iso = F.concat(F.lit("2024-01-01T00:"), s("event_id"), F.lit(":00.000Z"))
    return table(spark, sf, "events").select("event_id", identity.run_id(iso, F.left(F.sha2(s("event_id"), 256), F.lit(8))).alias("run_id"), identity.short_hash(F.col("event_type")).alias("pinned"))


@query("""
SELECT l_orderkey || ':' || l_linenumber || '-' || l_partkey || ':' || l_suppkey AS range, l_orderkey::INT AS start_line, l_linenumber::INT AS start_col,
  l_partkey::INT AS end_line, l_suppkey::INT AS end_col FROM lineitem""")
def source_ranges(spark: SparkSession, sf: str) -> DataFrame:
    own = identity.source_range(*(F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")))
    return table(spark, sf, "lineitem").select(own.alias("range")).withColumn("x", identity.scope_range(F.col("range"))).select("range", "x.*")


@query("""
WITH t AS (SELECT doc_id, left(text, length(text) // 3) AS a, left(text, length(text) // 2) AS b FROM documents),
l AS (SELECT doc_id, string_split(a, chr(10)) AS a, string_split(b, chr(10)) AS b FROM t)
SELECT doc_id, len(a) || ':' || length(list_last(a)) || '-' || len(b) || ':' || length(list_last(b)) AS range FROM l""")
def offset_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", identity.offset_range(F.col("text"), F.expr("length(text) div 3"), F.expr("length(text) div 2")).alias("range"))


def _quoted(words) -> str:
    return ", ".join("'" + w + "'" for w in words)


@query(f"""
SELECT page_id, regexp_replace(url, '/[^/]*$', '') AS folder, list_last(string_split(rtrim(url, '/'), '/')) AS last, regexp_replace(url, '[^A-Za-z0-9]', '-', 'g') AS slug,
  coalesce(lower(regexp_extract(url, '(\\.[^./]*)$', 1)) IN ({_quoted(predicates.SOURCE_EXTENSIONS)}), false) AS source, list_has_any(string_split(url, '/'), [{_quoted(predicates.EXCLUDED_DIRS)}]) AS excluded,
  url <> '' AND NOT starts_with(url, '..') AS usable, regexp_matches(url, '^(~|/|[a-zA-Z][a-zA-Z0-9+.-]*:)') AS external, CASE WHEN starts_with(url, 'scripts/') THEN 'skill.to_script' ELSE 'skill.to_reference' END AS kind
FROM pages""")
def path_predicates(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", identity.posix_dirname(url).alias("folder"), identity.last_segment(url).alias("last"), identity.project_slug(url).alias("slug"),
        predicates.supported_source(url).alias("source"), predicates.in_excluded_dir(url).alias("excluded"), predicates.repo_file(url).alias("usable"),
        predicates.external_target(url).alias("external"), predicates.skill_edge_kind(url).alias("kind"),
    )


@query("""
WITH c AS (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'certain' WHEN 'MACHINERY' THEN 'probable' WHEN 'HOUSEHOLD' THEN 'possible' ELSE c_mktsegment END AS k FROM customer),
d AS (SELECT c_custkey, CASE k WHEN 'probable' THEN 0.6 WHEN 'possible' THEN 0.3 ELSE 1.0 END::DOUBLE AS confidence FROM c)
SELECT c_custkey, confidence, confidence < 1 AS inferred FROM d""")
def confidences(spark: SparkSession, sf: str) -> DataFrame:
    seg = F.col("c_mktsegment")
    certainty = F.when(seg == "BUILDING", "certain").when(seg == "MACHINERY", "probable").when(seg == "HOUSEHOLD", "possible").otherwise(seg)
    rows = table(spark, sf, "customer").select("c_custkey", predicates.confidence(certainty).alias("confidence"))
    return rows.withColumn("inferred", predicates.is_inferred(F.col("confidence")))


# -- graph and flows ---------------------------------------------------------


@query("""
WITH m AS (SELECT c_nationkey AS n, 'c:' || c_custkey AS node FROM customer), k AS (SELECT n FROM m GROUP BY n HAVING count(*) > 1)
SELECT node, min(node) OVER (PARTITION BY n) AS root FROM m WHERE n IN (SELECT n FROM k)""")
def components_of_chains(spark: SparkSession, sf: str) -> DataFrame:
    """Each nation's customers form one chain in the order of their keys."""
    own = table(spark, sf, "customer").select("c_nationkey", "c_custkey", F.lead("c_custkey").over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).alias("next"))
    node = lambda c: F.concat(F.lit("c:"), s(c))
    return graph.components(own.filter("next IS NOT NULL").select(node("c_custkey").alias("src"), node("next").alias("dst")))


@query("""
WITH b AS (SELECT DISTINCT 's:' || l_suppkey AS src_id, 'p:' || l_partkey AS dst_id FROM lineitem),
m AS (SELECT 'n' || s_nationkey AS flow_id, 's:' || s_suppkey AS member FROM supplier UNION SELECT p_brand, 'p:' || p_partkey FROM part)
SELECT flow_id, src_id || dst_id AS key, src_id, dst_id FROM b JOIN m ON member = src_id UNION SELECT flow_id, src_id || dst_id, src_id, dst_id FROM b JOIN m ON member = dst_id""")
def incident_bridges(spark: SparkSession, sf: str) -> DataFrame:
    src, dst = F.concat(F.lit("s:"), s("l_suppkey")), F.concat(F.lit("p:"), s("l_partkey"))
    edges = table(spark, sf, "lineitem").select(F.concat(src, dst).alias("key"), src.alias("src_id"), dst.alias("dst_id"), F.lit("agentic.bridge").alias("kind"), F.lit(None).cast("string").alias("deleted_at")).distinct()
    one = table(spark, sf, "supplier").select(F.concat(F.lit("n"), s("s_nationkey")).alias("flow_id"), F.concat(F.lit("s:"), s("s_suppkey")).alias("member_id"))
    two = table(spark, sf, "part").select(F.col("p_brand").alias("flow_id"), F.concat(F.lit("p:"), s("p_partkey")).alias("member_id"))
    return flows.incident_bridges(edges, one.union(two))


@query("SELECT l_orderkey AS key, 'p' || l_partkey AS path, p_partkey AS symbol_id, p_partkey IS NULL AS is_doc FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size <= 25")
def reconstructed_paths(spark: SparkSession, sf: str) -> DataFrame:
    path = lambda c: F.concat(F.lit("p"), s(c)).alias("path")
    paths = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), path("l_partkey"))
    return flows.reconstructed(paths, table(spark, sf, "part").filter("p_size <= 25").select(path("p_partkey"), F.col("p_partkey").alias("symbol_id")))


@query("""
SELECT p_name AS symbol_path, arg_min(p_brand, p_partkey) AS content_hash, count(DISTINCT p_brand) > 1 AS conflict FROM part GROUP BY 1""")
def baseline_anchors(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("symbol_path"), F.col("p_brand").alias("content_hash"))
    low, conflicts = resolve.baseline_anchors(nodes)
    return low.join(conflicts.withColumn("conflict", F.lit(True)), "symbol_path", "left").withColumn("conflict", F.coalesce("conflict", F.lit(False)))


@query("""
WITH a AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS a FROM orders WHERE o_orderdate < TIMESTAMP '1995-06-01' GROUP BY 1),
b AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS b FROM orders WHERE o_orderdate >= TIMESTAMP '1995-06-01' GROUP BY 1),
c AS (SELECT o_custkey, list_filter(b, lambda x: NOT list_contains(a, x)) AS gained, list_filter(a, lambda x: NOT list_contains(b, x)) AS lost FROM a JOIN b USING (o_custkey))
SELECT o_custkey, array_to_string(gained, ',') AS gained, array_to_string(lost, ',') AS lost FROM c WHERE len(gained) + len(lost) > 0""")
def set_changes(spark: SparkSession, sf: str) -> DataFrame:
    sets = lambda d: d.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("m"))
    o = table(spark, sf, "orders")
    out = inspect.set_changes(sets(o.filter("o_orderdate < TIMESTAMP '1995-06-01'")), sets(o.filter("o_orderdate >= TIMESTAMP '1995-06-01'")), "o_custkey", "m")
    return out.select("o_custkey", *(F.array_join(F.array_sort(c), ",").alias(c) for c in ("gained", "lost")))


# -- summaries ---------------------------------------------------------------

SUMMARY_SQL = """
m AS (SELECT s_nationkey AS n, 's:' || s_suppkey AS member, CASE WHEN s_acctbal > 6000 THEN 'docstring' WHEN s_acctbal > 2000 THEN 'llm' WHEN s_acctbal > 0 THEN 'placeholder' END AS k FROM supplier),
b AS (SELECT s_nationkey AS n, count(*) AS bridges FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1),
f AS (SELECT 'n' || m.n AS flow_id, m.n < 20 AS live, count(*) AS member_count, count(*) FILTER (k = 'docstring') AS docstring, count(*) FILTER (k = 'placeholder') AS placeholder,
  count(*) FILTER (k = 'llm') AS llm, count(*) FILTER (k IS NULL) AS none, coalesce(max(bridges), 0) AS bridge_count FROM m LEFT JOIN b ON b.n = m.n GROUP BY ALL)"""


def _summaries(spark: SparkSession, sf: str) -> DataFrame:
    supp = table(spark, sf, "supplier").withColumn("member", F.concat(F.lit("s:"), s("s_suppkey")))
    own = supp.groupBy("s_nationkey").agg(F.collect_set("member").alias("anchor_set"))
    rows = own.select(F.concat(F.lit("n"), s("s_nationkey")).alias("flow_id"), (F.col("s_nationkey") < 20).alias("live"), "anchor_set", F.array().cast("array<string>").alias("entry_points"))
    balance = F.col("s_acctbal")
    told = supp.select(F.col("member").alias("symbol_path"), F.when(balance > 6000, "docstring").when(balance > 2000, "llm").when(balance > 0, "placeholder").alias("source"))
    pairs = table(spark, sf, "lineitem").select(F.concat(F.lit("s:"), s("l_suppkey")).alias("src_id"), F.concat(F.lit("p:"), s("l_partkey")).alias("dst_id"))
    return inspect.flow_summaries(rows, told, pairs)


@query(f"WITH {SUMMARY_SQL} SELECT * FROM f")
def flow_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return _summaries(spark, sf).select("flow_id", "live", F.col("member_count").cast("long").alias("member_count"), "docstring", "placeholder", "llm", "none", "bridge_count")


@query(f"""
WITH {SUMMARY_SQL}
SELECT flow_id, flow_id || '  [' || CASE WHEN live THEN 'live' ELSE 'retired' END || '] members=' || member_count || ' bridges=' || bridge_count || ' docstring=' || docstring
  || ' provisional=0 placeholder=' || placeholder || ' llm=' || llm || ' none=' || none AS line FROM f""")
def summary_lines(spark: SparkSession, sf: str) -> DataFrame:
    return inspect.summary_lines(_summaries(spark, sf))


@query("""
SELECT (SELECT count(*) FROM nation WHERE n_regionkey < 3) AS live_flows, (SELECT count(*) FROM nation WHERE n_regionkey >= 3) AS retired_flows, (SELECT count(*) FROM supplier) AS bridges,
  (SELECT count(*) FROM region) AS deferred, count(*) FILTER (lang = 'en') AS docstring, count(*) FILTER (lang = 'de') AS llm, count(*) FILTER (lang IS NULL OR lang NOT IN ('en', 'de')) AS none, count(*) AS total FROM documents""")
def store_summary(spark: SparkSession, sf: str) -> DataFrame:
    lang = F.col("lang")
    told = table(spark, sf, "documents").select(F.when(lang == "en", "docstring").when(lang == "de", "llm").alias("source"))
    out = inspect.store_summary(table(spark, sf, "nation").select((F.col("n_regionkey") < 3).alias("live")), told, table(spark, sf, "supplier"), table(spark, sf, "region"))
    return out.drop("provisional", "placeholder")


# -- store and layers --------------------------------------------------------


def _node_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as nodes: file by segment, tier by nation."""
    n = F.col("c_nationkey")
    return table(spark, sf, "customer").select(
        F.concat(F.lit("c:"), s("c_custkey")).alias("id"), F.lit("code.function").alias("kind"), F.col("c_mktsegment").alias("path"),
        F.when(n < 8, "raw").when(n < 16, "agentic").otherwise("user").alias("layer"),
        F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg"))).alias("attributes"), F.lit("raw").alias("origin"), "c_acctbal", "c_nationkey",
        *(F.lit(None).cast(t).alias(c) for c, t in NODE_NULLS.items()),
    )


def _store(spark: SparkSession):
    from strataweave.sources.store import GraphStore

    return GraphStore.open(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")


@query("""
WITH c AS (SELECT *, CASE WHEN c_nationkey < 8 THEN 'raw' WHEN c_nationkey < 16 THEN 'agentic' ELSE 'user' END AS layer FROM customer)
SELECT 'c:' || c_custkey AS id, layer, CASE WHEN c_acctbal < 0 AND layer <> 'raw' THEN '2024-01-01T00:00:00Z' END AS deleted_at FROM c WHERE NOT (layer = 'raw' AND c_mktsegment = 'BUILDING')""")
def stored_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Upsert, soft deletion and invalidation by file in one transaction, read back from the published version."""
    from strataweave.sources.store import TABLES

    own, rows = _store(spark), _node_rows(spark, sf)

    def work(store) -> None:
        store.upsert_nodes(rows.select(*TABLES["nodes"].names))
        store.soft_delete(rows.filter("c_acctbal < 0").select("id"), "2024-01-01T00:00:00Z")
        store.invalidate_nodes(rows.filter("path = 'BUILDING'").select("path"))

    own.transaction(work)
    return own.nodes(include_deleted=True).select("id", "layer", "deleted_at")


@query("""
WITH f AS (SELECT 'c:' || c_custkey AS path, sha256(c_name) AS was, CASE WHEN c_acctbal < 0 THEN sha256(c_name || '!') ELSE sha256(c_name) END AS now, c_nationkey AS n FROM customer)
SELECT path FROM f WHERE n >= 20 OR was <> now""")
def changed_files(spark: SparkSession, sf: str) -> DataFrame:
    """What differs from the recorded hashes, or has none."""
    own = _store(spark)
    c = table(spark, sf, "customer").withColumn("path", F.concat(F.lit("c:"), s("c_custkey")))
    from strataweave.sources.store import TABLES

    was = c.filter("c_nationkey < 20").select("path", F.sha2("c_name", 256).alias("sha256"))
    rest = [f for f in TABLES["file_hashes"].fields if f.name not in ("path", "sha256")]
    own.record_hashes(was.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in rest)))
    now = F.when(F.col("c_acctbal") < 0, F.sha2(F.concat("c_name", F.lit("!")), 256)).otherwise(F.sha2("c_name", 256))
    return own.changed_files(c.select("path", now.alias("sha256")))


@query("""
SELECT 'c:' || c_custkey AS id, c_name AS name, CASE WHEN c_acctbal < 0 THEN 'USER' WHEN c_mktsegment = 'BUILDING' THEN 'OVERLAY' ELSE c_mktsegment END AS seg,
  CASE WHEN c_acctbal < 0 THEN 'note' END AS note FROM customer WHERE NOT (c_nationkey = 3 AND c_acctbal < 0)""")
def folded_layers(spark: SparkSession, sf: str) -> DataFrame:
    """Whole rows of three layers: bags merge key by key, and a tombstone of the last layer takes a row out."""
    rows = _node_rows(spark, sf)
    over = rows.filter("path = 'BUILDING'").withColumn("attributes", F.lit('{"seg":"OVERLAY"}'))
    user = rows.filter("c_acctbal < 0").withColumns({"attributes": F.lit('{"note":"note","seg":"USER"}'), "deleted_at": F.when(F.col("c_nationkey") == 3, "2024")})
    out = ladder.fold([d.drop("c_acctbal", "c_nationkey") for d in (rows, over, user)], "id")
    return out.select("id", *(bag.string_at(F.col("attributes"), k).alias(k) for k in ("name", "seg", "note")))
