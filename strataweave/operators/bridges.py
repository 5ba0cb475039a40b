"""Inferred edges: building them from candidates, corroborating claims, capped writing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.functions.identity import edge_key
from strataweave.operators.descriptions import capped
from strataweave.operators.graph import unresolved_calls

#: How much one write may bring.
MAX_BRIDGES, MAX_DESCRIPTIONS, DEADLINE_MS = 500, 200, 30_000


def build(candidates: DataFrame, kind: str = "agentic.bridge", provenance_key: tuple = ("source_file", "source_range", "extractor_id"), parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges (key, src_id, dst_id, inference_rationale) and their provenance, of candidates with an ``ordinal``.

    One edge for each key with the first rationale; of provenance rows equal in
    ``provenance_key`` the first stands. With ``parts`` candidates are dealt among so many tasks by key, once for all that is grouped by it.
    """
    keyed = candidates.withColumn("key", edge_key(F.lit(kind), F.col("src_id"), F.col("dst_id")))
    keyed = keyed.repartition(parts, "key") if parts else keyed
    edges = keyed.groupBy("key", "src_id", "dst_id").agg(F.min_by("inference_rationale", "ordinal").alias("inference_rationale")).withColumn("kind", F.lit(kind))
    prov = keyed.groupBy(F.col("key").alias("edge_key"), *provenance_key).agg(F.min_by(F.struct("source_file", "source_range", "extractor_id", "extractor_version"), "ordinal").alias("p"))
    return edges, prov.select("edge_key", "p.*")


def registry_candidates(declared: DataFrame, targets: DataFrame, owner_id: str, source_file: str) -> DataFrame:
    """Candidates from a registry's declarations (name, source_range) that ``targets`` (name, dst_id) resolve."""
    return declared.join(targets, "name").select(
        F.lit(owner_id).alias("src_id"), "dst_id", F.format_string("meta.json sub_agents[] declares '%s'", "name").alias("inference_rationale"),
        F.lit(source_file).alias("source_file"), "source_range", F.lit("agentic-registry").alias("extractor_id"), F.lit("1").alias("extractor_version"),
        F.col("dst_id").alias("ordinal"),
    )


def doc_incident(edges: DataFrame) -> DataFrame:
    """Ends (path) of live doc-literal edges."""
    live = edges.filter("kind = 'code.literal-doc' AND deleted_at IS NULL")
    return live.select(F.col("src_id").alias("path")).union(live.select(F.col("dst_id").alias("path"))).distinct()


def orphan_entry_points(entry_points: DataFrame, edges: DataFrame) -> DataFrame:
    """Entry points (path, is_test) that are no tests and that no document mentions, once each, sorted."""
    return entry_points.filter(~F.coalesce("is_test", F.lit(False))).select("path").distinct().join(doc_incident(edges), "path", "left_anti").orderBy("path")


def corroborated(claims: DataFrame, members: DataFrame, calls: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claimed bridges (flow_id, src_id, dst_id, file, line) that an unresolved call of a member bears out, and the rest.

    A claim must match the place of such a call; of several the smallest caller is the witness.
    """
    sites = unresolved_calls(calls, nodes).join(members.select("flow_id", F.col("node").alias("caller_id")), "caller_id")
    sites = sites.select("flow_id", "file", F.col("start_line").alias("line"), "caller_id", "name")
    witness = sites.groupBy("flow_id", "file", "line").agg(F.min(F.struct("caller_id", "name")).alias("w"))
    out = claims.join(witness, ["flow_id", "file", "line"], "left")
    good = out.filter("w IS NOT NULL").select(*claims.columns, F.col("w.caller_id").alias("witness"), F.col("w.name").alias("call_name"))
    return good, out.filter("w IS NULL").select(*claims.columns)


def accepted(bridges: DataFrame, existing: DataFrame, cap: int = MAX_BRIDGES) -> DataFrame:
    """Bridges with outcome: write, preserved (user's, adjudicated or deleted ones stay as they are) or truncated, by key order."""
    marked = capped(bridges, ["key"], cap)
    kept = existing.filter("layer = 'user' OR adjudication IS NOT NULL OR deleted_at IS NOT NULL").select("key").distinct().withColumn("__kept", F.lit(True))
    outcome = F.when(~F.col("within_cap"), "truncated").when(F.col("__kept"), "preserved").otherwise("write")
    return marked.join(kept, "key", "left").withColumn("outcome", outcome).drop("__kept", "within_cap")


def write_plan(bridges: DataFrame, descriptions: DataFrame, existing: DataFrame, elapsed_ms: int = 0, max_bridges: int = MAX_BRIDGES, max_descriptions: int = MAX_DESCRIPTIONS, deadline_ms: int = DEADLINE_MS) -> tuple[DataFrame, DataFrame]:
    """Bridges with their outcome, and descriptions (symbol_path, …) with theirs; past the deadline no description is written."""
    marked = capped(descriptions, ["symbol_path"], 0 if elapsed_ms > deadline_ms else max_descriptions)
    return accepted(bridges, existing, max_bridges), marked.withColumn("outcome", F.when(F.col("within_cap"), "write").otherwise("truncated")).drop("within_cap")
