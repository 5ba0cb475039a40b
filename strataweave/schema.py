"""Fixed relational schemas and the tier ladder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ownership tiers, lowest first.
TIER_RANK = {"raw": 0, "agentic": 1, "user": 2}
SCHEMA_VERSION = 2

_TYPES = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType()}
_TYPES["strings"] = T.ArrayType(T.StringType())
_TYPES["tiers"] = T.MapType(T.StringType(), T.StringType())
_TYPES["resolutions"] = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("symbol_id", "confidence", "reason")]))


def _table(columns: str) -> T.StructType:
    """Columns by name, a type after a colon, string without one."""
    pairs = (c.partition(":") for c in columns.split())
    return T.StructType([T.StructField(name, _TYPES[kind or "string"]) for name, _, kind in pairs])


NODES = _table("id kind path anchor layer attributes field_ownership:tiers origin intent_source deleted_at")
EDGES = _table("key src_id dst_id kind confidence:double layer attributes field_ownership:tiers origin intent_source adjudication deleted_at")
PROVENANCE = _table("edge_key source_file source_range extractor_id extractor_version")
FILE_HASHES = _table("path sha256 size:long last_seen_at")
ANCHOR_RESOLUTION = _table("anchor status reason symbol_path content_hash span_hash resolved_at")
#: What reconciliation keeps between turns: the call edges it saw, the seeds of each key and what they reach.
CALL_EDGES, REACH = _table("src dst"), _table("key node")

#: Tables of a store; the disposable ones may be dropped and made again.
TABLES = {"nodes": NODES, "edges": EDGES, "edge_provenance": PROVENANCE, "file_hashes": FILE_HASHES, "anchor_resolution": ANCHOR_RESOLUTION, "call_edges": CALL_EDGES, "reach_seeds": REACH, "reach": REACH}
KEYS = {"nodes": ["id"], "edges": ["key"], "edge_provenance": ["edge_key", "source_file", "source_range", "extractor_id"], "file_hashes": ["path"], "anchor_resolution": ["anchor"], "call_edges": ["src", "dst"], "reach_seeds": ["key", "node"], "reach": ["key", "node"]}
DISPOSABLE = {"nodes": False, "edges": False, "edge_provenance": False, "file_hashes": False, "anchor_resolution": True, "call_edges": True, "reach_seeds": True, "reach": True}

#: Tables of a call graph.
CG_NODES = _table("symbol_id name file_path start_line:int kind enclosing:strings is_test:boolean docstring body_source")
CG_CALLS = _table("caller_id call_ix:int name file start_line:int start_col:int end_line:int end_col:int is_callback:boolean resolutions:resolutions")
CG_ENTRY_POINTS = _table("symbol_id")


def tier_rank(tier: Column) -> Column:
    """Rank of a tier; absent counts as raw."""
    return F.when(tier == "user", 2).when(tier == "agentic", 1).otherwise(0)
