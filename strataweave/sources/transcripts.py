"""Session transcripts as tables: edited files, tool steps, launches of a sub-agent, stitch files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.functions.predicates import ADDRESS_FIELDS, EDIT_TOOLS
from strataweave.functions.text import shortened

INPUT = ", ".join(f"{f} string" for f in (*ADDRESS_FIELDS, "subagent_type"))
ITEM = f"type string, name string, id string, tool_use_id string, input struct<{INPUT.replace(' string', ':string')}>"
LINE = f"type string, timestamp string, message struct<role:string,content:array<struct<{', '.join(f.replace(' ', ':', 1) for f in ITEM.split(', ', 4))}>>>, toolUseResult struct<agentId:string>"


def entries(rows: DataFrame) -> DataFrame:
    """(line_no, item_no, type, at, item, agent_id) of transcript lines; malformed ones are left out."""
    r = rows.select("line_no", F.from_json("line", LINE).alias("r"))
    return r.select("line_no", F.posexplode("r.message.content").alias("item_no", "item"), F.col("r.type").alias("type"), F.col("r.timestamp").alias("at"), F.col("r.toolUseResult.agentId").alias("agent_id"))


def tool_uses(rows: DataFrame) -> DataFrame:
    return entries(rows).filter("type = 'assistant' AND item.type = 'tool_use'")


def edited_files(rows: DataFrame) -> DataFrame:
    """(path, pos) of files that editing tools wrote, once each, in first-seen order."""
    path = F.coalesce(F.nullif("item.input.file_path", F.lit("")), F.nullif("item.input.notebook_path", F.lit("")))
    each = tool_uses(rows).filter(F.col("item.name").isin(*EDIT_TOOLS)).select(path.alias("path"), F.struct("line_no", "item_no").alias("pos"))
    return each.filter("path IS NOT NULL").groupBy("path").agg(F.min("pos").alias("pos")).orderBy("pos")


def context_steps(rows: DataFrame) -> DataFrame:
    """(line_no, item_no, tool, target, at): each call's tool and the one field that says what it was about."""
    target = shortened(F.coalesce(*(F.nullif(F.col(f"item.input.{f}"), F.lit("")) for f in ADDRESS_FIELDS), F.lit("")))
    return tool_uses(rows).select("line_no", "item_no", F.col("item.name").alias("tool"), target.alias("target"), "at")


def agent_spans(rows: DataFrame, agent: str) -> DataFrame:
    """(tool_use_id, launch_at, result_at, agent_id, pos) of launches of ``agent``, with their results where there are any."""
    start = tool_uses(rows).filter(F.col("item.input.subagent_type") == agent).select(F.col("item.id").alias("tool_use_id"), F.col("at").alias("launch_at"), F.col("line_no").alias("pos"))
    end = entries(rows).filter("item.type = 'tool_result'").groupBy(F.col("item.tool_use_id").alias("tool_use_id")).agg(F.max_by(F.struct(F.col("at").alias("result_at"), "agent_id"), "line_no").alias("e"))
    return start.join(end, "tool_use_id", "left").select("tool_use_id", "launch_at", "e.result_at", "e.agent_id", "pos")


def stitch_steps(texts: DataFrame, text: str = "json") -> DataFrame:
    """(label, seed_count, rationale) of a stitch file's umbrellas, with defaults for what is missing."""
    u = F.try_variant_get(F.try_parse_json(text), "$.umbrellas", "array<variant>")
    each = texts.select(F.posexplode(u).alias("pos", "u"))
    return each.select("pos", F.coalesce(F.try_variant_get("u", "$.label", "string"), F.lit("?")).alias("label"), F.coalesce(F.size(F.try_variant_get("u", "$.seeds", "array<variant>")), F.lit(0)).alias("seed_count"), F.coalesce(F.try_variant_get("u", "$.rationale", "string"), F.lit("")).alias("rationale"))
