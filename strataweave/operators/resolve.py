"""Entity resolution of anchors, symbol deltas and the re-keying they ask for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.functions.identity import DESCRIPTION_PREFIX, anchor, description_id, symbol_path
from strataweave.functions.text import content_hash, span_hash


def callables(definitions: DataFrame) -> DataFrame:
    """Callable definitions, from per-file trees (file_path, functions, classes, interfaces) of structs.

    Top-level functions, constructors and methods of classes, methods of interfaces; without
    those that have no body or no name.
    """
    each = lambda col, owner: definitions.select("file_path", F.inline(col)) if not owner else definitions.select("file_path", F.explode(col).alias("o")).select("file_path", F.col("o.name").alias("owner"), F.inline("o.members"))
    top = each("functions", False).select("file_path", "name", "kind", F.array().cast("array<string>").alias("enclosing"), "body_source")
    held = [each(c, True).select("file_path", "name", "kind", F.array("owner").alias("enclosing"), "body_source") for c in ("classes", "interfaces")]
    return top.unionByName(held[0]).unionByName(held[1]).filter("body_source IS NOT NULL AND name <> '<anonymous>'")


def code_states(symbols: DataFrame) -> DataFrame:
    """``symbols`` (file_path, enclosing, name, kind, body_source, …) with symbol_path, content_hash, span_hash and anchor."""
    out = symbols.withColumn("symbol_path", symbol_path(F.col("file_path"), F.col("enclosing"), F.col("name"), F.col("kind")))
    out = out.withColumns({"content_hash": content_hash(F.col("body_source"), F.col("name")), "span_hash": span_hash(F.col("body_source"))})
    return out.withColumn("anchor", anchor(F.col("symbol_path"), F.col("content_hash")))


def unique_index(states: DataFrame) -> DataFrame:
    """States by symbol_path; raises where a path stands twice."""
    n = F.count(F.lit(1))
    rest = [c for c in states.columns if c != "symbol_path"]
    out = states.groupBy("symbol_path").agg(n.alias("n"), *(F.first(c).alias(c) for c in rest))
    ok = F.when(F.col("n") == 1, F.col("symbol_path")).otherwise(F.raise_error(F.concat(F.lit("duplicate symbol path: "), F.col("symbol_path"))).cast("string"))
    return out.withColumn("symbol_path", ok).drop("n")


def deduplicated_index(states: DataFrame, ordinal: str) -> tuple[DataFrame, DataFrame]:
    """The first state of each symbol_path in input order, and the ones dropped."""
    rest = [c for c in states.columns if c != "symbol_path"]
    first = states.groupBy("symbol_path").agg(F.min_by(F.struct(*rest), ordinal).alias("__r"))
    kept = first.select(*(F.col(c) if c == "symbol_path" else F.col(f"__r.{c}").alias(c) for c in states.columns))
    low = kept.select(F.col("symbol_path").alias("__path"), F.col(ordinal).alias("__first"))
    dropped = states.join(low, F.col("symbol_path").eqNullSafe(F.col("__path"))).filter(F.col(ordinal) > F.col("__first"))
    return kept, dropped.select(*states.columns)


def by_content(states: DataFrame) -> DataFrame:
    """(content_hash, first, second): the two smallest symbol paths of each content, whatever their number.

    Two are enough to find the smallest one that differs from a given path, and a mergeable pair
    stays bounded where a content has very many copies.
    """
    low = states.groupBy("content_hash").agg(F.min("symbol_path").alias("first"))
    rest = states.join(low, "content_hash").filter("symbol_path <> first").groupBy("content_hash").agg(F.min("symbol_path").alias("second"))
    return low.join(rest, "content_hash", "left")


def resolve_anchors(anchors: DataFrame, states: DataFrame) -> DataFrame:
    """Verdict of each anchor (symbol_path, content_hash, …) against the states of today.

    Adds status (hit, downgrade, miss), reason (body-changed, relocated, null) and new_path: the
    same path first; else the smallest other path with the same content; else a miss.
    """
    same = states.select("symbol_path", F.col("content_hash").alias("__hash"))
    out = anchors.join(same, "symbol_path", "left").join(by_content(states), "content_hash", "left")
    moved = F.when(F.col("first") != F.col("symbol_path"), F.col("first")).otherwise(F.col("second"))
    here = F.col("__hash").isNotNull()
    status = F.when(here & (F.col("__hash") == F.col("content_hash")), "hit").when(here | moved.isNotNull(), "downgrade").otherwise("miss")
    reason = F.when(here & (F.col("__hash") != F.col("content_hash")), "body-changed").when(~here & moved.isNotNull(), "relocated")
    path = F.when(here, F.col("symbol_path")).otherwise(moved)
    return out.select(*(F.col(c) for c in anchors.columns), status.alias("status"), reason.alias("reason"), path.alias("new_path"))


def symbol_delta(baseline: DataFrame, fresh: DataFrame) -> DataFrame:
    """(bucket, symbol_path, to_path): modified, relocated, removed and added symbols between two states."""
    seen = resolve_anchors(baseline.select("symbol_path", "content_hash"), fresh)
    bucket = F.when(F.col("status") == "miss", "removed").when(F.col("reason") == "relocated", "relocated").when(F.col("reason") == "body-changed", "modified")
    changed = seen.select(bucket.alias("bucket"), "symbol_path", F.when(F.col("reason") == "relocated", F.col("new_path")).alias("to_path")).filter("bucket IS NOT NULL")
    known = baseline.select("symbol_path").union(seen.filter("reason = 'relocated'").select("new_path"))
    added = fresh.select("symbol_path").distinct().join(known.distinct(), "symbol_path", "left_anti")
    return changed.unionByName(added.select(F.lit("added").alias("bucket"), "symbol_path", F.lit(None).cast("string").alias("to_path")))


def baseline_anchors(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of preserved nodes (id, symbol_path, content_hash) the anchor of the smallest id for each path, and the paths whose anchors differ."""
    out = nodes.groupBy("symbol_path").agg(F.min_by("content_hash", "id").alias("content_hash"), F.count_distinct("content_hash").alias("n"))
    return out.select("symbol_path", "content_hash"), out.filter("n > 1").select("symbol_path")


def preserved_in(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Nodes above the raw tier that are anchored in ``files`` (path)."""
    return nodes.filter("layer <> 'raw' AND anchor IS NOT NULL").join(files.select("path").distinct(), "path", "left_semi")


def verdicts(nodes: DataFrame, states: DataFrame) -> DataFrame:
    """What becomes of preserved nodes (id, kind, symbol_path, content_hash): keep, rekey to new_id, or delete."""
    out = resolve_anchors(nodes, states)
    is_description = F.startswith("id", F.lit(DESCRIPTION_PREFIX))
    new_id = F.when(is_description, description_id(F.col("new_path"))).otherwise(F.replace(F.col("id"), F.col("symbol_path"), F.col("new_path")))
    action = F.when(F.col("status") == "miss", "delete").when(F.col("reason") == "relocated", "rekey").otherwise("keep")
    return out.withColumn("action", action).withColumn("new_id", F.when(action == "rekey", new_id))


def rekeys(verdicts_: DataFrame, live_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Re-keys to apply and those left out: after the deletions, a target that lives already stays, and of several moves to one target the smallest id goes."""
    gone = verdicts_.filter("action = 'delete'").select("id")
    taken = live_ids.select("id").join(gone, "id", "left_anti").select(F.col("id").alias("new_id"))
    moves = verdicts_.filter("action = 'rekey'")
    first = moves.groupBy("new_id").agg(F.min("id").alias("id")).join(taken, "new_id", "left_anti")
    return moves.join(first, ["id", "new_id"], "left_semi"), moves.join(first, ["id", "new_id"], "left_anti")


def stale_edges(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Existing edges (key, …) that the fresh ones lack."""
    return existing.join(fresh.select("key").distinct(), "key", "left_anti")
