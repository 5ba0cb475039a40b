"""Run trajectories: interval and as-of joins of launches, context steps, availability, spines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.operators.ordinals import numbered, running_max


def match_spans(records: DataFrame, spans: DataFrame, key: list[str]) -> DataFrame:
    """The span (launch_at, result_at, pos, …) of each record (…, at, record_id) under ``key``.

    The last span that holds the record's time; else the latest launch at or before it; else the
    last launch. A span stands in the one or two cells, as wide as the next power of two of its length, that it
    touches, and a record looks into its cell of each width there is (64 at most); so it meets spans
    near its time, not all of its key. The latest launch is a running maximum in time order, which
    each partition of a range takes by itself but for one launch that is carried in, so a key with very many records is spread.
    """
    own = [c for c in spans.columns if c not in key]
    told = spans.select(*key, F.struct(*own).alias("span"))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    a, b = micros(F.col("span.launch_at")), micros(F.col("span.result_at"))
    closed = told.withColumns({"__a": a, "__z": b}).filter("__a <= __z").withColumn("__w", F.length(F.bin(F.col("__z") - F.col("__a"))))
    at = F.col("at")
    found = records.select("record_id", *key, "at")
    widths = sorted(r[0] for r in closed.select("__w").distinct().collect())
    out = found
    if widths:
        cells = closed.withColumn("__c", F.explode(F.expr("sequence(shiftright(__a, __w), shiftright(__z, __w))")))
        look = found.withColumns({"__t": micros(at), "__w": F.explode(F.array(*(F.lit(w) for w in widths)))}).withColumn("__c", F.expr("shiftright(__t, __w)"))
        inside = look.join(cells, [*key, "__w", "__c"]).filter("__a <= __t AND __t <= __z")
        out = out.join(inside.groupBy("record_id").agg(F.max_by("span", F.col("span.pos")).alias("__in")), "record_id", "left")
    else:
        out = out.withColumn("__in", F.lit(None).cast(told.schema["span"].dataType))
    launch = F.struct(F.col("span.launch_at").alias("t"), F.col("span.pos").alias("p"), "span")
    both = found.select(*key, F.col("at").alias("__t"), F.lit(1).alias("__k"), "record_id", F.lit(None).cast(told.select(launch.alias("x")).schema["x"].dataType).alias("__l"))
    both = both.unionByName(told.filter("span.launch_at IS NOT NULL").select(*key, F.col("span.launch_at").alias("__t"), F.lit(0).alias("__k"), launch.alias("__l")), allowMissingColumns=True)
    timed = running_max(both.filter("__t IS NOT NULL"), key, ["__t", "__k"], "__l", "__best")
    before = timed.filter("__k = 1").select("record_id", F.col("__best.span").alias("__before"))
    last = told.groupBy(*key).agg(F.max_by("span", F.col("span.pos")).alias("__last"))
    out = out.join(before, "record_id", "left").join(last, key, "left")
    rank = F.when(F.col("__in").isNotNull(), 2).when(F.col("__before").isNotNull(), 1).when(F.col("__last").isNotNull(), 0)
    best = out.select("record_id", F.coalesce("__in", "__before", "__last").alias("span"), rank.alias("match"))
    return records.join(best, "record_id").select(*records.columns, "span", "match")


def parsed_time(iso: Column) -> Column:
    return F.try_to_timestamp(iso)


def with_agent(spans: DataFrame, metas: DataFrame) -> DataFrame:
    """Spans (tool_use_id, agent_id) whose missing agent comes from meta files (tool_use_id, agent_id)."""
    found = metas.groupBy("tool_use_id").agg(F.min("agent_id").alias("__agent"))
    return spans.join(found, "tool_use_id", "left").withColumn("agent_id", F.coalesce("agent_id", "__agent")).drop("__agent")


#: Why a transcript is unavailable, first failure wins.
TIERS = ("no_session", "path_not_recorded", "file_missing", "no_reconciler_span", "subagent_file_missing")


def availability(records: DataFrame) -> DataFrame:
    """``records`` (session_id, transcript_path, has_transcript, span, has_subagent) with tier, null when all is there."""
    absent = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    tests = [F.col("session_id").isNull(), F.col("transcript_path").isNull(), absent("has_transcript"), F.col("span").isNull(), absent("has_subagent")]
    tier = reduce(lambda acc, x: acc.when(x[0], x[1]), list(zip(tests[1:], TIERS[1:], strict=True)), F.when(tests[0], TIERS[0]))
    return records.withColumn("tier", tier)


def spine(run_id: str, parts: list[DataFrame]) -> DataFrame:
    """Steps of four kinds (kind, pos, at, summary, detail) in one order with a contiguous ordinal from 0.

    ``parts`` come in the order of the kinds; a stitch part belongs to the newest record only.
    """
    each = reduce(DataFrame.unionByName, (p.select(F.lit(i).alias("part"), "pos", "kind", "at", "summary", "detail") for i, p in enumerate(parts)))
    steps = numbered(each, ["part", "pos", "kind", "at", "summary", "detail"], "ordinal")
    return steps.select(F.lit(run_id).alias("run_id"), F.col("ordinal").cast("int").alias("ordinal"), "kind", "at", "summary", "detail")


def rendered(steps: DataFrame) -> DataFrame:
    return steps.select("ordinal", F.concat_ws("  ", F.lpad(F.col("ordinal").cast("string"), 3, " "), F.concat(F.lit("["), "kind", F.lit("]")), F.coalesce("at", F.lit("-")), "summary").alias("line"))
