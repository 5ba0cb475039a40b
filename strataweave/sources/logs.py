"""Line logs and small JSON files: run records, sync status, grades, pending work, manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataweave.operators.flows import last_wins
from strataweave.sources.store import Files, replaced

OUTCOME = "struct<flow_id:string,action:string,kind:string,member_count:long,last_synced_at:string,reason:string>"
RUN = (
    "schema_version int, run_id string, session_id string, transcript_path string, instruction string, timestamp string,"
    f" detail struct<mode:string,file_set:array<string>,outcomes:array<{OUTCOME}>,deferred_retirements:array<struct<flow_id:string,reason:string>>,"
    "deferred_skill_syncs:array<struct<skill_root:string,reason:string>>,description_counts:map<string,long>,diagnostics:array<string>>"
)
GRADE = "schema_version int, run_id string, verdict string, reason string, graded_at string, judged_at string, detail struct<mode:string,file_set:array<string>,transcript_available:boolean>"
STATUS = "last_attempt_at string, last_success_at string, last_error struct<at:string,message:string>"
PENDING = "version int, files array<string>, session struct<session_id:string,cwd:string,instruction:string>"
VERDICTS = ("good", "bad", "mixed")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, line_no) of a text file; none for a missing one. Numbers follow the file order, empty lines count and are left out.

    The file is read by ranges of bytes that are cut at line ends; a line's number is the lines of earlier ranges and its
    place in its own, so a log of any length is read by many tasks.
    """
    if not Files(spark).exists(path):
        return spark.createDataFrame([], "line string, line_no long")
    raw = spark.read.option("lineSep", "\n").text(path)
    each = raw.select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("at"))
    # Rows of a range follow one another in one task, whatever ranges a task reads.
    sizes = each.groupBy("f", "b").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("low"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("f", "b", "low", before.alias("before")))
    own = each.join(offsets, ["f", "b"]).select(F.regexp_replace("value", "\r$", "").alias("line"), (F.col("before") + F.col("at") - F.col("low")).alias("line_no"))
    return own.filter("line <> ''")


def parsed(rows: DataFrame, schema: str) -> DataFrame:
    """Records of JSON lines (line, line_no) as ``r``; torn lines are null."""
    return rows.select("line_no", "line", F.from_json("line", schema, {"mode": "PERMISSIVE"}).alias("r"))


def current_records(rows: DataFrame, schema: str) -> DataFrame:
    """Records of the present schema version with a detail object, newest first; all others are skipped."""
    has_detail = F.coalesce(F.startswith(F.schema_of_variant(F.try_variant_get(F.try_parse_json("line"), "$.detail", "variant")), F.lit("OBJECT")), F.lit(False))
    good = parsed(rows, schema).filter(has_detail & (F.col("r.schema_version") == 1) & F.col("r.run_id").isNotNull())
    return good.select("line_no", "r.*").orderBy(F.desc("line_no"))


def run_log(spark: SparkSession, path: str) -> DataFrame:
    return current_records(lines(spark, path), RUN)


def latest(records: DataFrame) -> DataFrame:
    return records.orderBy(F.desc("line_no")).limit(1)


def by_run_id(records: DataFrame, run_id: str) -> DataFrame:
    return records.filter(F.col("run_id") == run_id)


def register(rows: DataFrame, schema: str = GRADE) -> DataFrame:
    """The last valid line of each run: grades, or a judge's verdicts."""
    good = parsed(rows, schema).select("line_no", "r.*").filter(F.col("run_id").isNotNull() & F.col("verdict").isin(*VERDICTS) & (F.coalesce("schema_version", F.lit(0)) == 1))
    return last_wins(good, ["run_id"], "line_no")


def append_run(record: DataFrame, folder: str) -> None:
    """One more file of JSON lines in a log folder."""
    record.write.mode("append").json(folder)


def upsert_grade(register_: DataFrame, grades: DataFrame) -> DataFrame:
    """The register after new grades, keyed by run."""
    return replaced(register_, grades.select(*register_.columns), ["run_id"])


def sync_status(spark: SparkSession, path: str) -> dict:
    """The status file over empty defaults; what can't be read counts as nothing."""
    out = {"last_attempt_at": None, "last_success_at": None, "last_error": None}
    try:
        found = json.loads(Files(spark).read(path) or "{}")
    except ValueError:
        found = {}
    return out | ({k: v for k, v in found.items() if k in out} if isinstance(found, dict) else {})


def merge_sync_status(spark: SparkSession, path: str, **changes) -> dict:
    out = sync_status(spark, path) | changes
    Files(spark).write(path, json.dumps(out))
    return out


def pending(rows: DataFrame, text: str = "text") -> DataFrame:
    """(files, session) of pending-work texts: malformed files give null, a malformed session leaves the files."""
    v = F.try_parse_json(text)
    files = F.try_variant_get(v, "$.files", "array<string>")
    session = F.try_variant_get(v, "$.session", "struct<session_id:string,cwd:string,instruction:string>")
    whole = session["session_id"].isNotNull() & session["cwd"].isNotNull()
    return rows.select("*", F.when(F.schema_of_variant(F.try_variant_get(v, "$.files", "variant")).rlike("^ARRAY<(STRING|VOID)>$"), files).alias("files"), F.when(whole, session).alias("session"))


def merged_pending(older: dict | None, newer: dict) -> dict:
    """Files of both in first-seen order; the newest session stands."""
    older = older or {}
    files = list(dict.fromkeys([*older.get("files", []), *newer.get("files", [])]))
    out = {"version": 1, "files": files}
    session = newer.get("session") or older.get("session")
    return out | ({"session": session} if session else {})


def manifests(spark: SparkSession, folder: str, name: str = "fixture.json") -> DataFrame:
    """(dir, ok, …) of the manifests in sub-folders, sorted; foreign and malformed ones are marked."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(folder, wholetext=True)
    v = F.try_parse_json("value")
    ok = F.coalesce(F.try_variant_get(v, "$.schema_version", "int") == 1, F.lit(False)) & F.try_variant_get(v, "$.fixture", "string").isNotNull()
    dir_ = F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1)
    return raw.select(dir_.alias("dir"), ok.alias("ok"), F.when(ok, F.try_variant_get(v, "$.fixture", "string")).alias("fixture"), v.alias("manifest")).orderBy("dir")


def harvest(runs: DataFrame, flows: DataFrame, run_id: str) -> DataFrame:
    """One row of what a run's live flows hold: distinct members, bridges, kind. ``flows`` (flow_id, live, anchor_set, bridge_count)."""
    ids = runs.filter(F.col("run_id") == run_id).select(F.explode("detail.outcomes.flow_id").alias("flow_id")).distinct()
    own = flows.filter("live").join(ids, "flow_id", "left_semi")
    members = F.array_sort(F.array_distinct(F.flatten(F.collect_list("anchor_set"))))
    return own.agg(F.count(F.lit(1)).alias("flows"), members.alias("members"), F.coalesce(F.sum("bridge_count"), F.lit(0)).alias("bridges")).withColumn("kind", F.when(F.col("bridges") > 0, "stitch").when(F.col("flows") == 1, "stitch_seeds_only").otherwise("decline"))
