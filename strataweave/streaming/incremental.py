"""Position cursors, hand-offs and the streaming form of a turn.

A cursor counts lines of one transcript; it is no event-time watermark. The streaming form takes
the file source's own offsets for a cursor and its checkpoint for the hand-off.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.functions.predicates import stale_cursor
from strataweave.sources.logs import merged_pending
from strataweave.sources.store import Files
from strataweave.sources.transcripts import edited_files


def cursor_of(text: str | None) -> dict:
    """A stored cursor; a malformed one is fresh."""
    try:
        found = json.loads(text or "")
        return {"transcript_path": str(found["transcript_path"]), "lines_processed": int(found["lines_processed"])}
    except (ValueError, KeyError, TypeError):
        return {"transcript_path": None, "lines_processed": 0}


def cursor_text(cursor: dict) -> str:
    return json.dumps(cursor)


def since(lines: DataFrame, path: str, cursor: dict) -> tuple[DataFrame, dict]:
    """Lines at or past the cursor, and the cursor after them; another transcript or a shrunk file starts anew."""
    total = lines.agg(F.coalesce(F.max("line_no") + 1, F.lit(0))).first()[0]
    start = cursor["lines_processed"] if cursor["transcript_path"] == path and cursor["lines_processed"] <= total else 0
    return lines.filter(F.col("line_no") >= start), {"transcript_path": path, "lines_processed": total}


def worked_on_since(lines: DataFrame, path: str, cursor: dict) -> tuple[DataFrame, dict]:
    """Files edited since the cursor, in first-seen order."""
    new, after = since(lines, path, cursor)
    return edited_files(new), after


def expired_cursors(cursors: DataFrame, prefix: str = "cursor-", suffix: str = ".json", days: float = 7) -> DataFrame:
    """(name, age_days) of cursor files that are old enough to go."""
    return cursors.filter(stale_cursor(F.col("name"), F.col("age_days"), prefix, suffix, days))


def should_trigger(re_entrant: bool, edited: DataFrame) -> bool:
    return not re_entrant and not edited.isEmpty()


def process_lives(owner: str) -> bool:
    """Whether the process that an owner names lives on this machine; an owner of another form counts as alive."""
    if not owner.isdigit():
        return True
    try:
        os.kill(int(owner), 0)
    except ProcessLookupError:
        return False
    except (PermissionError, OverflowError):
        return True
    return True


class Handoff:
    """Pending work in one file: staged before a cursor moves, claimed by a rename, put back on failure."""

    def __init__(self, spark: SparkSession, folder: str):
        self.files, self.folder = Files(spark), folder.rstrip("/")
        self.path = f"{self.folder}/pending.json"

    def _read(self, path: str) -> dict | None:
        try:
            found = json.loads(self.files.read(path) or "null")
            return found if isinstance(found, dict) and isinstance(found.get("files"), list) else None
        except ValueError:
            return None

    def stage(self, files: list[str], session: dict | None = None) -> dict:
        merged = merged_pending(self._read(self.path), {"files": files} | ({"session": session} if session else {}))
        self.files.write(self.path, json.dumps(merged))
        return merged

    def claim(self, owner: str | None = None, alive: Callable[[str], bool] | None = None) -> tuple[dict, str] | None:
        """The pending work and its claim; first takes back claims whose owner is gone. Only one caller wins the rename."""
        alive = alive or process_lives
        for name in self.files.names(self.folder):
            if name.startswith("pending.claim-") and not alive(name.removeprefix("pending.claim-")):
                self.restore(f"{self.folder}/{name}")
        claim = f"{self.folder}/pending.claim-{owner or os.getpid()}"
        if not self.files.rename(self.path, claim):
            return None
        return self._read(claim) or {"version": 1, "files": []}, claim

    def consume(self, claim: str) -> None:
        self.files.delete(claim)

    def restore(self, claim: str) -> None:
        """Puts claimed work back, together with what was staged meanwhile."""
        old = self._read(claim)
        if old:
            self.files.write(self.path, json.dumps(merged_pending(old, self._read(self.path) or {"files": []})))
        self.files.delete(claim)


def stop_turn(lines: DataFrame, path: str, cursor: dict, handoff: Handoff, re_entrant: bool = False, session: dict | None = None) -> dict:
    """One stop event: stages edited files, and only then moves the cursor, so a crash between repeats work and loses none."""
    edited, after = worked_on_since(lines, path, cursor)
    if re_entrant:
        return cursor
    files = [r.path for r in edited.select("path").collect()]  # the files of one session
    if files:
        handoff.stage(files, session)
    return after


def stream_edits(spark: SparkSession, folder: str) -> DataFrame:
    """Transcript lines as they arrive in ``folder`` (text files); offsets are the source's checkpoint."""
    return spark.readStream.text(folder).select(F.col("value").alias("line"), F.input_file_name().alias("file"))


def run_turns(stream: DataFrame, turn: Callable[[DataFrame], None], checkpoint: str, interval: str | None = None):
    """Calls ``turn(paths)`` with the changed files (path) of each batch that has any.

    A batch is committed after ``turn`` returns, so work is repeated rather than lost; a turn must be
    idempotent. ``interval`` debounces; without it what is there is worked off once. One query runs
    one batch at a time, and what arrives meanwhile is one trailing batch.
    """
    from strataweave.sources.transcripts import EDIT_TOOLS, LINE

    def each(batch: DataFrame, _: int) -> None:
        said = batch.select(F.from_json("line", LINE).alias("r")).filter("r.type = 'assistant'")
        rows = said.select(F.explode("r.message.content").alias("item")).filter((F.col("item.type") == "tool_use") & F.col("item.name").isin(*EDIT_TOOLS))
        paths = rows.select(F.coalesce("item.input.file_path", "item.input.notebook_path").alias("path")).filter("path IS NOT NULL").distinct()
        if not paths.isEmpty():
            turn(paths)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def debounced(events: DataFrame, gap: str = "500 milliseconds", key: str = "path", at: str = "ts") -> DataFrame:
    """Bursts of events (key, at) as one row each: first, last and number. A stream needs a watermark on ``at``."""
    w = F.session_window(at, gap).alias("w")
    return events.groupBy(key, w).agg(F.count(F.lit(1)).alias("events")).select(key, F.col("w.start").alias("first"), F.col("w.end").alias("until"), "events")


def first_seen(rows: DataFrame, key: list[str], pos: str, cursor: int = 0) -> DataFrame:
    """Each key's first place at or past a cursor."""
    return rows.filter(F.col(pos) >= cursor).groupBy(*key).agg(F.min(pos).alias("first"))
