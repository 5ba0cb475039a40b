"""Streams with state: what changed in a store, how far each transcript was read, and bursts of events.

Each has a batch form over a table of the same events, which gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strataweave.operators.ordinals import running_max
from strataweave.sources.store import GraphStore
from strataweave.streaming.incremental import debounced

#: Fixed value: days after which a cursor is forgotten.
CURSOR_DAYS = 7
READ = "path string, at timestamp, from_line long, to_line long"


def started(writer, checkpoint: str, interval: str | None):
    """The query of a writer: by an interval, or once over what is there."""
    own = writer.option("checkpointLocation", checkpoint)
    return (own.trigger(processingTime=interval) if interval else own.trigger(availableNow=True)).start()


def follow_store(spark: SparkSession, path: str, on_changes: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = None):
    """Calls ``on_changes(rows, version)`` with the net changes (table, key, change) of a store since the version told before.

    The source's offsets are the versions that the store has told of, so a restart from the checkpoint repeats none; several
    commits between two polls give each net change once.
    """
    told = spark.readStream.schema("version long, since long").json(f"{path.rstrip('/')}/versions")

    def each(batch: DataFrame, _: int) -> None:
        span = batch.agg(F.min("since").alias("since"), F.max("version").alias("to")).first()
        if span["to"] is not None:
            on_changes(GraphStore(spark, path, read_only=True, version=span["to"]).diff(span["since"]), span["to"])

    return started(told.writeStream.foreachBatch(each), checkpoint, interval)


def read_ranges(events: DataFrame, days: int = CURSOR_DAYS) -> DataFrame:
    """(path, at, from_line, to_line) for each time (path, at, lines) that a transcript of so many lines is read.

    It goes on where it ended the time before; a new path, a shorter file and a cursor older than ``days`` start anew.
    """
    own = events.select("path", "at", F.col("lines").cast("long").alias("lines")).withColumn("seen", F.struct("at", "lines"))
    before = running_max(own, ["path"], ["at", "lines"], "seen", "last", before=True)
    fresh = F.col("last").isNull() | (F.col("lines") < F.col("last.lines")) | (F.col("at") > F.col("last.at") + F.expr(f"INTERVAL {days} DAYS"))
    return before.select("path", "at", F.when(fresh, 0).otherwise(F.col("last.lines")).cast("long").alias("from_line"), F.col("lines").alias("to_line"))


class Cursor(StatefulProcessor):
    """Lines seen of one transcript, as a value that is forgotten after some days."""

    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "at timestamp, lines long", ttlDurationMs=self.days * 86_400_000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.seen.get() if self.seen.exists() else None
        out = []
        for at, lines in pd.concat(list(rows))[["at", "lines"]].sort_values(["at", "lines"]).itertuples(index=False, name=None):
            fresh = last is None or lines < last[1] or at - pd.Timestamp(last[0]) > pd.Timedelta(days=self.days)
            out.append((key[0], at, 0 if fresh else int(last[1]), int(lines)))
            last = (at, int(lines))
        self.seen.update((last[0].to_pydatetime(), last[1]))
        yield pd.DataFrame(out, columns=["path", "at", "from_line", "to_line"])

    def close(self) -> None:
        pass


def stream_read_ranges(events: DataFrame, days: int = CURSOR_DAYS) -> DataFrame:
    """``read_ranges`` of a stream of events (path, at, lines), a cursor for each path as keyed state. The state store must be RocksDB's."""
    own = events.select("path", "at", F.col("lines").cast("long").alias("lines"))
    return own.groupBy("path").transformWithStateInPandas(statefulProcessor=Cursor(days), outputStructType=READ, outputMode="Append", timeMode="ProcessingTime")


def stream_bursts(events: DataFrame, gap: str = "500 milliseconds", late: str = "10 seconds", key: str = "path", at: str = "ts") -> DataFrame:
    """``debounced`` of a stream: a burst is one row when no event of it can come any more, ``late`` after its gap."""
    return debounced(events.withWatermark(at, late), gap, key, at)


def on_bursts(bursts: DataFrame, turn: Callable[[DataFrame], None], checkpoint: str, interval: str | None = None):
    """Calls ``turn(paths)`` with the keys of each batch's bursts; what comes meanwhile is one trailing batch."""

    def each(batch: DataFrame, _: int) -> None:
        paths = batch.select(batch.columns[0]).distinct()
        if not paths.isEmpty():
            turn(paths)

    return started(bursts.writeStream.foreachBatch(each).outputMode("append"), checkpoint, interval)
