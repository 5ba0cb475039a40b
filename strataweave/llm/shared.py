"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import ctypes
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"
#: Bytes of text that a Python operator turns into objects at once; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20
#: Bytes of an Arrow batch on its way to Python; a longer row is a batch of its own.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
#: Open scratch scopes of this thread, innermost last; a table belongs to the innermost at the time it is written.
_scopes: ContextVar[tuple[Scratch, ...]] = ContextVar("scopes", default=())
#: The one large object that a worker process keeps between tasks, by its key.
_resident: dict[tuple, object] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only where the session names none and its master is local (tests) a temporary folder is made,
    named in the session and removed at exit.
    """
    found = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None)
    if not found:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError(f"{SETTING} must name a folder that driver and executors share")
        made = tempfile.mkdtemp(prefix="strataweave-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        found = f"file://{made}"
        spark.conf.set(SETTING, found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/strataweave/{name}-{uuid.uuid4().hex}"


class Scratch:
    """Removes the tables written within it, by ``release`` or at the end of a ``with`` block that asks for it.

    Only what has been written out since may be read later; ``keep`` copies a small result to the
    scope around.
    """

    def __init__(self, spark: SparkSession, at_exit: bool = True):
        self.spark, self.at_exit, self.paths = spark, at_exit, []

    def __enter__(self) -> Scratch:
        _scopes.set((*_scopes.get(), self))
        return self

    def __exit__(self, *_) -> None:
        _scopes.set(tuple(s for s in _scopes.get() if s is not self))
        if self.at_exit:
            self.release()

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        around = _scopes.get()
        _scopes.set(tuple(s for s in around if s is not self))
        try:
            return staged(df, name)
        finally:
            _scopes.set(around)

    def release(self) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for p in self.paths:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)
        self.paths.clear()


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Readers then see one materialised result whatever executors are lost, and
    values such as row numbers stay as they were written.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    if scopes := _scopes.get():
        scopes[-1].paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def is_file_scan(df: DataFrame) -> bool:
    """Whether ``df`` is just the rows of Parquet files, so that a file and a place in it name a row."""
    plan = df._jdf.queryExecution().analyzed()
    return plan.getClass().getSimpleName() == "LogicalRelation" and "_metadata" not in df.columns and "parquet" in plan.toString().lower()


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column that names each row the same at each reading, and that column's name.

    Rows of files are named by their file (64 bits of its path) and place; anything else is written
    first, with a number for each row.
    """
    row = free_name(docs, "__row")
    if is_file_scan(docs):
        return docs.select("*", F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")).alias(row)), row
    return staged(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


#: Bits of the filter of ``without_rows``; as a table it has a row for each 64 of them at most.
FILTER_BITS = 1 << 24


def marks(values: DataFrame, bits: int, name: str) -> DataFrame:
    """A bit map over the hashed values of a one-column table, as (cell, bits): at most ``bits`` / 64 rows, written."""
    at = F.pmod(F.xxhash64(F.col(values.columns[0])), F.lit(bits)).alias("at")
    cells = values.select(at).groupBy(F.shiftright("at", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, int(at & 63))")).alias("bits"))
    return staged(cells, name)


def marked(df: DataFrame, value: Column, cells: DataFrame, bits: int, flag: str) -> DataFrame:
    """``df`` with ``flag``: whether the bit map has ``value``; it has all that it was made of, and some others."""
    at = free_name(df, f"{flag}_at")
    own = df.withColumn(at, F.pmod(F.xxhash64(value), F.lit(bits)))
    cells = F.broadcast(cells.toDF(cell := free_name(df, f"{flag}_cell"), word := free_name(df, f"{flag}_bits")))
    there = F.expr(f"(shiftrightunsigned(`{word}`, int(`{at}` & 63)) & 1) = 1")
    out = own.join(cells, F.shiftright(own[at], 6) == cells[cell], "left")
    return out.select(*(own[f"`{c}`"] for c in df.columns), F.coalesce(there, F.lit(False)).alias(flag))


def without_rows(own: DataFrame, row: str, dropped: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """``own`` without the rows whose number is in ``dropped`` (one column, the number).

    Most rows are settled where they are: a bit map over hashed numbers, broadcast as a table of at
    most ``bits`` / 64 rows, says which can't be dropped. Only the others cross the network, so
    long texts that stay are not shuffled. With more drops than bits more is let through to the join, no less right.
    """
    gone, maybe = free_name(own, "__gone"), free_name(own, "__maybe")
    drops = staged(dropped.select(F.col(dropped.columns[0]).alias(gone)).distinct(), "dropped")
    all_rows = marked(own, F.col(row), marks(drops, bits, "dropped-bits"), bits, maybe)
    doubtful = all_rows.filter(F.col(maybe)).drop(maybe)
    return all_rows.filter(~F.col(maybe)).drop(maybe).unionByName(doubtful.join(drops, F.col(row) == F.col(gone), "left_anti"))


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of ``most`` bytes in the column given, or of one row: what a worker holds
    as Python objects doesn't grow with the rows of a batch times the length of its texts."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < batch.num_rows:
        done = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(first, last - first)
        first = last


def bounded(batches: Iterator[pa.RecordBatch], column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The slices of all batches; after each batch Arrow gives back what it holds and doesn't use."""
    for whole in batches:
        yield from slices(whole, column, most)
        pa.default_memory_pool().release_unused()


def give_back() -> None:
    """Returns freed memory to the system, which a worker that waits for its next task would hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for a partition, after which freed memory goes back."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def with_small_batches(spark: SparkSession) -> SparkSession:
    """Bounds the bytes of a batch that goes to Python, in either process, unless the session has a smaller bound."""
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_SETTING)) > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, f"{BATCH_BYTES}b")
    return spark


def resident(key: tuple, make: Callable[[], object]) -> object:
    """The object under ``key``, made unless this worker process has it. A process keeps one at a
    time, so what an operator leaves in a reused worker goes when another operator comes."""
    if key not in _resident:
        _resident.clear()
        _resident[key] = make()
    return _resident[key]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
