"""Lineage cuts through the shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: What joins of a scope broadcast at most, by the planner's estimate, and rows of a task, about.
BROADCAST, ROWS = 256 << 10, 1_000_000
LIMIT = "spark.sql.autoBroadcastJoinThreshold"
#: Open scopes of this thread, innermost last.
_open: ContextVar[tuple[Cuts, ...]] = ContextVar("cuts", default=())


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Only a local session without one (tests) gets a temporary folder, removed at exit.
    """
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not named:
            if sc.master.partition("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            named = tempfile.mkdtemp(prefix="strataweave-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
        found = sc._jsc.sc().getCheckpointDir()
    return found.get()


def tasks(spark: SparkSession, rows: int, each: int = ROWS) -> int:
    """Into how many tasks to deal ``rows``: as many as the session has it, more where that makes a task hold more than ``each``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


class Cuts:
    """A ``with`` block whose cut tables are removed at its end, but for results that ``keep`` writes outside it.

    Its joins broadcast small tables only. A broadcast passes through the driver, ten times its files and more where
    texts pack well, and a loop or a turn plans a hundred joins, so tables just below the common limit add up.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Cuts:
        self.around = _open.get()
        _open.set((*self.around, self))
        self.limit = self.spark.conf.get(LIMIT)
        size = self.spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
        common = -1 if self.limit.startswith("-") else size(self.limit)
        self.spark.conf.set(LIMIT, min(common, BROADCAST))
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` as a table of the scope around."""
        now = _open.get()
        _open.set(self.around)
        try:
            return cut(df)
        finally:
            _open.set(now)

    def __exit__(self, *_) -> None:
        _open.set(self.around)
        self.spark.conf.set(LIMIT, self.limit)
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for p in self.paths:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read back.

    A table and not a checkpoint: its size is known from its files, while estimates of checkpointed
    plans multiply from join to join until a loop's planner runs out of memory.
    """
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    if scopes := _open.get():
        scopes[-1].paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
