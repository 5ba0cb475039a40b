"""Global row numbers without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.llm.shared import free_name, staged


def ranked(df: DataFrame, order: list[Column], rank: str) -> DataFrame:
    """``df`` with the global 0-based rank of each row in ``order`` as column ``rank``.

    Rows are dealt out by range and sorted; a rank is the number of rows in earlier
    partitions plus the place in its own. The sorted rows are written once, so both parts
    come from the same deal. The offsets table has one row per partition; it is the only
    thing that a window or a broadcast holds.
    """
    pid, place = free_name(df, "__part"), free_name(df, "__place")
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.withColumn(pid, F.spark_partition_id())
    dealt = dealt.withColumn(place, F.monotonically_increasing_id() - F.shiftleft(F.col(pid).cast("long"), 33))
    own = staged(dealt, "ranked")
    sizes = own.groupBy(pid).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(pid, before.alias("before"))
    out = own.join(F.broadcast(offsets), pid)
    return out.select(*(own[c] for c in df.columns), (F.col("before") + F.col(place)).alias(rank))
