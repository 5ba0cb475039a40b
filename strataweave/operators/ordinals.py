"""Row numbers and running values over any number of rows: each partition by itself, and one small table of what it carries on.

Rows are dealt out by ranges of their order, so a key that holds a third of them is spread over many tasks; what
windows or broadcasts hold is one row for each partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.staging import cut

PART, PLACE = "__part", "__place"


def dealt(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """``df`` sorted over all partitions, with the number of its partition and its place there; written once, so both stay."""
    own = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(PART, F.spark_partition_id())
    return cut(own.withColumn(PLACE, F.monotonically_increasing_id() - F.shiftleft(F.col(PART).cast("long"), 33)))


def numbered(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """``df`` with each row's number from 0 in ``order`` as column ``name``: the rows of earlier partitions and its place in its own."""
    own = dealt(df, order)
    sizes = own.groupBy(PART).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select(PART, before.alias("__before")))
    return own.join(offsets, PART).select(*(own[c] for c in df.columns), (F.col("__before") + F.col(PLACE)).alias(name))


def running_max(df: DataFrame, key: list[str], order: list[str], value: str, name: str, before: bool = False) -> DataFrame:
    """``df`` with the greatest ``value`` of its key up to each row in ``order`` as column ``name``, or of the rows ``before`` it; nulls count as nothing.

    A partition's rows are compared among themselves; of the key that a partition ends with, the greatest
    value so far is carried to the partitions that begin with it.
    """
    own = dealt(df, [*key, *order])
    keys = F.struct(*key)
    ends = own.groupBy(PART).agg(F.min(keys).alias("__first"), F.max(keys).alias("__last"))
    last = F.broadcast(ends.select(F.col(PART).alias("__of_part"), "__last"))
    tails = own.join(last, (F.col(PART) == F.col("__of_part")) & (keys == F.col("__last"))).groupBy(PART).agg(F.first("__last").alias("__of_key"), F.max(value).alias("__most"))
    # One row for each partition's last key and one for its first, in order; a first key takes what came before it.
    begun = ends.select(F.col("__first").alias("__of_key"), PART, F.lit(False).alias("__tail"), F.lit(None).cast(own.schema[value].dataType).alias("__most"))
    each = tails.select("__of_key", PART, F.lit(True).alias("__tail"), "__most").unionByName(begun)
    earlier = F.max("__most").over(Window.partitionBy("__of_key").orderBy(PART, "__tail").rowsBetween(Window.unboundedPreceding, -1))
    carried = F.broadcast(each.withColumn("__carry", earlier).filter("NOT __tail").select(F.col(PART).alias("__of_part"), "__of_key", "__carry"))
    local = F.max(value).over(Window.partitionBy(PART, *key).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, -1 if before else 0))
    out = own.withColumn("__local", local).join(carried, (F.col(PART) == F.col("__of_part")) & (keys == F.col("__of_key")), "left")
    return out.select(*(F.col(c) for c in df.columns), F.greatest("__local", "__carry").alias(name))
