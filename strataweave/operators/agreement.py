"""Agreement of two graders, keyed by run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def joined(human: DataFrame, judge: DataFrame) -> DataFrame:
    """(run_id, human, judge, side): full outer join; side is joined, human_only or judge_only."""
    a = human.select("run_id", F.col("verdict").alias("human"), F.lit(True).alias("a"))
    b = judge.select("run_id", F.col("verdict").alias("judge"), F.lit(True).alias("b"))
    side = F.when(F.col("a") & F.col("b"), "joined").when(F.col("a"), "human_only").otherwise("judge_only")
    return a.join(b, "run_id", "full_outer").select("run_id", "human", "judge", side.alias("side"))


def confusion(both: DataFrame) -> DataFrame:
    """(cell, n) of ``human->judge``."""
    return both.filter("side = 'joined'").groupBy(F.concat("human", F.lit("->"), "judge").alias("cell")).agg(F.count(F.lit(1)).alias("n"))


def report(both: DataFrame) -> DataFrame:
    """One row: joined, agreed, agreement (null without a joined run), human_only, judge_only."""
    n, same = F.count_if(F.col("side") == "joined"), F.count_if(F.coalesce((F.col("side") == "joined") & (F.col("human") == F.col("judge")), F.lit(False)))
    return both.agg(n.alias("joined"), same.alias("agreed"), F.try_divide(same, n).alias("agreement"), F.count_if(F.col("side") == "human_only").alias("human_only"), F.count_if(F.col("side") == "judge_only").alias("judge_only"))
