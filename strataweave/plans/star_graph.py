"""A graph over the star-schema tables: region -> nation -> customer -> order, nation -> supplier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, col: str):
    return F.concat(F.lit(prefix), F.col(col).cast("string"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst)."""
    t = lambda n: table(spark, sf_dir, n)
    out = t("nation").select(_id("r:", "n_regionkey").alias("src"), _id("n:", "n_nationkey").alias("dst"))
    out = out.union(t("customer").select(_id("n:", "c_nationkey"), _id("c:", "c_custkey")))
    out = out.union(t("supplier").select(_id("n:", "s_nationkey"), _id("s:", "s_suppkey")))
    return out.union(t("orders").select(_id("c:", "o_custkey"), _id("o:", "o_orderkey")))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node)."""
    keys = {"region": ("r:", "r_regionkey"), "nation": ("n:", "n_nationkey"), "customer": ("c:", "c_custkey"), "supplier": ("s:", "s_suppkey"), "orders": ("o:", "o_orderkey")}
    out = None
    for name, (prefix, key) in keys.items():
        own = table(spark, sf_dir, name).select(_id(prefix, key).alias("node"))
        out = own if out is None else out.union(own)
    return out


def walk(starts: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """(key, node) of the closure over a layered graph: one join for each layer, no loop.

    ``steps`` hold one layer's edges (src, dst) each, in order; where the layers are known, the
    closure is a fixed plan that the optimiser sees whole.
    """
    out, frontier = starts, starts
    for s in steps:
        frontier = frontier.join(s, frontier.node == s.src).select("key", F.col("dst").alias("node"))
        out = out.union(frontier)
    return out


def layers(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    t = lambda n: table(spark, sf_dir, n)
    nation = t("nation").select(_id("r:", "n_regionkey").alias("src"), _id("n:", "n_nationkey").alias("dst"))
    below = t("customer").select(_id("n:", "c_nationkey").alias("src"), _id("c:", "c_custkey").alias("dst")).union(t("supplier").select(_id("n:", "s_nationkey"), _id("s:", "s_suppkey")))
    return [nation, below, t("orders").select(_id("c:", "o_custkey").alias("src"), _id("o:", "o_orderkey").alias("dst"))]
