"""Comparing sets that are tables of members (key, node): no set travels as an array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.staging import Cuts, cut, tasks


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, node, side) of members that one side has and the other lacks; side is ``a`` or ``b``.

    One aggregate over the members of both, by key and node, so a set of any size is spread.
    """
    both = a.select("key", "node", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select("key", "node", F.lit(0).alias("a"), F.lit(1).alias("b")))
    held = both.groupBy("key", "node").agg(F.max("a").alias("a"), F.max("b").alias("b")).filter("a <> b")
    return held.select("key", "node", F.when(F.col("a") == 1, "a").otherwise("b").alias("side"))


def hashed(node: Column, salt: str) -> Column:
    return F.xxhash64(node, F.lit(salt))


def fingerprints(members: DataFrame) -> DataFrame:
    """(key, n, one, two): the number of members of each set and two 64-bit sums of their hashes without carry.

    Equal sets have equal fingerprints; they add up from parts, whatever their order.
    """
    own = members.select("key", "node").distinct()
    return own.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(hashed(F.col("node"), "one")).alias("one"), F.bit_xor(hashed(F.col("node"), "two")).alias("two"))


PRINT = ["n", "one", "two"]


def classes(members: DataFrame) -> DataFrame:
    """(key, first): for each set the smallest key of an equal one. Members are compared, not only fingerprints.

    Sets of one fingerprint are compared with its smallest key; those that differ, by a collision, are
    compared among themselves again until none is left.
    """
    with Cuts(members.sparkSession) as cuts:
        own = cut(members.select("key", "node").distinct())
        prints = cut(fingerprints(own))
        out = None
        while True:
            low = prints.groupBy(*PRINT).agg(F.min("key").alias("first"))
            named = cut(prints.join(low, PRINT).select("key", "first", *PRINT))
            others = named.filter("key <> first")
            # Members of the first that a set lacks; sizes are equal, so a set without such a one is equal.
            asked = others.select("key", "first").join(own.select(F.col("key").alias("first"), "node"), "first")
            odd = cut(asked.join(own, ["key", "node"], "left_anti").select("key").distinct())
            good = named.select("key", "first").join(odd, "key", "left_anti")
            out = good if out is None else out.unionByName(good)
            if odd.isEmpty():
                return cuts.keep(out)
            prints = cut(prints.join(odd, "key", "left_semi"))


def containments(sets: DataFrame, within: DataFrame) -> DataFrame:
    """(key, other) for every set of ``sets`` (key, node) and every other set of ``within`` (key, node) that has all its members.

    A set is looked for under its rarest member only, the one that fewest sets of ``within`` have; what is
    found there is verified by counting common members, and by size before that. A member that all sets have makes no
    list unless a set has none but such.
    """
    with Cuts(sets.sparkSession) as cuts:
        own, big = cut(sets.select("key", "node").distinct()), cut(within.select(F.col("key").alias("other"), "node").distinct())
        often = big.groupBy("node").agg(F.count(F.lit(1)).alias("often"))
        # A set with a member that no other has is within none.
        ranked = own.join(often, "node", "left").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "node")).alias("rarest"))
        asked = ranked.filter("rarest.often > 0").select("key", "n", F.col("rarest.node").alias("node"))
        sizes = big.groupBy("other").agg(F.count(F.lit(1)).alias("size"))
        pairs = cut(asked.join(big, "node").filter("key <> other").select("key", "other", "n").join(sizes, "other").filter("n <= size").select("key", "other", "n"))
        # Members of all pairs are counted by key, in as many tasks as keep the counts of one small.
        n = tasks(sets.sparkSession, pairs.agg(F.sum("n")).first()[0] or 0)
        members = pairs.repartition(n, "key").join(own.repartition(n, "key"), "key")
        common = members.join(big, ["other", "node"]).groupBy("key", "other", "n").agg(F.count(F.lit(1)).alias("common"))
        return cuts.keep(common.filter("common = n").select("key", "other"))
