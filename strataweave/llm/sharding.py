"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Row g of N goes to place p = permutation(g); its shard is p mod S and its slot p div S, so
shard counts differ by one row at most, slots have no gaps, and both can be computed from
(g, N, seed) alone. The permutation is a Feistel network over pairs in Z_a x Z_b with
a * b just above N; a place beyond N is permuted again until it falls below N (cycle
walking), which fewer than one row in sqrt(N) needs.

Law: ``rows``. Groups of equal texts are not kept together: with counts at most one apart
a group larger than a shard cannot be.

Defined results for odd input: a null text has size 16 and the CRC of nothing, 0; null ids
come first in the row order; repeated rows each get a slot of their own; an empty table
gives an empty result; further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.llm.ranking import ranked

SHARDS, SEED, ROUNDS = 40, 20240601, 4
PRIME = 2147483647


def keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int, int]]:
    """Three round constants below 2^31 for each round."""
    out = []
    for r in range(rounds):
        d = hashlib.sha256(f"{seed}:{r}".encode()).digest()
        out.append(tuple(int.from_bytes(d[8 * i : 8 * i + 8]) % (PRIME - 1) + 1 for i in range(3)))
    return out


def domain(n: int) -> tuple[int, int]:
    """a, b with a * b >= n and a * b - n < a."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def mixed(v: str, k: tuple) -> str:
    """SQL of the round function; every product stays below 2^63."""
    t = f"((({v} + {k[0]}) % {PRIME} * {k[1]} + {k[2]}) % {PRIME})"
    return f"(({t} * {t} + {v}) % {PRIME})"


def permuted(x: int, n: int, seed: int = SEED) -> int:
    """The permutation of one number, for tests and for readers that compute a place themselves."""
    a, b = domain(n)
    while True:
        u, v, mod, other = x // b, x % b, a, b
        for k1, k2, k3 in keys(seed):
            t = ((v + k1) % PRIME * k2 + k3) % PRIME
            u, v, mod, other = v, (u + (t * t + v) % PRIME) % mod, other, mod
        x = u * b + v
        if x < n:
            return x


def with_place(df: DataFrame, rank: str, n: int, place: str, seed: int = SEED) -> DataFrame:
    """Adds ``place``: the permuted ``rank``. Rounds are plain arithmetic columns; the walk is a fold over the few rows that need it."""
    a, b = domain(n)
    cols = df.columns
    out = df.withColumns({"__u": F.expr(f"`{rank}` div {b}"), "__v": F.expr(f"`{rank}` % {b}")})
    mods = [a, b] * (ROUNDS // 2)
    for mod, k in zip(mods, keys(seed), strict=True):
        out = out.withColumns({"__u": F.col("__v"), "__v": F.expr(f"(__u + {mixed('__v', k)}) % {mod}")})
    x = out.withColumn("__x", F.expr(f"__u * {b} + __v"))
    rounds = ", ".join(f"named_struct('m', {m}L, 'k0', {k[0]}L, 'k1', {k[1]}L, 'k2', {k[2]}L)" for m, k in zip(mods, keys(seed), strict=True))
    step = f"named_struct('u', s.v, 'v', (s.u + {mixed('s.v', ('k.k0', 'k.k1', 'k.k2'))}) % k.m)"
    again = f"aggregate(array({rounds}), named_struct('u', x div {b}L, 'v', x % {b}L), (s, k) -> {step}, s -> s.u * {b}L + s.v)"
    # A cycle leaves [0, n) for a * b - n steps at most.
    walk = f"aggregate(sequence(1, {max(1, a * b - n)}), __x, (x, i) -> CASE WHEN x < {n} THEN x ELSE {again} END)"
    return x.select(*cols, F.expr(f"CASE WHEN __x < {n} THEN __x ELSE {walk} END").alias(place))


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number."""
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    keyed = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    own = ranked(keyed, [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "row_number")
    n = own.count()
    return with_place(own, "row_number", n, "place", seed).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("place") % shards).cast("int").alias("shard"),
        F.expr(f"place div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )
