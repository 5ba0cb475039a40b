import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strataweave.llm import sharding
from strataweave.llm.ranking import ranked


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 99, 1000, 1025])
def test_permutation_is_one_to_one(spark, n):
    assert sorted(sharding.permuted(x, n) for x in range(n)) == list(range(n))
    got = sharding.with_place(spark.range(n).withColumnRenamed("id", "g"), "g", n, "p").collect()
    assert {r.g: r.p for r in got} == {x: sharding.permuted(x, n) for x in range(n)}


def test_shards_and_slots(docs):
    rows = [(i, None if i % 7 == 0 else f"é{i % 5}" * (i % 11)) for i in range(333)]
    got = sharding.shard(docs(rows)).collect()
    texts = dict(rows)
    counts = Counter(r.shard for r in got)
    assert set(counts) <= set(range(40)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
        assert r.row_number == r.doc_id
        assert sharding.permuted(r.row_number, 333) == r.slot * 40 + r.shard


def test_same_result_for_any_partitioning(docs):
    df = docs([(i, str(i)) for i in range(200)])
    a = {tuple(r) for r in sharding.shard(df.repartition(7)).collect()}
    assert a == {tuple(r) for r in sharding.shard(df.coalesce(1)).collect()}


def test_repeated_rows_nulls_no_rows_and_clashing_names(docs):
    df = docs([(1, "a"), (1, "a"), (None, None), (None, None)]).withColumns({c: F.lit(1) for c in ("place", "shard", "__u", "row_number")})
    got = sharding.shard(df).collect()
    assert len({(r.shard, r.slot) for r in got}) == 4
    assert sharding.shard(docs([])).count() == 0


def test_ranks_have_no_gaps(spark):
    df = spark.range(1000).selectExpr("id % 3 AS k", "id")
    got = sorted((r.k, r.id, r["rank"]) for r in ranked(df, [F.col("k"), F.col("id")], "rank").collect())
    assert [r[2] for r in got] == list(range(1000))
