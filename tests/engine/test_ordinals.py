"""Numbers and running values over many partitions, logs read by ranges, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from strataweave.operators import ordinals, trajectory, view
from strataweave.sources.logs import lines


@pytest.fixture
def parts(spark):
    """Many small partitions, kept apart."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 13)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    yield 13
    for k, v in old.items():
        spark.conf.set(k, v)


def test_numbers_have_no_gaps(spark, parts):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("x"), F.lit("same").alias("k"))
    got = ordinals.numbered(df, ["k", "x"], "n").collect()
    assert {r.x: r.n for r in got} == {x: x for x in range(500)}
    assert ordinals.numbered(df.limit(0), ["x"], "n").count() == 0


@pytest.mark.parametrize("keys", [1, 3, 200])
def test_running_maximum_across_partitions(spark, parts, keys):
    r = random.Random(keys)
    rows = [(f"k{r.randrange(keys)}", t, r.choice([None, r.randrange(1000)])) for t in range(600)]
    df = spark.createDataFrame(rows, "k string, t int, v int").repartition(5)
    own = ordinals.dealt(df, ["k", "t"])
    assert own.select(ordinals.PART).distinct().count() > 8  # one key alone is spread over the tasks
    best, want = {}, {}
    for k, t, v in rows:
        best[k] = max((x for x in (best.get(k), v) if x is not None), default=None)
        want[t] = best[k]
    assert {r.t: r.m for r in ordinals.running_max(df, ["k"], ["t"], "v", "m").collect()} == want


def test_spans_of_one_key_over_many_partitions(spark, parts):
    r = random.Random(9)
    spans = [("u", r.randrange(4000), 0, p) for p in range(150)]
    spans = [(u, a, a + r.choice([0, 5, 60, -1]), p) for u, a, _, p in spans]
    records = [("u", r.randrange(4000), i) for i in range(300)]
    to_time = lambda d, *cols: d.withColumns({c: F.timestamp_seconds(c) for c in cols})
    s = to_time(spark.createDataFrame(spans, "user string, launch_at long, result_at long, pos int"), "launch_at", "result_at")
    q = to_time(spark.createDataFrame(records, "user string, at long, record_id int"), "at")
    got = {x.record_id: (x.span.pos, x.match) for x in trajectory.match_spans(q, s, ["user"]).collect()}
    for _, at, i in records:
        inside = [p for _, a, b, p in spans if a <= at <= b]
        before = [(a, p) for _, a, _, p in spans if a <= at]
        assert got[i] == ((max(inside), 2) if inside else (max(before)[1], 1) if before else (149, 0))


def test_spine_and_clusters_have_one_order(spark, parts):
    steps = [spark.range(40).select(F.col("id").alias("pos"), F.lit(k).alias("kind"), F.lit(None).cast("string").alias("at"), F.concat(F.lit(k), F.col("id")).alias("summary"), F.lit("").alias("detail")) for k in ("run", "edit")]
    got = trajectory.spine("r", steps).collect()
    assert [x.summary for x in sorted(got, key=lambda x: x.ordinal)] == [f"{k}{i}" for k in ("run", "edit") for i in range(40)]
    mods = spark.range(100).select(F.format_string("m%d", F.col("id")).alias("module"), (-F.col("id")).alias("pos"))
    assert {x.module: x.cluster for x in view.cluster_numbers(mods).collect()} == {f"m{i}": 99 - i for i in range(100)}


@pytest.mark.parametrize("size", [64, 1000, 1 << 20])
def test_a_log_has_the_same_numbers_for_any_ranges(spark, tmp_path, size):
    r = random.Random(2)
    said = [r.choice(["", "x" * r.randrange(90), "é漢 line", '{"a": 1}']) + r.choice(["", "\r"]) for _ in range(400)]
    path = tmp_path / "log.jsonl"
    path.write_bytes(("\n".join(said) + "\n" + '{"torn').encode())
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        df = lines(spark, f"file://{path}")
        got = sorted((x.line_no, x.line) for x in df.collect())
        if size == 64:
            assert spark.read.text(f"file://{path}").rdd.getNumPartitions() > 40
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    whole = [*said, '{"torn']
    assert got == [(i, x.removesuffix("\r")) for i, x in enumerate(whole) if x.removesuffix("\r")]
    assert lines(spark, f"file://{tmp_path}/none").count() == 0
