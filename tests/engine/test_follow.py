"""Streams with state against their batch forms."""

import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from strataweave.sources.store import GraphStore
from strataweave.streaming import follow
from strataweave.streaming.incremental import debounced
from tests.engine.test_store import edges, nodes, prov

START = datetime(2024, 3, 1)
#: These two take minutes each, most of it in starting state stores and their workers.
slow = pytest.mark.skipif(not os.environ.get("STRATAWEAVE_SLOW"), reason="set STRATAWEAVE_SLOW to run")


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, old)


def write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_changes_of_a_store_as_a_stream(spark, tmp_path):
    path, got = f"file://{tmp_path}/s", []
    store = GraphStore.open(spark, path)
    take = lambda d, v: got.append((v, {tuple(r) for r in d.collect()}))
    turn = lambda: follow.follow_store(spark, path, take, f"file://{tmp_path}/check").awaitTermination(120)
    store.upsert_nodes(nodes(spark, ("a", "f", "raw"), ("b", "f", "raw")))
    turn()
    assert got.pop() == (store.version, {("nodes", "a", "added"), ("nodes", "b", "added")})
    # Between two polls a node comes and goes, one changes, and an edge comes.
    store.upsert_nodes(nodes(spark, ("c", "f2", "raw"), ("a", "g", "agentic")))
    store.invalidate_nodes(spark.createDataFrame([("f2",)], "path string"))
    store.upsert_edges(edges(spark, ("ab", "a", "b", "raw")), prov(spark, ("ab", "f")))
    turn()
    assert got.pop() == (store.version, {("nodes", "a", "changed"), ("edges", "ab", "added"), ("edge_provenance", "\x1f".join(("ab", "f", "1:0-2:0", "ex")), "added")})
    turn()
    assert got == []
    assert store.diff(store.version).isEmpty() and {r.change for r in store.diff(0).collect()} == {"added"}


def reads(seed):
    r = random.Random(seed)
    at, rows = START, []
    for _ in range(60):
        at += timedelta(hours=r.choice([1, 5, 24 * 8]) if r.random() < 0.3 else 1)
        rows.append((r.choice("pqr"), at, r.randrange(50)))
    return rows


def plain(rows):
    last, out = {}, []
    for path, at, lines in sorted(rows, key=lambda x: (x[1], x[2])):
        old = last.get(path)
        start = 0 if old is None or lines < old[1] or at - old[0] > timedelta(days=7) else old[1]
        out.append((path, at, start, lines))
        last[path] = at, lines
    return sorted(out)


@slow
@pytest.mark.parametrize("cutoff", [25])
def test_cursors_as_keyed_state_equal_the_batch(spark, tmp_path, rocks, cutoff):
    rows = reads(cutoff)
    df = spark.createDataFrame(rows, "path string, at timestamp, lines long").repartition(3)
    want = plain(rows)
    assert sorted(tuple(r) for r in follow.read_ranges(df).collect()) == want
    text = lambda part: [{"path": p, "at": a.isoformat(), "lines": n} for p, a, n in part]
    for k, part in enumerate([rows[:cutoff], rows[cutoff:]]):  # the second run goes on from the first one's state
        write(tmp_path / "in", f"{k}.json", text(part))
        stream = spark.readStream.schema("path string, at timestamp, lines long").json(f"file://{tmp_path}/in")
        out = follow.stream_read_ranges(stream).writeStream.format("parquet").option("path", f"file://{tmp_path}/out")
        follow.started(out, f"file://{tmp_path}/check", None).awaitTermination(120)
    assert sorted(tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == want


@slow
def test_bursts_of_a_stream_equal_the_batch_whatever_the_order(spark, tmp_path):
    r, rows, seen = random.Random(3), [], []
    for path in "pq":
        at = START
        for _ in range(40):
            at += timedelta(seconds=r.choice([1, 1, 2, 40]))
            rows.append((path, at))
    rows.sort(key=lambda x: (x[1], x[0]))
    mixed = [x for k in range(0, len(rows), 6) for x in r.sample(rows[k : k + 6], len(rows[k : k + 6]))]  # out of order by a few seconds
    # At last what moves the watermark, and then an event that is much too late.
    parts = [mixed[:40], mixed[40:], [("z", START + timedelta(days=1))], [("p", START + timedelta(seconds=1))]]
    for k, part in enumerate(parts):
        write(tmp_path / "in", f"{k}.json", [{"path": p, "ts": a.isoformat()} for p, a in part])
        os.utime(tmp_path / "in" / f"{k}.json", (1000 + k, 1000 + k))
    stream = lambda: follow.stream_bursts(spark.readStream.schema("path string, ts timestamp").option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in"), "10 seconds", "400 seconds")
    follow.started(stream().writeStream.format("parquet").option("path", f"file://{tmp_path}/out"), f"file://{tmp_path}/check", None).awaitTermination(120)
    follow.on_bursts(stream(), lambda d: seen.extend(x.path for x in d.collect()), f"file://{tmp_path}/turns").awaitTermination(120)
    batch = debounced(spark.createDataFrame(rows, "path string, ts timestamp"), "10 seconds")
    key = lambda d: sorted(tuple(x) for x in d.select("path", "first", "until", "events").collect())
    assert key(spark.read.parquet(f"file://{tmp_path}/out")) == key(batch)
    assert set(seen) == {"p", "q"} and batch.agg(F.sum("events")).first()[0] == len(rows)
