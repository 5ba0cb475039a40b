"""Closures over condensed graphs, their maintenance, and set comparisons against plain Python."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strataweave import staging
from strataweave.operators import closure as cl
from strataweave.operators import sets
from strataweave.operators.graph import reachable
from strataweave.queries import QUERIES


def plain(edges, seeds):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    got = set()
    for key, node in seeds:
        stack = [node]
        while stack:
            x = stack.pop()
            if (key, x) not in got:
                got.add((key, x))
                stack += out.get(x, ())
    return got


def frame(spark, rows, cols):
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols.split()))


def pairs(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def graphs():
    r = random.Random(5)
    chain = [(f"c{i}", f"c{i + 1}") for i in range(20)]
    yield "chain with an entry inside", [*chain, ("x", "c7")], [("k", "c3"), ("k", "c9"), ("m", "x"), ("n", "c20"), ("o", "nowhere")]
    ring = [(f"r{i}", f"r{(i + 1) % 9}") for i in range(9)]
    yield "rings", [*ring, *[(f"q{i}", f"q{(i + 1) % 6}") for i in range(6)], ("a", "q2"), ("q4", "r0")], [("k", "r4"), ("m", "a"), ("n", "q3")]
    yield "ring alone, loops", [*ring, ("s", "s"), ("t", "t"), ("t", "u"), ("u", "v")], [("k", "r8"), ("s", "s"), ("t", "t"), ("v", "v")]
    for n in (12, 40):
        yield f"random {n}", [(f"v{r.randrange(n)}", f"v{r.randrange(n)}") for _ in range(int(n * 1.2))], [(f"k{k}", f"v{r.randrange(n)}") for k in range(5)]


@pytest.mark.parametrize("name,edges,seeds", list(graphs()))
def test_closure_equals_plain_search(spark, name, edges, seeds):
    got = cl.closure(frame(spark, [*edges, *edges[:3]], "src dst"), frame(spark, seeds, "key node"))
    assert pairs(got) == plain(edges, seeds)


@pytest.mark.parametrize("name,edges,seeds", list(graphs()))
def test_unwritten_closure_with_stops_equals_plain_search(spark, name, edges, seeds, monkeypatch):
    for k, v in {"MANY": 1, "STRIDE": 3, "BLOCK": 4, "PART": 2, "PAIRS": 8}.items():
        monkeypatch.setattr(cl, k, v)
    got = cl.closure(frame(spark, edges, "src dst"), frame(spark, seeds, "key node"), written=False, named=lambda c: F.concat(F.lit("."), c))
    assert pairs(got) == {(f".{k}", f".{n}") for k, n in plain(edges, seeds)}


def test_ranking_a_long_path_writes_a_few_times_its_nodes(spark, monkeypatch):
    """Each round wrote all nodes, so they were written as often as their logarithm."""
    n, sizes = 4096, []
    monkeypatch.setattr(cl, "MANY", 1, raising=False)
    monkeypatch.setattr(cl, "cut", lambda df: (lambda d: sizes.append(d.count()) or d)(staging.cut(df)))
    ring = spark.range(40).select(F.format_string("r%d", "id").alias("src"), F.format_string("r%d", (F.col("id") + 1) % 40).alias("dst"))
    place = cl.chains(spark.range(n - 1).selectExpr("'n' || id AS src", "'n' || (id + 1) AS dst").union(ring))
    got = {r.node: (r.head, r.pos) for r in place.collect()}
    first = min(f"r{i}" for i in range(40))
    assert got == {f"n{i}": ("n0", i) for i in range(1, n)} | {f"r{i}": (first, i) for i in range(1, 40)}
    assert sum(sizes) < 11 * n


def test_condensed_closure_writes_less_than_its_pairs(spark, tmp_path, monkeypatch):
    """The pairs, which grow with the square of the parts, were written and read again. Part keys have a gap, one id is too large to carry its kind in a number."""
    sizes, write = [], staging.cut
    monkeypatch.setattr(cl, "cut", lambda df: (lambda d: sizes.append(d.count()) or d)(write(df)))
    monkeypatch.setattr(staging, "cut", cl.cut)
    n, far = 4000, 1 << 61
    part = [i for i in range(n) if i != 2500]
    spark.createDataFrame([(i,) for i in part], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    for big in (False, True):
        ids = [7, 9, far if big else 12]
        sf = tmp_path / str(big)
        sf.mkdir()
        (sf / "part.parquet").symlink_to(tmp_path / "part.parquet")
        events = [(i, 5, "error" if i == 9 else "view") for i in ids] + [(20, 6, "view"), (21, 6, "view")]
        spark.createDataFrame(events, "event_id long, user_id long, event_type string").write.parquet(str(sf / "events.parquet"))
        want = {(f"p:{a}", f"p:{b}") for a in part if a % 1000 == 1 for b in part if b >= a}
        want |= {("u:5", "u:5"), ("u:6", "u:6"), *(("u:5", f"e:{i}") for i in ids)}
        assert pairs(QUERIES["condensed_closure"](spark, str(sf))) == want
        assert max(sizes) < len(want) / 2


def test_keys_on_one_path_are_spread_over_tasks(spark, monkeypatch):
    """A path is one node of the condensed graph; its pairs must not come out of one task."""
    monkeypatch.setattr(cl, "BLOCK", 64)
    monkeypatch.setattr(cl, "PART", 16)
    n, keys = 1000, 40
    place = spark.range(1, n).selectExpr("'n' || id AS node", "'h' AS head", "id AS pos")
    inner = spark.range(keys).selectExpr("'k' || id AS key", "'h' AS head", "id * 20 AS from")
    got = cl.along(inner, place)
    assert pairs(got) == {(f"k{k}", f"n{i}") for k in range(keys) for i in range(max(1, k * 20), n)}
    sizes = [r.n for r in got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 1 and max(sizes) < sum(sizes) / 2


@pytest.mark.parametrize("ring", [False, True])
def test_a_long_chain_and_a_large_cycle_take_few_rounds(spark, ring, monkeypatch):
    n, cuts = 10_000, []
    monkeypatch.setattr(cl, "cut", lambda df: cuts.append(1) or staging.cut(df))
    edges = spark.range(n - 1 + ring).select(F.format_string("n%05d", "id").alias("src"), F.format_string("n%05d", (F.col("id") + 1) % n).alias("dst"))
    got = cl.closure(edges, frame(spark, [("a", "n00000"), ("b", "n04000"), ("c", "n09999")], "key node"))
    sizes = {r.key: r["count"] for r in got.groupBy("key").count().collect()}
    assert sizes == ({k: n for k in "abc"} if ring else {"a": n, "b": n - 4000, "c": 1})
    assert len(cuts) < 50


def test_tables_on_the_way_are_removed(spark):
    folder = Path(staging.shared_folder(spark).removeprefix("file:"))
    before = set(folder.glob("cut-*"))
    cl.closure(frame(spark, [("a", "b"), ("b", "c"), ("a", "d")], "src dst"), frame(spark, [("k", "a")], "key node"))
    reachable(frame(spark, [("a", "b"), ("b", "c")], "src dst"), frame(spark, [("k", "a")], "key node")).count()
    assert len(set(folder.glob("cut-*")) - before) <= 2


@pytest.mark.parametrize("seed", [0, 2])
def test_maintained_equals_fresh(spark, seed):
    r = random.Random(seed)
    n = 12 + 8 * seed
    edge = lambda: (f"v{r.randrange(n)}", f"v{r.randrange(n)}")
    old = {edge() for _ in range(int(n * 1.4))}
    new = {e for e in old if r.random() < 0.8} | {edge() for _ in range(4)}
    seeds = {(f"k{k}", f"v{r.randrange(n)}") for k in range(6)}
    later = {s for s in seeds if r.random() < 0.7} | {("k9", "v1")}
    before, after = plain(old, seeds), plain(new, later)
    f = lambda rows, cols: frame(spark, sorted(rows), cols)
    got = cl.maintained(f(before, "key node"), (f(old, "src dst"), f(new, "src dst")), (f(seeds, "key node"), f(later, "key node")))
    assert pairs(got.closure()) == after
    assert pairs(got.gone) == before - after and pairs(got.new) == after - before


def test_maintenance_of_an_unchanged_graph_changes_nothing(spark):
    e, s = frame(spark, [("a", "b"), ("b", "a")], "src dst"), frame(spark, [("k", "a")], "key node")
    got = cl.maintained(frame(spark, [("k", "a"), ("k", "b")], "key node"), (e, e), (s, s))
    assert got.keys().isEmpty() and pairs(got.closure()) == {("k", "a"), ("k", "b")}
    none = cl.maintained(s.limit(0), (e.limit(0), e), (s.limit(0), s))
    assert pairs(none.closure()) == {("k", "a"), ("k", "b")}


def members(spark, own):
    return frame(spark, [(k, m) for k, ms in own.items() for m in ms], "key node")


def some_sets(n, seed):
    r = random.Random(seed)
    return {f"s{k:03}": {"all", *(f"m{r.randrange(9)}" for _ in range(r.randint(0, 5)))} for k in range(n)}


def test_differing(spark):
    a, b = {"x": "ab", "y": "c", "z": "d"}, {"x": "bc", "y": "c", "w": "e"}
    assert pairs(sets.differing(members(spark, a), members(spark, b))) == {("x", "a", "a"), ("x", "c", "b"), ("z", "d", "a"), ("w", "e", "b")}


@pytest.mark.parametrize("collide", [False, True])
def test_classes_of_equal_sets(spark, collide, monkeypatch):
    if collide:  # every set of one size has one fingerprint
        monkeypatch.setattr(sets, "hashed", lambda node, salt: F.lit(7).cast("long"))
    own = some_sets(40, 1)
    got = {r.key: r.first for r in sets.classes(members(spark, own)).collect()}
    assert got == {k: min(j for j in own if own[j] == own[k]) for k in own}


def test_containments_equal_all_pairs(spark):
    one, two = some_sets(40, 2), {k.replace("s", "t"): v for k, v in some_sets(40, 3).items()}
    one["lone"], two["t000"] = {"nobody else"}, one["s000"]
    got = pairs(sets.containments(members(spark, one), members(spark, {**one, **two})))
    assert got == {(a, b) for a in one for b in {**one, **two} if a != b and one[a] <= {**one, **two}[b]}


def test_containments_deal_the_members_of_pairs_among_enough_tasks(spark, monkeypatch):
    asked, plans, write = [], [], staging.cut
    monkeypatch.setattr(sets, "tasks", lambda s, rows: asked.append(rows) or 9)
    monkeypatch.setattr(staging, "cut", lambda d: plans.append(d._jdf.queryExecution().sparkPlan().toString()) or write(d))
    one, two = some_sets(20, 4), {k.replace("s", "t"): v for k, v in some_sets(20, 5).items()}
    got = pairs(sets.containments(members(spark, one), members(spark, two)))
    assert got == {(a, b) for a in one for b in two if one[a] <= two[b]}
    assert asked[0] >= sum(len(one[a]) for a, _ in got) and plans[-1].count("9, REPARTITION_BY_NUM") + plans[-1].count(", 9)") >= 2


def test_tasks_grow_with_the_rows(spark):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [staging.tasks(spark, n, 10) for n in (0, 10 * least, 10 * least + 1, 1000)] == [least, least, least + 1, 100]


@pytest.mark.parametrize("common, own", [("10MB", staging.BROADCAST), ("1k", 1024), ("-1", -1)])
def test_a_scope_broadcasts_small_tables_only(spark, common, own):
    now = lambda: spark.conf.get(staging.LIMIT)
    was = now()
    spark.conf.set(staging.LIMIT, common)
    try:
        with pytest.raises(KeyError), staging.Cuts(spark):
            with staging.Cuts(spark):
                assert int(now()) == own
            assert int(now()) == own
            raise KeyError
        assert now() == common
    finally:
        spark.conf.set(staging.LIMIT, was)


def test_maintenance_compares_edges_by_one_aggregate_and_writes_kept_pairs_once(spark, monkeypatch):
    plans, write = [], staging.cut
    note = lambda d: plans.append(d._jdf.queryExecution().optimizedPlan().toString()) or write(d)
    monkeypatch.setattr(staging, "cut", note)
    monkeypatch.setattr(cl, "cut", note)
    old, new = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "b"), (None, "x"), ("x", "y")], [("a", "b"), ("b", "d"), ("c", "d"), ("x", "y"), ("y", "z"), ("x", None)]
    frames = [spark.createDataFrame(e, "src string, dst string") for e in (old, new)]
    seeds = [("a", "a"), ("x", "x")]
    start = spark.createDataFrame(seeds, "key string, node string")
    change = cl.maintained(spark.createDataFrame(sorted(plain([e for e in old if None not in e], seeds)), start.schema), tuple(frames), (start, start))
    assert pairs(change.closure()) == plain([e for e in new if None not in e], seeds)
    assert pairs(change.gone) == {("a", "c")} and pairs(change.new) == {("x", "z")}
    assert sum("Aggregate [src" in p and "Union" in p for p in plans) == 1 and not [p for p in plans if "LeftAnti" in p and "src" in p.split("LeftAnti")[1].split("\n")[0]]
    assert "LeftAnti" not in change.kept._jdf.queryExecution().optimizedPlan().toString()
