import itertools

import pytest
from pyspark.sql import functions as F

from strataweave.operators import ladder, resolve

ST = "symbol_path string, content_hash string"


def verdict(spark, states, anchor=("p", "h")):
    r = resolve.resolve_anchors(spark.createDataFrame([anchor], ST), spark.createDataFrame(states, ST)).first()
    return r.status, r.reason, r.new_path


@pytest.mark.parametrize(("states", "want"), [
    ([("p", "h"), ("q", "h")], ("hit", None, "p")),
    ([("p", "h2"), ("q", "h")], ("downgrade", "body-changed", "p")),
    ([("r", "h"), ("q", "h")], ("downgrade", "relocated", "q")),
    ([("q", "x")], ("miss", None, None)),
])
def test_cascade(spark, states, want):
    for order in itertools.permutations(states):
        assert verdict(spark, list(order)) == want


def test_delta(spark):
    base = [("same", "1"), ("edited", "2"), ("moved", "3"), ("gone", "4")]
    fresh = [("same", "1"), ("edited", "2x"), ("moved2", "3"), ("new", "5")]
    got = resolve.symbol_delta(spark.createDataFrame(base, ST), spark.createDataFrame(fresh, ST)).collect()
    assert {tuple(r) for r in got} == {("modified", "edited", None), ("relocated", "moved", "moved2"), ("removed", "gone", None), ("added", "new", None)}


def test_code_states_and_enclosing_chains(spark):
    rows = [("a.ts", "run", "method", ["X"], "run(){1}"), ("a.ts", "run", "method", ["Y"], "run(){2}"), ("a.ts", "f", "function", [], "f(){}"), ("b.ts", "g", "function", [], "g(){}")]
    got = {r.symbol_path: r for r in resolve.code_states(spark.createDataFrame(rows, "file_path string, name string, kind string, enclosing array<string>, body_source string")).collect()}
    assert set(got) == {"a.ts#X.run:method", "a.ts#Y.run:method", "a.ts#f:function", "b.ts#g:function"}
    assert got["a.ts#f:function"].content_hash == got["b.ts#g:function"].content_hash


def test_indexes(spark):
    df = spark.createDataFrame([("p", "1", 1), ("p", "2", 0), ("q", "3", 2)], "symbol_path string, content_hash string, pos int")
    kept, dropped = resolve.deduplicated_index(df, "pos")
    assert {(r.symbol_path, r.content_hash) for r in kept.collect()} == {("p", "2"), ("q", "3")} and dropped.count() == 1
    with pytest.raises(Exception, match="duplicate symbol path"):
        resolve.unique_index(df).collect()
    one, differing = resolve.baseline_anchors(df.withColumn("id", F.col("pos").cast("string")))
    assert {tuple(r) for r in one.collect()} == {("p", "2"), ("q", "3")} and [r.symbol_path for r in differing.collect()] == ["p"]


def test_rekeys_wait_for_deletions_and_settle_ties(spark):
    nodes = spark.createDataFrame([("p1", "p1", "h"), ("p2", "p2", "h"), ("agentic.description:p1", "p1", "h"), ("x", "x", "zz"), ("t", "t", "tt")], "id string, symbol_path string, content_hash string")
    v = resolve.verdicts(nodes, spark.createDataFrame([("new", "h"), ("t", "tt")], ST))
    assert {(r.id, r.action, r.new_id) for r in v.collect()} == {("p1", "rekey", "new"), ("p2", "rekey", "new"), ("agentic.description:p1", "rekey", "agentic.description:new"), ("x", "delete", None), ("t", "keep", None)}
    go, stay = resolve.rekeys(v, nodes)
    assert {r.id for r in go.collect()} == {"p1", "agentic.description:p1"} and {r.id for r in stay.collect()} == {"p2"}
    blocked, _ = resolve.rekeys(v, nodes.select("id").union(spark.createDataFrame([("new",)], "id string")))
    assert {r.id for r in blocked.collect()} == {"agentic.description:p1"}


def test_callables_and_scope(spark):
    m = "array<struct<name:string,kind:string,body_source:string>>"
    o = f"array<struct<name:string,members:{m}>>"
    df = spark.createDataFrame([("a.ts", [("f", "function", "x"), ("<anonymous>", "function", "x"), ("g", "function", None)], [("C", [("m", "method", "y")])], [("I", [("n", "method", "z")])])], f"file_path string, functions {m}, classes {o}, interfaces {o}")
    assert {(r.name, tuple(r.enclosing)) for r in resolve.callables(df).collect()} == {("f", ()), ("m", ("C",)), ("n", ("I",))}
    nodes = spark.createDataFrame([("1", "raw", "a", "f"), ("2", "user", None, "f"), ("3", "user", "a", "f"), ("4", "user", "a", "g")], "id string, layer string, anchor string, path string")
    assert [r.id for r in resolve.preserved_in(nodes, spark.createDataFrame([("f",)], "path string")).collect()] == ["3"]


TIERS = ["raw", "agentic", "user"]


@pytest.mark.parametrize(("owner", "tier"), itertools.product([None, *TIERS], TIERS))
def test_ladder_matrix(spark, owner, tier):
    now = spark.createDataFrame([("n", "f", "old", owner)], "target string, field string, value string, owner string")
    r = ladder.ladder_write(now, spark.createDataFrame([("n", "f", "new", tier)], "target string, field string, value string, tier string")).first()
    lands = TIERS.index(owner or "raw") <= TIERS.index(tier)
    assert (r.landed, r.value, r.owner) == ((True, "new", tier) if lands else (False, "old", owner))


NODE = "id string, layer string, attributes string, field_ownership map<string,string>, path string, deleted_at string"


def test_write_fields(spark):
    nodes = spark.createDataFrame([("a", "raw", '{"x":1,"y":"k"}', {"y": "user"}, "p", None), ("b", "raw", "{}", None, "p", "t")], NODE)
    w = [("a", "x", "2", "user"), ("a", "y", '"no"', "agentic"), ("a", "z", '{"d":[1]}', "user"), ("b", "q", "true", "agentic"), ("zz", "q", "1", "user")]
    out, skipped = ladder.write_fields(nodes, spark.createDataFrame(w, "target string, field string, value string, tier string"))
    got = {r.id: r for r in out.collect()}
    assert got["a"].attributes == '{"x":2,"y":"k","z":{"d":[1]}}' and got["a"].layer == "user" and got["a"].field_ownership == {"x": "user", "y": "user", "z": "user"}
    assert got["b"].attributes == '{"q":true}' and got["b"].layer == "raw"
    assert [tuple(r) for r in skipped.collect()] == [("a", "y")]


def test_fold_and_render(spark):
    one = spark.createDataFrame([("a", "raw", '{"x":1,"y":1}', {"x": "raw"}, "p1", None), ("b", "raw", "{}", None, "p", None), ("c", "raw", "{}", None, "p", "t")], NODE)
    two = spark.createDataFrame([("a", "user", '{"y":2}', None, "p2", None), ("b", "user", "{}", None, "p", "t"), ("c", "user", "{}", None, "p", None)], NODE)
    got = {r.id: r for r in ladder.fold([one, two], "id").collect()}
    assert set(got) == {"a", "c"} and got["a"].attributes == '{"x":1,"y":2}' and got["a"].path == "p2" and got["a"].field_ownership == {}
    assert {r.id: r.path for r in ladder.fold([two, one], "id").collect()} == {"a": "p1", "b": "p"}
    assert ladder.fold([one, two], "id", True).count() == 3
    edges = spark.createDataFrame([("k", "a", "c", "{}", None, None), ("l", "a", "b", "{}", None, None)], "key string, src_id string, dst_id string, attributes string, field_ownership map<string,string>, deleted_at string")
    assert [r.key for r in ladder.render([one, two], [edges])[1].collect()] == ["k"]
    with pytest.raises(Exception, match="edge without both ends"):
        ladder.hydrate(one.filter("id <> 'a'"), edges)[1].collect()
    assert ladder.base_layer(one, "raw").count() == 3 and ladder.base_layer(one, "overlay", two).count() == 3


def test_change_log(spark):
    log = [("n", "field", 1), ("n", "upsert", 2), ("n", "field", 3), ("m", "delete", 1)]
    got = ladder.folded_changes(spark.createDataFrame(log, "target string, op string, seq int")).collect()
    assert sorted((r.target, r.op, r.seq) for r in got) == [("m", "delete", 1), ("n", "field", 3), ("n", "upsert", 2)]
    by = ladder.fields_by_tier(spark.createDataFrame([("n", "a", "1", "user"), ("n", "b", "2", "user"), ("n", "c", "3", "raw")], "target string, field string, value string, tier string"))
    assert {(r.tier, len(r.fields)) for r in by.collect()} == {("user", 2), ("raw", 1)}
