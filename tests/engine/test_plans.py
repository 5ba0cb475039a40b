import json

import pytest
from pyspark.sql import functions as F

from strataweave.functions.bag import string_at
from strataweave.operators import bridges, descriptions, flows, search, view
from strataweave.plans import ingest, reconcile, stitch
from strataweave.sources.files import CallGraphSource
from strataweave.sources.store import GraphStore
from tests.engine.graphs import call_graph, sure



def path(*names):
    return [f"{n}.ts#{n}:function" for n in names]


def source(spark, spec, entries, present=None):
    nodes, calls, entry = call_graph(spark, spec, entries)
    nodes = nodes.withColumn("enclosing", F.array().cast("array<string>"))
    there = [(f"{n}.ts", bytearray(b"x")) for n in (present if present is not None else spec)]
    return CallGraphSource(nodes, calls, entry, spark.createDataFrame(there, "path string, content binary"))


def changes(spark, *paths):
    return spark.createDataFrame([(p,) for p in paths], "path string")


def actions(df):
    return {r.flow_id: r.action for r in df.collect()}


def members(store):
    return {r.id: r.anchor_set for r in flows.stored_flows(store.nodes()).collect()}


def test_reconcile_life_of_a_flow(spark, tmp_path):
    store = GraphStore.open(spark, f"file://{tmp_path}/s")
    src = source(spark, {"main": sure("helper"), "helper": [], "testx": []}, ["main", "testx"])
    assert actions(reconcile.reconcile(store, src, changes(spark, "helper.ts", "testx.ts", "../x", ""), "t1")) == {path("main")[0]: "hydrate-full"}
    assert members(store) == {path("main")[0]: path("helper", "main")}
    # A changed body or member set is synced again.
    grown = source(spark, {"main": sure("helper", "more"), "helper": [], "more": []}, ["main"])
    assert actions(reconcile.reconcile(store, grown, changes(spark, "main.ts"), "t3")) == {path("main")[0]: "resync"}
    assert members(store)[path("main")[0]] == path("helper", "main", "more")
    # A seed that is gone is retired when the edit is known.
    other = lambda present: source(spark, {"helper": []}, ["helper"], present)
    assert actions(reconcile.reconcile(store, other(["helper"]), changes(spark, "main.ts"), "t5"))[path("main")[0]] == "retire"
    assert path("main")[0] not in members(store)


def test_seed_loss_needs_proof(spark):
    fl = spark.createDataFrame([(k, [f"{k}.ts#x:function"]) for k in "abcdef"], "flow_id string, entry_points array<string>")
    known = [("a.ts", "absent", False, 0), ("b.ts", "present", False, 3), ("c.ts", "present", False, 0), ("d.ts", "indeterminate", False, 0), ("e.ts", "absent", True, 0), ("f.ts", "present", False, 1)]
    files = spark.createDataFrame(known, "path string, presence string, omitted boolean, symbols long")
    got = lambda *a: {r.flow_id: r.decision for r in reconcile.seed_loss(fl, files, *a).collect()}
    assert got("scoped") == {"a": "retire", "b": "retire", "c": "defer", "d": "defer", "e": "defer", "f": "retire"}
    assert got("sweep") == {"a": "retire", "b": "defer", "c": "defer", "d": "defer", "e": "defer", "f": "defer"}
    assert set(got("scoped", True).values()) == {"defer"}


def test_sweep(spark):
    fl = spark.createDataFrame([("agentic.flow:skill:s", ["x"], "sk"), ("agentic.flow:skill:old", ["x"], None), ("t", ["t.ts#t:f"], None), ("ok", ["ok.ts#ok:f"], None), ("done", ["z.ts#z:f"], None), ("lost", ["l.ts#l:f"], None)], "flow_id string, entry_points array<string>, skill_root string")
    nodes = spark.createDataFrame([("T", True), ("O", False)], "symbol_id string, is_test boolean")
    seeds = spark.createDataFrame([("t", "T", 0), ("ok", "O", 0)], "flow_id string, symbol_id string, pos int")
    files = spark.createDataFrame([("sk/SKILL.md", "absent", False, 0), ("l.ts", "absent", False, 0)], "path string, presence string, omitted boolean, symbols long")
    handled = spark.createDataFrame([("done",)], "flow_id string")
    got = {r.flow_id: r.decision for r in reconcile.sweep(fl, seeds, nodes, files, handled).collect()}
    assert got == {"agentic.flow:skill:s": "retire", "t": "retire", "lost": "retire"}
    assert {r.flow_id for r in reconcile.sweep(fl, seeds, nodes, files, handled, True).collect()} == {"agentic.flow:skill:s"}
    many = spark.range(30).selectExpr("concat('f', id) AS flow_id", "'retire' AS decision")
    assert reconcile.sweep_is_anomalous(many, many) and not reconcile.sweep_is_anomalous(many.limit(3), many)
    again = reconcile.deferred_again(spark.createDataFrame([("a", "old"), ("b", "old"), ("c", "old")], "flow_id string, reason string"), spark.createDataFrame([("a", "defer", "new"), ("b", "retire", "")], "flow_id string, action string, reason string"))
    assert {tuple(r) for r in again.collect()} == {("a", "new"), ("c", "old")}


def test_subsumption(spark):
    m = spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "9"), ("c", "2"), ("d", "1"), ("e", "1")], "flow_id string, node string")
    got = reconcile.subsumed(m.select("flow_id").distinct(), m, spark.createDataFrame([("1",), ("2",)], "node string"), spark.createDataFrame([("a", "sa"), ("b", "sb"), ("c", "sc"), ("d", "sd")], "flow_id string, symbol_id string"), spark.createDataFrame([("sc",)], "symbol_id string"), spark.createDataFrame([("d",)], "flow_id string"))
    assert [r.flow_id for r in got.collect()] == ["a"]


def test_stitch(spark):
    nodes, calls, entries = call_graph(spark, {"a": [[], *sure("x")], "b": sure("y"), "x": [], "y": [], "c": []}, ["a", "b", "c"])
    text = json.dumps({"umbrellas": [{"label": "U", "seeds": path("a", "b"), "rationale": "r", "bridges": [
        {"src_id": path("a")[0], "dst_id": path("c")[0], "file": "a.ts", "line": 10, "rationale": "w"}, {"src_id": path("a")[0], "dst_id": path("c")[0], "file": "a.ts", "line": 99}]}]})
    found = stitch.umbrellas(spark.createDataFrame([(text,)], "json string"))
    out, good, rest = stitch.stitched(found, nodes, calls)
    assert out.first().anchor_set == path("a", "b", "c", "x", "y") and good.first().witness == "a" and rest.first().line == 99
    single = spark.createDataFrame([("fa", path("a")), ("fz", path("z")), ("f2", path("a", "b"))], "flow_id string, entry_points array<string>")
    assert [r.flow_id for r in stitch.absorbed(single, found).collect()] == ["fa"]
    inv = {r.key: r for r in stitch.inventory(nodes, calls, entries, spark.createDataFrame([("x",)], "symbol_id string")).collect()}
    assert (inv["a"].member_count, inv["a"].described, [s.line for s in inv["a"].sites]) == (2, 1, [10])
    for bad in ({}, {"umbrellas": [{"label": "x", "seeds": ["one"]}]}):
        with pytest.raises(Exception, match="malformed payload|two seeds"):
            stitch.umbrellas(spark.createDataFrame([(json.dumps(bad),)], "json string")).collect()


def test_described_and_scored(spark):
    text = json.dumps({"descriptions": [{"symbol_path": p, "text": t} for p, t in [("f#a:function", "old"), ("f#a:function", " new "), ("f#b:function", " "), ("f#zz:function", "x"), ("f#c:function", "kept")]]})
    index = spark.createDataFrame([("f#a:function", "A"), ("f#b:function", "B"), ("f#c:function", "C")], "path string, symbol_id string")
    symbols = spark.createDataFrame([("A", "f#X.a:function", "h"), ("B", "f#b:function", "h"), ("C", "f#c:function", "h")], "symbol_id string, symbol_path string, content_hash string")
    old = spark.createDataFrame([("f#c:function", "h", "llm", "kept")], "symbol_path string, content_hash string, source string, text string")
    out, unknown = stitch.described(spark.createDataFrame([(text,)], "json string"), index, symbols, old)
    assert [tuple(r) for r in out.collect()] == [("f#X.a:function", "h", "new", "llm")] and [r.path for r in unknown.collect()] == ["f#zz:function"]
    want = spark.createDataFrame([(0, ["a", "b"]), (1, ["a", "b"]), (2, ["c"])], "pos int, members array<string>")
    have = spark.createDataFrame([("f1", ["b", "a"], ["s", "t"]), ("f2", ["x"], ["s", "t"]), ("one", ["c"], ["s"])], "flow_id string, anchor_set array<string>, entry_points array<string>")
    assert sorted(tuple(r) for r in stitch.umbrella_score(want, have).collect()) == [("missing", "a\nb"), ("missing", "c"), ("surplus", "x")]
    floor = stitch.floor_score(have, have.limit(0), old, 3).collect()
    assert {r.check: r.ok for r in floor} == {"flow_count": True, "no_bridges": True, "no_authored_descriptions": False}
    d = spark.createDataFrame([("f#run:function", "llm", "runs"), ("f#b:function", "llm", "parses the table"), ("f#c:function", "placeholder", "c")], "symbol_path string, source string, text string")
    asked = spark.createDataFrame([(f"f#{n}:function",) for n in ("run", "b", "c", "d")], "symbol_path string")
    assert {r.symbol_path[2:-9]: r.failure for r in stitch.description_score(asked, d).collect()} == {"run": "restates its name", "c": "not authored", "d": "not authored"}


def test_bundle_ingest(spark, tmp_path):
    rows = {
        "SKILL.md": "---\nname: demo\n---\n[a](ref/a.md) [a again](ref/a.md#x) [s](scripts/run.ts) [web](https://x.y) [out](../up.md) [gone](no.md)",
        "ref/a.md": "[b](b.md)", "ref/b.md": "[a](./a.md)", "scripts/run.ts": "code", "meta.json": '{"sub_agents": [{"name": "r", "file": "agents/r.md"}, {"name": "q", "file": "agents/q.md"}]}', "agents/r.md": "x",
    }
    files = spark.createDataFrame(list(rows.items()), "rel string, source string")
    store = GraphStore.open(spark, f"file://{tmp_path}/s")
    for _ in range(2):
        ingest.ingest(store, files, "demo", "skills/demo")
        kinds = sorted((r.kind, r.dst_id) for r in store.edges().collect())
        assert kinds == [("code.literal-doc", "demo/ref/a.md#doc"), ("code.literal-doc", "demo/ref/b.md#doc"), ("skill.to_reference", "demo/ref/a.md#doc"), ("skill.to_script", "demo/scripts/run.ts#doc"), ("skill.to_subagent", "demo/agents/r.md#doc")]
        assert store.provenance_for_edge("skill.to_reference:demo/SKILL.md#doc->demo/ref/a.md#doc").count() == 2
        hub = store.nodes().filter("kind = 'skill.hub'").select(string_at(F.col("attributes"), "name").alias("n")).first()
        assert hub.n == "demo" and store.nodes().count() == 5
    own = ingest.of_bundle(files, "demo", "skills/demo")
    assert [tuple(r) for r in ingest.missing_files(own).collect()] == [("demo", "skills/demo", "agents/q.md")]
    flow, members, cand = reconcile.skill_rows(own, "t")
    assert len(flow.first().anchor_set) == 5 == members.count() and [r.dst_id for r in cand.collect()] == ["demo/agents/r.md#doc"]


def bundle(k):
    return {"SKILL.md": f"---\nname: s{k}\n---\n[a](ref/a.md)", "ref/a.md": f"[up](../SKILL.md) {k}", "meta.json": '{"sub_agents": [{"name": "r", "file": "ref/a.md"}]}'}


def test_many_bundles_at_once_equal_single_calls(spark, tmp_path):
    own = [(f"s{k}", f"skills/s{k}", rel, text) for k in range(4) for rel, text in bundle(k).items()]
    files = spark.createDataFrame(own, "skill string, root string, rel string, source string")
    one, each = (GraphStore.open(spark, f"file://{tmp_path}/{n}") for n in ("one", "each"))
    ingest.ingest_all(one, files)
    for k in range(4):
        ingest.ingest(each, files.filter(F.col("skill") == f"s{k}").select("rel", "source"), f"s{k}", f"skills/s{k}")
    for t in ("nodes", "edges", "edge_provenance"):
        a, b = ([str(r) for r in s.table(t).collect()] for s in (one, each))
        assert sorted(a) == sorted(b) and a
    bad = spark.createDataFrame([("a", "x/a", "SKILL.md", " \n"), ("b", "x/b", "SKILL.md", "x"), ("b", "x/b", "meta.json", "{"), ("c", "x/c", "SKILL.md", "x"), ("c", "x/c", "meta.json", '{"sub_agents": [{"name": "n", "file": "./gone.md"}, {"name": "m", "file": "../out.md"}]}'), ("d", "x/d", "ref.md", "x")], files.schema)
    assert {r.skill: (r.problem or "").split(" ")[0] for r in ingest.problems(bad.union(files.filter("skill = 's0'"))).collect()} == {"a": "SKILL.md", "b": "meta.json", "c": "declared", "d": "SKILL.md", "s0": ""}


def test_reconcile_of_bundles(spark, tmp_path):
    store = GraphStore.open(spark, f"file://{tmp_path}/s")

    def turn(files, *changed, now="t"):
        nodes, calls, entry = call_graph(spark, {"main": []}, ["main"])
        src = CallGraphSource(nodes.withColumn("enclosing", F.array().cast("array<string>")), calls, entry, spark.createDataFrame([(p, bytearray(t.encode())) for p, t in {**files, "main.ts": "x"}.items()], "path string, content binary"))
        return actions(reconcile.reconcile(store, src, changes(spark, *changed), now))

    files = {f"sk/s0/{rel}": text for rel, text in bundle(0).items()}
    flow = "agentic.flow:skill:s0"
    assert turn(files, "sk/s0/ref/a.md") == {flow: "hydrate"}
    held = {r.id: r for r in flows.stored_flows(store.nodes()).collect()}[flow]
    assert held.anchor_set == ["s0/SKILL.md#doc", "s0/ref/a.md#doc"] and held.skill_root == "sk/s0"
    kinds = lambda: sorted((r.kind, r.dst_id) for r in store.edges().filter("layer = 'agentic'").collect())
    both = [("agentic.bridge", "s0/ref/a.md#doc"), *(("agentic.flow.member", d) for d in ("s0/SKILL.md#doc", "s0/ref/a.md#doc"))]
    assert kinds() == both
    # A degraded bundle is left as it is; a document that goes takes its member edge along.
    assert turn({**files, "sk/s0/meta.json": "{"}, "sk/s0/meta.json") == {flow: "defer"} and kinds() == both
    shrunk = {"sk/s0/SKILL.md": "plain"}
    assert turn(shrunk, "sk/s0/ref/a.md", now="t2") == {flow: "resync"}
    assert [k for k in kinds() if k[0].endswith("member")] == both[1:2] and members(store)[flow] == ["s0/SKILL.md#doc"]
    assert turn({}, "other.ts", now="t3") == {flow: "retire"}


def test_reconcile_goes_by_the_symbol_delta_and_absorbs_demoted_flows(spark, tmp_path):
    store = GraphStore.open(spark, f"file://{tmp_path}/s")
    one = {"helper": sure("leaf"), "leaf": [], "lone": []}
    all_ = [f"{n}.ts" for n in ("main", "helper", "leaf", "lone")]
    turn = lambda spec, entries, now, edit=(): actions(reconcile.reconcile(store, edited(source(spark, spec, entries), edit), changes(spark, *all_), now))
    edited = lambda src, names: CallGraphSource(src.nodes.withColumn("body_source", F.when(F.col("name").isin(*names), F.concat("name", F.lit(" more"))).otherwise(F.col("body_source"))) if names else src.nodes, src.calls, src.entry_points, src.files)
    assert turn(one, ["helper", "lone"], "t1") == {path(n)[0]: "hydrate-full" for n in ("helper", "lone")}
    # Files are touched, but no body changed.
    assert turn(one, ["helper", "lone"], "t2") == {}
    assert turn(one, ["helper", "lone"], "t3", ["leaf"]) == {path("helper")[0]: "resync"}
    # helper is called by main now and no entry point any more.
    two = {"main": sure("helper"), **one}
    assert turn(two, ["main", "lone"], "t5", ["leaf"]) == {path("main")[0]: "hydrate-full", path("helper")[0]: "retire"}
    assert set(members(store)) == {path("main")[0], path("lone")[0]}
    kept = {(r.key, r.node) for r in store.table("reach").collect()}
    assert kept == {("entry:main", n) for n in ("main", "helper", "leaf")} | {("entry:lone", "lone"), *((f"flow:{path('helper')[0]}", n) for n in ("helper", "leaf")), (f"flow:{path('lone')[0]}", "lone")}


def test_absorbed_by_the_first_in_turn(spark):
    m = [("a", "1"), ("a", "2"), ("b", "1"), ("b", "2"), ("c", "1"), ("d", "9"), ("new", "1"), ("new", "2")]
    members_ = spark.createDataFrame(m, "flow_id string, node string")
    turns = lambda *names: spark.createDataFrame([(n, i) for i, n in enumerate(names)], "flow_id string, turn int")
    ids = spark.createDataFrame([(x,) for x in "abcd"], "flow_id string")
    got = lambda *names: {r.flow_id: r.absorber for r in reconcile.absorbed(ids, turns(*names), members_).collect()}
    assert got("a", "b") == {"b": "a", "c": "a"} and got("b", "a") == {"a": "b", "c": "b"}
    assert got("new") == {"a": "new", "b": "new", "c": "new"} and got("c") == {} and got("c", "b", "new") == {"a": "b", "b": "new", "c": "b"}


def test_description_plan(spark):
    m = [("c", "h", "c", "doc"), ("a", "h", "a", None), ("b", "h", "b", None), ("d", "h", "d", None), ("e", "h2", "e", None)]
    members_ = spark.createDataFrame(m, "symbol_path string, content_hash string, name string, docstring string")
    plan = descriptions.plan(members_, spark.createDataFrame([("d", "h"), ("e", "h")], "symbol_path string, content_hash string"), cap=2)
    assert {r.symbol_path: r.bucket for r in plan.collect()} == {"c": "docstring", "d": "cached", "a": "llm", "b": "llm", "e": "placeholder"}
    texts = descriptions.resolved(plan)
    assert {(r.symbol_path, r.text, r.source) for r in texts.collect()} == {("c", "doc", "docstring"), ("a", "a", "provisional"), ("b", "b", "provisional"), ("e", "e", "placeholder")}
    assert descriptions.counts_by_source(texts).count() == 3
    writes = descriptions.rows_of(texts.filter("symbol_path = 'c'"))
    assert {(r.field, r.value) for r in writes.collect()} == {("description", '"doc"'), ("description_source", '"docstring"'), ("described_at_content_hash", '"h"')}
    assert descriptions.side_nodes(texts).count() == 4
    nodes = spark.createDataFrame([("agentic.description:p", '{"described_at_content_hash": "h", "description_source": "odd", "description": "t"}', None), ("agentic.description:q", '{"described_at_content_hash": 3}', None)], "id string, attributes string, deleted_at string")
    assert [tuple(r) for r in descriptions.existing_of(nodes).collect()] == [("p", "h", None, "t")]


def test_bridges(spark):
    rows = [("a", "b", "first", "f", "1:0-1:1", "e", "1", 0), ("a", "b", "second", "f", "1:0-1:1", "e", "2", 1), ("a", "b", "third", "g", "1:0-1:1", "e", "1", 2)]
    edges, prov = bridges.build(spark.createDataFrame(rows, "src_id string, dst_id string, inference_rationale string, source_file string, source_range string, extractor_id string, extractor_version string, ordinal int"))
    assert edges.first().inference_rationale == "first" and {(r.source_file, r.extractor_version) for r in prov.collect()} == {("f", "1"), ("g", "1")}
    null = F.lit(None).cast("string")
    old = spark.createDataFrame([("k1", "user"), ("k2", "agentic")], "key string, layer string").select("key", "layer", null.alias("adjudication"), null.alias("deleted_at"))
    new = spark.createDataFrame([(f"k{i}",) for i in range(5)], "key string")
    assert {r.key: r.outcome for r in bridges.accepted(new, old, 3).collect()} == {"k0": "write", "k1": "preserved", "k2": "write", "k3": "truncated", "k4": "truncated"}
    d = spark.createDataFrame([("a",), ("b",)], "symbol_path string")
    assert {r.outcome for r in bridges.write_plan(new, d, old, elapsed_ms=31_000)[1].collect()} == {"truncated"}
    decl = spark.createDataFrame([("x", "1:0-1:3"), ("y", "2:0-2:3")], "name string, source_range string")
    assert [r.dst_id for r in bridges.registry_candidates(decl, spark.createDataFrame([("x", "X")], "name string, dst_id string"), "hub", "meta.json").collect()] == ["X"]


def test_views_and_search(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("x", "y")], "src string, dst string")
    got = {r.node: (r.component, r.x, r.y) for r in view.grid(spark.createDataFrame([("z",)], "node string"), e, 10).collect()}
    assert got["a"] == ("a", 0, 0) and got["d"] == ("a", 0, 10) and got["e"] == ("a", 10, 10) and got["y"] == ("x", 10, 0) and got["z"] == ("z", 0, 0)
    boxes = spark.createDataFrame([("p", 0.0, 0.0, 10.0, 10.0), ("p", 50.0, 20.0, 10.0, 10.0)], "parent string, x double, y double, width double, height double")
    box = view.bounding_boxes(boxes)
    assert tuple(box.first()) == ("p", -20.0, -60.0, 100.0, 110.0) and sorted(r.x for r in view.moved_into(boxes, box).collect()) == [20.0, 70.0]
    mods = spark.createDataFrame([("m2", 0), ("m1", 1)], "module string, pos int")
    assert [(r.module, r.cluster) for r in view.cluster_numbers(mods).collect()] == [("m2", 0), ("m1", 1)]
    nodes = spark.createDataFrame([("c", "p", 0), ("p", None, 1)], "id string, parent string, pos int")
    assert [r.id for r in view.parents_first(nodes).collect()] == ["p", "c"]
    errs = spark.range(150).selectExpr("id AS pos", "IF(id < 100, 'low', 'high') AS severity")
    assert {tuple(r) for r in view.error_counts(errs).collect()} == {("low", 50), ("high", 50)}
    rows = spark.createDataFrame([(2, "ring", ""), (1, "ring", ""), (3, "a ring", ""), (4, "zzz", "")], "pos int, n string, d string")
    assert [r.pos for r in search.top_k(rows, "ring", "n", "d", "pos", 2).collect()] == [1, 2] and search.top_k(rows, " ", "n", "d", "pos").count() == 0


def test_export(spark, tmp_path):
    n = spark.createDataFrame([("a",)], "id string")
    view.export_graph(n, n, {"x": 1, "y": 2, "zoom": 0.5}, f"file://{tmp_path}/out")
    assert spark.read.json(f"file://{tmp_path}/out/viewport").first().zoom == 0.5
