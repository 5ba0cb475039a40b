import itertools

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataweave.operators import flows, graph
from tests.engine.graphs import call_graph, sure

N = "id string, deleted_at string"
E_ = "key string, src_id string, dst_id string, deleted_at string"


def pairs(spark, rows, schema="src string, dst string"):
    return spark.createDataFrame(rows, schema)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8)), max_size=14), st.sets(st.integers(0, 9), min_size=1, max_size=3))
def test_reachability_equals_the_closure(spark, edges, seeds):
    want = set()
    for s in seeds:
        seen, todo = {s}, [s]
        while todo:
            x = todo.pop()
            for a, b in edges:
                if a == x and b not in seen:
                    seen.add(b)
                    todo.append(b)
        want |= {(str(s), str(n)) for n in seen}
    got = graph.reachable(pairs(spark, [(str(a), str(b)) for a, b in edges]), pairs(spark, [(str(s), str(s)) for s in seeds], "key string, node string"))
    assert {(r.key, r.node) for r in got.collect()} == want


@pytest.fixture
def ring(spark):
    nodes = lambda dead=(): spark.createDataFrame([(x, "t" if x in dead else None) for x in "abcd"], N)
    edges = spark.createDataFrame([("ab", "a", "b", None), ("bc", "b", "c", None), ("ba", "b", "a", None), ("ad", "a", "d", "t")], E_)
    return nodes, edges


@pytest.mark.parametrize(("depth", "ids", "keys"), [(0, "a", []), (1, "ab", ["ab", "ba"]), (2, "abc", ["ab", "ba", "bc"])])
def test_neighborhood(ring, depth, ids, keys):
    nodes, edges = ring
    near, among = graph.neighborhood(nodes(), edges, "a", depth)
    assert sorted(r.id for r in near.collect()) == list(ids) and sorted(r.key for r in among.collect()) == keys


def test_neighborhood_goes_through_deleted_nodes(ring):
    nodes, edges = ring
    near, among = graph.neighborhood(nodes(("b",)), edges, "a", 2)
    assert sorted(r.id for r in near.collect()) == ["a", "c"] and among.count() == 3


def test_components_contract_hops(spark):
    got = {r.node: r.root for r in graph.components(pairs(spark, [("b", "a"), ("c", "b"), ("x", "y")]), spark.createDataFrame([("z",)], "node string")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "z"}
    groups = pairs(spark, [("a", "A"), ("b", "A"), ("c", "C")], "leaf string, group string")
    assert [tuple(r) for r in graph.contract(pairs(spark, [("a", "b"), ("a", "c"), ("b", "c"), ("a", "?")]), groups).collect()] == [("A", "C", 1.0)]
    near, among = graph.one_hop(spark.createDataFrame([("b",)], "node string"), pairs(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("c", "a")]))
    assert sorted(r.node for r in near.collect()) == ["a", "b", "c"] and among.count() == 3


def test_dangling_ancestors_containers(spark):
    edges = spark.createDataFrame([("k", "a", "b"), ("l", "a", "?")], "key string, src_id string, dst_id string")
    assert [r.key for r in graph.without_dangling(edges, spark.createDataFrame([("a",), ("b",)], "id string")).collect()] == ["k"]
    got = graph.nearest_marked_dir(spark.createDataFrame([("s/x/y/f.md",), ("t/f",), ("f",)], "path string"), spark.createDataFrame([("s",), ("s/x",), ("q",)], "dir string"))
    assert [tuple(r) for r in got.collect()] == [("s/x/y/f.md", "s/x")]
    rooted = graph.nearest_marked_dir(spark.createDataFrame([("t/f",)], "path string"), spark.createDataFrame([("",)], "dir string"))
    assert rooted.first().dir == ""
    boxes = graph.edge_containers(pairs(spark, [("a", "b"), ("a", "c")]), pairs(spark, [("a", "M"), ("b", "M"), ("c", "K")], "node string, module string"))
    assert {(r.dst, r.container) for r in boxes.collect()} == {("b", "M"), ("c", "")}


def test_shared_and_dead_code(spark):
    nodes, calls, entries = call_graph(spark, {"main": sure("helper", "shared"), "helper": [], "shared": [], "cli": sure("shared", "external"), "dead": []}, ["main", "cli"])
    edges = graph.call_edges(calls, nodes).select("src", "dst")
    got = flows.ranked(flows.skeleton_flows(nodes.withColumn("flow_id", F.col("symbol_id")), edges, entries)).collect()
    assert [(r.flow_id, r.member_count) for r in got] == [("main", 3), ("cli", 2), ("agentic.flow:unattributed", 1)]
    assert [r.symbol_id for r in flows.unattributed(nodes, edges, entries).collect()] == ["dead"]


def test_flows_of_one_id_collapse_to_the_larger(spark):
    nodes, calls, entries = call_graph(spark, {"a": sure("c"), "b": [], "c": []}, ["a", "b"])
    named = nodes.withColumn("flow_id", F.when(F.col("symbol_id") == "c", "c").otherwise("same"))
    got = flows.skeleton_flows(named, graph.call_edges(calls, nodes).select("src", "dst"), entries).collect()
    assert [(r.flow_id, r.entry_point, r.member_count) for r in got] == [("same", "a", 2)]


def test_first_resolution_gives_the_certainty(spark):
    nodes, calls, _ = call_graph(spark, {"a": [[("b", "possible"), ("c", "certain")], [("b", "certain")], "cb", []], "b": [], "c": []}, [])
    assert {(r.dst, r.certainty) for r in graph.call_edges(calls, nodes).collect()} == {("b", "possible"), ("c", "certain")}
    assert [r.call_ix for r in graph.unresolved_calls(calls, nodes).collect()] == [3]


def test_projection_and_budget(spark):
    nodes, calls, entries = call_graph(spark, {"main": sure("helper", "send"), "helper": sure("send", "send"), "send": [], "other": []}, ["main"])
    members = spark.createDataFrame([("main",), ("helper",), ("send",)], "node string")
    rows, edges = flows.projected(members, nodes, calls, entries)
    assert sorted((r.id, r.is_entry_point) for r in rows.collect()) == [("helper", False), ("main", True), ("send", False)]
    assert sorted((r.src, r.dst) for r in edges.collect()) == [("helper", "send"), ("main", "helper"), ("main", "send")]
    rows, edges = flows.projected(members, nodes, calls, entries, node_budget=2)
    assert {r.kind for r in rows.collect()} == {"code.module"} and edges.count() == 3
    docs = spark.createDataFrame([("send",), ("zzz",)], "node string")
    assert flows.projected(members, nodes, calls, entries, docs)[0].filter("kind = 'doc'").count() == 1


def test_order_of_flows_does_not_depend_on_input_order(spark):
    hyd = [("h1", None, ["x"]), ("h2", "2025-02", []), ("h3", "2025-01", ["s2"])]
    sk = [("s1", 3, False), ("s2", 9, False), ("h2", 9, False), ("rest", 99, True), ("s3", 5, False)]
    seen = set()
    for h, k in zip(itertools.permutations(hyd), itertools.permutations(sk), strict=False):
        out = flows.ordered(spark.createDataFrame(list(h), "id string, last_synced_at string, entry_points array<string>"), spark.createDataFrame(list(k), "flow_id string, member_count long, is_unattributed boolean"))
        seen.add(tuple(r.flow_id for r in out.collect()))
    assert seen == {("h2", "h3", "h1", "s3", "s1", "rest")}


def test_scaffold_rows_and_stored_flows(spark):
    leaves = spark.createDataFrame([("b", "src/b.ts"), ("a", "src/b.ts"), ("x", "/abs/x.ts")], "leaf string, path string")
    modules, edges = flows.module_scaffold(graph.grouped_by(leaves, flows.file_group(F.col("path"), "src")))
    assert sorted((r.id, r.path, r.label, r.members) for r in modules.collect()) == [("agentic.group:file:<external>", "", "<external>", ["x"]), ("agentic.group:file:src/b.ts", "src/b.ts", "b.ts", ["a", "b"])]
    assert "code.contains:agentic.group:file:src/b.ts->a" in [r.key for r in edges.collect()]
    rows = flows.flow_rows(spark.createDataFrame([("f1", "L", ["s"], ["m2", "m1"], None, None)], "id string, label string, entry_points array<string>, anchor_set array<string>, rationale string, last_synced_at string"))
    back = flows.stored_flows(rows).first()
    assert (back.label, back.member_count, back.anchor_set, back.last_synced_at) == ("L", 2, ["m1", "m2"], None) and "last_synced_at" not in rows.first().attributes
    assert flows.member_edge_rows(spark.createDataFrame([("f", "m")], "flow_id string, member_id string")).first().key == "agentic.flow.member:f->m"


def test_members_bridges_and_reconstruction(spark):
    seeds = spark.createDataFrame([("f", "a")], "key string, node string")
    got = flows.induced_members(seeds, pairs(spark, [("a", "b"), ("x", "y")]), spark.createDataFrame([("f", "b", "x")], "key string, src string, dst string"), spark.createDataFrame([("f", "doc")], "key string, node string"))
    assert {r.node for r in got.collect()} == {"a", "b", "x", "y", "doc"} and flows.flows_of_leaf(got, "y").first().key == "f"
    edges = spark.createDataFrame([("k1", "m", "z", "agentic.bridge", None), ("k2", "z", "m", "agentic.bridge", None), ("k3", "m", "n", "agentic.bridge", "t"), ("k4", "f", "m2", "agentic.flow.member", None)], "key string, src_id string, dst_id string, kind string, deleted_at string")
    own, touching = flows.assembled(spark.createDataFrame([("f", ["m"]), ("g", ["z"])], "id string, anchor_set array<string>"), edges)
    assert [tuple(r) for r in own.collect()] == [("f", "m2")] and sorted((r.flow_id, r.key) for r in touching.collect()) == [("f", "k1"), ("f", "k2"), ("g", "k1"), ("g", "k2")]
    nodes, _, _ = call_graph(spark, {"a": []}, [])
    back = flows.reconstructed(spark.createDataFrame([("f", "a.ts#a:function"), ("f", "s/x.md#doc")], "key string, path string"), flows.path_index(nodes))
    assert {(r.path, r.is_doc) for r in back.collect()} == {("a.ts#a:function", False), ("s/x.md#doc", True)}
    twin = flows.with_twins(spark.createDataFrame([("f", "here", 1)], "id string, seed_location string, member_count long"), spark.createDataFrame([("f", None, 7)], "flow_id string, seed_location string, member_count long"))
    assert tuple(twin.first()) == ("f", "here", 7)


def test_components_of_long_paths_take_few_rounds(spark, monkeypatch):
    """Names rise along the first path and fall below its own along the second, so a smallest label would go on by a step a round."""
    names = [f"b{i:03d}" for i in range(300)] + [f"a{i:03d}" for i in range(300)]
    cuts = []
    monkeypatch.setattr(graph, "cut", lambda d, real=graph.cut: cuts.append(d) or real(d))
    got = {r.node: r.root for r in graph.components(pairs(spark, [*zip(names, names[1:], strict=False), ("x", "x"), ("y", None)])).collect()}
    assert got == {**dict.fromkeys(names, "a000"), "x": "x", "y": "y"} and len(cuts) < 60


def test_edges_are_dealt_among_the_tasks_that_are_asked_for(spark):
    modules = pairs(spark, [("a", "M"), ("b", "M"), ("c", "K")], "node string, module string")
    boxes = graph.edge_containers(pairs(spark, [("a", "b"), ("a", "c"), ("?", "b")]), modules, 9)
    assert {(r.src, r.dst, r.container) for r in boxes.collect()} == {("a", "b", "M"), ("a", "c", ""), ("?", "b", "")}
    plan = boxes._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [src") == 1 and plan.count("RepartitionByExpression [dst") == 1 and plan.count(", 9") >= 2
