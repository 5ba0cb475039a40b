import pytest
from pyspark.sql import functions as F

from strataweave.schema import EDGES, NODES, PROVENANCE
from strataweave.sources.store import GraphStore, Lock, NullStore

FILES = "path string"


def nodes(spark, *rows):
    full = [(i, "code.function", path, None, layer, "{}", {}, "x", "y", None) for i, path, layer in rows]
    return spark.createDataFrame(full, NODES)


def edges(spark, *rows):
    return spark.createDataFrame([(k, a, b, "code.calls", 1.0, layer, "{}", {}, "x", "y", None, None) for k, a, b, layer in rows], EDGES)


def prov(spark, *rows):
    return spark.createDataFrame([(k, f, "1:0-2:0", "ex", "1") for k, f in rows], PROVENANCE)


@pytest.fixture
def store(spark, tmp_path):
    own = GraphStore.open(spark, f"file://{tmp_path}/store")

    def fill(s):
        s.upsert_nodes(nodes(spark, ("a", "f", "raw"), ("b", "g", "raw"), ("c", "g", "agentic")))
        s.upsert_edges(edges(spark, ("ab", "a", "b", "raw"), ("bc", "b", "c", "agentic")), prov(spark, ("ab", "f"), ("ab", "g"), ("bc", "g")))

    own.transaction(fill)
    return own


def ids(df, col="id"):
    return sorted(r[col] for r in df.collect())


def test_missing_store(spark, tmp_path):
    own = GraphStore.open(spark, f"file://{tmp_path}/none", read_only=True)
    assert isinstance(own, NullStore) and own.nodes().count() == 0 and own.schema_version() == 0
    assert own.changed_files(spark.createDataFrame([("f", "1")], "path string, sha256 string")).count() == 1


def test_round_trip_and_lookups(spark, store):
    assert ids(store.nodes()) == ["a", "b", "c"] and store.schema_version() == 2 and store.node("b").first().path == "g"
    assert ids(store.edges_for_files(spark.createDataFrame([("f",)], FILES)), "key") == ["ab"] and ids(store.edges_for_files(spark.createDataFrame([("g",)], FILES)), "key") == ["ab", "bc"]
    assert store.edges_for_files(spark.createDataFrame([], FILES)).count() == 0 and store.provenance_for_edge("ab").count() == 2
    store.register_table("mine", True)
    assert ids(store.table_disposition(), "table_name") == ["anchor_resolution", "call_edges", "edge_provenance", "edges", "file_hashes", "mine", "nodes", "reach", "reach_seeds"]


def test_readers_keep_their_version(spark, store):
    reader = GraphStore.open(spark, store.path, read_only=True)
    store.upsert_nodes(nodes(spark, ("d", "h", "user")))
    assert ids(reader.nodes()) == ["a", "b", "c"] and ids(store.nodes()) == ["a", "b", "c", "d"]
    assert ids(GraphStore.open(spark, store.path, read_only=True).snapshot()[0]) == ["a", "b", "c", "d"]
    with pytest.raises(PermissionError):
        reader.upsert_nodes(nodes(spark, ("e", "h", "user")))


def test_failures_and_dry_runs_change_nothing(spark, store):
    before = store.version

    def fails(s):
        s.upsert_nodes(nodes(spark, ("z", "h", "raw")))
        assert ids(s.nodes()) == ["a", "b", "c", "z"]
        raise RuntimeError("stop")

    with pytest.raises(RuntimeError):
        store.transaction(fails)
    store.transaction(lambda s: s.upsert_nodes(nodes(spark, ("z", "h", "raw"))), dry_run=True)
    assert ids(store.nodes()) == ["a", "b", "c"] and store.version == before and not store.files.exists(f"{store.path}/_LOCK")


def test_upserts_replace_rows_and_provenance(spark, store):
    store.upsert_edges(edges(spark, ("ab", "a", "c", "user")), prov(spark, ("ab", "new")))
    assert [r.source_file for r in store.provenance_for_edge("ab").collect()] == ["new"] and store.edges().filter("key = 'ab'").first().dst_id == "c"
    store.soft_delete(spark.createDataFrame([("a",), ("c",)], "id string"), "t1")
    assert ids(store.nodes()) == ["a", "b"] and ids(store.nodes(include_deleted=True)) == ["a", "b", "c"]
    store.upsert_nodes(nodes(spark, ("c", "g", "agentic")))
    assert ids(store.nodes()) == ["a", "b", "c"]


def test_invalidation_spares_upper_tiers(spark, store):
    store.invalidate_edges(spark.createDataFrame([("g",)], FILES))
    assert ids(store.edges(), "key") == ["bc"] and ids(store.table("edge_provenance"), "edge_key") == ["bc"]
    store.invalidate_nodes(spark.createDataFrame([("g",)], FILES))
    assert ids(store.nodes()) == ["a", "c"]


def test_rebuild_layer(spark, store):
    store.soft_delete(spark.createDataFrame([("c",)], "id string"), "t1")
    store.rebuild_layer("agentic", lambda s: s.upsert_nodes(nodes(spark, ("n", "g", "agentic"))))
    assert ids(store.nodes(include_deleted=True)) == ["a", "b", "c", "n"] and ids(store.edges(), "key") == ["ab"] and ids(store.table("edge_provenance"), "edge_key") == ["ab", "ab"]


def test_fields_hashes_validation(spark, store):
    skipped = store.write_fields(spark.createDataFrame([("a", "label", '"L"', "user"), ("zz", "x", "1", "user")], "target string, field string, value string, tier string"))
    row = store.node("a").first()
    assert skipped.count() == 0 and row.attributes == '{"label":"L"}' and row.layer == "user" and row.field_ownership == {"label": "user"}
    h = lambda *r: spark.createDataFrame(list(r), "path string, sha256 string, size long, last_seen_at string")
    store.record_hashes(h(("f", "1", 1, "t"), ("g", "2", 1, "t")))
    assert ids(store.changed_files(h(("f", "1", 1, "t"), ("g", "3", 1, "t"), ("n", "4", 1, "t"))), "path") == ["g", "n"]
    assert store.validated("nodes").count() == 3
    store.upsert_nodes(nodes(spark, ("bad", "p", "nowhere")))
    with pytest.raises(Exception, match="unknown layer"):
        store.validated("nodes").collect()


def test_one_writer_at_a_time(store):
    with Lock(store.files, f"{store.path}/_LOCK"):
        with pytest.raises(TimeoutError), Lock(store.files, f"{store.path}/_LOCK", wait=0.3, poll=0.1):
            pass


def test_order_of_input_rows_does_not_matter(spark, store):
    assert store.nodes().orderBy(F.rand(1)).count() == 3


def test_a_commit_writes_the_tables_it_changed_and_old_versions_stay(spark, tmp_path):
    store = GraphStore.open(spark, f"file://{tmp_path}/s")
    store.upsert_nodes(nodes(spark, ("a", "f", "raw"), ("b", "f", "raw")))
    first, files = store.version, lambda: {str(p.relative_to(tmp_path)) for p in tmp_path.rglob("part-*")}
    before = files()
    store.upsert_nodes(nodes(spark, ("c", "f", "raw")))
    assert {p.split("/")[2] for p in files() - before} == {"nodes"} and before <= files()
    assert ids(store.nodes()) == ["a", "b", "c"] and store.edges().count() == 0
    assert ids(GraphStore(spark, store.path, version=first).nodes()) == ["a", "b"]
    now = store.version
    store.transaction(lambda s: None)
    assert store.version == now
    store.record_hashes(spark.createDataFrame([("f", "h", 1, "t")], "path string, sha256 string, size long, last_seen_at string"))
    store.vacuum(keep=2)
    assert ids(store.nodes()) == ["a", "b", "c"] == ids(GraphStore(spark, store.path, version=now).nodes())
    assert not (tmp_path / "s" / f"v={first}" / "nodes").exists() and store.versions()[-2:] == [now, store.version]


def test_edges_of_the_store_queries_are_made_distinct_by_numbers(spark, monkeypatch):
    """Texts of an edge cross the network once less."""
    from strataweave import queries_store

    seen = []
    monkeypatch.setattr(GraphStore, "upsert_edges", lambda self, *rows: seen.extend(r._jdf.queryExecution().optimizedPlan().toString() for r in rows))
    queries_store._edge_store(spark, "/root/testdata/sf0.001")
    assert len(seen) == 4 and all("Aggregate [l_suppkey" in p and p.count("Aggregate [") == 1 for p in seen)
