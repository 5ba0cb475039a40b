import json

import pytest
from pyspark.sql import functions as F

from strataweave.operators import agreement, inspect, trajectory
from strataweave.sources import files, logs, transcripts
from strataweave.streaming import incremental as inc


def lines(spark, rows):
    return spark.createDataFrame([(x if isinstance(x, str) else json.dumps(x), i) for i, x in enumerate(rows)], "line string, line_no long")


def run(i, version=1, **detail):
    return {"schema_version": version, "run_id": f"r{i}", "timestamp": f"2025-01-0{i}T00:00:00Z", "detail": {"mode": "x", "outcomes": [], **detail}}


def test_run_log_skips_foreign_and_torn_lines(spark, tmp_path):
    rows = [run(1), "{torn", run(2, 9), {"schema_version": 1, "run_id": "r3"}, run(4, outcomes=[{"flow_id": "f", "action": "hydrate"}])]
    got = logs.current_records(lines(spark, rows), logs.RUN)
    assert [r.run_id for r in got.collect()] == ["r4", "r1"] and logs.latest(got).first().detail.outcomes[0].flow_id == "f"
    assert logs.by_run_id(got, "r1").count() == 1 and logs.by_run_id(got, "zz").count() == 0
    (tmp_path / "log.jsonl").write_text("\n".join(json.dumps(r) for r in (run(1), run(2))) + "\n")
    assert [r.run_id for r in logs.run_log(spark, f"file://{tmp_path}/log.jsonl").collect()] == ["r2", "r1"]
    assert logs.run_log(spark, f"file://{tmp_path}/none").count() == 0


def test_register_last_wins(spark):
    g = lambda i, v: {"schema_version": 1, "run_id": i, "verdict": v, "reason": v}
    reg = logs.register(lines(spark, [g("a", "good"), g("b", "bad"), g("a", "mixed"), g("b", "odd"), "{", {"run_id": "c", "verdict": "good"}]))
    assert {(r.run_id, r.verdict) for r in reg.collect()} == {("a", "mixed"), ("b", "bad")}
    new = reg.filter("run_id = 'a'").withColumn("verdict", F.lit("good"))
    assert {(r.run_id, r.verdict) for r in logs.upsert_grade(reg, new).collect()} == {("a", "good"), ("b", "bad")}


def test_calibration(spark):
    v = lambda rows: spark.createDataFrame(rows, "run_id string, verdict string")
    both = agreement.joined(v([("a", "good"), ("b", "bad"), ("c", "mixed"), ("h", "good")]), v([("a", "good"), ("b", "mixed"), ("c", "mixed"), ("j", "bad")]))
    r = agreement.report(both).first()
    assert (r.joined, r.agreed, round(r.agreement, 3), r.human_only, r.judge_only) == (3, 2, 0.667, 1, 1)
    assert {tuple(x) for x in agreement.confusion(both).collect()} == {("good->good", 1), ("bad->mixed", 1), ("mixed->mixed", 1)}
    assert agreement.report(agreement.joined(v([]), v([]))).first().agreement is None


def test_status_and_pending(spark, tmp_path):
    at = f"file://{tmp_path}/status.json"
    assert logs.sync_status(spark, at)["last_error"] is None
    logs.merge_sync_status(spark, at, last_attempt_at="1")
    assert logs.merge_sync_status(spark, at, last_success_at="2") == {"last_attempt_at": "1", "last_success_at": "2", "last_error": None}
    (tmp_path / "status.json").write_text("{torn")
    assert logs.sync_status(spark, at)["last_attempt_at"] is None
    rows = ['{"files": ["a"], "session": {"session_id": "s", "cwd": "c"}}', '{"files": ["a"], "session": {"cwd": 1}}', '{"files": "a"}', "{", '{"files": ["a", 1]}']
    got = logs.pending(spark.createDataFrame([(r,) for r in rows], "text string")).collect()
    assert [(r.files, r.session and r.session.session_id) for r in got] == [(["a"], "s"), (["a"], None), (None, None), (None, None), (None, None)]


def item(name, i, **inputs):
    return {"type": "tool_use", "name": name, "id": i, "input": inputs}


def says(*items, at=None, kind="assistant", **more):
    return {"type": kind, "message": {"role": kind, "content": list(items)}, **({"timestamp": at} if at else {}), **more}


TRANSCRIPT = [
    says(item("Edit", "1", file_path="pkg/banks.py"), item("Read", "2", file_path="seen.py")),
    "{torn",
    says(item("Write", "3", file_path="pkg/delta.py"), item("MultiEdit", "4", file_path="pkg/banks.py")),
    says({"type": "text", "text": "hi"}),
    says(item("NotebookEdit", "5", notebook_path="notes/flow.ipynb")),
    says(item("Edit", "6", file_path="typed.py"), kind="user"),
]


def test_edited_files_and_steps(spark):
    rows = lines(spark, TRANSCRIPT)
    assert [r.path for r in transcripts.edited_files(rows).collect()] == ["pkg/banks.py", "pkg/delta.py", "notes/flow.ipynb"]
    steps = transcripts.context_steps(lines(spark, [says(item("Bash", "1", command="x" * 300), item("Odd", "2", other="z"))])).orderBy("item_no").collect()
    assert len(steps[0].target) == 201 and steps[1].target == ""


def test_spans_and_availability(spark):
    rows = [says(item("Task", "t1", subagent_type="rec"), at="2025-01-01T00:00:00Z"), says({"type": "tool_result", "tool_use_id": "t1"}, at="2025-01-01T01:00:00Z", kind="user", toolUseResult={"agentId": "ag"}), says(item("Task", "t2", subagent_type="rec"), at="2025-01-02T00:00:00Z"), says(item("Task", "t3", subagent_type="other"))]
    spans = transcripts.agent_spans(lines(spark, rows), "rec")
    assert {(r.tool_use_id, r.agent_id) for r in spans.collect()} == {("t1", "ag"), ("t2", None)}
    timed = spans.withColumns({"launch_at": F.to_timestamp("launch_at"), "result_at": F.to_timestamp("result_at"), "k": F.lit(1)})
    at = [("in", "2025-01-01T00:30:00Z"), ("between", "2025-01-01T05:00:00Z"), ("after", "2025-01-03T00:00:00Z"), ("before", "2024-01-01T00:00:00Z")]
    recs = spark.createDataFrame(at, "record_id string, at string").withColumns({"at": F.to_timestamp("at"), "k": F.lit(1)})
    got = {r.record_id: (r.span.tool_use_id, r.match) for r in trajectory.match_spans(recs, timed, ["k"]).collect()}
    assert got == {"in": ("t1", 2), "between": ("t1", 1), "after": ("t2", 1), "before": ("t2", 0)}
    filled = trajectory.with_agent(spans, spark.createDataFrame([("t2", "meta")], "tool_use_id string, agent_id string"))
    assert {r.agent_id for r in filled.collect()} == {"ag", "meta"}
    cases = [(None, "p", True, "s", True), ("x", None, True, "s", True), ("x", "p", False, "s", True), ("x", "p", True, None, True), ("x", "p", True, "s", None), ("x", "p", True, "s", True)]
    df = spark.createDataFrame(cases, "session_id string, transcript_path string, has_transcript boolean, span string, has_subagent boolean")
    assert [r.tier for r in trajectory.availability(df).collect()] == [*trajectory.TIERS, None]


def test_spine_and_stitch_steps(spark):
    part = lambda kind, *rows: spark.createDataFrame([(p, kind, None, s, "d") for p, s in rows], "pos int, kind string, at string, summary string, detail string")
    got = trajectory.spine("r", [part("context", (1, "b"), (0, "a")), part("outcome", (0, "c"))]).collect()
    assert [(r.ordinal, r.summary) for r in got] == [(0, "a"), (1, "b"), (2, "c")]
    assert trajectory.rendered(trajectory.spine("r", [part("context", (0, "a"))])).first().line.endswith("[context]  -  a")
    df = spark.createDataFrame([('{"umbrellas": [{"label": "L", "seeds": ["a", "b"], "rationale": "why"}, {}]}',), ("{",), ('{"umbrellas": 3}',)], "json string")
    assert [(r.label, r.seed_count, r.rationale) for r in transcripts.stitch_steps(df).collect()] == [("L", 2, "why"), ("?", 0, "")]


def test_cursor(spark):
    rows = lines(spark, TRANSCRIPT)
    fresh = inc.cursor_of("{torn")
    got, after = inc.worked_on_since(rows, "p", fresh)
    assert got.count() == 3 and after == {"transcript_path": "p", "lines_processed": 6} and inc.cursor_of(inc.cursor_text(after)) == after
    assert inc.worked_on_since(rows, "p", {"transcript_path": "p", "lines_processed": 3})[0].first().path == "notes/flow.ipynb"
    assert inc.worked_on_since(rows, "other", after)[0].count() == 3 and inc.worked_on_since(rows, "p", {"transcript_path": "p", "lines_processed": 99})[0].count() == 3
    assert inc.expired_cursors(spark.createDataFrame([("cursor-a.json", 8.0), ("cursor-b.json", 1.0), ("x.json", 9.0)], "name string, age_days double")).first().name == "cursor-a.json"


def test_handoff(spark, tmp_path):
    own = inc.Handoff(spark, f"file://{tmp_path}/h")
    rows = lines(spark, TRANSCRIPT)
    assert own.claim() is None
    after = inc.stop_turn(rows, "p", inc.cursor_of(None), own, session={"session_id": "s", "cwd": "c"})
    assert after["lines_processed"] == 6 and inc.stop_turn(rows, "p", inc.cursor_of(None), own, re_entrant=True)["lines_processed"] == 0
    own.stage(["new.ts", "pkg/banks.py"])
    work, claim = own.claim("1")
    assert work["files"] == ["pkg/banks.py", "pkg/delta.py", "notes/flow.ipynb", "new.ts"] and work["session"]["session_id"] == "s" and own.claim("2") is None
    own.stage(["later.ts"])
    own.restore(claim)
    work, claim = own.claim("3", alive=lambda o: False)
    assert work["files"][-1] == "later.ts"
    work, claim = own.claim("4", alive=lambda o: o != "3")
    own.consume(claim)
    assert own.claim("5") is None


def test_streaming_turns(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in TRANSCRIPT))
    seen = []
    turn = lambda paths: seen.append(sorted(r.path for r in paths.collect()))
    for text in (None, json.dumps(says(item("Read", "1", file_path="x"))), json.dumps(says(item("Edit", "1", file_path="late.py")))):
        if text:
            (tmp_path / f"in/{len(seen)}{hash(text)}.jsonl").write_text(text)
        inc.run_turns(inc.stream_edits(spark, f"file://{tmp_path}/in"), turn, f"file://{tmp_path}/cp").awaitTermination()
    assert seen == [["notes/flow.ipynb", "pkg/banks.py", "pkg/delta.py"], ["late.py"]]


def test_files(spark, tmp_path):
    for name, body in {"src/a.ts": "one\n two ", "node_modules/x.ts": "z", "b.md": "x", "sk/SKILL.md": "y", "sk/deep/r.md": "z"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    all_ = files.tree(spark, f"file://{tmp_path}")
    assert sorted(r.path for r in all_.collect()) == ["b.md", "node_modules/x.ts", "sk/SKILL.md", "sk/deep/r.md", "src/a.ts"]
    assert [r.path for r in files.sources(all_).collect()] == ["src/a.ts"] and files.hashes(all_, "t").filter("path = 'b.md'").first().sha256.startswith("2d711642")
    assert sorted(r.rel for r in files.bundle_files(all_, "sk").collect()) == ["SKILL.md", "deep/r.md"]
    paths = spark.createDataFrame([("src/a.ts",), ("sk/deep/new.md",), ("b.md",)], "path string")
    ok, no = files.relevant(paths, all_)
    assert sorted(r.path for r in ok.collect()) == ["sk/deep/new.md", "src/a.ts"] and [r.path for r in no.collect()] == ["b.md"]
    assert files.changed_paths(paths, paths).count() == 3 and files.omitted(paths, all_).first().path == "sk/deep/new.md"
    nodes = spark.createDataFrame([("a", "x"), ("b", "y")], "symbol_id string, name string")
    pairs = files.to_pairs(nodes)
    assert sorted(tuple(r) for r in files.from_pairs(pairs).collect()) == [("a", "x"), ("b", "y")] and set(files.as_map(pairs).first().nodes) == {"a", "b"}


def test_manifests_and_harvest(spark, tmp_path):
    for d, body in {"b": '{"schema_version": 1, "fixture": "fb"}', "a": "{", "c": '{"schema_version": 7, "fixture": "x"}'}.items():
        (tmp_path / d).mkdir()
        (tmp_path / d / "fixture.json").write_text(body)
    assert [(r.dir, r.ok, r.fixture) for r in logs.manifests(spark, f"file://{tmp_path}").collect()] == [("a", False, None), ("b", True, "fb"), ("c", False, None)]
    runs = logs.current_records(lines(spark, [run(1, outcomes=[{"flow_id": "f"}, {"flow_id": "g"}, {"flow_id": "dead"}])]), logs.RUN)
    fl = spark.createDataFrame([("f", True, ["a", "b"], 1), ("g", True, ["b"], 0), ("dead", False, ["z"], 4)], "flow_id string, live boolean, anchor_set array<string>, bridge_count long")
    assert tuple(logs.harvest(runs, fl, "r1").first()) == (2, ["a", "b"], 1, "stitch")


def test_inspection(spark):
    f = spark.createDataFrame([("f", True, ["a", "b"], ["a"]), ("e", True, [], []), ("old", False, ["a"], ["a"])], "flow_id string, live boolean, anchor_set array<string>, entry_points array<string>")
    d = spark.createDataFrame([("a", "llm", "x"), ("b", "odd", "y")], "symbol_path string, source string, text string")
    b = spark.createDataFrame([("a", "z"), ("q", "b"), ("q", "r")], "src_id string, dst_id string")
    s = inspect.flow_summaries(f, d, b)
    got = {r.flow_id: r for r in s.collect()}
    assert (got["f"].bridge_count, got["f"].llm, got["f"].none, got["f"].total, got["e"].member_count, got["old"].bridge_count) == (2, 1, 1, 2, 0, 1)
    assert [r.flow_id for r in inspect.listed(s).collect()] == ["e", "f", "old"]
    one = inspect.store_summary(s, d, b, spark.createDataFrame([("x",)], "flow_id string")).first()
    assert (one.live_flows, one.retired_flows, one.bridges, one.deferred, one.llm, one.none) == (2, 1, 3, 1, 1, 1)
    members, touching = inspect.flow_detail("f", f, d, b)
    assert members.count() == 2 and touching.count() == 2
    after = s.withColumn("bridge_count", F.when(F.col("flow_id") == "f", 9).otherwise(F.col("bridge_count"))).filter("flow_id <> 'e'")
    assert {tuple(r) for r in inspect.flow_diff(s, after).collect()} == {("f", "changed"), ("e", "removed")}
    assert inspect.flow_diff(s, s.withColumn("anchor_set", F.reverse("anchor_set"))).count() == 0
    assert {r.line[0] for r in inspect.diff_lines(inspect.flow_diff(s, after)).collect()} == {"~", "-"} and "members=2" in "".join(r.line for r in inspect.summary_lines(s).collect())
    assert inspect.set_changes(f, f.withColumn("anchor_set", F.array(F.lit("a"))), "flow_id", "anchor_set").count() == 2


@pytest.mark.parametrize(("named", "llm", "fires"), [(3, 2, True), (2, 2, False), (2, 3, False), (0, 9, False)])
def test_placeholder_ratio(spark, named, llm, fires):
    totals = spark.createDataFrame([(named, 0, llm, None, 0)], "provisional long, placeholder long, llm long, proposed int, bridges int")
    none = spark.createDataFrame([], "flow_id string, live boolean, member_count int")
    assert (inspect.anomalies(none, totals).count() == 1) == fires


def test_proposed_bridges(spark):
    rows = [(None, None), ("{", None), ("3", 0), ('{"umbrellas": 1}', 0), ('{"umbrellas": [{"bridges": [1, 2]}, {"bridges": [3]}, {}, {"bridges": "x"}]}', 3)]
    df = spark.createDataFrame([(a,) for a, _ in rows], "json string")
    assert [r.proposed for r in inspect.proposed_bridges(df).collect()] == [b for _, b in rows]


def test_summaries_count_each_bridge_once_and_make_pairs_distinct_only(spark):
    f = spark.createDataFrame([("f", True, ["a", "b", "b"]), ("g", True, ["b", "c"]), ("h", True, ["z"])], "flow_id string, live boolean, anchor_set array<string>")
    d = spark.createDataFrame([("a", "llm")], "symbol_path string, source string")
    b = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("c", None), (None, "a"), ("x", "y"), ("x", "c"), ("b", "b")], "src_id string, dst_id string")
    s = inspect.flow_summaries(f, d, b)
    assert {r.flow_id: r.bridge_count for r in s.collect()} == {"f": 4, "g": 5, "h": 0}
    plan = s._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [flow_id" in plan and not [x for x in plan.splitlines() if "Aggregate [flow_id" in x and "dst_id" in x]


def test_provenance_crosses_the_network_once_where_tasks_are_given(spark):
    from strataweave.operators import bridges

    names = "src_id string, dst_id string, inference_rationale string, source_file string, source_range string, extractor_id string, extractor_version string, ordinal int"
    rows = [("a", "b", "later", "f", "1", "x", "1", 2), ("a", "b", "first", "f", "2", "y", "1", 1), ("a", "b", None, "g", "1", "x", "1", 3), ("b", "a", "z", "f", "1", "x", "1", 1)]
    edges, prov = bridges.build(spark.createDataFrame(rows, names), "k", ("source_file",), 9)
    assert {(r.key, r.inference_rationale) for r in edges.collect()} == {("k:a->b", "first"), ("k:b->a", "z")}
    assert {(r.edge_key, r.source_file, r.source_range) for r in prov.collect()} == {("k:a->b", "f", "2"), ("k:a->b", "g", "1"), ("k:b->a", "f", "1")}
    counts = prov.groupBy("edge_key").count()
    assert {tuple(r) for r in counts.collect()} == {("k:a->b", 2), ("k:b->a", 1)}
    plan = counts._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and ", 9), REPARTITION_BY_NUM" in plan
