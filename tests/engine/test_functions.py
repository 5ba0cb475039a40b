import hashlib

import pytest
from pyspark.sql import functions as F

from strataweave.functions import bag, extract, identity, predicates, text


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(k) for k, c in cols.items())).first()


def lit(*values):
    return [F.lit(v) for v in values]


def test_symbol_paths_and_anchors(spark):
    r = one(
        spark,
        path=identity.symbol_path(F.lit("src/a.ts"), F.array(*lit("A", "B")), F.lit("run"), F.lit("method")),
        bare=identity.symbol_path(F.lit("a"), F.lit(None).cast("array<string>"), F.lit("f"), F.lit("function")),
        name=identity.member_name(F.lit("csv.ts#Csv.export_rows:method")),
        file=identity.file_of(F.lit("src/a.ts#f:function")),
        anchor=identity.parse_anchor(F.lit("a#f:x:" + "0" * 64)),
        key=identity.edge_key(*lit("code.calls", "a", "b")),
        run=identity.run_id(*lit("2025-01-02T03:04:05.678Z", "0a1b2c3d")),
    )
    assert r.path == "src/a.ts#A.B.run:method" and r.bare == "a#f:function" and r.name == "export_rows" and r.file == "src/a.ts"
    assert tuple(r.anchor) == ("a#f:x", "0" * 64) and r.key == "code.calls:a->b" and r.run == "20250102T030405678Z-0a1b2c3d"


@pytest.mark.parametrize("bad", ["a#f", "a#f:xyz", ":" + "0" * 64])
def test_malformed_anchor_raises(spark, bad):
    with pytest.raises(Exception, match="malformed anchor"):
        spark.range(1).select(identity.parse_anchor(F.lit(bad))).collect()
    with pytest.raises(Exception, match="no # in"):
        spark.range(1).select(identity.file_of(F.lit("nohash"))).collect()


def test_paths(spark):
    cases = {"a/./b//c": "a/b/c", "a/../b": "b", "../x": "../x", "a/b/../../..": "..", "": "", "a\\b": "a/b"}
    df = spark.createDataFrame(list(cases.items()), "p string, want string").withColumn("got", identity.posix_normalize(F.col("p")))
    assert [r.got for r in df.collect()] == list(cases.values())
    r = one(spark, d=identity.posix_dirname(F.lit("a/b/c.md")), n=identity.posix_dirname(F.lit("c.md")), last=identity.last_segment(F.lit("a/b/")), slug=identity.project_slug(F.lit("/home/x.y")),
            rel=identity.repo_relative(F.lit("/r/s/a.ts"), "/r/s"), v=identity.at_least_version(F.lit("v22.13.1"), "22.13.0"), w=identity.at_least_version(F.lit("22.9.0"), "22.13.0"))
    assert (r.d, r.n, r.last, r.slug, r.rel, r.v, r.w) == ("a/b", "", "b", "-home-x-y", "a.ts", True, False)


def test_ranges(spark):
    src = "ab\ncdef\ng"
    r = one(spark, r=identity.offset_range(F.lit(src), F.lit(4), F.lit(6)), s=identity.scope_range(F.lit("1:0-2:3")), bad=identity.scope_range(F.lit("x")),
            cut=identity.slice_lines(F.lit(src), *lit(1, 1, 2, 2)), same=identity.slice_lines(F.lit(src), *lit(2, 1, 2, 3)), line=text.source_line(F.lit(" a \r\n b "), F.lit(2)), none=text.source_line(F.lit("a"), F.lit(5)))
    assert r.r == "2:1-2:3" and tuple(r.s) == (1, 0, 2, 3) and r.bad is None and r.cut == "b\ncd" and r.same == "de" and r.line == "b" and r.none is None


def test_content_hash_survives_a_rename(spark):
    r = one(spark, a=text.content_hash(*lit("function foo() {\r\n  return foo(1) + $foo + foo_;\r\n}", "foo")), b=text.content_hash(*lit("function bar() {\n  return bar(1) + $foo + foo_;\n}\n", "bar")),
            c=text.content_hash(*lit("return 2", "foo")), span=text.span_hash(F.lit("x")))
    assert r.a == r.b != r.c and r.span == hashlib.sha256(b"x").hexdigest()


def test_tokens_and_restatement(spark):
    rows = [("exportCsvRows", "Exports CSV rows.", True), ("run", "Runs it.", True), ("lookup", "looks up the table", False), ("on", "once upon", False), ("f", "", True)]
    df = spark.createDataFrame(rows, "n string, d string, want boolean").withColumn("got", text.name_restatement(F.col("n"), F.col("d")))
    assert [r.got for r in df.collect()] == [r[2] for r in rows]
    assert one(spark, t=text.tokens(F.lit("readHTTPFile_v2 A"))).t == ["read", "httpfile", "v2"]


def test_search_scores(spark):
    rows = [("ring", "", 100), ("ring one", "", 80), ("a ring", "", 60), ("x", "has RING", 40), ("r-i-n-g", "", 30), ("rgni", "", 0), (None, None, 0)]
    df = spark.createDataFrame(rows, "n string, d string, want int").withColumn("got", text.search_score("Ring", F.col("n"), F.col("d")))
    assert [r.got for r in df.collect()] == [r.want for r in df.collect()]
    assert one(spark, p=text.highlighted(F.lit("a.B.c"), ".b")).p == ["a", ".B", ".c"]


def test_docstrings_targets_grades(spark):
    r = one(spark, d=text.docstring(F.array(*lit(" a", "b\n"))), e=text.docstring(F.array(*lit(" ﻿"))), t=text.target_path(F.lit(' x/y.md#frag "title" ')), s=text.shortened(F.lit("x" * 300)),
            g=text.grade_line(F.lit("G  fine work")), k=text.grade_line(F.lit("s")), q=text.grade_line(F.lit("quit")), b=text.grade_line(F.lit("good")))
    assert r.d == "a\n\nb" and r.e is None and r.t == "x/y.md" and len(r.s) == 201
    assert tuple(r.g) == ("verdict", "good", "fine work") and (r.k.kind, r.q.kind, r.b.kind) == ("skip", "quit", "invalid")


def test_bags_keep_types_apart(spark):
    b = F.lit('{"label": "L", "n": 3, "list": ["a", 1, "b"], "deep": {"x": 1}}')
    r = one(spark, s=bag.string_at(b, "label"), no=bag.string_at(b, "n"), n=bag.number_at(b, "n"), nn=bag.number_at(b, "label"), li=bag.strings_at(b, "list"), none=bag.strings_at(b, "n"), torn=bag.string_at(F.lit("{x"), "label"))
    assert (r.s, r.no, r.n, r.nn, r.li, r.none, r.torn) == ("L", None, 3.0, None, ["a", "b"], [], None)
    for bad in ("[1]", "null", "{"):
        with pytest.raises(Exception, match="not a JSON object"):
            spark.range(1).select(bag.checked(F.lit(bad))).collect()


def test_predicates(spark):
    r = one(spark, a=predicates.supported_source(F.lit("x/A.TSX")), b=predicates.supported_source(F.lit("a.md")), c=predicates.in_excluded_dir(F.lit("a/node_modules/b.ts")), d=predicates.external_target(F.lit("HTTPS://x")), e=predicates.external_target(F.lit("a/b")),
            f=predicates.skill_edge_kind(F.lit("scripts/x")), g=predicates.confidence(F.lit("probable")), h=predicates.confidence(F.lit("?")), i=predicates.within_root(F.lit("ab"), "a"), j=predicates.within_root(F.lit("a/b"), "a"),
            k=predicates.stale_cursor(F.lit("cursor-1.json"), F.lit(8.0), "cursor-", ".json"), l=predicates.is_inferred(F.lit(0.3)))
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.h, r.i, r.j, r.k, r.l) == (True, False, True, True, False, "skill.to_script", 0.6, 1.0, False, True, True, True)
    rows = [(None, None, None, "never"), ("2", "1", "x", "unhealthy"), ("2", "1", None, "in_flight"), ("2", None, None, "in_flight"), ("1", "2", None, "healthy")]
    df = spark.createDataFrame(rows, "a string, s string, e string, want string")
    assert [x.got for x in df.select(predicates.sync_state(F.col("a"), F.col("s"), F.col("e")).alias("got")).collect()] == [x[3] for x in rows]


def test_bundle_problems(spark):
    rows = [(None, None, None, "unreadable"), (" \n", None, None, "empty"), ("x", "{", None, "unparseable"), ("x", "{}", "a.md", "missing"), ("x", None, None, None)]
    df = spark.createDataFrame(rows, "s string, m string, f string, want string")
    for r in df.select("want", predicates.bundle_problem(F.col("s"), F.col("m"), F.col("f")).alias("got")).collect():
        assert (r.got is None) if r.want is None else r.want in r.got


FRONT = """---
name: my-skill
description: "Does a, b and c"
allowed-tools: Read, 'Write'
user-invocable: true
# comment
text: |
  line one

  line two
folded: >
  a
  b
list:
  - x
  - "y"
empty:
broken line
---
# Body
"""


def test_frontmatter(spark):
    assert extract.frontmatter_of(FRONT) == {
        "name": "my-skill", "description": "Does a, b and c", "tools": ["Read", "Write"], "user_invocable": True, "text": "line one\n\nline two", "folded": "a b", "list": ["x", "y"], "empty": "",
    }
    assert extract.frontmatter_of("no") == extract.frontmatter_of("---\nname: x\n") == extract.frontmatter_of(None) == {}
    df = spark.createDataFrame([(FRONT,), (None,)], "s string").select(extract.frontmatter(F.col("s")).alias("b"))
    assert bag.string_at(F.col("b"), "name") is not None and [r.n for r in df.select(bag.string_at(F.col("b"), "name").alias("n")).collect()] == ["my-skill", None]


def test_markdown_links(spark):
    src = 'see [a](x.md "T") and `[no](no.md)`\n```\n[no](no.md)\n```\n[b](y.md#f) [c](#only)'
    got = extract.markdown_links(spark.createDataFrame([(1, src), (2, None)], "id int, source string"), "source", ["id"]).orderBy("ordinal").collect()
    assert [(r.id, r.target, r.source_range) for r in got] == [(1, "x.md", "1:4-1:17"), (1, "y.md", "5:0-5:11")]


def test_sub_agents(spark):
    src = '{\n "sub_agents": ["one", {"name": "two", "file": "agents/two.md"}, 3, {"file": "x"}]\n}'
    got = extract.sub_agents(spark.createDataFrame([(1, src), (2, "{"), (3, '{"sub_agents": 1}')], "id int, source string"), "source", ["id"]).collect()
    assert [(r.name, r.file, r.source_range) for r in got] == [("one", None, "2:16-2:21"), ("two", "agents/two.md", "2:32-2:37")]
