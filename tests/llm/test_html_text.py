import random
import time

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataweave.llm import html_text
from strataweave.llm.queries import op3_html_text

CASES = {
    "": "",
    "a<b>c</b>d": "acd",
    " a \n b ": "a b",
    "<p>a<p>b": "a\n\nb",
    "<div>a</div><div>b</div>": "a\nb",
    "a<br>b<br/>c": "a\nb\nc",
    "<ul><li>a<li>b<ul><li>c</ul></ul>d": "- a\n- b\n  - c\n\nd",
    "<ol start=3><li>a<li value=7>b<li>c</ol>": "3. a\n7. b\n8. c",
    "<table><tr><th>Name<th>Qty<tr><td>pie<td>1</table>": "Name  Qty\npie   1",
    "<table><td>a<td>b</table>": "a  b",
    "<table><tr><td colspan=2>long heading<tr><td>a<td>b</table>": "long heading\na  b",
    "<table><tr><td>a<br>b<td>c</table>": "a  c\nb",
    "<table><tr><td><table><tr><td>x<td>y</table><td>z</table>": "x  y  z",
    "<pre> a\n  b</pre>": " a\n  b",
    "<head><title>t</title></head><body>x": "x",
    "<script>a<b</script><style>p{}</style>x<template>y</template>": "x",
    "<p hidden>a</p><p style='color:red; DISPLAY : none'>b</p>c": "c",
    "<p style='visibility:hidden'>a<b style='visibility:visible'>b</b></p>": "b",
    "<details><summary>s</summary>x</details><details open><summary>t</summary>y</details>": "s\nt\ny",
    "&lt;b&gt; &amp; &eacute;&#8364;": "<b> & é€",
    "<input type=hidden value=a><input value=b>": "b",
    "<dl><dt>t<dd>d</dl>": "t\n  d",
    "</p>a</i></div>b": "ab",
    "<select><option>a<option>b</select>": "a\nb",
    "a<!-- x -->b": "ab",
}


@pytest.mark.parametrize(("html", "text"), CASES.items())
def test_rendering(html, text):
    assert html_text.text_of(html) == text


@given(st.lists(st.sampled_from(["<p>", "</p>", "<table>", "</table>", "<tr>", "<td>", "</td>", "<ul>", "<li>", "</ul>", "<ol>", "<pre>", "</pre>", "<div>", "</div>", "x", " y ", "<b>", "</b>", "<dd>", "<br>", "<details>", "<"]), max_size=25))
def test_any_markup_renders_all_visible_words(parts):
    html = "".join(parts)
    text = html_text.text_of(html)
    if "<details>" not in parts and "<" not in parts:
        assert (text.count("x"), text.count("y")) == (parts.count("x"), parts.count(" y "))


def test_deep_nesting_and_long_pages():
    assert html_text.text_of("<div>" * 30000 + "x") == "x"
    assert html_text.text_of("<table><tr><td>" * 3000 + "x") == "x"
    assert html_text.text_of("<p>word</p>" * 20000).count("word") == 20000


def test_query(spark, tmp_path):
    rows = [(i, "u", h, "z") for i, h in enumerate(CASES)] + [(900, None, None, None), (None, "u", "<p>a", "z"), (901, "u", "x", "z"), (901, "u", "x", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").withColumn("n_lines", F.lit(3))
    df.write.parquet(f"{tmp_path}/pages.parquet")
    got = op3_html_text(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i, t in enumerate(CASES.values()):
        assert (by[i].text, by[i].n_chars, by[i].n_lines) == (t, len(t), len(t.split("\n")) if t else 0)
    assert by[900].text == ""
    assert html_text.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("style", "text"),
    {
        "backface-visibility:hidden": "a",
        "content-visibility:auto": "a",
        "content-visibility: hidden; color: red": "",
        "--display: none": "a",
        "visibility:inherit": "a",
        "visibility:unset": "a",
        "visibility:initial": "a",
        "visibility:hidden": "",
        "VISIBILITY : Collapse": "",
        "visibility:hidden;visibility:bogus": "",
        "visibility:hidden !important;visibility:visible": "",
        "display:none;display:block": "a",
        "display:none;display:bogus": "",
        "display/**/:none": "",
        "/* display:none */": "a",
        "background:url(data:x;display:none)": "a",
        "content:';display:none'": "a",
        "background:url(data:x;y);display:none": "",
    }.items(),
)
def test_styles_go_by_whole_names_and_valid_values(style, text):
    assert html_text.text_of(f'<div style="{style}">a</div>') == text


def test_hidden_parents_and_inherited_visibility():
    inner = "".join(f"<b style='visibility:{v}'>{v} </b>" for v in ("inherit", "unset", "initial", "visible", "collapse"))
    assert html_text.text_of(f"<p style='visibility:hidden'>{inner}</p>") == "initial visible"


@pytest.mark.parametrize(
    ("html", "text"),
    {
        "<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds": "so x=1 holds",
        "<math><semantics><mi>y</mi><annotation>tex</annotation><annotation-xml><ci>z</ci></annotation-xml></semantics></math>": "y",
        "<math><mtable><mtr><mtd>a</mtd><mtd>b</mtd></mtr></mtable></math>": "a b",
        "a <svg><title>t</title><desc>d</desc><metadata>m</metadata><defs><text>e</text></defs><style>p{}</style><script>s</script><g><text>Jan</text><text>Feb</text></g></svg> b": "a Jan Feb b",
        "<svg><defs/><title/><path d='M0'/><text>x<tspan>y</tspan></text></svg>z": "xy z",
        "<svg><text display=none>a</text><text visibility=hidden>b</text><text>c</text></svg>": "c",
        "<svg><foreignObject><p>a<p>b</foreignObject></svg>": "a\n\nb",
        "<p>o<svg><foreignObject><p>a</p></foreignObject><text>t</text></svg>x": "o\n\na\n\nt x",
        "<svg><defs><p>a</p>b": "a\n\nb",
        "<svg/>a<title>t</title>": "a",
        "<svg><a><text>in</text></a></svg><defs>out</defs>": "in out",
    }.items(),
)
def test_math_and_svg_are_inline_text(html, text):
    assert html_text.text_of(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    {
        "<head><title>T</title>Hello<br>world<p>x": "Hello\nworld\n\nx",
        "<head>\n<title>T</title><br>a": "a",
        "<head><input value=v>": "v",
        "<head></p>a": "a",
        "<head><meta><link><base><style>p{}</style><script>s</script><template>m</template>\n</head>b": "b",
        "<head><iframe></iframe>a<title>t</title>": "a",
        "<head><svg><text>c</text></svg>": "c",
    }.items(),
)
def test_head_ends_at_text_and_other_tags(html, text):
    assert html_text.text_of(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    {
        "<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>": "a  b\n   c\nd  e",
        "<table><tr><td>a<td rowspan=3>b<td>c<tr><td>d<td>e<tr><td>f<td>g</table>": "a  b  c\nd     e\nf     g",
        "<table><tr><td colspan=2 rowspan=2>a<td>b<tr><td>c<tr><td>dd<td>ee<td>ff</table>": "a       b\n        c\ndd  ee  ff",
        "<table><tr><td rowspan=2>a<td>b<tr></tr><tr><td>c<td>d</table>": "a  b\nc  d",
        "<table><thead><tr><th rowspan=9>a<th>b<tbody><tr><td>c<td>d</table>": "a  b\nc  d",
        "<table><tbody><tr><td rowspan=0>a<td>b<tr><td>c</tbody><tr><td>d<td>e</table>": "a  b\n   c\nd  e",
        "<table><tr><td rowspan=2>a<td rowspan=3>b<td>c<tr><td>d<tr><td>e<td>f</table>": "a  b  c\n      d\ne     f",
        "<table><tr><td rowspan=x>a<tr><td rowspan=-2>b<tr><td>c</table>": "a\nb\nc",
    }.items(),
)
def test_cells_stand_beside_those_that_reach_down(html, text):
    assert html_text.text_of(html) == text


def test_many_spans():
    html = "<table><tr>" + "<td rowspan=65534 colspan=1000>w" * 1000 + "<tr><td>w" * 3000
    assert html_text.text_of(html).count("w") == 4000


@pytest.mark.parametrize(
    ("html", "text"),
    {
        "<style>.h{display:none}</style><p class=h>a<p class='x h'>b<p class=hh>c": "c",
        "<p id=k>a<p>b<style>#k , i{visibility:hidden}</style><i>c</i>": "b",
        "<style>p{display:none}p.s{display:block}</style><p>a<p class=s>b": "b",
        "<style>.h{display:none}</style><p class=h style='display:block'>a": "a",
        "<style>.h{display:none!important}</style><p class=h style='display:block'>a": "",
        "<style>@media print{p{display:none}}@media screen{i{display:none}}</style><p>a<i>b</i>": "a",
        "<style>.a .b,.a>.b,p:hover{display:none}/* p{display:none} */</style><p class=a><b class=b>a": "a",
        "<style>#k{display:none}p{display:block}</style><p id=k>a<p>b": "b",
        "<style>p{display:none": "",
    }.items(),
)
def test_rules_of_style_elements(html, text):
    assert html_text.text_of(html) == text


def test_wide_characters_take_two_columns():
    assert html_text.text_of("<table><tr><td>漢字<td>b<tr><td>abcde<td>c</table>") == "漢字   b\nabcde  c"


CELL = st.tuples(st.integers(1, 3), st.integers(1, 3), st.text("ab", min_size=1, max_size=4))


@given(st.lists(st.lists(CELL, min_size=1, max_size=4), min_size=1, max_size=5))
def test_cells_begin_where_a_grid_of_slots_says(rows):
    """Brute force: every slot of the grid is marked; cells of one column begin at one place."""
    html = "<table>" + "".join("<tr>" + "".join(f"<td colspan={c} rowspan={r}>{t}" for c, r, t in row) for row in rows) + "</table>"
    taken, column = set(), {}
    for y, row in enumerate(rows):
        x = 0
        for k, (c, r, _) in enumerate(row):
            while (y, x) in taken:
                x += 1
            column[y, k] = x
            taken |= {(y + j, x + i) for j in range(r) for i in range(c)}
            x += c
    lines = html_text.text_of(html).split("\n")
    place = {}
    for y, row in enumerate(rows):
        assert lines[y].split() == [t for _, _, t in row]
        at = -1
        for k, (_, _, t) in enumerate(row):
            at = lines[y].index(t, at + 1)
            place.setdefault(column[y, k], []).append((at, any(c > 1 for c, _, _ in row[:k])))
            at += len(t)
    for at in place.values():
        # A text wider than the columns that it spans moves what follows in its row.
        assert len({x for x, moved in at if not moved}) <= 1


@pytest.mark.parametrize(
    "html",
    [
        "<p><button>" + "<div>" * 8000 + "x",
        "<table>" + "<tr><td colspan=999>a<td>b" * 100 + "</table>",
        "<table><tr><td>" + "x" * 100000 + "<td>y" + "<tr><td>a<td>b" * 2000 + "</table>",
        "<table>" + "".join(f"<tr><td colspan={i}>a<td>b" for i in range(1, 1000)),
        "<ul><li>a" * 8000,
        "<table><tr><td>a" * 8000,
        "<b><table><td>" + "<i>" * 8000 + "</b>" * 8000,
        "<table><tr>" + "<td>a" * 10000 + "<td>" + "x<br>" * 10000,
        "<br>" * 100000 + "x",
        "<!--" * 50000,
        "<a " * 50000,
        "<style>" + ".a{display:none}" * 10000 + "</style>" + "<p class=a>x<p>y" * 2000,
    ],
)
def test_cost_and_text_are_linear(html):
    began = time.process_time()
    assert len(html_text.text_of(html)) <= 12 * len(html)
    assert time.process_time() - began < 5


def by_slots(rows, groups):
    """Places of cells by asking every column of every row."""
    out, held = [], {}
    for r, row in enumerate(rows):
        if r in groups:
            held = {}
        taken, at, places = {c for c, until in held.items() if until > r}, 0, []
        for _, span, down in row:
            while at in taken:
                at += 1
            places.append(at)
            for c in range(at, at + span):
                if down != 1:
                    held[c] = max(held.get(c, 0), r + down if down else 10**9)
            at += span
        out.append(places)
    return out


def test_cells_that_reach_down_stand_where_slots_are_free():
    r = random.Random(4)
    for _ in range(3000):
        table = html_text.Table()
        for k in range(r.randint(1, 8)):
            table.rows.append([(["x"], r.choice([1, 1, 2, 3]), r.choice([1, 1, 1, 2, 3, 0, 4])) for _ in range(r.randint(0, 4))])
            if r.random() < 0.1:
                table.groups.add(k)
        assert [[at for at, _, _ in row] for row in html_text.placed(table)] == by_slots(table.rows, table.groups)


def test_rules_equal_a_look_at_every_rule():
    """Each element is asked for each rule in order; the heaviest and last says whether it is shown."""
    r = random.Random(6)
    for _ in range(150):
        rules = []
        for _ in range(r.randint(1, 8)):
            ids, classes, tag = r.sample("xy", r.choice([0, 0, 1])), r.sample("abc", r.randint(0, 2)), r.choice(["", "", "p", "i"])
            if ids or classes or tag:
                rules.append((ids, classes, tag, r.choice(["none", "block"]), r.random() < 0.2, r.choice(["", "@media screen{", "@media print{", "@layer u{@media all{"])))
        style = "".join(f"{w}{t}{''.join('#' + i for i in ids)}{''.join('.' + c for c in cs)}{{display:{v}{'!important' if force else ''}}}{'}' * w.count('{')}" for ids, cs, t, v, force, w in rules)
        cells, want = [], []
        for k in range(6):
            tag, own_id, own = r.choice(["p", "div"]), r.choice(["", "x", "y"]), set(r.sample("abcd", r.randint(0, 3)))
            cells.append(f"<{tag} id='{own_id}' class='{' '.join(own)}'>t{k}</{tag}>")
            met = [(force, len(ids), len(cs), bool(t), n, v) for n, (ids, cs, t, v, force, w) in enumerate(rules) if "print" not in w and t in ("", tag) and set(cs) <= own and set(ids) <= {own_id}]
            if not met or max(met)[-1] != "none":
                want.append(f"t{k}")
        root, sheet = html_text.parse(f"<style>{style}</style>{''.join(cells)}")
        assert html_text.render(root, sheet).split() == want, style


def long_pages():
    yield "nested conditions", "<style>" + "@media screen{" * 30_000 + ".a{display:none}</style><p class=a>x<p>y"
    yield "selectors with a common class", "<style>" + "".join(f".a.b{i}{{display:none}}" for i in range(10_000)) + "</style>" + "".join(f"<p class=a id=i{i}>t" for i in range(10_000))
    yield "cells to the end", "<table>" + "<tr><td rowspan=9999>x" * 17_000
    yield "cells that end at many rows", "<table>" + "".join(f"<tr><td rowspan={2 + i * 7919 % 9000}>x" for i in range(17_000))


@pytest.mark.parametrize("name,page", list(long_pages()), ids=lambda x: x if len(x) < 40 else "")
def test_cost_is_linear_in_odd_pages(name, page):
    began = time.process_time()
    root, sheet = html_text.parse(page)
    html_text.render(root, sheet)
    assert time.process_time() - began < 5
