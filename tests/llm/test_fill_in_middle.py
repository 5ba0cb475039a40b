import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataweave.llm import fill_in_middle as fim


def expected(doc_id, text):
    """The same by code points of decoded text, as plainly as it can be said."""
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("n", [0, 1, 63, 64, 511, 512, 513, 1025, 5000])
def test_rank_and_select_are_the_boundaries_counted(n):
    r = random.Random(n)
    text = "".join(r.choice("aé漢😀") for _ in range(n))
    data = np.frombuffer(text.encode(), np.uint8)
    marks = fim.Boundaries(data)
    starts = [k for k, x in enumerate(data.tolist()) if x & 0xC0 != 0x80] + [len(data)]
    assert marks.total == n and marks.select(np.arange(n + 1)).tolist() == starts
    want = np.cumsum([0, *((data & 0xC0) != 0x80)])
    assert marks.rank(np.arange(len(data) + 1)).tolist() == want.tolist()


def test_equals_brute_force_and_is_restored(docs):
    r = random.Random(3)
    texts = ["".join(r.choice("ab é漢😀\n<>PSM") for _ in range(r.choice([0, 1, 2, 5, 40, 700]))) for _ in range(400)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(400, None), (401, "a<P>b"), (401, "a<P>b"), (None, "no id"), (402, "é" * 300_000), (403, "<P"), (404, "<S<S<"), (7, "another seven")]
    out = fim.transform(docs(rows).repartition(3)).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    got = sorted(((x.doc_id, x.n, x.form, x.prefix_chars, x.middle_chars, x.output) for x in out), key=repr)
    assert got == sorted(((i, *expected(i, t)) for i, t in rows), key=repr)
    assert sorted(((x.doc_id, x.back) for x in out), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)
    assert {x.form for x in out} == {"plain", "psm", "spm"}


def test_shares_are_arguments(docs):
    df = docs([f"text {i}" for i in range(200)])
    assert {r.form for r in fim.transform(df, cut_share=0).collect()} == {"plain"}
    assert {r.form for r in fim.transform(df, cut_share=100, suffix_first_share=100).collect()} == {"spm"}


def test_no_rows_and_clashing_names(docs):
    assert fim.transform(docs([])).count() == 0
    df = docs(["abc"]).withColumns({c: F.lit(1) for c in ("n", "form", "output")})
    assert fim.transform(df).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
