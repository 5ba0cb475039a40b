import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataweave.llm import language_id as L
from strataweave.llm.queries import op5_language_id

LEXICON = {"aa": "banana papaya kahala manama".split(), "zz": "strkt wrzlk pfchtz grmpf".split()}


def text(lang, seed, n=30):
    r = random.Random(seed)
    return " ".join(r.choice(LEXICON[lang]) for _ in range(n)) + "."


def rows(n):
    return [(i, text("az"[i % 2] * 2, i), "s", "az"[i % 2] * 2) for i in range(n)]


def plain(counts, order=L.ORDER):
    """Kneser-Ney by definition, with dictionaries; returns p(char | word so far)."""
    grams = [Counter() for _ in range(order)]
    for w, c in counts.items():
        s = f" {w} "
        for e in range(1, len(s)):
            for n in range(min(order, e + 1)):
                grams[n][s[e - n : e + 1]] += c
    use = []
    for n in range(order):
        if n == order - 1:
            use.append(dict(grams[n]))
        else:
            left = Counter(g[1:] for g in grams[n + 1])
            use.append({g: (left[g] if left[g] and not (n and g[0] == " ") else c) for g, c in grams[n].items()})
    vocabulary = len(use[0]) + 1

    def d(n):
        one, two = (sum(c == k for c in use[n].values()) for k in (1, 2))
        return min(0.95, max(0.05, one / (one + 2 * two))) if one else 0.5

    def p(h, ch, n):
        if n < 0:
            return 1 / vocabulary
        h = h[len(h) - n :]
        same = {g: c for g, c in use[n].items() if g[:-1] == h}
        if not same:
            return p(h[1:], ch, n - 1)
        total = sum(same.values())
        return max(same.get(h + ch, 0) - d(n), 0) / total + d(n) * len(same) / total * p(h[1:], ch, n - 1)

    return lambda s, e: p(s[max(0, e - order + 1) : e], s[e], min(order - 1, e))


def test_model_is_kneser_ney():
    counts = Counter({"banana": 3, "bandana": 1, "cab": 2, "é": 1})
    own, wanted = L.CharModel(counts), plain(counts)
    ws = ["banana", "bnana", "q", "cabé", "bandanas"]
    codes, place = L.codes_of(ws)
    got = own.log2(L.gram_hashes(codes, L.ORDER), place)
    expect = []
    for w in ws:
        s = f" {w} "
        expect += [0.0, *(math.log2(wanted(s, e)) for e in range(1, len(s)))]
    assert np.allclose(got, expect, atol=1e-3)


def test_held_out_accuracy_and_inputs(spark, docs, table_dir):
    df = docs([*rows(160), (1000, None, "s", "aa"), (1001, "12 3!", "s", "zz"), (1002, "", "s", None), (1003, text("aa", 7), "s", "zz"), (1003, text("aa", 7), "s", "zz"), (None, text("zz", 5), "s", None)])
    got = op5_language_id(spark, table_dir(df.withColumn("lang_pred", F.lit("x")))).collect()
    assert len(got) == 166
    for r in got:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
            if r.doc_id < 1000:
                assert r.lang_pred == "az"[r.doc_id % 2] * 2 and not r.rejected
        assert 0 <= r.score <= 1
    by = {r.doc_id: r for r in got}
    assert {by[i].lang_pred for i in (1000, 1001, 1002)} == {"und"} and by[1003].lang_pred == "aa" and by[None].lang_pred == "zz"


def test_foreign_text_is_rejected_and_clean_text_stays(docs):
    df = docs([*rows(80), (900, "ξψωφ " * 20, "s", None), (901, None, "s", None)])
    kept = L.accepted_documents(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == list(range(80))


def test_small_cache_and_long_text_give_the_same(monkeypatch):
    model = L.fit([(r[3], r[1]) for r in rows(60)]).ready()
    texts = [text("aa", 1, 5000), text("zz", 2), None]
    a = model.entropies(texts)
    monkeypatch.setattr(L, "CACHED", 2)
    b = model.ready().entropies(texts)
    assert a[2] is None and np.allclose(a[0], b[0]) and np.allclose(a[1], b[1])


def test_no_labels_and_no_rows(docs):
    assert {r.lang_pred for r in L.identify(docs(["abc def", None])).collect()} == {"und"}
    assert L.identify(docs([])).count() == 0


@pytest.mark.parametrize("rows_", [1, 5])
def test_sample_is_bounded_and_has_no_held_out_row(docs, rows_):
    df = docs([(i, f"t{i}", "s", "aa") for i in range(100)])
    sample = L.training_sample(df, "doc_id", "text", "lang", rows_).collect()
    assert len(sample) <= rows_ and all(zlib.crc32(r.text[1:].encode()) % 4 != 2 for r in sample) and sorted(r.n for r in sample) == list(range(1, len(sample) + 1))


def test_scores_and_rejection_on_short_slices():
    model = L.fit([(r[3], r[1]) for r in rows(400)]).ready()
    r = random.Random(3)
    for n in (1, 2, 4, 16):
        own = [" ".join(r.choice(LEXICON[lang]) for _ in range(n)) for lang in ("aa", "zz") for _ in range(50)]
        assert not any(model.decide(h, size)[2] for h, size in model.measured(own))
    foreign = ["".join(r.choice("qxjvy") for _ in range(6)) + " " + "".join(r.choice("qxjvy") for _ in range(7)) for _ in range(100)]
    assert sum(model.decide(h, size)[2] for h, size in model.measured(foreign)) >= 95


def test_carried_columns_of_any_name_and_repeated_ids(docs):
    df = docs(rows(40)).withColumns({c: F.lit(c) for c in ("__input", "__score", "__rejected", "__lang_pred", "a.b")})
    got = L.accepted_documents(df)
    assert got.columns == df.columns
    assert all(r["__score"] == "__score" and r["a.b"] == "a.b" for r in got.collect())
    # One id all over: rows are told apart by their text, and a sample is drawn.
    one = docs([(8, text("az"[i % 2] * 2, i), "s", "az"[i % 2] * 2) for i in range(200)])
    assert zlib.crc32(b"8") % 4 != 2 and 20 <= L.training_sample(one, "doc_id", "text", "lang", 20).count() <= 40


def test_sampled_texts_are_whole_and_counted_where_they_are(docs):
    df = docs([(i, text("aa" if i % 2 else "zz", i, 300 + i), "s", "aa" if i % 2 else "zz") for i in range(60)])
    sample = L.training_sample(df, "doc_id", "text", "lang")
    own = [(r.lang, r.text) for r in sample.orderBy("lang", "n").collect()]
    assert all(len(L.words(t)) >= 300 for _, t in own)
    one, two = L.learned(sample).ready(), L.fit(own).ready()
    asked = [text(lang, 99, n) for lang in ("aa", "zz") for n in (1, 3, 40)]
    for (h, n), (h2, n2) in zip(one.measured(asked), two.measured(asked), strict=True):
        assert n == n2 and np.allclose(h, h2)
        assert one.decide(h, n)[0] == two.decide(h2, n2)[0] and abs(one.decide(h, n)[1] - two.decide(h2, n2)[1]) < 1e-9


def test_too_many_languages_raise_before_they_are_gathered(docs, monkeypatch):
    monkeypatch.setattr(L, "LANGUAGES", 5)
    with pytest.raises(ValueError, match="more than 5"):
        L.identify(docs([(i, "abc", "s", f"l{i}") for i in range(100)]))
