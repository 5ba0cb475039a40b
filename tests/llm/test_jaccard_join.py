import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataweave.llm import jaccard_join as J
from strataweave.llm.components import components


def shingle_set(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())


def roots_of(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def brute(texts):
    sets = [shingle_set(t) for t in texts]
    links = [(a, b) for b in range(len(sets)) for a in range(b) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    return [len(s) for s in sets], roots_of(len(sets), links)


def corpus(seed):
    """Copies with one to six words changed, chains of them, a passage many share, and odd texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(40)]
    out = [None, "", " \t\n", "one", "ONE", "one two", "One  two", "Émile É", "émile é"]
    for size in (5, 9, 11, 12, 20, 22, 30, 41, 60, 150, 400):
        base = [word() for _ in range(size)]
        out.append(" ".join(base))
        for k in range(9):
            own = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                own[r.randrange(size)] = word()
            if r.random() < 0.4:
                own = own[r.randrange(3) :]
            out.append(" ".join(own).upper() if k == 3 else "\n".join(own))
    chain = [word() for _ in range(120)]
    for _ in range(12):
        out.append(" ".join(chain))
        chain[r.randrange(120)] = word()
        chain.append(word())
    for _ in range(25):
        out.append(" ".join(passage + [word() for _ in range(r.choice([3, 10, 60]))]))
    r.shuffle(out)
    return out


@pytest.mark.parametrize(("seed", "boundary"), [(1, None), (2, 9), (3, 30)])
def test_matches_brute_force(docs, seed, boundary):
    texts = corpus(seed)
    sizes, roots = brute(texts)
    df = docs(texts).withColumns({c: F.lit("z") for c in ("n", "keys", "root", "row", "sid")})
    got = {r.doc_id: r for r in J.join(df.repartition(5), boundary=boundary).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].component_id for i in range(len(texts))] == roots


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 60), st.integers(0, 4), st.integers(0, 4), st.integers(8, 39), st.integers(0, 10**6))
def test_linked_sets_share_a_key(common, left, right, boundary, seed):
    x = np.random.default_rng(seed).integers(1, 2**63, common + left + right).astype(np.uint64)
    a, b = np.unique(x[: common + left]), np.unique(np.concatenate([x[:common], x[common + left :]]))
    if common * J.DEN >= J.NUM * (common + left + right):
        own = J.Signatures(boundary)
        assert set(own.keys(a).tolist()) & set(own.keys(b).tolist())


def test_sets_with_many_empty_blocks_keep_their_keys():
    own = J.Signatures(8)
    own.size_class(400)
    s = np.arange(1, 15, dtype=np.uint64)
    assert len(own.keys(s)) >= own.blocks(own.size_class(14))


def test_boundary_follows_the_cost():
    assert J.boundary_by_cost({}) == 8
    assert 9 <= J.boundary_by_cost({10: 1000, 12: 1000, 30: 1000}) < 30


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 20)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(20)}


def test_repeated_rows_null_ids_and_no_rows(docs):
    text = "a b c d e f g h i j k l"
    got = J.join(docs([(5, text), (5, text), (None, text), (None, "x y z"), (9, None), (None, None)])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.n_shingles) for r in got) == [(-1, -1, 0), (-1, -1, 1), (-1, 5, 10), (5, 5, 10), (5, 5, 10), (9, 9, 0)]
    assert len({r.first_row for r in got if r.n_shingles == 10}) == 1
    assert J.join(docs([])).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 60), st.integers(0, 8), st.integers(0, 8), st.integers(8, 20), st.integers(0, 10**6))
def test_linked_sets_share_a_key_at_four_fifths(common, left, right, boundary, seed):
    x = np.random.default_rng(seed).integers(1, 2**63, common + left + right).astype(np.uint64)
    a, b = np.unique(x[: common + left]), np.unique(np.concatenate([x[:common], x[common + left :]]))
    if common * 5 >= 4 * (common + left + right):
        own = J.Signatures(boundary, J.Rule.of(5, 0.8))
        assert set(own.keys(a).tolist()) & set(own.keys(b).tolist())


@given(st.integers(0, 300), st.integers(0, 300), st.integers(0, 300), st.sampled_from([64, 1024]), st.integers(0, 10**6))
def test_sketches_never_differ_by_more_than_sets(common, left, right, bits, seed):
    x = np.random.default_rng(seed).integers(1, 2**63, common + left + right).astype(np.uint64)
    a, b = np.unique(x[: common + left]), np.unique(np.concatenate([x[:common], x[common + left :]]))
    assert int(np.bitwise_count(J.sketch(a, bits) ^ J.sketch(b, bits)).sum()) <= len(np.setxor1d(a, b))


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 90), st.integers(0, 10), st.integers(0, 10), st.sampled_from([J.Rule(3, 9, 10), J.Rule(5, 4, 5), J.Rule(1, 1, 2)]), st.integers(0, 10**6))
def test_prefixes_of_linked_sets_share_enough(common, left, right, rule, seed):
    x = np.random.default_rng(seed).integers(1, 2**63, common + left + right).astype(np.uint64)
    a, b = np.unique(x[: common + left]), np.unique(np.concatenate([x[:common], x[common + left :]]))
    if common * rule.den >= rule.num * (common + left + right):
        both = np.intersect1d(a[: rule.prefix(len(a))], b[: rule.prefix(len(b))])
        assert len(both) >= max(rule.least_shared(len(a)), rule.least_shared(len(b)))
    assert np.array_equal(J.unpack(J.pack(a)), a & np.uint64((1 << 40) - 1))


def test_shared_counts_by_brute_force(spark, docs, monkeypatch):
    monkeypatch.setattr(J, "COUNTED", 50)
    monkeypatch.setattr(J, "SLICE_PACKED", 900)
    rule = J.Rule.of(3, 0.9)
    texts = corpus(5)
    sets = J.sets_of(docs(texts).repartition(4), "doc_id", "text", None, rule)
    own = {r.row: set(J.unpack(r.prefix).tolist()) for r in sets.collect()}
    held = {}
    for tokens in own.values():
        for t in tokens:
            held[t] = held.get(t, 0) + 1
    want = {row: n for row, tokens in own.items() if (n := sum(held[t] > 1 for t in tokens))}
    assert {r.row: r.shared for r in J.shared_counts(sets, rule).collect()} == want


def test_a_passage_in_all_sets_makes_no_pairs(spark):
    """Sets of a common passage and a part of their own that is just too large to link: no list holds the passage."""
    rows = [(i, i, 100, [*range(88), *(1000 * (i + 1) + k for k in range(12))]) for i in range(300)]
    arrays = spark.createDataFrame(rows, "sid long, comp long, n long, items array<long>")
    assert J.open_pairs(arrays, J.Rule.of(5, 0.8)).count() == 0
    linked = [(i, i, 100, [*range(90), *(1000 * (i + 1) + k for k in range(10))]) for i in range(20)]
    assert J.open_pairs(spark.createDataFrame(linked, arrays.schema), J.Rule.of(5, 0.8)).count() == 190


def test_very_long_texts_and_string_ids(docs):
    r = random.Random(8)
    base = [f"w{r.randrange(10**6)}" for _ in range(60000)]
    other = [w if k % 80 else "x" for k, w in enumerate(base)]
    df = docs([" ".join(base), " ".join(other), " ".join(base[:30000]), "a b c"]).withColumn("doc_id", F.concat(F.lit("id"), "doc_id"))
    got = {x.doc_id: x.component_id for x in J.join(df).collect()}
    assert got == {"id0": "id0", "id1": "id0", "id2": "id2", "id3": "id3"}
