from collections import Counter
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataweave.llm import mixing

weights_of = st.dictionaries(st.sampled_from("abcdef*"), st.integers(1, 9), min_size=1)


@settings(max_examples=60, deadline=None)
@given(weights_of)
def test_pattern_stays_within_one_block(weights):
    slots = mixing.pattern(weights)
    total = sum(weights.values())
    at = {t: s for s, ts in slots.items() for t in ts}
    assert sorted(at) == list(range(total))
    for s, w in weights.items():
        for i, t in enumerate(slots[s]):
            assert i * total // w <= t < -(-(i + 1) * total // w)
        for t in range(total + 1):
            assert abs(sum(x < t for x in slots[s]) - Fraction(t * w, total)) < 1


@settings(max_examples=60, deadline=None)
@given(weights_of, st.data())
def test_phases_place_every_block_once(weights, data):
    blocks = {s: data.draw(st.integers(0, 60)) for s in weights}
    rows = mixing.phases(blocks, weights)
    slots = []
    for s, n in blocks.items():
        own = sorted((r for r in rows if r["source"] == s), key=lambda r: r["first"])
        covered = [j for r in own for j in range(r["first"], r["last"])]
        assert covered == list(range(n))
        mine = [r["base"] + (j - r["first"]) // len(r["slots"]) * r["period"] + r["slots"][(j - r["first"]) % len(r["slots"])] for r in own for j in range(r["first"], r["last"])]
        assert mine == sorted(mine)
        slots += mine
    assert sorted(slots) == list(range(sum(blocks.values())))


WEIGHTS = {"a": 3, "b": 2, "*": 1}


def brute(rows, block):
    """Blocks by an earliest-deadline-first run slot by slot, sources leaving as they run dry."""
    by = {}
    for i, s in sorted(rows):
        by.setdefault(s if s in ("a", "b") else "*", []).append(i)
    queue = {s: [v[i : i + block] for i in range(0, len(v), block)] for s, v in by.items()}
    out = []
    while any(queue.values()):
        own = {s: WEIGHTS[s] for s in sorted(queue) if queue[s]}
        total, done, period = sum(own.values()), dict.fromkeys(own, 0), []
        for t in range(total):
            s = min((-(-(done[s] + 1) * total // w), s) for s, w in own.items() if done[s] < w and done[s] * total // w <= t)[1]
            done[s] += 1
            if queue[s]:
                period += queue[s].pop(0)
        out += period
    return out


@pytest.mark.parametrize("block", [1, 3])
def test_positions_match_brute_force(docs, block):
    rows = [(i, "abbbaac"[i % 7] if i % 5 else None) for i in range(150)]
    got = mixing.mixed(docs([(i, "t", s) for i, s in rows]), WEIGHTS, block).orderBy("position").collect()
    assert [r.position for r in got] == list(range(150))
    assert [r.doc_id for r in got] == brute(rows, block)


def test_documents_come_out_in_order_with_their_columns(docs):
    df = docs([(i, f"t{i}", "ab"[i % 2]) for i in range(50)]).withColumns({"position": F.lit(7), "slot": F.lit(8), "__i": F.lit(1)})
    df = df.drop("__i")
    out = mixing.mixed_documents(df, WEIGHTS, 4)
    assert out.columns == df.columns and out.count() == 50
    assert [r.doc_id for r in out.collect()] == brute([(i, "ab"[i % 2]) for i in range(50)], 4)


def test_null_ids_repeated_rows_and_no_rows(docs):
    got = mixing.mixed(docs([(None, "x", "a"), (1, "x", "a"), (1, "x", "a"), (None, None, None)]), WEIGHTS)
    assert sorted(r.position for r in got.collect()) == [0, 1, 2, 3]
    assert mixing.mixed(docs([]), WEIGHTS).count() == 0
    with pytest.raises(ValueError):
        mixing.mixed(docs([]), {"a": 1})


def test_share_of_a_hot_source(docs):
    got = mixing.mixed(docs([(i, "t", "a" if i % 3 else "b") for i in range(300)]), WEIGHTS, 1)
    first = Counter(r.pool for r in got.filter("position < 100").collect())
    assert abs(first["a"] - 60) <= 1 and abs(first["b"] - 40) <= 1


def test_columns_with_the_names_of_internal_ones(docs):
    names = ["__j", "__i", "__p", "__p_base", "__g", "pool", "block", "position", "__mix_position"]
    df = docs([(i, f"t{i}", "ab*"[i % 3]) for i in range(9)]).withColumns({c: F.concat(F.lit(c), "doc_id") for c in names})
    got = mixing.mixed_documents(df, WEIGHTS, 2)
    assert got.columns == df.columns
    assert all(r[c] == f"{c}{r.doc_id}" for r in got.collect() for c in names) and got.count() == 9
