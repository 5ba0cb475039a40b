import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from strataweave.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string"
BLANKS = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if what == 1:
            text = ""
        if what == 2:
            text = re.sub("[.!?]", "", text)
        if what == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if what == 0 else 2 if what == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        said = text.rstrip(BLANKS)
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plans(rows, marks):
    """All edits with up to two insertions in a place: (cost, audit, repaired rows)."""
    ways = [(0, "", ())]
    add = lambda w: [(c + 5, a + "I", (*r, (x, ""))) for c, a, r in w for x in ("user", "assistant")]
    for (_, _, role, text), mark in zip(rows, marks, strict=True):
        ways += (once := add(ways)) + add(once)
        after = [(c + 2, a + "D", r) for c, a, r in ways]
        if mark not in ("blank", "duplicate"):
            more = 5 * (mark == "truncated")
            after += [(c + more, a + "K", (*r, (role, text))) for c, a, r in ways]
            after += [(c + 1 + more, a + "R", (*r, (x, text))) for c, a, r in ways for x in ("user", "assistant")]
        # What could still become a conversation.
        ways = [w for w in after if re.fullmatch("(s?(ua)*u?)?", "".join(x[0][:1] or " " for x in w[2]))]
    ways += (once := add(ways)) + add(once)
    return [w for w in ways if re.fullmatch("(s?(ua)+)?", "".join(x[0][:1] or " " for x in w[2]))]


def expected(conv, rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
    marks, turns = faults(rows), {r[1] for r in rows if r[1] is not None}
    cost, audit, kept = min(plans(rows, marks))
    pairs = [a[2][:1] + b[2][:1] for a, b in itertools.pairwise(rows)]
    said = "\n".join(f"{a}:{b}" for a, b in kept)
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return conv, gaps, *(marks.count(m) for m in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(said.encode()).hexdigest()


def brute(rows, ids):
    own = defaultdict(list)
    for r in rows:
        own[r[0]].append(r)
    return sorted((expected(c, own[c]) for c in ids), key=repr)


def made(n, seed):
    r = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", None, "tool"]
    texts = ["Yes.", "No!", "Why?", "cut", "", " \n", None, "é漢 end. \t", "More words."]
    rows = []
    for c in range(n):
        rows += [(c, None if r.random() < 0.05 else t + (t > 3) * r.randint(0, 2), r.choice(roles), r.choice(texts)) for t in range(r.randint(1, 4))]
    return rows


def test_every_short_signature_has_the_cheapest_edits():
    trie = cr.Trie()
    names = {0: "system", 1: "user", 2: "assistant", 3: "tool"}
    for n in range(4):
        for s in map("".join, itertools.product("abcdefgiln", repeat=n)):
            codes = [ord(c) - 97 for c in s]
            rows = [(0, k, names[c % 4], f"{k}") for k, c in enumerate(codes)]
            marks = [("", "truncated", "blank", "duplicate")[c // 4] for c in codes]
            assert trie.answer(s) == min(plans(rows, marks))[:2], s


def test_query_of_damaged_rows_equals_brute_force(spark):
    rows = [*made(120, 1), *((None, t, "user" if t % 2 else "assistant", f"t{t}.") for t in range(3)), (500, 1, "user", "same."), (500, 1, "user", "same."), (501, 2**40, "user", "a.")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = cr.repair(cr.damaged(df), df)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(damage(rows), {r[0] for r in rows})


def test_repaired_rows_are_those_of_the_digest(spark):
    rows = damage(made(40, 2))
    df = spark.createDataFrame(rows, SCHEMA)
    told = cr.diagnosed(df).cache()
    own = defaultdict(list)
    for r in cr.repaired(df, told).collect():
        own[r.conv_id].append(r)
    digests = {r.conv_id: r for r in cr.repair(df).collect()}
    for conv, row in digests.items():
        got = sorted(own[conv], key=lambda r: r.position)
        assert [r.position for r in got] == list(range(len(got)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in got))
        assert "".join(r.edit for r in got) == row.audit.replace("D", "")
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in got).encode()).hexdigest() == row.repaired_sha256


@pytest.mark.parametrize("n", [3000])
def test_a_long_conversation_is_spread_and_whole(spark, n, monkeypatch):
    monkeypatch.setattr(cr, "SEGMENT", 64)
    rows = [(7, t, "user" if t % 2 == 0 else "assistant", f"row {t}." if t % 5 else "cut") for t in range(n)] + [(8, t, "user", "x" * 300_000 + ".") for t in range(2)]
    r = next(x for x in cr.repair(spark.createDataFrame(rows, SCHEMA)).collect() if x.conv_id == 7)
    assert len(r.audit.replace("I", "")) == n and r.duplicate > n // 5 - 5 and r.truncated == 2 and r.gaps == 0
    assert r.audit.count("D") >= r.duplicate
    trie, signature = cr.Trie(), "".join("f" if t == 0 else "g" if t == 5 else "nm"[t % 2 == 1] if t % 5 == 0 else "bc"[t % 2] for t in range(n))
    assert trie.answer(signature)[0] == r.cost


def test_no_rows_and_clashing_names(spark):
    from pyspark.sql import functions as F

    assert cr.repair(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, 0, "user", "a.")], SCHEMA).withColumns({c: F.lit(1) for c in ("at", "told", "digest", "audit")})
    assert [tuple(r)[:-1] for r in cr.repair(df).collect()] == [(1, 0, 0, 0, 0, 0, 2, "D")]
    gone = cr.repair(df.limit(0), df).collect()
    assert [tuple(r) for r in gone] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
