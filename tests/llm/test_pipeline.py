import random
import re

import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from strataweave.llm import bpe, exact_dedup, jaccard_join
from strataweave.llm.shared import without_rows



def near_roots(texts):
    """The first text of each component, by comparing all pairs."""
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    root = list(range(len(sets)))
    for b in range(len(sets)):
        for a in range(b):
            if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if x == high else x for x in root]
    return root

def corpus():
    r = random.Random(4)
    words = {"aa": "banana papaya kahala manama nalani".split(), "zz": "strkt wrzlk pfchtz grmpf drvz".split()}
    rows = []
    for i in range(60):
        lang = "az"[i % 2] * 2
        rows.append((i, " ".join(r.choice(words[lang]) + str(r.randrange(10)) for _ in range(40)), f"src{i % 7}", lang))
    rows += [(100 + i, rows[i][1].replace(" ", "\n"), "src1", "aa") for i in range(5)]
    rows += [(200 + i, rows[i][1].rsplit(" ", 1)[0], None, "aa") for i in range(5, 9)]
    return [*rows, (300, None, "src0", None), (301, "ξψωφ " * 30, "src0", None), (302, "", None, None)]


def test_run_matches_brute_force(spark, docs, table_dir):
    rows = corpus()
    got = corpus_pipeline.run(spark, table_dir(docs(rows)))
    texts = {i: t for i, t, _, _ in rows if i not in (300, 301, 302)}
    seen, kept = {}, {}
    for i, t in sorted(texts.items(), key=lambda x: (-len(x[1]), x[0])):
        if seen.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), i) == i:
            kept[i] = t
    ids = sorted(kept)
    roots = near_roots([kept[i] for i in ids])
    left = {i for k, i in enumerate(ids) if roots[k] == k}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert {r.doc_id: r.n_tokens for r in got.collect()} == {i: len(own.encode_ordinary(kept[i])) for i in left}


def test_stages_keep_the_columns(spark, docs, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "language id" and len(corpus_pipeline.STAGES) == 5
    df = docs(corpus()).withColumn("row", F.lit("extra"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, df, "unused")
        if k < 4:
            assert out.columns == df.columns
        out.write.parquet(f"{tmp_path}/{k}")
        df = spark.read.parquet(f"{tmp_path}/{k}")


def test_repeated_rows_and_null_ids(docs):
    df = docs([(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, None), (2, "x y z w")])
    assert sorted((r.doc_id or -1, r.text) for r in exact_dedup.kept_documents(df).collect() if r.text) == [(1, "a b c"), (2, "x y z w")]
    assert jaccard_join.representative_documents(df).count() == 3
    assert exact_dedup.kept_documents(docs([])).count() == 0
    assert jaccard_join.representative_documents(docs([])).count() == 0


def test_rows_are_dropped_however_small_the_filter(spark):
    own = spark.range(500).selectExpr("id AS n", "concat('t', id) AS text", "id % 3 AS __cells")
    for bits in (64, 1 << 24):
        got = without_rows(own, "n", spark.range(0, 500, 7), bits)
        assert got.columns == own.columns and sorted(r.n for r in got.collect()) == [i for i in range(500) if i % 7]


def test_near_copies_go_by_five_words_and_four_fifths(spark, docs):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    texts = ["a b c", "a b c d", ""]
    for size in (8, 12, 25, 60, 120, 300):
        base = [word() for _ in range(size)]
        for changed in (0, 1, 1, size // 50, size // 30, size // 12):
            own = list(base)
            for at in r.sample(range(size), changed):
                own[at] = word()
            texts.append(" ".join(own))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.split()) else set() for t in texts]
    root = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if sets[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if x == high else x for x in root]
    kept = sorted(x.doc_id for x in corpus_pipeline.without_near_copies(spark, docs(texts), "unused").collect())
    assert kept == [i for i, x in enumerate(root) if i == x]
    # near copies of five words at 0.8 that three words at 0.9 do not link
    assert len(kept) < len(jaccard_join.representative_documents(docs(texts)).collect())
