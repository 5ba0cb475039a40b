import functools

import public_tokenizers as P
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataweave.llm import token_counts
from strataweave.llm.queries import op10_token_counts

PATH = P.path("piece_bpe_32k.model")
TEXTS = ["", None, " ", "  ", "a", "a ", " a  b\n\nc ", "▁", "a▁b ▁ c", "<s> </s> <unk>", "é😀漢字かな" * 20, "word " * 6000, "x" * 9000, "a ", "\t \x00"]


@functools.cache
def reference():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@functools.cache
def lengths():
    return token_counts.Lengths(PATH, *token_counts.table(PATH, ["the", "of", "e"]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=40) | st.text("the of▁\n.é😀", max_size=60), max_size=5))
def test_sums_equal_the_library(texts):
    assert lengths().total(texts) == [len(reference().encode(t)) for t in texts]


def test_any_table_and_small_cache_give_the_same(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHED", 4)
    own = token_counts.Lengths(PATH, *token_counts.table(PATH, []))
    for _ in range(2):
        assert own.total([t or "" for t in TEXTS]) == [len(reference().encode(t or "")) for t in TEXTS]


def test_query(spark, docs, table_dir):
    got = {r.doc_id: r for r in op10_token_counts(spark, table_dir(docs(TEXTS).withColumn("n_tokens", F.lit(1)))).collect()}
    for i, t in enumerate(TEXTS):
        n = len(reference().encode(t or ""))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 4096)


def test_frequent_pre_tokens_come_from_all_rows(docs):
    df = docs([f"common rare{i}" for i in range(50)]).repartition(5)
    found = token_counts.frequent(df)
    assert "common" in found and len(found) <= token_counts.FREQUENT


def test_no_rows_null_ids_and_repeated_rows(docs):
    assert token_counts.counted(docs([]), PATH).count() == 0
    assert token_counts.counted(docs([(None, None), (1, "a b"), (1, "a b")]), PATH).count() == 3
