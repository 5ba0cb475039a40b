import hashlib
import re

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataweave.llm import exact_dedup
from strataweave.llm.exact_dedup import dedup, kept_documents
from strataweave.llm.shared import is_file_scan, slices


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    out = {}
    for norm, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            out[i] = (keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest())
    return out


LONG = "".join(f"Sentence {i * i} runs on, and on. " for i in range(3000))
ROWS = [
    (1, None), (2, ""), (3, " \t\r\n\x0b\x0c"), (4, "a b"), (5, "ab"), (6, "a\nb"), (7, "a b"), (8, LONG), (9, LONG.replace(" ", "\n\n")),
    (10, LONG[:-3] + "?"), (11, "x" * 10000), (12, "x" * 10000), (13, "x" * 9999), (14, "\U0001f600 é"), (15, "\U0001f600é"),
]


@pytest.mark.parametrize("bits", [64, 3])
def test_matches_brute_force(docs, bits):
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.dedup(docs(ROWS), bits=bits).collect()}
    assert got == brute(ROWS)


def test_clashing_identifiers_are_told_apart(docs):
    texts = [f"text number {i}" for i in range(40)]
    assert exact_dedup.clashing_chunks(docs(texts)) is None
    assert exact_dedup.clashing_chunks(docs(texts), bits=2).count() > 0
    assert exact_dedup.dedup(docs(texts), bits=2).filter("kept").count() == 40


def test_repeated_rows_null_ids_and_no_rows(docs):
    got = exact_dedup.dedup(docs([(1, "a"), (1, "a"), (None, "a"), (None, "b")]))
    assert got.filter("kept").count() == 2
    assert got.filter("keep_id = 1").count() == 3
    assert exact_dedup.dedup(docs([])).count() == 0


def test_extra_columns_with_the_operators_names(docs):
    df = docs(["a", "a "]).withColumns({c: F.lit("z") for c in ("row", "kept", "recipe", "chunks", "h", "norm")})
    assert exact_dedup.dedup(df).filter("kept").count() == 1


def test_ids_that_are_strings_or_extreme(spark, docs):
    low = -(1 << 63)
    got = {r.doc_id: (r.keep_id, r.kept) for r in dedup(docs([(low, "a b"), (5, "ab"), (None, "a b"), (6, "x")])).collect()}
    assert got == {low: (low, True), 5: (low, False), None: (low, False), 6: (6, True)}
    df = spark.createDataFrame([("b", "a b"), ("a", "a b"), (None, "a b")], "doc_id string, text string")
    assert {(r.doc_id, r.kept) for r in dedup(df).collect()} == {("a", True), ("b", False), (None, False)}


@pytest.mark.parametrize("scan", [False, True])
def test_columns_with_the_names_of_internal_ones(docs, table_dir, spark, scan):
    names = ["__at", "__cell", "__bits", "__gone", "__maybe", "__row", "row", "a.b"]
    df = docs([(1, "a b"), (2, "ab"), (3, "c")]).withColumns({c: F.concat(F.lit(c), "doc_id") for c in names})
    if scan:
        df = spark.read.parquet(f"{table_dir(df)}/documents.parquet")
    got = kept_documents(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id, r["__at"], r["a.b"], r["row"]) for r in got.collect()) == [(1, "__at1", "a.b1", "row1"), (3, "__at3", "a.b3", "row3")]


def test_rows_of_files_are_named_without_a_copy(docs, table_dir, spark):
    df = spark.read.parquet(f"{table_dir(docs([(1, 'a')]))}/documents.parquet")
    assert is_file_scan(df) and not is_file_scan(df.filter("doc_id = 1")) and not is_file_scan(df.crossJoin(df)) and not is_file_scan(docs([(1, "a")]))


@given(st.lists(st.one_of(st.none(), st.text(max_size=30)), max_size=30), st.integers(1, 40))
def test_slices_hold_all_rows_in_order_and_bounded_bytes(texts, most):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["i", "t"])
    parts = list(slices(batch, 1, most))
    assert [x for p in parts for x in p.column(1).to_pylist()] == texts
    assert all(len(p) == 1 or sum(len((t or "").encode()) for t in p.column(1).to_pylist()) <= most for p in parts)
