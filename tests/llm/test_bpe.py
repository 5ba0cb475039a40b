import functools
import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataweave.llm import bpe
from strataweave.llm.queries import op9_byte_bpe

PATH = P.path("byte_bpe_50k.tiktoken")
TEXTS = ["", None, " ", "a", "Hello  world's\n\n end. ", "aaaa" * 900, "é😀漢字" * 40, "<|endoftext|>", "1234567890" * 30, "\x00\x01", "Hello  world's\n\n end. "]


@functools.cache
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def core():
    return bpe.encoder(PATH, P.PATTERN).core


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80) | st.text("etaoin shr\n.,'", max_size=200))
def test_same_ids_as_the_library(text):
    own = bpe.encoder(PATH, P.PATTERN)
    assert own.encode(text) == reference().encode_ordinary(text)
    assert own.core.decode(own.encode(text)).decode() == text


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=60) | st.text("etaoinsh", max_size=90).map(str.encode), st.data())
def test_appends_and_edits_are_exact(piece, data):
    core = bpe.encoder(PATH, P.PATTERN).core
    last = core.last_tokens(piece)
    cut = data.draw(st.integers(0, len(piece)))
    assert core.last_tokens(piece, core.last_tokens(piece[:cut])) == last
    removed = data.draw(st.integers(0, len(piece) - cut))
    new, fresh = core.edited(piece, last, cut, removed, data.draw(st.binary(max_size=8)))
    assert fresh == core.last_tokens(new)


def test_edit_of_a_long_piece_stops_early(core):
    piece = b"abcdefgh" * 5000
    last = core.last_tokens(piece)
    new, fresh = core.edited(piece, last, 100, 3, b"zz")
    assert len(new) == len(piece) - 1 and core.read_back(fresh) == core.read_back(core.last_tokens(new))


def test_older_generation_gives_the_same(core, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_PIECES", 3)
    own = bpe.TextEncoder(core.ranks, P.PATTERN)
    text = "one two three four five one two three " * 5
    assert own.encode(text) == reference().encode_ordinary(text) and len(own) <= 3


def test_query(spark, docs, table_dir):
    got = {r.doc_id: r for r in op9_byte_bpe(spark, table_dir(docs(TEXTS).withColumn("ids", F.lit(1)))).collect()}
    for i, t in enumerate(TEXTS):
        ids = reference().encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_operator_and_no_rows(docs):
    got = bpe.encoded(docs(["hi there", None]), PATH, P.PATTERN).orderBy("doc_id").collect()
    assert bytes(got[0].decoded) == b"hi there" and got[0].ids == reference().encode_ordinary("hi there") and got[1].ids == []
    assert bpe.digests(docs([]), PATH, P.PATTERN).count() == 0
    assert bpe.digests(docs([(None, "x"), (None, "x")]), PATH, P.PATTERN).count() == 2
