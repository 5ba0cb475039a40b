"""From documents to token digests: language, exact and near copies, source mix, encoding.

Each stage takes the documents that the one before kept and, but for the last, returns rows
with the columns of documents. ``run`` writes each stage's result in the shared folder and
reads it again, so a lost executor costs a stage at most; what a stage wrote for itself is
removed when the next one begins in the same thread.

Defined results for odd input: a null or empty text, or one without a letter, has no language and goes
in the first stage; of repeated rows one stays; ties go to the smallest id, and a null id loses them;
a text shorter than a shingle is one shingle; an empty table gives an empty result; further columns
are carried to the last stage, whatever their names, which returns its own; texts of any length are read whole.
"""

from __future__ import annotations

import threading

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strataweave.llm import bpe, exact_dedup, jaccard_join, language_id, mixing
from strataweave.llm.shared import Scratch, documents, staged

#: The scope of the stage that runs in this thread; runs in other threads have their own.
_running = threading.local()


def _scope(spark: SparkSession) -> Scratch:
    """A scope for a stage's own tables. Those of the stage before go: its result is written."""
    if hasattr(_running, "scope"):
        _running.scope.release()
    _running.scope = Scratch(spark, at_exit=False)
    return _running.scope


def recognised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    with _scope(spark):
        return language_id.accepted_documents(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    with _scope(spark):
        return exact_dedup.kept_documents(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: shingles of five words, a similarity of 0.8 on."""
    with _scope(spark):
        return jaccard_join.representative_documents(docs, width=5, threshold=0.8)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order that gives sources their target weights."""
    with _scope(spark):
        return mixing.mixed_documents(docs, mixing.WEIGHTS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes."""
    with _scope(spark):
        return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language id", recognised),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("mixing sources to target weights", mixed),
    ("byte-level BPE encoding and decoding", encoded),
]

#: The first stage is a trained model, which SQL doesn't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = documents(spark, sf_dir)
    for name, stage in STAGES:
        out = staged(stage(spark, out, sf_dir), "stage-" + name.replace(" ", "-"))
    return out
