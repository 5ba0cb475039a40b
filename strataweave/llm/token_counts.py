"""Token counts of a sentence-piece model by a two-tier lookup on the map side.

The model's pieces never hold a space mark after another character, so no merge crosses from a
character to a following space: a text's count is the sum over its pre-tokens, each a run of
spaces with the characters up to the next space. A first pass over all texts finds frequent
pre-tokens with a mergeable heavy-hitter sketch of fixed size; their lengths are broadcast as a
compact table of at most FREQUENT entries, whatever the corpus. The second pass looks pre-tokens
up there, and encodes misses in batches into a bounded cache of the worker. No pre-token is
shuffled, and the sketch only decides what is fast: counts are exact for any table.

Whether the model allows the split is checked on its pieces; where it does not, whole texts are
encoded instead.

Defined results for odd input: a null text is empty and has 0 tokens; strings that look like
special tokens are plain text; repeated rows are counted alike; further columns are ignored,
whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.llm.shared import bounded, lean, resident, with_small_batches

#: Entries of the broadcast table and of each sketch; pre-tokens that a worker's cache holds.
FREQUENT, SKETCH, CACHED = 8192, 16384, 600_000
#: Sketches of map tasks are merged in this many groups before the last merge.
MERGES = 64
LIMIT = 4096
MARK = "▁"
#: A pre-token: the spaces before it and what follows up to the next space. The model treats its mark as a space.
PRE_TOKEN = re.compile(f"[ {MARK}]*[^ {MARK}]+|[ {MARK}]+$")


def processor(path: str):
    import sentencepiece

    return resident(("sentencepiece", path), lambda: sentencepiece.SentencePieceProcessor(model_file=path))


def splits(path: str) -> bool:
    """Whether counts add up over pre-tokens: no piece has a mark after another character, and texts are taken as they are."""
    own = processor(path)
    pieces = (own.id_to_piece(i) for i in range(own.get_piece_size()))
    if any(MARK in p.lstrip(MARK) for p in pieces):
        return False
    probe = "a  b ﬁ 　 c "
    return own.decode(own.encode(probe)) == probe


def count_alone(own, pre_tokens: list[str]) -> list[int]:
    """Lengths of pre-tokens. The model puts a mark before what it encodes, so the one that a pre-token
    has is taken off; it puts none before nothing, so a lone space is one piece by itself."""
    return [len(x) or 1 for x in own.encode([p[1:] for p in pre_tokens], num_threads=1)]


def pre_tokens(text: str) -> list[str]:
    """With the mark that the model puts before a text."""
    return PRE_TOKEN.findall(" " + text) if text else []


def frequent(docs: DataFrame, text_col: str = "text") -> list[str]:
    """Frequent pre-tokens of all texts, by sketches merged in the JVM; bounded by FREQUENT."""
    word = F.explode(F.split(F.col(text_col), " ")).alias("word")
    # Very long words are not worth a place in a sketch.
    words = docs.select(word).filter("length(word) BETWEEN 1 AND 40")
    part = F.pmod(F.spark_partition_id(), F.lit(MERGES)).alias("part")
    some = words.groupBy(part).agg(F.expr(f"approx_top_k_accumulate(word, {SKETCH})").alias("sketch"))
    # Grouped, though by one value: sketches of empty partitions can't be merged.
    last = some.groupBy(F.expr("part * 0")).agg(F.expr("approx_top_k_combine(sketch)").alias("sketch"))
    top = last.select(F.expr(f"approx_top_k_estimate(sketch, {FREQUENT})").alias("top"))
    return [r[0] for r in top.select(F.explode("top.item")).collect()]


class Lengths(dict):
    """Pre-token -> length; the broadcast tier and, after it, what this worker has met, in two generations:
    when CACHED are held they become the older one, of which what is met again comes back."""

    def __init__(self, path: str, words: bytes, ends: np.ndarray, lengths: np.ndarray):
        super().__init__()
        self.own = processor(path)
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        self.first = {words[s:e].decode(): int(n) for s, e, n in zip(starts.tolist(), ends.tolist(), lengths.tolist(), strict=True)}
        self.older: dict[str, int] = {}
        self.update(self.first)

    def total(self, texts: list[str]) -> list[int]:
        split = [pre_tokens(t) for t in texts]
        new = {p for ps in split for p in ps if p not in self}
        if new:
            found = {p: self.older[p] for p in new if p in self.older}
            missing = list(new - found.keys())
            found |= zip(missing, count_alone(self.own, missing), strict=True)
            if len(self) + len(found) > CACHED:
                self.older = dict(self)
                self.clear()
                self.update(self.first)
            self.update(found)
        return [sum(map(self.__getitem__, ps)) for ps in split]

    def __missing__(self, pre_token: str) -> int:
        return self.older[pre_token]


def table(path: str, words: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The broadcast tier: pre-tokens one after another, where each ends, and their lengths."""
    own = processor(path)
    marked = sorted({" " + w for w in words if MARK not in w})
    lengths = count_alone(own, marked) if marked else []
    raw = [w.encode() for w in marked]
    return b"".join(raw), np.cumsum([len(w) for w in raw], dtype=np.int64), np.array(lengths, dtype=np.uint16)


def counted(docs: DataFrame, model: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each document."""
    spark = with_small_batches(docs.sparkSession)
    whole = not splits(model)
    shared = spark.sparkContext.broadcast(table(model, [] if whole else frequent(docs, text_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths(model, *shared.value)
        for batch in bounded(batches, 1):
            texts = batch.column(1).to_pylist()
            n = [len(x) for x in lengths.own.encode(texts, num_threads=1)] if whole else lengths.total(texts)
            sizes = pa.compute.binary_length(batch.column(1)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), sizes, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(lean(run), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
