"""Fill-in-middle transformation by rank and select over packed code point boundaries.

A document of n code points is cut after two of them into prefix, middle and suffix, which are
written in another order between sentinels: ``psm`` (prefix, suffix, middle) or ``spm`` (suffix, prefix,
middle); ``plain`` documents stay as they are. Everything that is drawn comes from a hash of seed and id.

No text is decoded. Of the UTF-8 bytes of a slice of rows, a bit vector marks those that begin a
code point, packed into words of 64 bits, with a directory of the bits before each block of
BLOCK bits. ``rank`` at the ends of a row gives its n, ``select`` of two ranks gives the bytes where it is
cut; both look at one block only, for all rows of a slice at once.

Defined results for odd input: a null text is empty, an empty text is plain; a text that holds a
sentinel is plain, so a written row always says where it was cut; a null id counts as an empty one, and
repeated rows are cut alike; a stray continuation byte belongs to the code point before it; an
empty table gives an empty result; further columns are ignored, whatever their names; a text of any length is one row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.llm.shared import bounded, lean, with_small_batches

SEED = 1
#: Of 100 documents, how many are cut, and how many of those are written suffix first.
CUT_SHARE, SUFFIX_FIRST_SHARE = 90, 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bits of a block of the directory: eight words.
BLOCK = 512


class Boundaries:
    """The code point boundaries of UTF-8 bytes: ``rank`` and ``select`` in one block each."""

    def __init__(self, data: np.ndarray):
        self.n_bytes = len(data)
        packed = np.packbits((data & 0xC0) != 0x80, bitorder="little")
        bits = np.zeros((self.n_bytes // BLOCK + 1) * (BLOCK // 8), np.uint8)
        bits[: len(packed)] = packed
        self.words = bits.view("<u8").reshape(-1, BLOCK // 64)
        held = np.bitwise_count(self.words).sum(1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(held)])
        self.total = int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Boundaries before each byte position."""
        block, word, bit = at // BLOCK, at % BLOCK // 64, (at % 64).astype(np.uint64)
        rows = self.words[block]
        whole = np.where(np.arange(BLOCK // 64) < word[:, None], np.bitwise_count(rows), 0).sum(1, dtype=np.int64)
        part = rows[np.arange(len(at)), word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[block] + whole + np.bitwise_count(part)

    def select(self, rank: np.ndarray) -> np.ndarray:
        """The byte position of the boundary with each rank; the end for the rank after the last."""
        out = np.full(len(rank), self.n_bytes, np.int64)
        inside = rank < self.total
        asked = rank[inside]
        block = np.searchsorted(self.before, asked, side="right") - 1
        rows = self.words[block]
        upto = np.bitwise_count(rows).cumsum(1, dtype=np.int64)
        left = asked - self.before[block]
        word = (upto <= left[:, None]).sum(1)
        at = np.arange(len(asked))
        left -= np.where(word > 0, upto[at, word - 1], 0)
        bits = np.unpackbits(rows[at, word].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        bit = (bits.cumsum(1, dtype=np.int64) > left[:, None]).argmax(1) if len(asked) else word
        out[inside] = block * BLOCK + word * 64 + bit
        return out


def draws(ids: list, seed: int) -> np.ndarray:
    """Four unsigned 32-bit numbers for each id."""
    raw = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(raw, ">u4").reshape(-1, 4).astype(np.int64)


def transform(docs: DataFrame, seed: int = SEED, cut_share: int = CUT_SHARE, suffix_first_share: int = SUFFIX_FIRST_SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output (the text that is written) of each document."""
    with_small_batches(docs.sparkSession)
    signs = tuple(s.encode() for s in (PREFIX, SUFFIX, MIDDLE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):
            texts = batch.column(1).cast(pa.large_binary())
            ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
            data = memoryview(texts.buffers()[2] or b"")[ends[0] : ends[-1]]
            ends = ends - ends[0]
            marks = Boundaries(np.frombuffer(data, np.uint8))
            ranks = marks.rank(ends)
            n, h = np.diff(ranks), draws(batch.column(0).to_pylist(), seed)
            one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
            low, high = np.minimum(one, two), np.maximum(one, two)
            cuts = np.stack([ends[:-1], marks.select(ranks[:-1] + low), marks.select(ranks[:-1] + high), ends[1:]], 1)
            forms, outputs = [], []
            for (s, a, b, e), (_, _, h3, h4) in zip(np.minimum(cuts, ends[1:, None]).tolist(), h.tolist(), strict=True):
                text = bytes(data[s:e])
                if not text or h3 % 100 >= cut_share or any(x in text for x in signs):
                    forms.append("plain")
                    outputs.append(text)
                    continue
                prefix, middle, suffix = signs[0] + text[: a - s], signs[2] + text[a - s : b - s], signs[1] + text[b - s :]
                forms.append("spm" if h4 % 100 < suffix_first_share else "psm")
                outputs.append(b"".join((suffix, prefix, middle) if forms[-1] == "spm" else (prefix, suffix, middle)))
            plain = np.array([f == "plain" for f in forms], bool)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(forms, pa.string()), pa.array(low, mask=plain), pa.array(high - low, mask=plain), pa.array(outputs, pa.binary())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    out = own.mapInArrow(lean(run), f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text from what was written and its form; only sentinels of the transformation are in a row that was cut."""
    parts = F.split(output, "|".join(re.escape(s) for s in (PREFIX, SUFFIX, MIDDLE)), -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)
