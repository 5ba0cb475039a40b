"""Byte-level BPE encoding by prefix dynamic programming.

For every prefix of a byte string exactly one token can end its BPE encoding. The encoder
keeps that last token for each prefix: token t may end prefix p[:e] iff the token u that
ends p[:e - len(t)] and t are compatible, that is BPE leaves (u, t) as they are. Reading the
last tokens backwards gives the encoding. Appending bytes only adds prefixes, and an edit
changes prefixes from its place on until the encoder falls back into step, so both are exact
and cost what they touch. The work is linear in the length, also for very long pieces.

The compatibility of two tokens is decided without encoding them: undo their merges from the
latest back, and see whether BPE would have made an earlier merge across the border.

Texts are split by the tokenizer's pattern; each match is encoded separately, and a match that
is itself a token is that token. Workers keep the encodings of pieces they met, up to a bound, and
take texts in slices of bounded bytes.

Defined results for odd input: a null text is empty; an empty text has no tokens, its digests
are those of no bytes; lone surrogates cannot occur in a column of strings; repeated rows are
encoded alike; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.llm.shared import bounded, lean, resident, with_small_batches

#: Pieces whose encodings a worker keeps in each of two generations, and the longest piece kept; others are worked out again.
KEPT_PIECES, KEPT_LENGTH = 150_000, 64
#: Pairs of tokens whose compatibility a worker keeps.
KEPT_PAIRS = 500_000


class PrefixEncoder:
    """BPE over the ranks of a byte-level vocabulary (bytes -> rank)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.starts = {b[:n] for b in ranks for n in range(1, len(b) + 1)}
        # How BPE makes each token: its last merge. A token that BPE never makes can only be a whole piece.
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: set[int] = set()
        for b, i in sorted(ranks.items(), key=lambda x: x[1]):
            if len(b) == 1:
                self.made.add(i)
                continue
            both = self._merged(b, i)
            if len(both) == 2:
                self.parts[i] = both[0], both[1]
                self.made.add(i)
        self.pair = {p: i for i, p in self.parts.items()}
        self.makeable = {b: i for b, i in ranks.items() if i in self.made}
        #: Pairs of tokens (u << 32 | t) met so far and whether they are compatible.
        self.known: dict[int, bool] = {}

    def _merged(self, b: bytes, below: int) -> list[int]:
        """Tokens of ``b`` by merges of ranks under ``below``, lowest first; the textbook loop, for set-up and short strings."""
        t = [b[i : i + 1] for i in range(len(b))]
        while len(t) > 1:
            best, at = min((self.ranks.get(t[i] + t[i + 1], below), i) for i in range(len(t) - 1))
            if best >= below:
                break
            t[at : at + 2] = [t[at] + t[at + 1]]
        return [self.ranks[x] for x in t]

    def _compatible(self, u: int, t: int) -> bool:
        """Whether BPE of the bytes of u and t is just u, t."""
        # In the order of time backwards, what touches the border are (u, t) and what they were merged from.
        # A merge across it would have come first if it ranks before whichever of the two was made later;
        # at equal ranks the leftmost merge comes first.
        limit = None
        while True:
            across = self.pair.get((u, t))
            if across is not None and (limit is None or across < limit):
                return False
            later_u = u in self.parts and (t not in self.parts or u > t)
            if later_u:
                limit, u = u, self.parts[u][1]
            elif t in self.parts:
                limit, t = t + 1, self.parts[t][0]
            else:
                return True

    def last_tokens(self, piece: bytes, last: list[int] | None = None) -> list[int]:
        """The last token of each prefix; ``last[e]`` for ``piece[:e]``, ``last[0]`` is -1.

        With ``last`` of a prefix of ``piece`` given, it is extended: an exact append.
        """
        rank_of, starts, known, size = self.makeable.get, self.starts, self.known, len(piece)
        if len(known) > KEPT_PAIRS:
            known.clear()
        out = [-1] * (size + 1)
        done = 0
        if last:
            done = min(len(last), size + 1) - 1
            out[: done + 1] = last[: done + 1]
        # A token that ends beyond the old end may begin before it.
        for s in range(max(0, done - self.longest + 1) if done else 0, size):
            u = out[s]
            e = s + 1
            while e <= size and (x := piece[s:e]) in starts:
                if e > done and out[e] < 0 and (t := rank_of(x)) is not None:
                    if u < 0:
                        out[e] = t
                    else:
                        if (fits := known.get(key := u << 32 | t)) is None:
                            fits = known[key] = self._compatible(u, t)
                        if fits:
                            out[e] = t
                e += 1
        return out

    def read_back(self, last: list[int]) -> list[int]:
        out, e = [], len(last) - 1
        while e:
            out.append(last[e])
            e -= len(self.bytes[last[e]])
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        return self.read_back(self.last_tokens(piece))

    def edited(self, piece: bytes, last: list[int], at: int, removed: int, added: bytes) -> tuple[bytes, list[int]]:
        """The piece after an edit and its last tokens, worked out anew only near the edit.

        Beyond the edit, once the last tokens of as many prefixes as the longest token has bytes
        agree with the old ones, all later ones do.
        """
        new = piece[:at] + added + piece[at + removed :]
        shift = len(added) - removed
        out, size, same = last[: at + 1], len(new), 0
        while len(out) <= size:
            end = min(size, len(out) - 1 + 64)
            fresh = self.last_tokens(new[:end], out)
            for e in range(len(out), end + 1):
                old = last[e - shift] if e - shift > at + removed else None
                same = same + 1 if fresh[e] == old else 0
                out.append(fresh[e])
                if same >= 2 * self.longest:
                    return new, out + last[e - shift + 1 :]
        return new, out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    """Lines of a base64 token and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class TextEncoder(dict):
    """Maps a piece of text to its ids; encodings of short pieces are kept. When KEPT_PIECES are,
    they become the older generation, of which only what is met again stays."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.core = PrefixEncoder(ranks)
        self.split = regex.compile(pattern).findall
        self.older: dict[str, tuple[int, ...]] = {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece)
        if ids is None:
            ids = tuple(self.core.encode_piece(piece.encode()))
        if len(piece) <= KEPT_LENGTH:
            if len(self) >= KEPT_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        return [i for ids in map(self.__getitem__, self.split(text)) for i in ids]


def encoder(path: str, pattern: str) -> TextEncoder:
    """One for each worker process, until another operator's work comes."""
    return resident(("bpe", path, pattern), lambda: TextEncoder(read_ranks(path), pattern))


def encoded(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>) and decoded (binary) of each document."""
    return _per_text(docs, vocabulary, pattern, id_col, text_col, "ids array<int>, decoded binary", _ids_and_bytes)


def digests(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document."""
    return _per_text(docs, vocabulary, pattern, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", _digests)


def _ids_and_bytes(own: TextEncoder, text: str) -> tuple:
    ids = own.encode(text)
    return ids, own.core.decode(ids)


def _digests(own: TextEncoder, text: str) -> tuple:
    ids = own.encode(text)
    joined = " ".join(map(str, ids)).encode()
    return len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(own.core.decode(ids)).hexdigest()


def _per_text(docs: DataFrame, vocabulary: str, pattern: str, id_col: str, text_col: str, fields: str, make) -> DataFrame:
    types = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "binary": pa.binary()}
    named = [f.rsplit(" ", 1) for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary, pattern)
        for batch in bounded(batches, 1):
            rows = [make(own, t) for t in batch.column(1).to_pylist()]
            cols = list(zip(*rows, strict=True)) or [()] * len(named)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, types[kind]) for c, (_, kind) in zip(cols, named, strict=True))],
                names=["doc_id", *(n for n, _ in named)],
            )

    with_small_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(lean(run), f"doc_id {kind}, {fields}")
