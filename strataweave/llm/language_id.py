"""Language identification by interpolated Kneser-Ney character models.

Each language gets a character n-gram model over its words (a word is a run of letters, lower
case, with a border mark at either end). Probabilities and back-off weights are kept in sorted
hash arrays, one pair for each order. A text goes to the language with the lowest
cross-entropy per character. On slices of held-back rows of the sample, of one word and more, a
temperature and how it grows with the length are fitted, which turn the differences into a score
that is a probability at each length; and the mean and spread of the cross-entropy, which falls with the
length. A text too far above the mean for its length fits no language and is rejected.

Models are fitted on a bounded sample of labelled rows, SAMPLE for each language, taken by a
hash of id and text and read whole: words are counted on the cluster, and only rows that calibrate come to the
driver as texts. Predictions read every row and whole texts. Only the text is an input of a
prediction. A worker scores each distinct word once while it keeps it (up to CACHED words), and takes
texts in slices of bounded bytes. What is broadcast is bounded by LANGUAGES and the sample.

Defined results for odd input: a text that is null or has no letter is ``und`` with score 0,
and rejected; without labelled rows every text is ``und``; a null id is never held out and
never learned from; repeated rows get equal predictions; ties go to the first language by
name; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataweave.llm.shared import bounded, free_name, lean, staged, with_small_batches

#: Sampled rows for each language; characters of context and the one after; words a worker keeps.
SAMPLE, ORDER, CACHED = 400, 5, 200_000
#: Languages that models are made for (an error beyond: what the driver fits and the broadcast grow with them).
LANGUAGES = 500
#: Of the sample, every HELD_BACKth row calibrates. A text is rejected that lies MARGIN bits and DEVIATIONS
#: standard deviations for its length above the mean of its language. The margin lets texts in two languages stay.
HELD_BACK, MARGIN, DEVIATIONS = 5, 1.25, 6.0
UNKNOWN = "und"
BASE = np.uint64(0x9E3779B97F4A7C15)
WORD = re.compile(r"[^\W\d_]+")
BORDER = " "


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def codes_of(ws: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words with their border marks, and each one's place in its word."""
    text = "".join(f"{BORDER}{w}{BORDER}" for w in ws)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, ws), np.int64, len(ws)) + 2
    ends = np.cumsum(sizes)
    place = np.arange(len(codes)) - np.repeat(ends - sizes, sizes)
    return codes, place


def gram_hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1..order, a hash of the n code points that end at each place."""
    out, power = [], 1
    total = np.zeros(len(codes), np.uint64)
    for n in range(order):
        moved = np.zeros(len(codes), np.uint64)
        moved[n:] = codes[: len(codes) - n] + np.uint64(1)
        total = total + moved * np.uint64(power)
        mixed = total ^ (total >> np.uint64(31))
        out.append(mixed * BASE)
        power = power * int(BASE) % (1 << 64)
    return out


class SortedTable:
    """Values by hash, in a sorted array."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray):
        at = np.argsort(hashes)
        self.hashes, self.values = hashes[at], values[at].astype(np.float32)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each is there, and its value or 0."""
        if not len(self.hashes):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.float32)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        there = self.hashes[at] == hashes
        return there, np.where(there, self.values[at], np.float32(0))


class CharModel:
    """Interpolated Kneser-Ney over characters of words; log2 probabilities."""

    def __init__(self, counts: Counter, order: int = ORDER):
        self.order = order
        raw: list[Counter] = [Counter() for _ in range(order)]
        for w, c in counts.items():
            s = f"{BORDER}{w}{BORDER}"
            for e in range(1, len(s)):
                for n in range(1, min(order, e + 1) + 1):
                    raw[n - 1][s[e - n + 1 : e + 1]] += c
        # Below the top order a gram counts its distinct left neighbours; one that starts a word has none and keeps its count.
        used: list[dict[str, int]] = [dict() for _ in range(order)]
        for n in range(order):
            if n < order - 1:
                left: Counter = Counter(g[1:] for g in raw[n + 1])
                used[n] = {g: left[g] if left[g] and not (n and g[0] == BORDER) else c for g, c in raw[n].items()}
            else:
                used[n] = dict(raw[n])
        alphabet = len(used[0]) + 1
        self.floor = -math.log2(alphabet) if alphabet > 1 else -1.0
        prob: dict[str, float] = {}
        self.grams, self.backs = [], []
        for n in range(order):
            ones, twos = (sum(c == k for c in used[n].values()) for k in (1, 2))
            d = min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5
            total, kinds = defaultdict(int), defaultdict(int)
            for g, c in used[n].items():
                total[g[:-1]] += c
                kinds[g[:-1]] += 1
            own = {}
            for g, c in used[n].items():
                lower = prob.get(g[1:]) if n else 1 / alphabet
                own[g] = (c - d) / total[g[:-1]] + d * kinds[g[:-1]] / total[g[:-1]] * lower
            prob |= own
            self.grams.append(self._table(list(own), [math.log2(p) for p in own.values()], n + 1))
            back = {h: math.log2(d * kinds[h] / total[h]) for h in total}
            if n == 0:
                self.floor += back.get("", 0.0)
            self.backs.append(self._table(list(back), list(back.values()), n))

    @staticmethod
    def _table(grams: list[str], values: list[float], n: int) -> SortedTable:
        if not grams or n == 0:
            return SortedTable(np.zeros(0, np.uint64), np.zeros(0, np.float32))
        codes = np.frombuffer("".join(grams).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        return SortedTable(gram_hashes(codes, n)[-1][n - 1 :: n], np.array(values))

    def log2(self, hashes: list[np.ndarray], place: np.ndarray) -> np.ndarray:
        """For each place, log2 of its character's probability after those before it in the word; 0 at a word's first mark."""
        out, back = np.zeros(len(place), np.float32), np.zeros(len(place), np.float32)
        open_ = np.nonzero(place > 0)[0]
        for n in range(self.order, 0, -1):
            now = place[open_] + 1 >= n
            at = open_[now]
            there, value = self.grams[n - 1].find(hashes[n - 1][at])
            out[at[there]] = back[at[there]] + value[there]
            missed = at[~there]
            if n > 1:
                back[missed] += self.backs[n - 1].find(hashes[n - 2][missed - 1])[1]
            else:
                out[missed] = back[missed] + self.floor
            open_ = np.concatenate([open_[~now], missed])
            open_.sort()
        return out


class Identifier:
    """The models of all languages, what was calibrated, and the words met so far."""

    def __init__(self, models: dict[str, CharModel], temperature: float = 1.0, power: float = 0.0, spread: dict[str, tuple[float, float, float]] | None = None):
        self.models, self.temperature, self.power, self.spread = models, temperature, power, spread or {}
        self.langs = sorted(models)

    def ready(self) -> Identifier:
        self.index: dict[str, int] = {}
        self.costs = np.zeros((1024, len(self.langs)), np.float64)
        self.sizes = np.zeros(1024, np.int64)
        return self

    def learn_words(self, ws: list[str]) -> None:
        first, need = len(self.index), len(self.index) + len(ws)
        if need > len(self.sizes):
            room = max(need, 2 * len(self.sizes))
            self.costs = np.concatenate([self.costs, np.zeros((room - len(self.costs), len(self.langs)))])
            self.sizes = np.concatenate([self.sizes, np.zeros(room - len(self.sizes), np.int64)])
        for part in range(0, len(ws), 50_000):
            own = ws[part : part + 50_000]
            codes, place = codes_of(own)
            hashes = gram_hashes(codes, ORDER)
            starts = np.nonzero(place == 0)[0]
            at = slice(first + part, first + part + len(own))
            for k, lang in enumerate(self.langs):
                self.costs[at, k] = -np.add.reduceat(self.models[lang].log2(hashes, place).astype(np.float64), starts)
            self.sizes[at] = np.fromiter(map(len, own), np.int64, len(own)) + 1
        self.index.update(zip(ws, range(first, need), strict=True))

    def entropies(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Bits per character by language; None without a letter."""
        return [h for h, _ in self.measured(texts)]

    def measured(self, texts: list[str | None]) -> list[tuple[np.ndarray | None, int]]:
        """Bits per character by language, and how many characters gave them."""
        split = [words(t) if t else [] for t in texts]
        new = list({w for ws in split for w in ws if w not in self.index})
        if len(self.index) + len(new) > CACHED and self.index:
            self.index.clear()
            new = list({w for ws in split for w in ws})
        if new:
            self.learn_words(new)
        out: list[tuple[np.ndarray | None, int]] = []
        for ws, t in zip(split, texts, strict=True):
            if not ws or not any(map(str.isalpha, t)):
                out.append((None, 0))
                continue
            at = np.fromiter(map(self.index.__getitem__, ws), np.int64, len(ws))
            size = int(self.sizes[at].sum())
            out.append((self.costs[at].sum(0) / size, size))
        return out

    def decide(self, h: np.ndarray | None, size: int) -> tuple[str, float, bool]:
        """Language, score, whether rejected; ``size`` characters gave ``h``."""
        if h is None or not self.langs:
            return UNKNOWN, 0.0, True
        k = int(np.argmin(h))
        x = self.temperature * size**self.power * (h - h[k])
        return self.langs[k], round(1 / float(np.exp(-np.minimum(x, 700)).sum()), 6), bool(h[k] > self.limit(self.langs[k], size))

    def limit(self, lang: str, size: int) -> float:
        """The largest cross-entropy that is accepted: the shorter a text, the more chance there is in it."""
        if lang not in self.spread:
            return math.inf
        mean, across, within = self.spread[lang]
        return mean + MARGIN + DEVIATIONS * math.sqrt(across + within / size)


def cuts(text: str, k: int) -> list[str]:
    """The text and slices of it, of 1, 2, 4 and so on words, from a place that depends on ``k``: what scores are calibrated on."""
    ws = words(text)
    out, n = [text], 1
    while n < len(ws):
        at = (k * 7919) % (len(ws) - n + 1)
        out.append(" ".join(ws[at : at + n]))
        n *= 2
    return out


def spread_of(h: np.ndarray, size: np.ndarray) -> tuple[float, float, float]:
    """Mean of the cross-entropies ``h``, and their variance as across + within / size. What lies
    beyond DEVIATIONS of a first round, such as rows with a wrong label, is left out of the second."""
    for _ in range(2):
        mean = float((h * size).sum() / size.sum())
        off = (h - mean) ** 2
        within = float((off * size)[size <= np.quantile(size, 0.75)].mean())
        across = float(max(0.0, np.median(off - within / size)))
        near = off <= DEVIATIONS**2 * (across + within / size)
        h, size = h[near], size[near]
    return mean, across, within


def fit(sample: list[tuple[str, str]]) -> Identifier:
    """Models from (lang, text) rows, in their order; every HELD_BACKth row of a language calibrates."""
    by: dict[str, list[str]] = defaultdict(list)
    for lang, text in sample:
        by[lang].append(text)
    counts = {lang: Counter(w for k, t in enumerate(texts) if k % HELD_BACK != HELD_BACK - 1 for w in words(t)) for lang, texts in by.items()}
    return fitted(counts, {lang: texts[HELD_BACK - 1 :: HELD_BACK] for lang, texts in by.items()})


def fitted(counts: dict[str, Counter], held: dict[str, list[str]]) -> Identifier:
    """Models from the counts of words of each language, calibrated on texts held back."""
    back = [(lang, x) for lang, texts in held.items() for k, t in enumerate(texts) for x in cuts(t, k)]
    own = Identifier({lang: CharModel(c) for lang, c in counts.items() if c}).ready()
    found = [(own.langs.index(lang), h, n) for (lang, _), (h, n) in zip(back, own.measured([t for _, t in back]), strict=True) if h is not None and lang in own.models]
    if not found:
        return Identifier(own.models)
    at, h, n = np.array([x[0] for x in found]), np.stack([x[1] for x in found]), np.array([x[2] for x in found], float)
    apart = h - h.min(1, keepdims=True)

    def loss(temperature: float, power: float) -> float:
        x = -temperature * (n**power)[:, None] * apart
        return float((np.log(np.exp(x).sum(1)) - x[np.arange(len(at)), at]).sum())

    temperature, power = min(((2.0**t, p / 4) for t in range(-6, 7) for p in range(5)), key=lambda x: loss(*x))
    own_best = h.argmin(1) == at
    spread = {lang: spread_of(h[mine, k], n[mine]) for k, lang in enumerate(own.langs) if (mine := (at == k) & own_best).sum() > 1}
    return Identifier(own.models, temperature, power, spread)


def held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int = SAMPLE) -> DataFrame:
    """(lang, n, text): ``rows`` labelled rows of each language at most, numbered from 1, by a hash of id and text; never a held-out row.

    Repeated rows count once. Labels of more than LANGUAGES values raise before anything of their number is gathered.
    """
    usable = docs.filter(F.col(id_col).isNotNull() & ~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    usable = usable.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("full"))
    usable = usable.withColumn("h", F.pmod("full", F.lit(1 << 30)))
    sizes = usable.groupBy("lang").count().limit(LANGUAGES + 1).collect()
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages; models are broadcast for so many at most")
    rates = docs.sparkSession.createDataFrame([(r["lang"], int(min(1.0, 1.2 * rows / r["count"]) * (1 << 30))) for r in sizes], "lang string, rate long")
    some = usable.join(F.broadcast(rates), "lang").filter("h < rate").select("lang", "full", "h", "text")
    once = some.groupBy("lang", "full").agg(F.min("h").alias("h"), F.min("text").alias("text"))
    return once.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "full"))).filter(F.col("n") <= rows).select("lang", "n", "text")


def learned(sample: DataFrame) -> Identifier:
    """Models from a sample (lang, n, text): words are counted where the texts are, every HELD_BACKth row calibrates."""
    own = staged(sample, "language-sample")
    back = F.col("n") % HELD_BACK == 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):
            found = Counter((lang, w) for lang, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for w in words(t))
            if found:
                langs, ws = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(ws, pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "word", "n"])

    each = own.filter(~back).select("lang", "text").mapInArrow(lean(run), "lang string, word string, n long")
    counts: dict[str, Counter] = defaultdict(Counter)
    for r in each.groupBy("lang", "word").agg(F.sum("n").alias("n")).orderBy("lang", "word").toLocalIterator():
        counts[r["lang"]][r["word"]] = r["n"]
    held: dict[str, list[str]] = defaultdict(list)
    for r in own.filter(back).orderBy("lang", "n").toLocalIterator():
        held[r["lang"]].append(r["text"])
    return fitted(counts, held)


def predict(docs: DataFrame, model: Identifier, text_col: str = "text", carry: list[str] | None = None, names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """The ``carry`` columns (default: all) with language, score and rejection under ``names``; the text is sent once."""
    shared = with_small_batches(docs.sparkSession).sparkContext.broadcast(model)
    kept = carry if carry is not None else docs.columns
    sent = kept if text_col in kept else [*kept, text_col]
    at, width = sent.index(text_col), len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value.ready()
        for batch in bounded(batches, at):
            found = [own.decide(h, n) for h, n in own.measured(batch.column(at).to_pylist())]
            made = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.float64(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *made], names=plain)

    # Plain names on the way, whatever the columns are called.
    plain = [*(f"c{k}" for k in range(width)), "lang", "score", "rejected"]
    source = docs.select(*(docs[f"`{c}`"].alias(f"c{k}") for k, c in enumerate(sent)))
    added = [T.StructField(c, t) for c, t in zip(plain[width:], (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True)]
    return source.mapInArrow(lean(run), T.StructType([*source.schema.fields[:width], *added])).toDF(*kept, *names)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of each document; learned from the rows not held out."""
    model = learned(training_sample(docs, id_col, text_col, lang_col))
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return predict(own, model, carry=["doc_id"]).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


def accepted_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language is recognised, with their columns."""
    model = learned(training_sample(docs, id_col, text_col, lang_col))
    names = tuple(free_name(docs, f"__{c}") for c in ("lang_pred", "score", "rejected"))
    return predict(docs, model, text_col, names=names).filter(~F.col(names[2])).select(*(F.col(f"`{c}`") for c in docs.columns))
