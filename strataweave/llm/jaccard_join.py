"""N-gram Jaccard join by a size-aware heavy-light scheme, and the components of its links.

A document's set holds its distinct word shingles as 64-bit hashes. Equal sets are one class
from the start, whatever their number. Two classes link when |A n B| / |A u B| >= num / den,
so their symmetric difference is at most (|A| + |B|) * (den - num) / (den + num) shingles.
The words of a shingle and the threshold are arguments; all sizes below follow from them.

Most sets link with nothing, and that shows before any list is made. In the order of their hashes
the first |A| - ceil(num * |A| / den) + k(|A|) shingles of two linked sets have k of the smaller in common
(k(n) is a fifth of n). A first pass sends these prefixes, packed by ranges of hashes, to where it is
counted which shingles several sets hold; a set whose prefix has fewer than k(ceil(num * |A| / den)) of them
is done. A hash that cuts shingles to 40 bits can only keep a set in. Only what is left is read again.

Light sets (up to a boundary) enumerate subsets of a fixed size: a pair whose larger set has m
shingles shares ceil(num * m / den) of them, so each set emits its subsets of that size for
each m it may meet. Heavy sets are found in inverted lists. A list for each shingle would hold
a third of all documents for a common passage, so tier one lists blocks of shingles: sets of a
size class are dealt by hash into more blocks than their difference can touch, and a linked
pair has a block in common, whole. Tier two lists single shingles, of what tier one leaves open.
The boundary is where the sum of emitted rows, weighted by what a row costs later, is least
over the sizes that are left. A set below it that may meet one above emits for both.

Lists are not expanded to pairs. Each member is checked against one pivot of its list only; lists
whose members are then one component are done. The members of the others go to tier two:
shingles ordered rare first (by exact counts over those members), lists of the prefix that a linked
pair must share, and only pairs of different components that sizes and places allow. A list is split
by the size of its members: who looks for a partner of about its own size needs a shorter prefix than
one who may meet any, so a passage that many sets hold beside what is their own is in no list of theirs.
Every link is checked on the whole sets. So components are exact, and a group of copies costs its
size, not its square. Exact is up to the hashes: a shingle is 64 bits, and equal sets are those of
equal size and 128 bits.

Memory: the one broadcast is a bit map of fixed size; beyond what it can tell apart it lets
more through and all stays exact. Everything else is joined by key. Python works on slices of bounded bytes.

Defined results for odd input: a null or empty text, or one of white space, has no shingles
and links with nothing; a text of fewer words than a shingle's is one shingle; a null id has itself as
component unless linked, and then the smallest id there is; repeated rows are one class; an
empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataweave.llm.components import components
from strataweave.llm.shared import FILTER_BITS, Scratch, bounded, free_name, give_back, lean, marked, marks, numbered, staged, with_small_batches, without_rows

#: What the arguments are unless given: words of a shingle, and the threshold NUM / DEN.
WIDTH, NUM, DEN = 3, 9, 10
#: Blocks beyond those that a difference can touch: so many empty blocks of a set need no list.
SLACK = 1
#: Boundaries considered, and what an emitted block costs in emitted subsets (blocks are less selective).
BOUNDARIES, BLOCK_COST = range(8, 40), 4
#: Words whose hash a worker keeps.
KEPT_WORDS = 150_000
#: A prefix has n div EXTRA shingles beyond those that may differ; bytes of a shingle in it; shingles that one group counts.
EXTRA, PACKED, COUNTED = 5, 5, 250_000
#: Sizes that an inverted list of tier two is split by, each so many times the one before.
BAND = 1.06
#: Bits of the sketches that tell before sets are moved that a pair differs by too much; the longer is for pairs that the shorter leaves.
SKETCH_BITS = {"short": 1024, "long": 8192}
U = np.uint64


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A one-to-one scramble of 64-bit values."""
    x = (x ^ U(salt)) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(29))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(32))


class Rule(NamedTuple):
    """Words of a shingle, and the threshold num / den."""

    width: int = WIDTH
    num: int = NUM
    den: int = DEN

    @classmethod
    def of(cls, width: int, threshold: float) -> Rule:
        """The threshold as its decimal says, not as the float nearest to it."""
        exact = Fraction(str(threshold))
        if width < 1 or not 0 < exact <= 1:
            raise ValueError(f"width {width}, threshold {threshold}")
        return cls(width, exact.numerator, exact.denominator)

    def most_different(self, both: int) -> int:
        """Largest symmetric difference of a linked pair with ``both`` shingles together."""
        return both * (self.den - self.num) // (self.den + self.num)

    def least_common(self, n: int) -> int:
        """Shingles that a set of ``n`` shares with any that it links with."""
        return -(-self.num * n // self.den)

    def prefix(self, n: int) -> int:
        return n - self.least_common(n) + n // EXTRA

    def least_shared(self, n: int) -> int:
        """So many shingles of its prefix a linked set of ``n`` shares with its partner's."""
        return self.least_common(n) // EXTRA

    def sql(self, what: str, n: str = "n") -> str:
        common = f"(({n} * {self.num} + {self.den - 1}) div {self.den})"
        return {"least_common": common, "prefix": f"({n} - {common} + {n} div {EXTRA})", "least_shared": f"({common} div {EXTRA})"}[what]


class Words(dict):
    """Hashes of words; starts again when KEPT_WORDS are kept."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, known: Words, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes. Lower-casing and splitting of bytes touch A-Z and ASCII white space only."""
    ws = text.encode().lower().split() if text else []
    if not ws:
        return np.zeros(0, U)
    w = np.fromiter(map(known.__getitem__, ws), U, len(ws))
    n = max(1, len(w) - width + 1)
    k = min(width, len(w))
    total = np.full(n, k, U)
    for i in range(k):
        total = mixed(total + w[i : i + n], 0x9E3779B97F4A7C15 + i)
    return np.unique(total)


def sketch(s: np.ndarray, bits: int) -> np.ndarray:
    """Whether each of so many cells holds an odd number of shingles: two sets differ by as many shingles as cells at least."""
    odd = np.bincount((mixed(s, 51) % U(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(U)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    a, b = mixed(s, 11).sum(dtype=U), np.bitwise_xor.reduce(mixed(s, 12)) if len(s) else U(0)
    return int(a.astype(np.int64)), int(U(b).astype(np.int64))


class Signatures:
    """List keys of a set, for a light-heavy boundary."""

    def __init__(self, boundary: int, rule: Rule = Rule()):
        self.boundary, self.rule = boundary, rule
        self.tops: list[int] = []

    def size_class(self, n: int) -> int:
        """Class of a heavy size; class i ends at tops[i], the largest size that its smallest may meet."""
        while not self.tops or self.tops[-1] < n:
            low = self.tops[-1] + 1 if self.tops else self.boundary + 1
            self.tops.append(low * self.rule.den // self.rule.num)
        return int(np.searchsorted(self.tops, n))

    def blocks(self, c: int) -> int:
        return self.rule.most_different(2 * self.tops[c]) + 1 + SLACK

    def subset_sizes(self, n: int) -> list[int]:
        _, num, den = self.rule
        return sorted({self.rule.least_common(m) for m in range(n, min(self.boundary, n * den // num) + 1)})

    def classes(self, n: int) -> range:
        low, high = max(n, self.boundary + 1), n * self.rule.den // self.rule.num
        return range(self.size_class(low), self.size_class(high) + 1) if low <= high else range(0)

    def cost(self, n: int) -> float:
        light = sum(math.comb(n, c) for c in self.subset_sizes(n)) if n <= self.boundary else 0
        return light + BLOCK_COST * sum(self.blocks(c) for c in self.classes(n))

    def keys(self, s: np.ndarray) -> np.ndarray:
        n, out = len(s), []
        if not n:
            return np.zeros(0, U)
        g = mixed(s, 21)
        if n <= self.boundary:
            total = g.sum(dtype=U)
            for c in self.subset_sizes(n):
                gone = np.array([sum(int(x) for x in left) % (1 << 64) for left in itertools.combinations(g.tolist(), n - c)], U)
                out.append(mixed(total - gone, 1000 + c))
        for c in self.classes(n):
            p = self.blocks(c)
            block = ((mixed(s, 31) >> U(32)) * U(p)) >> U(32)
            at = np.argsort(block, kind="stable")
            b = block[at]
            first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
            sums, there = np.add.reduceat(g[at], first), b[first]
            if p - len(there) > SLACK:
                there = np.concatenate([there, np.setdiff1d(np.arange(p, dtype=U), there)])
                sums = np.concatenate([sums, np.zeros(p - len(sums), U)])
            out.append(mixed(sums + mixed(there, 41), 100_000 + c))
        return np.unique(np.concatenate(out)) if out else np.zeros(0, U)


def boundary_by_cost(sizes: dict[int, int], rule: Rule = Rule()) -> int:
    """The cheapest boundary for so many sets of each size."""
    return min(BOUNDARIES, key=lambda x: (sum(n * Signatures(x, rule).cost(size) for size, n in sizes.items()), x))


def small_sizes(classes: DataFrame, rule: Rule) -> dict[int, int]:
    """How many classes have each small number of shingles; a row for each size at most."""
    top = max(BOUNDARIES) * rule.den // rule.num + 1
    return {r["n"]: r["count"] for r in classes.filter(F.col("n") <= top).groupBy("n").count().collect()}


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    if ends[-1] >= 1 << 31:
        raise ValueError("the lists of a slice have too many items for one array")
    flat = np.concatenate(arrays) if arrays else np.zeros(0, U)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.view(np.int64)))


def pack(s: np.ndarray) -> bytes:
    """The lower PACKED bytes of each hash."""
    return np.ascontiguousarray(s).view(np.uint8).reshape(-1, 8)[:, :PACKED].tobytes()


def unpack(raw: bytes | memoryview) -> np.ndarray:
    own = np.frombuffer(raw, np.uint8).reshape(-1, PACKED)
    out = np.zeros((len(own), 8), np.uint8)
    out[:, :PACKED] = own
    return out.reshape(-1).view(U)


def sets_of(docs: DataFrame, id_col: str, text_col: str, row_col: str | None, rule: Rule) -> DataFrame:
    """row, key (what the row bears in ``row_col``), doc_id, h (hash of the text), n, f1, f2 (fingerprint),
    prefix (packed); written, so that row numbers hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in bounded(batches, 4):
            sets = [shingles(t, known, rule.width) for t in batch.column(4).to_pylist()]
            prints = [fingerprint(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:4],
                    pa.array(map(len, sets), pa.int64()),
                    pa.array([a for a, _ in prints], pa.int64()),
                    pa.array([b for _, b in prints], pa.int64()),
                    pa.array([pack(s[: rule.prefix(len(s))]) for s in sets], pa.binary()),
                ],
                names=["row", "key", "doc_id", "h", "n", "f1", "f2", "prefix"],
            )

    key = F.col(row_col) if row_col else F.lit(None).cast("long")
    own = docs.select(F.monotonically_increasing_id().alias("row"), key.alias("key"), F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    kinds = ", ".join(f"{c} {own.schema[c].dataType.simpleString()}" for c in ("key", "doc_id"))
    return staged(own.mapInArrow(lean(run), f"row long, {kinds}, h long, n long, f1 long, f2 long, prefix binary"), "sets")


#: Rows with the same number but for so many bits are counted together.
RANGE = 15
#: Bytes of packed prefixes that are dealt out at once: more let more be known where it is.
SLICE_PACKED = 2 << 20


def deltas(rows: np.ndarray) -> bytes:
    """Ascending row numbers by their steps, which compress."""
    return np.diff(rows, prepend=np.int64(0)).tobytes()


def shared_counts(sets: DataFrame, rule: Rule) -> DataFrame:
    """(row, shared): how many shingles of a row's prefix another row's prefix has too; rows without one are left out.

    What one batch of rows holds twice is known at once, and goes on as one entry: a group gets an
    entry for each batch that holds a shingle, however common that is. Counts come back packed, by ranges of rows.
    """
    total = sets.agg(F.sum(F.expr(rule.sql("prefix")))).first()[0] or 0
    groups = int(total // COUNTED) + 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1, SLICE_PACKED):
            prefix = [unpack(x) for x in batch.column(1).to_pylist()]
            tokens = np.concatenate(prefix)
            rows = np.repeat(batch.column(0).to_numpy(), [len(x) for x in prefix])
            at = np.lexsort((rows, tokens))
            tokens, rows = tokens[at], rows[at]
            again = np.zeros(len(tokens) + 1, bool)
            again[1:-1] = tokens[1:] == tokens[:-1]
            several = again[1:] | again[:-1]
            known, counts = np.unique(rows[several], return_counts=True)
            common, single, owner = np.unique(tokens[several]), tokens[~several], rows[~several]
            group = single % U(groups)
            at = np.lexsort((single, owner, group))
            group, single, owner = group[at].astype(np.int64), single[at], owner[at]
            common = common[np.argsort(common % U(groups), kind="stable")]
            common_group = (common % U(groups)).astype(np.int64)
            used = np.union1d(group, common_group)
            out = []
            for g in used.tolist():
                a, b = np.searchsorted(group, [g, g + 1])
                c, d = np.searchsorted(common_group, [g, g + 1])
                first = g == used[0]
                out.append((g, pack(single[a:b]), deltas(owner[a:b]), pack(common[c:d]), deltas(known) if first else b"", counts.astype(np.int64).tobytes() if first else b""))
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["grp", "single", "owner", "common", "known", "counts"])

    def count(key: tuple, table: pa.Table) -> pa.Table:
        cells = {c: table.column(c).to_pylist() for c in ("single", "owner", "common", "known", "counts")}
        single, common = (np.concatenate([unpack(x) for x in cells[c]]) for c in ("single", "common"))
        owner = np.concatenate([np.cumsum(np.frombuffer(x, np.int64)) for x in cells["owner"]])
        distinct, where, n = np.unique(single, return_inverse=True, return_counts=True)
        there = (n > 1) | np.isin(distinct, common)
        rows, counts = np.unique(owner[there[where]], return_counts=True)
        rows = np.concatenate([rows, *(np.cumsum(np.frombuffer(x, np.int64)) for x in cells["known"])])
        counts = np.concatenate([counts, *(np.frombuffer(x, np.int64) for x in cells["counts"])])
        at = np.argsort(rows)
        rows, counts = rows[at], counts[at].astype(np.uint32)
        cut = np.flatnonzero(np.diff(rows >> RANGE)) + 1
        parts = list(zip(np.split(rows, cut), np.split(counts, cut), strict=True)) if len(rows) else []
        cols = [int(a[0] >> RANGE) for a, _ in parts], [deltas(a) for a, _ in parts], [b.tobytes() for _, b in parts]
        give_back()
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["rng", "row", "shared"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        first = key[0].as_py() << RANGE
        rows = np.concatenate([np.cumsum(np.frombuffer(x, np.int64)) for x in table.column("row").to_pylist()]) - first
        shared = np.bincount(rows, np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("shared").to_pylist()]), 1 << RANGE).astype(np.int64)
        there = np.flatnonzero(shared)
        return pa.table({"row": pa.array(there + first, pa.int64()), "shared": pa.array(shared[there], pa.int64())})

    dealt = sets.filter("n > 0").select("row", "prefix").mapInArrow(lean(deal), "grp long, single binary, owner binary, common binary, known binary, counts binary")
    found = dealt.groupBy("grp").applyInArrow(count, "rng long, row binary, shared binary")
    return found.groupBy("rng").applyInArrow(add, "row long, shared long")


def likely_classes(sets: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """The classes whose prefix doesn't show that they link with none."""
    counts = shared_counts(sets, rule).withColumnRenamed("row", "sid")
    few = F.coalesce("shared", F.lit(0)) < F.expr(rule.sql("least_shared"))
    return staged(classes.join(counts, "sid", "left").filter(~few).select("sid", "n", "f1", "f2", "h"), "likely")


def arrays_of(docs: DataFrame, text_col: str, wanted: DataFrame, boundary: int, rule: Rule) -> DataFrame:
    """(sid, n, items, short, long: sketches, keys) for the classes in ``wanted`` (sid, n, f1, f2, h), made again from their texts."""
    text, maybe = free_name(docs, "__text"), free_name(docs, "__maybe")
    texts = docs.select(F.col(text_col).alias(text)).filter(F.col(text).isNotNull())
    texts = marked(texts, F.xxhash64(text), marks(wanted.select("h"), FILTER_BITS, "wanted-bits"), FILTER_BITS, maybe).filter(F.col(maybe)).select(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own = Words(), Signatures(boundary, rule)
        for batch in bounded(batches, 0):
            out = {}
            for t in batch.column(0).to_pylist():
                s = shingles(t, known, rule.width)
                if len(s):
                    out[len(s), *fingerprint(s)] = s
            cols = [pa.array([k[i] for k in out], pa.int64()) for i in range(3)]
            sets = list(out.values())
            lists = [_lists(sets), *(_lists([sketch(s, x) for s in sets]) for x in SKETCH_BITS.values()), _lists([own.keys(s) for s in sets])]
            yield pa.RecordBatch.from_arrays([*cols, *lists], names=["n", "f1", "f2", "items", *SKETCH_BITS, "keys"])

    found = texts.mapInArrow(lean(run), "n long, f1 long, f2 long, items array<long>, short array<long>, long array<long>, keys array<long>")
    once = found.groupBy("n", "f1", "f2").agg(F.any_value(F.struct("items", *SKETCH_BITS, "keys")).alias("own"))
    return staged(once.join(wanted, ["n", "f1", "f2"]).select("sid", "n", "own.*"), "arrays")


def verified(pairs: DataFrame, arrays: DataFrame, rule: Rule) -> DataFrame:
    """The linked ones of ``pairs`` (a, b), by their whole sets; sizes and sketches leave out most others before sets are moved."""

    def side(x: str, *more: str) -> DataFrame:
        return arrays.select(F.col("sid").alias(x), *(F.col(c).alias(c + x) for c in more))

    near = pairs.select("a", "b")
    for own in SKETCH_BITS:
        near = near.join(side("a", "n", own), "a").join(side("b", "n", own), "b").filter(F.least("na", "nb") * rule.den >= F.greatest("na", "nb") * rule.num)
        apart = F.aggregate(F.zip_with(own + "a", own + "b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
        near = staged(near.filter(apart <= F.expr(f"(na + nb) * {rule.den - rule.num} div {rule.den + rule.num}")).select("a", "b"), "near-pairs")
    both = near.join(side("a", "n", "items"), "a").join(side("b", "n", "items"), "b")
    both = both.select("a", "b", "na", "nb", F.size(F.array_intersect("itemsa", "itemsb")).cast("long").alias("i"))
    return staged(both.filter((F.col("i") * rule.den) >= (F.col("na") + F.col("nb") - F.col("i")) * rule.num).select("a", "b"), "verified")


def ordered(arrays: DataFrame) -> DataFrame:
    """(sid, comp, n, token, place): the shingles of sets that lists of several components hold, with their place in the set.

    Shingles are ordered by how many of ``arrays`` hold them, then by value. Those that one set
    alone holds come first and need no list, so only shared ones are joined and ordered; a window
    never holds more than one set.
    """
    tokens = arrays.select("sid", "comp", "n", F.explode("items").alias("token"))
    held = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("held"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    shared = tokens.join(staged(held.filter("held > 1"), "shared-shingles"), "token")
    own = Window.partitionBy("sid")
    place = F.col("n") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("held", "token")) - 1
    return shared.select("sid", "comp", "n", "token", "low", "high", place.alias("place")).filter("low < high").drop("low", "high")


def open_pairs(arrays: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) of ``arrays`` (sid, comp, n, items) of different components that may link: inverted lists of prefixes.

    A list holds sets of one size band; a set looks for partners that aren't smaller, in its own
    band and those above that it may meet, with the prefix that the band asks for.
    """

    # ceil((both - most_different(both)) / 2) shingles must be shared, and be left from either place on.
    def need(x: str, y: str) -> str:
        return f"({x} + {y} - ({x} + {y}) * {rule.den - rule.num} div {rule.den + rule.num} + 1) div 2"

    band = lambda n: f"int(floor(ln({n}) / {math.log(BAND)!r}))"
    rows = ordered(arrays)
    rows = staged(rows.filter(f"place <= n - {rule.sql('least_common')}"), "prefixes")
    index = rows.select(F.expr(band("n")).alias("band"), "token", F.col("sid").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("nb"), F.col("place").alias("pb"))
    # A band's lowest size, less one in case that a logarithm is rounded.
    probe = rows.withColumn("band", F.explode(F.expr(f"sequence({band('n')}, {band(f'n * {rule.den} div {rule.num}')})")))
    probe = probe.withColumn("least", F.expr(f"greatest(n, bigint(floor(power({BAND}D, band))) - 1)")).filter(f"n - place >= {need('n', 'least')}")
    probe = probe.select("band", "token", F.col("sid").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("na"), F.col("place").alias("pa"))
    fits = f"na <= nb AND ca <> cb AND na - pa >= {need('na', 'nb')} AND nb - pb >= {need('na', 'nb')}"
    return probe.join(index, ["band", "token"]).filter(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def with_pivots(members: DataFrame) -> DataFrame:
    """``members`` (key, sid) with each list's pivot: the member that is in most lists, of several the smallest.

    The text that a group of near copies stems from is in nearly all its lists, so they share a
    pivot and each copy is checked against it once, not against another member for each list.
    """
    lists = members.groupBy("sid").agg(F.count(F.lit(1)).alias("lists"))
    best = F.max(F.struct("lists", (-F.col("sid")).alias("less"))).alias("best")
    pivots = members.join(lists, "sid").groupBy("key").agg(best).select("key", (-F.col("best.less")).alias("pivot"))
    return staged(members.join(staged(pivots, "pivots"), "key"), "members")


def linked_classes(docs: DataFrame, sets: DataFrame, classes: DataFrame, text_col: str, boundary: int | None, rule: Rule) -> DataFrame:
    """(node, root) of the classes that link with another."""
    likely = likely_classes(sets, classes, rule)
    arrays = arrays_of(docs, text_col, likely, boundary or boundary_by_cost(small_sizes(likely, rule), rule), rule)
    rows = arrays.select("sid", F.explode("keys").alias("key"))
    shared = staged(rows.groupBy("key").agg(F.min("sid").alias("low"), F.max("sid").alias("top")).filter("low < top").select("key"), "lists")
    members = with_pivots(staged(rows.join(shared, "key"), "listed-rows"))
    stars = members.filter("sid <> pivot").select(F.least("pivot", "sid").alias("a"), F.greatest("pivot", "sid").alias("b"))
    stars = staged(stars.distinct(), "stars")
    links = verified(stars, arrays, rule)
    roots = components(links)
    labelled = staged(members.join(roots.withColumnRenamed("node", "sid"), "sid", "left").select("key", "sid", F.coalesce("root", "sid").alias("comp")), "labelled")
    still = labelled.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y").select("key")
    left = staged(labelled.join(staged(still, "open-lists"), "key", "left_semi").select("sid", "comp").distinct(), "open")
    if left.isEmpty():
        return roots
    pairs = open_pairs(staged(arrays.join(left, "sid").select("sid", "comp", "n", "items"), "open-arrays"), rule)
    more = verified(staged(pairs.join(stars, ["a", "b"], "left_anti"), "open-pairs"), arrays, rule)
    return roots if more.isEmpty() else components(links.union(more))


def join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, boundary: int | None = None, width: int = WIDTH, threshold: float = NUM / DEN
) -> DataFrame:
    """A row per document: row, doc_id, n_shingles, component_id, first_row, key.

    component_id is the smallest id of the component, first_row the row that bears it (of
    repeated rows the first), key what the row bears in ``row_col``. ``boundary`` is found by cost unless given. Shingles have ``width``
    words; a Jaccard similarity of ``threshold`` on links.
    """
    rule = Rule.of(width, threshold)
    with_small_batches(docs.sparkSession)
    sets = sets_of(docs, id_col, text_col, row_col, rule)
    low = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("low")
    classes = staged(sets.filter("n > 0").groupBy("n", "f1", "f2").agg(F.min("row").alias("sid"), F.min_by("h", "row").alias("h"), low), "classes")
    with Scratch(docs.sparkSession) as scratch:
        roots = scratch.keep(linked_classes(docs, sets, classes, text_col, boundary, rule), "roots")
    rooted = staged(classes.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid")), "rooted")
    lowest = staged(rooted.groupBy("root").agg(F.min("low").alias("first")), "lowest")
    found = staged(rooted.join(lowest, "root").select("n", "f1", "f2", F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("first_row")), "found")
    own = sets.select("row", "key", "doc_id", "n", "f1", "f2").join(found, ["n", "f1", "f2"], "left")
    return own.select(
        "row",
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("first_row", "row").alias("first_row"),
        "key",
    )


def representative_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: float = NUM / DEN) -> DataFrame:
    """One row of ``docs`` of each component, the one with the smallest id, with its columns."""
    own, row = numbered(docs)
    return without_rows(own, row, join(own, id_col, text_col, row, width=width, threshold=threshold).filter("row <> first_row").select("key")).select(*(F.col(f"`{c}`") for c in docs.columns))
