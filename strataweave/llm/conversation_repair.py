"""Repair of conversation structure by dynamic programming over a prefix trie of signatures.

A repaired conversation has role initials ``(s?(ua)+)?``. Edits: Keep (0), Rerole to user or assistant
(1), Delete (2; blank and duplicate rows must go), Insert an empty row of user or assistant anywhere (5); a
truncated row that stays costs 5 more. The audit is the initials of the cheapest edits in order, of equally
cheap ones the least.

What edits cost depends on the signature alone: a letter for each row, which says its role and first fault. So
conversations are sorted by signature and dealt out by ranges of it; a task walks the prefix trie of
its signatures depth first and keeps the layers of the present path, so a prefix that several share is
computed once, and equal signatures get one answer. A layer has, for each state of the grammar, the least
cost above the layer's minimum and the rank of its audit; layers are interned, which makes the next one a lookup.
Ranks suffice to compare audits: all of a layer hold as many letters other than I and end in one, so none begins another.

Rows get their places by a sort over ids and digests, dealt out by ranges, so a conversation with a third of all
rows is spread; copies are found by an aggregate and flagged by place. Signatures grow from pieces of
SEGMENT rows to a byte for each row, as long as the audit that is asked for. Texts are shuffled once, sorted, and streamed
through the edits; no conversation's texts are held, but its digest is one sequential hash, so one task makes it.

Defined results for odd input: rows of one turn go by role, then digest of the text; a null id is a conversation
of its own, a null turn comes first, null role and text are one space; a role with another initial (or none) can't be kept;
repeated rows are duplicates; an id without rows has zeros, an empty audit and the digest of nothing;
an empty table gives an empty result; further columns are ignored, whatever their names; texts and conversations of any length are whole.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.llm.ranking import ranked
from strataweave.llm.shared import bounded, lean, with_small_batches

#: Rows of a signature's piece, collected by one group of the first aggregation.
SEGMENT = 4096
BLANKS = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Roles by initial and faults, in the order of their codes; a letter's code is 4 * fault + role.
ROLES, FAULTS = "sua", ("none", "truncated", "blank", "duplicate")
#: States of the grammar: nothing yet, after system, after user, after assistant. Where a role leads from each.
START, SYSTEM, USER, ASSISTANT = range(4)
LEADS = ((SYSTEM, None, None, None), (USER, USER, None, USER), (None, None, ASSISTANT, None), (None,) * 4)
#: Where an inserted row leads, which is also where a rerole leads.
NEXT = (USER, USER, ASSISTANT, USER)
LEGAL = ("su", "ua", "au")
NAMES = {USER: b"user", ASSISTANT: b"assistant"}

#: (state, cost above the least, rank of the audit) of the states that a layer reaches.
Layer = tuple[tuple[int, int, int], ...]


class Layers:
    """The layers met so far, by number, and what a letter makes of each."""

    def __init__(self):
        self.known: list[Layer] = [((START, 0, 0),)]
        self.number = {self.known[0]: 0}
        self.steps: dict[tuple[int, str], tuple[int, int, dict[int, tuple[int, str]]]] = {}

    def step(self, at: int, letter: str) -> tuple[int, int, dict[int, tuple[int, str]]]:
        """Number of the next layer, what its minimum is above this one's, and where each state came from by which edits."""
        if (at, letter) not in self.steps:
            fault, role = divmod(ord(letter) - ord("a"), 4)
            best: dict[int, tuple[int, int, str, int]] = {}
            for state, cost, rank in self.known[at]:
                for k, now in enumerate((state, NEXT[state], NEXT[NEXT[state]])):
                    for target, more, edit in self.edits(now, role, fault):
                        way = (cost + k * INSERT + more, rank, "I" * k + edit, state)
                        if target not in best or way < best[target]:
                            best[target] = way
            least = min(w[0] for w in best.values())
            order = sorted(best, key=lambda s: best[s][1:3])
            layer = tuple((s, best[s][0] - least, order.index(s)) for s in sorted(best))
            if layer not in self.number:
                self.number[layer] = len(self.known)
                self.known.append(layer)
            self.steps[at, letter] = self.number[layer], least, {s: (w[3], w[2]) for s, w in best.items()}
        return self.steps[at, letter]

    @staticmethod
    def edits(state: int, role: int, fault: int) -> Iterator[tuple[int, int, str]]:
        yield state, DELETE, "D"
        if fault < 2:
            more = TRUNCATED * (fault == 1)
            yield NEXT[state], REROLE + more, "R"
            if LEADS[role][state] is not None:
                yield LEADS[role][state], more, "K"

    def end(self, at: int) -> tuple[int, str, int]:
        """The least cost above the layer's minimum to a whole conversation, the rows to insert, and the state they follow."""
        ways = [(cost + k * INSERT, rank, "I" * k, state) for state, cost, rank in self.known[at] for k, now in enumerate((state, NEXT[state], NEXT[NEXT[state]])) if now in (START, ASSISTANT)]
        cost, _, tail, state = min(ways)
        return cost, tail, state


def shared_prefix(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Trie:
    """Depth-first walk over signatures that come in order; keeps the layers of the present path."""

    def __init__(self):
        self.layers, self.path, self.cost, self.last, self.found = Layers(), array("l", [0]), array("q", [0]), "", (0, "")

    def answer(self, signature: str) -> tuple[int, str]:
        """Least cost and audit."""
        if signature == self.last:
            return self.found
        at = shared_prefix(self.last, signature)
        del self.path[at + 1 :], self.cost[at + 1 :]
        for letter in signature[at:]:
            number, more, _ = self.layers.step(self.path[-1], letter)
            self.path.append(number)
            self.cost.append(self.cost[-1] + more)
        more, tail, state = self.layers.end(self.path[-1])
        edits = [tail]
        for k in range(len(signature), 0, -1):
            state, edit = self.layers.step(self.path[k - 1], signature[k - 1])[2][state]
            edits.append(edit)
        self.last, self.found = signature, (self.cost[-1] + more, "".join(reversed(edits)))
        return self.found


def counts(signature: str) -> tuple[int, int, int, int]:
    """Rows that are blank, duplicate, truncated, and neighbours whose roles may not follow one another."""
    codes = [ord(c) - ord("a") for c in set(signature)]
    by_fault = [sum(signature.count(chr(ord("a") + c)) for c in codes if c // 4 == f) for f in range(4)]
    roles = signature.translate({ord("a") + c: (ROLES + "o")[c % 4] for c in codes})
    return by_fault[2], by_fault[3], by_fault[1], max(len(roles) - 1, 0) - sum(roles.count(p) for p in LEGAL)


def checksum(conv_id: Column, turn: Column) -> Column:
    one = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    return F.crc32(F.concat(one(conv_id), F.lit(":"), one(turn)).cast("binary"))


def damaged(convs: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with planted faults: of twenty checksums of id and turn each of five drops, empties, cuts the
    end marks of, repeats or makes the user's a row."""
    what = (checksum(F.col("conv_id"), F.col("turn")) % 20).alias("what")
    rows = convs.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), what).filter("what <> 0")
    role = F.when(F.col("what") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    again = F.explode(F.when(F.col("what") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), again.alias("again")).drop("again")


def rows_of(convs: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without nulls, and the digest by which rows of one turn and role go."""
    full = convs.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    return full.withColumn("digest", F.unhex(F.sha2("text", 256)))


def signatures(convs: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, signature) of each conversation; ``ids`` (conv_id) adds those without rows."""
    rows = rows_of(convs)
    said = F.rtrim("text", F.lit(BLANKS))
    facts = rows.select("conv_id", "turn", "role", "digest", (said == "").alias("blank"), F.substring(said, -1, 1).isin(".", "!", "?").alias("ended"))
    own = ranked(facts, [F.col(c) for c in ("conv_id", "turn", "role", "digest")], "at")
    firsts = own.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("first")).select("first")
    fault = F.when(F.col("blank"), 2).when(F.col("first").isNull(), 3).when(F.col("ended"), 0).otherwise(1)
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    letters = own.join(firsts, F.col("at") == F.col("first"), "left").select("conv_id", "at", F.char(97 + 4 * fault + role).alias("letter"))
    joined = lambda piece, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(piece).isNotNull(), F.struct(by, piece)))), lambda x: x[piece]), "")
    pieces = letters.groupBy("conv_id", F.expr(f"at div {SEGMENT}").alias("part")).agg(joined("letter", "at").alias("piece"))
    turns = own.select("conv_id", "turn").distinct().groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).cast("long").alias("gaps"))
    every = (convs if ids is None else ids).select("conv_id").distinct()
    known = pieces.unionByName(turns, allowMissingColumns=True).unionByName(every, allowMissingColumns=True)
    return known.groupBy("conv_id").agg(F.coalesce(F.max("gaps"), F.lit(0)).alias("gaps"), joined("piece", "part").alias("signature"))


COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")


def diagnosed(convs: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation."""
    with_small_batches(convs.sparkSession)
    own = signatures(convs, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for batch in bounded(batches, 2):
            found = [(*counts(s), *trie.answer(s)) for s in batch.column(2).to_pylist()]
            numbers = [pa.array([f[k] for f in found], pa.int64()) for k in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *numbers, pa.array([f[-1] for f in found], pa.string())], names=["conv_id", "gaps", *COUNTS, "audit"])

    dealt = own.repartitionByRange("signature", "conv_id").sortWithinPartitions("signature", "conv_id")
    kind = own.schema["conv_id"].dataType.simpleString()
    return dealt.mapInArrow(lean(run), f"conv_id {kind}, gaps long, {', '.join(f'{c} long' for c in COUNTS)}, audit string")


class Replay:
    """The repaired rows of one conversation, as its rows come in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def inserted(self) -> Iterator[tuple[bytes, bytes, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.state = NEXT[self.state]
            yield NAMES[self.state], b"", "I"

    def row(self, role: bytes, text: bytes) -> Iterator[tuple[bytes, bytes, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = LEADS[ROLES.index(chr(role[0]))][self.state]
            yield role, text, edit
        elif edit == "R":
            self.state = NEXT[self.state]
            yield NAMES[self.state], text, edit


def replayed(convs: DataFrame, told: DataFrame) -> tuple[DataFrame, list[str]]:
    """What tasks stream: of each conversation its row of ``told`` and then its rows, in order; and the names of ``told``."""
    names = [c for c in told.columns if c != "conv_id"]
    answers = told.select("conv_id", F.struct(*names).alias("told"), F.lit(None).cast("long").alias("turn"), *(F.lit(None).cast("binary").alias(c) for c in ("role", "text", "digest")))
    rows = rows_of(convs).select("conv_id", F.lit(None).cast(answers.schema["told"].dataType).alias("told"), "turn", F.col("role").cast("binary").alias("role"), F.col("text").cast("binary").alias("text"), "digest")
    both = answers.unionByName(rows).repartition("conv_id")
    ordered = both.sortWithinPartitions("conv_id", F.col("told").isNull(), "turn", "role", "digest")
    return ordered.select("conv_id", "told", "role", "text"), names


def repaired(convs: DataFrame, told: DataFrame) -> DataFrame:
    """(conv_id, position, role, text, edit): the rows of the repaired conversations; ``told`` is what ``diagnosed`` returns."""
    ordered, _ = replayed(with_small_batches(convs.sparkSession) and convs, told.select("conv_id", "audit"))
    kind = ordered.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, now, position = None, None, 0

        def out(rows: list) -> Iterator[pa.RecordBatch]:
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["conv_id", "position", "role", "text", "edit"])

        for batch in bounded(batches, 3):
            types = [batch.schema.field(0).type, pa.int64(), pa.binary(), pa.binary(), pa.string()]
            made = []

            def add(rows: Iterator) -> None:
                nonlocal position
                for r in rows:
                    made.append((conv, position, *r))  # noqa: B023  (used before the next batch)
                    position += 1

            for c, told_, role, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if told_ is not None:
                    if now:
                        add(now.inserted())
                    conv, now, position = c, Replay(told_["audit"]), 0
                else:
                    add(now.row(role, text))
            yield from out(made)
        if now:
            made = [(conv, position + k, *r) for k, r in enumerate(now.inserted())]
            yield from out(made)

    rows = ordered.mapInArrow(lean(run), f"conv_id {kind}, position long, role binary, text binary, edit string")
    return rows.withColumns({c: F.col(c).cast("string") for c in ("role", "text")})


def repair(convs: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """A row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, and
    repaired_sha256, the digest of its repaired ``role:text`` rows joined by newlines."""
    ordered, names = replayed(convs, diagnosed(convs, ids))
    kinds = ordered.schema
    kind = kinds["conv_id"].dataType.simpleString()
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds["told"].dataType.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, told, now, digest, first = None, None, None, None, True

        def add(rows: Iterator) -> None:
            nonlocal first
            for role, text, _ in rows:
                digest.update(role if first else b"\n" + role)
                digest.update(b":")
                digest.update(text)
                first = False

        def done() -> list:
            add(now.inserted())
            return [(conv, *(told[n] for n in names), digest.hexdigest())]

        def out(rows: list) -> Iterator[pa.RecordBatch]:
            if rows:
                types = [conv_type, *(pa.string() if n == "audit" else pa.int64() for n in names), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["conv_id", *names, "repaired_sha256"])

        for batch in bounded(batches, 3):
            conv_type, made = batch.schema.field(0).type, []
            for c, told_, role, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if told_ is not None:
                    made += done() if now else []
                    conv, told, now, digest, first = c, told_, Replay(told_["audit"]), hashlib.sha256(), True
                else:
                    add(now.row(role, text))
            yield from out(made)
        if now:
            yield from out(done())

    return ordered.mapInArrow(lean(run), f"conv_id {kind}, {fields}, repaired_sha256 string")
