"""Personal data: base formats, and candidates that boosted trees select.

Base spans (email, ip, card, phone) follow fixed formats and always stay. Beside them,
high-recall generators propose further, possibly overlapping spans: disguised addresses
(``name [at] host [dot] net``, ``name at host dot net``), phone and card numbers in odd groups, without
a plus or beside other numbers, IPv6 addresses, and secrets (what is assigned to a password, token or key, and
long words of letters and digits). Boosted trees score each by its format, the words around it and the
base spans near it; a span is taken, best first, where its calibrated probability reaches its kind's
threshold and it meets no span taken before.

The trees are fitted on examples made here, EXAMPLES of them, from a fixed seed; a threshold is the
least with PRECISION on the third that calibrates. No corpus text is learned from.

All scans are linear in the length of the text, and go to the true ends of what they find; of spans that
are sorted by place, a search finds those that meet. Positions are code points, ends exclusive.

Defined results for odd input: a null text is empty and has no spans; repeated rows are
treated alike; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.llm.boosting import BoostedTrees
from strataweave.llm.shared import bounded, lean, with_small_batches

KINDS = ("email", "ip", "card", "phone")
#: Kinds of spans in the order in which they are written; secrets are added spans only.
ALL_KINDS = (*KINDS, "secret")
EXAMPLES, SEED, PRECISION = 18000, 7, 0.995
#: Characters read before and after a candidate; of a word that may be a key without a sign of it.
CONTEXT, LONG = 32, 16

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Runs that can hold an ip, a card or a phone number without a plus.
DIGIT_RUN = re.compile(r"[0-9][0-9 .()\-]{6,}")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Generators of further candidates.
AT_SIGN = re.compile(r" ?[\[({<] ?(?:at|AT|@) ?[\])}>] ?| at (?=[A-Za-z0-9-]++(?: dot [A-Za-z0-9-]++)+)| AT (?=[A-Za-z0-9-]++(?: DOT [A-Za-z0-9-]++)+)")
AFTER_AT = re.compile(r"[A-Za-z0-9-]++(?: ?(?:[\[({<] ?(?:dot|DOT|\.) ?[\])}>]|\.) ?[A-Za-z0-9-]++| dot [A-Za-z0-9-]++| DOT [A-Za-z0-9-]++)++")
#: A dot in words before the sign for at; the part before it belongs to the address.
DOT_BEFORE = re.compile(r" (?:dot|DOT) \Z| ?[\[({<] ?(?:dot|DOT|\.) ?[\])}>] ?\Z")
GROUP = re.compile(r"[0-9]+")
IP_APART = re.compile(r"(?<![0-9.])[0-9]{1,3}+(?: ?[\[({] ?(?:\.|dot|DOT) ?[\])}] ?[0-9]{1,3}+){3}(?![0-9])")
IP6 = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]*+:[0-9A-Fa-f:]++(?![0-9A-Za-z])")
ASSIGNED = re.compile(r"(?i:pass(?:word|wd|phrase)?|pwd|secret|token|credential|(?:api|access|auth|private)[_ -]?key)s?[\"']?\s?(?:[:=]|is\s|was\s)\s?[\"']?([^\s\"'<>]{6,}+)")
#: Long words of keys; parts that stand between dots belong together where more than one looks like a key.
KEY = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]++(?:\.[A-Za-z0-9_+/=-]++)*+")

CUES = {
    "email": ("mail", "contact", "write", "reach", "courriel", "correo"),
    "ip": ("ip", "host", "server", "address", "from", "ping", "adresse"),
    "card": ("card", "visa", "credit", "carte", "tarjeta", "karte", "pay"),
    "phone": ("tel", "phone", "call", "fax", "mobile", "fon", "ring"),
    "secret": ("password", "passwd", "pwd", "token", "secret", "key", "credential", "credentials", "auth", "bearer", "login"),
    "other": ("order", "invoice", "version", "isbn", "date", "page", "id", "ref", "no", "build", "total", "time", "mac", "line", "commit", "sha", "hash", "digest", "checksum", "uuid", "file", "http", "https", "www"),
}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    out, at, free = [], 0, 0
    while (at := text.find("@", at)) >= 0:
        s = at
        while s > free and text[s - 1] in LOCAL:
            s -= 1
        m = DOMAIN.match(text, at + 1) if s < at else None
        if m:
            out.append((s, m.end()))
            at = free = m.end()
        else:
            at += 1
    return out


def base_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    out = [(s, e, "email") for s, e in emails(text)]
    for s, e in runs:
        for m in IP.finditer(text, s, e):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((*m.span(), "ip"))
        for m in CARD.finditer(text, s, e):
            d = digits_of(m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((*m.span(), "card"))
    if "+" in text:
        out += [(*m.span(), "phone") for m in PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def candidates(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    out = set()
    for m in AT_SIGN.finditer(text):
        s = m.start()
        while s and text[s - 1] in LOCAL:
            s -= 1
        while s and (dot := DOT_BEFORE.search(text, max(0, s - 8), s)) and dot.start() and text[dot.start() - 1] in LOCAL:
            s = dot.start()
            while s and text[s - 1] in LOCAL:
                s -= 1
        right = AFTER_AT.match(text, m.end())
        if right and s < m.start():
            out.add((s, right.end(), "email"))
    for begin, end in runs:
        groups = [m.span() for m in GROUP.finditer(text, begin, end)]
        for i, (s, _) in enumerate(groups):
            total, before = 0, text[s - 1 : s]
            first = s - (before in ("(", "+"))
            first -= first < s and before == "(" and text[first - 1 : first] == "+"
            for a, e in groups[i : i + 19]:  # a group has a digit at least, a number 19 at most
                if a > s and a - last > 3:
                    break
                total, last = total + e - a, e
                if total > 19:
                    break
                if 7 <= total <= 15:
                    out.add((first, e, "phone"))
                if total >= 12:
                    out.add((s, e, "card"))
    if ":" in text:
        for m in IP6.finditer(text):
            parts = m[0].split(":")
            if len(parts) > 2 and max(map(len, parts)) <= 4 and len(parts) <= 9:
                out.add((*m.span(), "ip"))
    out |= {(*m.span(), "ip") for m in IP_APART.finditer(text)}
    out |= {(*m.span(1), "secret") for m in ASSIGNED.finditer(text)}
    for m in KEY.finditer(text):
        if m.end() - m.start() < LONG:
            continue
        parts, at = [], m.start()
        for own in m[0].split("."):
            parts.append((at, at + len(own), own))
            at += len(own) + 1
        alike = [x for x in parts if len(x[2]) >= 10 and mixed_word(x[2])]
        if len(alike) > 1:
            out.add((alike[0][0], m.end(), "secret"))
        else:
            out |= {(s, e, "secret") for s, e, own in parts if e - s >= LONG and mixed_word(own)}
    return sorted(out)


def mixed_word(own: str) -> bool:
    return any("0" <= c <= "9" for c in own) and any(c.isalpha() for c in own)


def entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def near_spans(base: list[tuple[int, int]], s: int, e: int) -> tuple[int, int]:
    """How many of the sorted spans begin or end within CONTEXT before and after."""
    at = bisect_left(base, (s, e))
    return sum(y > s - CONTEXT for _, y in base[max(0, at - 3) : at]), sum(x < e + CONTEXT for x, _ in base[at : at + 3])


def features(text: str, s: int, e: int, kind: str, base: list[tuple[int, int]] = ()) -> list[float]:
    own, before, after = text[s:e], text[max(0, s - CONTEXT) : s].lower(), text[e : e + CONTEXT].lower()
    near = set(re.findall(r"[a-z]+", before)[-4:])
    d = digits_of(own)
    groups = [len(g) for g in GROUP.findall(own)] or [0]
    left, right = text[s - 1 : s] if s else "", text[e : e + 1]
    size = len(own)
    upper, lower = sum("A" <= c <= "Z" for c in own), sum("a" <= c <= "z" for c in own)
    parts = [len(x) for x in own.split(":")] if kind == "ip" else [0]
    return [
        *(kind == k for k in ALL_KINDS),
        size, len(d), len(groups), min(groups), max(groups), groups[-1], groups[0],
        own.count(" "), own.count("-"), own.count("."), own.count(":"), own.count("("), own.count("::"),
        len(parts), max(parts), own.startswith("+"), own.startswith("(") or own.startswith("+("),
        bool(d) and luhn(d), len(set(d)), d[:1] == "0",
        len(own.rsplit(".", 1)[-1].rsplit(" ", 1)[-1].strip(" ])}>")) if kind == "email" else 0, " at " in own, own.count("dot") + own.count("DOT"),
        left.isalnum() or left in ("-", ".", "/", "_", "#", "$", ":", "+"), right.isalnum() or right in ("-", "/", "_", "%", ":"),
        before.rstrip()[-1:].isdigit(), after.lstrip()[:1].isdigit(), left in ("=", '"', "'"), before.rstrip(" \"'")[-1:] in ("=", ":"),
        *(any(w in near for w in CUES[k]) for k in CUES),
        any(w in after for w in ("ext", "mobile", "office")),
        all(g == 4 for g in groups[:-1]), len({c for c in own if not c.isalnum()}),
        entropy(own) if kind == "secret" else 0, len(d) / size, upper / size, lower / size, upper > 0 and lower > 0,
        kind == "secret" and all(c in "0123456789abcdef" for c in own), own[:4].isalpha() and own[:4].isupper() and not lower, "/" in own or "_" in own,
        *near_spans(base, s, e),
    ]


def examples(n: int = EXAMPLES, seed: int = SEED) -> list[tuple[str, int, int, str, bool, list]]:
    """Made-up sentences with a candidate, whether it is personal data, and the base spans beside it."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghijklmnoprstu") for _ in range(r.randint(2, 9)))

    def card() -> str:
        body = r.choice("3456") + digits(r.choice([13, 14]))
        return next(body + c for c in "0123456789" if luhn(body + c))

    def grouped(d: str, sep: str) -> str:
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))

    pick = lambda k, chars: "".join(r.choice(chars) for _ in range(k))
    hexa, capitals, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def example() -> tuple[str, str, str, str, str, bool]:
        """kind, text before the candidate, candidate, text after, word that leads, whether it counts."""
        x = r.randrange(30)
        at = r.choice(["[at]", "(at)", " [at] ", " (AT) ", "<at>", " at "])
        dot = r.choice(["[dot]", "(dot)", ".", " [dot] ", "."]) if at != " at " else " dot "
        if x < 3:
            return "email", "", f"{word()}{r.choice(['', '.', '_'])}{word()}{at}{word()}{dot}{r.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'io'])}", "", r.choice(CUES["email"]), True
        if x == 3:
            return "email", "", f"{word()} (at) {word()}. {word()}", "", word(), False
        phone = r.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(3)} {digits(4)}"])
        if x < 7:
            a, b = r.choice(["-", ".", " "]), r.choice(["-", ".", " "])
            form = r.choice([phone, f"({digits(3)}) {digits(3)}{a}{digits(4)}", f"0{digits(3)}{a}{digits(3)}{b}{digits(4)}", f"{digits(3)}{a}{digits(3)}{a}{digits(4)}", f"0{digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}", f"00 {digits(2)} {digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}", " ".join("0" + digits(9))])
            cut = max(form.rfind(c) for c in " -.") if r.random() < 0.15 and not form.startswith(("+", "(")) else 0
            if cut > 0:  # a part of a number isn't one
                return "phone", "", form[:cut], form[cut:], r.choice(CUES["phone"]), False
            return "phone", "", form, "", r.choice(CUES["phone"]), True
        if x == 7:
            return "phone", "", r.choice([f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}.{digits(2)}.{digits(4)}", f"{digits(3)}-{digits(2)}-{digits(5)}", f"{digits(3)}.{digits(3)}.{digits(3)}"]), "", r.choice(CUES["other"]), False
        if x == 8:
            return "phone", "", r.choice([f"{digits(3)} {digits(4)}", f"{digits(5)} {digits(5)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(2)}.{digits(2)}.{digits(2)}.{digits(3)}", digits(9), digits(12)]), "", r.choice([word(), *CUES["other"]]), False
        if x < 11:
            sep = r.choice([".", "  ", " - ", "-"])
            form = grouped(card(), sep)
            if r.random() < 0.2:  # nor is a part of a card number
                cut = form.rfind(sep)
                return r.choice(["phone", "card"]), "", form[:cut], form[cut:], r.choice(CUES["card"]), False
            return "card", "", form, "", r.choice(CUES["card"]), True
        if x == 11:
            return "card", "", grouped(digits(r.choice([12, 14, 15, 16])), r.choice([".", "  ", "-", " "])), "", r.choice([word(), *CUES["other"]]), False
        if x == 12:  # a phone and a card number side by side: each counts, what takes parts of both doesn't
            full, other = phone, card()
            last = full[-4:]
            return r.choice([("phone", "", full, f" {other}", word(), True), ("card", f"{full} ", other, "", word(), True), ("phone", full[:-4], f"{last} {other[:6]}", other[6:], word(), False), ("phone", f"{full} ", other[:15], other[15:], word(), False)])
        if x < 15:
            return "ip", "", r.choice([":".join(f"{r.randrange(1, 65536):x}" for _ in range(8)), f"fe80::{r.randrange(65536):x}:{r.randrange(65536):x}:{r.randrange(65536):x}", f"2001:{r.randrange(65536):x}:{r.randrange(65536):x}::{r.randrange(65536):x}"]), "", r.choice(CUES["ip"]), True
        if x == 15:
            return "ip", "", r.choice([f"{digits(2)}:{digits(2)}:{digits(2)}", ":".join(f"{r.randrange(256):02x}" for _ in range(6)), f"{digits(1)}:{digits(2)}:{digits(2)}:{digits(2)}"]), "", r.choice(["time", "mac", "at", "line", word()]), False
        if x < 18:
            quote = r.choice(["", '"', "'"])
            value = r.choice([pick(r.randint(8, 40), hexa), pick(r.randint(8, 40), mixed), pick(r.randint(10, 24), mixed + "!%&*?")])
            return "secret", f"{r.choice(['password', 'token', 'secret', 'api_key', 'passwd', 'pwd', 'access_key', 'auth_key'])}{r.choice(['=', ' = ', ': '])}{quote}", value, quote, word(), True
        if x < 20:
            return "secret", "", r.choice(["AKIA", "ASIA"]) + pick(16, capitals) if r.random() < 0.5 else r.choice(["sk_live_", "ghp_", "xoxb-", "glpat-"]) + pick(r.randint(20, 36), mixed), "", r.choice([word(), "key", "token", "with"]), True
        if x < 26:  # what an author of a text hides or writes out otherwise
            host = f"{word()} dot {r.choice(['com', 'org', 'net', 'de', 'io'])}"
            told = f"{word()} dot {word()} at {host}" if r.random() < 0.5 else f"{word()} at {host}"
            return r.choice([
                ("email", "", told.upper() if r.random() < 0.4 else told, "", r.choice([word(), *CUES["email"]]), True),
                ("ip", "", r.choice(["[.]", "(.)", "[dot]"]).join(str(r.randrange(256)) for _ in range(4)), "", r.choice([word(), *CUES["ip"]]), True),
                ("secret", f"{r.choice(['password', 'passwd', 'pwd', 'passphrase'])}{r.choice([': ', '=', ' = ', ' is '])}", word() + digits(r.randint(1, 4)), "", word(), True),
                ("secret", r.choice(["bearer ", "token ", "authorization: bearer ", ""]), f"eyJ{pick(r.randint(12, 30), mixed)}.{pick(r.randint(16, 60), mixed)}.{pick(r.randint(16, 43), mixed + '-_')}", "", r.choice([word(), "token", "auth"]), True),
            ])
        if x < 28:  # identifiers that hold long numbers or look like keys
            uuid = [pick(k, hexa) for k in (8, 4, 4)] + [r.choice("abcdef") + digits(3), digits(12)]
            iban = f"{r.choice(['DE', 'FR', 'ES', 'GB', 'NL'])}{digits(2)}{r.choice(['', pick(4, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')])}{digits(r.randint(14, 18))}"
            return r.choice([
                ("phone", "-".join(uuid[:3]) + "-" + uuid[3][0], f"{uuid[3][1:]}-{uuid[4]}", "", word(), False),
                ("phone", "-".join(uuid[:4]) + "-", uuid[4], "", word(), False),
                ("secret", "", iban, "", r.choice(["iban", "account", "konto", word()]), False),
                ("secret", "", f"{word()}.{word()}{digits(2)}.{word()}/{word()}{digits(3)}/{word()}.html", "", r.choice([word(), "see", "http"]), False),
                ("secret", f"{r.choice(['password', 'token', 'secret', 'key'])} is ", r.choice([word() + "ing", f"{word()}ed.", f"{word()}{word()},"]), "", word(), False),
            ])
        if x < 29:
            path = "/".join(word() for _ in range(4))
            value = r.choice([pick(40, hexa), pick(64, hexa), "-".join(pick(k, hexa) for k in (8, 4, 4, 4, 12)), f"{path}/{digits(2)}", f"{word()}-{word()}-{word()}-{digits(3)}", f"{word()}_{word()}_{word()}{digits(2)}", "=" * 16 + digits(1) + word()])
            return "secret", "", value, "", r.choice(["commit", "sha", "hash", "digest", "checksum", "uuid", "file", "see", "id"]), False
        return "secret", f"{r.choice(['token', 'secret', 'password'])}{r.choice([': ', ' = '])}", r.choice([word() + "ing", f"{word()},", f"{word()}{word()}."]), "", word(), False

    out = []
    for _ in range(n):
        kind, lead, own, rest, cue, yes = example()
        if r.random() < 0.25 and not (kind == "secret" and not lead and not yes):
            cue = word()
        left = f"{word()} {word()} {cue}{r.choice([': ', ' ', ' is ', ' = '] if kind != 'secret' else [' '])}" if r.random() < 0.95 else ""
        left += lead
        text = f"{left}{own}{rest}{r.choice([' ', '. ', ', ', '']) if not rest else ' '}{word()} {word()}"
        base = [(a, b) for a, b, _ in base_spans(text, [m.span() for m in DIGIT_RUN.finditer(text)]) if b <= len(left) or a >= len(left) + len(own)]
        out.append((text, len(left), len(left) + len(own), kind, yes, base))
    return out


class Selector:
    """The fitted trees and the thresholds by kind."""

    def __init__(self, trees: BoostedTrees, thresholds: dict[str, float]):
        self.trees, self.thresholds = trees, thresholds

    def probabilities(self, rows: list[list[float]]) -> np.ndarray:
        return self.trees.probability(np.array(rows, float).reshape(len(rows), -1)) if rows else np.zeros(0)


@functools.cache
def selector() -> Selector:
    rows = examples()
    x = np.array([features(*row[:4], row[5]) for row in rows], float)
    y = np.array([row[4] for row in rows], float)
    held = np.arange(len(y)) % 3 == 2
    trees = BoostedTrees(trees=90).fit(x[~held], y[~held]).calibrate(x[held], y[held])
    p, kinds, thresholds = trees.probability(x[held]), [row[3] for row, h in zip(rows, held, strict=True) if h], {}
    for kind in ALL_KINDS:
        own = sorted(((a, b) for a, b, k in zip(p, y[held], kinds, strict=True) if k == kind), reverse=True)
        good, thresholds[kind] = 0, 1.0
        for n, (a, b) in enumerate(own, 1):
            good += b
            if good / n >= PRECISION:
                thresholds[kind] = float(a)
        thresholds[kind] = max(thresholds[kind], 0.5)
    return Selector(trees, thresholds)


def meets(spans: list[tuple[int, int]], s: int, e: int) -> bool:
    """Whether one of the sorted spans, of which none meet, meets s..e."""
    at = bisect_left(spans, (e,))
    return at > 0 and spans[at - 1][1] > s


def spans_of(texts: list[str | None], own: Selector) -> list[tuple[list, list]]:
    """Base spans and added spans of each text, (start, end, kind), in order."""
    found, rows, where, taken = [], [], [], []
    for k, t in enumerate(texts):
        t = t or ""
        runs = [m.span() for m in DIGIT_RUN.finditer(t)]
        base = base_spans(t, runs)
        found.append((base, []))
        joined: list[tuple[int, int]] = []
        for s, e, _ in base:
            if joined and s < joined[-1][1]:
                joined[-1] = joined[-1][0], max(joined[-1][1], e)
            else:
                joined.append((s, e))
        taken.append(joined)
        for s, e, kind in candidates(t, runs):
            if not meets(joined, s, e):
                rows.append(features(t, s, e, kind, joined))
                where.append((k, s, e, kind))
    p = own.probabilities(rows)
    for at in sorted(range(len(p)), key=lambda i: (-p[i], where[i])):
        k, s, e, kind = where[at]
        if p[at] >= own.thresholds[kind] and not meets(taken[k], s, e):
            found[k][1].append((s, e, kind))
            insort(taken[k], (s, e))
    return found


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, e, kind in sorted(spans, key=lambda x: (x[0], ALL_KINDS.index(x[2]), x[1])))


def redacted(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with each span replaced by its kind in brackets."""
    if text is None:
        return None
    out, done = [], 0
    for s, e, kind in sorted(spans):
        if e > done:
            out += [text[done : max(s, done)], f"[{kind}]"]
            done = e
    return "".join([*out, text[done:]])


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_spans, n_secret (of all spans), redacted of each document."""
    shared = with_small_batches(docs.sparkSession).sparkContext.broadcast(selector())
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans", "n_secret", "redacted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):
            texts = batch.column(1).to_pylist()
            found = spans_of(texts, shared.value)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array([sum(x[2] == k for x in base) for base, _ in found], pa.int64()) for k in KINDS),
                    pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found], pa.string()),
                    pa.array([written(base + more) for base, more in found], pa.string()),
                    pa.array([len(base) + len(more) for base, more in found], pa.int64()),
                    pa.array([sum(x[2] == "secret" for x in more) for _, more in found], pa.int64()),
                    pa.array([redacted(t, base + more) for t, (base, more) in zip(texts, found, strict=True)], pa.string()),
                ],
                names=names,
            )

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(lean(run), f"doc_id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string, n_spans long, n_secret long, redacted string")
