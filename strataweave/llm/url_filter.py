"""URL filter: rules of hosts and paths, and gradient-boosted trees on lexical features for what no rule fits.

A rule fits its host and all subdomains where the path starts with the rule's; the longest wins. URLs that a
rule fits are the labelled ones. From them trees are fitted on length, host length, labels of the host,
depth, digit ratio, entropy, parameters, hyphens, and four suffix statistics: the share of blocked URLs among the
labelled ones with the same last label of the host, same last two labels, same file ending and same first
directory. Statistics are counted over all labelled rows, in BUCKETS hashed buckets a kind, so the table
that is broadcast is bounded; those that trees are fitted on come from the other half of the URLs.

All is DataFrame and SQL: features, statistics, the histograms of gradients by which a level of a tree is
split, and the fold over the fitted trees. Trees are fitted on FIT_URLS distinct URLs a verdict at most, chosen by their hash
and weighted by what they stand for; the driver sees a level's histogram only.

Defined results for odd input: a null url and one without ``://`` have an empty host and path, no rule and a score of the method;
repeated rows are judged alike, and are counted once in the fit; without labelled URLs of both verdicts the score is their share of
blocked ones (one half without any) and a score of one half allows; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.llm.shared import staged

#: Host, path and verdict of each rule.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Distinct URLs of a verdict that trees are fitted on, in expectation; hashed buckets of a suffix statistic; its weight of the mean.
FIT_URLS, BUCKETS, PRIOR = 5000, 4096, 10.0
TREES, BINS, RATE, RIDGE = 20, 16, 0.3, 1.0
#: A depth of three: seven questions and eight leaves, in level order.
DEPTH = 3
NEVER = 1e300
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SUFFIXES = ("last_label", "last_labels", "ending", "directory")
PLAIN = ("length", "host_length", "labels", "depth", "digits", "entropy", "parameters", "hyphens")
FEATURES = (*PLAIN, *SUFFIXES)


def with_parts(pages: DataFrame) -> DataFrame:
    """Adds host, path and query of ``url``."""
    rest = F.when(F.contains("url", F.lit("://")), F.expr("substring(url, instr(url, '://') + 3)"))
    host = F.translate(F.regexp_extract(F.col("rest"), "^[^/?#]*", 0), CAPITALS, CAPITALS.lower())
    tail = F.expr("substring(rest, length(host) + 1)")
    own = pages.withColumn("rest", F.coalesce(rest, F.lit(""))).withColumn("host", host)
    own = own.withColumn("path", F.regexp_extract(tail, "^[^?#]*", 0))
    return own.withColumn("query", F.regexp_extract("url", r"\?([^#]*)", 1)).drop("rest")


def fitting(rules: tuple[tuple[str, str, str], ...]) -> Column:
    """The longest rule that fits host and path, as (rule, verdict)."""
    text = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    longest = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    listed = ", ".join(f"named_struct('host', {text(h)}, 'path', {text(p)}, 'rule', {text(h + p)}, 'verdict', {text(v)})" for h, p, v in longest)
    fits = "(host = r.host OR endswith(host, concat('.', r.host))) AND startswith(path, r.path)"
    return F.expr(f"get(filter(array({listed}), r -> {fits}), 0)") if rules else F.lit(None).cast("struct<rule:string,verdict:string>")


def entropy(text: Column) -> Column:
    """Bits a character, by one fold over the sorted characters."""
    n = F.length(text)
    chars = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    nats = lambda k: F.when(k > 0, k * F.log(F.greatest(k, F.lit(1.0)))).otherwise(0.0)
    start = F.struct(F.lit("").alias("c"), F.lit(0.0).alias("k"), F.lit(0.0).alias("s"))
    step = lambda a, c: F.when(a.c == c, F.struct(c.alias("c"), (a.k + 1.0).alias("k"), a.s.alias("s"))).otherwise(F.struct(c.alias("c"), F.lit(1.0).alias("k"), (a.s + nats(a.k)).alias("s")))
    total = F.aggregate(chars, start, step, lambda a: a.s + nats(a.k))
    return F.when(n > 0, (F.log(n.cast("double")) - total / n) / math.log(2)).otherwise(0.0)


def with_features(parts: DataFrame) -> DataFrame:
    """Adds the plain features, the hashed bucket of each suffix, and the half of the URLs that it belongs to."""
    labels = F.expr("split(host, '[.]')")
    name = F.substring_index("path", "/", -1)
    suffix = {
        "last_label": F.substring_index("host", ".", -1),
        "last_labels": F.substring_index("host", ".", -2),
        "ending": F.regexp_extract(name, r"\.([^.]*)$", 1),
        "directory": F.regexp_extract("path", "^/([^/]*)/", 1),
    }
    size = F.length("url")
    plain = {
        "length": size,
        "host_length": F.length("host"),
        "labels": F.size(labels),
        "depth": F.size(F.regexp_extract_all("path", F.lit("[^/]+"), F.lit(0))),
        "digits": (size - F.length(F.translate("url", "0123456789", ""))) / F.greatest(size, F.lit(1)),
        "entropy": entropy(F.col("url")),
        "parameters": F.size(F.regexp_extract_all("query", F.lit("[^&]+"), F.lit(0))),
        "hyphens": F.length("host") - F.length(F.translate("host", "-", "")),
    }
    hashed = {f"at_{k}": F.pmod(F.xxhash64(v), F.lit(BUCKETS)).cast("int") for k, v in suffix.items()}
    return parts.withColumns({k: v.cast("double") for k, v in plain.items()} | hashed | {"half": F.pmod(F.xxhash64("url", F.lit("half")), F.lit(2))})


def statistics(labelled: DataFrame) -> DataFrame:
    """(kind, bucket, n, blocked, n_other, blocked_other): labelled rows of both halves by suffix bucket, 4 * BUCKETS rows at most."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"at_{k}").alias("bucket")) for k in SUFFIXES))).alias("s")
    one, bad = F.col("half") == 1, F.col("blocked") == 1
    rows = labelled.select(each, "half", "blocked").select("s.kind", "s.bucket", "half", "blocked")
    counted = rows.groupBy("kind", "bucket").agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("blocked"), F.count_if(one).alias("n_1"), F.count_if(one & bad).alias("blocked_1"))
    return staged(counted, "suffixes")


def with_statistics(rows: DataFrame, stats: DataFrame, mean: float, held_out: bool) -> DataFrame:
    """Adds the share of blocked URLs for each suffix; ``held_out``: counted over the other half of the URLs only."""
    out = rows
    for kind in SUFFIXES:
        own = F.broadcast(stats.filter(F.col("kind") == kind).select(F.col("bucket").alias(f"b_{kind}"), F.struct("n", "blocked", "n_1", "blocked_1").alias(f"s_{kind}")))
        out = out.join(own, F.col(f"at_{kind}") == F.col(f"b_{kind}"), "left")
    shares = {}
    for kind in SUFFIXES:
        s = F.col(f"s_{kind}")
        n, bad = s.n, s.blocked
        if held_out:
            n, bad = (F.when(F.col("half") == 1, whole - part).otherwise(part) for whole, part in ((s.n, s.n_1), (s.blocked, s.blocked_1)))
        shares[kind] = (F.coalesce(bad, F.lit(0)) + PRIOR * mean) / (F.coalesce(n, F.lit(0)) + PRIOR)
    return out.withColumns(shares)


def fold(trees: list[tuple[list[int], list[float], list[float]]], start: float, x: str) -> str:
    """SQL of the trees' sum for the array ``x``: three comparisons a tree, whatever their number."""
    if not trees:
        return f"{start!r}D"

    def ask(node: int) -> str:
        if node >= 7:
            return f"t.v[{node - 7}]"
        return f"if({x}[t.f[{node}]] > t.c[{node}], {ask(2 * node + 2)}, {ask(2 * node + 1)})"

    number = lambda values: "array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")"
    listed = ", ".join(f"named_struct('f', array({', '.join(map(str, f))}), 'c', {number(c)}, 'v', {number(v)})" for f, c, v in trees)
    return f"aggregate(array({listed}), {start!r}D, (z, t) -> z + {ask(0)})"


def best_splits(histogram: dict[tuple[int, int, int], tuple[float, float]], level: int) -> dict[int, tuple[int, int, tuple, tuple]]:
    """For each node of a level the feature and bin after which it is split, and sums of both sides.

    Gains are compared at six digits, so the order in which a sum was added up doesn't choose.
    """
    nodes: dict[int, dict[int, dict[int, tuple[float, float]]]] = {}
    for (node, feature, b), sums in histogram.items():
        nodes.setdefault(node, {}).setdefault(feature, {})[b] = sums
    found = {}
    for node, by_feature in nodes.items():
        g, h = (math.fsum(s[k] for s in next(iter(by_feature.values())).values()) for k in (0, 1))
        worth = lambda a, b: a * a / (b + RIDGE)
        found[node] = (0, BINS, (g, h), (0.0, 0.0))
        best = 0.0
        for feature in sorted(by_feature):
            left_g = left_h = 0.0
            for b in sorted(by_feature[feature])[:-1]:
                left_g, left_h = left_g + by_feature[feature][b][0], left_h + by_feature[feature][b][1]
                gain = round(worth(left_g, left_h) + worth(g - left_g, h - left_h) - worth(g, h), 6)
                if gain > best:
                    best, found[node] = gain, (feature, b, (left_g, left_h), (g - left_g, h - left_h))
    return found


def boosted(binned: DataFrame, start: float, trees: int = TREES) -> list[tuple[list[int], list[float], list[float]]]:
    """Trees on bins, fitted to rows (bins, blocked, weight) by the logistic loss, a level by one histogram over all rows."""
    # FIT_URLS rows a verdict at most, so one task adds up a histogram without a shuffle.
    rows, made = binned.coalesce(1), []
    for _ in range(trees):
        features, cuts, leaves = [0] * 7, [NEVER] * 7, [0.0] * 8
        for level in range(DEPTH):
            node = "0"
            for _ in range(level):
                node = f"(2 * {node} + 1 + int(bins[array({', '.join(map(str, features))})[{node}]] > array({', '.join(f'{c!r}D' for c in cuts)})[{node}]))"
            z = rows.select("bins", "blocked", "weight", F.expr(fold(made, start, "bins")).alias("z"), F.expr(node).alias("node"))
            p = 1 / (1 + F.exp(-F.col("z")))
            one = z.withColumn("p", p).select("node", (F.col("weight") * (F.col("blocked") - F.col("p"))).alias("g"), (F.col("weight") * F.col("p") * (1 - F.col("p"))).alias("h"), F.posexplode("bins").alias("feature", "bin"))
            sums = one.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            for at, (feature, b, left, right) in best_splits({(r.node, r.feature, int(r.bin)): (r.g, r.h) for r in sums}, level).items():
                features[at], cuts[at] = feature, float(b)
                if level == DEPTH - 1:
                    for side, (g, h) in enumerate((left, right)):
                        leaves[2 * (at - 3) + side] = round(RATE * g / (h + RIDGE), 6)
        made.append((features, cuts, leaves))
    return made


def sampled(labelled: DataFrame, most: int) -> tuple[DataFrame, float, bool]:
    """Distinct labelled URLs (with their features), ``most`` a verdict in expectation, with the weight of each; the share of
    blocked rows; and whether there are both verdicts.

    A URL is taken by its hash; the number of distinct ones comes from a mergeable sketch.
    """
    sizes = {r.blocked: (r.n, r.urls) for r in labelled.groupBy("blocked").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("url", 0.02).alias("urls")).collect()}
    n = sum(x[0] for x in sizes.values())
    mean = sizes.get(1, (0, 0))[0] / n if n else 0.5
    share = lambda y: min(1.0, most / max(1, sizes[y][1])) if y in sizes else 1.0
    taken = F.when(F.col("blocked") == 1, share(1)).otherwise(share(0))
    draw = F.pmod(F.xxhash64("url", F.lit("fit")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = labelled.filter(draw < taken).withColumn("weight", 1 / taken)
    return rows.groupBy("url").agg(*(F.first(c).alias(c) for c in rows.columns if c != "url")), mean, len(sizes) == 2


class Method:
    """Fitted trees over raw features, and the statistics they were fitted with."""

    def __init__(self, stats: DataFrame, mean: float, start: float, trees: list):
        self.stats, self.mean, self.start, self.trees = stats, mean, start, trees

    def scores(self, rows: DataFrame, kept: list[str]) -> DataFrame:
        """``kept`` columns of rows with features, and score: the probability that a URL is to be blocked."""
        own = with_statistics(rows, self.stats, self.mean, held_out=False)
        own = own.select(*kept, F.array(*FEATURES).alias("x"))
        return own.select(*kept, (1 / (1 + F.exp(-F.expr(fold(self.trees, self.start, "x"))))).alias("score"))


def fit(labelled: DataFrame, most: int = FIT_URLS, trees: int = TREES) -> Method:
    """The method from labelled URLs with features (``blocked`` 0 or 1)."""
    stats = statistics(labelled)
    rows, mean, both = sampled(labelled, most)
    logit = math.log((mean + 1e-6) / (1 - mean + 1e-6))
    if not both:
        return Method(stats, mean, logit, [])
    own = staged(with_statistics(rows, stats, mean, held_out=True).select(*FEATURES, "blocked", "weight"), "fit")
    points = ", ".join(str(k / BINS) for k in range(1, BINS))
    found = own.agg(*(F.expr(f"percentile(`{f}`, array({points}))").alias(f) for f in FEATURES)).first()
    cuts = [sorted(set(found[f])) for f in FEATURES]
    bins = F.array(*(F.expr(f"double(size(filter(array({', '.join(f'{c!r}D' for c in own_cuts)}), c -> `{f}` > c)))") for f, own_cuts in zip(FEATURES, cuts, strict=True)))
    binned = own.select(bins.alias("bins"), "blocked", "weight").groupBy("bins", "blocked").agg(F.sum("weight").alias("weight"))
    made = boosted(staged(binned, "bins"), logit, trees)
    raw = [(f, [cuts[k][int(c)] if c < len(cuts[k]) else NEVER for k, c in zip(f, at, strict=True)], v) for f, at, v in made]
    return Method(stats, mean, logit, raw)


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, fit_urls: int = FIT_URLS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict (the rule's, else the method's) and score of each URL."""
    own = with_parts(pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url")))
    own = with_features(own.withColumn("fit", fitting(rules)))
    labelled = own.filter("fit IS NOT NULL").select("url", F.when(F.col("fit.verdict") == "block", 1).otherwise(0).alias("blocked"), *PLAIN, *(f"at_{k}" for k in SUFFIXES), "half")
    method = fit(labelled, fit_urls)
    scored = method.scores(own, ["page_id", "host", "path", "fit"])
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "score")
