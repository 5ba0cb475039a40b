"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

Each source is cut into blocks of documents in id order. With integer target weights w of
sum W, block i of a source may not start before slot floor(i * W / w) and is due by slot
ceil((i + 1) * W / w); in every slot the earliest due released block runs. Each source is
then less than one block from its target share at every slot. The pattern repeats every W
slots, so it is worked out once per phase, over W slots, and any block's slot is arithmetic.

When a source has fewer blocks left than its weight it supplies what it has in one last
period, the slots that it leaves empty close up, and the rest go on with the weights that
remain. So each document has exactly one place, and none is repeated or left out. Sources
that the weights do not name, and a null source, share the weight of REST as one source.

The driver holds one row count for each named weight, nothing that grows with the data.

Defined results for odd input: null ids come first within their source; repeated rows each
get a place; an empty table gives an empty result; further columns are ignored, or carried
along unchanged by ``mixed_documents``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.llm.ranking import ranked
from strataweave.llm.shared import free_name

REST = "*"
BLOCK = 32
#: Target weights of the registered query and of the pipeline.
WEIGHTS = {**{f"src{i}": 4 for i in range(5)}, **{f"src{i}": 3 for i in range(5, 10)}, **{f"src{i}": 2 for i in range(10, 20)}, REST: 1}


def pattern(weights: dict[str, int]) -> dict[str, list[int]]:
    """Slots of each source's blocks in one period of sum(weights) slots, by earliest deadline first."""
    total = sum(weights.values())
    done = dict.fromkeys(weights, 0)
    slots: dict[str, list[int]] = {s: [] for s in weights}
    for t in range(total):
        free = [(-(-(done[s] + 1) * total // w), s) for s, w in weights.items() if done[s] < w and done[s] * total // w <= t]
        _, s = min(free)
        slots[s].append(t)
        done[s] += 1
    return slots


def phases(blocks: dict[str, int], weights: dict[str, int]) -> list[dict]:
    """Rows (source, first, last, base, period, slots): blocks first..last-1 of source run at
    base + (i div len(slots)) * period + slots[i mod len(slots)], i counted from first."""
    left = {s: n for s, n in blocks.items() if n > 0}
    used = dict.fromkeys(left, 0)
    out, base = [], 0
    while left:
        own = {s: weights[s] for s in sorted(left)}
        slots, period = pattern(own), sum(own.values())
        full = min(left[s] // w for s, w in own.items())
        if full:
            for s, w in own.items():
                out.append({"source": s, "first": used[s], "last": used[s] + full * w, "base": base, "period": period, "slots": slots[s], "weight": w})
                used[s] += full * w
                left[s] -= full * w
            base += full * period
        taken = sorted((t, s) for s, w in own.items() for t in slots[s][: min(w, left[s])])
        if any(left[s] < w for s, w in own.items()):
            for s, w in own.items():
                mine = [at for at, (_, x) in enumerate(taken) if x == s]
                if mine:
                    out.append({"source": s, "first": used[s], "last": used[s] + len(mine), "base": base, "period": len(taken), "slots": mine, "weight": w})
                used[s] += len(mine)
                left[s] -= len(mine)
            base += len(taken)
        left = {s: n for s, n in left.items() if n > 0}
    return out


def plan_table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """The phases as a literal table; its size depends on the weights alone."""
    text = "', '".join(r["source"].replace("\\", "\\\\").replace("'", "\\'") for r in rows)
    num = lambda k: "array(" + ", ".join(f"{r[k]}L" for r in rows) + ")"
    slots = "array(" + ", ".join("array(" + ", ".join(f"{x}L" for x in r["slots"]) + ")" for r in rows) + ")"
    fields = ["pool", "first", "last", "base", "period", "weight", "slots"]
    if not rows:
        return spark.range(0).selectExpr("'' AS pool", *(f"0L AS {k}" for k in fields[1:-1]), "array(0L) AS slots")
    zipped = f"arrays_zip(array('{text}'), {', '.join(num(k) for k in fields[1:-1])}, {slots})"
    return spark.sql(f"SELECT inline({zipped})").toDF(*fields)


def mixed(docs: DataFrame, weights: dict[str, int], block: int = BLOCK, id_col: str = "doc_id", source_col: str = "source", prefix: str = "") -> DataFrame:
    """``docs`` with pool, block, slot, release, deadline and position (names led by ``prefix``).

    position numbers all documents from 0 without gaps in the mixed order.
    """
    if REST not in weights or min(weights.values()) < 1:
        raise ValueError(f"weights are integers from 1 on and name {REST!r}")
    spark = docs.sparkSession
    pool = free_name(docs, f"{prefix}pool")
    named = F.when(F.col(source_col).isin([s for s in weights if s != REST]), F.col(source_col)).otherwise(F.lit(REST))
    g = free_name(docs, "__g")
    keyed = docs.withColumn(pool, named)
    ties = [F.xxhash64(*(c for c in docs.columns if not isinstance(docs.schema[c].dataType, _unhashable())))]
    own = ranked(keyed, [F.col(pool), F.col(id_col), *ties], g)
    sizes = {r[0]: r[1] for r in own.groupBy(pool).count().collect()}  # a row for each weight
    starts, at = {}, 0
    for s in sorted(sizes, key=lambda x: x.encode()):
        starts[s], at = at, at + sizes[s]
    blocks = {s: -(-n // block) for s, n in sizes.items()}
    rows = phases(blocks, weights)
    plan = plan_table(spark, rows)
    # The last block of a source may be short; documents after it move up.
    short = []
    for s, n in sizes.items():
        if n % block:
            j = blocks[s] - 1
            r = next(r for r in rows if r["source"] == s and r["first"] <= j < r["last"])
            i, w = j - r["first"], len(r["slots"])
            short.append((r["base"] + i // w * r["period"] + r["slots"][i % w], block - n % block))
    start = F.lit(0).cast("long")
    for s, x in starts.items():
        start = F.when(F.col(pool) == s, F.lit(x).cast("long")).otherwise(start)
    names = {k: free_name(docs, f"{prefix}{k}") for k in ("block", "slot", "release", "deadline", "position")}
    j, i, p = free_name(docs, "__j"), free_name(docs, "__i"), free_name(docs, "__p")
    own = own.withColumn(g, F.col(g) - start).withColumn(j, F.expr(f"`{g}` div {block}"))
    # One struct column carries the phase, so that it can't meet a column of the input.
    phase = F.broadcast(plan.select(F.struct(*plan.columns).alias(p)))
    here = own.join(phase, F.expr(f"`{pool}` = `{p}`.pool AND `{j}` >= `{p}`.first AND `{j}` < `{p}`.last")).withColumn(i, F.expr(f"`{j}` - `{p}`.first"))
    w, base, period = f"size(`{p}`.slots)", f"`{p}`.base", f"`{p}`.period"
    here = here.withColumn(names["slot"], F.expr(f"{base} + `{i}` div {w} * {period} + get(`{p}`.slots, int(`{i}` % {w}))"))
    moved = F.lit(0).cast("long")
    for slot, missing in short:
        moved = moved + F.when(F.col(names["slot"]) > slot, F.lit(missing)).otherwise(F.lit(0))
    return here.select(
        *(F.col(f"`{c}`") for c in docs.columns),
        pool,
        F.col(j).alias(names["block"]),
        names["slot"],
        F.expr(f"{base} + `{i}` * {period} div {w}").alias(names["release"]),
        F.expr(f"{base} + ((`{i}` + 1) * {period} + {w} - 1) div {w}").alias(names["deadline"]),
        (F.col(names["slot"]) * block + F.col(g) % block - moved).alias(names["position"]),
    )


def _unhashable() -> tuple:
    from pyspark.sql import types as T

    return (T.MapType, T.VariantType)


def mixed_documents(docs: DataFrame, weights: dict[str, int], block: int = BLOCK, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """All rows and columns of ``docs``, sorted into the mixed order."""
    out = mixed(docs, weights, block, id_col, source_col, prefix="__mix_")
    return out.orderBy(out.columns[-1]).select(*(F.col(f"`{c}`") for c in docs.columns))
