"""Exact deduplication by content-defined chunk recipes, in DataFrame operations only.

Texts count as equal when they are identical after white space is deleted. Each
normalised text is cut into chunks at places that its own content defines, so copies are
cut alike wherever they stand. The distinct chunks are shuffled once, to verify that a
64-bit identifier stands for one chunk content only; identifiers that several contents
share get a rank beside them. A document is then its ordered list of identifiers, its
recipe, and only recipes are grouped and joined: long texts do not move again.

Defined results for odd input: a null text is an empty one, and all empty texts are one
group with an empty recipe; a null id loses ties between equally long texts; of repeated
rows exactly one is kept; an empty table gives an empty result; further columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.llm.shared import numbered, staged, without_rows

#: Deleted before texts are compared: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE_SPACE = " \t\n\x0b\x0c\r"
#: A chunk ends at the first punctuation mark after MIN_CHUNK characters, or after MAX_CHUNK.
MIN_CHUNK, MAX_CHUNK, MARKS = 512, 4096, ".,;:!?。、！？।"


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in WHITE_SPACE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def chunks(norm: Column) -> Column:
    pattern = f"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?[{MARKS}]|.{{1,{MAX_CHUNK}}}"
    return F.regexp_extract_all(norm, F.lit(pattern), F.lit(0))


def identifier(chunk: Column, bits: int) -> Column:
    """``bits`` below 64 only serves tests, which need identifiers that clash."""
    h = F.xxhash64(chunk)
    return h if bits == 64 else F.pmod(h, F.lit(1 << bits))


def clashing_chunks(docs: DataFrame, text_col: str = "text", bits: int = 64) -> DataFrame | None:
    """Chunk contents whose identifier another content shares, with their rank; None if there are none.

    The distinct chunks cross the network here, each about once per map task at most.
    """
    distinct = docs.select(F.explode(chunks(normalised(F.col(text_col)))).alias("chunk")).distinct()
    distinct = distinct.withColumn("h", identifier(F.col("chunk"), bits))
    shared = staged(distinct.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "clashes")
    if shared.isEmpty():
        return None
    by_content = Window.partitionBy("h").orderBy("chunk")
    ranked = distinct.join(shared, "h", "left_semi").withColumn("rank", F.row_number().over(by_content) - 1)
    return staged(ranked.filter("rank > 0"), "clashing-chunks")


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, bits: int = 64) -> DataFrame:
    """A row per document: row, doc_id, n_points, text_sha256, recipe (array of verified identifiers)."""
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    norm = docs.select(
        row.alias("row"),
        F.col(id_col).alias("doc_id"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_points"),
        normalised(F.col(text_col)).alias("norm"),
    )
    cut = norm.select("row", "doc_id", "n_points", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), chunks(F.col("norm")).alias("chunks"))
    clashes = clashing_chunks(docs, text_col, bits)
    plain = F.transform("chunks", lambda c: F.struct(identifier(c, bits).alias("h"), F.lit(0).alias("rank")))
    if clashes is None:
        return cut.select("row", "doc_id", "n_points", "text_sha256", F.transform("chunks", lambda c: identifier(c, bits)).alias("recipe"))
    # Only documents with a clashing chunk need the ranks: their recipes are corrected at the places concerned.
    cut = staged(cut.withColumn("plain", plain), "cut")
    at = cut.select("row", F.posexplode("chunks").alias("at", "chunk")).withColumn("h", identifier(F.col("chunk"), bits))
    fixes = at.join(clashes, ["h", "chunk"]).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("at", "rank"))).alias("fix"))
    fixed = F.transform("plain", lambda x, i: F.struct(x["h"].alias("h"), F.coalesce(F.try_element_at("fix", i), F.lit(0)).alias("rank")))
    whole = F.when(F.col("fix").isNull(), F.col("plain")).otherwise(fixed)
    return cut.join(fixes, "row", "left").select("row", "doc_id", "n_points", "text_sha256", whole.alias("recipe"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, bits: int = 64) -> DataFrame:
    """A row per document: row, doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the one with the most code points, then the smallest id, is kept.
    Groups are aggregated before the shuffle, so a group of copies of any size costs
    a row per map task; the join back reads large groups in slices (skew join).
    """
    own = staged(recipes(docs, id_col, text_col, row_col, bits), "recipes")
    # Ordered by no arithmetic on ids, which may be strings; a null id comes last.
    best = F.min(F.struct((-F.col("n_points")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    # Written, so that the join has an exchange on either side and a hot recipe can be read in slices.
    groups = staged(own.groupBy("recipe").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")), "recipe-groups")
    return own.join(groups, "recipe").select(
        "row",
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        "text_sha256",
    )


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns."""
    own, row = numbered(docs)
    return without_rows(own, row, dedup(own, id_col, text_col, row).filter("NOT kept").select("row")).select(*(F.col(f"`{c}`") for c in docs.columns))
