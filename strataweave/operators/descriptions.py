"""Which members get which description, and what is written of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataweave.functions.bag import string_at
from strataweave.functions.identity import DESCRIPTION_PREFIX, description_id
from strataweave.operators.flows import last_wins
from strataweave.staging import cut

#: Members a pass may describe, and sources of a description.
DESCRIBE_CAP = 200
SOURCES = ("docstring", "provisional", "placeholder", "llm")


def capped(df: DataFrame, order: list, cap: int) -> DataFrame:
    """``df`` with within_cap: whether a row is among the first ``cap`` in order; exactly so many are.

    The input is read once and written; the boundary row is found by a top-k, and a comparison with it marks
    the rest, so no row crosses the network for a global window. Rows of one order go by a hash of all their columns; only
    copies of the boundary row, equal in every column, are numbered.
    """
    own = cut(df.withColumn("__b", F.struct(*order, F.xxhash64(*df.columns).alias("__h"))))
    top = own.select("__b").orderBy("__b").limit(cap).groupBy("__b").agg(F.count(F.lit(1)).alias("n"))
    boundary = F.broadcast(top.agg(F.max("__b").alias("__last"), F.max_by("n", "__b").alias("__n")))
    marked = own.crossJoin(boundary)
    at = F.coalesce(F.col("__b") == F.col("__last"), F.lit(False))
    rest = marked.filter(~at).withColumn("within_cap", F.coalesce(F.col("__b") < F.col("__last"), F.lit(False)))
    copies = marked.filter(at).withColumn("within_cap", F.row_number().over(Window.partitionBy("__b").orderBy("__n")) <= F.col("__n"))
    return rest.unionByName(copies).drop("__b", "__last", "__n")


def plan(members: DataFrame, existing: DataFrame, cap: int = DESCRIBE_CAP) -> DataFrame:
    """(symbol_path, bucket): cached, docstring, llm or placeholder.

    ``members`` (symbol_path, content_hash, name, docstring), ``existing`` (symbol_path,
    content_hash). Unchanged contents and docstrings never use up the cap; beyond it names stand in.
    """
    known = existing.select("symbol_path", "content_hash").distinct().withColumn("__cached", F.lit(True))
    rows = members.join(known, ["symbol_path", "content_hash"], "left")
    bucket = F.when(F.col("__cached"), "cached").when(F.col("docstring").isNotNull(), "docstring")
    marked = rows.withColumn("bucket", bucket).drop("__cached")
    open_ = capped(marked.filter("bucket IS NULL"), ["symbol_path"], cap)
    named = open_.withColumn("bucket", F.when(F.col("within_cap"), "llm").otherwise("placeholder")).drop("within_cap")
    return marked.filter("bucket IS NOT NULL").unionByName(named)


def resolved(plan_: DataFrame) -> DataFrame:
    """Texts of a deterministic pass: the docstring, or the name for what awaits an author (provisional) or is over the cap."""
    text = F.when(F.col("bucket") == "docstring", F.col("docstring")).otherwise(F.col("name"))
    source = F.when(F.col("bucket") == "llm", "provisional").otherwise(F.col("bucket"))
    return plan_.filter("bucket <> 'cached'").select("symbol_path", "content_hash", text.alias("text"), source.alias("source"))


def existing_of(nodes: DataFrame) -> DataFrame:
    """(symbol_path, content_hash, source, text) of description nodes; without those whose hash is no string; an unknown source is null."""
    rows = nodes.filter(F.startswith("id", F.lit(DESCRIPTION_PREFIX)) & F.col("deleted_at").isNull())
    source = string_at(F.col("attributes"), "description_source")
    return rows.select(
        F.substring("id", F.lit(len(DESCRIPTION_PREFIX) + 1), F.length("id")).alias("symbol_path"),
        string_at(F.col("attributes"), "described_at_content_hash").alias("content_hash"),
        F.when(source.isin(*SOURCES), source).alias("source"),
        string_at(F.col("attributes"), "description").alias("text"),
    ).filter("content_hash IS NOT NULL")


def rows_of(texts: DataFrame) -> DataFrame:
    """Field writes (target, field, value as JSON text, tier) of described members."""
    fields = {"description": "text", "description_source": "source", "described_at_content_hash": "content_hash"}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("field"), F.col(c).alias("v")) for k, c in fields.items()))).alias("f")
    text = F.to_json(F.array("f.v"))
    return texts.select(description_id(F.col("symbol_path")).alias("target"), each).select("target", "f.field", text.substr(F.lit(2), F.length(text) - 2).alias("value"), F.lit("agentic").alias("tier"))


def side_nodes(texts: DataFrame) -> DataFrame:
    """Node rows that carry the descriptions."""
    null = F.lit(None).cast("string")
    return texts.select(
        description_id(F.col("symbol_path")).alias("id"), F.lit("agentic.description").alias("kind"), F.substring_index("symbol_path", "#", 1).alias("path"),
        F.concat("symbol_path", F.lit(":"), "content_hash").alias("anchor"), F.lit("agentic").alias("layer"), F.lit("{}").alias("attributes"),
        F.create_map().cast("map<string,string>").alias("field_ownership"), F.lit("agentic").alias("origin"), F.lit("description").alias("intent_source"), null.alias("deleted_at"),
    )


def counts_by_source(texts: DataFrame) -> DataFrame:
    return texts.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def breakdown(rows: DataFrame, key: list[str], source: str = "source") -> DataFrame:
    """Counts of five buckets for each key; unknown and absent sources are ``none``, so buckets add up to the rows."""
    bucket = F.when(F.col(source).isin(*SOURCES), F.col(source)).otherwise("none")
    return rows.groupBy(*key).agg(*(F.count_if(bucket == b).alias(b) for b in (*SOURCES, "none")), F.count(F.lit(1)).alias("total"))


def index_by_path(descriptions: DataFrame, pos: str) -> DataFrame:
    """One description for each symbol path, the last row standing."""
    return last_wins(descriptions, ["symbol_path"], pos)
