"""Attribute bags: JSON objects read by type, without casting what has another one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bag(text: Column) -> Column:
    """The bag as VARIANT; null where the text is no JSON."""
    return F.try_parse_json(text)


def checked(text: Column) -> Column:
    """The text of a bag; raises where it is not a JSON object."""
    ok = F.coalesce(F.startswith(F.schema_of_variant(bag(text)), F.lit("OBJECT")), F.lit(False))
    return F.when(text.isNull() | ok, text).otherwise(F.raise_error(F.concat(F.lit("not a JSON object: "), text)).cast("string"))


def _typed(text: Column, key: str, kinds: tuple[str, ...], as_: str) -> Column:
    found = F.try_variant_get(bag(text), f"$.{key}", "variant")
    return F.when(F.schema_of_variant(found).rlike("^(" + "|".join(kinds) + ")"), F.try_variant_get(bag(text), f"$.{key}", as_))


def string_at(text: Column, key: str) -> Column:
    """A string value; null for any other type."""
    return _typed(text, key, ("STRING",), "string")


def number_at(text: Column, key: str) -> Column:
    return _typed(text, key, ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT", "INT"), "double")


def strings_at(text: Column, key: str) -> Column:
    """The string elements of a list value, in order; an empty array for any other type."""
    items = F.try_variant_get(bag(text), f"$.{key}", "array<variant>")
    only = F.filter(F.coalesce(items, F.array().cast("array<variant>")), lambda x: F.schema_of_variant(x) == "STRING")
    return F.transform(only, lambda x: F.try_variant_get(x, "$", "string"))


def flow_fields(node_id: Column, attributes: Column) -> Column:
    """struct of what a stored flow says of itself, with fallbacks: label -> id, member_count -> 0."""
    return F.struct(
        F.coalesce(string_at(attributes, "label"), node_id).alias("label"),
        F.coalesce(number_at(attributes, "member_count"), F.lit(0.0)).cast("long").alias("member_count"),
        strings_at(attributes, "entry_points").alias("entry_points"),
        strings_at(attributes, "anchor_set").alias("anchor_set"),
        string_at(attributes, "rationale").alias("rationale"),
        string_at(attributes, "skill_root").alias("skill_root"),
        string_at(attributes, "last_synced_at").alias("last_synced_at"),
    )


def seed_files(entry_points: Column) -> Column:
    """Files of stored seeds: what stands before ``#``, entries without one left out."""
    return F.array_distinct(F.transform(F.filter(entry_points, lambda p: F.contains(p, F.lit("#"))), lambda p: F.substring_index(p, "#", 1)))
