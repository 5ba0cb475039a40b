"""Field precedence of tiers, and the read-side fold of layers. They are different mechanisms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.operators.graph import without_dangling
from strataweave.schema import tier_rank


def ladder_write(current: DataFrame, writes: DataFrame) -> DataFrame:
    """Field writes under the ladder.

    ``current`` (target, field, value, owner) and ``writes`` (target, field, value, tier); a
    write lands where its tier ranks at or above the field's owner, absent counting as raw.
    Returns target, field, value, owner, landed for every written field.
    """
    own = current.select("target", "field", F.col("value").alias("old"), "owner")
    both = writes.join(own, ["target", "field"], "left")
    lands = tier_rank(F.col("owner")) <= tier_rank(F.col("tier"))
    return both.select("target", "field", F.when(lands, F.col("value")).otherwise(F.col("old")).alias("value"), F.when(lands, F.col("tier")).otherwise(F.col("owner")).alias("owner"), lands.alias("landed"))


def long_fields(nodes: DataFrame) -> DataFrame:
    """(target, field, value, owner) of rows (id, attributes, field_ownership); values as JSON text."""
    fields = F.explode(F.from_json("attributes", "map<string,variant>")).alias("field", "v")
    own = nodes.select(F.col("id").alias("target"), "field_ownership", fields)
    return own.select("target", "field", F.to_json("v").alias("value"), F.try_element_at("field_ownership", F.col("field")).alias("owner"))


def write_fields(nodes: DataFrame, writes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``nodes`` after the writes (target, field, value as JSON text, tier), and the skipped ones (target, field).

    Landed fields are stamped with their tier; a landed user write makes the row a user row for
    good. Unknown targets do nothing; deleted rows are written like others.
    """
    done = ladder_write(long_fields(nodes), writes.join(nodes.select(F.col("id").alias("target")), "target", "left_semi"))
    landed = done.filter("landed").groupBy(F.col("target").alias("id")).agg(
        F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("__values"),
        F.map_from_entries(F.collect_list(F.struct("field", "owner"))).alias("__owners"),
        F.max(F.col("owner") == "user").alias("__user"),
    )
    joined = nodes.join(landed, "id", "left")
    old = F.coalesce(F.transform_values(F.from_json("attributes", "map<string,variant>"), lambda k, v: F.to_json(v)), F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(F.col("__values"), k)), F.col("__values"))
    text = bag_text(F.array_sort(F.map_entries(merged)))
    owned = F.coalesce("field_ownership", F.create_map().cast("map<string,string>"))
    owners = F.map_concat(F.map_filter(owned, lambda k, v: ~F.map_contains_key(F.col("__owners"), k)), F.col("__owners"))
    hit = F.col("__values").isNotNull()
    out = joined.withColumns({
        "attributes": F.when(hit, text).otherwise(F.col("attributes")),
        "field_ownership": F.when(hit, owners).otherwise(F.col("field_ownership")),
        "layer": F.when(F.coalesce("__user", F.lit(False)), "user").otherwise(F.col("layer")),
    })
    return out.select(*nodes.columns), done.filter("NOT landed").select("target", "field")


def bag_text(entries: Column) -> Column:
    """The JSON object of (key, value as JSON text) entries."""
    return F.to_json(F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"], F.parse_json(e["value"])))))


def fields_by_tier(dirty: DataFrame) -> DataFrame:
    """(target, tier, fields): dirty fields (target, field, value, tier) as one map for each write."""
    return dirty.groupBy("target", "tier").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("fields"))


def fold_fields(fields: DataFrame) -> DataFrame:
    """(id, field, value): of (id, field, value, ord) the value of the last layer."""
    return fields.groupBy("id", "field").agg(F.max_by("value", "ord").alias("value"))


def fold(layers: list[DataFrame], key: str, show_tombstones: bool = False) -> DataFrame:
    """Rows of layers merged in list order.

    Bags merge key by key, the last layer's value standing; all other columns come whole from the
    last layer; ownership is cleared. Tombstones go after the fold, so a later layer may revive.
    """
    order = F.struct(F.col("__layer"), F.col("__row"))
    each = reduce(DataFrame.unionByName, (d.withColumns({"__layer": F.lit(i), "__row": F.monotonically_increasing_id()}) for i, d in enumerate(layers)))
    rest = [c for c in layers[0].columns if c not in (key, "attributes", "field_ownership")]
    whole = each.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("__r"), F.max(order).alias("__last"))
    bags = each.select(F.col(key), order.alias("o"), F.explode(F.from_json("attributes", "map<string,variant>")).alias("k", "v"))
    last = bags.groupBy(key, "k").agg(F.max_by(F.to_json("v"), "o").alias("v"))
    merged = last.groupBy(key).agg(bag_text(F.array_sort(F.collect_list(F.struct(F.col("k").alias("key"), F.col("v").alias("value"))))).alias("__bag"))
    out = whole.join(merged, key, "left").select(
        key, *(F.col(f"__r.{c}").alias(c) for c in rest), F.coalesce("__bag", F.lit("{}")).alias("attributes"), F.create_map().cast("map<string,string>").alias("field_ownership")
    )
    return (out if show_tombstones else out.filter("deleted_at IS NULL")).select(*layers[0].columns)


def base_layer(rows: DataFrame, layer: str, overlay: DataFrame | None = None) -> DataFrame:
    """Rows of a stored tier, or the overlay's own."""
    return overlay if overlay is not None else rows.filter(F.col("layer") == layer)


def render(node_layers: list[DataFrame], edge_layers: list[DataFrame], show_tombstones: bool = False) -> tuple[DataFrame, DataFrame]:
    """Folded nodes and edges; edges without both ends are left out."""
    nodes = fold(node_layers, "id", show_tombstones)
    return nodes, without_dangling(fold(edge_layers, "key", show_tombstones), nodes)


def hydrate(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows, deleted ones too; reading an edge without both ends raises."""
    a, b = nodes.select(F.col("id").alias("src_id"), F.lit(True).alias("__a")), nodes.select(F.col("id").alias("dst_id"), F.lit(True).alias("__b"))
    both = edges.join(a, "src_id", "left").join(b, "dst_id", "left")
    missing = F.raise_error(F.concat(F.lit("edge without both ends: "), F.col("key"))).cast("string")
    checked = both.withColumn("key", F.when(F.col("__a") & F.col("__b"), F.col("key")).otherwise(missing))
    return nodes, checked.select(*edges.columns)


def folded_changes(log: DataFrame) -> DataFrame:
    """A change log (target, op, seq, …) without what a later full upsert of the target made void."""
    reset = log.filter("op = 'upsert'").groupBy("target").agg(F.max("seq").alias("__reset"))
    return log.join(reset, "target", "left").filter("__reset IS NULL OR seq >= __reset").drop("__reset")
