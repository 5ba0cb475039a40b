"""Rows for a bounded view: grids, boxes, cluster numbers, exports, error tallies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataweave.functions.identity import display_name
from strataweave.functions.predicates import in_viewport, is_inferred
from strataweave.operators.graph import components
from strataweave.operators.ordinals import numbered


def culled(boxes: DataFrame, view: tuple[float, float, float, float], buffer: float = 100) -> DataFrame:
    return boxes.filter(in_viewport(F.col("x"), F.col("y"), F.col("width"), F.col("height"), view, buffer))


def member_counts(contains: DataFrame) -> DataFrame:
    """(module, n) of contains edges (src_id, dst_id)."""
    return contains.groupBy(F.col("src_id").alias("module")).agg(F.count(F.lit(1)).alias("n"))


def bounding_boxes(children: DataFrame, padding: float = 20, header: float = 40) -> DataFrame:
    """The box around each parent's children (parent, x, y, width, height), padded, with room for a header."""
    left, top = F.min("x"), F.min("y")
    right, bottom = F.max(F.col("x") + F.col("width")), F.max(F.col("y") + F.col("height"))
    return children.groupBy("parent").agg((left - padding).alias("x"), (top - padding - header).alias("y"), (right - left + 2 * padding).alias("width"), (bottom - top + 2 * padding + header).alias("height"))


def moved_into(children: DataFrame, boxes: DataFrame) -> DataFrame:
    """Children placed relative to their parent's box."""
    b = boxes.select("parent", F.col("x").alias("__x"), F.col("y").alias("__y"))
    return children.join(b, "parent").withColumns({"x": F.col("x") - F.col("__x"), "y": F.col("y") - F.col("__y")}).drop("__x", "__y")


def grid(nodes: DataFrame, edges: DataFrame, cell: float = 250) -> DataFrame:
    """(node, component, x, y): each undirected component in a square grid, by node order. For views within the budget."""
    rooted = components(edges, nodes).withColumnRenamed("root", "component")
    n = F.count(F.lit(1)).over(Window.partitionBy("component"))
    i = F.row_number().over(Window.partitionBy("component").orderBy("node")) - 1
    side = F.ceil(F.sqrt(n.cast("double")))
    return rooted.select("node", "component", (F.pmod(i, side) * cell).alias("x"), (F.floor(i / side) * cell).alias("y"))


def cluster_numbers(modules: DataFrame, pos: str = "pos") -> DataFrame:
    """Modules (module, cluster) with their index in the order of ``pos``."""
    return numbered(modules.select("module", F.col(pos).alias("pos")), ["pos", "module"], "cluster").select("module", F.col("cluster").cast("int").alias("cluster"))


def parents_first(nodes: DataFrame, pos: str = "pos") -> DataFrame:
    return nodes.orderBy(F.col("parent").isNotNull(), pos)


def view_nodes(rows: DataFrame) -> DataFrame:
    """View rows by kind: modules are containers, functions show their bare name."""
    is_module = F.col("kind") == "code.module"
    return rows.select("id", F.when(is_module, "module").when(F.col("kind") == "doc", "doc").otherwise("function").alias("type"), F.when(is_module, F.element_at(F.split("id", "/"), -1)).otherwise(display_name(F.col("id"))).alias("label"), F.col("group").alias("parent"))


def view_edges(edges: DataFrame) -> DataFrame:
    return edges.withColumn("is_inferred", is_inferred(F.col("confidence")))


def cluster_colour(number: str, palette: list[str]):
    """The palette entry of a cluster number, repeating."""
    return F.element_at(F.array(*(F.lit(c) for c in palette)), (F.pmod(F.col(number), F.lit(len(palette))) + 1).cast("int"))


def error_counts(errors: DataFrame, last: int = 100, pos: str = "pos") -> DataFrame:
    """(severity, n) of the newest ``last`` errors."""
    return errors.orderBy(F.desc(pos)).limit(last).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def export_graph(nodes: DataFrame, edges: DataFrame, viewport: dict, path: str) -> None:
    """Nodes, edges and the viewport as JSON under ``path``."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")
    one = nodes.sparkSession.createDataFrame([(float(viewport["x"]), float(viewport["y"]), float(viewport["zoom"]))], "x double, y double, zoom double")
    one.write.mode("overwrite").json(f"{path}/viewport")


def within_budget(nodes: DataFrame, edges: DataFrame, node_budget: int, edge_budget: int) -> bool:
    return nodes.limit(node_budget + 1).count() <= node_budget and edges.limit(edge_budget + 1).count() <= edge_budget
