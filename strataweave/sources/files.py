"""Source trees as tables: listings, hashes, bundles, call graphs, change lists."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.functions.identity import repo_relative
from strataweave.functions.predicates import in_excluded_dir, supported_source
from strataweave.operators.graph import nearest_marked_dir


def tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, size, modified) of all files below ``root``, paths relative to it."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.sub(r"^file:/*", "/", root).rstrip("/")
    path = repo_relative(F.regexp_replace("path", r"^file:/*", "/"), base)
    return raw.select(path.alias("path"), "content", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def sources(files: DataFrame) -> DataFrame:
    """Files that are indexed: a supported extension, in no excluded directory."""
    return files.filter(supported_source(F.col("path")) & ~in_excluded_dir(F.col("path")))


def omitted(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """Wanted paths that could not be read."""
    return wanted.select("path").join(files.select("path"), "path", "left_anti")


def hashes(files: DataFrame, now: str) -> DataFrame:
    return files.select("path", F.sha2("content", 256).alias("sha256"), "size", F.lit(now).alias("last_seen_at"))


def bundle_files(files: DataFrame, root: str) -> DataFrame:
    """(rel, content) of a bundle's files, relative to its root."""
    own = files.filter(F.startswith("path", F.lit(root.rstrip("/") + "/")))
    return own.select(F.substring("path", F.lit(len(root.rstrip("/")) + 2), F.length("path")).alias("rel"), "content")


def bundle_roots(paths: DataFrame, files: DataFrame, marker: str = "SKILL.md") -> DataFrame:
    """(path, dir): the nearest directory above each path that holds the marker file."""
    marked = files.filter((F.col("path") == marker) | F.endswith("path", F.lit("/" + marker)))
    return nearest_marked_dir(paths, marked.select(F.regexp_replace("path", f"/?{marker}$", "").alias("dir")))


def relevant(paths: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changed paths that can touch a flow (a supported source, or below a bundle), and the others; order is kept."""
    roots = bundle_roots(paths, files).withColumn("__in", F.lit(True)).select("path", "__in")
    marked = paths.join(roots, "path", "left").withColumn("__ok", supported_source(F.col("path")) | F.coalesce("__in", F.lit(False)))
    return marked.filter("__ok").select(*paths.columns), marked.filter("NOT __ok").select(*paths.columns)


def changed_paths(*lists: DataFrame) -> DataFrame:
    """The union of change lists (path), once each: tracked differences and untracked files."""
    return reduce(DataFrame.union, (x.select("path") for x in lists)).distinct()


def to_pairs(nodes: DataFrame) -> DataFrame:
    """A call graph's node map as (symbol_id, node) entries in one array, and back with ``from_pairs``."""
    return nodes.agg(F.collect_list(F.struct("symbol_id", F.struct(*[c for c in nodes.columns if c != "symbol_id"]).alias("node"))).alias("nodes"))


def from_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.inline("nodes")).select("symbol_id", "node.*")


def as_map(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.map_from_entries("nodes").alias("nodes"))


class CallGraphSource:
    """A call graph given as tables; the only thing a parser has to deliver."""

    def __init__(self, nodes: DataFrame, calls: DataFrame, entry_points: DataFrame, files: DataFrame, omitted_files: DataFrame | None = None):
        self.nodes, self.calls, self.entry_points, self.files = nodes, calls, entry_points, files
        self.omitted_files = omitted_files if omitted_files is not None else nodes.select(F.col("file_path").alias("path")).limit(0)

    def anchored_symbols(self, paths: DataFrame) -> DataFrame:
        """Symbols of the given files with their anchors; files that aren't indexed have none."""
        from strataweave.operators.resolve import code_states

        own = self.nodes.join(paths.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi")
        return code_states(own.filter("body_source IS NOT NULL AND name <> '<anonymous>'"))

    def index(self) -> DataFrame:
        from strataweave.operators.resolve import code_states

        return code_states(self.nodes.filter("body_source IS NOT NULL"))

    def source_line(self, sites: DataFrame) -> DataFrame:
        """``sites`` (file, line, …) with the trimmed text there."""
        from strataweave.functions.text import source_line

        text = self.files.select(F.col("path").alias("file"), F.decode("content", "UTF-8").alias("__s"))
        return sites.join(text, "file", "left").withColumn("text", source_line(F.col("__s"), F.col("line"))).drop("__s")
