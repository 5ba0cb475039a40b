"""A versioned graph store: Parquet tables and one pointer that says which version is current.

A commit writes the tables that it changed for version n + 1, notes for each table which version's folder holds
it, and then renames the pointer, so readers see one version whole, a failed writer leaves the old one in force
and an untouched table is never written again. A reader pins its version when it opens; ``vacuum`` removes folders that
no kept version points at. Rows are sorted by path or source within files and
partitioned by layer, so that file statistics serve lookups.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.functions import bag
from strataweave.operators import ladder
from strataweave.schema import DISPOSABLE, KEYS, SCHEMA_VERSION, TABLES

Tables = dict[str, DataFrame]
_SORT = {"nodes": ["path"], "edges": ["src_id"], "edge_provenance": ["source_file"], "file_hashes": ["path"], "anchor_resolution": ["anchor"], "call_edges": ["src"], "reach_seeds": ["key"], "reach": ["key"]}


def replaced(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those that share their key."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


class Files:
    """Small files and renames through Hadoop's file system, whatever store the path names."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> str | None:
        fs, p = self._at(path)
        if not fs.exists(p):
            return None
        fs.setVerifyChecksum(False)  # other tools write these files too, and leave side files behind
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Replaces the file by one rename of a written temporary file."""
        fs, p = self._at(path)
        temp = self.jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
        out = fs.create(temp, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        overwrite = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        names = self.jvm.java.lang.reflect.Array.newInstance(overwrite.getClass(), 1)
        names[0] = overwrite
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.conf).rename(fs.makeQualified(temp), fs.makeQualified(p), names)

    def create_new(self, path: str, text: str) -> bool:
        """Creates the file; False if it is there already."""
        fs, p = self._at(path)
        if fs.exists(p):
            return False
        try:
            out = fs.create(p, False)
        except Exception:
            if fs.exists(p):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def rename(self, a: str, b: str) -> bool:
        fs, p = self._at(a)
        return fs.exists(p) and fs.rename(p, self.jvm.org.apache.hadoop.fs.Path(b))

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


class NullStore:
    """An empty store: reads find nothing, writes do nothing, every file counts as changed."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def table(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([], TABLES[name])

    def nodes(self, include_deleted: bool = False) -> DataFrame:
        return self.table("nodes")

    def edges(self, include_deleted: bool = False) -> DataFrame:
        return self.table("edges")

    def snapshot(self, include_deleted: bool = False) -> tuple[DataFrame, DataFrame]:
        return self.nodes(), self.edges()

    def schema_version(self) -> int:
        return 0

    def changed_files(self, hashes: DataFrame) -> DataFrame:
        return hashes.select("path").distinct()

    def commit(self, change: Callable[[Tables], Tables]) -> None:
        return None


class GraphStore:
    def __init__(self, spark: SparkSession, path: str, read_only: bool = False, version: int | None = None):
        self.spark, self.path, self.read_only, self.files = spark, path.rstrip("/"), read_only, Files(spark)
        self.version = self._current() if version is None else version
        #: Tables of an open transaction, which later calls within it read and change.
        self.staged: Tables | None = None
        #: The version whose notes were read last, and which version's folder holds each of its tables.
        self.folders: tuple[int, dict[str, int]] | None = None

    @staticmethod
    def open(spark: SparkSession, path: str, read_only: bool = False) -> GraphStore | NullStore:
        """The store at ``path`` at its current version; a missing one is empty to readers and made for writers."""
        files = Files(spark)
        if not files.exists(f"{path.rstrip('/')}/_CURRENT"):
            if read_only:
                return NullStore(spark)
            own = GraphStore(spark, path)
            own._publish({n: spark.createDataFrame([], t) for n, t in TABLES.items()})
            return own
        own = GraphStore(spark, path, read_only)
        if not read_only and own.schema_version() != SCHEMA_VERSION:
            own._renew_disposable()
        return own

    # -- reads ---------------------------------------------------------------

    def _current(self) -> int:
        return int(self.files.read(f"{self.path}/_CURRENT") or 0)

    def _meta(self) -> dict:
        return json.loads(self.files.read(f"{self.path}/v={self.version}/_meta.json") or "{}")

    def _folder(self, name: str) -> str:
        """Where this version's table lies: the folder of the version that wrote it last."""
        if self.folders is None or self.folders[0] != self.version:
            self.folders = self.version, self._meta().get("tables", {})
        return f"{self.path}/v={self.folders[1].get(name, self.version)}/{name}"

    def table(self, name: str) -> DataFrame:
        if self.staged is not None:
            return self.staged[name]
        path = self._folder(name)
        # A store of an older schema lacks tables that were added since.
        return self.spark.read.schema(TABLES[name]).parquet(path) if self.files.exists(path) else self.spark.createDataFrame([], TABLES[name])

    def nodes(self, include_deleted: bool = False) -> DataFrame:
        rows = self.table("nodes")
        return rows if include_deleted else rows.filter("deleted_at IS NULL")

    def edges(self, include_deleted: bool = False) -> DataFrame:
        rows = self.table("edges")
        return rows if include_deleted else rows.filter("deleted_at IS NULL")

    def snapshot(self, include_deleted: bool = False) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges of one version."""
        return self.nodes(include_deleted), self.edges(include_deleted)

    def node(self, id_: str) -> DataFrame:
        return self.nodes().filter(F.col("id") == id_).limit(1)

    def provenance_for_edge(self, key: str) -> DataFrame:
        return self.table("edge_provenance").filter(F.col("edge_key") == key)

    def edges_for_files(self, files: DataFrame) -> DataFrame:
        """Live edges with provenance in ``files`` (path)."""
        return edges_for_files(self.edges(), self.table("edge_provenance"), files)

    def table_disposition(self) -> DataFrame:
        """(table_name, disposable) of the registry, external registrations too, sorted."""
        found = {**DISPOSABLE, **self._meta().get("registry", {})}
        return self.spark.createDataFrame(sorted(found.items()), "table_name string, disposable boolean").orderBy("table_name")

    def schema_version(self) -> int:
        return int(self._meta().get("schema_version", 0))

    def validated(self, name: str) -> DataFrame:
        """A table whose rows are checked as they are read: unknown layers and bags that are no objects raise."""
        rows = self.table(name)
        bad = F.raise_error(F.concat(F.lit("unknown layer: "), F.coalesce("layer", F.lit("null")))).cast("string")
        return rows.withColumns({"layer": F.when(F.col("layer").isin("raw", "agentic", "user"), F.col("layer")).otherwise(bad), "attributes": bag.checked(F.col("attributes"))})

    def changed_files(self, hashes: DataFrame) -> DataFrame:
        """Paths of ``hashes`` (path, sha256) that are new or differ from what was recorded."""
        return hashes.join(self.table("file_hashes").select("path", "sha256"), ["path", "sha256"], "left_anti").select("path").distinct()

    # -- writes --------------------------------------------------------------

    def transaction(self, work: Callable[[GraphStore], object], dry_run: bool = False) -> object:
        """Runs ``work`` over staged tables and publishes them at once; a failure or a dry run leaves the version as it is.

        One writer at a time holds the lock; a call inside another transaction joins it.
        """
        if self.read_only:
            raise PermissionError("the store was opened read-only")
        if self.staged is not None:
            return work(self)
        with Lock(self.files, f"{self.path}/_LOCK"):
            self.version = self._current()
            old = {n: self.table(n) for n in TABLES}
            self.staged = dict(old)
            try:
                out = work(self)
                if not dry_run:
                    self._publish({n: rows for n, rows in self.staged.items() if rows is not old[n]})
                return out
            finally:
                self.staged = None

    def commit(self, change: Callable[[Tables], Tables]) -> None:
        def work(own: GraphStore) -> None:
            own.staged |= change(dict(own.staged))

        self.transaction(work)

    def upsert_nodes(self, rows: DataFrame) -> None:
        """Whole rows replace those of their id; a deleted row comes back if the new one lives."""
        self.commit(lambda t: {"nodes": replaced(t["nodes"], rows, KEYS["nodes"])})

    def upsert_edges(self, rows: DataFrame, provenance: DataFrame) -> None:
        """Edges and all their provenance are replaced."""
        keys = rows.select(F.col("key").alias("edge_key")).distinct()
        self.commit(lambda t: {"edges": replaced(t["edges"], rows, KEYS["edges"]), "edge_provenance": t["edge_provenance"].join(keys, "edge_key", "left_anti").unionByName(provenance)})

    def write_fields(self, writes: DataFrame, table: str = "nodes") -> DataFrame:
        """Ladder writes (target, field, value, tier); returns what was skipped."""
        skipped: list[DataFrame] = []

        def change(t: Tables) -> Tables:
            own = t[table] if table == "nodes" else t[table].withColumnRenamed("key", "id")
            out, left = ladder.write_fields(own, writes)
            skipped.append(left)
            return {table: out if table == "nodes" else out.withColumnRenamed("id", "key")}

        self.commit(change)
        return skipped[0]

    def record_hashes(self, hashes: DataFrame) -> None:
        self.commit(lambda t: {"file_hashes": replaced(t["file_hashes"], hashes, KEYS["file_hashes"])})

    def invalidate_edges(self, files: DataFrame) -> None:
        """Raw edges with any provenance in ``files`` go, with their provenance."""

        def change(t: Tables) -> Tables:
            gone = edges_for_files(t["edges"].filter("layer = 'raw'"), t["edge_provenance"], files).select("key")
            return {"edges": t["edges"].join(gone, "key", "left_anti"), "edge_provenance": t["edge_provenance"].join(gone.withColumnRenamed("key", "edge_key"), "edge_key", "left_anti")}

        self.commit(change)

    def invalidate_nodes(self, files: DataFrame) -> None:
        """Raw nodes of ``files`` go."""

        def change(t: Tables) -> Tables:
            gone = t["nodes"].filter("layer = 'raw'").join(files.select("path").distinct(), "path", "left_semi").select("id")
            return {"nodes": t["nodes"].join(gone, "id", "left_anti")}

        self.commit(change)

    def soft_delete(self, ids: DataFrame, now: str, table: str = "nodes") -> None:
        """Rows above the raw tier get a time of deletion."""
        key = KEYS[table][0]

        def change(t: Tables) -> Tables:
            hit = t[table].join(ids.select(F.col(ids.columns[0]).alias(key)).distinct().withColumn("__hit", F.lit(True)), key, "left")
            at = F.when(F.col("__hit") & (F.col("layer") != "raw"), F.lit(now)).otherwise(F.col("deleted_at"))
            return {table: hit.withColumn("deleted_at", at).select(*TABLES[table].names)}

        self.commit(change)

    def rebuild_layer(self, layer: str, write: Callable[[GraphStore], object]) -> None:
        """Live rows of a tier and all disposable tables go, then ``write`` fills the tier; all in one version."""

        def work(own: GraphStore) -> None:
            t = own.staged
            keep = ~((F.col("layer") == layer) & F.col("deleted_at").isNull())
            t["nodes"], t["edges"] = t["nodes"].filter(keep), t["edges"].filter(keep)
            t["edge_provenance"] = t["edge_provenance"].join(t["edges"].select(F.col("key").alias("edge_key")), "edge_key", "left_semi")
            for name, disposable in DISPOSABLE.items():
                if disposable:
                    t[name] = own.spark.createDataFrame([], TABLES[name])
            write(own)

        self.transaction(work)

    def register_table(self, name: str, disposable: bool) -> None:
        """Notes an external table in the registry; it survives re-initialisation."""
        with Lock(self.files, f"{self.path}/_LOCK"):
            self.version = self._current()
            meta = self._meta()
            meta.setdefault("registry", {})[name] = disposable
            self.files.write(f"{self.path}/v={self.version}/_meta.json", json.dumps(meta))

    def _renew_disposable(self) -> None:
        empty = {n: self.spark.createDataFrame([], TABLES[n]) for n, d in DISPOSABLE.items() if d}
        self.transaction(lambda own: own.staged.update(empty))

    def _publish(self, tables: Tables) -> None:
        """Writes what changed as the next version; a commit that changed nothing makes none."""
        if not tables and self.version:
            return
        meta = self._meta() if self.version else {}
        to = self._current() + 1
        folder = f"{self.path}/v={to}"
        self.files.delete(folder)  # what a failed writer left
        # A table that an older schema lacked begins empty.
        held = {n: meta.get("tables", {}).get(n, self.version) for n in TABLES} if self.version else {}
        for name, rows in tables.items():
            rows.select(*TABLES[name].names).sortWithinPartitions(*_SORT[name]).write.parquet(f"{folder}/{name}")
            held[name] = to
        self.files.write(f"{folder}/_meta.json", json.dumps({"schema_version": SCHEMA_VERSION, "registry": meta.get("registry", {}), "tables": held}))
        self.files.write(f"{self.path}/_CURRENT", str(to))
        # Told last, for those who follow the store; a version that a crash left untold is in the next one's span.
        told = [int(n[1:-5]) for n in self.files.names(f"{self.path}/versions") if n.startswith("v") and n.endswith(".json")]
        self.files.write(f"{self.path}/versions/v{to}.json", json.dumps({"version": to, "since": max(told, default=0)}))
        self.version = to

    def diff(self, since: int, to: int | None = None) -> DataFrame:
        """(table, key, change) of rows that were added, removed or changed between two versions; version 0 is empty.

        Only tables that were written in between are read; each side's rows are compared by one aggregate over keys.
        """
        ends = [GraphStore(self.spark, self.path, read_only=True, version=v) if v else NullStore(self.spark) for v in (since, self.version if to is None else to)]
        out = self.spark.createDataFrame([], "table string, key string, change string")
        for name in TABLES:
            if all(isinstance(e, GraphStore) for e in ends) and ends[0]._folder(name) == ends[1]._folder(name):
                continue
            plain = [F.array_sort(F.map_entries(f.name)).alias(f.name) if f.dataType.typeName() == "map" else F.col(f.name) for f in TABLES[name].fields]
            key = F.concat_ws("\u001f", *KEYS[name]).alias("key")
            both = [e.table(name).select(key, F.sha2(F.to_json(F.struct(*plain)), 256).alias(side)) for e, side in zip(ends, "ab", strict=True)]
            held = both[0].unionByName(both[1], allowMissingColumns=True).groupBy("key").agg(F.max("a").alias("a"), F.max("b").alias("b"))
            change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
            out = out.unionByName(held.select(F.lit(name).alias("table"), "key", change.alias("change")).filter("change IS NOT NULL"))
        return out

    def versions(self) -> list[int]:
        """Versions that can be read."""
        return sorted(int(n[2:]) for n in self.files.names(self.path) if n.startswith("v=") and self.files.exists(f"{self.path}/{n}/_meta.json"))

    def vacuum(self, keep: int = 1) -> None:
        """Keeps the newest ``keep`` versions; tables of others go unless a kept version points at them."""
        with Lock(self.files, f"{self.path}/_LOCK"):
            found = [v for v in self.versions() if v <= self._current()]
            kept = found[-max(keep, 1) :]
            used = {f"v={v}/_meta.json" for v in kept}
            for v in kept:
                tables = json.loads(self.files.read(f"{self.path}/v={v}/_meta.json") or "{}").get("tables", {})
                used |= {f"v={tables.get(n, v)}/{n}" for n in TABLES}
            for v in found:
                for name in self.files.names(f"{self.path}/v={v}"):
                    if f"v={v}/{name}" not in used:
                        self.files.delete(f"{self.path}/v={v}/{name}")
                if not self.files.names(f"{self.path}/v={v}"):
                    self.files.delete(f"{self.path}/v={v}")


def edges_for_files(edges: DataFrame, provenance: DataFrame, files: DataFrame) -> DataFrame:
    """Edges with any provenance in ``files`` (path), once each."""
    keys = provenance.join(files.select(F.col("path").alias("source_file")).distinct(), "source_file", "left_semi").select(F.col("edge_key").alias("key")).distinct()
    return edges.join(keys, "key", "left_semi")


class Lock:
    """One writer at a time: a file that only one can create; waits up to ``wait`` seconds.

    The holder renews its lease while it works. A lease that has run out, of a writer that crashed, is
    taken away by a rename that one waiter wins; an unreadable lock counts from when it is first seen.
    """

    def __init__(self, files: Files, path: str, wait: float = 10, poll: float = 0.25, lease: float = 60):
        self.files, self.path, self.wait, self.poll, self.lease = files, path, wait, poll, lease
        self.owner, self.done = uuid.uuid4().hex, threading.Event()
        self.unreadable: float | None = None

    def _text(self) -> str:
        return json.dumps({"owner": self.owner, "until": time.time() + self.lease})

    def _held(self) -> dict:
        try:
            found = json.loads(self.files.read(self.path) or "null")
            return found if isinstance(found, dict) else {}
        except ValueError:
            return {}

    def _take_away(self) -> None:
        until = self._held().get("until")
        if until is None:
            self.unreadable = self.unreadable or time.time()
            until = self.unreadable + self.lease
        if until < time.time() and self.files.rename(self.path, gone := f"{self.path}.{uuid.uuid4().hex}.stale"):
            self.files.delete(gone)

    def _renew(self) -> None:
        while not self.done.wait(self.lease / 3):
            if self._held().get("owner") == self.owner:
                self.files.write(self.path, self._text())

    def __enter__(self) -> Lock:
        end = time.monotonic() + self.wait
        while not self.files.create_new(self.path, self._text()):
            if time.monotonic() > end:
                raise TimeoutError(f"{self.path} is held by another writer")
            self._take_away()
            time.sleep(self.poll)
        self.renewal = threading.Thread(target=self._renew, daemon=True)
        self.renewal.start()
        return self

    def __exit__(self, *_) -> None:
        self.done.set()
        self.renewal.join()
        if self._held().get("owner") == self.owner:
            self.files.delete(self.path)
