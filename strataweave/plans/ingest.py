"""Document bundles as graph rows: frontmatter, links, sub-agents.

The files of all bundles are one table (skill, root, rel, source): a bundle is a key that links, registries and
rows carry, so a thousand bundles are one plan and one version. A bundle with very many files is no
hot key: joins go by bundle and path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.functions.extract import frontmatter, markdown_links, sub_agents
from strataweave.functions.identity import doc_node_id, posix_dirname, posix_normalize
from strataweave.functions.predicates import bundle_problem, external_target, skill_edge_kind
from strataweave.operators.bridges import build

EXTRACTOR, EXTRACTOR_VERSION = "skill-ingest", "1"
BUNDLE = ["skill", "root"]


def of_bundle(files: DataFrame, skill: str, root: str) -> DataFrame:
    """The files (rel, source) of one bundle as a table of bundles."""
    return files.select(F.lit(skill).alias("skill"), F.lit(root.rstrip("/")).alias("root"), "rel", "source")


def bundled(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Files (path, source) below ``roots`` (dir), as (skill, root, rel, source). A bundle goes by the name of its directory;
    a file below several of them is in each."""
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    own = files.select("path", "source", F.explode(ups).alias("root")).join(roots.select(F.col("dir").alias("root")).distinct(), "root", "left_semi")
    rel = F.when(F.col("root") == "", F.col("path")).otherwise(F.expr("substring(path, length(root) + 2)"))
    return own.select(F.substring_index("root", "/", -1).alias("skill"), "root", rel.alias("rel"), "source")


def full_path(root, rel):
    return F.when(root == "", rel).otherwise(F.concat(root, F.lit("/"), rel))


def resolved_target(rel, target):
    """A link's target as a path within the bundle."""
    base = posix_dirname(rel)
    return posix_normalize(F.when(base == "", target).otherwise(F.concat(base, F.lit("/"), target)))


def nodes(files: DataFrame) -> DataFrame:
    """Node rows of the bundles' text files; SKILL.md carries its frontmatter."""
    null = F.lit(None).cast("string")
    hub = F.col("rel") == "SKILL.md"
    return files.filter(F.endswith("rel", F.lit(".md")) | F.startswith("rel", F.lit("scripts/"))).select(
        doc_node_id(F.col("skill"), F.col("rel")).alias("id"),
        F.when(hub, "skill.hub").when(F.startswith("rel", F.lit("scripts/")), "skill.script").otherwise("skill.reference").alias("kind"),
        full_path(F.col("root"), F.col("rel")).alias("path"), null.alias("anchor"), F.lit("raw").alias("layer"),
        F.when(hub, frontmatter(F.col("source"))).otherwise("{}").alias("attributes"), F.create_map().cast("map<string,string>").alias("field_ownership"),
        F.lit("extractor").alias("origin"), F.lit("skill").alias("intent_source"), null.alias("deleted_at"),
    )


def declared(files: DataFrame) -> DataFrame:
    """(skill, root, name, file, source_range, ordinal, to) of declared sub-agents; ``to`` is their file as a path within the bundle, null outside it."""
    asked = sub_agents(files.filter("rel = 'meta.json'"), "source", BUNDLE)
    to = posix_normalize(F.replace("file", F.lit("\\"), F.lit("/")))
    inside = F.col("file").isNotNull() & ~external_target(F.col("file")) & (to != "") & ~F.startswith(to, F.lit(".."))
    return asked.withColumn("to", F.when(inside, to))


def edges(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and provenance of links between a bundle's files and of declared sub-agents.

    Links to anything outside the bundle are left out; links between two references are
    doc-literal edges, others lead from the hub.
    """
    known = files.select("skill", "root", F.col("rel").alias("to")).distinct()
    links = markdown_links(files.filter(F.endswith("rel", F.lit(".md"))), "source", [*BUNDLE, "rel"]).filter(~external_target(F.col("target")))
    links = links.withColumn("to", resolved_target(F.col("rel"), F.col("target"))).join(known, [*BUNDLE, "to"], "left_semi").filter("to <> rel")
    kind = F.when(F.col("rel") == "SKILL.md", skill_edge_kind(F.col("to"))).otherwise("code.literal-doc")
    agents = declared(files).join(known, [*BUNDLE, "to"], "left_semi").withColumn("rel", F.lit("meta.json"))
    each = links.select("skill", "rel", "to", kind.alias("kind"), "source_range").unionByName(agents.select("skill", "rel", "to", F.lit("skill.to_subagent").alias("kind"), "source_range"))
    src = F.when(F.col("kind") == "skill.to_subagent", F.lit("SKILL.md")).otherwise(F.col("rel"))
    rows = each.select(
        "kind", doc_node_id(F.col("skill"), src).alias("src_id"), doc_node_id(F.col("skill"), F.col("to")).alias("dst_id"), F.lit(None).cast("string").alias("inference_rationale"),
        F.col("rel").alias("source_file"), "source_range", F.lit(EXTRACTOR).alias("extractor_id"), F.lit(EXTRACTOR_VERSION).alias("extractor_version"), F.struct("rel", "source_range").alias("ordinal"),
    )
    made = [build(rows.filter(F.col("kind") == k), k, ("source_file", "source_range")) for k in ("skill.to_reference", "skill.to_script", "skill.to_subagent", "code.literal-doc")]
    out, prov = made[0]
    for e, p in made[1:]:
        out, prov = out.unionByName(e), prov.unionByName(p)
    return out, prov


def edge_rows(edges_: DataFrame, layer: str = "raw") -> DataFrame:
    null = F.lit(None).cast("string")
    return edges_.select(
        "key", "src_id", "dst_id", "kind", F.lit(1.0).alias("confidence"), F.lit(layer).alias("layer"), F.lit("{}").alias("attributes"), F.create_map().cast("map<string,string>").alias("field_ownership"),
        F.lit("extractor").alias("origin"), F.lit("skill").alias("intent_source"), null.alias("adjudication"), null.alias("deleted_at"),
    )


def ingest_all(store, files: DataFrame) -> None:
    """Replaces the raw rows of all bundles of ``files`` (skill, root, rel, source) in one version; the same bundles again change nothing.

    An edge's provenance names a file within its bundle, so raw edges go by the bundle they lead from.
    """
    own = files.select(full_path(F.col("root"), F.col("rel")).alias("path"))
    docs = files.select(doc_node_id(F.col("skill"), F.col("rel")).alias("src_id")).distinct()

    def work(s) -> None:
        gone = s.table("edges").filter("layer = 'raw' AND intent_source = 'skill'").join(docs, "src_id", "left_semi").select("key")
        s.commit(lambda t: {"edges": t["edges"].join(gone, "key", "left_anti"), "edge_provenance": t["edge_provenance"].join(gone.withColumnRenamed("key", "edge_key"), "edge_key", "left_anti")})
        s.invalidate_nodes(own)
        s.upsert_nodes(nodes(files))
        made, prov = edges(files)
        s.upsert_edges(edge_rows(made), prov)

    store.transaction(work)


def ingest(store, files: DataFrame, skill: str, root: str) -> None:
    """``ingest_all`` of one bundle (rel, source)."""
    ingest_all(store, of_bundle(files, skill, root))


def missing_files(files: DataFrame) -> DataFrame:
    """(skill, root, missing): the first declared sub-agent file of each bundle that the bundle lacks."""
    lacking = declared(files).filter("to IS NOT NULL").join(files.select("skill", "root", F.col("rel").alias("to")).distinct(), [*BUNDLE, "to"], "left_anti")
    return lacking.groupBy(*BUNDLE).agg(F.min_by("file", "ordinal").alias("missing"))


def problems(files: DataFrame) -> DataFrame:
    """(skill, root, problem) of each bundle: why it can't be trusted, or null."""
    text = lambda name, to: F.max(F.when(F.col("rel") == name, F.col("source"))).alias(to)
    own = files.filter("rel IN ('SKILL.md', 'meta.json')").groupBy(*BUNDLE).agg(text("SKILL.md", "hub"), text("meta.json", "meta"))
    every = files.select(*BUNDLE).distinct().join(own, BUNDLE, "left").join(missing_files(files), BUNDLE, "left")
    return every.select(*BUNDLE, bundle_problem(F.col("hub"), F.col("meta"), F.col("missing")).alias("problem"))
