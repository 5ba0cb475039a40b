"""Incremental maintenance: which flows a change touches, and what becomes of each.

A turn goes by the symbol delta of the changed code files and by what the change does to the closure of stored
flows and entry points, which the store keeps between turns: only keys that a changed edge reaches are walked again.
Sets of members are tables (key, node) throughout; an array is made of a flow's set where it is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.functions.bag import seed_files
from strataweave.functions.identity import DESCRIPTION_PREFIX, anchor, description_id, doc_node_id, flow_path, is_skill_flow, parse_anchor, skill_flow_id
from strataweave.functions.predicates import repo_file, supported_source
from strataweave.operators import bridges, closure, descriptions, resolve, sets
from strataweave.operators import flows as fl
from strataweave.plans import ingest
from strataweave.sources.files import bundle_roots
from strataweave.staging import Cuts, cut

#: Flows hydrated in full at once, and when a sweep is suspiciously large.
HYDRATION_CAP, SWEEP_MIN, SWEEP_SHARE = 50, 25, 0.5


def usable_changes(paths: DataFrame) -> DataFrame:
    """Changed repository paths, once each, sorted."""
    return paths.filter(repo_file(F.col("path"))).select("path").distinct().orderBy("path")


def seeds_of(flows: DataFrame, index: DataFrame) -> DataFrame:
    """(flow_id, symbol_id, pos): stored seeds that today's symbols resolve, in stored order."""
    each = flows.select("flow_id", F.posexplode("entry_points").alias("pos", "path"))
    return each.join(index, "path").select("flow_id", "symbol_id", "pos")


def affected_members(stored: DataFrame, induced: DataFrame, changed_symbols: DataFrame) -> DataFrame:
    """(flow_id, reason) of flows with a member whose body changed, or whose induced members aren't the stored ones any more.

    ``stored`` and ``induced`` are members (flow_id, path), ``changed_symbols`` (path). Flows of
    ``stored`` without induced members, and the other way round, differ.
    """
    body = induced.join(changed_symbols.select("path").distinct(), "path", "left_semi").select("flow_id").distinct().withColumn("reason", F.lit("body"))
    pairs = lambda d: d.select(F.col("flow_id").alias("key"), F.col("path").alias("node"))
    moved = sets.differing(pairs(stored), pairs(induced)).select(F.col("key").alias("flow_id")).distinct().withColumn("reason", F.lit("membership"))
    return body.unionByName(moved)


def seedless(flows: DataFrame, seeds: DataFrame, changed_files: DataFrame) -> DataFrame:
    """(flow_id, reason) of flows none of whose seeds resolves and a file of whose seeds changed."""
    lost = flows.join(seeds.select("flow_id").distinct(), "flow_id", "left_anti").select("flow_id", F.explode(seed_files(F.col("entry_points"))).alias("path"))
    return lost.join(changed_files.select("path").distinct(), "path", "left_semi").select("flow_id").distinct().withColumn("reason", F.lit("seedless"))


def reasons_of(found: DataFrame) -> DataFrame:
    """(flow_id, reasons): the at most three reasons of each flow, sorted."""
    return found.groupBy("flow_id").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def affected(flows: DataFrame, induced: DataFrame, changed_symbols: DataFrame, changed_files: DataFrame) -> DataFrame:
    """(flow_id, reasons) of stored flows (flow_id, anchor_set, entry_points) that a change touches.

    A member's body changed; or the induced members (flow_id, path) are no longer the stored
    ones; or no seed resolves, so nothing is induced, and a seed file was touched. ``changed_symbols`` (path), ``changed_files`` (path).
    """
    live = induced.select("flow_id").distinct()
    stored = flows.join(live, "flow_id", "left_semi").select("flow_id", F.explode("anchor_set").alias("path"))
    found = affected_members(stored, induced.join(flows.select("flow_id"), "flow_id", "left_semi"), changed_symbols)
    return reasons_of(found.unionByName(seedless(flows, live, changed_files)))


def touched_skeletons(members: DataFrame, nodes: DataFrame, files: DataFrame, entry_points: DataFrame) -> DataFrame:
    """(key): entry points that are no tests and whose members (key, node) lie in a changed file."""
    own = nodes.select(F.col("symbol_id").alias("node"), F.col("file_path").alias("path"))
    hit = members.join(own, "node").join(files.select("path").distinct(), "path", "left_semi").select("key").distinct()
    real = entry_points.join(nodes.filter(~F.coalesce("is_test", F.lit(False))).select("symbol_id"), "symbol_id", "left_semi").select(F.col("symbol_id").alias("key"))
    return hit.join(real, "key", "left_semi")


def candidates_for_retirement(flows: DataFrame, seeds: DataFrame, entry_points: DataFrame, member_edges: DataFrame) -> DataFrame:
    """(flow_id) of flows some seed of which resolves, none to an entry point, and that have no member edges."""
    alive = seeds.join(entry_points.select("symbol_id").distinct(), "symbol_id", "left_semi").select("flow_id").distinct()
    out = flows.select("flow_id").join(seeds.select("flow_id").distinct(), "flow_id", "left_semi")
    for no in (alive, member_edges.select("flow_id").distinct()):
        out = out.join(no, "flow_id", "left_anti")
    return out


def subsumed(candidates: DataFrame, members: DataFrame, new_members: DataFrame, seeds: DataFrame, entry_points: DataFrame, member_edges: DataFrame) -> DataFrame:
    """(flow_id) of flows that one new flow absorbs.

    All members are members of the new one; some seed resolves, but none is an entry point any
    more; and it has no member edges of its own. ``members`` (flow_id, node), ``new_members`` (node).
    """
    outside = members.join(new_members.select("node").distinct(), "node", "left_anti").select("flow_id").distinct()
    return candidates_for_retirement(candidates, seeds, entry_points, member_edges).join(outside, "flow_id", "left_anti")


def absorbed(candidates: DataFrame, written: DataFrame, members: DataFrame) -> DataFrame:
    """(flow_id, absorber) of candidates all of whose members some written flow has; of several the first in turn.

    ``candidates`` (flow_id), ``written`` (flow_id, turn) with comparable turns, ``members`` (flow_id, node). Among
    candidates with equal members the first that is written stays and absorbs the others.
    """
    pairs = lambda d: d.select(F.col("flow_id").alias("key"), "node")
    own = pairs(members.join(candidates, "flow_id", "left_semi"))
    found = cut(sets.containments(own, pairs(members.join(written, "flow_id", "left_semi"))))
    turns = written.select(F.col("flow_id").alias("other"), "turn")
    both = found.join(found.select(F.col("key").alias("other"), F.col("other").alias("key")).withColumn("equal", F.lit(True)), ["key", "other"], "left")
    # Equal ones that are both written: only the earlier absorbs. The reverse pair is found where the other is a candidate.
    mine = written.select(F.col("flow_id").alias("key"), F.col("turn").alias("own"))
    valid = both.join(turns, "other").join(mine, "key", "left").filter("equal IS NULL OR own IS NULL OR turn < own")
    return valid.groupBy(F.col("key").alias("flow_id")).agg(F.min_by("other", "turn").alias("absorber"))


def test_rooted(flows: DataFrame, seeds: DataFrame, nodes: DataFrame) -> DataFrame:
    """(flow_id) of flows all of whose stored seeds resolve, to tests only."""
    tests = nodes.select("symbol_id", F.coalesce("is_test", F.lit(False)).alias("is_test"))
    found = seeds.join(tests, "symbol_id").groupBy("flow_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and("is_test").alias("tests"))
    asked = flows.select("flow_id", F.size("entry_points").alias("asked"))
    return found.join(asked, "flow_id").filter("tests AND n = asked AND n > 0").select("flow_id")


def seed_loss(flows: DataFrame, files: DataFrame, corroboration: str, graph_is_empty: bool = False) -> DataFrame:
    """(flow_id, decision, reason) for flows none of whose seeds resolves: retire on proof, else defer.

    ``files`` (path, presence, omitted, symbols): what is known of seed files. ``scoped``: an edit
    touched the seed's file; ``sweep``: none did, so any seed file that is still there defers.
    """
    each = flows.select("flow_id", F.posexplode_outer(seed_files(F.col("entry_points"))).alias("pos", "path")).join(files, "path", "left")
    here = F.col("presence") == "present"
    doubt = (
        F.when(F.lit(graph_is_empty), "empty call graph")
        .when(F.col("omitted"), F.concat(F.lit("seed file omitted from graph: "), "path"))
        .when(F.col("presence") == "indeterminate", F.concat(F.lit("seed file unreadable: "), "path"))
        .when(here & (F.coalesce("symbols", F.lit(0)) == 0), F.concat(F.lit("seed file present but yields no indexed symbols: "), "path"))
        .when(here & F.lit(corroboration == "sweep"), F.concat(F.lit("seed file still present, seed unresolved: "), "path"))
    )
    first = each.withColumn("doubt", doubt).groupBy("flow_id").agg(F.min_by("doubt", F.when(F.col("doubt").isNotNull(), F.coalesce("pos", F.lit(0)))).alias("doubt"))
    return first.select("flow_id", F.when(F.col("doubt").isNull(), "retire").otherwise("defer").alias("decision"), F.coalesce("doubt", F.lit("seed entrypoint gone (deleted or renamed away)")).alias("reason"))


def sweep(flows: DataFrame, seeds: DataFrame, nodes: DataFrame, files: DataFrame, handled: DataFrame, graph_is_empty: bool = False) -> DataFrame:
    """(flow_id, decision, reason) of stale flows that this turn didn't handle.

    Bundles by the presence of their marker file; code flows by test seeds, then by lost seeds.
    An empty call graph leaves code flows alone. ``files`` (path, presence, omitted, symbols).
    """
    rest = flows.join(handled.select("flow_id").distinct(), "flow_id", "left_anti")
    marked = rest.filter(is_skill_flow(F.col("flow_id")) & F.col("skill_root").isNotNull())
    at = marked.withColumn("path", F.concat("skill_root", F.lit("/SKILL.md"))).join(files, "path", "left")
    skill = at.select("flow_id", F.when(F.col("presence") == "present", "keep").when(F.col("presence") == "absent", "retire").otherwise("defer").alias("decision"), F.concat(F.lit("bundle "), "skill_root", F.lit(": marker file "), F.coalesce("presence", F.lit("indeterminate"))).alias("reason"))
    if graph_is_empty:
        return skill.filter("decision <> 'keep'")
    code = rest.filter(~is_skill_flow(F.col("flow_id")))
    tests = test_rooted(code, seeds, nodes)
    lost = code.join(tests, "flow_id", "left_anti").join(seeds.select("flow_id").distinct(), "flow_id", "left_anti")
    rooted = tests.select("flow_id", F.lit("retire").alias("decision"), F.lit("test-rooted flow (test entrypoints are not hydrated)").alias("reason"))
    return skill.filter("decision <> 'keep'").unionByName(rooted).unionByName(seed_loss(lost, files, "sweep"))


def sweep_is_anomalous(decisions: DataFrame, flows: DataFrame) -> bool:
    """Whether a sweep retired at least SWEEP_MIN flows and half of all."""
    gone = decisions.filter("decision = 'retire'").count()
    return gone >= SWEEP_MIN and gone >= SWEEP_SHARE * flows.count()


def hydration_plan(candidates: DataFrame, cap: int = HYDRATION_CAP, order: list[str] | None = None) -> DataFrame:
    """Candidates (flow_id, …) with mode: the first ``cap`` in ``order`` (by id) in full, the rest as stubs."""
    marked = descriptions.capped(candidates, order or ["flow_id"], cap)
    return marked.withColumn("mode", F.when(F.col("within_cap"), "full").otherwise("stub")).drop("within_cap")


def skill_rows(files: DataFrame, now: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of bundles (skill, root, rel, source): their flow rows, members (flow_id, member_id) and bridge candidates of their registries.

    A bundle's members are its documents; a registry's declaration leads to the document that it names.
    """
    docs = files.filter(F.endswith("rel", F.lit(".md")) | F.startswith("rel", F.lit("scripts/")))
    flow_id = skill_flow_id(F.col("skill"))
    members = docs.select(flow_id.alias("flow_id"), doc_node_id(F.col("skill"), F.col("rel")).alias("member_id")).distinct()
    listed = members.groupBy("flow_id").agg(F.array_sort(F.collect_set("member_id")).alias("anchor_set"))
    own = files.select("skill", "root").distinct().withColumn("flow_id", flow_id).join(listed, "flow_id")
    flow = own.select(
        F.col("flow_id").alias("id"), F.col("skill").alias("label"), F.array(doc_node_id(F.col("skill"), F.lit("SKILL.md"))).alias("entry_points"), "anchor_set",
        F.format_string("skill bundle '%s' grouped as one flow", "skill").alias("rationale"), F.lit(now).alias("last_synced_at"), F.col("root").alias("skill_root"),
    )
    told = ingest.declared(files).withColumn("member_id", doc_node_id(F.col("skill"), F.col("to"))).withColumn("flow_id", flow_id).join(members, ["flow_id", "member_id"], "left_semi")
    candidates = told.select(
        F.col("flow_id").alias("src_id"), F.col("member_id").alias("dst_id"), F.format_string("meta.json sub_agents[] declares '%s'", "name").alias("inference_rationale"),
        F.concat("skill", F.lit("/meta.json")).alias("source_file"), "source_range", F.lit("agentic-registry").alias("extractor_id"), F.lit("1").alias("extractor_version"), "ordinal",
    )
    return flow, members, candidates


def re_extract(store, source, code: DataFrame, now: str, extract_raw=None) -> DataFrame:
    """Anchored nodes above the raw tier follow the code of the changed files (path); returns the symbol delta.

    A moved symbol's nodes are re-anchored, a lost one's deleted. ``extract_raw(store, code)`` writes
    the raw rows of the files anew, if it is given; they are invalidated then.
    """
    fresh = cut(resolve.deduplicated_index(source.anchored_symbols(code), "symbol_id")[0].select("symbol_path", "content_hash", "symbol_id"))
    if extract_raw is not None:
        store.invalidate_edges(code)
        store.invalidate_nodes(code)
        extract_raw(store, code)
    held = resolve.preserved_in(store.nodes(), code)
    parsed = parse_anchor(F.col("anchor"))
    own = cut(held.select("id", "kind", parsed["symbol_path"].alias("symbol_path"), parsed["content_hash"].alias("content_hash")))
    delta = cut(resolve.symbol_delta(resolve.baseline_anchors(own)[0], fresh.select("symbol_path", "content_hash")))
    told = cut(resolve.verdicts(own, fresh.select("symbol_path", "content_hash")).filter("action <> 'keep'"))
    if told.isEmpty():
        return delta
    renamed = F.when(F.startswith("id", F.lit(DESCRIPTION_PREFIX)), description_id(F.col("new_path"))).otherwise(F.col("id"))
    moves = told.filter("action = 'rekey'").withColumn("new_id", renamed)
    others = store.nodes().select("id").join(told.select("id"), "id", "left_anti")
    stay = moves.filter("new_id = id").select("id", "new_id", "new_path")
    go = cut(resolve.rekeys(told.filter("action = 'delete'").withColumn("new_id", F.lit(None).cast("string")).unionByName(moves.filter("new_id <> id")), others)[0].select("id", "new_id", "new_path").unionByName(stay))
    hashes = fresh.select(F.col("symbol_path").alias("new_path"), F.col("content_hash").alias("now"))
    rows = held.join(go, "id").join(hashes, "new_path")
    carried = rows.select(F.col("new_id").alias("id"), "kind", F.substring_index("new_path", "#", 1).alias("path"), anchor(F.col("new_path"), F.col("now")).alias("anchor"), *(c for c in held.columns if c not in ("id", "kind", "path", "anchor")))
    carried = cut(carried.select(*held.columns))
    store.soft_delete(told.filter("action = 'delete'").select("id").union(moves.filter("new_id <> id").select("id")), now)
    store.upsert_nodes(carried)
    return delta


def kept_closure(store, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(key, node) that ``seeds`` (key, node) reach along ``edges`` (src, dst), kept in the store from turn to turn.

    The first turn walks the graph, later ones maintain what is there.
    """
    old = store.table("reach")
    edges, seeds = cut(edges.select("src", "dst").distinct()), cut(seeds.select("key", "node").distinct())
    if old.isEmpty():
        now = closure.closure(edges, seeds)
    else:
        change = closure.maintained(old, (store.table("call_edges"), edges), (store.table("reach_seeds"), seeds))
        if change.keys().isEmpty():
            now = old
        else:
            now = cut(change.closure())
        if now is old and sets.differing(pairs_of(store.table("call_edges")), pairs_of(edges)).isEmpty():
            return old
    store.commit(lambda t: {"call_edges": edges, "reach_seeds": seeds, "reach": now})
    return now


def pairs_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("key"), F.col("dst").alias("node"))


def describe(store, source, members: DataFrame, nodes: DataFrame) -> None:
    """Descriptions of ``members`` (symbol_id) that have none for their present content, within one turn's cap."""
    own = nodes.join(members.distinct(), "symbol_id", "left_semi")
    symbols = source.anchored_symbols(own.select(F.col("file_path").alias("path"))).join(members.distinct(), "symbol_id", "left_semi")
    known = descriptions.existing_of(store.nodes())
    texts = cut(descriptions.resolved(descriptions.plan(symbols.select("symbol_path", "content_hash", "name", "docstring"), known.select("symbol_path", "content_hash"))))
    rows = descriptions.side_nodes(texts)
    old = store.nodes().select("id", F.col("attributes").alias("__a"), F.col("field_ownership").alias("__f"), F.col("layer").alias("__l"))
    # What others wrote on a description stays; its anchor follows the content.
    merged = rows.join(old, "id", "left").withColumns({"attributes": F.coalesce("__a", "attributes"), "field_ownership": F.coalesce("__f", "field_ownership"), "layer": F.coalesce("__l", "layer")})
    store.upsert_nodes(cut(merged.select(*rows.columns)))
    store.write_fields(descriptions.rows_of(texts))


def write_skills(store, files: DataFrame, now: str) -> None:
    """Bundles (skill, root, rel, source) as raw rows, flows, member edges and bridges; member edges that a bundle no longer has are deleted."""
    ingest.ingest_all(store, files)
    flow, members, candidates = skill_rows(files, now)
    store.upsert_nodes(cut(fl.flow_rows(flow)))
    fresh = cut(fl.member_edge_rows(members))
    own = store.edges().filter("kind = 'agentic.flow.member'").join(flow.select(F.col("id").alias("src_id")), "src_id", "left_semi")
    store.soft_delete(cut(resolve.stale_edges(own, fresh).select("key")), now, "edges")
    store.upsert_edges(fresh, store.table("edge_provenance").limit(0))
    made, provenance = bridges.build(candidates)
    good = bridges.accepted(made, store.edges(include_deleted=True)).filter("outcome = 'write'").drop("outcome")
    good = cut(good)
    rows = ingest.edge_rows(good, "agentic").withColumns({"origin": F.lit("agentic"), "intent_source": F.lit("bridge")})
    store.upsert_edges(rows, provenance.join(good.select(F.col("key").alias("edge_key")), "edge_key", "left_semi"))


def reconcile(store, source, changes: DataFrame, now: str, dry_run: bool = False, extract_raw=None) -> DataFrame:
    """One turn over changed files (path); returns outcomes (flow_id, action, reason), one for each flow.

    Files below a bundle's marker re-ingest the bundle, unless it is degraded; the others are code. Code flows are
    synced again where a member's body or the members changed, retired or deferred where their seeds are lost;
    new entry points over changed files are hydrated; a flow whose entry points were demoted is retired if a flow written
    in this turn has all its members; a sweep goes over the rest. ``source`` is a CallGraphSource. Unless it is a dry
    run the store moves on by one version; all is decided against the version that the turn began with.
    """
    run = lambda own: turn(own, source, cut(usable_changes(changes)), now, extract_raw)
    if store.staged is not None:  # the transaction around publishes what is cut here
        return run(store)
    with Cuts(changes.sparkSession) as cuts:
        return cuts.keep(store.transaction(run, dry_run))


def turn(s, source, changed: DataFrame, now: str, extract_raw=None) -> DataFrame:
    """``reconcile`` within a transaction of the store."""
    nodes, entry = source.nodes, source.entry_points
    edges = fl.call_edges(source.calls, nodes).select("src", "dst")
    index = cut(fl.path_index(nodes))
    empty = nodes.isEmpty()
    spark = changed.sparkSession
    none = spark.createDataFrame([], "flow_id string, action string, reason string")
    if changed.isEmpty():
        return none

    # Bundles and code.
    texts = source.files.select("path", F.decode("content", "UTF-8").alias("source"))
    roots = cut(bundle_roots(changed, source.files))
    code = cut(changed.join(roots, "path", "left_anti").filter(supported_source(F.col("path"))))
    touched = cut(ingest.bundled(texts, roots)) if not roots.isEmpty() else None
    before = cut(fl.stored_flows(s.nodes()).withColumnRenamed("id", "flow_id"))
    member_edges = cut(s.edges().filter("kind = 'agentic.flow.member'").select(F.col("src_id").alias("flow_id"), F.col("dst_id").alias("path")))
    known = cut(s.nodes().select("id"))
    skills = none
    if touched is not None:
        told = cut(ingest.problems(touched).withColumn("flow_id", skill_flow_id(F.col("skill"))))
        good = told.filter("problem IS NULL").join(before.select("flow_id").withColumn("old", F.lit(True)), "flow_id", "left")
        done = good.select("flow_id", F.when(F.col("old"), "resync").otherwise("hydrate").alias("action"), F.when(F.col("old"), "skill bundle files touched this turn (re-ingested in place)").otherwise("skill bundle first touched this turn").alias("reason"))
        skills = cut(done.unionByName(told.filter("problem IS NOT NULL").select("flow_id", F.lit("defer").alias("action"), F.col("problem").alias("reason"))))
        write_skills(s, cut(touched.join(told.filter("problem IS NULL"), ["skill", "root"], "left_semi")), now)

    # What changed in the code, and what follows for the flows' members.
    delta = re_extract(s, source, code, now, extract_raw)
    modified = delta.filter("bucket = 'modified'").select("symbol_path").join(source.anchored_symbols(code).select("symbol_path", "symbol_id"), "symbol_path").select("symbol_id")
    asked = before.select("flow_id", "entry_points").unionByName(member_edges.groupBy("flow_id").agg(F.collect_set("path").alias("entry_points")))
    seeds = cut(seeds_of(asked, index).select("flow_id", "symbol_id").distinct())
    flow_key, entry_key = F.concat(F.lit("flow:"), "flow_id"), F.concat(F.lit("entry:"), "symbol_id")
    reach = kept_closure(s, edges, seeds.select(flow_key.alias("key"), F.col("symbol_id").alias("node")).union(entry.select(entry_key, "symbol_id")))
    of_flow = cut(reach.filter(F.startswith("key", F.lit("flow:"))).select(F.substring("key", 6, 1 << 30).alias("flow_id"), "node"))
    paths = nodes.select(F.col("symbol_id").alias("node"), flow_path(F.col("file_path"), F.col("name"), F.col("kind")).alias("path"))
    induced = cut(of_flow.join(paths, "node").select("flow_id", "path").distinct())

    # Stored code flows that the change touches.
    plain = before.join(member_edges.select("flow_id").distinct(), "flow_id", "left_anti").filter(~is_skill_flow(F.col("flow_id")))
    tests = cut(test_rooted(before, seeds, nodes))
    live = plain.join(seeds.select("flow_id").distinct(), "flow_id", "left_semi").join(tests, "flow_id", "left_anti")
    stored = live.select("flow_id", F.explode("anchor_set").alias("path"))
    body = of_flow.join(modified.select(F.col("symbol_id").alias("node")), "node", "left_semi").join(paths, "node").select("path")
    hit = affected_members(stored, induced.join(live.select("flow_id"), "flow_id", "left_semi"), body)
    resync = cut(reasons_of(hit))
    lost = cut(seedless(plain, seeds, changed))
    files = known_files(before, source, nodes)
    loss = cut(seed_loss(plain.join(lost, "flow_id", "left_semi"), files, "scoped", empty))

    # New entry points over changed code.
    reached = reach.filter(F.startswith("key", F.lit("entry:"))).select(F.substring("key", 7, 1 << 30).alias("key"), "node")
    new = touched_skeletons(reached, nodes, code, entry)
    named = new.join(paths.select(F.col("node").alias("key"), F.col("path").alias("flow_id")), "key")
    named = named.join(fl.claimed(before.withColumnRenamed("flow_id", "id")), "flow_id", "left_anti")
    sized = reached.join(named, "key").groupBy("flow_id", "key").agg(F.count(F.lit(1)).alias("member_count"))
    first = sized.groupBy("flow_id").agg(F.min(F.struct((-F.col("member_count")).alias("less"), "key")).alias("best"))
    hydrate = cut(hydration_plan(first.select("flow_id", F.col("best.key").alias("key"), F.col("best.less").alias("less")), order=["less", "flow_id"]))

    # Flows that others written in this turn absorb.
    written = resync.select("flow_id", F.struct(F.lit(0).alias("phase"), F.lit(0).cast("long").alias("less"), "flow_id").alias("turn"))
    written = cut(written.unionByName(hydrate.select("flow_id", F.struct(F.lit(1).alias("phase"), F.col("less").cast("long").alias("less"), "flow_id").alias("turn"))))
    gone = none
    if not written.isEmpty():
        demoted = candidates_for_retirement(before, seeds, entry, member_edges)
        news = reached.join(hydrate.select("key", "flow_id"), "key").select("flow_id", "node")
        found = cut(absorbed(demoted, written, of_flow.unionByName(news)))
        gone = found.select("flow_id", F.lit("retire").alias("action"), F.concat(F.lit("seed entrypoint demoted; subsumed by "), "absorber").alias("reason"))

    outcomes = resync.select("flow_id", F.lit("resync").alias("action"), F.array_join("reasons", ",").alias("reason"))
    outcomes = outcomes.unionByName(loss.select("flow_id", F.col("decision").alias("action"), "reason"))
    outcomes = outcomes.unionByName(hydrate.select("flow_id", F.concat(F.lit("hydrate-"), "mode").alias("action"), F.lit("touched").alias("reason")))
    outcomes = cut(skills.unionByName(outcomes.join(gone.select("flow_id"), "flow_id", "left_anti").unionByName(gone)))
    swept = sweep(before, seeds, nodes, files, outcomes, empty).select("flow_id", F.col("decision").alias("action"), "reason")
    outcomes = cut(outcomes.unionByName(swept))

    # Writes.
    again = outcomes.filter("action = 'resync'").join(skills.select("flow_id"), "flow_id", "left_anti").select("flow_id")
    full = outcomes.filter("action = 'hydrate-full'").select("flow_id").union(again)
    sets_of = lambda d: d.groupBy("flow_id").agg(F.array_sort(F.collect_set("path")).alias("anchor_set"))
    update = before.drop("anchor_set", "member_count", "last_synced_at").join(again, "flow_id", "left_semi").join(sets_of(induced.join(again, "flow_id", "left_semi")), "flow_id")
    fresh = hydrate.join(outcomes.filter(F.startswith("action", F.lit("hydrate-"))), "flow_id", "left_semi").select("flow_id", "key")
    made = fresh.join(reached, "key").join(paths, "node").select("flow_id", "path").distinct()
    label = F.substring_index("flow_id", "#", -1)
    rows = update.select("flow_id", "label", "entry_points", "anchor_set", "rationale", F.lit(now).alias("last_synced_at"))
    rows = rows.unionByName(sets_of(made).select("flow_id", label.alias("label"), F.array("flow_id").alias("entry_points"), "anchor_set", F.lit(None).cast("string").alias("rationale"), F.lit(now).alias("last_synced_at")))
    if not written.isEmpty():
        s.upsert_nodes(cut(fl.flow_rows(rows.withColumnRenamed("flow_id", "id"))))
    ended = cut(outcomes.filter("action = 'retire'").join(known.withColumnRenamed("id", "flow_id"), "flow_id", "left_semi").select("flow_id"))
    if not ended.isEmpty():
        s.soft_delete(ended, now)
    members = of_flow.join(full, "flow_id", "left_semi").select("node").union(fresh.join(full, "flow_id", "left_semi").join(reached, "key").select("node"))
    if not written.isEmpty():
        describe(s, source, cut(members.select(F.col("node").alias("symbol_id")).distinct()), nodes)
    return outcomes


def known_files(flows: DataFrame, source, nodes: DataFrame) -> DataFrame:
    """(path, presence, omitted, symbols) of the files of stored seeds and of bundles' markers."""
    sizes = nodes.groupBy(F.col("file_path").alias("path")).agg(F.count(F.lit(1)).alias("symbols"))
    listed = source.files.select("path").distinct().withColumn("presence", F.lit("present"))
    omitted = source.omitted_files.select("path").distinct().withColumn("omitted", F.lit(True))
    asked = flows.select(F.explode(seed_files(F.col("entry_points"))).alias("path")).union(flows.filter("skill_root IS NOT NULL").select(F.concat("skill_root", F.lit("/SKILL.md")))).distinct()
    known = asked.join(listed, "path", "left").join(omitted, "path", "left").join(sizes, "path", "left")
    return cut(known.withColumns({"presence": F.coalesce("presence", F.lit("absent")), "omitted": F.coalesce("omitted", F.lit(False)), "symbols": F.coalesce("symbols", F.lit(0))}))


def deferred_again(deferred: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Deferrals that are still open after a turn, the newest reason standing; a later turn tries them again."""
    now = outcomes.filter("action = 'defer'").select("flow_id", "reason", F.lit(1).alias("turn"))
    settled = outcomes.filter("action <> 'defer'").select("flow_id").distinct()
    old = deferred.select("flow_id", "reason").withColumn("turn", F.lit(0)).join(settled, "flow_id", "left_anti")
    return old.unionByName(now).groupBy("flow_id").agg(F.min_by("reason", F.struct(-F.col("turn"), "reason")).alias("reason"))
