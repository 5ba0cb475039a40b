"""Identities: symbol paths, anchors, edge keys, group and description ids, run ids, paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes of stored ids, shared with existing stores.
GROUP_PREFIX = "agentic.group:file:"
DESCRIPTION_PREFIX = "agentic.description:"
FLOW_PREFIX = "agentic.flow:"
SKILL_FLOW_PREFIX = "agentic.flow:skill:"
UNATTRIBUTED = "agentic.flow:unattributed"
EXTERNAL_GROUP = "<external>"


def symbol_path(file: Column, enclosing: Column, name: Column, kind: Column) -> Column:
    """``<file>#<enclosing.>*<name>:<kind>``."""
    return F.concat(file, F.lit("#"), F.array_join(F.concat(F.coalesce(enclosing, F.array().cast("array<string>")), F.array(name)), "."), F.lit(":"), kind)


def flow_path(file: Column, name: Column, kind: Column) -> Column:
    """The symbol path of the flow layer, which leaves the enclosing chain out."""
    return F.concat(file, F.lit("#"), name, F.lit(":"), kind)


def anchor(path: Column, content_hash: Column) -> Column:
    return F.concat(path, F.lit(":"), content_hash)


_ANCHOR = r"(?s)^(.+):([0-9a-f]{64})$"


def parse_anchor(value: Column) -> Column:
    """struct(symbol_path, content_hash), split at the last colon; raises on a malformed anchor, null stays null."""
    parsed = F.struct(F.regexp_extract(value, _ANCHOR, 1).alias("symbol_path"), F.regexp_extract(value, _ANCHOR, 2).alias("content_hash"))
    broken = F.raise_error(F.concat(F.lit("malformed anchor: "), value)).cast("struct<symbol_path:string,content_hash:string>")
    return F.when(value.isNull(), F.lit(None).cast("struct<symbol_path:string,content_hash:string>")).when(value.rlike(_ANCHOR), parsed).otherwise(broken)


def file_of(path: Column) -> Column:
    """What stands before the first ``#``; raises without one."""
    return F.when(F.contains(path, F.lit("#")), F.substring_index(path, "#", 1)).otherwise(F.raise_error(F.concat(F.lit("no # in symbol path: "), path)).cast("string"))


def member_name(path: Column) -> Column:
    """The bare name: after ``#``, before ``:``, after the last dot."""
    after = F.regexp_replace(path, r"(?s)^[^#]*#", "")
    return F.substring_index(F.substring_index(after, ":", 1), ".", -1)


def display_name(path: Column) -> Column:
    return member_name(path)


def edge_key(kind: Column, src: Column, dst: Column) -> Column:
    return F.concat(kind, F.lit(":"), src, F.lit("->"), dst)


def group_id(file: Column) -> Column:
    return F.concat(F.lit(GROUP_PREFIX), file)


def description_id(path: Column) -> Column:
    return F.concat(F.lit(DESCRIPTION_PREFIX), path)


def skill_flow_id(name: Column) -> Column:
    return F.concat(F.lit(SKILL_FLOW_PREFIX), name)


def doc_node_id(skill: Column, rel: Column) -> Column:
    return F.concat(skill, F.lit("/"), rel, F.lit("#doc"))


def is_skill_flow(id_: Column) -> Column:
    return F.startswith(id_, F.lit(SKILL_FLOW_PREFIX))


def run_id(iso: Column, suffix: Column) -> Column:
    """Compact ISO time and eight hex digits; sorts by time."""
    return F.concat(F.regexp_replace(iso, r"[-:.]", ""), F.lit("-"), suffix)


def source_range(l1: Column, c1: Column, l2: Column, c2: Column) -> Column:
    """Lines from 1, columns from 0."""
    s = lambda c: c.cast("string")
    return F.concat(s(l1), F.lit(":"), s(c1), F.lit("-"), s(l2), F.lit(":"), s(c2))


def scope_range(value: Column) -> Column:
    """struct of the four numbers of a source range; null where it is malformed."""
    at = lambda k: F.regexp_extract(value, r"^(\d+):(\d+)-(\d+):(\d+)$", k)
    found = F.struct(*(F.try_to_number(at(k), F.lit("999999999")).cast("int").alias(n) for k, n in enumerate(("start_line", "start_col", "end_line", "end_col"), 1)))
    return F.when(value.rlike(r"^\d+:\d+-\d+:\d+$"), found)


def offset_range(source: Column, start: Column, end: Column) -> Column:
    """The source range of two character offsets."""

    def place(at: Column) -> tuple[Column, Column]:
        before = F.substring(source, F.lit(1), at.cast("int"))
        lines = F.split(before, "\n")
        return F.size(lines), F.length(F.element_at(lines, -1))

    return source_range(*place(start), *place(end))


def slice_lines(source: Column, start_line: Column, start_col: Column, end_line: Column, end_col: Column) -> Column:
    """The text of a range: lines from 1, columns from 0, the end exclusive."""
    lines = F.slice(F.split(source, "\n"), start_line, F.greatest(end_line - start_line + 1, F.lit(0)))
    n = F.size(lines)
    cut = F.transform(
        lines,
        lambda x, i: F.when((i == 0) & (n == 1), F.substring(x, start_col + 1, end_col - start_col))
        .when(i == 0, F.substring(x, start_col + 1, F.length(x)))
        .when(i == n - 1, F.substring(x, F.lit(1), end_col))
        .otherwise(x),
    )
    return F.array_join(cut, "\n")


def repo_relative(path: Column, root: str) -> Column:
    """Posix path below ``root``; others as they are."""
    norm = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.regexp_replace(norm, f"^{re.escape(root.rstrip('/'))}/", "") if root else norm


def absolute(path: Column, root: str) -> Column:
    return F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def posix_normalize(path: Column) -> Column:
    """Without empty and ``.`` segments, ``..`` resolved; one that leads out of the root stays in front."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    step = lambda acc, p: (
        F.when((p == "") | (p == "."), acc)
        .when((p == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) != ".."), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(p)))
    )
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def posix_dirname(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit(""))


def last_segment(path: Column) -> Column:
    return F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)


def project_slug(path: Column) -> Column:
    return F.regexp_replace(path, r"[^A-Za-z0-9]", "-")


def transcript_file(root: str, cwd: Column, session: Column) -> Column:
    return F.concat(F.lit(root.rstrip("/") + "/"), project_slug(cwd), F.lit("/"), session, F.lit(".jsonl"))


def agent_transcript_file(root: str, cwd: Column, session: Column, agent: Column) -> Column:
    return F.concat(F.lit(root.rstrip("/") + "/"), project_slug(cwd), F.lit("/"), session, F.lit("/subagents/agent-"), agent, F.lit(".jsonl"))


def at_least_version(version: Column, least: str) -> Column:
    """Whether a dotted version is at least ``least``; false when malformed."""
    nums = lambda c: F.transform(F.slice(F.split(F.regexp_replace(c, "^v", ""), r"[.\-+]"), 1, 3), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))
    return version.rlike(r"^v?\d+\.\d+\.\d+") & (nums(version) >= nums(F.lit(least)))


def short_hash(text: Column) -> Column:
    """Twelve hex digits, for prompts and other pinned assets."""
    return F.left(F.sha2(text, 256), F.lit(12))
