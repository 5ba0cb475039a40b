"""Document extraction that has a line grammar of its own: frontmatter, links, registries.

Vectorised Python functions and a table function: these grammars keep state between lines.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataweave.functions.predicates import external_target
from strataweave.functions.text import target_path

# Spellings of frontmatter keys, a fence, a link.
KEY_ALIASES = {"allowed-tools": "tools", "allowed_tools": "tools", "user-invocable": "user_invocable"}
FENCE = re.compile(r"\s*(```|~~~)")
LINK = re.compile(r"\[[^\]]*\]\(([^)]+)\)")


def _quoted(v: str) -> bool:
    return len(v) > 1 and v[0] == v[-1] and v[0] in "\"'"


def _bare(v: str) -> str:
    v = v.strip()
    return v[1:-1] if _quoted(v) else v


def frontmatter_of(source: str | None) -> dict:
    """The leading ``---`` block as a bag: scalars, inline and block lists, block scalars."""
    text = re.sub(r"\r\n?", "\n", source or "")
    end = text.find("\n---", 3)
    if not text.startswith("---\n") or end < 0:
        return {}
    out: dict = {}
    lines = iter(text[4 : end + 1].split("\n"))
    pending = next(lines, None)
    while pending is not None:
        line, pending = pending, next(lines, None)
        if not line.strip() or line.lstrip().startswith("#") or line[:1].isspace() or ":" not in line:
            continue
        key, value = (p.strip() for p in line.split(":", 1))
        key = KEY_ALIASES.get(key, key.replace("-", "_"))
        block: list[str] = []
        if value in ("|", ">"):
            while pending is not None and (not pending.strip() or pending[:1].isspace()):
                block.append(pending.strip())
                pending = next(lines, None)
            out[key] = (" " if value == ">" else "\n").join(block).strip()
        elif not value:
            while pending is not None and pending.lstrip().startswith("- "):
                block.append(_bare(pending.lstrip()[2:]))
                pending = next(lines, None)
            out[key] = block or ""
        elif not _quoted(value) and "," in value:
            out[key] = [p for p in map(_bare, value.split(",")) if p]
        else:
            own = _bare(value)
            out[key] = {"true": True, "false": False}.get(own, own)
    return out


@F.pandas_udf(T.StringType())
def _frontmatter(sources: pd.Series) -> pd.Series:
    return sources.map(lambda s: json.dumps(frontmatter_of(s), ensure_ascii=False))


def frontmatter(source: Column) -> Column:
    """The frontmatter as a JSON bag."""
    return _frontmatter(source)


def links_of(source: str | None) -> Iterator[tuple[int, str, int, int, int]]:
    """(ordinal, link text, line, first column, end column) outside fences and inline code."""
    fenced, n = False, 0
    for number, line in enumerate((source or "").split("\n"), 1):
        if FENCE.match(line):
            fenced = not fenced
        elif not fenced:
            code, shown = False, []
            for ch in line:
                code ^= ch == "`"
                shown.append(" " if code or ch == "`" else ch)
            for m in LINK.finditer("".join(shown)):
                yield n, m[1], number, m.start(), m.end()
                n += 1


def _explode_with(df: DataFrame, source_col: str, carry: list[str], fields: str, rows_of) -> DataFrame:
    """The ``carry`` columns of ``df`` with a row for each that ``rows_of(source)`` yields."""
    names = [f.split(" ")[0] for f in fields.split(", ")]

    def run(batches):
        for batch in batches:
            found = [(r, *x) for r, s in zip(batch[carry].itertuples(index=False, name=None), batch[source_col], strict=True) for x in rows_of(s)]
            yield pd.DataFrame([(*r, *x) for r, *x in found], columns=[*carry, *names])

    kept = df.select(*carry, source_col)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInPandas(run, f"{types}, {fields}")


def markdown_links(docs: DataFrame, source_col: str, carry: list[str]) -> DataFrame:
    """A row for each link: ordinal, target (path without title and fragment), source_range."""
    raw = _explode_with(docs, source_col, carry, "ordinal int, link string, line int, first int, last int", links_of)
    where = F.format_string("%d:%d-%d:%d", "line", "first", "line", "last")
    return raw.select(*carry, "ordinal", target_path(F.col("link")).alias("target"), where.alias("source_range")).filter("target <> ''")


def sub_agents_of(source: str | None) -> Iterator[tuple[str, str | None, str]]:
    """(name, file, source range) of each declared sub-agent; tolerant of anything malformed."""
    try:
        found = json.loads(source or "")
    except ValueError:
        return
    entries = found.get("sub_agents") if isinstance(found, dict) else None
    key = '"sub_agents"'
    at = max(0, source.find(key))

    def span(start: int, end: int) -> str:
        place = lambda i: f"{source.count(chr(10), 0, i) + 1}:{i - source.rfind(chr(10), 0, i) - 1}"
        return f"{place(start)}-{place(end)}"

    fallback = span(at, at + len(key)) if key in source else "1:0-1:0"
    for entry in entries if isinstance(entries, list) else []:
        name = entry if isinstance(entry, str) else entry.get("name") if isinstance(entry, dict) else None
        if not isinstance(name, str):
            continue
        file = entry.get("file") if isinstance(entry, dict) else None
        literal = json.dumps(name, ensure_ascii=False)
        where = source.find(literal, at)
        own = fallback
        if where >= 0:
            own, at = span(where, where + len(literal)), where + len(literal)
        yield name, file if isinstance(file, str) else None, own


def sub_agents(docs: DataFrame, source_col: str, carry: list[str]) -> DataFrame:
    """A row for each sub-agent that a registry declares: name, file, source_range, ordinal."""
    return _explode_with(docs, source_col, carry, "name string, file string, source_range string, ordinal int", lambda s: ((*x, k) for k, x in enumerate(sub_agents_of(s))))


def bundle_links(links: DataFrame, files: DataFrame) -> DataFrame:
    """``links`` (…, target normalised) whose target is a file of the bundle; external ones never are."""
    return links.filter(~external_target(F.col("target"))).join(files.select(F.col("path").alias("target")).distinct(), "target", "left_semi")
