"""Row predicates and classifications."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions that are indexed, directories that are not, certainties of a call.
SOURCE_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".py", ".rs")
EXCLUDED_DIRS = (
    "node_modules", "__pycache__", ".vscode", "out", ".git", ".hg", "dist", "build", ".tox", ".mypy_cache", ".pytest_cache", "venv", ".venv", "env", ".env",
)
CONFIDENCE = {"certain": 1.0, "probable": 0.6, "possible": 0.3}
EXTERNAL_TARGET = r"(?i)^(~|/|[a-z][a-z0-9+.-]*:)"
#: Fields that name what a tool call was about, first present wins.
ADDRESS_FIELDS = ("file_path", "notebook_path", "pattern", "command", "path", "url", "skill", "query")
EDIT_TOOLS = ("Edit", "Write", "MultiEdit", "NotebookEdit")


def live(deleted_at: Column) -> Column:
    return deleted_at.isNull()


def of_kind(kind: str) -> Column:
    return (F.col("kind") == kind) & live(F.col("deleted_at"))


def supported_source(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)).isin(*SOURCE_EXTENSIONS)


def in_excluded_dir(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*(F.lit(d) for d in EXCLUDED_DIRS)))


def within_root(path: Column, root: str) -> Column:
    return F.lit(True) if root == "" else (path == root) | F.startswith(path, F.lit(root + "/"))


def repo_file(path: Column) -> Column:
    """A usable change: not empty, not leading out of the repository."""
    return path.isNotNull() & (path != "") & ~F.startswith(path, F.lit(".."))


def external_target(target: Column) -> Column:
    return target.rlike(EXTERNAL_TARGET)


def skill_edge_kind(target: Column) -> Column:
    return F.when(F.startswith(target, F.lit("scripts/")), "skill.to_script").otherwise("skill.to_reference")


def confidence(certainty: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in CONFIDENCE.items() for x in kv))
    return F.coalesce(F.try_element_at(table, certainty), F.lit(1.0))


def is_inferred(confidence: Column) -> Column:
    """Edges below full confidence are drawn dashed."""
    return F.coalesce(confidence, F.lit(1.0)) < 1


def stale_cursor(name: Column, age_days: Column, prefix: str, suffix: str, most: float = 7) -> Column:
    return F.startswith(name, F.lit(prefix)) & F.endswith(name, F.lit(suffix)) & (age_days > most)


def in_viewport(x: Column, y: Column, width: Column, height: Column, view: tuple[float, float, float, float], buffer: float = 100) -> Column:
    """Whether a box meets the viewport (left, top, right, bottom) and a margin; sizes default to 200 x 100."""
    left, top, right, bottom = view
    w, h = F.coalesce(width, F.lit(200.0)), F.coalesce(height, F.lit(100.0))
    return (x + w >= left - buffer) & (x <= right + buffer) & (y + h >= top - buffer) & (y <= bottom + buffer)


def sync_state(last_attempt: Column, last_success: Column, last_error: Column) -> Column:
    """never, unhealthy, in_flight or healthy; times compare as text."""
    return (
        F.when(last_attempt.isNull() & last_success.isNull() & last_error.isNull(), "never")
        .when(last_error.isNotNull(), "unhealthy")
        .when(last_attempt.isNotNull() & (last_success.isNull() | (last_attempt > last_success)), "in_flight")
        .otherwise("healthy")
    )


def bundle_problem(skill_source: Column, meta_source: Column, missing_file: Column) -> Column:
    """Why a skill bundle is degraded, or null. ``missing_file``: a declared file that the bundle lacks, if any."""
    empty = F.regexp_replace(skill_source, r"\s+", "") == ""
    return (
        F.when(skill_source.isNull(), "SKILL.md unreadable")
        .when(empty, "SKILL.md is empty (mid-edit truncation)")
        .when(meta_source.isNotNull() & F.try_parse_json(meta_source).isNull(), "meta.json is unparseable (mid-edit truncation)")
        .when(missing_file.isNotNull(), F.concat(F.lit("declared sub-agent file missing from bundle: "), missing_file))
    )
