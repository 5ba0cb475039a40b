"""Ranked search over names and descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.functions.text import search_score


def top_k(rows: DataFrame, query: str, name: str, description: str, pos: str, k: int = 10) -> DataFrame:
    """The ``k`` best of ``rows`` by score, ties in the order of ``pos``; nothing for a blank query.

    Each task keeps k rows (TakeOrderedAndProject); the limit is the feature.
    """
    if not query.strip():
        return rows.withColumn("score", F.lit(0.0)).filter(F.lit(False))
    scored = rows.withColumn("score", search_score(query, F.col(name), F.col(description)))
    return scored.filter("score > 0").orderBy(F.desc("score"), pos).limit(k)
