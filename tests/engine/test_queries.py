"""The registered queries against their SQL, and the driver's entry without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from strataweave.queries import ORACLES, QUERIES

ROOT, DATA = Path(__file__).parents[2], Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    null = lambda x: None if not isinstance(x, list) and pd.isna(x) else x
    return sorted((tuple(map(null, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def db():
    own = duckdb.connect()
    for t in TABLES:
        own.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return own


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", [n for n in QUERIES if n != "reconcile_turn"])  # two turns; test_plans has them
def test_query_equals_its_sql(spark, db, name):
    got, want = QUERIES[name](spark, str(DATA)).toPandas(), db.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_entry_works_without_the_optional_subpackage(tmp_path):
    skip = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", ".pytest_cache", ".hypothesis")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'reachable_from' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True)


def test_nothing_else_imports_the_optional_subpackage():
    for path in (ROOT / "strataweave").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "strataweave.llm" not in path.read_text(), path
