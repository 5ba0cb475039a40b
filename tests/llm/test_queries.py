"""The registered queries that have SQL, against it: on the given tables and on odd rows."""

from pathlib import Path

import duckdb
import pytest

from strataweave.llm.queries import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
#: Null ids are left out: the SQL of copies and links compares ids.
ODD = [(1, None, None), (2, "", "src0"), (3, "é 漢字\t" * 700, "src0"), (4, "é 漢字\t" * 700, "*"), (5, " ", "no such"), *((i, f"text {i % 40} of {i % 7}", f"src{i * i % 23}") for i in range(6, 900))]

TALK = "conv_id long, turn long, role string, text string"


def compared(spark, name, folder):
    db = duckdb.connect()
    for table in ("documents", "conversations"):
        files = f"{folder}/{table}.parquet"
        if Path(files).exists():
            db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{files if Path(files).is_file() else files + '/*.parquet'}'")
    got, want = QUERIES[name](spark, str(folder)), db.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    key = lambda r: tuple((x is None, x) for x in r)
    found = sorted((tuple(r) for r in got.select(*cols).collect()), key=key)
    assert found == sorted(want.select(*cols).fetchall(), key=key)
    return len(found)


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_its_sql(spark, name):
    assert compared(spark, name, DATA) == (20 if name == "op13_conversation_repair" else 200)


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op7_mix_sources", "op8_feistel_shards", "op12_fill_in_middle"])
def test_odd_rows(spark, docs, table_dir, name):
    assert compared(spark, name, table_dir(docs(ODD))) == len(ODD)


@pytest.mark.parametrize("name", ORACLES)
def test_no_rows(spark, docs, table_dir, name):
    folder = table_dir(docs([]))
    spark.createDataFrame([], TALK).write.parquet(f"{folder}/conversations.parquet")
    assert compared(spark, name, folder) == 0


def test_odd_conversations(spark, docs, table_dir):
    folder, names, said = table_dir(docs([])), ["user", "assistant", "system", None, "tool"], ["Yes.", "cut", " \n", None, "", "é 漢? \t"]
    rows = [(None if c == 7 else c, None if t == 3 else t // 2 * 2**30, names[c * t % 5], said[(c + t * t) % 6]) for c in range(120) for t in range(c % 6)]
    spark.createDataFrame(rows, TALK).write.parquet(f"{folder}/conversations.parquet")
    assert compared(spark, "op13_conversation_repair", folder) == len({r[0] for r in rows})
