import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture
def docs(spark):
    """Builds a documents table from texts or (id, text[, source[, lang]]) tuples."""

    def make(rows):
        full = []
        for i, r in enumerate(rows):
            r = (i, r) if r is None or isinstance(r, str) else r
            i, text, source, lang = (*r, *(None,) * (4 - len(r)))
            full.append((i, text, lang, source, None if text is None else len(text)))
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture
def table_dir(tmp_path):
    """Writes a documents DataFrame where the registered queries look for it."""

    def write(df):
        df.write.mode("overwrite").parquet(f"{tmp_path}/sf/documents.parquet")
        return f"{tmp_path}/sf"

    return write
