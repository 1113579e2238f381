from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        """rows of (doc_id, text); other columns are filled, also with nulls."""
        full = [(i, t, None if k % 3 else "en", f"src{k % 2}", len(t) if t is not None else None) for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(full, DOCS)

    return make
