from __future__ import annotations

import pytest
from pyspark.sql import functions as F


@pytest.fixture
def frame(spark):
    """A documents-like table from (doc_id, text, lang, source) rows, with further columns
    that bear the names operators use inside."""

    def make(rows, partitions: int = 3):
        rows = [tuple(r) + (None,) * (4 - len(r)) for r in rows]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
        for name in ("fp", "size", "row", "key", "label", "segment", "units", "spans", "n_words", "_pii", "_text"):
            df = df.withColumn(name, F.lit(name))
        return df.repartition(partitions)

    return make
