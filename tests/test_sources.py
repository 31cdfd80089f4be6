from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ticketlens.plans import catalog, tracking
from ticketlens.schemas import TICKET_TABLES, VIDA, conform
from ticketlens.sources.tables import life_rows, read_tables


def test_tables_written_and_read_back(spark, tables, tmp_path, rows_of):
    """Upper-case names, text codes, float codes and long life names are accepted."""
    for name in TICKET_TABLES:
        df = tables[name]
        if name == "vida":
            df = df.withColumnsRenamed(
                {"vda_grupo": "vda_responsavelpor_grupo", "vda_usuario": "vda_responsavelpor_usuario"}
            ).withColumn("vda_responsavelpor_grupo", F.col("vda_responsavelpor_grupo").cast("string"))
        if name == "ta":
            df = df.withColumn("tqa_raiz", F.col("tqa_raiz").cast("double"))
        df.toDF(*[c.upper() for c in df.columns]).write.parquet(str(tmp_path / name))
    read = read_tables(spark, str(tmp_path))
    assert all(read[n].dtypes == tables[n].dtypes for n in TICKET_TABLES)
    args = catalog.AS_OF, catalog.START, datetime(1996, 1, 1)
    found = tracking.tracking_active(read, *args)
    assert rows_of(found) == rows_of(tracking.tracking_active(tables, *args))


def test_a_missing_sequence_is_derived(tables):
    life = life_rows(tables["vida"].drop("vda_seq"))
    first, again = (conform(life, VIDA).orderBy("vda_ta", "vda_seq").collect() for _ in range(2))
    assert first == again and all(r["vda_seq"] is not None for r in first)


def test_missing_columns_are_an_error(tables):
    with pytest.raises(ValueError, match="vda_ta"):
        conform(tables["vida"].drop("vda_ta"), VIDA)
