"""Reading the input tables: parquet directories or a JDBC database."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.operators.windows import window_bounds
from ticketlens.schemas import TICKET_TABLES, conform


# Long source names of two life columns.
LIFE_NAMES = {
    "vda_responsavelpor_grupo": "vda_grupo",
    "vda_responsavelpor_usuario": "vda_usuario",
}


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[name.lower() for name in df.columns])


def life_rows(df: DataFrame) -> DataFrame:
    """Life rows under the engine's names. Where the source has no `vda_seq`, stays
    that enter at the same instant are ordered by a hash of the row, so that every
    run orders them alike."""
    named = df.withColumnsRenamed(LIFE_NAMES)
    if "vda_seq" in named.columns:
        return named
    return named.withColumn("vda_seq", F.xxhash64(*[F.col(name) for name in named.columns]))


def read_tables(
    spark: SparkSession, root: str, schemas: Mapping = TICKET_TABLES, fmt: str = "parquet"
) -> dict[str, DataFrame]:
    """One DataFrame per table name, from `root/<name>`, in its declared schema."""
    found = {name: lower_names(spark.read.format(fmt).load(f"{root}/{name}")) for name in schemas}
    if "vida" in found:
        found["vida"] = life_rows(found["vida"])
    return {name: conform(df, schemas[name]) for name, df in found.items()}


def window_predicates(
    column: str, start: datetime, end: datetime, cycle: str = "daily", closed: str = "left"
) -> list[str]:
    """One SQL condition per load window, for the partitions of a JDBC scan."""
    low_op, high_op = (">=", "<") if closed == "left" else (">", "<=")
    return [
        f"{column} {low_op} TIMESTAMP '{low}' AND {column} {high_op} TIMESTAMP '{high}'"
        for low, high in window_bounds(start, end, cycle)
    ]


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    predicates: Sequence[str],
    properties: Mapping[str, str],
) -> DataFrame:
    """A database table, one partition per predicate. The caller brings the
    connection options; `fetchsize` is 10,000 unless given."""
    options = {"fetchsize": "10000", "preferTimestampNTZ": "true", **properties}
    df = spark.read.jdbc(url, table, predicates=list(predicates), properties=options)
    return lower_names(df)
