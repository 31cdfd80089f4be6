"""Freshness, duplicates and row counts of tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.functions.calendar import ntz
from ticketlens.functions.durations import seconds_between


def _times(weight: str | None) -> Column:
    """Sum of how many rows each row stands for: one, or `weight`."""
    return F.coalesce(F.sum(F.col(weight) if weight else F.lit(1)), F.lit(0)).cast("bigint")


def freshness_values(tag: str, tables: Sequence[str], weight: str | None = None) -> dict[str, Column]:
    """The aggregates behind `table_freshness` by name, for rows that are being written."""
    times = F.col(weight) if weight else F.lit(1)
    values = {}
    for number, name in enumerate(tables):
        own = F.col(tag) == name
        values |= {
            f"linhas_{number}": F.coalesce(F.sum(F.when(own, times)), F.lit(0)).cast("bigint"),
            f"entrada_{number}": F.max(F.when(own, F.col("data_entrada_n2"))),
            f"encerramento_{number}": F.max(F.when(own, F.col("data_encerramento"))),
        }
    return values


def freshness_rows(values: DataFrame, tables: Sequence[str], as_of: datetime) -> DataFrame:
    """One row per table from one row of `freshness_values` (as text too)."""
    each = [
        F.struct(
            F.lit(name).alias("tabela"),
            F.col(f"linhas_{number}").cast("bigint").alias("linhas"),
            F.col(f"entrada_{number}").cast("timestamp_ntz").alias("ultima_entrada"),
            F.col(f"encerramento_{number}").cast("timestamp_ntz").alias("ultimo_encerramento"),
        )
        for number, name in enumerate(tables)
    ]
    return values.select(F.inline(F.array(*each))).withColumns(
        {
            "atraso_seg": seconds_between(F.col("ultima_entrada"), ntz(as_of)),
            "data_update": F.lit(as_of.strftime("%d-%m-%Y %H:%M")),
        }
    )


def table_freshness(
    rows: DataFrame, tag: str, tables: Sequence[str], as_of: datetime, weight: str | None = None
) -> DataFrame:
    """Per tracking table (a value of `tag`): rows, newest entry and closure, seconds from the
    newest entry to `as_of`, and `as_of` as a text stamp, day first. `weight` names a
    column that says how many rows a row stands for.

    All tables are read in one pass; one without rows has 0 of them."""
    values = freshness_values(tag, tables, weight)
    return freshness_rows(rows.agg(*[v.alias(name) for name, v in values.items()]), tables, as_of)


def duplicate_report(
    df: DataFrame, key: str, n: int | None = 20, weight: str | None = None
) -> DataFrame:
    """Rows per key value, most first; the top `n`, or all of them."""
    counts = df.groupBy(key).agg(_times(weight).alias("qtd"))
    ordered = counts.where(F.col(key).isNotNull()).orderBy(F.col("qtd").desc(), key)
    return ordered if n is None else ordered.limit(n)


def _profile(name: str, df: DataFrame, seconds: str | None, weight: str | None) -> DataFrame:
    # Rows per ticket first: partial sums by key, then a handful of totals.
    below = df.withColumn("_vezes", F.col(weight) if weight else F.lit(1))
    negative = F.sum(F.when(F.col(seconds) < 0, F.col("_vezes")).otherwise(0)) if seconds else F.lit(0)
    per_ticket = below.groupBy("origem").agg(F.sum("_vezes").alias("n"), negative.alias("negativos"))

    def total(value: Column) -> Column:
        return F.coalesce(value, F.lit(0)).cast("bigint")

    return per_ticket.agg(
        F.lit(name).alias("etapa"),
        total(F.sum("n")).alias("linhas"),
        F.count("origem").alias("tickets"),
        total(F.max("n")).alias("max_por_ticket"),
        total(F.sum("negativos")).alias("tempos_negativos"),
    )


def reconciliation(
    tickets: DataFrame,
    stays: DataFrame,
    final: DataFrame,
    ticket_weight: str | None = None,
    final_weight: str | None = None,
) -> DataFrame:
    """Rows, distinct tickets, the largest fan-out of a ticket and spans below
    zero, for the snapshot, the stays and the joined table. The weights name columns
    that say how many rows a row stands for."""
    return (
        _profile("tickets", tickets, None, ticket_weight)
        .unionByName(_profile("stays", stays, "tma_n2_seg", None))
        .unionByName(_profile("final", final, "tma_n2_seg", final_weight))
    )
