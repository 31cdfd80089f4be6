"""Stored tables that know their pages and their measures.

A table is written in the order of its pages, cut into ranges, with an index of how many rows
come before each range: a page reads the ranges it lies in, however many rows come before.
Measures (any aggregates) are observed by the job that writes the rows, so that asking
for them later reads neither the rows nor the plan behind them. Rows, index and measures
are published as one version."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType
from pyspark.sql.window import Window

from ticketlens.operators.packed import Packed
from ticketlens.operators.reports import check_page
from ticketlens.sources.sinks import full_refresh, shuffles_freed
from ticketlens.sources.versions import current, publish, remove

RANGE = "faixa"
ROWS, INDEX, MEASURES = "linhas", "indice", "medidas"
DRAFT = "rascunho"
KEYS, SCHEMA, TOTAL = "ordem", "esquema", "total"


def _in_order(columns: Sequence[str]) -> list[Column]:
    return [F.col(name).asc_nulls_last() for name in columns]


def _index(stored: DataFrame) -> DataFrame:
    """Rows of each range and before it. Counts come from the footers of the files; the
    window sorts one row per range."""
    before = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    counts = stored.groupBy(RANGE).agg(F.count(F.lit(1)).alias("linhas"))
    return counts.withColumn("inicio", F.coalesce(F.sum("linhas").over(before), F.lit(0)))


def write_pages(
    df: DataFrame | Packed,
    folder: str,
    keys: Sequence[str],
    measures: Mapping[str, Column] | None = None,
    cut_by: int | None = None,
) -> int:
    """Stores `df` in the order of `keys`, then of all other columns by their place, and
    publishes it; the number of the version. `measures` are aggregates over the rows, kept
    as text.

    Ranges are cut by the first `cut_by` columns of that order (all of `keys` if not
    given): rows alike in them share a range, so name enough for such rows to be few. The
    size of a range is that of a shuffle partition under adaptive execution.

    Cutting ranges samples the rows and so needs them twice: they are stored as they come
    first, in a folder of their own that is removed afterwards, and the plan behind them
    is planned and run once. Packed rows are stored and dealt into ranges packed, and opened
    where they are sorted. On disk are at most the shuffles of that plan and the draft, then
    the draft, the shuffle into ranges and the table: shuffles go with the job they serve."""
    folder = folder.rstrip("/")
    if not keys:
        raise ValueError("keys must name the sort columns")
    packed = df if isinstance(df, Packed) else Packed(df, (), lambda rows, keep: rows.select(*df.columns, *keep))
    schema = packed.rows().schema
    if RANGE in schema.names:
        raise ValueError(f"{RANGE} is the name of the range column")
    spark = packed.frame.sparkSession
    number, _ = current(spark, folder)
    order = [*keys, *[c for c in schema.names if c not in keys]]
    cut = [value.asc_nulls_last() for _, value in packed.cut(order[: cut_by or len(keys)])]
    with shuffles_freed(spark):
        kept = full_refresh(packed.frame, f"{folder}/{DRAFT}")
    draft = spark.read.schema(packed.frame.schema).parquet(kept)
    ranged = draft.repartitionByRange(*cut).withColumn(RANGE, F.spark_partition_id())
    rows = packed.over(ranged).rows(RANGE).sortWithinPartitions(RANGE, *_in_order(order))
    # Observed behind the last shuffle: a task that runs again is counted once.
    seen = Observation()
    values = {TOTAL: F.count(F.lit(1)), **(measures or {})}
    rows = rows.observe(seen, *[value.cast("string").alias(name) for name, value in values.items()])
    # Not by full_refresh: its rebalance hint would deal the ranges anew.
    path = f"{folder}/{ROWS}/{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        rows.write.mode("errorifexists").option("compression", "zstd").partitionBy(RANGE).parquet(path)
    remove(spark, kept)
    stored = _ranges(spark, path, schema)
    index = full_refresh(_index(stored), f"{folder}/{INDEX}")
    content = {
        ROWS: path,
        INDEX: index,
        KEYS: order,
        SCHEMA: schema.json(),
        MEASURES: {name: seen.get.get(name) for name in values},
    }
    return publish(spark, folder, content, number)


def _ranges(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(StructType([*schema.fields]).add(RANGE, IntegerType())).parquet(path)


def _published(spark: SparkSession, folder: str) -> dict:
    number, content = current(spark, folder)
    if not number:
        raise ValueError(f"nothing has been published in {folder}")
    return content


def read_rows(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of the newest version, in no order."""
    content = _published(spark, folder)
    return _ranges(spark, content[ROWS], StructType.fromJson(json.loads(content[SCHEMA]))).drop(RANGE)


def read_page(spark: SparkSession, folder: str, page: int = 1, page_size: int = 50) -> DataFrame:
    """One page of the newest version: the rows of `tracking_page` over the same table and
    keys. Only the ranges that hold the page are listed, read and sorted; no range is
    empty, so there are at most `page_size` of them."""
    check_page(page, page_size)
    content = _published(spark, folder)
    schema = StructType.fromJson(json.loads(content[SCHEMA]))
    first = (page - 1) * page_size
    hits = (
        spark.read.parquet(content[INDEX])
        .where((F.col("inicio") < first + page_size) & (F.col("inicio") + F.col("linhas") > first))
        .orderBy("inicio")
        .collect()
    )
    if not hits:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*[f"{content[ROWS]}/{RANGE}={hit[RANGE]}" for hit in hits])
    return rows.orderBy(*_in_order(content[KEYS])).offset(first - hits[0]["inicio"]).limit(page_size)


def measures(spark: SparkSession, folder: str) -> dict[str, str | None]:
    """The measures of the newest version as text, with the number of rows as `total`."""
    return _published(spark, folder)[MEASURES]


def read_summary(spark: SparkSession, folder: str, page: int = 1, page_size: int = 50) -> DataFrame:
    """The row of `page_summary` for the newest version, from its measures alone."""
    check_page(page, page_size)
    total = int(measures(spark, folder)[TOTAL])
    return spark.createDataFrame(
        [(page, page_size, total, -(-total // page_size))],
        "page int, page_size int, total bigint, total_pages int",
    )
