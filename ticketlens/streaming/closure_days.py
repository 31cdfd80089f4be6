"""Closed tickets by day of closure: only days whose source rows have changed are loaded again.

Every day has a fingerprint of its source rows, the number of rows and two sums over their
hashes, which depend on no order. A run compares the fingerprints of the source with
the stored ones and loads the days that differ: new ones, days a late ticket has closed in,
days with a late life, procedure, element or equipment row, and days whose tickets are
gone. All days that one run loads are one folder; the version tells which run holds a day."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.operators.snapshot import closed_roots
from ticketlens.plans.tracking import tracking_of
from ticketlens.sources.sinks import full_refresh, shuffles_freed
from ticketlens.sources.versions import current, publish

DAYS, LOADS, DAY, LOAD = "dias", "cargas", "dia_fechamento", "carga"
PRINT = ("linhas", "soma", "soma_quadrada")


def day_fingerprints(tables: Mapping[str, DataFrame], roots: DataFrame) -> DataFrame:
    """One row per closure day of `roots`: dia_fechamento and the fingerprint of its rows.

    Rows are hashed before they meet the days of their ticket, and added up by day with
    map-side partials: of a row only its ticket and its hash travel. Sums are decimals: they
    are exact and wrap nowhere."""
    days = roots.select(
        F.col("tqa_codigo").cast("bigint").alias("ta"), F.col("tqa_data_encerramento").cast("date").alias(DAY)
    ).distinct()

    def hashed(number: int, rows: DataFrame, key: str) -> DataFrame:
        code = F.xxhash64(F.lit(number), *[F.col(c) for c in rows.columns]).cast("decimal(20,0)")
        return rows.select(F.col(key).cast("bigint").alias("ta"), code.alias("h"))

    of_day = None
    for number, (rows, key) in enumerate(
        [(roots, "tqa_codigo"), (tables["ta"], "tqa_origem"), (tables["vida"], "vda_ta"), (tables["proced"], "pca_ta")]
    ):
        own = hashed(number, rows, key).join(days, "ta").select(DAY, "h")
        of_day = own if of_day is None else of_day.unionByName(own)
    # Elements of the roots only: equipment of others does not travel on.
    elements = tables["ta"].select(F.col("tqa_codigo").alias("aeq_ta"), F.col("tqa_origem").alias("ta"))
    owned = tables["equip"].join(elements.join(days.select("ta").distinct(), "ta", "left_semi").distinct(), "aeq_ta")
    equipment = hashed(4, owned.select(*tables["equip"].columns, "ta"), "ta").join(days, "ta")
    of_day = of_day.unionByName(equipment.select(DAY, "h"))
    # A second sum, over the rests by a prime, so that changes do not cancel out.
    rest = (F.col("h") % F.lit(2_147_483_647)).cast("decimal(20,0)")
    return of_day.groupBy(DAY).agg(
        F.count(F.lit(1)).alias("linhas"),
        F.sum("h").cast("decimal(38,0)").alias("soma"),
        F.sum(rest * rest).cast("decimal(38,0)").alias("soma_quadrada"),
    )


def changed_days(source: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Days whose fingerprints differ, or that only one side has: one row per day."""
    if stored is None:
        return source.select(DAY)
    theirs = stored.select(DAY, *[F.col(c).alias(f"antes_{c}") for c in PRINT])
    same = F.lit(True)
    for c in PRINT:
        same = same & F.col(c).eqNullSafe(F.col(f"antes_{c}"))
    return source.join(theirs, DAY, "full").where(~same).select(DAY)


def sync_closed(
    folder: str,
    tables: Mapping[str, DataFrame],
    as_of: datetime,
    end: datetime,
    created_from: datetime,
) -> int:
    """Brings the stored tracking rows of closed tickets up to the source; the number of
    the version. Without a changed day nothing is written.

    Days are kept whole: a stay that is still open keeps the end that the `as_of` of its
    day's last load gave it. The table of days has one small row per day. Shuffle files go with
    the job they serve: on disk are at most those of the prints or of the load."""
    spark = tables["ta"].sparkSession
    with shuffles_freed(spark):
        return _sync(spark, folder, tables, as_of, end, created_from)


def _sync(
    spark: SparkSession,
    folder: str,
    tables: Mapping[str, DataFrame],
    as_of: datetime,
    end: datetime,
    created_from: datetime,
) -> int:
    number, stored = current(spark, folder)
    roots = closed_roots(tables["ta"], created_from, end, created_from)
    prints = spark.read.parquet(full_refresh(day_fingerprints(tables, roots), f"{folder}/{DAYS}"))
    before = spark.read.parquet(stored[DAYS]) if number else None
    days = spark.read.parquet(full_refresh(changed_days(prints, before), f"{folder}/{DAYS}"))
    if days.isEmpty():
        return number
    of_day = F.col("tqa_data_encerramento").cast("date").alias(DAY)
    due = roots.withColumn(DAY, of_day).join(days, DAY, "left_semi").drop(DAY)
    load = full_refresh(tracking_of(due, tables, as_of), f"{folder}/{LOADS}")
    held = prints.join(days.withColumn("nova", F.lit(load)), DAY, "left")
    if before is not None:
        held = held.join(before.select(DAY, LOAD), DAY, "left")
        held = held.withColumn(LOAD, F.coalesce("nova", LOAD)).drop("nova")
    else:
        held = held.withColumnRenamed("nova", LOAD)
    kept = full_refresh(held, f"{folder}/{DAYS}")
    # Loads that still hold a day: at most one per run.
    live = {row[LOAD] for row in spark.read.parquet(kept).select(LOAD).distinct().collect()}
    content = {DAYS: kept, LOADS: [path for path in [*stored.get(LOADS, []), load] if path in live]}
    return publish(spark, folder, content, number)


def read_synced(spark: SparkSession, folder: str) -> DataFrame:
    """The stored rows, each day's from the load that holds it."""
    _, stored = current(spark, folder)
    days = spark.read.parquet(stored[DAYS]).select(DAY, LOAD)
    if not stored[LOADS]:
        raise ValueError(f"no closed ticket is stored in {folder}")
    rows = None
    for path in stored[LOADS]:
        own = spark.read.parquet(path)
        own = own.withColumns({DAY: F.col("data_encerramento").cast("date"), LOAD: F.lit(path)})
        rows = own if rows is None else rows.unionByName(own)
    return rows.join(days, [DAY, LOAD], "left_semi").drop(DAY, LOAD)
