"""Replacing and extending stored tables."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.operators.packed import Packed

# The partition column that tells the loads of a table apart.
LOAD = "carga"


def by_entry_month(df: DataFrame | Packed) -> DataFrame | Packed:
    """Adds `mes_entrada` (yyyyMM), the partition column of the tracking tables."""
    if isinstance(df, Packed):
        stays = df.opened("data_entrada_n2")
        entry = stays.value("data_entrada_n2")
        return stays.with_column("mes_entrada", F.year(entry) * 100 + F.month(entry))
    entry = F.col("data_entrada_n2")
    return df.withColumn("mes_entrada", F.year(entry) * 100 + F.month(entry))


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that runs in here are removed when it ends, not when the driver
    next collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _write(df: DataFrame | Packed, path: str, mode: str, partition_by: tuple[str, ...]) -> str:
    """Plain tables are written where the rows are. For a partitioned one the
    rebalance hint lets adaptive execution merge the small files of a partition
    value and split a value that holds most of the rows. Packed rows are dealt packed."""
    if isinstance(df, Packed):
        dealt = df.over(df.frame.hint("rebalance", *partition_by)) if partition_by else df
        writer = dealt.rows().write.mode(mode)
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    elif partition_by:
        df.hint("rebalance", *partition_by).write.mode(mode).partitionBy(*partition_by).parquet(path)
    else:
        df.write.mode(mode).parquet(path)
    return path


def full_refresh(df: DataFrame | Packed, folder: str, partition_by: tuple[str, ...] = ()) -> str:
    """Writes the table beside its former versions in `folder` and returns the path of
    the new one. Readers keep the version they opened; hand them the new path once the
    job has succeeded, and remove versions nobody reads."""
    return _write(df, f"{folder.rstrip('/')}/{uuid.uuid4().hex}", "errorifexists", partition_by)


def write_load(df: DataFrame, folder: str, start: datetime, end: datetime) -> str:
    """Writes one load, of rows in (start, end], to its own folder in `folder`. The same
    load written again replaces itself and no other."""
    path = f"{folder.rstrip('/')}/{LOAD}={start:%Y%m%dT%H%M%S}-{end:%Y%m%dT%H%M%S}"
    return _write(df, path, "overwrite", ())


def read_loads(spark: SparkSession, folder: str) -> DataFrame:
    """All loads of a folder as one table."""
    return spark.read.parquet(folder).drop(LOAD)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder path under the folder that `spark.checkpoint.dir` names, which
    every executor sees."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
