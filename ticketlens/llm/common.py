"""Helpers the operators share: the shared folder, stored tables, running totals."""

from __future__ import annotations

import ctypes
import ctypes.util
import functools
import uuid
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as `spark.checkpoint.dir` names it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder.rstrip("/")


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Writes `df` to a new folder of the shared one and reads it back: lineage is
    cut, and a lost executor costs a read and no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@functools.cache
def _trim():
    name = ctypes.util.find_library("c")
    return getattr(ctypes.CDLL(name), "malloc_trim", None) if name else None


def give_back() -> None:
    """Returns freed memory of a Python worker to the system: workers are reused, and
    each would keep the most that any batch has needed."""
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def running_total(
    df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[Column], value: str, name: str
) -> DataFrame:
    """Adds `name`: the sum of `value` over the rows of the same `keys` that come
    before, by `bucket` and within it by `order`.

    The sums of whole buckets are added up first, so that a window sorts the rows
    of one bucket or one row for each bucket, never all rows of a hot key."""
    keys = list(keys)
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    same = F.lit(True)
    starts = starts.select(*[F.col(c).alias(f"_k_{c}") for c in [*keys, bucket]], "_start")
    for c in [*keys, bucket]:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    inside = (
        Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        df.join(starts, same)
        .withColumn(name, F.col("_start") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_start", *[f"_k_{c}" for c in [*keys, bucket]])
    )


def whole_groups(
    batches: Iterable[pd.DataFrame], keys: Sequence[str], rows: int
) -> Iterator[pd.DataFrame]:
    """Joins batches that are sorted by `keys` into frames of about `rows` rows
    that never cut a group."""
    held: list[pd.DataFrame] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += len(batch)
        if count < rows:
            continue
        frame = pd.concat(held, ignore_index=True)
        last = (frame[list(keys)] == frame[list(keys)].iloc[-1]).all(axis=1).to_numpy()
        start = len(frame) - int(last[::-1].argmin()) if not last.all() else 0
        if start:
            yield frame.iloc[:start].reset_index(drop=True)
        held = [frame.iloc[start:]]
        count = len(held[0])
    if count:
        yield pd.concat(held, ignore_index=True)
