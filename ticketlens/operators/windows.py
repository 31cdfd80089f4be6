"""Load windows: contiguous daily, weekly or monthly ranges of a timestamp."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.functions.calendar import ntz

DAYS_PER_WINDOW = {"daily": 1, "weekly": 7}
CYCLES = ("daily", "weekly", "monthly")


def _midnight(moment: datetime) -> datetime:
    return moment.replace(hour=0, minute=0, second=0, microsecond=0)


def _period(start: datetime, end: datetime, cycle: str, truncate: bool) -> tuple[datetime, datetime]:
    if cycle not in CYCLES:
        raise ValueError(f"cycle must be one of {', '.join(CYCLES)}")
    return (_midnight(start), _midnight(end)) if truncate else (start, end)


def window_bounds(
    start: datetime, end: datetime, cycle: str = "daily", truncate: bool = True
) -> list[tuple[datetime, datetime]]:
    """All windows of a period as Python values, for scan predicates."""
    start, end = _period(start, end, cycle, truncate)
    if start >= end:
        return []
    if cycle == "monthly":
        months = (end.year - start.year) * 12 + end.month - start.month
        clock = start - _midnight(start)
        firsts = (start.year * 12 + start.month - 1 + k for k in range(1, months + 1))
        cuts = [datetime(m // 12, m % 12 + 1, 1) + clock for m in firsts]
    else:
        step = timedelta(days=DAYS_PER_WINDOW[cycle])
        cuts = [start + step * k for k in range(1, (end - start) // step + 1)]
    edges = [start, *[cut for cut in cuts if cut < end], end]
    return list(zip(edges, edges[1:]))


def _bounds_of(moment: Column, start: datetime, end: datetime, cycle: str) -> tuple[Column, Column]:
    """Start and end of the window that holds `moment`, by arithmetic."""
    if cycle == "monthly":
        clock = F.make_dt_interval(secs=F.lit((start - _midnight(start)).total_seconds()))
        first = F.trunc((moment - clock).cast("date"), "MM")
        low = first.cast("timestamp_ntz") + clock
        high = F.add_months(first, 1).cast("timestamp_ntz") + clock
    else:
        days = DAYS_PER_WINDOW[cycle]
        passed = (moment - ntz(start)).cast("interval day").cast("int")
        whole = (F.call_function("div", passed, F.lit(days)) * days).cast("int")
        low = ntz(start) + F.make_dt_interval(days=whole)
        high = low + F.make_dt_interval(days=F.lit(days))
    return F.greatest(low, ntz(start)), F.least(high, ntz(end))


def load_windows(
    df: DataFrame,
    ts_col: str,
    start: datetime,
    end: datetime,
    cycle: str = "daily",
    closed: str = "left",
    truncate: bool = True,
) -> DataFrame:
    """Rows of the period with the `window_start` and `window_end` they load in.

    `closed="left"` windows are [start, end), `closed="right"` ones (start, end]."""
    start, end = _period(start, end, cycle, truncate)
    ts = F.col(ts_col)
    if closed == "left":
        rows = df.where((ts >= ntz(start)) & (ts < ntz(end)))
        moment = ts
    elif closed == "right":
        rows = df.where((ts > ntz(start)) & (ts <= ntz(end)))
        # The smallest step back puts an instant on an edge in the earlier window.
        moment = ts - F.expr("interval '0.000001' second")
    else:
        raise ValueError("closed must be left or right")
    low, high = _bounds_of(moment, start, end, cycle)
    return rows.withColumn("window_start", low).withColumn("window_end", high)


def all_windows(
    spark: SparkSession, start: datetime, end: datetime, cycle: str = "daily", truncate: bool = True
) -> DataFrame:
    """Every window of the period, one row each."""
    start, end = _period(start, end, cycle, truncate)
    if start >= end:
        return spark.createDataFrame([], "window_start timestamp_ntz, window_end timestamp_ntz")
    days = (end - start).days + 1
    moments = spark.range(days).select(
        (ntz(start) + F.make_dt_interval(days=F.col("id").cast("int"))).alias("moment")
    )
    low, high = _bounds_of(F.col("moment"), start, end, cycle)
    inside = moments.where(F.col("moment") < ntz(end))
    windows = inside.select(low.alias("window_start"), high.alias("window_end")).distinct()
    return windows


def rows_per_window(
    df: DataFrame,
    ts_col: str,
    start: datetime,
    end: datetime,
    cycle: str = "daily",
    closed: str = "left",
    truncate: bool = True,
) -> DataFrame:
    """Row count of every window; windows without rows show 0."""
    loaded = load_windows(df, ts_col, start, end, cycle, closed, truncate)
    counts = loaded.groupBy("window_start").agg(F.count(F.lit(1)).alias("found"))
    windows = all_windows(df.sparkSession, start, end, cycle, truncate)
    return windows.join(counts, "window_start", "left").select(
        "window_start", "window_end", F.coalesce("found", F.lit(0).cast("bigint")).alias("linhas")
    )
