"""Incremental load of closed tickets behind a closure high-water mark."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.plans.tracking import tracking_closed


def closure_watermark(target: DataFrame) -> datetime | None:
    """Newest closure already stored; a text column is read day first."""
    closed = F.col("data_encerramento")
    if dict(target.dtypes)["data_encerramento"] == "string":
        closed = F.to_timestamp_ntz(closed, F.lit("dd/MM/yyyy HH:mm:ss"))
    return target.agg(F.max(closed).alias("mark")).first()["mark"]


def closed_increment(
    target: DataFrame,
    tables: Mapping[str, DataFrame],
    as_of: datetime,
    end: datetime,
    created_from: datetime,
) -> DataFrame:
    """Tracking rows of tickets that closed after the newest closure in `target`,
    up to `end`. Write them with `sinks.write_load`; a second run then finds none, and a
    retried write replaces itself.

    A ticket that arrives late, with a closure at or before the mark, is not in any later
    increment: reload the range it closed in, whose folder the load then replaces.

    The mark is one value read ahead, so it reaches the ticket scan as a literal
    range filter. Without a mark everything since `created_from` is loaded."""
    start = closure_watermark(target) or created_from
    return tracking_closed(tables, as_of, start, end, created_from)
