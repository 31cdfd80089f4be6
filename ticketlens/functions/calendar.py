"""Calendar parts and calendar filters written as ranges."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ntz(moment: datetime | date | str) -> Column:
    """Zone-free timestamp literal, whatever the session time zone."""
    return F.lit(str(moment)).cast("timestamp_ntz")


def week_mode1(day: Column) -> Column:
    """Week 0-53 of the calendar year: weeks start on Monday and week 1 is the
    first one with at least four days in the year."""
    day = day.cast("date")
    first_weekday = F.weekday(F.trunc(day, "YEAR"))
    full_weeks = F.call_function("div", F.dayofyear(day) - 1 + first_weekday, F.lit(7))
    return (full_weeks + F.when(first_weekday <= 3, 1).otherwise(0)).cast("int")


def _week_bounds(year: int, week: int) -> tuple[datetime, datetime]:
    january1 = datetime(year, 1, 1)
    monday = january1 - timedelta(days=january1.weekday())
    # The week holding 1 January counts as week 1 when it starts by Thursday.
    first = monday if january1.weekday() <= 3 else monday + timedelta(days=7)
    start = first + timedelta(days=7 * (week - 1))
    return start, start + timedelta(days=7)


def calendar_bounds(
    ano: int, mes: int | None = None, semana: int | None = None
) -> tuple[datetime, datetime]:
    """Half-open range of a year, narrowed to a month and / or a week of it.

    The range may be empty (lower bound not below the upper one)."""
    ranges = [(datetime(ano, 1, 1), datetime(ano + 1, 1, 1))]
    if mes is not None:
        if not 1 <= mes <= 12:
            raise ValueError("mes must be 1-12")
        ranges.append((datetime(ano, mes, 1), datetime(ano + mes // 12, mes % 12 + 1, 1)))
    if semana is not None:
        if not 0 <= semana <= 53:
            raise ValueError("semana must be 0-53")
        ranges.append(_week_bounds(ano, semana))
    return max(low for low, _ in ranges), min(high for _, high in ranges)


def within(df: DataFrame, column: str, low: datetime, high: datetime) -> DataFrame:
    """Rows with low <= column < high, as plain comparisons the scan can use.

    A table partitioned by entry month (`mes_entrada`) is also pruned by it."""
    rows = df.where((F.col(column) >= ntz(low)) & (F.col(column) < ntz(high)))
    if "mes_entrada" in df.columns and column == "data_entrada_n2":
        months = (low.year * 100 + low.month, high.year * 100 + high.month)
        rows = rows.where(F.col("mes_entrada").between(*months))
    return rows


def calendar_filter(
    df: DataFrame,
    column: str,
    ano: int,
    mes: int | None = None,
    dia: int | None = None,
    semana: int | None = None,
) -> DataFrame:
    """Rows of a year and, when given, of a month, a day of month and a week."""
    if dia is not None and not 1 <= dia <= 31:
        raise ValueError("dia must be 1-31")
    rows = within(df, column, *calendar_bounds(ano, mes, semana))
    # A day without a month means that day in every month.
    return rows if dia is None else rows.where(F.dayofmonth(column) == dia)
