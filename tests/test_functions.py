from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ticketlens.functions.calendar import calendar_bounds, calendar_filter, ntz, week_mode1
from ticketlens.functions.durations import (
    clip_time,
    hms,
    hms_to_seconds,
    report_hms,
    seconds_between,
)


def week_by_rule(day: date) -> int:
    """Week of the year counted day by day from the first of January."""
    first = date(day.year, 1, 1)
    # The Monday-started week of 1 January has 7 - weekday days in the year.
    week = 1 if 7 - first.weekday() >= 4 else 0
    step = first
    while step < day:
        step += timedelta(days=1)
        week += step.weekday() == 0
    return week


@pytest.fixture(scope="module")
def days(spark):
    first = date(1990, 1, 1)
    count = (date(2036, 1, 1) - first).days
    return spark.range(count).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("d"))


def test_week_on_every_day(days):
    found = {r["d"]: r["w"] for r in days.select("d", week_mode1(F.col("d")).alias("w")).collect()}
    assert len(found) == 16801
    assert all(week == week_by_rule(day) for day, week in found.items())
    assert found[date(1993, 1, 1)] == 0
    assert found[date(1990, 12, 31)] == 53
    assert found[date(2026, 1, 1)] == 1


def test_calendar_ranges_equal_the_calendar_parts(days):
    stamped = days.select(F.col("d").cast("timestamp_ntz").alias("t"), "d")
    parts = [
        (r["d"], r["w"]) for r in days.select("d", week_mode1(F.col("d")).alias("w")).collect()
    ]
    for year in (1992, 1993, 2000, 2015, 2020, 2024):
        for week in (0, 1, 2, 9, 52, 53):
            low, high = calendar_bounds(year, semana=week)
            inside = {d for d, _ in parts if low.date() <= d < high.date()}
            assert inside == {d for d, w in parts if d.year == year and w == week}
    picked = calendar_filter(stamped, "t", 2004, mes=2, dia=29).collect()
    assert [r["d"] for r in picked] == [date(2004, 2, 29)]
    assert calendar_filter(stamped, "t", 2004, dia=30).count() == 11
    assert calendar_filter(stamped, "t", 2004, mes=12).count() == 31
    assert calendar_filter(stamped, "t", 2004, mes=1, semana=40).count() == 0


@pytest.mark.parametrize("bad", [{"mes": 0}, {"mes": 13}, {"dia": 0}, {"dia": 32}, {"semana": 54}])
def test_calendar_arguments(days, bad):
    with pytest.raises(ValueError):
        calendar_filter(days, "d", 2000, **bad)


def test_duration_texts(spark):
    values = [3661, 59, 360000, 0, -61, None]
    df = spark.createDataFrame([(v,) for v in values], "s bigint")
    rows = df.select("s", hms(F.col("s")).alias("h"), report_hms(F.col("s")).alias("r")).collect()
    assert [r["h"] for r in rows] == ["1:01:01", "0:00:59", "100:00:00", "0:00:00", "-0:01:01", None]
    assert [r["r"] for r in rows] == ["01:01:01", "00:00:59", "100:00:00", "00:00:00", "-00:01:01", None]


def test_duration_round_trip(spark):
    df = spark.range(-200000, 4000000, 977).select("id", hms_to_seconds(hms(F.col("id"))).alias("s"))
    assert df.where("s is null or s <> id").count() == 0
    bad = spark.createDataFrame([("x",), ("1:2:3",), ("",), (None,)], "t string")
    assert [r[0] for r in bad.select(hms_to_seconds(F.col("t"))).collect()] == [None] * 4


def test_clip(spark):
    df = spark.createDataFrame([(3020399,), (3020400,), (-3020400,), (None,)], "s bigint")
    assert [r[0] for r in df.select(clip_time(F.col("s"))).collect()] == [3020399, 3020399, -3020399, None]
    assert [r[0] for r in df.select(clip_time(F.col("s"), None)).collect()][1] == 3020400


def test_seconds_are_rounded_and_zone_free(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        a, b = datetime(2018, 11, 3, 23, 0), datetime(2018, 11, 4, 1, 0, 0, 500000)
        row = spark.range(1).select(
            seconds_between(ntz(a), ntz(b)).alias("up"), seconds_between(ntz(b), ntz(a)).alias("down")
        ).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert (row["up"], row["down"]) == (7201, -7201)
