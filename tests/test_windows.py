from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ticketlens.operators.windows import all_windows, load_windows, rows_per_window, window_bounds
from ticketlens.sources.tables import window_predicates

START, END = datetime(2025, 1, 15, 10, 30), datetime(2025, 3, 2, 5, 0)


def day(month, number, hour=0, minute=0):
    return datetime(2025, month, number, hour, minute)


def test_monthly_restarts_on_the_first():
    assert window_bounds(START, END, "monthly") == [
        (day(1, 15), day(2, 1)),
        (day(2, 1), day(3, 1)),
        (day(3, 1), day(3, 2)),
    ]


def test_monthly_keeps_hours():
    assert window_bounds(START, END, "monthly", truncate=False) == [
        (START, day(2, 1, 10, 30)),
        (day(2, 1, 10, 30), day(3, 1, 10, 30)),
        (day(3, 1, 10, 30), END),
    ]


@pytest.mark.parametrize("cycle", ["daily", "weekly", "monthly"])
@pytest.mark.parametrize("truncate", [True, False])
def test_windows_are_contiguous_and_cover(spark, cycle, truncate):
    listed = window_bounds(START, END, cycle, truncate)
    assert all(a[1] == b[0] for a, b in zip(listed, listed[1:]))
    low, high = (START, END) if not truncate else (day(1, 15), day(3, 2))
    assert (listed[0][0], listed[-1][1]) == (low, high)
    rows = all_windows(spark, START, END, cycle, truncate).orderBy("window_start").collect()
    assert [tuple(r) for r in rows] == listed


@pytest.mark.parametrize("cycle", ["daily", "weekly", "monthly"])
@pytest.mark.parametrize("closed", ["left", "right"])
@pytest.mark.parametrize("truncate", [True, False])
def test_every_instant_lands_in_its_window(spark, cycle, closed, truncate):
    listed = window_bounds(START, END, cycle, truncate)
    edges = [moment for window in listed for moment in window]
    step = timedelta(microseconds=1)
    instants = sorted({e + d for e in edges for d in (-step, 0 * step, step, 7000000 * step)})
    df = spark.createDataFrame([(t,) for t in instants], "t timestamp_ntz")

    def holds(window, t):
        low, high = window
        return low <= t < high if closed == "left" else low < t <= high

    expected = [(t, *w) for t in instants for w in listed if holds(w, t)]
    found = load_windows(df, "t", START, END, cycle, closed, truncate)
    assert sorted(map(tuple, found.collect())) == expected
    counts = rows_per_window(df, "t", START, END, cycle, closed, truncate)
    by_window = {(r[0], r[1]): r[2] for r in counts.collect()}
    assert by_window == {w: sum(holds(w, t) for t in instants) for w in listed}


def test_empty_and_wrong_periods(spark):
    assert window_bounds(END, START) == []
    assert all_windows(spark, END, START).count() == 0
    with pytest.raises(ValueError):
        window_bounds(START, END, "hourly")
    with pytest.raises(ValueError):
        load_windows(spark.range(1).select(F.lit(None).alias("t")), "t", START, END, closed="both")


def test_scan_predicates():
    assert window_predicates("t", day(1, 1), day(1, 3), closed="right") == [
        "t > TIMESTAMP '2025-01-01 00:00:00' AND t <= TIMESTAMP '2025-01-02 00:00:00'",
        "t > TIMESTAMP '2025-01-02 00:00:00' AND t <= TIMESTAMP '2025-01-03 00:00:00'",
    ]
