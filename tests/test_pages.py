"""Tables stored in the order of their pages, with measures observed while writing."""

from __future__ import annotations

from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ticketlens.operators import quality, reports
from ticketlens.sources import pages
from ticketlens.sources.versions import current

KEYS = ("a", "b")
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@pytest.fixture
def small_ranges(spark):
    settings = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _table(spark, n=2000):
    """Ties in the keys, nulls, rows equal in all columns."""
    ids = spark.range(0, n, 1, 4)
    return ids.select(
        F.when(F.col("id") % 7 > 0, F.col("id") % 40).alias("a"),
        F.when(F.col("id") % 5 > 0, (F.col("id") % 11).cast("string")).alias("b"),
        (F.col("id") % 300).alias("c"),
        F.lit(None).cast("timestamp_ntz").alias("t"),
    )


def _list(df):
    return [tuple(row) for row in df.collect()]


def test_every_page_is_that_of_a_ranking_over_all_rows(spark, tmp_path, small_ranges):
    df, folder = _table(spark), str(tmp_path / "t")
    assert pages.write_pages(df, folder, KEYS) == 1
    whole = _list(df.orderBy(*[F.col(c).asc_nulls_last() for c in df.columns]))
    for size in (1, 37, 199):
        last = -(-len(whole) // size)
        for page in sorted({1, 2, last // 2 or 1, last, last + 1}):
            got = pages.read_page(spark, folder, page, size)
            assert _list(got) == whole[(page - 1) * size : page * size]
            assert got.dtypes == df.dtypes
    assert sorted(map(repr, _list(pages.read_rows(spark, folder)))) == sorted(map(repr, whole))


def test_a_deep_page_reads_its_own_range_only(spark, tmp_path, small_ranges):
    folder = str(tmp_path / "t")
    pages.write_pages(_table(spark), folder, KEYS)
    _, content = current(spark, folder)
    ranges = spark.read.parquet(content[pages.INDEX]).orderBy("inicio").collect()
    assert len(ranges) > 5 and sum(r["linhas"] for r in ranges) == 2000
    inside = max(ranges, key=lambda r: r["linhas"])
    page = pages.read_page(spark, folder, inside["inicio"] + 1, 1)
    assert len(page.inputFiles()) == 1
    assert f"{pages.RANGE}={inside[pages.RANGE]}/" in page.inputFiles()[0]


def test_measures_are_those_of_the_rows(spark, tmp_path, small_ranges):
    folder = str(tmp_path / "t")
    tags = ("ATIVO", "FECHADO", "OUTRO")
    at = F.to_timestamp_ntz(F.lit("2001-02-03 04:05:06.123456"))
    df = _table(spark).withColumns(
        {
            "x": F.when(F.col("c") % 3 > 0, "ATIVO").otherwise("FECHADO"),
            "data_entrada_n2": F.when(F.col("c") == 7, at),
            "data_encerramento": F.lit(None).cast("timestamp_ntz"),
        }
    )
    pages.write_pages(df, folder, KEYS, quality.freshness_values("x", tags))
    seen = pages.measures(spark, folder)
    row = spark.createDataFrame([tuple(seen.values())], ", ".join(f"{name} string" for name in seen))
    as_of = datetime(2001, 3, 1)
    assert _list(quality.freshness_rows(row, tags, as_of)) == _list(quality.table_freshness(df, "x", tags, as_of))
    for size in (1, 7, 200):
        got = pages.read_summary(spark, folder, 2, size)
        assert _list(got) == _list(reports.page_summary(df, 2, size))
        assert got.dtypes == reports.page_summary(df, 2, size).dtypes


@pytest.mark.parametrize("rows", ["none", "no partition"])
def test_an_empty_table(spark, tmp_path, rows):
    df = _table(spark).where("c < 0") if rows == "none" else spark.createDataFrame([], _table(spark).schema)
    folder = str(tmp_path / "t")
    pages.write_pages(df, folder, KEYS, {"most": F.max("c")})
    assert pages.read_page(spark, folder).collect() == [] and pages.read_rows(spark, folder).count() == 0
    assert pages.read_page(spark, folder).dtypes == df.dtypes
    assert pages.measures(spark, folder) == {"total": "0", "most": None}
    assert _list(pages.read_summary(spark, folder)) == [(1, 50, 0, 0)]


def test_a_failed_write_leaves_the_version_before(spark, tmp_path):
    folder = str(tmp_path / "t")
    pages.write_pages(_table(spark, 50), folder, KEYS)
    broken = _table(spark).withColumn("c", F.when(F.col("c") == 299, F.raise_error(F.lit("dies"))).otherwise(F.col("c")))
    with pytest.raises(Exception, match="dies"):
        pages.write_pages(broken, folder, KEYS)
    assert pages.read_rows(spark, folder).count() == 50 and current(spark, folder)[0] == 1
    pages.write_pages(_table(spark, 60), folder, KEYS)
    assert pages.measures(spark, folder)["total"] == "60"


def test_wrong_arguments(spark, tmp_path):
    folder = str(tmp_path / "t")
    with pytest.raises(ValueError, match="keys"):
        pages.write_pages(_table(spark), folder, ())
    with pytest.raises(ValueError, match=pages.RANGE):
        pages.write_pages(_table(spark).withColumn(pages.RANGE, F.lit(1)), folder, KEYS)
    with pytest.raises(ValueError, match="nothing"):
        pages.read_page(spark, folder)


def test_draft_and_shuffles_go_when_the_table_is_written(spark, tmp_path, small_ranges):
    """Shuffle files of both jobs are removed with them, whenever the driver collects garbage."""
    local = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    before, setting = {f.name for f in local.rglob("shuffle_*.data")}, spark.conf.get(CLEANUP)
    folder = tmp_path / "t"
    rows = _table(spark).groupBy("a", "b", "c", "t").agg(F.count(F.lit(1)).alias("n"))
    pages.write_pages(rows, str(folder), KEYS)
    left = {f.name for f in local.rglob("shuffle_*.data")} - before
    # Only the one row per range of the index: no file of the table's own shuffles.
    assert sum(f.stat().st_size for f in local.rglob("shuffle_*.data") if f.name in left) < 4096
    assert not list((folder / pages.DRAFT).iterdir())
    assert pages.read_rows(spark, str(folder)).count() == rows.count()
    assert spark.conf.get(CLEANUP) == setting
