from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from ticketlens.operators import reports
from ticketlens.operators.quality import duplicate_report, reconciliation
from ticketlens.plans import catalog
from ticketlens.sources.sinks import (
    by_entry_month,
    full_refresh,
    read_loads,
    shared_folder,
    write_load,
)
from ticketlens.streaming.increment import closed_increment, closure_watermark


@pytest.fixture(scope="module")
def stored(spark, sf_dir):
    """The unified tracking rows as a table partitioned by entry month."""
    path = shared_folder(spark, "unified")
    rows = by_entry_month(catalog._unified(spark, sf_dir))
    return spark.read.parquet(full_refresh(rows, path, ("mes_entrada",)))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_reports_on_the_stored_table(spark, sf_dir, stored, rows_of):
    day = catalog.REPORT_DAY
    # The registered queries count on stays before the joins multiply them.
    for report in ("volumetry", "volumetry_by_user", "mean_handling_time"):
        found = getattr(reports, report)(stored, day)
        assert rows_of(found) == rows_of(catalog.QUERIES[report](spark, sf_dir))
    deduped = reports.mean_handling_time(stored, day, dedupe=True, clip_seconds=None)
    assert rows_of(deduped) == rows_of(catalog.mean_handling_time_dedupe(spark, sf_dir))
    for parts in ({}, {"mes": 3}, {"semana": 10}, {"dia": 15}, {"mes": 12, "dia": 31}):
        plain = reports.unified_download(stored.drop("mes_entrada"), 1998, **parts)
        pruned = reports.unified_download(stored, 1998, **parts)
        assert rows_of(pruned) == rows_of(plain)


def test_calendar_filter_reaches_the_scan(spark, stored):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = plan_of(reports.unified_download(stored, 1998, mes=3))
    assert "GreaterThanOrEqual(data_entrada_n2,1998-03-01T00:00)" in plan
    assert "LessThan(data_entrada_n2,1998-04-01T00:00)" in plan
    partition_filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "199803" in partition_filters


def test_reports_read_few_columns(stored):
    plan = plan_of(reports.volumetry(stored, catalog.REPORT_DAY))
    schema = plan.split("ReadSchema: struct<")[1].split(">")[0]
    assert {c.split(":")[0] for c in schema.split(",")} == {
        "origem", "data_entrada_n2", "tipo_bilhete", "classificacao_atuacao",
    }
    assert plan.count("Scan parquet") == 1


def test_volumes_add_up_to_distinct_stays(stored):
    counted = stored.where("classificacao_atuacao <> 'VAZIO'")
    distinct = counted.select("origem", "data_entrada_n2").distinct().count()
    totals = reports.volumetry(stored, catalog.REPORT_DAY).groupBy("visao").agg(F.sum("total").alias("n"))
    by_view = {r["visao"]: r["n"] for r in totals.collect()}
    assert by_view["ANO_MES"] == by_view["SEMANAL"] == distinct
    recent = counted.where("data_entrada_n2 >= timestamp_ntz '2001-05-01 00:00:00'")
    assert by_view["DIARIO"] == recent.select("origem", "data_entrada_n2").distinct().count()


def tracked(spark, rows):
    return spark.createDataFrame(
        rows, "origem bigint, data_entrada_n2 timestamp_ntz, tma_n2_seg bigint"
    )


def test_mean_time_clip_rounding_and_null_group(spark):
    day = datetime(1993, 1, 1, 9)
    rows = [(1, day, 3661), (1, day, 3661), (2, day, 3664), (3, None, None), (4, datetime(2020, 5, 5), 9999999)]
    found = {
        (r["visao"], r["ano"], r["mes"], r["semana"]): (r["tma_medio"], r["tma_medio_seg"])
        for r in reports.mean_handling_time(tracked(spark, rows), date(1992, 12, 31)).collect()
    }
    # (3661 + 3661 + 3664) / 3 = 3662 exactly; 1 January 1993 lies in week 0.
    assert found["ANO_MES", 1993, "01", ""] == ("01:01:02", 3662)
    assert found["SEMANAL", 1993, "", "0"] == ("01:01:02", 3662)
    assert found["ANO_MES", 2020, "05", ""] == ("838:59:59", 3020399)
    assert found["ANO_MES", None, None, ""] == (None, None)
    assert found["SEMANAL", None, "", None] == (None, None)
    deduped = reports.mean_handling_time(
        tracked(spark, rows), date(1992, 12, 31), dedupe=True, clip_seconds=None
    )
    means = {(r["visao"], r["ano"]): r["tma_medio_seg"] for r in deduped.collect()}
    assert means["ANO_MES", 1993] == 3662 and means["ANO_MES", 2020] == 9999999


def test_mean_with_huge_weights(spark):
    day = datetime(2020, 5, 5)
    rows = [(day, 3000000, 10**12), (day, 1000, 10**12), (day, None, 5)]
    df = spark.createDataFrame(rows, "data_entrada_n2 timestamp_ntz, tma_n2_seg bigint, peso bigint")
    row = reports.mean_handling_time(df, date(2020, 5, 5), weight="peso").first()
    assert row["tma_medio_seg"] == 1500500
    with pytest.raises(ValueError):
        reports.mean_handling_time(df, date(2020, 5, 5), dedupe=True, weight="peso")


def test_mean_is_cut_to_whole_seconds(spark):
    day = datetime(2020, 5, 5)
    rows = [(1, day, 10), (2, day, 11), (3, day, 11)]
    row = reports.mean_handling_time(tracked(spark, rows), date(2020, 5, 5)).first()
    assert row["tma_medio_seg"] == 10


def test_pages_by_number_and_by_cursor(stored):
    """Keys that leave many ties: all columns decide, so pages meet without gap or overlap."""
    keys, size, pages = ("data_encerramento", "origem"), 150, 4
    order = [*keys, *[c for c in stored.columns if c not in keys]]
    first = stored.orderBy(*[F.col(k).asc_nulls_last() for k in order]).limit(size * pages).collect()
    summary = reports.page_summary(stored, 1, size).first()
    assert summary["total"] == stored.count()
    assert summary["total_pages"] == -(-summary["total"] // size)
    last = None
    for page in range(1, pages + 1):
        expected = first[(page - 1) * size : page * size]
        assert reports.tracking_page(stored, keys, page, size).collect() == expected
        assert reports.tracking_page(stored, keys, page_size=size, after=last).collect() == expected
        last = expected[-1].asDict()
    with pytest.raises(ValueError):
        reports.tracking_page(stored, keys, after={"origem": 1})


def test_whole_rows_tell_tracking_rows_apart(stored):
    assert stored.distinct().count() == stored.count()


def test_page_limits(stored):
    empty = reports.page_summary(stored.limit(0)).first()
    assert (empty["total"], empty["total_pages"]) == (0, 0)
    for page, size in ((0, 50), (1, 0), (1, 201)):
        with pytest.raises(ValueError):
            reports.tracking_page(stored, ["origem"], page, size)
    with pytest.raises(ValueError):
        reports.tracking_page(stored, [])


def test_range_keeps_rows_that_differ_elsewhere(stored):
    whole = stored.where("data_entrada_n2 is not null")
    found = reports.unified_range(stored, date(1990, 1, 1), date(2010, 1, 1))
    assert found.count() == whole.distinct().count()
    assert found.distinct().count() < found.count()


def test_increment_is_complete_and_runs_dry(spark, tables, rows_of, sf_dir):
    _, folder = catalog._first_load(spark, sf_dir)
    target = read_loads(spark, folder)
    before = target.count()
    args = tables, catalog.AS_OF, catalog.END, catalog.START
    more = closed_increment(target, *args)
    for _ in range(2):  # a load that is written again replaces itself
        write_load(more, folder, catalog.FIRST_LOAD_END, catalog.END)
    grown = read_loads(spark, folder)
    assert grown.count() > before
    assert rows_of(grown) == rows_of(catalog.tracking_closed(spark, sf_dir))
    assert closed_increment(grown, *args).count() == 0
    assert rows_of(closed_increment(grown.limit(0), *args)) == rows_of(grown)


def test_watermark_of_a_text_column(spark):
    df = spark.createDataFrame([("02/01/2025 03:04:05",), ("01/02/2024 00:00:00",), (None,)], "data_encerramento string")
    assert closure_watermark(df) == datetime(2025, 1, 2, 3, 4, 5)


def test_refresh_leaves_readers_their_version(spark, tmp_path):
    folder = str(tmp_path / "t")
    old = spark.read.parquet(full_refresh(spark.range(10), folder))
    new = spark.read.parquet(full_refresh(spark.range(3), folder))
    assert (old.count(), new.count()) == (10, 3)


def test_shared_folder_comes_from_the_session(spark, tmp_path):
    assert shared_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_counts(spark):
    df = spark.createDataFrame([(1, 5), (1, -5), (2, None), (None, 1)], "origem bigint, tma_n2_seg bigint")
    assert [tuple(r) for r in duplicate_report(df, "origem", 1).collect()] == [(1, 2)]
    rows = {r["etapa"]: tuple(r)[1:] for r in reconciliation(df, df, df.limit(0)).collect()}
    assert rows == {"tickets": (4, 2, 2, 0), "stays": (4, 2, 2, 1), "final": (0, 0, 0, 0)}


def test_downloads_are_the_same_where_few_rows_repeat(spark, rows_of):
    """Equal rows meet in one range of the order, newest first, in any session time zone."""
    texts = {name: "x" for name in reports.DOWNLOAD_COLUMNS}
    rows = [
        {**texts, "origem": str(i % 4), "site": None if i % 3 else "s", "entrada": f"1998-{1 + i % 12:02d}-{1 + i % 27:02d} 00:{i % 2 * 30:02d}:00",
         "saida": None if i % 5 else "1999-01-01 00:00:00"}
        for i in range(600)
    ] + [{**texts, "entrada": entry, "saida": None} for entry in (None, "1999-01-01 00:00:00", "1998-12-31 23:59:59.999999")]
    df = spark.createDataFrame(rows).withColumns(
        {"data_entrada_n2": F.col("entrada").cast("timestamp_ntz"), "data_saida_n2": F.col("saida").cast("timestamp_ntz")}
    )
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        plain = reports.unified_download(df, 1998)
        sorted_rows = reports.unified_download(df, 1998, few_repeat=True)
        assert sorted_rows.columns == plain.columns
        assert rows_of(sorted_rows) == rows_of(plain)
        entries = [r["data_entrada_n2"] for r in sorted_rows.collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert entries == sorted(entries, reverse=True) and 1 < len(entries) < 600
