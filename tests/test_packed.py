"""Rows that travel packed are those of the plain joins, in the same order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketlens.operators import reports, rollup
from ticketlens.operators.packed import PIECE, Packed, listed, pieces


def _table(spark):
    """Two light tickets and the pieces of a heavy one, with ties and a missing list."""
    lines = spark.createDataFrame([(1, 9, "b"), (1, 8, None), (1, 8, "a")], "origem long, elemento long, hostname string")
    stays = spark.sql(
        "select * from values (1L, timestamp_ntz '2020-01-02 00:00:00'), (1L, timestamp_ntz '2020-01-01 00:00:00')"
        " as t(origem, data_entrada_n2)"
    ).select("*", F.col("data_entrada_n2").alias("data_saida_n2"), F.lit("u").alias("usuario_atuacao_PROCEDIMENTO"))
    tickets = spark.createDataFrame([(1, 5), (2, 7)], "origem long, data_criacao long")
    light = tickets.join(lines, "origem", "left").join(stays, "origem", "left")
    packed = (
        tickets.join(listed(lines, "origem", "l"), "origem", "left")
        .join(listed(stays, "origem", "s"), "origem", "left")
        .withColumn(PIECE, F.lit(False))
    )
    heavy = light.where("origem = 1").withColumns({"origem": F.lit(3).cast("long"), "data_criacao": F.lit(6).cast("long")})
    names = {"l": lines.columns[1:], "s": stays.columns[1:]}
    frame = packed.unionByName(pieces(heavy, names))
    columns = light.columns
    return light.unionByName(heavy), Packed(frame, ("l", "s"), lambda rows, keep: rows.select(*columns, *keep))


def test_opened_rows_and_their_order(spark, rows_of):
    plain, packed = _table(spark)
    assert rows_of(packed.rows()) == rows_of(plain)
    assert reports.unified_newest(packed).collect() == reports.unified_newest(plain).collect()


def test_rows_are_sorted_by_packed_rows(spark):
    """What is dealt into ranges is the lists: long rows are made behind the last shuffle."""
    _, packed = _table(spark)
    plan = reports.unified_newest(packed)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("RepartitionByExpression")


def test_a_list_is_opened_to_deal_by_its_column(spark, rows_of):
    plain, packed = _table(spark)
    days = packed.opened("data_entrada_n2")
    days = days.with_column("dia", F.day(days.value("data_entrada_n2")))
    assert rows_of(days.rows()) == rows_of(plain.withColumn("dia", F.day("data_entrada_n2")))


def test_states_of_parts_add_up(spark, rows_of):
    rows = spark.sql(
        "select * from values (1L, timestamp_ntz '2020-01-02 00:00:00', 't', 'SIM', 'u', 60L),"
        " (1L, timestamp_ntz '2020-01-02 00:00:00', 't', 'SIM', 'v', 30L), (2L, null, 't', 'NAO', null, null),"
        " (3L, timestamp_ntz '2020-01-02 00:00:00', 't', 'VAZIO', 'u', 10L)"
        " as t(origem, data_entrada_n2, tipo_bilhete, classificacao_atuacao, usuario_atuacao, tma_n2_seg)"
    )
    whole = rollup.daily_states(rows)
    parts = rollup.daily_states(rows.where("origem < 2"), rows.where("origem >= 2"))
    assert rows_of(whole) == rows_of(parts)
    found = {(r["medida"], str(r["entrada"]), r["valor"]): (r["n"], r["s"]) for r in whole.collect()}
    assert found == {
        ("classe", "2020-01-02", "SIM"): (1, None),
        ("classe", "None", "NAO"): (0, None),
        ("usuario", "2020-01-02", "u"): (1, None),
        ("usuario", "2020-01-02", "v"): (1, None),
        ("tempo", "2020-01-02", None): (3, 100),
        ("tempo", "None", None): (0, None),
    }
