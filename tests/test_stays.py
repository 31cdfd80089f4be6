from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ticketlens.operators.procedures import procedure_summary, stays_with_procedures
from ticketlens.operators.stays import classify_stay, group_stays, stay_table
from ticketlens.plans import catalog, tracking
from ticketlens.schemas import GRUPOS, PROCED, TRACKING, USUARIOS, VIDA

T0 = datetime(2025, 5, 1, 8, 0)
X, Y = 1, 2


@pytest.fixture(scope="module")
def groups(spark):
    return spark.createDataFrame([(6611, "A", 9), (6612, "B", 9), (1341, "F", 1340)], GRUPOS)


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame([(X, "X"), (Y, "Y")], USUARIOS)


def stays_of(spark, groups, users, rows, as_of=T0 + timedelta(days=1)):
    df = stay_table(spark.createDataFrame(rows, VIDA), groups, users, as_of)
    return classify_stay(df).orderBy(F.col("data_entrada_n2").asc_nulls_last()).collect()


def visit(position, user, ticket=1, group=6611, minutes=10):
    start = T0 + timedelta(hours=position)
    return (ticket, position, group, user, start, start + timedelta(minutes=minutes))


def test_same_user_then_nobody_then_same_user(spark, groups, users):
    rows = stays_of(spark, groups, users, [visit(i, u) for i, u in enumerate([X, X, None, X])])
    assert [r["inicio_atuacao"] for r in rows] == [1, 0, 0, 1]
    assert [r["classificacao_atuacao"] for r in rows] == ["SIM", "VAZIO", "NAO", "SIM"]
    assert [r["quantidade_atuacao"] for r in rows] == [2, 2, None, 2]
    assert [r["tempo_total_atuacao"] for r in rows] == ["0:30:00", "0:30:00", None, "0:30:00"]
    assert [r["tempo_total_n2"] for r in rows] == ["0:40:00"] * 4


def test_user_change_starts_again(spark, groups, users):
    rows = stays_of(spark, groups, users, [visit(i, u) for i, u in enumerate([X, Y, X])])
    assert [r["inicio_atuacao"] for r in rows] == [1, 1, 1]


def test_other_groups_do_not_interrupt(spark, groups, users):
    rows = [visit(0, X), visit(1, Y, group=1341), visit(2, X, group=6612)]
    found = stays_of(spark, groups, users, rows)
    assert [(r["grupo_n2"], r["inicio_atuacao"]) for r in found] == [("A", 1), ("B", 0)]


def test_missing_entry_comes_last(spark, groups, users):
    rows = [(1, 0, 6611, X, None, T0), visit(1, Y)]
    found = stays_of(spark, groups, users, rows)
    assert [r["usuario_atuacao"] for r in found] == ["Y", "X"]
    assert [r["inicio_atuacao"] for r in found] == [1, 1]
    assert found[1]["tma_n2"] is None and found[1]["tma_n2_seg"] is None


def test_open_and_negative_stays(spark, groups, users):
    rows = [(1, 0, 6611, None, T0, None), (2, 0, 6611, 77, T0, T0 - timedelta(seconds=61))]
    found = {r["origem"]: r for r in stays_of(spark, groups, users, rows)}
    assert (found[1]["ainda_na_fila"], found[1]["tma_n2"]) == ("SIM", "24:00:00")
    assert found[1]["teve_atuacao"] == "NAO" and found[1]["tempo_total_atuacao"] is None
    assert (found[2]["tma_n2"], found[2]["usuario_atuacao"]) == ("-0:01:01", None)
    assert found[2]["teve_atuacao"] == "SIM"


def test_one_procedure_entry(spark, groups, users):
    procs = spark.createDataFrame([(1, 6611, X, T0), (1, 6563, X, T0), (2, 6612, 50, T0)], PROCED)
    rows = {r["origem_PROCEDIMENTO"]: r for r in procedure_summary(procs, groups, users).collect()}
    assert set(rows) == {1, 2}
    one = rows[1]
    assert one["data_entrada_n2_PROCEDIMENTO"] == one["data_saida_n2_PROCEDIMENTO"] == T0
    assert one["tma_n2_PROCEDIMENTO"] == one["tempo_total_n2_PROCEDIMENTO"] == "0:00:00"
    assert one["quantidade_atuacao_PROCEDIMENTO"] == 1 and one["ainda_na_fila_PROCEDIMENTO"] is None
    assert rows[2]["usuario_atuacao_PROCEDIMENTO"] is None


def test_procedures_of_tickets_without_stay(spark, groups, users):
    life = spark.createDataFrame([visit(0, X)], VIDA)
    procs = spark.createDataFrame([(1, 6611, X, T0), (2, 6611, X, T0)], PROCED)
    both = stays_with_procedures(
        stay_table(life, groups, users, T0), procedure_summary(procs, groups, users)
    )
    assert sorted((r["origem"], r["origem_atuacao"]) for r in both.collect()) == [
        (1, "VIDA"),
        (2, "PROCEDIMENTO"),
    ]


def test_starts_add_up(tables):
    rows = stay_table(tables["vida"], tables["grupos"], tables["usuarios"], catalog.AS_OF)
    sums = rows.groupBy("origem").agg(
        F.sum("inicio_atuacao").alias("s"), F.max("quantidade_atuacao").alias("q")
    )
    assert sums.where("q is not null and s <> q").count() == 0
    assert rows.count() == tables["vida"].where("vda_grupo in (6611, 6612)").count()


def test_tracking_rows_are_the_product(tables):
    """Snapshot rows x max(1, stays) x max(1, procedure rows) per ticket."""
    from ticketlens.operators.snapshot import ticket_snapshot_active

    shot = ticket_snapshot_active(tables, catalog.START, catalog.END)
    base = group_stays(tables["vida"], tables["grupos"], tables["usuarios"], catalog.AS_OF)
    procs = procedure_summary(tables["proced"], tables["grupos"], tables["usuarios"])
    final = tracking.tracking_active(tables, catalog.AS_OF, catalog.START, catalog.END)
    assert final.columns == [f.name for f in TRACKING]
    counts = (
        shot.groupBy("origem").agg(F.count("*").alias("n"))
        .join(base.groupBy("origem").agg(F.count("*").alias("s")), "origem", "left")
        .join(procs.groupBy(F.col("origem_PROCEDIMENTO").alias("origem")).agg(F.count("*").alias("p")),
              "origem", "left")
        .selectExpr("sum(n * coalesce(s, 1) * coalesce(p, 1))").first()[0]
    )
    assert final.count() == counts
