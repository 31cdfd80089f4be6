from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ticketlens.operators import skew, snapshot
from ticketlens.operators.snapshot import (
    eligible_tickets,
    route_flags,
    rows_per_ticket,
    ticket_snapshot_active,
    ticket_snapshot_closed,
)
from ticketlens.plans import catalog
from ticketlens.plans.tracking import tracking_active, tracking_unified, unified_stays
from ticketlens.operators.reports import volumetry
from ticketlens.schemas import TICKET_TABLES

D = datetime(2025, 1, 10)


def ticket(code, parent=None, status=10, created=D, closed=None, network=701, owner=6611):
    return (code, parent, 5, status, "S", "U", "R", created, closed, "T", "P", "L", "I", network, owner)


def life(code, group, user=1, start=D, seq=0):
    return (code, seq, group, user, start, start + timedelta(minutes=5))


@pytest.fixture(scope="module")
def make(spark):
    def build(**rows):
        fixed = {
            "grupos": [(6611, "A", 9), (6612, "B", 9), (6563, "C", 9), (1341, "F", 1340)],
            "usuarios": [(1, "one"), (2, "two")],
            "status_ta": [(10, "OPEN"), (90, "CLOSED")],
        }
        rows = {**{name: [] for name in TICKET_TABLES}, **fixed, **rows}
        return {n: spark.createDataFrame(rows[n], schema) for n, schema in TICKET_TABLES.items()}

    return build


def codes(df):
    return sorted({r["origem"] for r in df.collect()})


def test_eligibility(make):
    t = make(
        vida=[life(1, 6611), life(2, 6563), life(3, 9999), life(4, 6563)],
        proced=[(2, 6612, 1, D), (5, 6611, 1, D), (4, 6563, 1, D)],
    )
    assert codes(eligible_tickets(t["vida"], t["proced"], t["grupos"])) == [1, 2]
    assert codes(eligible_tickets(t["vida"], t["proced"], t["grupos"], mode="life")) == [1]
    unknown = t["grupos"].where("grp_codigo <> 6611")
    assert codes(eligible_tickets(t["vida"], t["proced"], unknown, mode="life")) == []
    assert codes(eligible_tickets(t["vida"], t["proced"], unknown)) == [1, 2]
    with pytest.raises(ValueError):
        eligible_tickets(t["vida"], t["proced"], t["grupos"], mode="all")


def test_routes_need_a_known_group(make):
    t = make(vida=[life(1, 6611), life(1, 1341), life(2, 6563), life(3, 9999)])
    rows = {r["origem"]: tuple(r)[1:] for r in route_flags(t["vida"], t["grupos"]).collect()}
    assert rows == {
        1: ("SIM", "NÃO", "NÃO", "SIM"),
        2: ("NÃO", "NÃO", "SIM", "NÃO"),
        3: ("NÃO", "NÃO", "NÃO", "NÃO"),
    }
    bare = route_flags(t["vida"], t["grupos"].where("grp_codigo <> 6611"))
    assert bare.where("origem = 1").first()["passou_pelo_acesso_ericson"] == "NÃO"


def test_window_edges(make):
    moments = [D - timedelta(seconds=1), D, D + timedelta(days=1)]
    active = [ticket(i, created=m) for i, m in enumerate(moments)]
    closed = [ticket(10 + i, status=90, closed=m, created=D - timedelta(days=5)) for i, m in enumerate(moments)]
    early = ticket(20, status=90, closed=D + timedelta(hours=1), created=D - timedelta(days=50))
    t = make(ta=[*active, *closed, early], vida=[life(i, 6611) for i in range(30)])
    end, floor = D + timedelta(days=1), D - timedelta(days=20)
    assert codes(ticket_snapshot_active(t, D, end)) == [1]
    assert codes(ticket_snapshot_closed(t, D, end, floor)) == [12]


def test_only_open_roots_of_the_network(make):
    rows = [ticket(1), ticket(2, network=702), ticket(3, status=30), ticket(4, parent=1), ticket(5, status=70)]
    t = make(ta=rows, vida=[life(i, 6611) for i in range(1, 6)])
    assert codes(ticket_snapshot_active(t, D, D + timedelta(days=1))) == [1, 5]


def test_ticket_without_elements_and_copies(make):
    t = make(
        ta=[ticket(1), ticket(2), ticket(21, parent=2), ticket(22, parent=2)],
        vida=[life(1, 6611), life(2, 6612)],
        equip=[(21, "h", "v"), (21, "h", "v"), (21, "k", "v"), (1, "root", "v")],
    )
    rows = ticket_snapshot_active(t, D, D + timedelta(days=1)).collect()
    found = sorted((r["origem"], r["elemento"] or 0, r["hostname"] or "") for r in rows)
    assert found == [(1, 0, ""), (2, 21, "h"), (2, 21, "k"), (2, 22, "")]
    lone = next(r for r in rows if r["origem"] == 1)
    assert (lone["site"], lone["uf"], lone["impacto"]) == (None, None, None)
    assert (lone["regional"], lone["status"], lone["grupo_responsavel"]) == ("R", "OPEN", "A")


def test_rows_per_ticket(make):
    t = make(
        ta=[ticket(1), ticket(2), ticket(21, parent=2), ticket(22, parent=2), ticket(31, parent=3)],
        equip=[(21, "h", "v"), (21, "h", "v"), (21, "k", None), (21, None, None), (1, "root", "v")],
    )
    assert {r["origem"]: r["linhas"] for r in rows_per_ticket(t).collect()} == {2: 4, 3: 1}


def test_two_elements_two_stays_three_procedures(make):
    t = make(
        ta=[ticket(1), ticket(11, parent=1), ticket(12, parent=1)],
        vida=[life(1, 6611, 1), life(1, 6612, 2, D + timedelta(hours=1), 1)],
        proced=[(1, 6611, 1, D), (1, 6611, 2, D), (1, 6612, 1, D)],
    )
    end = D + timedelta(days=1)
    assert tracking_active(t, end, D, end).count() == 12
    unified = tracking_unified(t, end, D, end, D)
    month = volumetry(unified, end).where("visao = 'ANO_MES'").collect()
    assert sum(r["total"] for r in month) == 2
    assert [r["repeats"] for r in unified_stays(t, end, D, end, D, weighted=True).collect()] == [6, 6]


def test_ticket_without_stays_is_unclassified(make):
    t = make(ta=[ticket(1)], vida=[life(1, 6563)], proced=[(1, 6611, 1, D)])
    row = tracking_active(t, D, D, D + timedelta(days=1)).first()
    assert row["classificacao_atuacao"] == "VAZIO" and row["data_entrada_n2"] is None
    assert row["origem_PROCEDIMENTO"] == 1


def test_empty_tables(make):
    t = make()
    assert tracking_active(t, D, D, D + timedelta(days=1)).count() == 0


@pytest.mark.parametrize("rows", [1, 3, 10**6])
@pytest.mark.parametrize("heavy", [(), (2, 5)])
def test_lines_are_elements_with_their_equipment(spark, rows_of, monkeypatch, rows, heavy):
    """Elements of several tickets, rows that come twice or differ in a site, keys and values
    missing, elements with much equipment or none."""
    monkeypatch.setattr(skew, "ROWS_PER_CHUNK", rows)
    rng = random.Random(rows)
    some = [None, "a", "b"]
    elements = [
        (rng.choice([None, *range(20, 34)]), rng.choice([None, 1, 2, 3, 4, 5]), rng.choice(some), rng.choice(some), rng.choice(some))
        for _ in range(200)
    ]
    pieces = [(rng.choice([20, 20, 21, 22, 23, 24, 25, 99]), rng.choice(some), rng.choice(some)) for _ in range(60)]
    t = {
        "ta": spark.createDataFrame(
            elements, "tqa_codigo int, tqa_origem int, tqa_area_codigo string, tqa_estado_codigo string, tqa_impacto_eqp string"
        ),
        "equip": spark.createDataFrame(pieces, "aeq_ta int, aeq_hostname string, aeq_fabricante string"),
    }
    plain = snapshot._elements(t["ta"]).distinct().join(snapshot._equipment(t["equip"]).distinct(), "elemento", "left")
    sizes = F.broadcast(spark.createDataFrame([(k, 10**6) for k in heavy], "origem int, linhas long"))
    light, hot = snapshot.line_parts(t, sizes)
    assert {r["origem"] for r in light.collect()} == {1, 2, 3, 4, 5} - {*heavy}
    assert rows_of(light.unionByName(hot.drop("linhas"))) == rows_of(plain)


def test_long_rows_of_elements_travel_once(spark, tables):
    """By ticket; to the equipment go their keys alone. Joins are shuffled, as at size."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        df = snapshot.ticket_snapshot_closed(tables, catalog.START, catalog.END, catalog.START)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set(key, before)
    lines = plan.split("\n")
    sent = [below for line, below in zip(lines, lines[1:]) if " Exchange " in line and "elemento" in line]
    assert sent and not [line for line in sent if "impacto" in line]
