"""Ticket snapshots: root tickets with their elements, equipment and routes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.functions.calendar import ntz
from ticketlens.operators.skew import chunked_join, counts_of, heavy, split
from ticketlens.schemas import SNAPSHOT

# Codes and texts that results depend on.
N2_GROUPS = (6611, 6612)
ROUTE_GROUPS = {
    "passou_pelo_acesso_ericson": 6611,
    "passou_pelo_acesso_huawei": 6612,
    "passou_pelo_coran": 6563,
}
FIELD_PARENT_GROUP = 1340
NETWORK_TYPE = 701
ACTIVE_STATUS = (10, 20, 70)
CLOSED_STATUS = (90,)
TAG = "origem_tabela"
ACTIVE_TAG = "ATIVO"
CLOSED_TAG = "FECHADO"
TICKET_KEYS = {"vida": "vda_ta", "proced": "pca_ta", "ta": "tqa_origem"}
YES = "SIM"
NO_ROUTE = "NÃO"


def _in_n2(column: str, groups: Sequence[int]) -> Column:
    return F.coalesce(F.col(column).isin(list(groups)), F.lit(False))


def _route_conditions() -> dict[str, Column]:
    # A flag needs the group to exist, so codes are tested on the group table.
    by_code = {name: F.col("grp_codigo") == code for name, code in ROUTE_GROUPS.items()}
    return {**by_code, "passou_pelo_campo": F.col("grp_pai") == FIELD_PARENT_GROUP}


def _life_profile(life: DataFrame, groups: DataFrame, n2: Sequence[int]) -> DataFrame:
    """One row per ticket with a life row: N2 membership and route flags.

    A single aggregate with map-side partials, so a ticket with very many life
    rows costs no more than any other."""
    # Of the group table only the codes and children that the flags ask for: a few rows
    # whatever the table's size, so the life rows never travel by group.
    asked = F.col("grp_codigo").isin([*n2, *ROUTE_GROUPS.values()]) | (
        F.col("grp_pai") == FIELD_PARENT_GROUP
    )
    known = life.join(
        groups.where(asked).select("grp_codigo", "grp_pai"),
        F.col("vda_grupo") == F.col("grp_codigo"),
        "left",
    )

    def any_true(condition: Column) -> Column:
        return F.coalesce(F.bool_or(condition), F.lit(False))

    flags = [any_true(c).alias(name) for name, c in _route_conditions().items()]
    in_n2 = _in_n2("vda_grupo", n2)
    return known.groupBy(F.col("vda_ta").alias("origem")).agg(
        any_true(in_n2).alias("vida_n2"),
        any_true(in_n2 & F.col("grp_codigo").isNotNull()).alias("vida_n2_conhecida"),
        *flags,
    )


def _eligible_profile(
    life: DataFrame, procs: DataFrame, groups: DataFrame, mode: str, n2: Sequence[int]
) -> DataFrame:
    profile = _life_profile(life, groups, n2)
    if mode == "life":
        return profile.where("vida_n2_conhecida")
    if mode != "life_or_procedure":
        raise ValueError("mode must be life_or_procedure or life")
    acted = procs.where(_in_n2("pca_grupo", n2)).select(F.col("pca_ta").alias("origem")).distinct()
    found = profile.join(acted.withColumn("tem_proc", F.lit(True)), "origem", "left")
    return found.where(F.col("vida_n2") | F.col("tem_proc")).drop("tem_proc")


def eligible_tickets(
    life: DataFrame,
    procs: DataFrame,
    groups: DataFrame,
    mode: str = "life_or_procedure",
    n2: Sequence[int] = N2_GROUPS,
) -> DataFrame:
    """Tickets with a life row that have a life row or a procedure in the N2
    groups; `mode="life"` asks for a life row in a known N2 group."""
    return _eligible_profile(life, procs, groups, mode, n2).select("origem")


def _flag_text(name: str) -> Column:
    return F.when(F.col(name), YES).otherwise(NO_ROUTE).alias(name)


def route_flags(life: DataFrame, groups: DataFrame) -> DataFrame:
    """SIM / NÃO per ticket with a life row, for each of the four routes."""
    profile = _life_profile(life, groups, N2_GROUPS)
    return profile.select("origem", *[_flag_text(name) for name in _route_conditions()])


def _roots(ta: DataFrame, status: Sequence[int]) -> DataFrame:
    return ta.where(
        F.col("tqa_origem").isNull()
        & (F.col("tqa_tipo_rede") == NETWORK_TYPE)
        & F.col("tqa_status").isin(list(status))
    )


def _created_in(start: datetime, end: datetime) -> Column:
    created = F.col("tqa_data_criacao")
    return (created >= ntz(start)) & (created < ntz(end))


def _closed_in(start: datetime, end: datetime, created_from: datetime) -> Column:
    closed = F.col("tqa_data_encerramento")
    created = F.col("tqa_data_criacao") >= ntz(created_from)
    return created & (closed > ntz(start)) & (closed <= ntz(end))


def active_roots(ta: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Open root tickets created in [start, end)."""
    return _roots(ta, ACTIVE_STATUS).where(_created_in(start, end))


def closed_roots(
    ta: DataFrame, start: datetime, end: datetime, created_from: datetime
) -> DataFrame:
    """Closed root tickets that closed in (start, end], created since a floor."""
    return _roots(ta, CLOSED_STATUS).where(_closed_in(start, end, created_from))


def both_roots(
    ta: DataFrame, start: datetime, end: datetime, created_from: datetime
) -> DataFrame:
    """The rows of both, tagged, in one reading: no status is open and closed. Unlike a union
    they keep the order of a join, so that the next one does not sort them again."""
    active = F.col("tqa_status").isin(list(ACTIVE_STATUS))
    wanted = F.when(active, _created_in(start, end)).otherwise(_closed_in(start, end, created_from))
    tag = F.when(active, ACTIVE_TAG).otherwise(CLOSED_TAG)
    return _roots(ta, (*ACTIVE_STATUS, *CLOSED_STATUS)).where(wanted).withColumn(TAG, tag)


def keyed_tables(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The ticket tables without rows that have no key, which match nothing. They are left out by
    name, so that all uses of a table read it by one filter and can share its shuffle."""
    ready = dict(tables)
    for name, key in (*TICKET_KEYS.items(), ("equip", "aeq_ta")):
        ready[name] = tables[name].where(F.col(key).isNotNull())
    return ready


def load_tables(tables: Mapping[str, DataFrame], roots: DataFrame) -> dict[str, DataFrame]:
    """The ticket tables with the rows of one load's tickets only: life rows, procedures
    and elements of the roots. Spark chooses between broadcast and shuffle for each semi-join
    by the size it sees. Equipment is chosen where it is joined: a semi-join ahead would send
    the codes of the elements once more."""
    ready = keyed_tables(tables)
    codes = roots.select(F.col("tqa_codigo").alias("codigo"))
    for name, key in TICKET_KEYS.items():
        ready[name] = ready[name].join(codes, F.col(key) == F.col("codigo"), "left_semi")
    return ready


def ticket_rows(roots: DataFrame, tables: Mapping[str, DataFrame], mode: str) -> DataFrame:
    """Eligible roots with names and route flags, one row per ticket."""
    eligible = _eligible_profile(
        tables["vida"], tables["proced"], tables["grupos"], mode, N2_GROUPS
    )
    owner_groups = tables["grupos"].select(
        F.col("grp_codigo").alias("tqa_responsavelpor_grupo"),
        F.col("grp_nome").alias("grupo_responsavel"),
    )
    # One row per status code, and there are four codes at most: bounded.
    status_names = F.broadcast(
        tables["status_ta"]
        .where(F.col("sta_codigo").isin([*ACTIVE_STATUS, *CLOSED_STATUS]))
        .select(F.col("sta_codigo").alias("tqa_status"), F.col("sta_nome").alias("status"))
    )
    return (
        roots.select(
            F.col("tqa_codigo").alias("origem"),
            F.col("tqa_raiz").alias("ta_raiz"),
            F.col("tqa_gerencia_codigo").alias("regional"),
            F.col("tqa_data_criacao").alias("data_criacao"),
            F.col("tqa_data_encerramento").alias("data_encerramento"),
            F.col("tqa_tipo_bilhete").alias("tipo_bilhete"),
            F.col("tqa_tipo_site").alias("tipo_site"),
            F.col("tqa_alarme_tipo").alias("tipo_de_alarme"),
            "tqa_status",
            "tqa_responsavelpor_grupo",
            *_tag(roots),
        )
        .join(status_names, "tqa_status", "left")
        .join(owner_groups, "tqa_responsavelpor_grupo", "left")
        .join(eligible, "origem")
        .withColumns({name: _flag_text(name) for name in _route_conditions()})
    )


def _tag(roots: DataFrame) -> list[str]:
    """The source tag, where the roots carry one."""
    return [column for column in roots.columns if column == TAG]


def _elements(ta: DataFrame) -> DataFrame:
    return ta.where(F.col("tqa_origem").isNotNull()).select(
        F.col("tqa_origem").alias("origem"),
        F.col("tqa_codigo").alias("elemento"),
        F.col("tqa_area_codigo").alias("site"),
        F.col("tqa_estado_codigo").alias("uf"),
        F.col("tqa_impacto_eqp").alias("impacto"),
    )


def _equipment(equip: DataFrame) -> DataFrame:
    return equip.select(
        F.col("aeq_ta").alias("elemento"),
        F.col("aeq_hostname").alias("hostname"),
        F.col("aeq_fabricante").alias("fabricante"),
    )


def rows_per_ticket(tables: Mapping[str, DataFrame]) -> DataFrame:
    """How many snapshot rows the elements and equipment of a ticket make (`linhas`), by
    counting; tickets without elements (one row) are left out."""
    per_element = counts_of(_equipment(tables["equip"]).distinct(), "elemento", "n")
    elements = _elements(tables["ta"]).distinct().join(per_element, "elemento", "left")
    return elements.groupBy("origem").agg(F.sum(F.coalesce("n", F.lit(1))).alias("linhas"))


def _with_equipment(elements: DataFrame, tables: Mapping[str, DataFrame], how: str) -> DataFrame:
    """Rows of elements with each piece of equipment (inner, left), without duplicates of these,
    so that the counts that split hot keys are those of its rows.

    Equipment has no null key. Keys are compared null-safe all the same, as in `split`: else the
    elements would get a null filter below their shuffle by ticket, and travel once more."""
    equipment = _equipment(tables["equip"]).where(F.col("elemento").isNotNull()).distinct()
    large = heavy(counts_of(equipment, "elemento", "equipamentos"), ["elemento"], "equipamentos")
    light, hot = split(elements, large, "elemento")
    own, hot_own = split(equipment, large, "elemento")
    many = chunked_join(hot, hot_own, "elemento", right_rows="equipamentos").drop("equipamentos")
    own = own.withColumnRenamed("elemento", "_dela")
    return light.join(own, F.col("elemento").eqNullSafe(F.col("_dela")), how).drop("_dela").unionByName(many)


def _equipment_of_tickets(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Equipment of the elements of each ticket: origem, elemento, hostname, fabricante, again for
    each row of the element. Of the elements only their keys travel to it."""
    return _with_equipment(_elements(tables["ta"]).distinct().select("origem", "elemento"), tables, "inner")


def line_parts(tables: Mapping[str, DataFrame], sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Elements with their equipment, without duplicates, of light and of heavy tickets.

    The long rows of light tickets' elements travel once, by ticket, and stay there: their
    equipment comes to them."""
    elements, hot = split(_elements(tables["ta"]).distinct(), sizes)
    equipment, _ = split(_equipment_of_tickets(tables), sizes)
    keys = ("origem", "elemento")
    line, piece = F.struct("site", "uf", "impacto"), F.struct("hostname", "fabricante")
    own = elements.select(*keys, line.alias("linha")).unionByName(
        equipment.repartition("origem").select(*keys, piece.alias("peca")), allowMissingColumns=True
    )
    lists = own.groupBy(*keys).agg(F.collect_list("linha").alias("linhas"), F.collect_set("peca").alias("pecas"))
    opened = lists.select(*keys, F.explode("linhas").alias("linha"), "pecas")
    light = opened.select(*keys, "linha", F.explode_outer("pecas").alias("peca")).select(*keys, "linha.*", "peca.*")
    return light, _with_equipment(hot, tables, "left")


def snapshot_parts(
    roots: DataFrame, tables: Mapping[str, DataFrame], mode: str, sizes: DataFrame
) -> tuple[tuple[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]:
    """Tickets and their lines (elements with equipment), light and heavy ones of either; the
    heavy ones with the columns of `sizes`, a table of heavy tickets with `linhas`.

    Neither has duplicates, so their pairs have none: the long rows need not be compared."""
    lines = line_parts(tables, sizes)
    own = [f.name for f in SNAPSHOT if f.name == "origem" or f.name not in lines[0].columns]
    tickets = ticket_rows(roots, tables, mode).select(*own, *_tag(roots)).distinct()
    return split(tickets, sizes), lines


def snapshot(
    roots: DataFrame, tables: Mapping[str, DataFrame], mode: str = "life_or_procedure"
) -> DataFrame:
    """Eligible root tickets x elements x equipment without duplicates. A ticket
    without elements keeps one row."""
    sizes = heavy(rows_per_ticket(tables), ["origem"], "linhas")
    (tickets, hot), (lines, hot_lines) = snapshot_parts(roots, tables, mode, sizes)
    columns = [*[f.name for f in SNAPSHOT], *_tag(roots)]
    many = chunked_join(hot, hot_lines, "origem", right_rows="linhas")
    return tickets.join(lines, "origem", "left").select(*columns).unionByName(many.select(*columns))


def ticket_snapshot_active(
    tables: Mapping[str, DataFrame],
    start: datetime,
    end: datetime,
    mode: str = "life_or_procedure",
) -> DataFrame:
    """20-column rows of open tickets created in [start, end)."""
    roots = active_roots(tables["ta"], start, end)
    return snapshot(roots, load_tables(tables, roots), mode)


def ticket_snapshot_closed(
    tables: Mapping[str, DataFrame],
    start: datetime,
    end: datetime,
    created_from: datetime,
    mode: str = "life_or_procedure",
) -> DataFrame:
    """20-column rows of tickets that closed in (start, end]."""
    roots = closed_roots(tables["ta"], start, end, created_from)
    return snapshot(roots, load_tables(tables, roots), mode)
