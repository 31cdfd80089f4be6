"""Tracking tables: snapshot, stays and procedures joined by ticket."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.operators.packed import PIECE, Packed, listed, pieces
from ticketlens.operators.procedures import SUFFIX, procedure_summary
from ticketlens.operators.skew import chunked_join, counts_of, distinct_sorted, heavy, split
from ticketlens.operators.snapshot import (
    N2_GROUPS,
    TAG,
    active_roots,
    both_roots,
    closed_roots,
    keyed_tables,
    load_tables,
    rows_per_ticket,
    snapshot_parts,
    ticket_rows,
)
from ticketlens.operators.stays import classify_stay, stay_parts, stays_per_ticket
from ticketlens.schemas import TRACKING

# Lists of a packed ticket: its elements with equipment, its stays, its procedure rows.
LISTS = ("lista_linhas", "lista_estadas", "lista_procedimentos")

# Keeps the life rows that entered in some period, by the name of the entry column.
Entered = Callable[[DataFrame, str], DataFrame]


def _pairs() -> Column:
    """Rows that the stays of a ticket make with its snapshot rows."""
    return F.coalesce("linhas", F.lit(1)) * F.coalesce("estadas", F.lit(1))


def ticket_sizes(lines: DataFrame, stays: DataFrame) -> DataFrame:
    """Heavy tickets: with more snapshot rows, stays, or pairs of both than a task should
    hold (`linhas`, `estadas`, null for none)."""
    counts = lines.join(stays, "origem", "full")
    return heavy(counts, ["origem"], _pairs())


def _procedures(tables: Mapping[str, DataFrame]) -> DataFrame:
    return procedure_summary(tables["proced"], tables["grupos"], tables["usuarios"])


def _finish(rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    tag = [column for column in rows.columns if column == TAG]
    return classify_stay(rows).select(*[f.name for f in TRACKING], *tag, *keep)


def consolidate(tickets: DataFrame, sides: Sequence[DataFrame]) -> DataFrame:
    """Every ticket row with each line, stay and procedure row of its ticket, for tickets that
    are not heavy. All four travel by ticket, once, and what the joins make stays in place."""
    rows = tickets
    for side in sides:
        rows = rows.join(side, "origem", "left")
    return rows


def consolidate_packed(tickets: DataFrame, sides: Sequence[DataFrame]) -> DataFrame:
    """The same packed: a row per ticket row."""
    named = [listed(side, "origem", name) for name, side in zip(LISTS, sides, strict=True)]
    return consolidate(tickets, named).withColumn(PIECE, F.lit(False))


def consolidate_heavy(tickets: DataFrame, sides: Sequence[DataFrame]) -> DataFrame:
    """The rows of `consolidate` for heavy tickets.

    All carry `linhas` and `estadas`, how many lines and stays the ticket has: from them
    follows into how many chunks it is split."""
    lines, stays, procedures = sides
    placed = chunked_join(tickets, lines, "origem", right_rows="linhas")
    with_stays = chunked_join(placed, stays, "origem", left_rows=F.col("linhas"), right_rows="estadas")
    rows = chunked_join(with_stays, procedures, "origem", left_rows=_pairs())
    return rows.drop("linhas", "estadas")


# Tickets and their lines, stays and procedure rows.
Parts = tuple[DataFrame, Sequence[DataFrame]]


def _parts(
    roots: DataFrame, tables: Mapping[str, DataFrame], as_of: datetime, mode: str
) -> tuple[Parts, Parts]:
    """Those of light and of heavy tickets."""
    ready = load_tables(tables, roots)
    sizes = ticket_sizes(rows_per_ticket(ready), stays_per_ticket(ready["vida"]))
    tickets, lines = snapshot_parts(roots, ready, mode, sizes)
    stays = stay_parts(
        ready["vida"], ready["grupos"], ready["usuarios"], as_of, sizes, tables["vida"]
    )
    procedures = split(_procedures(ready).withColumn("origem", F.col("origem" + SUFFIX)), sizes)
    light, hot = zip(lines, stays, procedures, strict=True)
    return (tickets[0], light), (tickets[1], hot)


def _tracking(
    roots: DataFrame, tables: Mapping[str, DataFrame], as_of: datetime, mode: str
) -> DataFrame:
    light, hot = _parts(roots, tables, as_of, mode)
    return _finish(consolidate(*light), ()).unionByName(_finish(consolidate_heavy(*hot), ()))


def _packed(
    roots: DataFrame, tables: Mapping[str, DataFrame], as_of: datetime, mode: str
) -> Packed:
    light, hot = _parts(roots, tables, as_of, mode)
    packed = consolidate_packed(*light)
    factors = {name: [c for c in side.columns if c != "origem"] for name, side in zip(LISTS, light[1], strict=True)}
    many = pieces(consolidate_heavy(*hot), factors).select(*packed.columns)
    return Packed(packed.unionByName(many), LISTS, _finish)


def tracking_of(roots: DataFrame, tables: Mapping[str, DataFrame], as_of: datetime) -> DataFrame:
    """Tracking rows of some root tickets."""
    return _tracking(roots, tables, as_of, "life_or_procedure")


def tracking_active(
    tables: Mapping[str, DataFrame],
    as_of: datetime,
    start: datetime,
    end: datetime,
    mode: str = "life_or_procedure",
) -> DataFrame:
    """Tracking rows of open tickets created in [start, end)."""
    return _tracking(active_roots(tables["ta"], start, end), tables, as_of, mode)


def closed_packed(
    tables: Mapping[str, DataFrame],
    as_of: datetime,
    start: datetime,
    end: datetime,
    created_from: datetime,
    mode: str = "life_or_procedure",
) -> Packed:
    """`tracking_closed`, packed."""
    roots = closed_roots(tables["ta"], start, end, created_from)
    return _packed(roots, tables, as_of, mode)


def tracking_closed(
    tables: Mapping[str, DataFrame],
    as_of: datetime,
    start: datetime,
    end: datetime,
    created_from: datetime,
    mode: str = "life_or_procedure",
) -> DataFrame:
    """Tracking rows of tickets that closed in (start, end]."""
    roots = closed_roots(tables["ta"], start, end, created_from)
    return _tracking(roots, tables, as_of, mode)


def _both_roots(
    tables: Mapping[str, DataFrame],
    start: datetime,
    end: datetime,
    created_from: datetime,
    entered: Entered | None = None,
) -> DataFrame:
    """Roots of both kinds, tagged; with `entered` only those with an N2 stay that
    entered in its period."""
    roots = both_roots(tables["ta"], start, end, created_from)
    if entered is None:
        return roots
    life = tables["vida"].where(F.col("vda_grupo").isin(list(N2_GROUPS)))
    seen = entered(life, "vda_data_initial").select(F.col("vda_ta").alias("tqa_codigo")).distinct()
    return roots.join(seen, "tqa_codigo", "left_semi")


def unified_packed(
    tables: Mapping[str, DataFrame],
    as_of: datetime,
    start: datetime,
    end: datetime,
    created_from: datetime,
    mode: str = "life_or_procedure",
    entered: Entered | None = None,
) -> Packed:
    """`tracking_unified`, packed."""
    return _packed(_both_roots(tables, start, end, created_from, entered), tables, as_of, mode)


def tracking_unified(
    tables: Mapping[str, DataFrame],
    as_of: datetime,
    start: datetime,
    end: datetime,
    created_from: datetime,
    mode: str = "life_or_procedure",
    entered: Entered | None = None,
) -> DataFrame:
    """Both tables in one, tagged ATIVO / FECHADO in `origem_tabela`.

    Life rows, procedures and elements are read and shuffled once for both kinds
    of ticket. The rows are those of `unified_tracking` over the two tables; with
    `entered`, all rows of tickets that have a stay in its period."""
    return _tracking(_both_roots(tables, start, end, created_from, entered), tables, as_of, mode)


def unified_sites(
    tables: Mapping[str, DataFrame],
    as_of: datetime,
    start: datetime,
    end: datetime,
    created_from: datetime,
    mode: str = "life_or_procedure",
    entered: Entered | None = None,
) -> DataFrame:
    """Tickets of both kinds with their sites and stays, without equipment and
    procedures: what a download that makes rows distinct needs of the tracking rows.
    With `entered`, tickets with a stay in its period only."""
    roots = _both_roots(tables, start, end, created_from, entered)
    # Only the tickets are chosen; what is joined to them is not chosen by them ahead, which
    # would sort every table once more beside the same tickets, all in the task of the joins.
    ready = keyed_tables(tables)
    sites = ready["ta"].select(
        F.col("tqa_origem").alias("origem"),
        F.col("tqa_area_codigo").alias("site"),
        F.col("tqa_estado_codigo").alias("uf"),
    )
    sizes = ticket_sizes(counts_of(sites, "origem", "linhas"), stays_per_ticket(ready["vida"]))
    tickets, hot = split(ticket_rows(roots, ready, mode), sizes)
    lines, hot_lines = split(sites, sizes)
    lines, hot_lines = distinct_sorted(lines, "origem"), hot_lines.distinct()
    stays, hot_stays = stay_parts(
        ready["vida"], ready["grupos"], ready["usuarios"], as_of, sizes, tables["vida"]
    )
    light = tickets.join(lines, "origem", "left").join(stays, "origem", "left")
    placed = chunked_join(hot, hot_lines, "origem", right_rows="linhas")
    many = chunked_join(placed, hot_stays, "origem", left_rows=F.col("linhas"), right_rows="estadas")
    return light.unionByName(many.drop("linhas", "estadas"))


def unified_stays(
    tables: Mapping[str, DataFrame],
    as_of: datetime,
    start: datetime,
    end: datetime,
    created_from: datetime,
    mode: str = "life_or_procedure",
    weighted: bool = False,
) -> DataFrame:
    """Tickets of both kinds with each of their stays: the unified rows before
    elements, equipment and procedures multiply them. Reports that count distinct
    stays give the same result on it, for much less work.

    `weighted=True` adds `linhas` (snapshot rows of the ticket), `procs` (its procedure
    rows) and `repeats`, how often the joins would repeat the row: with them, counts and
    means over all tracking rows come out the same without a row repeated."""
    light, hot = unified_stay_parts(tables, as_of, start, end, created_from, mode, weighted)
    return light.unionByName(hot)


def unified_stay_parts(
    tables: Mapping[str, DataFrame],
    as_of: datetime,
    start: datetime,
    end: datetime,
    created_from: datetime,
    mode: str = "life_or_procedure",
    weighted: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """`unified_stays` of light tickets, where rows of a ticket lie together, and of heavy
    ones."""
    roots = _both_roots(tables, start, end, created_from)
    ready = load_tables(tables, roots)
    sizes = heavy(stays_per_ticket(ready["vida"]), ["origem"], "estadas")
    stays, hot_stays = stay_parts(
        ready["vida"], ready["grupos"], ready["usuarios"], as_of, sizes, tables["vida"]
    )
    tickets = ticket_rows(roots, ready, mode)
    tickets, hot = split(_with_repeats(tickets, ready) if weighted else tickets, sizes)
    many = chunked_join(hot, hot_stays, "origem", right_rows="estadas").drop("estadas")
    return classify_stay(tickets.join(stays, "origem", "left")), classify_stay(many)


def _with_repeats(tickets: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Both counts have one row per ticket, as the tickets do."""
    procedures = (
        _procedures(tables)
        .groupBy(F.col("origem" + SUFFIX).alias("origem"))
        .agg(F.count(F.lit(1)).alias("procs"))
    )
    return (
        tickets.join(rows_per_ticket(tables), "origem", "left")
        .join(procedures, "origem", "left")
        .withColumns({"linhas": F.coalesce("linhas", F.lit(1)), "procs": F.coalesce("procs", F.lit(0))})
        .withColumn("repeats", F.col("linhas") * F.greatest("procs", F.lit(1)))
    )
