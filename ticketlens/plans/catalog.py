"""Every operator as a named query over a data folder."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.functions.calendar import calendar_filter
from ticketlens.operators import activities, command_store, commands, procedures, quality, reports, rollup, snapshot, stays
from ticketlens.operators.windows import rows_per_window
from ticketlens.plans import standin, tracking
from ticketlens.schemas import TICKET_TABLES
from ticketlens.sources import pages
from ticketlens.sources.sinks import (
    by_entry_month,
    full_refresh,
    read_loads,
    shared_folder,
    write_load,
)
from ticketlens.sources.versions import read_current, refresh
from ticketlens.streaming.closure_days import read_synced, sync_closed
from ticketlens.streaming.increment import closed_increment

Query = Callable[[SparkSession, str], DataFrame]

# The load period covers all rows of the data.
START = datetime(1995, 1, 1)
END = datetime(2002, 1, 1)
AS_OF = datetime(2001, 12, 1)
REPORT_DAY = date(2001, 6, 1)
# First load of the incremental query; the rest arrives as its increment.
FIRST_LOAD_END = datetime(1998, 7, 1)
HOURLY_START = datetime(1994, 12, 20, 10, 30)
HOURLY_END = datetime(2002, 1, 5, 5, 0)
PAGE, PAGE_SIZE = 3, 50
PAGE_KEYS = ("origem", "elemento", "hostname", "fabricante", "data_entrada_n2")
# Past all rows of this ticket: its other columns sort last.
PAGE_AFTER = {"origem": 1000}
LINK_PREFIX = "/arquivo/"
# Commands before this instant are the first stored batch.
COMMANDS_SPLIT = "2024-01-16 00:00:00"
YEAR, MONTH, WEEK, DAY = 1998, 3, 10, 15
RANGE = (date(1997, 11, 20), date(1998, 2, 10))


def _tables(spark: SparkSession, sf_dir: str) -> standin.StandInTables:
    return standin.StandInTables(spark, sf_dir)


def _names(t) -> tuple[DataFrame, DataFrame]:
    return t["grupos"], t["usuarios"]


# --- load windows -----------------------------------------------------------


def load_windows_daily(spark, sf_dir):
    return rows_per_window(_tables(spark, sf_dir)["ta"], "tqa_data_criacao", START, END, "daily")


def load_windows_weekly(spark, sf_dir):
    ta = _tables(spark, sf_dir)["ta"]
    return rows_per_window(ta, "tqa_data_encerramento", START, END, "weekly", closed="right")


def load_windows_monthly(spark, sf_dir):
    ta = _tables(spark, sf_dir)["ta"]
    return rows_per_window(
        ta, "tqa_data_criacao", HOURLY_START, HOURLY_END, "monthly", truncate=False
    )


# --- tickets ----------------------------------------------------------------


def eligible_tickets(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return snapshot.eligible_tickets(t["vida"], t["proced"], t["grupos"])


def eligible_tickets_life_only(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return snapshot.eligible_tickets(t["vida"], t["proced"], t["grupos"], mode="life")


def route_flags(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return snapshot.route_flags(t["vida"], t["grupos"])


def ticket_snapshot_active(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return snapshot.ticket_snapshot_active(t, START, END)


def ticket_snapshot_closed(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return snapshot.ticket_snapshot_closed(t, START, END, START)


def ticket_snapshot_validation(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return snapshot.ticket_snapshot_active(t, START, END, mode="life")


# --- stays and procedures ---------------------------------------------------


def _stays(t):
    return stays.stay_table(t["vida"], *_names(t), AS_OF)


def _procedures(t):
    return procedures.procedure_summary(t["proced"], *_names(t))


def group_stays(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return stays.group_stays(t["vida"], *_names(t), AS_OF)


def stay_starts(spark, sf_dir):
    t = _tables(spark, sf_dir)
    rows = stays.group_stays(t["vida"], *_names(t), AS_OF)
    return stays.mark_starts(rows, stays.stays_per_ticket(t["vida"])).select(
        "origem", "seq", "usuario_cod", "usuario_anterior", "inicio_atuacao",
        "contar_atuacao", "contar_sem_atuacao",
    )


def stay_totals(spark, sf_dir):
    return _stays(_tables(spark, sf_dir))


def stay_class(spark, sf_dir):
    classed = stays.classify_stay(_stays(_tables(spark, sf_dir)))
    return classed.select("origem", "data_entrada_n2", "classificacao_atuacao")


def procedure_summary(spark, sf_dir):
    return _procedures(_tables(spark, sf_dir))


def procedure_only(spark, sf_dir):
    t = _tables(spark, sf_dir)
    n2_stays = stays.group_stays(t["vida"], *_names(t), AS_OF)
    return procedures.procedure_only(_procedures(t), n2_stays)


def stays_with_procedures(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return procedures.stays_with_procedures(_stays(t), _procedures(t))


# --- tracking ---------------------------------------------------------------


def tracking_active(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return tracking.tracking_active(t, AS_OF, START, END)


def tracking_closed(spark, sf_dir):
    return tracking.tracking_closed(_tables(spark, sf_dir), AS_OF, START, END, START)


def _unified(spark, sf_dir, entered=None):
    return tracking.tracking_unified(
        _tables(spark, sf_dir), AS_OF, START, END, START, entered=entered
    )


def _unified_packed(spark, sf_dir):
    return tracking.unified_packed(_tables(spark, sf_dir), AS_OF, START, END, START)


def _unified_stays(spark, sf_dir, weighted: bool = False):
    return tracking.unified_stays(
        _tables(spark, sf_dir), AS_OF, START, END, START, weighted=weighted
    )


def full_refresh_roundtrip(spark, sf_dir):
    closed = by_entry_month(
        tracking.closed_packed(_tables(spark, sf_dir), AS_OF, START, END, START)
    )
    path = full_refresh(closed, shared_folder(spark, "tracking_closed"), ("mes_entrada",))
    return spark.read.parquet(path)


def refresh_current(spark, sf_dir):
    """A table is replaced twice; readers find the second version by the folder alone."""
    folder = shared_folder(spark, "stays")
    rows = _stays(_tables(spark, sf_dir))
    refresh(rows.where("teve_atuacao = 'NAO'"), folder)
    refresh(rows, folder)
    return read_current(spark, folder)


def closed_days_synced(spark, sf_dir):
    """Every seventh ticket and every fifth life row of the others come late, of days
    that are stored already: the second run finds and loads their days."""
    t = _tables(spark, sf_dir)
    folder = shared_folder(spark, "closed_days")
    early = {name: t[name] for name in TICKET_TABLES}
    late = F.col("tqa_codigo") % 7 == 0
    early["ta"] = t["ta"].where(F.col("tqa_origem").isNotNull() | ~late)
    early["vida"] = t["vida"].where((F.col("vda_ta") % 11 != 0) | (F.col("vda_seq") % 5 != 0))
    for tables in (early, t, t):
        sync_closed(folder, tables, AS_OF, END, START)
    return read_synced(spark, folder)


def _first_load(spark, sf_dir):
    t = _tables(spark, sf_dir)
    first = tracking.tracking_closed(t, AS_OF, START, FIRST_LOAD_END, START)
    folder = shared_folder(spark, "closed")
    write_load(first, folder, START, FIRST_LOAD_END)
    return t, folder


def closed_increment_rows(spark, sf_dir):
    t, folder = _first_load(spark, sf_dir)
    return closed_increment(read_loads(spark, folder), t, AS_OF, END, START)


def closed_increment_appended(spark, sf_dir):
    """The increment is written twice, as by a retried run: the rows come once."""
    t, folder = _first_load(spark, sf_dir)
    stored = read_loads(spark, folder)
    for _ in range(2):
        write_load(closed_increment(stored, t, AS_OF, END, START), folder, FIRST_LOAD_END, END)
    return read_loads(spark, folder)


# --- reports ----------------------------------------------------------------


def unified_tracking(spark, sf_dir):
    return reports.unified_newest(_unified_packed(spark, sf_dir))


def _download(spark, sf_dir, **period):
    def entered(df: DataFrame, column: str) -> DataFrame:
        return calendar_filter(df, column, YEAR, **period)

    rows = tracking.unified_sites(
        _tables(spark, sf_dir), AS_OF, START, END, START, entered=entered
    )
    return reports.unified_download(rows, YEAR, **period, few_repeat=True)


def unified_download_year(spark, sf_dir):
    return _download(spark, sf_dir)


def unified_download_month(spark, sf_dir):
    return _download(spark, sf_dir, mes=MONTH)


def unified_download_week(spark, sf_dir):
    return _download(spark, sf_dir, semana=WEEK)


def unified_download_day(spark, sf_dir):
    return _download(spark, sf_dir, dia=DAY)


def unified_range(spark, sf_dir):
    def entered(df: DataFrame, column: str) -> DataFrame:
        return reports.within_days(df, column, *RANGE)

    return reports.unified_range(_unified(spark, sf_dir, entered), *RANGE)


def tracking_page_active(spark, sf_dir):
    return reports.tracking_page(tracking_active(spark, sf_dir), PAGE_KEYS, PAGE, PAGE_SIZE)


def tracking_page_closed(spark, sf_dir):
    return reports.tracking_page(tracking_closed(spark, sf_dir), PAGE_KEYS, PAGE, PAGE_SIZE)


def tracking_page_unified(spark, sf_dir):
    return reports.tracking_page(
        _unified(spark, sf_dir), ("origem_tabela", *PAGE_KEYS), PAGE, PAGE_SIZE
    )


def tracking_page_after(spark, sf_dir):
    rows = tracking_active(spark, sf_dir)
    cursor = dict.fromkeys(rows.columns) | PAGE_AFTER
    return reports.tracking_page(rows, PAGE_KEYS, page_size=PAGE_SIZE, after=cursor)


def page_summary(spark, sf_dir):
    rows = _unified_stays(spark, sf_dir, weighted=True)
    return reports.page_summary(rows, PAGE, PAGE_SIZE, weight="repeats")


def _paged(spark, sf_dir):
    """Both tracking tables stored in the order of their pages, with measures."""
    folder = shared_folder(spark, "pages")
    tags = (snapshot.ACTIVE_TAG, snapshot.CLOSED_TAG)
    values = quality.freshness_values(snapshot.TAG, tags)
    pages.write_pages(_unified_packed(spark, sf_dir), folder, (snapshot.TAG, *PAGE_KEYS), values)
    return folder


def tracking_page_stored(spark, sf_dir):
    return pages.read_page(spark, _paged(spark, sf_dir), PAGE, PAGE_SIZE)


def page_summary_stored(spark, sf_dir):
    return pages.read_summary(spark, _paged(spark, sf_dir), PAGE, PAGE_SIZE)


def table_freshness_stored(spark, sf_dir):
    """Observed while the tables were written: no row is read for it."""
    seen = pages.measures(spark, _paged(spark, sf_dir))
    row = spark.createDataFrame([tuple(seen.values())], ", ".join(f"{name} string" for name in seen))
    return quality.freshness_rows(row, (snapshot.ACTIVE_TAG, snapshot.CLOSED_TAG), AS_OF)


def volumetry(spark, sf_dir):
    return reports.volumetry(_unified_stays(spark, sf_dir), REPORT_DAY)


def volumetry_by_user(spark, sf_dir):
    return reports.volumetry_by_user(_unified_stays(spark, sf_dir), REPORT_DAY)


def mean_handling_time(spark, sf_dir):
    rows = _unified_stays(spark, sf_dir, weighted=True)
    return reports.mean_handling_time(rows, REPORT_DAY, weight="repeats")


def mean_handling_time_dedupe(spark, sf_dir):
    rows = _unified_stays(spark, sf_dir)
    return reports.mean_handling_time(rows, REPORT_DAY, dedupe=True, clip_seconds=None)


def _rollup(spark, sf_dir):
    """Two increments, the second written twice, as by a retried run."""
    t = _tables(spark, sf_dir)
    folder = shared_folder(spark, "rollup")
    for start, end in ((START, FIRST_LOAD_END), (FIRST_LOAD_END, END), (FIRST_LOAD_END, END)):
        rows = tracking.unified_stay_parts(t, AS_OF, start, end, START, weighted=True)
        rollup.write_states(rows, folder, start, end, weight="repeats")
    return folder


def volumetry_rollup(spark, sf_dir):
    return rollup.volumetry(spark, _rollup(spark, sf_dir), REPORT_DAY)


def volumetry_by_user_rollup(spark, sf_dir):
    return rollup.volumetry_by_user(spark, _rollup(spark, sf_dir), REPORT_DAY)


def mean_handling_time_rollup(spark, sf_dir):
    return rollup.mean_handling_time(spark, _rollup(spark, sf_dir), REPORT_DAY)


# --- quality ----------------------------------------------------------------


def _weighted(spark, sf_dir, tag):
    return _unified_stays(spark, sf_dir, weighted=True).where(F.col(snapshot.TAG) == tag)


def table_freshness(spark, sf_dir):
    rows = _unified_stays(spark, sf_dir, weighted=True)
    tags = (snapshot.ACTIVE_TAG, snapshot.CLOSED_TAG)
    return quality.table_freshness(rows, snapshot.TAG, tags, AS_OF, weight="repeats")


def duplicate_report(spark, sf_dir):
    return quality.duplicate_report(ticket_snapshot_active(spark, sf_dir), "origem", 20)


def stays_per_ticket(spark, sf_dir):
    return quality.duplicate_report(group_stays(spark, sf_dir), "origem", None)


def procedure_tags(spark, sf_dir):
    tag = "origem_atuacao_PROCEDIMENTO"
    rows = _weighted(spark, sf_dir, snapshot.ACTIVE_TAG).where("procs > 0")
    tagged = rows.withColumn(tag, F.lit(procedures.FROM_PROCEDURE))
    return quality.duplicate_report(tagged, tag, None, weight="repeats")


def reconciliation(spark, sf_dir):
    t = _tables(spark, sf_dir)
    final = _weighted(spark, sf_dir, snapshot.ACTIVE_TAG)
    # A ticket has its snapshot rows once, however many stays.
    tickets = final.groupBy("origem").agg(F.max("linhas").alias("linhas"))
    return quality.reconciliation(tickets, _stays(t), final, "linhas", "repeats")


# --- activity log -----------------------------------------------------------


def active_catalogue(spark, sf_dir):
    return activities.active_catalogue(_tables(spark, sf_dir)["atividade_padrao"])


def activity_list(spark, sf_dir):
    log = _tables(spark, sf_dir)
    return activities.activity_list(
        log["atividade_suporte"], log["atividade_padrao"], log["arquivos"], LINK_PREFIX
    )


def activity_detail(spark, sf_dir):
    """Detail of the activities the history speaks of."""
    log = _tables(spark, sf_dir)
    return activities.activity_detail(
        log["atividade_suporte"], log["atividade_padrao"], log["arquivos"], log["historico"]
    )


def activity_history(spark, sf_dir):
    """Events of all known activities."""
    log = _tables(spark, sf_dir)
    return activities.activity_history(log["historico"], log["atividade_suporte"])


def activity_files(spark, sf_dir):
    """Attachments of all known activities."""
    log = _tables(spark, sf_dir)
    return activities.activity_files(log["arquivos"], log["atividade_suporte"], LINK_PREFIX)


def _commands(log):
    named = F.when(F.col("nome_original").isNotNull(), "text/plain")
    return log["comandos"].withColumns(
        {"conteudo": F.encode("observacoes", "UTF-8"), "content_type": named}
    )


def _judged(spark, sf_dir):
    """Given activities and judged commands."""
    log = _tables(spark, sf_dir)
    given = log["atividade_suporte"]
    return given, commands.judge_commands(given, log["atividade_padrao"], _commands(log))


def _stored_log(spark, sf_dir):
    """All commands, applied to the stored log in batches that overlap and repeat."""
    log = _tables(spark, sf_dir)
    folder = shared_folder(spark, "activity_log")
    cmds, catalogue = _commands(log), log["atividade_padrao"]
    command_store.begin(log["atividade_suporte"], folder)
    half = F.col("ts") < F.lit(COMMANDS_SPLIT).cast("timestamp_ntz")
    for batch in (cmds.where(half), cmds, cmds):
        command_store.apply_batch(folder, catalogue, batch)
    return command_store.read_log(spark, folder)


def stored_activity_state(spark, sf_dir):
    return _stored_log(spark, sf_dir)[command_store.STATE]


def stored_activity_history(spark, sf_dir):
    return _stored_log(spark, sf_dir)[command_store.HISTORY]


def stored_activity_files(spark, sf_dir):
    return _stored_log(spark, sf_dir)[command_store.FILES]


def activity_state(spark, sf_dir):
    return commands.apply_activity_commands(*_judged(spark, sf_dir))


def history_from_commands(spark, sf_dir):
    return commands.history_from_commands(_judged(spark, sf_dir)[1])


def files_from_commands(spark, sf_dir):
    return commands.files_from_commands(_judged(spark, sf_dir)[1])


def rejected_commands(spark, sf_dir):
    return commands.reject_commands(_judged(spark, sf_dir)[1])


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        load_windows_daily,
        load_windows_weekly,
        load_windows_monthly,
        eligible_tickets,
        eligible_tickets_life_only,
        route_flags,
        ticket_snapshot_active,
        ticket_snapshot_closed,
        ticket_snapshot_validation,
        group_stays,
        stay_starts,
        stay_totals,
        stay_class,
        procedure_summary,
        procedure_only,
        stays_with_procedures,
        tracking_active,
        tracking_closed,
        full_refresh_roundtrip,
        refresh_current,
        closed_days_synced,
        closed_increment_rows,
        closed_increment_appended,
        unified_tracking,
        unified_download_year,
        unified_download_month,
        unified_download_week,
        unified_download_day,
        unified_range,
        tracking_page_active,
        tracking_page_closed,
        tracking_page_unified,
        tracking_page_after,
        page_summary,
        tracking_page_stored,
        page_summary_stored,
        table_freshness_stored,
        volumetry,
        volumetry_by_user,
        mean_handling_time,
        mean_handling_time_dedupe,
        volumetry_rollup,
        volumetry_by_user_rollup,
        mean_handling_time_rollup,
        table_freshness,
        duplicate_report,
        stays_per_ticket,
        procedure_tags,
        reconciliation,
        active_catalogue,
        activity_list,
        activity_detail,
        activity_history,
        activity_files,
        activity_state,
        history_from_commands,
        files_from_commands,
        rejected_commands,
        stored_activity_state,
        stored_activity_history,
        stored_activity_files,
    )
}
