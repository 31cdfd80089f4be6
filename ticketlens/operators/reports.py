"""Reports over the unified tracking rows (both tables, tagged).

Partition the stored tables by entry month (`sinks.by_entry_month`) and the
calendar filters prune files as well as row groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.functions.calendar import calendar_filter, ntz, week_mode1, within
from ticketlens.functions.durations import TIME_LIMIT_SECONDS, clip_time, micros_between, report_hms
from ticketlens.operators.packed import Packed
from ticketlens.operators.skew import distinct_sorted
from ticketlens.operators.snapshot import ACTIVE_TAG, CLOSED_TAG, TAG
from ticketlens.operators.stays import UNCLASSIFIED

# View names, look-back of the daily view, download columns, page limit.
MONTH_VIEW = "ANO_MES"
WEEK_VIEW = "SEMANAL"
DAY_VIEW = "DIARIO"
DAILY_LOOKBACK_DAYS = 31
DOWNLOAD_COLUMNS = (
    "origem",
    "ta_raiz",
    "status",
    "site",
    "uf",
    "regional",
    "data_criacao",
    "data_encerramento",
    "tipo_bilhete",
    "tipo_site",
    "tipo_de_alarme",
    "grupo_responsavel",
    "passou_pelo_acesso_ericson",
    "passou_pelo_acesso_huawei",
    "passou_pelo_campo",
    "passou_pelo_coran",
    "grupo_n2",
    "usuario_atuacao",
    "data_entrada_n2",
    "data_saida_n2",
    "teve_atuacao",
    "ainda_na_fila",
    "inicio_atuacao",
    "tempo_no_grupo",
    "tma_n2",
    "tempo_total_atuacao",
    "quantidade_atuacao",
    "tempo_total_n2",
    "origem_tabela",
)
MAX_PAGE_SIZE = 200
# Ours: columns that tell tracking rows of one instant apart.
TIE_BREAKERS = (
    "origem",
    "elemento",
    "hostname",
    "data_entrada_n2",
    "data_saida_n2",
    "usuario_atuacao_PROCEDIMENTO",
)


def unified_tracking(active: DataFrame, closed: DataFrame) -> DataFrame:
    """All rows of both tables, tagged ATIVO / FECHADO in `origem_tabela`."""
    return active.withColumn(TAG, F.lit(ACTIVE_TAG)).unionByName(
        closed.withColumn(TAG, F.lit(CLOSED_TAG))
    )


def _newest(df: DataFrame, column: str) -> list[Column]:
    """By `column`, newest first, then by what tells rows of it apart: a sort splits its
    tasks between different keys only, and one instant or one ticket may hold a great part of
    the rows."""
    ties = [key for key in TIE_BREAKERS if key in df.columns and key != column]
    return [F.col(column).desc_nulls_last(), *[F.col(key) for key in ties]]


def _newest_first(df: DataFrame, column: str) -> DataFrame:
    return df.orderBy(*_newest(df, column))


def unified_newest(unified: DataFrame | Packed) -> DataFrame:
    """The unpaged listing of both tables, newest creation first. Packed rows are dealt into
    ranges of that order, and opened and sorted inside their ranges."""
    newest = "data_criacao"
    if not isinstance(unified, Packed):
        return _newest_first(unified, newest)
    first, *others = unified.cut([newest, *TIE_BREAKERS])
    ranges = unified.frame.repartitionByRange(first[1].desc_nulls_last(), *[value for _, value in others])
    return unified.over(ranges).rows().sortWithinPartitions(F.col(newest).desc_nulls_last(), *TIE_BREAKERS)


def unified_download(
    unified: DataFrame,
    ano: int,
    mes: int | None = None,
    dia: int | None = None,
    semana: int | None = None,
    few_repeat: bool = False,
) -> DataFrame:
    """Distinct 29-column rows that entered in a year and, when given, a month, a
    day of month and a week (0-53); newest entry first.

    With `few_repeat` rows are made distinct where they are sorted: equal ones are in one range
    of the order, and the tasks that make the rows hold no table of them. Where many repeat, as
    in a whole tracking table, that would let them all travel."""
    entry = "data_entrada_n2"
    rows = calendar_filter(unified, entry, ano, mes, dia, semana).select(*DOWNLOAD_COLUMNS)
    if not few_repeat:
        return _newest_first(rows.distinct(), entry)
    # Counted back, entries ascend: so one sort serves both the order and the comparison. The
    # year leaves none null.
    until_end = micros_between(F.col(entry), ntz(datetime(ano + 1, 1, 1))).cast("bigint")
    back = rows.withColumn("_recente", until_end)
    order = ["_recente", *[key for key in TIE_BREAKERS if key in DOWNLOAD_COLUMNS and key != entry]]
    ranges = distinct_sorted(back.repartitionByRange(*order), *order)
    return ranges.sortWithinPartitions(*order).drop("_recente")


def within_days(df: DataFrame, column: str, first: date, last: date) -> DataFrame:
    """Rows whose timestamp `column` lies from day `first` to day `last` inclusive."""
    low = datetime.combine(first, datetime.min.time())
    high = datetime.combine(last, datetime.min.time()) + timedelta(days=1)
    return within(df, column, low, high)


def unified_range(unified: DataFrame, first: date, last: date) -> DataFrame:
    """29-column rows that entered from day `first` to day `last` inclusive.

    Whole tracking rows are made distinct before the columns are chosen, so rows
    that differ elsewhere only (element, equipment, procedure) repeat."""
    rows = within_days(unified, "data_entrada_n2", first, last)
    return _newest_first(rows.distinct(), "data_entrada_n2").select(*DOWNLOAD_COLUMNS)


def check_page(page: int, page_size: int) -> None:
    if page < 1:
        raise ValueError("page must be at least 1")
    if not 1 <= page_size <= MAX_PAGE_SIZE:
        raise ValueError(f"page_size must be 1-{MAX_PAGE_SIZE}")


def _after(keys: Sequence[str], cursor: Mapping[str, object]) -> Column:
    """Rows past the cursor in ascending, nulls-last order of the keys."""
    same, past = F.lit(True), F.lit(False)
    for key in keys:
        value = cursor[key]
        column = F.col(key)
        if value is not None:
            bound = F.lit(str(value)).cast("timestamp_ntz") if isinstance(value, datetime) else F.lit(value)
            past = past | (same & (column.isNull() | (column > bound)))
            same = same & F.coalesce(column == bound, F.lit(False))
        else:
            same = same & column.isNull()
    return past


def tracking_page(
    df: DataFrame,
    keys: Sequence[str],
    page: int = 1,
    page_size: int = 50,
    after: Mapping[str, object] | None = None,
) -> DataFrame:
    """One page of `df` in the order of `keys`, then of all other columns by name of the
    schema: rows that still tie are equal, so a page edge never shows or hides a row by
    chance.

    `after` (the last row seen, all its columns) replaces the page number: it is a filter,
    where a page number has to rank all rows before it. Walk deep lists by `after`; rows
    equal to the cursor in all columns are taken as seen."""
    check_page(page, page_size)
    if not keys:
        raise ValueError("keys must name the sort columns")
    order = [*keys, *[c for c in df.columns if c not in keys]]
    if after is not None and set(after) != set(order):
        raise ValueError("after must hold every column of the last row")
    rows = df if after is None else df.where(_after(order, after))
    ordered = rows.orderBy(*[F.col(key).asc_nulls_last() for key in order])
    offset = 0 if after is not None else (page - 1) * page_size
    return ordered.offset(offset).limit(page_size)


def page_summary(
    df: DataFrame, page: int = 1, page_size: int = 50, weight: str | None = None
) -> DataFrame:
    """page, page_size, total and total_pages (0 for an empty table), one row. `weight`
    names a column that says how many rows a row stands for."""
    check_page(page, page_size)
    pages = F.ceil(F.col("total") / page_size).cast("int")
    times = F.sum(F.col(weight) if weight else F.lit(1))
    return df.agg(F.coalesce(times, F.lit(0)).cast("bigint").alias("total")).select(
        F.lit(page).alias("page"),
        F.lit(page_size).alias("page_size"),
        "total",
        pages.alias("total_pages"),
    )


def _views(day: str, as_of: date) -> Column:
    """The month, week and (for recent days) day view labels of a day."""
    date_col = F.col(day)
    blank = F.lit("")
    year = F.year(date_col)

    def view(name: str, mes: Column, semana: Column, dia: Column) -> Column:
        return F.struct(
            year.alias("ano"),
            mes.alias("mes"),
            semana.alias("semana"),
            dia.alias("dia"),
            F.lit(name).alias("visao"),
        )

    month = F.lpad(F.month(date_col).cast("string"), 2, "0")
    month_view = view(MONTH_VIEW, month, blank, blank)
    week_view = view(WEEK_VIEW, blank, week_mode1(date_col).cast("string"), blank)
    day_view = view(DAY_VIEW, blank, blank, date_col.cast("string"))
    # No upper bound: days after the report date belong to the daily view too.
    first_day = F.lit(str(as_of)).cast("date") - F.expr(f"interval {DAILY_LOOKBACK_DAYS} days")
    return F.when(
        date_col >= first_day.cast("date"), F.array(month_view, week_view, day_view)
    ).otherwise(F.array(month_view, week_view))


def _distinct_stays(unified: DataFrame, by: str) -> DataFrame:
    """Distinct (ticket, entry) pairs per classified stay value, with entry day."""
    wanted = unified.where(
        (F.col("classificacao_atuacao") != UNCLASSIFIED) & F.col(by).isNotNull()
    )
    return wanted.select("origem", "data_entrada_n2", "tipo_bilhete", by).distinct()


def volume_days(unified: DataFrame, by: str) -> DataFrame:
    """Distinct stays per entry day, ticket type and `by`: entrada, tipo_bilhete, by, n.
    Counts of disjoint sets of tickets add up, because a stay is one of one ticket."""
    return (
        _distinct_stays(unified, by)
        .groupBy(F.to_date("data_entrada_n2").alias("entrada"), "tipo_bilhete", by)
        .agg(F.count("data_entrada_n2").alias("n"))
    )


def volume_views(per_day: DataFrame, as_of: date, by: str, name: str) -> DataFrame:
    """The three views add up daily counts, because a stay enters on one day only."""
    views = per_day.select(
        F.explode(_views("entrada", as_of)).alias("v"), "tipo_bilhete", F.col(by).alias(name), "n"
    )
    return (
        views.groupBy("v.ano", "v.mes", "v.semana", "v.dia", "v.visao", "tipo_bilhete", name)
        .agg(F.sum("n").alias("total"))
        .select(
            "ano", "mes", "semana", "dia", F.lit("").alias("hora"), "visao", "tipo_bilhete", name, "total"
        )
    )


def volumetry(unified: DataFrame, as_of: date) -> DataFrame:
    """Distinct classified stays by month, by week and by recent day, per ticket
    type and class (SIM / NAO, in `teve_atuacao`)."""
    days = volume_days(unified, "classificacao_atuacao")
    return volume_views(days, as_of, "classificacao_atuacao", "teve_atuacao")


def volumetry_by_user(unified: DataFrame, as_of: date) -> DataFrame:
    """The same per ticket type and acting user."""
    return volume_views(volume_days(unified, "usuario_atuacao"), as_of, "usuario_atuacao", "usuario_atuacao")


def time_days(
    unified: DataFrame,
    dedupe: bool = False,
    clip_seconds: int | None = TIME_LIMIT_SECONDS,
    weight: str | None = None,
) -> DataFrame:
    """Seconds of stays and their number per entry day: entrada, s, n."""
    if dedupe and weight:
        raise ValueError("distinct stays have no weight")
    seconds = clip_time(F.col("tma_n2_seg"), clip_seconds)
    if weight is None:
        rows = unified.select("origem", "data_entrada_n2", "tma_n2_seg")
        rows = rows.distinct() if dedupe else rows
        total, count = F.sum(seconds), F.count("tma_n2_seg")
    else:
        rows = unified.select("data_entrada_n2", "tma_n2_seg", weight)
        # Weights may be products of long lists: more than a bigint may come together.
        total = F.sum(seconds.cast("decimal(19,0)") * F.col(weight).cast("decimal(18,0)"))
        count = F.sum(F.when(F.col("tma_n2_seg").isNotNull(), F.col(weight)).otherwise(0))
    return rows.groupBy(F.to_date("data_entrada_n2").alias("entrada")).agg(
        total.cast("decimal(30,0)").alias("s"), count.alias("n")
    )


def time_views(per_day: DataFrame, as_of: date) -> DataFrame:
    """Means of the three views from daily sums and numbers."""
    totals = (
        per_day.select(F.explode(_views("entrada", as_of)).alias("v"), "s", "n")
        .groupBy("v.ano", "v.mes", "v.semana", "v.dia", "v.visao")
        .agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    )
    # Four decimals, then whole seconds toward zero; no stays give a null mean.
    mean = F.col("s").cast("decimal(30,0)") / F.nullif(F.col("n"), F.lit(0)).cast("decimal(20,0)")
    whole = F.round(mean, 4).cast("bigint")
    return totals.select(
        "ano",
        "mes",
        "semana",
        "dia",
        "visao",
        report_hms(whole).alias("tma_medio"),
        whole.alias("tma_medio_seg"),
    )


def mean_handling_time(
    unified: DataFrame,
    as_of: date,
    dedupe: bool = False,
    clip_seconds: int | None = TIME_LIMIT_SECONDS,
    weight: str | None = None,
) -> DataFrame:
    """Mean stay time by month, by week and by recent day.

    Every tracking row counts, so a stay weighs as often as its ticket has
    elements, equipment and procedures; `dedupe=True` counts distinct stays, and
    `weight` names a column that says how many rows a row stands for. Sums and
    counts per day are added up per view: the means are exact."""
    return time_views(time_days(unified, dedupe, clip_seconds, weight), as_of)
