"""Daily partial states of the reports, kept per load and added up when a report is read.

A state is a number of distinct stays, or of seconds, of one entry day. Loads hold disjoint
tickets, so their states add up; a load that is written again replaces its states and no
others. A report over years of loads then reads a few rows per day instead of the stays."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.operators import reports
from ticketlens.operators.stays import UNCLASSIFIED
from ticketlens.sources.sinks import read_loads, write_load

BY_CLASS, BY_USER, TIME = "classe", "usuario", "tempo"


def _stay_states(unified: DataFrame, weight: str | None) -> DataFrame:
    """One row per stay of a ticket with its classes, its users and its times. Where the rows
    of a ticket lie together they stay there."""
    entry, kind = F.col("data_entrada_n2"), F.col("classificacao_atuacao")
    user = F.col("usuario_atuacao")
    times = F.col(weight) if weight else F.lit(1)
    seconds = reports.clip_time(F.col("tma_n2_seg"), reports.TIME_LIMIT_SECONDS)
    known = F.col("tma_n2_seg").isNotNull()
    total = seconds.cast("decimal(19,0)") * times.cast("decimal(18,0)")
    wanted = kind != UNCLASSIFIED
    return unified.groupBy(
        "origem",
        F.when(F.col("origem").isNotNull(), entry).alias("estada"),
        F.to_date(entry).alias("entrada"),
        "tipo_bilhete",
    ).agg(
        F.collect_set(F.when(wanted, kind)).alias("classes"),
        F.collect_set(F.when(wanted, user)).alias("usuarios"),
        F.sum(F.when(known, times).otherwise(0).cast("decimal(18,0)")).alias("vezes"),
        F.sum(total.cast("decimal(37,0)")).cast("decimal(30,0)").alias("segundos"),
    )


def daily_states(*unified: DataFrame, weight: str | None = None) -> DataFrame:
    """The states of some tickets: medida, entrada, tipo_bilhete, valor, n, s. `weight` is
    that of `mean_handling_time`; distinct stays have none. Several frames must hold
    disjoint tickets.

    The stays are built once: each gives a row per class and user and one for its times,
    which are added up by day where they are, so that few rows travel."""
    stays = None
    for part in unified:
        own = _stay_states(part, weight)
        stays = own if stays is None else stays.unionByName(own)

    def measure(kind: str, kind_of, value, n, s):
        return F.struct(
            F.lit(kind).alias("medida"),
            F.col("entrada").alias("entrada"),
            kind_of.cast("string").alias("tipo_bilhete"),
            value.cast("string").alias("valor"),
            n.cast("decimal(28,0)").alias("n"),
            s.cast("decimal(30,0)").alias("s"),
        )

    none = F.lit(None)
    one = F.when(F.col("entrada").isNotNull(), 1).otherwise(0)

    def volume(kind: str, column: str):
        return F.transform(column, lambda value: measure(kind, F.col("tipo_bilhete"), value, one, none))

    volumes = [volume(BY_CLASS, "classes"), volume(BY_USER, "usuarios")]
    time = F.array(measure(TIME, none, none, F.col("vezes"), F.col("segundos")))
    measures = stays.select(F.inline(F.concat(*volumes, time)))
    return measures.groupBy("medida", "entrada", "tipo_bilhete", "valor").agg(
        F.sum("n").cast("decimal(30,0)").alias("n"), F.sum("s").cast("decimal(30,0)").alias("s")
    )


def write_states(
    unified: DataFrame | Sequence[DataFrame], folder: str, start: datetime, end: datetime, weight: str | None = None
) -> str:
    """Stores the states of one load, of tickets in (start, end]."""
    parts = [unified] if isinstance(unified, DataFrame) else unified
    return write_load(daily_states(*parts, weight=weight), folder, start, end)


def _added(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    own = read_loads(spark, folder).where(F.col("medida") == kind)
    return own.groupBy("entrada", "tipo_bilhete", "valor").agg(
        F.sum("n").cast("bigint").alias("n"), F.sum("s").cast("decimal(30,0)").alias("s")
    )


def volumetry(spark: SparkSession, folder: str, as_of: date) -> DataFrame:
    """`reports.volumetry` over all stored loads."""
    return reports.volume_views(_added(spark, folder, BY_CLASS), as_of, "valor", "teve_atuacao")


def volumetry_by_user(spark: SparkSession, folder: str, as_of: date) -> DataFrame:
    """`reports.volumetry_by_user` over all stored loads."""
    return reports.volume_views(_added(spark, folder, BY_USER), as_of, "valor", "usuario_atuacao")


def mean_handling_time(spark: SparkSession, folder: str, as_of: date) -> DataFrame:
    """`reports.mean_handling_time` over all stored loads."""
    return reports.time_views(_added(spark, folder, TIME), as_of)
