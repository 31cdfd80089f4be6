"""Stays of tickets in the N2 groups: times, handling starts, totals, class."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.functions.calendar import ntz
from ticketlens.functions.durations import hms, micros_between, seconds_between
from ticketlens.operators import skew
from ticketlens.operators.snapshot import N2_GROUPS, YES

# Texts of the stay flags and classes.
NO_STAY = "NAO"
UNCLASSIFIED = "VAZIO"
# Stands for "no entry time" among the minutes of a ticket: sorts last.
NO_DAY = "9999-12-31 00:00:00"
CHUNK = ("pedaco_minuto", "pedaco_segundo", "pedaco_bloco")

STARTED = ("usuario_anterior", "inicio_atuacao", "contar_atuacao", "contar_sem_atuacao")


def group_stays(
    life: DataFrame,
    groups: DataFrame,
    users: DataFrame,
    as_of: datetime,
    n2: Sequence[int] = N2_GROUPS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per life row in the N2 groups; stays still open end at `as_of`. `keep` names
    more columns of `life` that stay."""
    acted = F.col("usuario_cod").isNotNull()
    until = F.coalesce("data_saida_n2", ntz(as_of))
    stays = life.where(F.col("vda_grupo").isin(list(n2))).select(
        F.col("vda_ta").alias("origem"),
        F.col("vda_seq").alias("seq"),
        F.col("vda_grupo").alias("grp_codigo"),
        F.col("vda_usuario").alias("usuario_cod"),
        F.col("vda_data_initial").alias("data_entrada_n2"),
        F.col("vda_data_final").alias("data_saida_n2"),
        *keep,
    )
    timed = stays.withColumns(
        {
            "teve_atuacao": F.when(acted, YES).otherwise(NO_STAY),
            "ainda_na_fila": F.when(F.col("data_saida_n2").isNull(), YES).otherwise(NO_STAY),
            "total_segundos": seconds_between(F.col("data_entrada_n2"), until),
        }
    ).withColumn(
        "total_segundos_atuacao",
        F.when(acted, F.col("total_segundos")).otherwise(F.lit(0).cast("bigint")),
    )
    # One row per N2 group code at most: bounded, and each code holds many stays.
    group_names = F.broadcast(
        groups.where(F.col("grp_codigo").isin(list(n2))).select(
            "grp_codigo", F.col("grp_nome").alias("grupo_n2")
        )
    )
    user_names = users.select(
        F.col("usr_codigo").cast("bigint").alias("chave"), F.col("usr_nome").alias("nome")
    )
    # Many stays have no user: negative keys spread them, should users be too many
    # to broadcast. Whatever such a key meets is no name.
    spread = -1 - F.pmod(F.xxhash64("origem", "seq"), F.lit(1_000_000))
    keyed = timed.withColumn("chave", F.coalesce(F.col("usuario_cod").cast("bigint"), spread))
    return (
        keyed.join(group_names, "grp_codigo", "left")
        .join(user_names, "chave", "left")
        .withColumn("usuario_atuacao", F.when(acted, F.col("nome")))
        .drop("grp_codigo", "chave", "nome")
    )


def _entry_order() -> list:
    return [F.col("data_entrada_n2").asc_nulls_last(), F.col("seq").asc_nulls_last()]


def _with_starts(stays: DataFrame) -> DataFrame:
    user, before = F.col("usuario_cod"), F.col("usuario_anterior")
    starts = user.isNotNull() & (before.isNull() | (before != user))
    counted = F.when(starts, 1).otherwise(0)
    return stays.withColumns(
        {
            "inicio_atuacao": counted,
            "contar_atuacao": counted,
            "contar_sem_atuacao": F.when(user.isNull(), 1).otherwise(0),
        }
    )


def _split(stays: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stays of light tickets, which a task holds whole, and of heavy ones. `counts`: rows by
    ticket. Where no ticket is heavy, the second part is found empty before it is read."""
    hot = skew.heavy(counts, ["origem"], "estadas").select("origem")
    return stays.join(hot, "origem", "left_anti"), stays.join(hot, "origem", "left_semi")


def _own_counts(stays: DataFrame) -> DataFrame:
    return skew.counts_of(stays, "origem", "estadas")


def _in_chunks(stays: DataFrame) -> DataFrame:
    """Adds the columns of CHUNK, which sort as the entry order does and split a ticket into
    pieces of bounded size: minutes, in heavy minutes seconds, in heavy seconds as many
    blocks as their rows fill. A block is a part of the span of entries, or of sequence numbers
    where all entries are equal, whatever numbers they are."""
    entry, seq = F.col("data_entrada_n2"), F.col("seq")
    # Day plus clock, not date_trunc, which would go through the session time zone.
    day = entry.cast("date").cast("timestamp_ntz")
    last = F.lit(NO_DAY).cast("timestamp_ntz")
    clock = {"hours": F.hour(entry), "mins": F.minute(entry)}
    second = F.floor(F.second(entry)).cast("int")
    dated = stays.withColumns(
        {
            "minuto_n2": F.coalesce(day + F.make_dt_interval(**clock), last),
            "segundo_n2": F.coalesce(day + F.make_dt_interval(**clock, secs=second), last),
        }
    )
    by_second = dated.groupBy("origem", "minuto_n2", "segundo_n2").agg(
        F.count(F.lit(1)).alias("linhas_s"),
        F.min(entry).alias("entrada_min"),
        F.max(entry).alias("entrada_max"),
        F.min(seq).cast("double").alias("seq_min"),
        F.max(seq).cast("double").alias("seq_max"),
    )
    by_minute = by_second.groupBy("origem", "minuto_n2").agg(F.sum("linhas_s").alias("linhas_m"))
    seconds = skew.heavy(by_second, ["origem", "segundo_n2"], "linhas_s").drop("minuto_n2")
    minutes = skew.heavy(by_minute, ["origem", "minuto_n2"], "linhas_m")
    sized = dated.join(minutes, ["origem", "minuto_n2"], "left").join(seconds, ["origem", "segundo_n2"], "left")
    blocks = skew.chunks("linhas_s")
    by_entry = micros_between(F.col("entrada_min"), entry).cast("double") / (
        micros_between(F.col("entrada_min"), F.col("entrada_max")).cast("double") + 1
    )
    by_seq = (seq.cast("double") - F.col("seq_min")) / (F.col("seq_max") - F.col("seq_min") + 1)
    part = F.when(F.col("entrada_max") > F.col("entrada_min"), by_entry).otherwise(by_seq)
    block = F.coalesce(F.least(F.floor(part * blocks).cast("int"), blocks - 1), blocks)
    within = F.col("linhas_m").isNotNull()
    return sized.withColumns(
        {
            "pedaco_minuto": F.col("minuto_n2"),
            "pedaco_segundo": F.when(within, F.col("segundo_n2")).otherwise(F.col("minuto_n2")),
            "pedaco_bloco": F.when(within & F.col("linhas_s").isNotNull(), block).otherwise(F.lit(0)),
        }
    ).select(*stays.columns, *CHUNK)


def _mark(chunked: DataFrame) -> DataFrame:
    """Marks stays of heavy tickets, which carry CHUNK. Stays are ordered inside chunks of a ticket; the first
    of a chunk takes its previous user from the last stay of the chunk before, found over
    one row per chunk."""
    in_chunk = Window.partitionBy("origem", *CHUNK).orderBy(*_entry_order())
    inside = chunked.withColumns(
        {"anterior": F.lag("usuario_cod").over(in_chunk), "pos": F.row_number().over(in_chunk)}
    )
    # Nulls last, as in the entry order: a missing value must win the maximum.
    rank = F.struct(F.col("data_entrada_n2").isNull(), "data_entrada_n2", F.col("seq").isNull(), "seq")
    lasts = chunked.groupBy("origem", *CHUNK).agg(F.max_by("usuario_cod", rank).alias("ultimo"))
    by_chunk = Window.partitionBy("origem").orderBy(*CHUNK)
    carried = lasts.select("origem", *CHUNK, F.lag("ultimo").over(by_chunk).alias("trazido"))
    previous = F.when(F.col("pos") == 1, F.col("trazido")).otherwise(F.col("anterior"))
    return _with_starts(
        inside.join(carried, ["origem", *CHUNK], "left")
        .withColumn("usuario_anterior", previous)
        .drop("anterior", "pos", "trazido")
    )


def _mark_light(stays: DataFrame) -> DataFrame:
    before = F.lag("usuario_cod").over(Window.partitionBy("origem").orderBy(*_entry_order()))
    return _with_starts(stays.withColumn("usuario_anterior", before))


def mark_starts(stays: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Adds the previous user of the ticket, and whether a stay starts a handling:
    a user acts who is not the one of the stay just before. `counts` is `stays_per_ticket`,
    for callers that can count without building the stays."""
    light, hot = _split(stays, counts if counts is not None else _own_counts(stays))
    return _mark_light(light).unionByName(_mark(_in_chunks(hot)).drop(*CHUNK))


def _total_light(marked: DataFrame) -> DataFrame:
    ticket = Window.partitionBy("origem")
    return marked.withColumns(
        {
            "total_n2": F.sum("total_segundos").over(ticket),
            "total_atuacao": F.sum("total_segundos_atuacao").over(ticket),
            "total_inicios": F.sum("inicio_atuacao").over(ticket),
        }
    )


def _total(chunked: DataFrame) -> DataFrame:
    """Adds the ticket's sums to marked stays of heavy tickets, which carry CHUNK: sums per
    chunk, added up per ticket, and brought back chunk by chunk, so that no step holds a
    ticket whole."""
    by_chunk = chunked.groupBy("origem", *CHUNK).agg(
        F.sum("total_segundos").alias("s"),
        F.sum("total_segundos_atuacao").alias("a"),
        F.sum("inicio_atuacao").alias("i"),
    )
    sums = by_chunk.groupBy("origem").agg(
        F.sum("s").alias("total_n2"),
        F.sum("a").alias("total_atuacao"),
        F.sum("i").alias("total_inicios"),
    )
    back = by_chunk.select("origem", *CHUNK).join(sums, "origem")
    return chunked.join(back, ["origem", *CHUNK]).drop(*CHUNK)


def _texts(stays: DataFrame, *extra: str) -> DataFrame:
    acted = F.col("teve_atuacao") == YES
    acted_total = F.when(acted, F.col("total_atuacao"))
    return stays.select(
        "origem",
        "grupo_n2",
        "usuario_atuacao",
        "data_entrada_n2",
        "data_saida_n2",
        "teve_atuacao",
        "ainda_na_fila",
        "inicio_atuacao",
        "contar_atuacao",
        "contar_sem_atuacao",
        hms(F.col("total_segundos")).alias("tempo_no_grupo"),
        hms(F.col("total_segundos")).alias("tma_n2"),
        hms(acted_total).alias("tempo_total_atuacao"),
        F.when(acted, F.col("total_inicios")).alias("quantidade_atuacao"),
        hms(F.col("total_n2")).alias("tempo_total_n2"),
        F.col("total_segundos").alias("tma_n2_seg"),
        acted_total.alias("tempo_total_atuacao_seg"),
        F.col("total_n2").alias("tempo_total_n2_seg"),
        *extra,
    )


def stay_totals(stays: DataFrame) -> DataFrame:
    """Marked stays with the ticket's total time, acted time and handlings, as
    texts and as seconds."""
    light, hot = _split(stays, _own_counts(stays))
    return _texts(_total_light(light).unionByName(_total(_in_chunks(hot))))


def stay_table(
    life: DataFrame, groups: DataFrame, users: DataFrame, as_of: datetime
) -> DataFrame:
    """Stays with starts and totals. A light ticket is shuffled once and read twice, the
    first time for its number of rows only."""
    stays = group_stays(life, groups, users, as_of)
    light, hot = _split(stays, stays_per_ticket(life))
    return _texts(_total_light(_mark_light(light)).unionByName(_total(_mark(_in_chunks(hot)))))


def stay_parts(
    life: DataFrame,
    groups: DataFrame,
    users: DataFrame,
    as_of: datetime,
    sizes: DataFrame,
    source: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """The rows of `stay_table` of light tickets, and of heavy ones with the columns of
    `sizes`, a table of heavy tickets that names all with more stays than a chunk.

    `life` has the rows of the tickets that `sizes` was counted over, `source` those and maybe
    others: heavy tickets are taken from it ahead of the shuffle that chose `life`."""
    light, _ = skew.split(group_stays(life, groups, users, as_of), sizes)
    counts = [c for c in sizes.columns if c != "origem"]
    hot = group_stays(skew.only_heavy(source, "vda_ta", sizes), groups, users, as_of, keep=counts)
    return _texts(_total_light(_mark_light(light))), _texts(_total(_mark(_in_chunks(hot))), *counts)


def stays_per_ticket(life: DataFrame, n2: Sequence[int] = N2_GROUPS) -> DataFrame:
    """How many stays each ticket has, for tickets that have any: (origem, estadas)."""
    stays = life.where(F.col("vda_grupo").isin(list(n2)) & F.col("vda_ta").isNotNull())
    return stays.groupBy(F.col("vda_ta").alias("origem")).agg(F.count(F.lit(1)).alias("estadas"))


def classify_stay(df: DataFrame) -> DataFrame:
    """SIM for a counted handling, NAO for a stay nobody acted in, else VAZIO."""
    kind = (
        F.when(F.col("contar_atuacao") == 1, YES)
        .when(F.col("contar_sem_atuacao") == 1, NO_STAY)
        .otherwise(UNCLASSIFIED)
    )
    return df.withColumn("classificacao_atuacao", kind)
