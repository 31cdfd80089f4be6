"""Procedure entries summarised per ticket, group and user."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.functions.durations import hms, seconds_between
from ticketlens.operators.snapshot import N2_GROUPS, YES

# Suffix of the procedure columns and the two source tags.
SUFFIX = "_PROCEDIMENTO"
FROM_LIFE = "VIDA"
FROM_PROCEDURE = "PROCEDIMENTO"


def procedure_summary(
    procs: DataFrame, groups: DataFrame, users: DataFrame, n2: Sequence[int] = N2_GROUPS
) -> DataFrame:
    """First and last entry and their span per (ticket, group name, user name),
    with the constant columns of an acted stay. All names carry the suffix."""
    # One row per N2 group code at most: bounded.
    group_names = F.broadcast(groups.where(F.col("grp_codigo").isin(list(n2))))
    user_names = users.select(F.col("usr_codigo").cast("bigint").alias("chave"), "usr_nome")
    # Entries without user are spread over negative keys, which meet no name.
    spread = -1 - F.pmod(F.xxhash64("pca_ta", "pca_data"), F.lit(1_000_000))
    named = (
        procs.where(F.col("pca_grupo").isin(list(n2)))
        .join(group_names, F.col("pca_grupo") == F.col("grp_codigo"), "left")
        .withColumn("chave", F.coalesce(F.col("pca_usuario").cast("bigint"), spread))
        .join(user_names, "chave", "left")
    )
    spans = named.groupBy("pca_ta", "grp_nome", "usr_nome").agg(
        F.min("pca_data").alias("primeira"), F.max("pca_data").alias("ultima")
    )
    text = hms(seconds_between(F.col("primeira"), F.col("ultima")))
    columns = {
        "origem": F.col("pca_ta"),
        "grupo_n2": F.col("grp_nome"),
        "usuario_atuacao": F.col("usr_nome"),
        "data_entrada_n2": F.col("primeira"),
        "data_saida_n2": F.col("ultima"),
        "teve_atuacao": F.lit(YES),
        "ainda_na_fila": F.lit(None).cast("string"),
        "inicio_atuacao": F.lit(1),
        "contar_atuacao": F.lit(1),
        "contar_sem_atuacao": F.lit(0),
        "tempo_no_grupo": text,
        "tma_n2": text,
        "tempo_total_atuacao": text,
        "quantidade_atuacao": F.lit(1),
        "tempo_total_n2": text,
        "origem_atuacao": F.lit(FROM_PROCEDURE),
    }
    return spans.select([value.alias(name + SUFFIX) for name, value in columns.items()])


def procedure_only(procedures: DataFrame, stays: DataFrame) -> DataFrame:
    """Procedure rows of tickets that have no stay at all."""
    with_stay = stays.select(F.col("origem").alias("origem" + SUFFIX)).distinct()
    return procedures.join(with_stay, "origem" + SUFFIX, "left_anti")


def stays_with_procedures(stays: DataFrame, procedures: DataFrame) -> DataFrame:
    """Stays followed by the procedure-only rows in the same columns, tagged with
    their source in `origem_atuacao`."""
    extra = procedure_only(procedures, stays)
    plain = extra.select([F.col(c).alias(c.removesuffix(SUFFIX)) for c in extra.columns])
    shared = [c for c in plain.columns if c in stays.columns]
    tagged = stays.select(*shared).withColumn("origem_atuacao", F.lit(FROM_LIFE))
    return tagged.unionByName(plain.select(*shared, "origem_atuacao"))
