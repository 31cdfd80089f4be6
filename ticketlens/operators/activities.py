"""Reading the activity log: catalogue, activities, history, attachments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.operators.skew import chunked_join, counts_of, heavy

FILE_FIELDS = (
    "id_arquivo",
    "id_atividade",
    "nome_original",
    "nome_arquivo",
    "caminho",
    "content_type",
    "tamanho_bytes",
    "data_upload",
)


def active_catalogue(catalogue: DataFrame) -> DataFrame:
    """Entries in use, by category and name."""
    return (
        catalogue.where("ativo")
        .orderBy(F.col("categoria"), F.col("nome_atividade"), F.col("id"))
        .select(
            F.col("id").alias("id_atividade"), "nome_atividade", "tempo_estimado_min", "observacao"
        )
    )


def _with_link(files: DataFrame, link_prefix: str) -> DataFrame:
    """The link of an attachment is a prefix (the route under which a service hands out
    attachments, so the caller's) followed by its id."""
    link = F.concat(F.lit(link_prefix), F.col("id_arquivo").cast("string"))
    return files.withColumn("url_download", link)


def _listing(
    activities: DataFrame, catalogue: DataFrame, files: DataFrame, fields: Sequence[str]
) -> DataFrame:
    names = catalogue.select(F.col("id").alias("id_atividade_padrao"), "nome_atividade")
    named = activities.join(names, "id_atividade_padrao")
    attached = files.select("id_atividade", *[F.col(f).alias(f"arquivo_{f}") for f in fields])
    large = heavy(counts_of(attached, "id_atividade", "arquivos"), ["id_atividade"], "arquivos")
    rows = chunked_join(
        named.join(large, "id_atividade", "left"),
        attached.join(large, "id_atividade", "left"),
        "id_atividade",
        right_rows="arquivos",
    )
    return rows.select(
        "id_atividade",
        "matricula",
        "nome_usuario",
        "id_atividade_padrao",
        "nome_atividade",
        "status",
        "data_inicio",
        "data_fim",
        "tempo_estimado_min",
        "tempo_real_min",
        "observacoes",
        *[f"arquivo_{f}" for f in fields],
    ).orderBy(F.col("data_inicio").desc_nulls_last(), F.col("id_atividade").desc(), "arquivo_id_arquivo")


def activity_list(
    activities: DataFrame, catalogue: DataFrame, files: DataFrame, link_prefix: str
) -> DataFrame:
    """Activities with a catalogue entry, newest first: one row per activity and
    attachment, with its link; an activity without attachments is one row with nulls."""
    linked = _with_link(files, link_prefix)
    return _listing(activities, catalogue, linked, [*FILE_FIELDS, "url_download"])


def _chosen(df: DataFrame, ids: DataFrame) -> DataFrame:
    # Distinct first: ids may repeat without end, as in an event table.
    return df.join(ids.select("id_atividade").distinct(), "id_atividade", "left_semi")


def activity_detail(
    activities: DataFrame, catalogue: DataFrame, files: DataFrame, ids: DataFrame
) -> DataFrame:
    """The same for the activities in `ids`; attachments carry no link."""
    return _listing(_chosen(activities, ids), catalogue, _chosen(files, ids), FILE_FIELDS)


def activity_history(history: DataFrame, ids: DataFrame) -> DataFrame:
    """Events of the activities in `ids`, newest first per activity."""
    return (
        _chosen(history, ids)
        .select(
            "id_historico",
            "id_atividade",
            "matricula_responsavel",
            "nome_usuario",
            "tipo_evento",
            "descricao_evento",
            "data_evento",
        )
        .orderBy("id_atividade", F.col("data_evento").desc_nulls_last(), F.col("id_historico").desc())
    )


def activity_files(files: DataFrame, ids: DataFrame, link_prefix: str) -> DataFrame:
    """Attachments of the activities in `ids` with links, newest first per activity."""
    return (
        _with_link(_chosen(files, ids), link_prefix)
        .select(*FILE_FIELDS, "url_download")
        .orderBy("id_atividade", F.col("data_upload").desc_nulls_last(), F.col("id_arquivo").desc())
    )
