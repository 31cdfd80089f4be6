"""Folding activity commands into activity state, history and rejects.

Acceptance depends only on whether the activity exists yet and on fixed sets of
values, never on the state other commands left behind. So commands are judged by
joins and every field of an activity is the value of its last accepted setter:
aggregates with map-side partials, no ordered replay.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.functions.durations import micros_between
from ticketlens.operators.skew import chunked_join, counts_of, heavy
from ticketlens.schemas import ATIVIDADE_SUPORTE

# Command kinds, statuses, history texts and reject reasons.
CREATE, SET_STATUS, SET_NOTE, ATTACH = "create", "status", "note", "attach"
CREATE_STATUS = ("Agendado", "Em Atuação", "Improcedente")
UPDATE_STATUS = ("Agendado", "Em Atuação", "Finalizado", "Improcedente")
FINISHED = "Finalizado"
EVENT_KINDS = {
    CREATE: "CRIACAO",
    SET_STATUS: "STATUS_ATUALIZADO",
    SET_NOTE: "OBSERVACAO_ATUALIZADA",
    ATTACH: "ARQUIVO_ANEXADO",
}
CREATED_TEXT = "Atividade criada."
STATUS_TEXT = "Status alterado para {}."
NOTE_TEXT = "Observação atualizada."
ATTACHED_TEXT = "Arquivo anexado: {}"
NO_CATALOGUE = (400, "Atividade padrão inválida.")
BAD_STATUS = (400, "Status inválido.")
NO_ACTIVITY = (404, "Atividade não encontrada.")
NO_FILE = (400, "Nenhum arquivo enviado.")
NO_VALID_FILE = (400, "Nenhum arquivo válido enviado.")
# Ours: cases a service that hands out its own ids and checks shapes cannot meet.
REPEATED_ID = (409, "Atividade já existe.")
NO_NOTE = (422, "Observação ausente.")
UNKNOWN_KIND = (422, "Comando desconhecido.")


def _order() -> Column:
    """Position of a command: time, then command id."""
    return F.struct("ts", "cmd_id")


def _verdict(cases: Sequence[tuple[Column, tuple[int, str]]]) -> Column:
    """(code, reason) of the first failing check, null when all pass."""
    verdict = F.lit(None).cast("struct<codigo: int, motivo: string>")
    for failed, (code, reason) in reversed(cases):
        failure = F.struct(F.lit(code).alias("codigo"), F.lit(reason).alias("motivo"))
        verdict = F.when(failed, failure).otherwise(verdict)
    return verdict


def _not_in(column: str, allowed: Sequence[str]) -> Column:
    return ~F.coalesce(F.col(column).isin(list(allowed)), F.lit(False))


def judge_commands(
    activities: DataFrame,
    catalogue: DataFrame,
    commands: DataFrame,
) -> DataFrame:
    """Every command with `veredito` (null = accepted) and the facts of its
    activity: owner, start and catalogue entry.

    An activity exists from before the first command when it is in `activities`,
    else from its first acceptable create. A create is checked for its catalogue
    entry, then its status, then a repeated id; other kinds for the activity,
    then their own values."""
    is_create = F.coalesce(F.col("kind") == CREATE, F.lit(False))
    entries = catalogue.select(
        F.col("id").cast("bigint").alias("entrada"),
        F.col("tempo_estimado_min").alias("tempo_padrao"),
        F.lit(True).alias("no_catalogo"),
    )
    # Only creates look an entry up. The others get keys of their own, so that a
    # join by shuffle spreads them instead of gathering them on one null.
    entry = F.when(is_create, F.col("id_atividade_padrao")).otherwise(-1 - F.col("cmd_id"))
    checked = commands.withColumn("entrada", entry).join(entries, "entrada", "left")
    create_checks = [
        (F.col("no_catalogo").isNull(), NO_CATALOGUE),
        (_not_in("status", CREATE_STATUS), BAD_STATUS),
    ]
    known = activities.select(
        "id_atividade",
        F.lit(True).alias("dado"),
        F.lit(None).cast("struct<ts: timestamp_ntz, cmd_id: bigint>").alias("desde"),
        F.col("matricula").alias("dono"),
        F.col("nome_usuario").alias("nome_dono"),
        F.col("data_inicio").alias("inicio"),
    )
    born = checked.where(is_create & _verdict(create_checks).isNull()).select(
        "id_atividade",
        F.lit(False).alias("dado"),
        _order().alias("desde"),
        F.col("matricula").alias("dono"),
        F.col("nome_usuario").alias("nome_dono"),
        F.col("ts").alias("inicio"),
    )
    # Nulls sort first: a given activity precedes every command.
    births = (
        known.unionByName(born)
        .groupBy("id_atividade")
        .agg(F.min(F.struct("desde", "dado", "dono", "nome_dono", "inicio")).alias("b"))
        .select("id_atividade", "b.*")
    )
    repeated = F.col("dado") | (F.col("desde") != _order())
    exists = F.coalesce(F.col("dado") | (F.col("desde") < _order()), F.lit(False))
    kind = F.coalesce("kind", F.lit(""))
    name = F.col("nome_original")
    other_checks = [
        (~kind.isin(list(EVENT_KINDS)), UNKNOWN_KIND),
        (~exists, NO_ACTIVITY),
        ((kind == SET_STATUS) & _not_in("status", UPDATE_STATUS), BAD_STATUS),
        ((kind == SET_NOTE) & F.col("observacoes").isNull(), NO_NOTE),
        ((kind == ATTACH) & name.isNull(), NO_FILE),
        ((kind == ATTACH) & (name == ""), NO_VALID_FILE),
    ]
    verdict = F.when(is_create, _verdict([*create_checks, (repeated, REPEATED_ID)])).otherwise(
        _verdict(other_checks)
    )
    large = heavy(counts_of(commands, "id_atividade", "comandos"), ["id_atividade"], "comandos")
    judged = chunked_join(
        checked.join(large, "id_atividade", "left"),
        births.join(large, "id_atividade", "left"),
        "id_atividade",
        left_rows=F.col("comandos"),
    ).drop("comandos")
    return judged.withColumn("veredito", verdict).drop("entrada", "no_catalogo")


def _accepted(judged: DataFrame) -> DataFrame:
    return judged.where(F.col("veredito").isNull())


def reject_commands(judged: DataFrame) -> DataFrame:
    """Refused commands with code and reason."""
    return judged.where(F.col("veredito").isNotNull()).select(
        "cmd_id", "ts", "kind", "id_atividade", "veredito.codigo", "veredito.motivo"
    )


def history_from_commands(judged: DataFrame) -> DataFrame:
    """One audit row per accepted command; the actor is the activity's owner. The
    command id is the history id."""
    kind = F.col("kind")
    event = F.create_map(*[F.lit(v) for pair in EVENT_KINDS.items() for v in pair])

    def filled(text: str, value: str) -> Column:
        before, after = text.split("{}")
        return F.concat(F.lit(before), F.col(value), F.lit(after))

    text = (
        F.when(kind == CREATE, CREATED_TEXT)
        .when(kind == SET_STATUS, filled(STATUS_TEXT, "status"))
        .when(kind == SET_NOTE, NOTE_TEXT)
        .when(kind == ATTACH, filled(ATTACHED_TEXT, "nome_original"))
    )
    return _accepted(judged).select(
        F.col("cmd_id").alias("id_historico"),
        "id_atividade",
        F.col("dono").alias("matricula_responsavel"),
        F.col("nome_dono").alias("nome_usuario"),
        event[kind].alias("tipo_evento"),
        text.alias("descricao_evento"),
        F.col("ts").alias("data_evento"),
    )


def files_from_commands(judged: DataFrame) -> DataFrame:
    """Attachment metadata of accepted attach commands. The command id is the file
    id; size and content type are those of `conteudo` and `content_type` where commands
    carry them."""
    attached = _accepted(judged).where(F.col("kind") == ATTACH)
    content = F.col("content_type") if "content_type" in judged.columns else F.lit(None)
    size = F.octet_length("conteudo") if "conteudo" in judged.columns else F.lit(None)
    # Leading dots are part of the name, not the start of an extension.
    extension = F.regexp_extract("nome_original", r"^(?:.*/)?\.*[^./][^/]*?(\.[^./]*)$", 1)
    return attached.select(
        F.col("cmd_id").alias("id_arquivo"),
        "id_atividade",
        "nome_original",
        extension.alias("extensao"),
        content.cast("string").alias("content_type"),
        size.cast("bigint").alias("tamanho_bytes"),
        F.col("ts").alias("data_upload"),
    )


def apply_activity_commands(activities: DataFrame, judged: DataFrame) -> DataFrame:
    """Activities after all accepted commands, in the activity schema.

    Status and notes are those of the last command that sets them; the end is the
    time of the last finish and stays when the activity is reopened; the actual
    minutes are whole minutes from start to that end."""
    kind = F.col("kind")
    # Ours: marks a row of `activities`, which sets every field before any command.
    given = activities.withColumns({"kind": F.lit("given"), "ts": F.lit(None).cast("timestamp_ntz")})
    given = given.withColumn("cmd_id", F.lit(None).cast("bigint"))
    done = _accepted(judged).withColumns(
        {
            "data_inicio": F.when(kind == CREATE, F.col("ts")),
            "data_fim": F.when((kind == SET_STATUS) & (F.col("status") == FINISHED), F.col("ts")),
            "tempo_estimado_min": F.col("tempo_padrao"),
            "tempo_real_min": F.lit(None).cast("int"),
        }
    )
    columns = ["cmd_id", "ts", "kind", *[f.name for f in ATIVIDADE_SUPORTE]]
    steps = given.select(*columns).unionByName(done.select(*columns))

    starts = kind.isin("given", CREATE)
    position = F.struct("ts", "cmd_id")

    def first(column: str) -> Column:
        return F.max_by(column, F.when(starts, position)).alias(column)

    def last(column: str, setter: Column) -> Column:
        return F.max_by(column, F.when(starts | setter, position)).alias(column)

    finishes = (kind == SET_STATUS) & (F.col("status") == FINISHED)
    folded = steps.groupBy("id_atividade").agg(
        first("matricula"),
        first("nome_usuario"),
        first("id_atividade_padrao"),
        first("data_inicio"),
        first("tempo_estimado_min"),
        last("status", kind == SET_STATUS),
        last("observacoes", kind == SET_NOTE),
        last("data_fim", finishes),
        F.max_by("tempo_real_min", F.when(starts, position)).alias("minutos_dados"),
        F.bool_or(finishes).alias("terminou"),
    )
    minutes = F.call_function(
        "div", micros_between(F.col("data_inicio"), F.col("data_fim")), F.lit(60_000_000)
    ).cast("int")
    measured = F.col("terminou") & F.col("data_inicio").isNotNull()
    return folded.withColumn(
        "tempo_real_min", F.when(measured, minutes).otherwise(F.col("minutos_dados"))
    ).select([f.name for f in ATIVIDADE_SUPORTE])
