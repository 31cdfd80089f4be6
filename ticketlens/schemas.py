"""Explicit schemas of the input, tracking and activity tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "timestamp_ntz": T.TimestampNTZType(),
}


def _schema(columns: str) -> T.StructType:
    """A schema from `name type, ...`; needs no running session, unlike DDL."""
    pairs = (column.split() for column in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


TA = _schema(
    "tqa_codigo bigint, tqa_origem bigint, tqa_raiz bigint, tqa_status int, tqa_area_codigo string,"
    " tqa_estado_codigo string, tqa_gerencia_codigo string, tqa_data_criacao timestamp_ntz,"
    " tqa_data_encerramento timestamp_ntz, tqa_tipo_bilhete string, tqa_tipo_site string,"
    " tqa_alarme_tipo string, tqa_impacto_eqp string, tqa_tipo_rede int, tqa_responsavelpor_grupo int"
)
# vda_seq is the tie-break of stays that enter at the same instant.
VIDA = _schema(
    "vda_ta bigint, vda_seq bigint, vda_grupo int, vda_usuario int,"
    " vda_data_initial timestamp_ntz, vda_data_final timestamp_ntz"
)
GRUPOS = _schema("grp_codigo int, grp_nome string, grp_pai int")
USUARIOS = _schema("usr_codigo int, usr_nome string")
PROCED = _schema("pca_ta bigint, pca_grupo int, pca_usuario int, pca_data timestamp_ntz")
EQUIP = _schema("aeq_ta bigint, aeq_hostname string, aeq_fabricante string")
STATUS_TA = _schema("sta_codigo int, sta_nome string")

SNAPSHOT = _schema(
    "origem bigint, elemento bigint, ta_raiz bigint, status string, site string, uf string,"
    " regional string, data_criacao timestamp_ntz, data_encerramento timestamp_ntz,"
    " tipo_bilhete string, tipo_site string, tipo_de_alarme string, hostname string,"
    " fabricante string, impacto string, grupo_responsavel string,"
    " passou_pelo_acesso_ericson string, passou_pelo_acesso_huawei string,"
    " passou_pelo_campo string, passou_pelo_coran string"
)
STAY_COLUMNS = _schema(
    "grupo_n2 string, usuario_atuacao string, data_entrada_n2 timestamp_ntz,"
    " data_saida_n2 timestamp_ntz, teve_atuacao string, ainda_na_fila string, inicio_atuacao int,"
    " contar_atuacao int, contar_sem_atuacao int, tempo_no_grupo string, tma_n2 string,"
    " tempo_total_atuacao string, quantidade_atuacao bigint, tempo_total_n2 string"
)
STAY_SECONDS = _schema(
    "tma_n2_seg bigint, tempo_total_atuacao_seg bigint, tempo_total_n2_seg bigint"
)
PROCEDURES = _schema(
    "origem_PROCEDIMENTO bigint, grupo_n2_PROCEDIMENTO string, usuario_atuacao_PROCEDIMENTO string,"
    " data_entrada_n2_PROCEDIMENTO timestamp_ntz, data_saida_n2_PROCEDIMENTO timestamp_ntz,"
    " teve_atuacao_PROCEDIMENTO string, ainda_na_fila_PROCEDIMENTO string,"
    " inicio_atuacao_PROCEDIMENTO int, contar_atuacao_PROCEDIMENTO int,"
    " contar_sem_atuacao_PROCEDIMENTO int, tempo_no_grupo_PROCEDIMENTO string,"
    " tma_n2_PROCEDIMENTO string, tempo_total_atuacao_PROCEDIMENTO string,"
    " quantidade_atuacao_PROCEDIMENTO int, tempo_total_n2_PROCEDIMENTO string,"
    " origem_atuacao_PROCEDIMENTO string"
)
TRACKING = T.StructType(
    SNAPSHOT.fields
    + STAY_COLUMNS.fields
    + [T.StructField("classificacao_atuacao", T.StringType())]
    + PROCEDURES.fields
    + STAY_SECONDS.fields
)

ATIVIDADE_PADRAO = _schema(
    "id int, categoria string, nome_atividade string, tempo_estimado_min int,"
    " observacao string, ativo boolean"
)
ATIVIDADE_SUPORTE = _schema(
    "id_atividade int, matricula string, nome_usuario string, id_atividade_padrao int,"
    " status string, data_inicio timestamp_ntz, data_fim timestamp_ntz, tempo_estimado_min int,"
    " tempo_real_min int, observacoes string"
)
HISTORICO = _schema(
    "id_historico int, id_atividade int, matricula_responsavel string, nome_usuario string,"
    " tipo_evento string, descricao_evento string, data_evento timestamp_ntz"
)
ARQUIVOS = _schema(
    "id_arquivo int, id_atividade int, nome_original string, nome_arquivo string, caminho string,"
    " content_type string, tamanho_bytes bigint, data_upload timestamp_ntz"
)
COMANDOS = _schema(
    "cmd_id bigint, ts timestamp_ntz, kind string, id_atividade int, matricula string,"
    " nome_usuario string, id_atividade_padrao int, status string, observacoes string,"
    " nome_original string"
)

TICKET_TABLES = {
    "ta": TA,
    "vida": VIDA,
    "grupos": GRUPOS,
    "usuarios": USUARIOS,
    "proced": PROCED,
    "equip": EQUIP,
    "status_ta": STATUS_TA,
}
ACTIVITY_TABLES = {
    "atividade_padrao": ATIVIDADE_PADRAO,
    "atividade_suporte": ATIVIDADE_SUPORTE,
    "historico": HISTORICO,
    "arquivos": ARQUIVOS,
    "comandos": COMANDOS,
}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of `schema`, in its order and types; a missing one is an error."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
