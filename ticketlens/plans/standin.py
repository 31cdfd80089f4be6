"""Ticket and activity tables derived from the generic test tables.

The test data has no tickets, so orders play root tickets, line items play
elements and life rows, suppliers users, events procedure entries, history and
commands, and so on. Every derivation is row by row or a keyed aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens import schemas

# The small code tables of the stand-in.
GROUPS = """select * from values
  (6611, 'GRP_ACCESS_A', 900),
  (6612, 'GRP_ACCESS_B', 900),
  (6563, 'GRP_CORE', 900),
  (1341, 'GRP_FIELD_1', 1340)
  as t(grp_codigo, grp_nome, grp_pai)"""
STATUS = """select * from values (10, 'OPEN'), (20, 'WORKING'), (70, 'HELD'), (90, 'CLOSED')
  as t(sta_codigo, sta_nome)"""
ELEMENT_CODE = "1000000000 + l_partkey * 1000000 + l_orderkey"


class Source:
    """A data folder; every file is opened once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self._folder = folder
        self._open: dict[str, DataFrame] = {}

    def read(self, name: str) -> DataFrame:
        if name not in self._open:
            self._open[name] = self.spark.read.parquet(f"{self._folder}/{name}.parquet")
        return self._open[name]


def tickets(source: Source) -> DataFrame:
    orders, lines = source.read("orders"), source.read("lineitem")
    roots = orders.selectExpr(
        "o_orderkey as tqa_codigo",
        "cast(null as bigint) as tqa_origem",
        "o_custkey as tqa_raiz",
        "case when o_orderstatus = 'O' then 10 when o_orderstatus = 'F' then 90"
        " when o_orderkey % 2 = 0 then 20 else 70 end as tqa_status",
        "cast(null as string) as tqa_area_codigo",
        "cast(null as string) as tqa_estado_codigo",
        "concat('REG_', cast(o_custkey % 4 as string)) as tqa_gerencia_codigo",
        "o_orderdate as tqa_data_criacao",
        "case when o_orderstatus = 'F' then o_orderdate + interval '1' second"
        " * cast((o_orderkey % 40 + 1) * 86400 + (o_orderkey % 5) * 3600 as int) end"
        " as tqa_data_encerramento",
        "o_orderpriority as tqa_tipo_bilhete",
        "case when o_custkey % 2 = 0 then 'MACRO' else 'SMALL' end as tqa_tipo_site",
        "case when o_custkey % 3 = 0 then 'POWER' else 'LINK' end as tqa_alarme_tipo",
        "cast(null as string) as tqa_impacto_eqp",
        "case when o_orderkey % 10 = 0 then 702 else 701 end as tqa_tipo_rede",
        "case when o_orderkey % 4 = 0 then cast(null as int) else 6611 end as tqa_responsavelpor_grupo",
    )
    elements = lines.selectExpr(
        f"{ELEMENT_CODE} as tqa_codigo",
        "l_orderkey as tqa_origem",
        "cast(null as bigint) as tqa_raiz",
        "10 as tqa_status",
        "concat('SITE_', cast(l_suppkey as string)) as tqa_area_codigo",
        "concat('UF_', cast(l_suppkey % 27 as string)) as tqa_estado_codigo",
        "cast(null as string) as tqa_gerencia_codigo",
        "l_shipdate as tqa_data_criacao",
        "cast(null as timestamp_ntz) as tqa_data_encerramento",
        "cast(null as string) as tqa_tipo_bilhete",
        "cast(null as string) as tqa_tipo_site",
        "cast(null as string) as tqa_alarme_tipo",
        "case when l_tax > 0.04 then 'HIGH' else 'LOW' end as tqa_impacto_eqp",
        "701 as tqa_tipo_rede",
        "cast(null as int) as tqa_responsavelpor_grupo",
    )
    return roots.unionByName(elements)


def equipment(source: Source) -> DataFrame:
    lines = source.read("lineitem").where("l_partkey % 2 = 0")
    return lines.selectExpr(
        f"{ELEMENT_CODE} as aeq_ta",
        "concat('host-', cast(l_partkey as string)) as aeq_hostname",
        "case when l_partkey % 4 = 0 then 'VENDOR_A' else 'VENDOR_B' end as aeq_fabricante",
    ).distinct()


def life(source: Source) -> DataFrame:
    entry = "l_shipdate + interval '1' second"
    return source.read("lineitem").selectExpr(
        "l_orderkey as vda_ta",
        "l_partkey as vda_seq",
        "case cast(l_suppkey % 5 as int) when 0 then 6611 when 1 then 6612 when 2 then 6563"
        " when 3 then 1341 else 9999 end as vda_grupo",
        "case when l_returnflag = 'N' then null else cast(l_partkey % 3 as int) end as vda_usuario",
        f"{entry} * cast(l_partkey % 86400 as int) as vda_data_initial",
        "case when l_linestatus = 'O' and l_linenumber = 7 then null"
        f" else {entry} * cast(l_partkey % 86400 + l_quantity * 977 as int) end as vda_data_final",
    )


def procedures(source: Source) -> DataFrame:
    return source.read("events").selectExpr(
        "user_id * 10 + event_id % 3 as pca_ta",
        "case event_type when 'error' then 6611 when 'click' then 6612 else 6563 end as pca_grupo",
        "cast(user_id % 4 as int) as pca_usuario",
        "ts as pca_data",
    )


def groups(source: Source) -> DataFrame:
    return source.spark.sql(GROUPS)


def users(source: Source) -> DataFrame:
    return source.read("supplier").selectExpr(
        "cast(s_suppkey as int) as usr_codigo", "s_name as usr_nome"
    )


def status_names(source: Source) -> DataFrame:
    return source.spark.sql(STATUS)


def catalogue(source: Source) -> DataFrame:
    return source.read("part").selectExpr(
        "cast(p_partkey as int) as id",
        "p_type as categoria",
        "p_name as nome_atividade",
        "p_size as tempo_estimado_min",
        "p_brand as observacao",
        "p_size % 4 <> 0 as ativo",
    )


def activities(source: Source) -> DataFrame:
    orders, customers = source.read("orders"), source.read("customer")
    owned = orders.join(customers, F.col("c_custkey") == F.col("o_custkey"))
    return owned.selectExpr(
        "cast(o_orderkey as int) as id_atividade",
        "cast(o_custkey as string) as matricula",
        "c_name as nome_usuario",
        "cast(case when o_orderkey % 11 = 0 then -1 else o_orderkey % 200 end as int)"
        " as id_atividade_padrao",
        "case o_orderstatus when 'F' then 'Finalizado' when 'O' then 'Agendado'"
        " else 'Em Atuação' end as status",
        "o_orderdate as data_inicio",
        "case when o_orderstatus = 'F' then"
        " o_orderdate + interval '1' second * cast(o_orderkey % 30000 as int) end as data_fim",
        "cast(o_custkey % 50 as int) as tempo_estimado_min",
        "case when o_orderstatus = 'F' then cast(floor((o_orderkey % 30000) / 60) as int) end"
        " as tempo_real_min",
        "o_orderpriority as observacoes",
    )


def history(source: Source) -> DataFrame:
    return source.read("events").selectExpr(
        "cast(event_id as int) as id_historico",
        "cast(user_id as int) as id_atividade",
        "cast(user_id as string) as matricula_responsavel",
        "cast(null as string) as nome_usuario",
        "case event_type when 'signup' then 'CRIACAO' when 'view' then 'OBSERVACAO_ATUALIZADA'"
        " when 'purchase' then 'ARQUIVO_ANEXADO' else 'STATUS_ATUALIZADO' end as tipo_evento",
        "props as descricao_evento",
        "ts as data_evento",
    )


def attachments(source: Source) -> DataFrame:
    return source.read("documents").selectExpr(
        "cast(doc_id as int) as id_arquivo",
        "cast(doc_id % 400 as int) as id_atividade",
        "concat(source, '-', cast(doc_id as string), '.txt') as nome_original",
        "concat('f', cast(doc_id as string), '.txt') as nome_arquivo",
        "concat('/files/f', cast(doc_id as string), '.txt') as caminho",
        "lang as content_type",
        "n_chars as tamanho_bytes",
        "timestamp_ntz '2024-01-01 00:00:00' + interval '1' second * cast(doc_id as int) as data_upload",
    )


def commands(source: Source) -> DataFrame:
    events = source.read("events")
    # The first event of a user, by aggregate and a join on the unique event id.
    first = events.groupBy("user_id").agg(
        F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id")
    )
    marked = events.join(
        first.select("event_id", F.lit(True).alias("primeiro")), "event_id", "left"
    )
    return marked.selectExpr(
        "event_id as cmd_id",
        "ts",
        "case when primeiro and user_id % 7 <> 0 then 'create' when event_type = 'view' then 'note'"
        " when event_type = 'purchase' then 'attach' else 'status' end as kind",
        "cast(user_id as int) as id_atividade",
        "cast(user_id as string) as matricula",
        "concat('user-', cast(user_id % 9 as string)) as nome_usuario",
        "cast(case when user_id % 11 = 0 then -1 else user_id * 3 % 200 end as int)"
        " as id_atividade_padrao",
        "case cast(event_id % 6 as int) when 0 then 'Agendado' when 1 then 'Em Atuação'"
        " when 2 then 'Finalizado' when 3 then 'Improcedente' when 4 then 'Agendado'"
        " else 'Outro' end as status",
        "props as observacoes",
        "case when event_type = 'purchase' then"
        " concat('file-', cast(event_id as string), '.txt') end as nome_original",
    )


TABLES = {
    "ta": tickets,
    "vida": life,
    "grupos": groups,
    "usuarios": users,
    "proced": procedures,
    "equip": equipment,
    "status_ta": status_names,
    "atividade_padrao": catalogue,
    "atividade_suporte": activities,
    "historico": history,
    "arquivos": attachments,
    "comandos": commands,
}
SCHEMAS = {**schemas.TICKET_TABLES, **schemas.ACTIVITY_TABLES}


class StandInTables(Mapping[str, DataFrame]):
    """The tables by name; each is derived when a query first asks for it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._source = Source(spark, sf_dir)
        self._derived: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._derived:
            self._derived[name] = schemas.conform(TABLES[name](self._source), SCHEMAS[name])
        return self._derived[name]

    def __iter__(self) -> Iterator[str]:
        return iter(TABLES)

    def __len__(self) -> int:
        return len(TABLES)
