"""SQL for a second engine that gives the rows of the named queries."""

from __future__ import annotations

import re

from ticketlens.plans import catalog as c
from ticketlens.schemas import PROCEDURES, SNAPSHOT, STAY_COLUMNS, STAY_SECONDS, TRACKING


def _names(schema) -> list[str]:
    return [f.name for f in schema]


def _cols(names, prefix: str = "") -> str:
    return ", ".join(prefix + n for n in names)


def _ts(moment) -> str:
    return f"TIMESTAMP '{moment}'"


def _seconds(a: str, b: str) -> str:
    return f"CAST(round(date_diff('microsecond', {a}, {b}) / 1000000.0) AS BIGINT)"


def _hms(x: str, hour_width: int = 1) -> str:
    hours = f"CAST(abs({x}) // 3600 AS VARCHAR)"
    if hour_width == 2:
        hours = f"CASE WHEN abs({x}) // 3600 < 10 THEN '0' ELSE '' END || {hours}"
    return (
        f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END || {hours}"
        f" || ':' || lpad(CAST(abs({x}) % 3600 // 60 AS VARCHAR), 2, '0')"
        f" || ':' || lpad(CAST(abs({x}) % 60 AS VARCHAR), 2, '0'))"
    )


def _week(d: str) -> str:
    w0 = f"(isodow(date_trunc('year', {d})) - 1)"
    return f"CAST((dayofyear({d}) - 1 + {w0}) // 7 + CASE WHEN {w0} <= 3 THEN 1 ELSE 0 END AS INTEGER)"


def _passed(condition: str, name: str) -> str:
    routes = f"SELECT vda_ta FROM vida, grupos WHERE vda_grupo = grp_codigo AND {condition}"
    return f"if(r.tqa_codigo IN ({routes}), 'SIM', 'NÃO') AS {name}"


_FLAGS = (
    _passed("grp_codigo = 6611", "passou_pelo_acesso_ericson"),
    _passed("grp_codigo = 6612", "passou_pelo_acesso_huawei"),
    _passed("grp_pai = 1340", "passou_pelo_campo"),
    _passed("grp_codigo = 6563", "passou_pelo_coran"),
)


def _snapshot(status: str, window: str, eligible: str) -> str:
    return f"""
SELECT DISTINCT r.tqa_codigo AS origem, e.tqa_codigo AS elemento, r.tqa_raiz AS ta_raiz,
  s.sta_nome AS status, e.tqa_area_codigo AS site, e.tqa_estado_codigo AS uf,
  r.tqa_gerencia_codigo AS regional, r.tqa_data_criacao AS data_criacao,
  r.tqa_data_encerramento AS data_encerramento, r.tqa_tipo_bilhete AS tipo_bilhete,
  r.tqa_tipo_site AS tipo_site, r.tqa_alarme_tipo AS tipo_de_alarme, q.aeq_hostname AS hostname,
  q.aeq_fabricante AS fabricante, e.tqa_impacto_eqp AS impacto, o.grp_nome AS grupo_responsavel,
  {", ".join(_FLAGS)}
FROM ta r
LEFT JOIN ta e ON e.tqa_origem = r.tqa_codigo
LEFT JOIN equip q ON q.aeq_ta = e.tqa_codigo
LEFT JOIN status_ta s ON s.sta_codigo = r.tqa_status
LEFT JOIN grupos o ON o.grp_codigo = r.tqa_responsavelpor_grupo
WHERE r.tqa_origem IS NULL AND r.tqa_tipo_rede IN (701) AND r.tqa_status IN ({status})
  AND {window} AND r.tqa_codigo IN (SELECT origem FROM {eligible})"""


_ACTIVE_WINDOW = f"r.tqa_data_criacao >= {_ts(c.START)} AND r.tqa_data_criacao < {_ts(c.END)}"


def _closed_window(start, end) -> str:
    return (
        f"r.tqa_data_criacao >= {_ts(c.START)} AND r.tqa_data_encerramento > {_ts(start)}"
        f" AND r.tqa_data_encerramento <= {_ts(end)}"
    )


def _tracking(tickets: str) -> str:
    stay_names = [*_names(STAY_COLUMNS), *_names(STAY_SECONDS)]
    columns = {n: f"t.{n}" for n in _names(SNAPSHOT)}
    columns.update({n: f"s.{n}" for n in stay_names})
    columns["classificacao_atuacao"] = (
        "CASE WHEN s.contar_atuacao = 1 THEN 'SIM' WHEN s.contar_sem_atuacao = 1 THEN 'NAO'"
        " ELSE 'VAZIO' END AS classificacao_atuacao"
    )
    columns.update({n: f"p.{n}" for n in _names(PROCEDURES)})
    return (
        f"SELECT {', '.join(columns[n] for n in _names(TRACKING))} FROM {tickets} t"
        " LEFT JOIN stays s ON s.origem = t.origem"
        " LEFT JOIN procs p ON p.origem_PROCEDIMENTO = t.origem"
    )


_PROCEDURE_TEXT = _hms(_seconds("min(pca_data)", "max(pca_data)"))

# Building blocks, each may use those before it.
VIEWS: dict[str, str] = {
    "grupos": "SELECT * FROM (VALUES (6611,'GRP_ACCESS_A',900),(6612,'GRP_ACCESS_B',900),"
    "(6563,'GRP_CORE',900),(1341,'GRP_FIELD_1',1340)) AS t(grp_codigo, grp_nome, grp_pai)",
    "usuarios": "SELECT CAST(s_suppkey AS INTEGER) AS usr_codigo, s_name AS usr_nome FROM supplier",
    "status_ta": "SELECT * FROM (VALUES (10,'OPEN'),(20,'WORKING'),(70,'HELD'),(90,'CLOSED'))"
    " AS t(sta_codigo, sta_nome)",
    "ta": """
SELECT o_orderkey AS tqa_codigo, CAST(NULL AS BIGINT) AS tqa_origem, o_custkey AS tqa_raiz,
  CASE WHEN o_orderstatus = 'O' THEN 10 WHEN o_orderstatus = 'F' THEN 90
    WHEN o_orderkey % 2 = 0 THEN 20 ELSE 70 END AS tqa_status,
  CAST(NULL AS VARCHAR) AS tqa_area_codigo, CAST(NULL AS VARCHAR) AS tqa_estado_codigo,
  concat('REG_', CAST(o_custkey % 4 AS VARCHAR)) AS tqa_gerencia_codigo,
  o_orderdate AS tqa_data_criacao,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL '1' SECOND
    * CAST((o_orderkey % 40 + 1) * 86400 + (o_orderkey % 5) * 3600 AS INTEGER) END AS tqa_data_encerramento,
  o_orderpriority AS tqa_tipo_bilhete,
  CASE WHEN o_custkey % 2 = 0 THEN 'MACRO' ELSE 'SMALL' END AS tqa_tipo_site,
  CASE WHEN o_custkey % 3 = 0 THEN 'POWER' ELSE 'LINK' END AS tqa_alarme_tipo,
  CAST(NULL AS VARCHAR) AS tqa_impacto_eqp,
  CASE WHEN o_orderkey % 10 = 0 THEN 702 ELSE 701 END AS tqa_tipo_rede,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 6611 END AS tqa_responsavelpor_grupo
FROM orders
UNION ALL
SELECT 1000000000 + l_partkey * 1000000 + l_orderkey, l_orderkey, NULL, 10,
  concat('SITE_', CAST(l_suppkey AS VARCHAR)), concat('UF_', CAST(l_suppkey % 27 AS VARCHAR)),
  NULL, l_shipdate, NULL, NULL, NULL, NULL,
  CASE WHEN l_tax > 0.04 THEN 'HIGH' ELSE 'LOW' END, 701, NULL
FROM lineitem""",
    "equip": """
SELECT DISTINCT 1000000000 + l_partkey * 1000000 + l_orderkey AS aeq_ta,
  concat('host-', CAST(l_partkey AS VARCHAR)) AS aeq_hostname,
  CASE WHEN l_partkey % 4 = 0 THEN 'VENDOR_A' ELSE 'VENDOR_B' END AS aeq_fabricante
FROM lineitem WHERE l_partkey % 2 = 0""",
    "vida": """
SELECT l_orderkey AS vda_ta, l_partkey AS vda_seq,
  CASE CAST(l_suppkey % 5 AS INTEGER) WHEN 0 THEN 6611 WHEN 1 THEN 6612 WHEN 2 THEN 6563
    WHEN 3 THEN 1341 ELSE 9999 END AS vda_grupo,
  CASE WHEN l_returnflag = 'N' THEN NULL ELSE CAST(l_partkey % 3 AS INTEGER) END AS vda_usuario,
  l_shipdate + INTERVAL '1' SECOND * CAST(l_partkey % 86400 AS INTEGER) AS vda_data_initial,
  CASE WHEN l_linestatus = 'O' AND l_linenumber = 7 THEN NULL ELSE l_shipdate + INTERVAL '1' SECOND
    * CAST(l_partkey % 86400 + l_quantity * 977 AS INTEGER) END AS vda_data_final
FROM lineitem""",
    "proced": """
SELECT user_id * 10 + event_id % 3 AS pca_ta,
  CASE event_type WHEN 'error' THEN 6611 WHEN 'click' THEN 6612 ELSE 6563 END AS pca_grupo,
  CAST(user_id % 4 AS INTEGER) AS pca_usuario, ts AS pca_data
FROM events""",
    "atividade_padrao": """
SELECT CAST(p_partkey AS INTEGER) AS id, p_type AS categoria, p_name AS nome_atividade,
  p_size AS tempo_estimado_min, p_brand AS observacao, p_size % 4 <> 0 AS ativo
FROM part""",
    "historico": """
SELECT CAST(event_id AS INTEGER) AS id_historico, CAST(user_id AS INTEGER) AS id_atividade,
  CAST(user_id AS VARCHAR) AS matricula_responsavel, CAST(NULL AS VARCHAR) AS nome_usuario,
  CASE event_type WHEN 'signup' THEN 'CRIACAO' WHEN 'view' THEN 'OBSERVACAO_ATUALIZADA'
    WHEN 'purchase' THEN 'ARQUIVO_ANEXADO' ELSE 'STATUS_ATUALIZADO' END AS tipo_evento,
  props AS descricao_evento, ts AS data_evento
FROM events""",
    "atividade_suporte": """
SELECT CAST(o_orderkey AS INTEGER) AS id_atividade, CAST(o_custkey AS VARCHAR) AS matricula,
  c_name AS nome_usuario,
  CAST(CASE WHEN o_orderkey % 11 = 0 THEN -1 ELSE o_orderkey % 200 END AS INTEGER) AS id_atividade_padrao,
  CASE o_orderstatus WHEN 'F' THEN 'Finalizado' WHEN 'O' THEN 'Agendado' ELSE 'Em Atuação' END AS status,
  o_orderdate AS data_inicio,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL '1' SECOND
    * CAST(o_orderkey % 30000 AS INTEGER) END AS data_fim,
  CAST(o_custkey % 50 AS INTEGER) AS tempo_estimado_min,
  CASE WHEN o_orderstatus = 'F' THEN CAST((o_orderkey % 30000) // 60 AS INTEGER) END AS tempo_real_min,
  o_orderpriority AS observacoes
FROM orders JOIN customer ON c_custkey = o_custkey""",
    "arquivos": """
SELECT CAST(doc_id AS INTEGER) AS id_arquivo, CAST(doc_id % 400 AS INTEGER) AS id_atividade,
  concat(source, '-', CAST(doc_id AS VARCHAR), '.txt') AS nome_original,
  concat('f', CAST(doc_id AS VARCHAR), '.txt') AS nome_arquivo,
  concat('/files/f', CAST(doc_id AS VARCHAR), '.txt') AS caminho, lang AS content_type,
  n_chars AS tamanho_bytes,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' SECOND * CAST(doc_id AS INTEGER) AS data_upload
FROM documents""",
    "comandos": """
SELECT event_id AS cmd_id, ts,
  CASE WHEN rn = 1 AND user_id % 7 <> 0 THEN 'create' WHEN event_type = 'view' THEN 'note'
    WHEN event_type = 'purchase' THEN 'attach' ELSE 'status' END AS kind,
  CAST(user_id AS INTEGER) AS id_atividade, CAST(user_id AS VARCHAR) AS matricula,
  concat('user-', CAST(user_id % 9 AS VARCHAR)) AS nome_usuario,
  CAST(CASE WHEN user_id % 11 = 0 THEN -1 ELSE user_id * 3 % 200 END AS INTEGER) AS id_atividade_padrao,
  CASE CAST(event_id % 6 AS INTEGER) WHEN 0 THEN 'Agendado' WHEN 1 THEN 'Em Atuação'
    WHEN 2 THEN 'Finalizado' WHEN 3 THEN 'Improcedente' WHEN 4 THEN 'Agendado' ELSE 'Outro' END AS status,
  props AS observacoes,
  CASE WHEN event_type = 'purchase' THEN concat('file-', CAST(event_id AS VARCHAR), '.txt') END AS nome_original
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) e""",
    "eligible": """
SELECT vda_ta AS origem FROM vida GROUP BY vda_ta
HAVING bool_or(vda_grupo IN (6611, 6612))
  OR vda_ta IN (SELECT pca_ta FROM proced WHERE pca_grupo IN (6611, 6612))""",
    "eligible_life": """
SELECT DISTINCT vda_ta AS origem FROM vida
WHERE vda_grupo IN (6611, 6612) AND vda_grupo IN (SELECT grp_codigo FROM grupos)""",
    "base": f"""
SELECT vda_ta AS origem, vda_seq AS seq, grp_nome AS grupo_n2, usr_nome AS usuario_atuacao,
  vda_usuario AS usuario_cod, vda_data_initial AS data_entrada_n2, vda_data_final AS data_saida_n2,
  if(vda_usuario IS NULL, 'NAO', 'SIM') AS teve_atuacao, if(vda_data_final IS NULL, 'SIM', 'NAO') AS ainda_na_fila,
  {_seconds("vda_data_initial", f"ifnull(vda_data_final, {_ts(c.AS_OF)})")} AS total_segundos,
  if(vda_usuario IS NULL, 0, total_segundos) AS total_segundos_atuacao,
  row_number() OVER (PARTITION BY vda_ta ORDER BY vda_data_initial NULLS LAST, vda_seq NULLS LAST) AS pos
FROM vida LEFT JOIN grupos ON grp_codigo = vda_grupo LEFT JOIN usuarios ON usr_codigo = vda_usuario
WHERE vda_grupo IN (6611, 6612)""",
    # The stay before is the one at the position before, joined back.
    "started": """
SELECT a.*, b.usuario_cod AS usuario_anterior,
  CAST(a.usuario_cod IS NOT NULL AND a.usuario_cod IS DISTINCT FROM b.usuario_cod AS INTEGER) AS inicio_atuacao,
  CAST(a.usuario_cod IS NULL AS INTEGER) AS contar_sem_atuacao
FROM base a LEFT JOIN base b ON b.origem = a.origem AND b.pos = a.pos - 1""",
    "per_ticket": """
SELECT origem, CAST(sum(inicio_atuacao) AS BIGINT) AS quantidade, CAST(sum(total_segundos) AS BIGINT) AS total_n2,
  CAST(sum(total_segundos_atuacao) AS BIGINT) AS total_atuacao
FROM started GROUP BY origem""",
    "stays": f"""
SELECT b.origem, grupo_n2, usuario_atuacao, data_entrada_n2, data_saida_n2, teve_atuacao, ainda_na_fila,
  inicio_atuacao, inicio_atuacao AS contar_atuacao, contar_sem_atuacao,
  {_hms("total_segundos")} AS tempo_no_grupo, {_hms("total_segundos")} AS tma_n2,
  CASE WHEN teve_atuacao = 'SIM' THEN {_hms("total_atuacao")} END AS tempo_total_atuacao,
  CASE WHEN teve_atuacao = 'SIM' THEN quantidade END AS quantidade_atuacao,
  {_hms("total_n2")} AS tempo_total_n2, total_segundos AS tma_n2_seg,
  CASE WHEN teve_atuacao = 'SIM' THEN total_atuacao END AS tempo_total_atuacao_seg,
  total_n2 AS tempo_total_n2_seg
FROM started b JOIN per_ticket a ON a.origem = b.origem""",
    "procs": f"""
SELECT pca_ta AS origem_PROCEDIMENTO, g.grp_nome AS grupo_n2_PROCEDIMENTO,
  u.usr_nome AS usuario_atuacao_PROCEDIMENTO, min(pca_data) AS data_entrada_n2_PROCEDIMENTO,
  max(pca_data) AS data_saida_n2_PROCEDIMENTO, 'SIM' AS teve_atuacao_PROCEDIMENTO,
  CAST(NULL AS VARCHAR) AS ainda_na_fila_PROCEDIMENTO, 1 AS inicio_atuacao_PROCEDIMENTO,
  1 AS contar_atuacao_PROCEDIMENTO, 0 AS contar_sem_atuacao_PROCEDIMENTO,
  {_PROCEDURE_TEXT} AS tempo_no_grupo_PROCEDIMENTO, {_PROCEDURE_TEXT} AS tma_n2_PROCEDIMENTO,
  {_PROCEDURE_TEXT} AS tempo_total_atuacao_PROCEDIMENTO, 1 AS quantidade_atuacao_PROCEDIMENTO,
  {_PROCEDURE_TEXT} AS tempo_total_n2_PROCEDIMENTO, 'PROCEDIMENTO' AS origem_atuacao_PROCEDIMENTO
FROM proced LEFT JOIN grupos g ON g.grp_codigo = pca_grupo LEFT JOIN usuarios u ON u.usr_codigo = pca_usuario
WHERE pca_grupo IN (6611, 6612) GROUP BY pca_ta, g.grp_nome, u.usr_nome""",
    "snap_active": _snapshot("10, 20, 70", _ACTIVE_WINDOW, "eligible"),
    "snap_closed": _snapshot("90", _closed_window(c.START, c.END), "eligible"),
    "track_active": _tracking("snap_active"),
    "track_closed": _tracking("snap_closed"),
    "unified": "SELECT *, 'ATIVO' AS origem_tabela FROM track_active"
    " UNION ALL SELECT *, 'FECHADO' AS origem_tabela FROM track_closed",
}


def _blocks(sql: str) -> str:
    """The building blocks that `sql` uses, as a list of named subqueries."""
    used: list[str] = []
    texts = [sql]
    for name in reversed(VIEWS):
        if any(re.search(rf"\b{name}\b", text) for text in texts):
            used.insert(0, name)
            texts.append(VIEWS[name])
    return ",\n".join(f"{name} AS ({VIEWS[name]})" for name in used)


def _with(sql: str) -> str:
    return f"WITH {_blocks(sql)}\n{sql}"


def _windows(column: str, edges: str, closed: str) -> str:
    low, high = (">=", "<") if closed == "left" else (">", "<=")
    return f"""
SELECT w.window_start, w.window_end, count(t.{column}) AS linhas
FROM ({edges}) w LEFT JOIN ta t ON t.{column} {low} w.window_start AND t.{column} {high} w.window_end
GROUP BY w.window_start, w.window_end"""


def _steps(step: str) -> str:
    return (
        f"SELECT s AS window_start, least(s + INTERVAL {step}, {_ts(c.END)}) AS window_end"
        f" FROM generate_series({_ts(c.START)}, {_ts(c.END)} - INTERVAL 1 SECOND, INTERVAL {step}) g(s)"
    )


def _clock_months() -> str:
    first = c.HOURLY_START.replace(day=1)
    return (
        f"SELECT greatest(s, {_ts(c.HOURLY_START)}) AS window_start,"
        f" least(s + INTERVAL 1 MONTH, {_ts(c.HOURLY_END)}) AS window_end"
        f" FROM generate_series({_ts(first)}, {_ts(c.HOURLY_END)} - INTERVAL 1 SECOND, INTERVAL 1 MONTH) g(s)"
    )


def _download(condition: str) -> str:
    return f"SELECT DISTINCT {_cols(c.reports.DOWNLOAD_COLUMNS)} FROM unified WHERE {condition}"


_YEAR = f"year(data_entrada_n2) = {c.YEAR}"


def _page(source: str, keys, offset: int = (c.PAGE - 1) * c.PAGE_SIZE, condition: str = "TRUE") -> str:
    """Ordered by the keys, then by all columns: rows that still tie are equal."""
    rest = ", ".join(f"{n} ASC NULLS LAST" for n in _names(TRACKING))
    order = ", ".join(f"{k} ASC NULLS LAST" for k in keys)
    return f"SELECT * FROM {source} WHERE {condition} ORDER BY {order}, {rest} LIMIT {c.PAGE_SIZE} OFFSET {offset}"


_PERIODS = {
    "ANO_MES": ("lpad(CAST(month(data_entrada_n2) AS VARCHAR), 2, '0')", "''", "''"),
    "SEMANAL": ("''", f"CAST({_week('data_entrada_n2')} AS VARCHAR)", "''"),
    "DIARIO": ("''", "''", "CAST(CAST(data_entrada_n2 AS DATE) AS VARCHAR)"),
}


def _period_views(select: str, source: str, condition: str, hora: str = "") -> str:
    parts = []
    for view, (mes, semana, dia) in _PERIODS.items():
        recent = f"data_entrada_n2 >= DATE '{c.REPORT_DAY}' - INTERVAL 31 DAY" if view == "DIARIO" else "TRUE"
        parts.append(
            f"SELECT CAST(year(data_entrada_n2) AS INTEGER) AS ano, {mes} AS mes, {semana} AS semana,"
            f" {dia} AS dia, {hora} '{view}' AS visao, {select} FROM {source}"
            f" WHERE {condition} AND {recent} GROUP BY ALL"
        )
    return "\nUNION ALL\n".join(parts)


_DISTINCT_STAYS = (
    "count(DISTINCT (origem, data_entrada_n2)) FILTER (data_entrada_n2 IS NOT NULL) AS total"
)


def _mean(source: str, seconds: str) -> str:
    # Exact sums, four decimals, then whole seconds.
    views = _period_views(f"sum({seconds}) AS s, count(tma_n2_seg) AS n", source, "TRUE")
    whole = "CAST(((CAST(s AS HUGEINT) * 10000 * 2 + n) // (2 * n)) // 10000 AS BIGINT)"
    return (
        f"SELECT ano, mes, semana, dia, visao, {_hms('x', 2)} AS tma_medio, x AS tma_medio_seg"
        f" FROM (SELECT *, CASE WHEN n > 0 THEN {whole} END AS x FROM ({views}))"
    )


def _fresh(name: str, source: str) -> str:
    return (
        f"SELECT '{name}' AS tabela, count(*) AS linhas, max(data_entrada_n2) AS ultima_entrada,"
        " max(data_encerramento) AS ultimo_encerramento,"
        f" {_seconds('max(data_entrada_n2)', _ts(c.AS_OF))} AS atraso_seg,"
        f" strftime({_ts(c.AS_OF)}, '%d-%m-%Y %H:%M') AS data_update FROM {source}"
    )


def _counts(name: str, source: str, negative: str) -> str:
    return (
        f"SELECT '{name}' AS etapa, CAST(coalesce(sum(n), 0) AS BIGINT) AS linhas,"
        " count(origem) AS tickets, CAST(coalesce(max(n), 0) AS BIGINT) AS max_por_ticket,"
        " CAST(coalesce(sum(neg), 0) AS BIGINT) AS tempos_negativos"
        f" FROM (SELECT origem, count(*) AS n, {negative} AS neg FROM {source} GROUP BY origem)"
    )


_ACTIVITY = (
    "a.id_atividade, a.matricula, a.nome_usuario, a.id_atividade_padrao, p.nome_atividade, a.status,"
    " a.data_inicio, a.data_fim, a.tempo_estimado_min, a.tempo_real_min, a.observacoes"
)
_FILE = ", ".join(f"f.{n} AS arquivo_{n}" for n in c.activities.FILE_FIELDS)
_LINK = "'/arquivo/' || CAST({0}.id_arquivo AS VARCHAR)"
_LISTING = (
    " FROM atividade_suporte a JOIN atividade_padrao p ON p.id = a.id_atividade_padrao"
    " LEFT JOIN arquivos f ON f.id_atividade = a.id_atividade"
)


def _commands(tail: str) -> str:
    """Commands with the code and reason of their refusal, then `tail`."""
    return f"""
given AS (SELECT * FROM atividade_suporte),
valid_creates AS (
  SELECT c.* FROM comandos c JOIN atividade_padrao p ON p.id = c.id_atividade_padrao
  WHERE c.kind = 'create' AND c.status IN ('Agendado', 'Em Atuação', 'Improcedente')),
births AS (
  SELECT id_atividade, NULL AS born_ts, NULL AS born_id, matricula, nome_usuario, data_inicio, TRUE AS old FROM given
  UNION ALL
  SELECT id_atividade, ts, cmd_id, matricula, nome_usuario, ts, FALSE FROM valid_creates
  WHERE id_atividade NOT IN (SELECT id_atividade FROM given)
  QUALIFY row_number() OVER (PARTITION BY id_atividade ORDER BY ts, cmd_id) = 1),
judged AS (
  SELECT c.*, b.matricula AS dono, b.nome_usuario AS nome_dono, b.data_inicio AS inicio, p.tempo_estimado_min AS padrao,
    CASE
      WHEN c.kind = 'create' AND p.id IS NULL THEN 'Atividade padrão inválida.'
      WHEN c.kind = 'create' AND (c.status IS NULL OR c.status NOT IN ('Agendado', 'Em Atuação', 'Improcedente'))
        THEN 'Status inválido.'
      WHEN c.kind = 'create' AND (b.old OR b.born_id <> c.cmd_id) THEN 'Atividade já existe.'
      WHEN c.kind = 'create' THEN NULL
      WHEN b.id_atividade IS NULL THEN 'Atividade não encontrada.'
      WHEN NOT b.old AND (b.born_ts > c.ts OR (b.born_ts = c.ts AND b.born_id >= c.cmd_id))
        THEN 'Atividade não encontrada.'
      WHEN c.kind = 'status' AND (c.status IS NULL
        OR c.status NOT IN ('Agendado', 'Em Atuação', 'Finalizado', 'Improcedente')) THEN 'Status inválido.'
      WHEN c.kind = 'note' AND c.observacoes IS NULL THEN 'Observação ausente.'
      WHEN c.kind = 'attach' AND c.nome_original IS NULL THEN 'Nenhum arquivo enviado.'
      WHEN c.kind = 'attach' AND c.nome_original = '' THEN 'Nenhum arquivo válido enviado.'
    END AS motivo
  FROM comandos c LEFT JOIN births b ON b.id_atividade = c.id_atividade
  LEFT JOIN atividade_padrao p ON p.id = c.id_atividade_padrao AND c.kind = 'create'),
done AS (SELECT * FROM judged WHERE motivo IS NULL)
{tail}"""


def _log_query(tail: str) -> str:
    steps = _commands(tail)
    return f"WITH {_blocks(steps)},{steps}"


# The last setter of each field among the given row (first) and the commands.
_STATE = """,
steps AS (
  SELECT id_atividade, NULL AS ts, NULL AS cmd_id, 'given' AS kind, matricula, nome_usuario, id_atividade_padrao,
    status, data_inicio, data_fim, tempo_estimado_min, tempo_real_min, observacoes FROM given
  UNION ALL
  SELECT id_atividade, ts, cmd_id, kind, matricula, nome_usuario, id_atividade_padrao, status,
    CASE WHEN kind = 'create' THEN ts END, CASE WHEN kind = 'status' AND status = 'Finalizado' THEN ts END,
    padrao, NULL, observacoes FROM done),
folded AS (
  SELECT id_atividade,
    first(matricula ORDER BY ts NULLS FIRST, cmd_id) AS matricula,
    first(nome_usuario ORDER BY ts NULLS FIRST, cmd_id) AS nome_usuario,
    first(id_atividade_padrao ORDER BY ts NULLS FIRST, cmd_id) AS id_atividade_padrao,
    last(status ORDER BY ts NULLS FIRST, cmd_id) FILTER (kind IN ('given', 'create', 'status')) AS status,
    first(data_inicio ORDER BY ts NULLS FIRST, cmd_id) AS data_inicio,
    last(data_fim ORDER BY ts NULLS FIRST, cmd_id)
      FILTER (kind = 'given' OR (kind = 'status' AND status = 'Finalizado')) AS data_fim,
    first(tempo_estimado_min ORDER BY ts NULLS FIRST, cmd_id) AS tempo_estimado_min,
    first(tempo_real_min ORDER BY ts NULLS FIRST, cmd_id) AS minutos,
    bool_or(kind = 'status' AND status = 'Finalizado') AS terminou,
    last(observacoes ORDER BY ts NULLS FIRST, cmd_id) FILTER (kind IN ('given', 'create', 'note')) AS observacoes
  FROM steps GROUP BY id_atividade)
SELECT id_atividade, matricula, nome_usuario, id_atividade_padrao, status, data_inicio, data_fim, tempo_estimado_min,
  CASE WHEN terminou AND data_inicio IS NOT NULL
    THEN CAST(date_diff('microsecond', data_inicio, data_fim) // 60000000 AS INTEGER) ELSE minutos END AS tempo_real_min,
  observacoes
FROM folded"""

_HISTORY = """
SELECT cmd_id AS id_historico, id_atividade, dono AS matricula_responsavel, nome_dono AS nome_usuario,
  CASE kind WHEN 'create' THEN 'CRIACAO' WHEN 'status' THEN 'STATUS_ATUALIZADO'
    WHEN 'note' THEN 'OBSERVACAO_ATUALIZADA' ELSE 'ARQUIVO_ANEXADO' END AS tipo_evento,
  CASE kind WHEN 'create' THEN 'Atividade criada.' WHEN 'status' THEN concat('Status alterado para ', status, '.')
    WHEN 'note' THEN 'Observação atualizada.' ELSE concat('Arquivo anexado: ', nome_original) END AS descricao_evento,
  ts AS data_evento
FROM done"""

_REJECTS = """
SELECT cmd_id, ts, kind, id_atividade, CASE motivo WHEN 'Atividade não encontrada.' THEN 404
    WHEN 'Atividade já existe.' THEN 409 WHEN 'Observação ausente.' THEN 422 ELSE 400 END AS codigo, motivo
FROM judged WHERE motivo IS NOT NULL"""

_FILES = """
SELECT cmd_id AS id_arquivo, id_atividade, nome_original, '.' || string_split(nome_original, '.')[-1] AS extensao,
  CASE WHEN nome_original IS NOT NULL THEN 'text/plain' END AS content_type,
  octet_length(encode(observacoes)) AS tamanho_bytes, ts AS data_upload
FROM done WHERE kind = 'attach'"""

_SHARED = [
    n for n in _names(PROCEDURES) if n.removesuffix("_PROCEDIMENTO") in ("origem", *_names(STAY_COLUMNS))
]

_PLAIN: dict[str, str] = {
    "load_windows_daily": _windows("tqa_data_criacao", _steps("1 DAY"), "left"),
    "load_windows_weekly": _windows("tqa_data_encerramento", _steps("7 DAY"), "right"),
    "load_windows_monthly": _windows("tqa_data_criacao", _clock_months(), "left"),
    "eligible_tickets": "SELECT origem FROM eligible",
    "eligible_tickets_life_only": "SELECT origem FROM eligible_life",
    "route_flags": f"SELECT r.tqa_codigo AS origem, {', '.join(_FLAGS)}"
    " FROM (SELECT DISTINCT vda_ta AS tqa_codigo FROM vida) r",
    "ticket_snapshot_active": "SELECT * FROM snap_active",
    "ticket_snapshot_closed": "SELECT * FROM snap_closed",
    "ticket_snapshot_validation": _snapshot("10, 20, 70", _ACTIVE_WINDOW, "eligible_life"),
    "group_stays": "SELECT origem, seq, grupo_n2, usuario_atuacao, usuario_cod, data_entrada_n2, data_saida_n2,"
    " teve_atuacao, ainda_na_fila, total_segundos,"
    " CAST(total_segundos_atuacao AS BIGINT) AS total_segundos_atuacao FROM base",
    "stay_starts": "SELECT origem, seq, usuario_cod, usuario_anterior, inicio_atuacao,"
    " inicio_atuacao AS contar_atuacao, contar_sem_atuacao FROM started",
    "stay_totals": "SELECT * FROM stays",
    "stay_class": "SELECT origem, data_entrada_n2, CASE WHEN inicio_atuacao = 1 THEN 'SIM'"
    " WHEN contar_sem_atuacao = 1 THEN 'NAO' ELSE 'VAZIO' END AS classificacao_atuacao FROM started",
    "procedure_summary": "SELECT * FROM procs",
    "procedure_only": "SELECT * FROM procs WHERE origem_PROCEDIMENTO NOT IN (SELECT origem FROM base)",
    "stays_with_procedures": f"SELECT {_cols(n.removesuffix('_PROCEDIMENTO') for n in _SHARED)},"
    " 'VIDA' AS origem_atuacao FROM stays UNION ALL"
    f" SELECT {_cols(_SHARED)}, 'PROCEDIMENTO' FROM procs"
    " WHERE origem_PROCEDIMENTO NOT IN (SELECT origem FROM base)",
    "tracking_active": "SELECT * FROM track_active",
    "tracking_closed": "SELECT * FROM track_closed",
    "full_refresh_roundtrip": "SELECT *, CAST(year(data_entrada_n2) * 100 + month(data_entrada_n2) AS INTEGER)"
    " AS mes_entrada FROM track_closed",
    "closed_increment_rows": "SELECT * FROM track_closed WHERE data_encerramento > (SELECT max(data_encerramento)"
    f" FROM track_closed WHERE data_encerramento <= {_ts(c.FIRST_LOAD_END)})",
    "closed_increment_appended": "SELECT * FROM track_closed",
    "closed_days_synced": "SELECT * FROM track_closed",
    "refresh_current": "SELECT * FROM stays",
    "unified_tracking": "SELECT * FROM unified",
    "unified_download_year": _download(_YEAR),
    "unified_download_month": _download(f"{_YEAR} AND month(data_entrada_n2) = {c.MONTH}"),
    "unified_download_week": _download(f"{_YEAR} AND {_week('data_entrada_n2')} = {c.WEEK}"),
    "unified_download_day": _download(f"{_YEAR} AND day(data_entrada_n2) = {c.DAY}"),
    "unified_range": f"SELECT {_cols(c.reports.DOWNLOAD_COLUMNS)} FROM (SELECT DISTINCT * FROM unified)"
    f" WHERE data_entrada_n2 >= DATE '{c.RANGE[0]}' AND data_entrada_n2 < DATE '{c.RANGE[1]}' + INTERVAL 1 DAY",
    "tracking_page_active": _page("track_active", c.PAGE_KEYS),
    "tracking_page_closed": _page("track_closed", c.PAGE_KEYS),
    "tracking_page_unified": _page("unified", ("origem_tabela", *c.PAGE_KEYS)),
    "tracking_page_after": _page("track_active", c.PAGE_KEYS, 0, f"origem > {c.PAGE_AFTER['origem']}"),
    "page_summary": f"SELECT {c.PAGE} AS page, {c.PAGE_SIZE} AS page_size, count(*) AS total,"
    f" CAST(ceil(count(*) / {c.PAGE_SIZE}) AS INTEGER) AS total_pages FROM unified",
    "volumetry": _period_views(
        f"tipo_bilhete, classificacao_atuacao AS teve_atuacao, {_DISTINCT_STAYS}",
        "unified",
        "classificacao_atuacao <> 'VAZIO'",
        "'' AS hora,",
    ),
    "volumetry_by_user": _period_views(
        f"tipo_bilhete, usuario_atuacao, {_DISTINCT_STAYS}",
        "unified",
        "classificacao_atuacao <> 'VAZIO' AND usuario_atuacao IS NOT NULL",
        "'' AS hora,",
    ),
    "mean_handling_time": _mean("unified", "least(tma_n2_seg, 3020399)"),
    "mean_handling_time_dedupe": _mean(
        "(SELECT DISTINCT origem, data_entrada_n2, tma_n2_seg FROM unified)", "tma_n2_seg"
    ),
    "table_freshness": f"{_fresh('ATIVO', 'track_active')} UNION ALL {_fresh('FECHADO', 'track_closed')}",
    "duplicate_report": "SELECT origem, count(*) AS qtd FROM snap_active GROUP BY origem"
    " ORDER BY qtd DESC, origem LIMIT 20",
    "stays_per_ticket": "SELECT origem, count(*) AS qtd FROM base GROUP BY origem",
    "procedure_tags": "SELECT origem_atuacao_PROCEDIMENTO, count(*) AS qtd FROM track_active"
    " WHERE origem_atuacao_PROCEDIMENTO IS NOT NULL GROUP BY origem_atuacao_PROCEDIMENTO",
    "reconciliation": " UNION ALL ".join(
        (
            _counts("tickets", "snap_active", "0"),
            _counts("stays", "stays", "count(*) FILTER (tma_n2_seg < 0)"),
            _counts("final", "track_active", "count(*) FILTER (tma_n2_seg < 0)"),
        )
    ),
    "active_catalogue": "SELECT id AS id_atividade, nome_atividade, tempo_estimado_min, observacao"
    " FROM atividade_padrao WHERE ativo",
    "activity_list": f"SELECT {_ACTIVITY}, {_FILE}, {_LINK.format('f')} AS arquivo_url_download {_LISTING}",
    "activity_detail": f"SELECT {_ACTIVITY}, {_FILE} {_LISTING}"
    " WHERE a.id_atividade IN (SELECT id_atividade FROM historico)",
    "activity_history": "SELECT * FROM historico"
    " WHERE id_atividade IN (SELECT id_atividade FROM atividade_suporte)",
    "activity_files": f"SELECT r.*, {_LINK.format('r')} AS url_download FROM arquivos r"
    " WHERE id_atividade IN (SELECT id_atividade FROM atividade_suporte)",
}


def oracle_sql() -> dict[str, str]:
    plain = {name: _with(sql) for name, sql in _PLAIN.items()}
    log = {
        "activity_state": _log_query(_STATE),
        "stored_activity_state": _log_query(_STATE),
        "history_from_commands": _log_query(_HISTORY),
        "stored_activity_history": _log_query(_HISTORY),
        "files_from_commands": _log_query(_FILES),
        "stored_activity_files": _log_query(_FILES),
        "rejected_commands": _log_query(_REJECTS),
    }
    # Reports over stored states give the rows of the reports over the tables.
    rollup = {f"{name}_rollup": plain[name] for name in ("volumetry", "volumetry_by_user", "mean_handling_time")}
    paged = {
        "tracking_page_stored": plain["tracking_page_unified"],
        "page_summary_stored": plain["page_summary"],
        "table_freshness_stored": plain["table_freshness"],
    }
    return {**plain, **log, **rollup, **paged}
