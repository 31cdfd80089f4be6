"""The command fold against a replay of the rules, one command after another."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ticketlens.operators.commands import (
    apply_activity_commands,
    files_from_commands,
    history_from_commands,
    judge_commands,
    reject_commands,
)
from ticketlens.schemas import ATIVIDADE_PADRAO, ATIVIDADE_SUPORTE, COMANDOS

T0 = datetime(2025, 1, 1, 10)


def replay(given, catalogue, commands):
    state = {a["id_atividade"]: dict(a) for a in given}
    history, rejects = [], []
    for c in sorted(commands, key=lambda c: (c["ts"], c["cmd_id"])):
        key, kind = c["id_atividade"], c["kind"]
        code = text = None
        if kind == "create":
            if c["id_atividade_padrao"] not in catalogue:
                code = 400, "Atividade padrão inválida."
            elif c["status"] not in ("Agendado", "Em Atuação", "Improcedente"):
                code = 400, "Status inválido."
            elif key in state:
                code = 409, "Atividade já existe."
            else:
                state[key] = {
                    "id_atividade": key, "matricula": c["matricula"], "nome_usuario": c["nome_usuario"],
                    "id_atividade_padrao": c["id_atividade_padrao"], "status": c["status"],
                    "data_inicio": c["ts"], "data_fim": None,
                    "tempo_estimado_min": catalogue[c["id_atividade_padrao"]],
                    "tempo_real_min": None, "observacoes": c["observacoes"],
                }
                event, text = "CRIACAO", "Atividade criada."
        elif key not in state:
            code = 404, "Atividade não encontrada."
        elif kind == "status":
            if c["status"] not in ("Agendado", "Em Atuação", "Finalizado", "Improcedente"):
                code = 400, "Status inválido."
            else:
                state[key]["status"] = c["status"]
                if c["status"] == "Finalizado":
                    state[key]["data_fim"] = c["ts"]
                    if state[key]["data_inicio"]:
                        spent = c["ts"] - state[key]["data_inicio"]
                        state[key]["tempo_real_min"] = int(spent.total_seconds() / 60)
                event, text = "STATUS_ATUALIZADO", f"Status alterado para {c['status']}."
        elif kind == "note":
            state[key]["observacoes"] = c["observacoes"]
            event, text = "OBSERVACAO_ATUALIZADA", "Observação atualizada."
        else:
            event, text = "ARQUIVO_ANEXADO", f"Arquivo anexado: {c['nome_original']}"
        if code:
            rejects.append((c["cmd_id"], *code))
        else:
            owner = state[key]
            history.append((c["cmd_id"], owner["matricula"], owner["nome_usuario"], event, text, c["ts"]))
    return state, sorted(history), sorted(rejects)


def fold(given, catalogue, commands):
    judged = judge_commands(given, catalogue, commands)
    folded = apply_activity_commands(given, judged)
    state = {r["id_atividade"]: r.asDict() for r in folded.collect()}
    history = history_from_commands(judged).select(
        "id_historico", "matricula_responsavel", "nome_usuario", "tipo_evento", "descricao_evento", "data_evento"
    )
    rejects = reject_commands(judged).select("cmd_id", "codigo", "motivo")
    return state, sorted(map(tuple, history.collect())), sorted(map(tuple, rejects.collect()))


@pytest.mark.parametrize("existing", ["none", "some", "all"])
def test_fold_equals_replay(tables, existing):
    condition = {"none": "false", "some": "id_atividade % 3 = 0", "all": "true"}[existing]
    given = tables["atividade_suporte"].where(condition)
    catalogue, commands = tables["atividade_padrao"], tables["comandos"]
    expected = replay(
        [r.asDict() for r in given.collect()],
        {r["id"]: r["tempo_estimado_min"] for r in catalogue.collect()},
        [r.asDict() for r in commands.collect()],
    )
    assert fold(given, catalogue, commands) == expected


def command(number, kind, minutes, key=1, status=None, note=None, file=None, entry=5, user="m"):
    return (number, T0 + timedelta(minutes=minutes), kind, key, user, "n" + user, entry, status, note, file)


@pytest.fixture(scope="module")
def run(spark):
    catalogue = spark.createDataFrame([(5, "c", "a", 30, "o", False)], ATIVIDADE_PADRAO)
    nothing = spark.createDataFrame([], ATIVIDADE_SUPORTE)

    def go(*rows):
        return fold(nothing, catalogue, spark.createDataFrame(list(rows), COMANDOS))

    return go


def test_finish_twice_and_reopen(run):
    state, history, rejects = run(
        command(1, "create", 0, status="Agendado"),
        command(2, "status", 1.99, status="Finalizado", user="other"),
        command(3, "status", 60, status="Finalizado"),
        command(4, "status", 90, status="Agendado"),
    )
    one = state[1]
    assert (one["status"], one["data_fim"]) == ("Agendado", T0 + timedelta(hours=1))
    assert (one["tempo_real_min"], one["tempo_estimado_min"]) == (60, 30)
    assert [h[1] for h in history] == ["m"] * 4 and not rejects


def test_minutes_are_cut(run):
    state, _, _ = run(
        command(1, "create", 0, status="Em Atuação"), command(2, "status", 1.999, status="Finalizado")
    )
    assert state[1]["tempo_real_min"] == 1


def test_check_order_and_reasons(run):
    _, _, rejects = run(
        command(1, "status", 0, status="Outro"),
        command(2, "create", 1, status="Finalizado", entry=6),
        command(3, "create", 2, status="Finalizado"),
        command(4, "create", 3, status=None),
        command(5, "create", 4, status="Agendado"),
        command(6, "create", 5, status="Agendado"),
        command(7, "status", 6, status="Outro"),
        command(8, "note", 7),
        command(9, "attach", 8),
        command(10, "attach", 9, file=""),
        command(11, "rename", 10),
        command(12, "note", 11, key=2, note="x"),
    )
    assert [(n, code) for n, code, _ in rejects] == [
        (1, 404), (2, 400), (3, 400), (4, 400), (6, 409), (7, 400), (8, 422), (9, 400), (10, 400),
        (11, 422), (12, 404),
    ]
    assert rejects[1][2] == "Atividade padrão inválida." and rejects[2][2] == "Status inválido."
    assert rejects[7][2] == "Nenhum arquivo enviado."
    assert rejects[8][2] == "Nenhum arquivo válido enviado."


def test_same_instant_is_ordered_by_command(run):
    state, history, rejects = run(
        command(2, "create", 0, status="Agendado"),
        command(1, "note", 0, note="early"),
        command(3, "note", 0, note="late"),
    )
    assert state[1]["observacoes"] == "late"
    assert [h[0] for h in history] == [2, 3] and [r[0] for r in rejects] == [1]


@pytest.mark.parametrize(
    "name, extension",
    [("a.txt", ".txt"), ("a.tar.gz", ".gz"), ("README", ""), (".bashrc", ""), ("a.", "."), ("d.e/f", "")],
)
def test_file_extension(spark, name, extension):
    rows = [command(1, "create", 0, status="Agendado"), command(2, "attach", 1, file=name)]
    catalogue = spark.createDataFrame([(5, "c", "a", 30, "o", True)], ATIVIDADE_PADRAO)
    cmds = spark.createDataFrame(rows, COMANDOS)
    nothing = spark.createDataFrame([], ATIVIDADE_SUPORTE)
    plain = files_from_commands(judge_commands(nothing, catalogue, cmds)).first()
    assert (plain["extensao"], plain["tamanho_bytes"]) == (extension, None)
    sized = cmds.withColumn("conteudo", F.encode(F.lit("né"), "UTF-8"))
    assert files_from_commands(judge_commands(nothing, catalogue, sized)).first()["tamanho_bytes"] == 3
