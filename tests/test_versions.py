"""Published versions, the stored activity log and closed tickets by day."""

from __future__ import annotations

from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ticketlens.operators import command_store as store
from ticketlens.operators.commands import (
    apply_activity_commands,
    files_from_commands,
    history_from_commands,
    judge_commands,
)
from ticketlens.plans import catalog, tracking
from ticketlens.schemas import TICKET_TABLES
from ticketlens.sources.versions import VersionTaken, current, publish, read_current, refresh
from ticketlens.streaming.closure_days import DAY, day_fingerprints, read_synced, sync_closed


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_readers_find_the_newest_version(spark, tmp_path, scheme):
    folder = f"{scheme}{tmp_path}/table"
    with pytest.raises(ValueError, match="nothing"):
        read_current(spark, folder)
    refresh(spark.range(10), folder)
    old = read_current(spark, folder)
    refresh(spark.range(3).withColumn("p", F.col("id") % 2), folder, ("p",))
    assert (old.count(), read_current(spark, folder).count()) == (10, 3)
    assert current(spark, folder)[0] == 2


def test_a_failed_write_leaves_the_version_before(spark, tmp_path):
    folder = str(tmp_path / "table")
    refresh(spark.range(5), folder)
    broken = spark.range(0, 1000, 1, 4).withColumn("x", F.when(F.col("id") == 999, F.raise_error(F.lit("dies"))))
    with pytest.raises(Exception, match="dies"):
        refresh(broken, folder)
    assert read_current(spark, folder).count() == 5 and current(spark, folder)[0] == 1


def test_one_of_two_writers_succeeds(spark, tmp_path):
    folder = str(tmp_path / "table")
    publish(spark, folder, {"a": 1}, 0)
    publish(spark, folder, {"a": 2}, 1)
    with pytest.raises(VersionTaken):
        publish(spark, folder, {"a": 3}, 1)
    assert current(spark, folder) == (2, {"a": 2})
    assert publish(spark, folder, {"a": 4}, 2) == 3


def test_batches_give_what_their_commands_give_together(spark, tables, tmp_path, rows_of):
    catalogue = tables["atividade_padrao"]
    given = tables["atividade_suporte"].where("id_atividade % 2 = 0")
    cmds = tables["comandos"].where("id_atividade % 5 < 2")
    # Equal times, to be told apart by the command's id, and a missing one.
    cmds = cmds.withColumn("ts", F.when(F.col("cmd_id") % 50 > 0, F.col("ts").cast("date").cast("timestamp_ntz")))
    folder = str(tmp_path / "log")
    store.begin(given, folder)
    empty = cmds.where("false")
    assert store.apply_batch(folder, catalogue, empty) == 1
    cuts = [F.col("ts").isNull(), F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz"), F.lit(True)]
    versions = []
    for cut in cuts:
        batch = cmds.where(cut | F.col("ts").isNull())
        versions += [store.apply_batch(folder, catalogue, batch), store.apply_batch(folder, catalogue, batch)]
    assert versions == [2, 2, 3, 3, 4, 4]
    judged = judge_commands(given, catalogue, cmds)
    log = store.read_log(spark, folder)
    assert rows_of(log[store.STATE]) == rows_of(apply_activity_commands(given, judged))
    assert rows_of(log[store.HISTORY]) == rows_of(history_from_commands(judged))
    assert rows_of(log[store.FILES]) == rows_of(files_from_commands(judged))


def test_days_that_changed_are_loaded_again(spark, tables, tmp_path, rows_of):
    few = {name: tables[name] for name in TICKET_TABLES}
    few["ta"] = tables["ta"].where("coalesce(tqa_origem, tqa_codigo) < 300")
    folder = str(tmp_path / "closed")
    args = catalog.AS_OF, catalog.END, catalog.START

    def synced(source):
        return sync_closed(folder, source, *args)

    def expected(source):
        return rows_of(tracking.tracking_closed(source, catalog.AS_OF, catalog.START, catalog.END, catalog.START))

    closed = tracking.closed_roots(few["ta"], catalog.START, catalog.END, catalog.START)
    days = [r[DAY] for r in day_fingerprints(few, closed).orderBy(DAY).select(DAY).collect()]
    assert len(days) > 20
    late = few | {"ta": few["ta"].where("tqa_codigo % 7 > 0")}
    assert synced(late) == 1 and synced(late) == 1
    assert rows_of(read_synced(spark, folder)) == expected(late)
    assert synced(few) == 2
    assert rows_of(read_synced(spark, folder)) == expected(few)
    # Tickets that vanish, and a changed life row: both are days to be loaded again.
    shorter = few | {
        "ta": few["ta"].where("tqa_codigo % 5 > 0"),
        "vida": few["vida"].withColumn("vda_usuario", F.when(F.col("vda_seq") % 9 > 0, F.col("vda_usuario"))),
    }
    assert synced(shorter) == 3
    assert rows_of(read_synced(spark, folder)) == expected(shorter)
    assert datetime.combine(days[0], datetime.min.time()) >= catalog.START


def test_shuffles_of_a_sync_go_with_their_jobs(spark, tables, tmp_path):
    """Whenever the driver collects garbage: else the prints and loads of all runs add up on disk."""
    local = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    few = {name: tables[name] for name in TICKET_TABLES}
    few["ta"] = few["ta"].where("coalesce(tqa_origem, tqa_codigo) % 29 = 0")
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting, before = spark.conf.get(key), {f.name for f in local.rglob("shuffle_*.data")}
    folder = str(tmp_path / "days")
    assert sync_closed(folder, few, catalog.AS_OF, catalog.END, catalog.START) == 1
    left = [f.stat().st_size for f in local.rglob("shuffle_*.data") if f.name not in before]
    # At most the few distinct names of loads, which are collected and not written.
    assert sum(left) < 4096 and spark.conf.get(key) == setting
    assert read_synced(spark, folder).count() > 100
