"""The activity log as stored tables: state, history and files behind one version.

A batch of commands is judged against the stored state, and one version makes all of its
results visible: the new state, one more folder of history rows and one of files. The version
keeps the position of the last command it has seen, so a batch that comes again, wholly
or in part, changes nothing."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.functions.calendar import ntz
from ticketlens.operators.commands import (
    apply_activity_commands,
    files_from_commands,
    history_from_commands,
    judge_commands,
)
from ticketlens.sources.sinks import full_refresh
from ticketlens.sources.versions import current, publish

STATE, HISTORY, FILES, UNTIL = "estado", "historico", "arquivos", "ate"


def begin(activities: DataFrame, folder: str) -> int:
    """Stores the given activities as the first version."""
    content = {STATE: full_refresh(activities, f"{folder}/{STATE}"), HISTORY: [], FILES: [], UNTIL: None}
    return publish(activities.sparkSession, folder, content, 0)


def _after(commands: DataFrame, until: list | None) -> DataFrame:
    """Commands behind the position of the last one seen. A missing time sorts first."""
    if until is None:
        return commands
    stamp, number = until
    same = F.col("cmd_id") > F.lit(number).cast("bigint")
    if stamp is None:
        return commands.where(F.col("ts").isNotNull() | same)
    seen = ntz(datetime.fromisoformat(stamp))
    return commands.where((F.col("ts") > seen) | ((F.col("ts") == seen) & same))


def apply_batch(folder: str, catalogue: DataFrame, commands: DataFrame) -> int:
    """Applies the commands that come after all seen so far and publishes the result; the
    number of the version. Without new commands the version stays. Commands come in
    order of time and id: one at or before the last position counts as seen.

    Two batches give what their commands give together. History and files are written
    once; the state, one row per activity, is written anew."""
    spark = commands.sparkSession
    number, stored = current(spark, folder)
    if not number:
        raise ValueError(f"{folder} holds no activities yet")
    fresh = _after(commands, stored[UNTIL])
    last = fresh.agg(F.max(F.struct("ts", "cmd_id")).alias("p")).select("p.ts", "p.cmd_id").first()
    if last["cmd_id"] is None:
        return number
    given = spark.read.parquet(stored[STATE])
    judged = judge_commands(given, catalogue, fresh)
    content = {
        STATE: full_refresh(apply_activity_commands(given, judged), f"{folder}/{STATE}"),
        HISTORY: [*stored[HISTORY], full_refresh(history_from_commands(judged), f"{folder}/{HISTORY}")],
        FILES: [*stored[FILES], full_refresh(files_from_commands(judged), f"{folder}/{FILES}")],
        UNTIL: [last["ts"].isoformat() if last["ts"] is not None else None, last["cmd_id"]],
    }
    return publish(spark, folder, content, number)


def read_log(spark: SparkSession, folder: str) -> dict[str, DataFrame | None]:
    """The tables of the newest version; history and files are null before the first batch."""
    _, stored = current(spark, folder)
    tables = {STATE: spark.read.parquet(stored[STATE])}
    for name in (HISTORY, FILES):
        tables[name] = spark.read.parquet(*stored[name]) if stored[name] else None
    return tables
