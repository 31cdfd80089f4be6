"""Versions of stored tables: a numbered list that readers resolve to the current one.

Data is written to folders of its own first. A version is then published by one rename of a
small file to the next number, which fails where another writer has taken the number. So a
writer that dies leaves the version before, readers see all of a version or nothing of
it, and of two writers that started from one version only the first succeeds."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

# The folder of the version files in a table's folder; readers of data skip it by its name.
VERSIONS = "_versions"


class VersionTaken(RuntimeError):
    """Another writer has published since the version was read."""


def _file_system(spark: SparkSession, path: str):
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf), target.getFileSystem(conf), jvm


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    _, files, jvm = _file_system(spark, folder)
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{VERSIONS}")
    if not files.exists(path):
        return []
    names = [status.getPath().getName() for status in files.listStatus(path)]
    return sorted(int(name) for name in names if name.isdigit())


def current(spark: SparkSession, folder: str) -> tuple[int, dict[str, Any]]:
    """Number and content of the newest version; (0, {}) where there is none."""
    folder = folder.rstrip("/")
    numbers = _numbers(spark, folder)
    if not numbers:
        return 0, {}
    lines = spark.read.text(f"{folder}/{VERSIONS}/{numbers[-1]:012d}", wholetext=True).collect()
    return numbers[-1], json.loads(lines[0]["value"])


def publish(spark: SparkSession, folder: str, content: Mapping[str, Any], after: int) -> int:
    """Makes `content` (a small mapping of names to paths and marks) the version after
    number `after`, or raises VersionTaken."""
    folder = folder.rstrip("/")
    context, files, jvm = _file_system(spark, folder)
    at = jvm.org.apache.hadoop.fs.Path
    files.mkdirs(at(f"{folder}/{VERSIONS}"))
    draft = at(f"{folder}/{VERSIONS}/_{uuid.uuid4().hex}")
    stream = files.create(draft, False)
    stream.write(bytearray(json.dumps(dict(content)).encode()))
    stream.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    keep = spark._sc._gateway.new_array(rename, 1)
    keep[0] = rename.NONE  # never onto a file that is there
    try:
        context.rename(draft, at(f"{folder}/{VERSIONS}/{after + 1:012d}"), keep)
    except Py4JJavaError as error:
        files.delete(draft, False)
        if after + 1 in _numbers(spark, folder):
            raise VersionTaken(f"version {after + 1} of {folder} is already there") from error
        raise
    return after + 1


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the caller's own that no version names."""
    _, files, jvm = _file_system(spark, path)
    files.delete(jvm.org.apache.hadoop.fs.Path(path), True)


def refresh(df: DataFrame, folder: str, partition_by: tuple[str, ...] = ()) -> str:
    """Replaces the table in `folder`: writes it beside its former versions, then publishes
    it. `read_current` finds the new rows afterwards; a write that fails changes nothing."""
    from ticketlens.sources.sinks import full_refresh

    spark = df.sparkSession
    number, _ = current(spark, folder)
    path = full_refresh(df, folder, partition_by)
    publish(spark, folder, {"tabela": path}, number)
    return path


def read_current(spark: SparkSession, folder: str) -> DataFrame:
    """The newest published rows of a table written by `refresh`."""
    number, content = current(spark, folder)
    if not number:
        raise ValueError(f"nothing has been published in {folder}")
    return spark.read.parquet(content["tabela"])
