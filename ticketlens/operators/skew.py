"""Joins that split the rows of one key over tasks, by the same plan at every size.

A key with more than ROWS_PER_CHUNK rows is heavy. Both sides of a join carry the number of
rows of heavy keys, from one small table that is sent to every task, so no row travels to be
told that its key is light. A heavy key has several chunks, any other one: such a key is
never copied. No key is looked for ahead of the plan and none is left out.

`split` parts light rows from heavy ones by that table. Several joins in a row on one key
are plain joins for the light part: each side travels once, by the key, and what they make
does not travel at all. Only the heavy part goes by chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of one key that a task is meant to hold.
ROWS_PER_CHUNK = 100_000
# Most rows of a table of heavy keys: a few megabytes. With more heavy keys than that the
# largest are split, and any other holds less than a hundred-thousandth of all rows.
MOST_HEAVY = 100_000


def chunks(rows: str | Column) -> Column:
    """Chunks of a key with so many rows; a missing count is one chunk."""
    value = F.col(rows) if isinstance(rows, str) else rows
    return F.greatest(F.ceil(F.coalesce(value, F.lit(1)) / ROWS_PER_CHUNK), F.lit(1)).cast("int")


def counts_of(df: DataFrame, key: str, name: str) -> DataFrame:
    """Rows by key, with map-side partial counts."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(name))


def heavy(counts: DataFrame, keys: Sequence[str], *sizes: str | Column) -> DataFrame:
    """Of a table with one row per key, the rows where one of `sizes` is above a chunk: a
    broadcast table of bounded size, the same wherever it is used."""
    values = [F.col(s) if isinstance(s, str) else s for s in sizes]
    size = F.greatest(*values) if len(values) > 1 else values[0]
    largest = counts.withColumn("tamanho", size).where(F.col("tamanho") > ROWS_PER_CHUNK)
    return F.broadcast(largest.orderBy(F.desc("tamanho"), *keys).limit(MOST_HEAVY).drop("tamanho"))


def distinct_sorted(df: DataFrame, *keys: str) -> DataFrame:
    """Distinct rows, in the order of `keys`: each is held against the one before it among the
    rows of its keys, so a task sorts its rows once and needs no table of them. For keys that
    are not heavy."""
    others = [name for name in df.columns if name not in keys]
    within = Window.partitionBy(*keys).orderBy(*others)
    again = F.row_number().over(within) > 1
    for name in others:
        again = again & F.col(name).eqNullSafe(F.lag(name).over(within))
    return df.withColumn("_repetida", again).where(~F.col("_repetida")).drop("_repetida")


def split(df: DataFrame, sizes: DataFrame, key: str = "origem") -> tuple[DataFrame, DataFrame]:
    """Rows of light keys, and rows of heavy ones with the columns of `sizes`, a table of
    `heavy` keys.

    `sizes` has no null key. Keys are compared null-safe all the same: by plain equality the
    heavy part would get a null filter below the shuffles of `df`, which are then not those
    of the light part, so that all of `df` would travel once more."""
    known = df.join(sizes.withColumnRenamed(key, "_pesada"), F.col(key).eqNullSafe(F.col("_pesada")), "left")
    known = known.drop("_pesada")
    size = F.coalesce(*[F.col(name) for name in sizes.columns if name != key])
    return known.where(size.isNull()).select(*df.columns), known.where(size.isNotNull())


def only_heavy(df: DataFrame, key: str, sizes: DataFrame) -> DataFrame:
    """Rows whose `key` is one of the heavy tickets of `sizes`, with its columns, found where they
    are read: light rows do not travel, and where no ticket is heavy nothing is read."""
    tickets = sizes.withColumnRenamed("origem", "_pesada")
    return df.join(tickets, F.col(key) == F.col("_pesada")).drop("_pesada")


def _own(df: DataFrame, number: Column) -> Column:
    """The chunk of a row, from a hash of its values: a rerun task agrees."""
    return F.pmod(F.xxhash64(*[F.col(name) for name in df.columns]), number).cast("int")


def _every(number: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), number - 1))


def chunked_join(
    left: DataFrame,
    right: DataFrame,
    on: str,
    left_rows: Column | None = None,
    right_rows: str | None = None,
) -> DataFrame:
    """Left join on `on`, whose keys may hold much of either side.

    A row of a side takes one of its key's chunks on that side and all chunks of the
    other, so each pair meets once. `left_rows` (an estimate of the key's left rows) is
    computed alike from columns of both sides; `right_rows` names a column of both sides
    with the count of the key's right rows. Both come from a table of `heavy` keys and are
    null for light ones.
    The columns of the right side that both have are dropped."""
    one = F.lit(1)
    spread_left = left.withColumn("ce", _own(left, chunks(left_rows)) if left_rows is not None else F.lit(0))
    spread_left = spread_left.withColumn("cd", _every(chunks(right_rows) if right_rows else one))
    spread_right = right.withColumn("cd", _own(right, chunks(right_rows)) if right_rows else F.lit(0))
    spread_right = spread_right.withColumn("ce", _every(chunks(left_rows) if left_rows is not None else one))
    shared = [c for c in right.columns if c in left.columns and c != on]
    joined = spread_left.join(
        spread_right.drop(*shared).withColumn("par", F.lit(True)), [on, "ce", "cd"], "left"
    )
    if right_rows:
        # Of a left row sent to every chunk only the pairs count.
        joined = joined.where((chunks(right_rows) == 1) | F.col("par"))
    return joined.drop("ce", "cd", "par")
