"""Tables kept as factors: a row holds lists whose elements, combined, are its rows.

A tracking table repeats a ticket for each line, stay and procedure row. Packed, it has one
row per ticket with a list of each, a small part of the bytes: rows that have to travel (to
be sorted, or dealt by a column) travel packed and are opened behind the shuffle."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marks rows that are one of many of a heavy key: their lists have one element each.
PIECE = "parte"


def listed(df: DataFrame, key: str, name: str) -> DataFrame:
    """One row per key with the list of its rows."""
    row = F.struct(*[column for column in df.columns if column != key])
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.collect_list(row).alias(name))


def pieces(df: DataFrame, factors: dict[str, Sequence[str]]) -> DataFrame:
    """Rows as lists of one element."""
    own = [c for c in df.columns if not any(c in columns for columns in factors.values())]
    lists = [F.array(F.struct(*columns)).alias(name) for name, columns in factors.items()]
    return df.select(*own, *lists, F.lit(True).alias(PIECE))


@dataclass(frozen=True)
class Packed:
    """`frame` has the columns of a key, PIECE, and `factors`, columns of lists. `finish` makes
    the table's columns of the opened rows and keeps those it is told to."""

    frame: DataFrame
    factors: tuple[str, ...]
    finish: Callable[[DataFrame, Sequence[str]], DataFrame]
    extra: tuple[str, ...] = ()

    def rows(self, *keep: str) -> DataFrame:
        """The table itself."""
        opened = self.frame
        for name in self.factors:
            opened = opened.withColumn(name, F.explode_outer(name))
        own = [c for c in self.frame.columns if c not in self.factors and c != PIECE]
        opened = opened.select(*own, *[f"{name}.*" for name in self.factors])
        return self.finish(opened, (*self.extra, *keep))

    def over(self, frame: DataFrame) -> Packed:
        return replace(self, frame=frame)

    def _factor(self, column: str) -> str | None:
        fields = {name: self.frame.schema[name].dataType.elementType.names for name in self.factors}
        return next((name for name, names in fields.items() if column in names), None)

    def value(self, column: str) -> Column:
        """A column of a row whose list of it has one element."""
        factor = self._factor(column)
        return F.col(column) if factor is None else F.col(factor)[0][column]

    def cut(self, keys: Sequence[str]) -> list[tuple[str, Column]]:
        """What tells packed rows apart in the order of `keys`, as far as they can be cut: a
        key whose rows are in one list is not, the pieces of a heavy one are."""
        found = []
        for key in keys:
            if key in self.frame.columns:
                found.append((key, F.col(key)))
            elif self._factor(key):
                found.append((key, F.when(F.col(PIECE), self.value(key))))
            else:
                break
        return found

    def opened(self, column: str) -> Packed:
        """The list that has `column` opened: each of its elements in a row of its own."""
        name = self._factor(column)
        if name is None:
            return self
        single = self.frame.withColumn(name, F.explode_outer(name))
        return self.over(single.withColumn(name, F.array(name)))

    def with_column(self, name: str, value: Column) -> Packed:
        """One more column, at the end of the table's."""
        return replace(self, frame=self.frame.withColumn(name, value), extra=(*self.extra, name))
