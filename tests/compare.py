"""Comparing a query with its SQL, as multisets of rows."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

KINDS = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "timestamp_ntz": "TIMESTAMP",
    "boolean": "BOOLEAN",
    "date": "DATE",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def _multiset(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(row[i] for i in order) for row in rows)


def differences(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty when names, types and rows agree, else what differs."""
    relation = con.sql(sql)
    theirs = dict(zip(relation.columns, map(str, relation.types)))
    ours = {name: KINDS.get(kind, kind) for name, kind in df.dtypes}
    if ours != theirs:
        only = {n: (ours.get(n), theirs.get(n)) for n in {*ours, *theirs} if ours.get(n) != theirs.get(n)}
        return f"columns (spark, sql): {only}"
    mine = _multiset(df.columns, df.collect())
    other = _multiset(relation.columns, relation.fetchall())
    if mine == other:
        return ""
    extra, missing = mine - other, other - mine
    return (
        f"rows {mine.total()} / {other.total()}, only spark {extra.total()} e.g. {list(extra)[:2]},"
        f" only sql {missing.total()} e.g. {list(missing)[:2]}"
    )
