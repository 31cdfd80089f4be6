"""Approximate nearest neighbours by cross-polytope hashing.

In each table a vector of unit length is turned by a pseudo-rotation (three rounds of sign
flips and a fast Hadamard transform) and falls to the nearest signed axis. A query probes
the axes nearest to it. What shares a bucket is a candidate and is ranked by the exact
inner product of the original vectors; only a query's best of many buckets leave a task.
Buckets above a bound are cut into chunks of vectors and chunks of queries, and each chunk
of the ones meets each of the others. Of equal vectors only the k + 1 smallest ids are
indexed: the others have the same score and lose every tie."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ticketlens.llm.common import stored, whole_groups

#: Vectors, and queries, of a chunk of a bucket; rows of a batch of whole chunks.
CHUNK, BATCH = 4096, 40_000
#: Rows found that a task brings together before they leave it.
HELD = 500_000
#: Products held at a time: of a slab of queries with a chunk, and of pairs scored exactly.
SLAB_CELLS, SCORED_CELLS = 1_000_000, 4_000_000
#: Into how many parts, in turn, the ids of equal vectors are dealt to find the smallest.
SALTS = (64, 8, 1)
_KEYS = ["dim", "place", "chunk", "part"]


def usable(vector: Column) -> Column:
    """Not null, not zero, and all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def hadamard(rows: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of each row; the length is a power of two."""
    count, size = rows.shape
    step = 1
    while step < size:
        pairs = rows.reshape(count, size // (2 * step), 2, step)
        rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(count, size)
        step *= 2
    return rows


def rotated(vectors: np.ndarray, table: int, seed: int) -> np.ndarray:
    """The pseudo-rotation of a table, of unit vectors padded to a power of two."""
    size = 1 << max(vectors.shape[1] - 1, 0).bit_length()
    # By the largest component first: squares of huge or tiny ones leave the range.
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    out = np.pad(vectors / np.linalg.norm(vectors, axis=1, keepdims=True), ((0, 0), (0, size - vectors.shape[1])))
    random = np.random.default_rng((seed, table, size))
    for _ in range(3):
        out = hadamard(out * random.choice([-1.0, 1.0], size)) / np.sqrt(size)
    return out


def nearest_axes(turned: np.ndarray, probes: int) -> np.ndarray:
    """The `probes` nearest signed axes of each row, nearest first."""
    signed = np.concatenate([turned, -turned], axis=1)
    return np.argsort(-signed, axis=1, kind="stable")[:, :probes]


def _axes(batches: Iterable[pd.DataFrame], tables: int, probes: int, seed: int) -> Iterator[tuple]:
    """(dim, ids, matrix, place): place has a row for each vector and numbers a table's axes."""
    for batch in batches:
        lengths = batch["vector"].map(len)
        for dim, same in batch.groupby(lengths):
            matrix = np.array(same["vector"].tolist(), dtype=np.float64)
            for number in range(tables):
                axes = nearest_axes(rotated(matrix, number, seed), probes)
                yield np.int32(dim), same["id"].to_numpy(), matrix, number * (1 << 20) + axes


def _hashed(vectors: DataFrame, tables: int, probes: int, seed: int) -> DataFrame:
    """From (id, vector) to (dim, place, id, raw): a row for each table and probe; place
    numbers a table's axis, raw holds the vector as doubles."""

    def of(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for dim, ids, matrix, place in _axes(batches, tables, probes, seed):
            raw = np.array([row.tobytes() for row in matrix], dtype=object)
            each = place.shape[1]
            yield pd.DataFrame({"dim": dim, "place": place.ravel(), "id": np.repeat(ids, each), "raw": np.repeat(raw, each)})

    return vectors.mapInPandas(of, "dim int, place long, id long, raw binary")


def _rows_by_place(vectors: DataFrame, tables: int, probes: int, seed: int) -> DataFrame:
    """How many rows _hashed() has for each dim and place, without making them."""

    def of(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for dim, _, _, place in _axes(batches, tables, probes, seed):
            places, rows = np.unique(place, return_counts=True)
            yield pd.DataFrame({"dim": dim, "place": places, "rows": rows})

    counts = vectors.mapInPandas(of, "dim int, place long, rows long")
    return counts.groupBy("dim", "place").agg(F.sum("rows").alias("count"))


def _smallest_of_equal(vectors: DataFrame, least: int) -> DataFrame:
    """(id, vector) with only the `least` smallest ids of equal vectors. Only vectors that
    more rows share are looked at, and their ids are dealt out, so that no task sees all."""
    key = F.xxhash64("vector").alias("_key")
    common = vectors.groupBy(key).count().where(F.col("count") > least).select("_key")
    keyed = vectors.withColumn("_key", F.xxhash64("vector"))
    shared = keyed.join(common, "_key")
    for salts in SALTS:
        order = Window.partitionBy("vector", F.pmod(F.xxhash64("id"), F.lit(salts))).orderBy("id")
        shared = shared.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= least).drop("_place")
    return keyed.join(common, "_key", "left_anti").unionByName(shared).drop("_key")


def best(query: np.ndarray, other: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query, each partner once; ties go to the smaller id."""
    order = np.lexsort((other, -score, query))
    query, other = query[order], other[order]
    first = ~pd.DataFrame({"q": query, "o": other}).duplicated().to_numpy()
    order, query = order[first], query[first]
    starts = np.searchsorted(query, query)
    return order[np.arange(len(query)) - starts < k]


def _best_of_slab(left: np.ndarray, asks: np.ndarray, right: np.ndarray, ids: np.ndarray, k: int) -> tuple:
    """(query, other, score): the k best of each query of a slab among the vectors of a
    chunk, which are sorted by id; the cut is at the k-th id, not at the k-th vector."""
    with np.errstate(over="ignore", invalid="ignore"):
        rough = left @ right.T
    other = asks[:, None] != ids[None, :]
    rough[~other] = -np.inf
    starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    if len(starts) > k:
        least = np.partition(np.maximum.reduceat(rough, starts, axis=1), -k, axis=1)[:, -k]
        slack = 1e-9 * np.maximum(1, np.abs(least))
        other &= rough >= (least - slack)[:, None]
    a, b = np.nonzero(other)
    score, step = np.empty(len(a)), max(1, SCORED_CELLS // max(1, left.shape[1]))
    for at in range(0, len(a), step):
        score[at : at + step] = (left[a[at : at + step]] * right[b[at : at + step]]).sum(axis=1)
    top = best(asks[a], ids[b], score, k)
    return asks[a[top]], ids[b[top]], score[top]


def _rank(frame: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best of each query of a frame of whole chunks."""
    found = []
    for _, group in frame.groupby(_KEYS, sort=False):
        asks = group["query"].to_numpy()
        if not asks.any() or asks.all():
            continue
        order = np.argsort(group["id"].to_numpy(), kind="stable")
        group, asks = group.iloc[order], asks[order]
        matrix = np.frombuffer(b"".join(group["raw"]), np.float64).reshape(len(group), -1)
        ids = group["id"].to_numpy()
        left, right, own, others = matrix[asks], matrix[~asks], ids[asks], ids[~asks]
        slab = max(1, SLAB_CELLS // len(others))
        for at in range(0, len(own), slab):
            found.append(_best_of_slab(left[at : at + slab], own[at : at + slab], right, others, k))
    if not found:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
    return _merged([pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), f))) for f in found], k)


def _merged(found: list[pd.DataFrame], k: int) -> pd.DataFrame:
    """The k best of each query of all frames."""
    rows = pd.concat(found, ignore_index=True)
    return rows.iloc[best(*(rows[c].to_numpy() for c in ("query_id", "vec_id", "score")), k)]


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    tables: int,
    probes: int,
    seed: int = 1,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """The k nearest found of each query: query_id, rank (from 1), vec_id, score (the inner
    product of the original vectors, in double precision), nearest first, ties to the
    smaller vec_id. A query is not its own neighbour, which is told by its id.

    Vectors that are null, zero or hold a null or non-finite component, and rows with a
    null id, take no part. Vectors of different lengths never meet. A vec_id that repeats
    counts once, with its best score. An empty table or one without a partner gives no
    rows. Other columns are not read. All vectors are indexed and all of a bucket's
    vectors are ranked; what no probe reaches is not found."""

    def clean(df: DataFrame) -> DataFrame:
        rows = df.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(
            F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")
        )
        return rows.dropDuplicates(["id", "vector"])

    index = stored(_hashed(_smallest_of_equal(clean(vectors), k + 1), tables, 1, seed), "axes")
    asked = _hashed(clean(queries), tables, probes, seed)

    def chunks(counts: DataFrame, name: str) -> DataFrame:
        return counts.select("dim", "place", F.ceil(F.col("count") / CHUNK).cast("int").alias(name))

    large = (
        chunks(index.groupBy("dim", "place").count(), "chunks")
        .join(chunks(_rows_by_place(clean(queries), tables, probes, seed), "parts"), ["dim", "place"])
        .where("chunks > 1 OR parts > 1")
    )

    def spread(df: DataFrame, query: bool) -> DataFrame:
        def place(number: str, own: bool) -> Column:
            count = F.coalesce(number, F.lit(1))
            if own:
                return F.pmod(F.xxhash64("id", "raw"), count).cast("int")
            return F.explode(F.sequence(F.lit(0), count - 1))

        return df.join(large, ["dim", "place"], "left").select(
            "dim", "place", place("chunks", not query).alias("chunk"), place("parts", query).alias("part"), "id", "raw", F.lit(query).alias("query")
        )

    together = spread(index, False).unionByName(spread(asked, True))

    def rank(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in whole_groups(batches, _KEYS, BATCH):
            held.append(_rank(frame, k))
            if sum(map(len, held)) >= HELD:
                held = [_merged(held, k)]
                if len(held[0]) > HELD // 2:
                    yield held.pop()
        if held:
            yield _merged(held, k)

    found = (
        together.repartition(*_KEYS)
        .sortWithinPartitions(*_KEYS)
        .mapInPandas(rank, "query_id long, vec_id long, score double")
        .groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"))
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
