from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ticketlens.llm import neighbours, queries
from ticketlens.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, id string, raw int"


def _exact(ids, matrix, query, k):
    scores = (matrix * matrix[ids == query][0]).sum(axis=1)
    order = [i for i in np.lexsort((ids, -scores)) if ids[i] != query][:k]
    return [(int(ids[i]), float(scores[i])) for i in order]


def test_query_recall_and_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").toPandas()
    ids, matrix = rows["vec_id"].to_numpy(), np.array(rows["embedding"].tolist(), dtype=float)
    got = queries.op1_neighbours(spark, sf_dir).toPandas().sort_values(["query_id", "rank"])
    found = total = 0
    for query in ids[ids % 20 == 0]:
        own = got[got["query_id"] == query]
        assert list(own["rank"]) == list(range(1, 21))
        scores = (matrix[own["vec_id"]] * matrix[ids == query][0]).sum(axis=1)
        assert np.allclose(scores, own["score"], rtol=0, atol=1e-12) and (np.diff(own["score"]) <= 0).all()
        found += len({v for v, _ in _exact(ids, matrix, query, 20)} & set(own["vec_id"]))
        total += 20
    assert found / total >= 0.9


@pytest.mark.parametrize("chunk", [4096, 5])
def test_all_axes_probed_is_exact_with_ties(spark, monkeypatch, chunk):
    monkeypatch.setattr(neighbours, "CHUNK", chunk)
    random = np.random.default_rng(3)
    matrix = random.normal(size=(80, 6)).astype(np.float32)
    matrix[20:60] = matrix[20]
    df = spark.createDataFrame([(i, v.tolist(), "x", 1) for i, v in enumerate(matrix)], SCHEMA).repartition(4)
    got = neighbours.search(df, df.where("vec_id % 7 = 0"), 10, 1, 16).collect()
    for query in range(0, 80, 7):
        own = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == query)
        assert [v for _, v in own] == [v for v, _ in _exact(np.arange(80), matrix.astype(float), query, 10)]


@pytest.mark.parametrize("near", [False, True])
def test_hot_group_scores_few_pairs(spark, monkeypatch, near):
    matrix = np.random.default_rng(5).normal(size=(400, 4))
    matrix[40:] = matrix[40]
    if near:  # not equal, but too near for the rough scores to tell apart
        matrix[40:] *= 1 + 1e-13 * np.arange(360)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)], "vec_id long, embedding array<double>").repartition(4)
    few = neighbours._smallest_of_equal(df.selectExpr("vec_id AS id", "embedding AS vector"), 6).collect()
    assert sorted(r["id"] for r in few) == list(range(400 if near else 46))
    monkeypatch.setattr(neighbours, "CHUNK", 50)
    rank, scale = neighbours._rank, spark.sparkContext.accumulator(0)

    def small(frame, k):
        for _, group in frame.groupby(neighbours._KEYS):
            asks = int(group["query"].sum())
            if asks > 90 or len(group) - asks > 90:  # a chunk is 50 rows by hash
                scale.add(1)
        return rank(frame, k)

    monkeypatch.setattr(neighbours, "_rank", small)
    got = neighbours.search(df, df, 5, 1, 8).collect()
    assert scale.value == 0
    for query in range(0, 400, 13):
        own = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == query)
        assert [v for _, v in own] == [v for v, _ in _exact(np.arange(400), matrix, query, 5)]


@pytest.mark.parametrize("same", [False, True])
def test_repeated_ids_take_one_place(spark, same):
    rows = [(1, [1.0, 0.0]), (8, [0.8, 0.1]), (9, [0.7, 0.1])]
    rows += [(7, [0.9, 0.0 if same else 0.001 * i]) for i in range(25)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.search(df, df.where("vec_id = 1"), 2, 1, 4).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(1, 7, 0.9), (2, 8, 0.8)]


def test_slabs_of_few_queries_and_pairs(monkeypatch):
    random = np.random.default_rng(7)
    matrix, ids = random.normal(size=(300, 4)), random.integers(0, 40, 300)
    matrix[:100] = matrix[0]
    frame = pd.DataFrame({"id": ids, "raw": [v.tobytes() for v in matrix], "query": np.arange(300) % 3 == 0})
    frame = frame.assign(**dict.fromkeys(neighbours._KEYS, 0))
    whole = neighbours._rank(frame, 5).sort_values(["query_id", "vec_id"])
    monkeypatch.setattr(neighbours, "SLAB_CELLS", 500)
    monkeypatch.setattr(neighbours, "SCORED_CELLS", 100)
    parts = neighbours._rank(frame, 5).sort_values(["query_id", "vec_id"])
    assert np.array_equal(whole.to_numpy(), parts.to_numpy())
    asks = frame["query"].to_numpy()
    for query in set(ids[asks]):
        scores = (matrix[asks & (ids == query)] @ matrix[~asks].T).max(axis=0)
        best = pd.Series(scores).groupby(ids[~asks]).max().drop(query, errors="ignore").nlargest(5)
        own = whole[whole["query_id"] == query]
        assert len(own) == 5 and np.allclose(sorted(own["score"]), sorted(best))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0])]
    rows += [(8, []), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (10, [2e30, -1e30]), (11, [1.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)
    got = {(r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.search(df, df, 5, 2, 4).collect()}
    assert {q for q, _, _ in got} <= {1, 2, 10} and (1, 1, 10) in got and (2, 1, 10) in got
    assert len({(q, v) for q, _, v in got}) == len(got)
    assert neighbours.search(df.where(F.lit(False)), df, 5, 2, 4).count() == 0


def test_rotation_keeps_lengths():
    turned = neighbours.rotated(np.random.default_rng(0).normal(size=(20, 48)), 0, 1)
    assert turned.shape == (20, 64) and np.allclose(np.linalg.norm(turned, axis=1), 1)
