from __future__ import annotations

import random

import brute
from pyspark.sql import functions as F

from ticketlens.llm import decontaminate, queries
from ticketlens.llm.common import table


def _rows(df):
    return sorted(
        (r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in df.collect()
    )


def _wanted(docs, items, window=10):
    return sorted(
        (d is None, d or 0, words, hit, found, hit > 0) for d, words, hit, found in brute.contamination(docs, items, window)
    )


def test_query_equals_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    got = {r["doc_id"]: r for r in queries.op3_decontamination(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    hits = 0
    for doc, words, hit, found in brute.contamination(docs, items):
        row = got[doc]
        assert (row["n_words"], row["n_hit"], row["n_items"]) == (words, hit, len(found))
        assert row["items_sha256"] == brute.sha(",".join(found)) and row["contaminated"] == (hit > 0)
        assert row["n_near"] >= row["n_items"]
        hits += hit > 0
    assert hits


def test_odd_rows(frame, spark):
    long = "pad " * 30_000 + "one two three four five six seven eight nine ten eleven"
    docs = [
        (1, "Zero ONE two-three,four five six seven eight nine ten ELEVEN"),
        (1, "Zero ONE two-three,four five six seven eight nine ten ELEVEN"),
        (2, None),
        (3, ""),
        (None, "alone here"),
        (4, "héllo Élan élan"),
        (5, long),
        (6, "one two three four five six seven eight nine"),
        (7, "ten eleven alone alone here alone here"),
    ]
    items = [
        (1, "one two three four five six seven eight nine ten eleven"),
        (12, "one two three four five six seven eight nine ten"),
        (3, "alone here"),
        (4, ""),
        (5, None),
        (None, "hÉllo"),
        (7, "héllo"),
    ]
    items_df = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    for partitions in (1, 4):
        got = decontaminate.contamination(frame(docs, partitions), items_df)
        assert _rows(got) == _wanted(docs, items)


def test_random_texts_with_windows_across_documents(frame, spark):
    random.seed(4)
    docs = [(i, " ".join(random.choices("abcd", k=random.randrange(30)))) for i in range(200)]
    items = [(i, " ".join(random.choices("abcd", k=random.randrange(9)))) for i in range(60)]
    got = decontaminate.contamination(frame(docs), spark.createDataFrame(items, "item_id long, text string"), window=5)
    assert _rows(got) == _wanted(docs, items, 5)


def test_many_blocks_and_small_segments_change_nothing(frame, spark, monkeypatch):
    random.seed(5)
    docs = [(i, " ".join(random.choices("abcdef", k=random.randrange(40)))) for i in range(100)]
    items = spark.createDataFrame(
        [(i, " ".join(random.choices("abcdef", k=random.randrange(12)))) for i in range(40)], "item_id long, text string"
    )
    whole = _rows(decontaminate.contamination(frame(docs), items, window=4))
    monkeypatch.setattr(decontaminate, "BLOCK_PHRASES", 60)
    monkeypatch.setattr(decontaminate, "CHECKED", 10)
    assert _rows(decontaminate.contamination(frame(docs), items, window=4)) == whole


def test_proximity(frame, spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    docs = [(1, "alpha beta gamma delta"), (2, "alpha x beta gamma y delta"), (3, "alpha x y z beta gamma delta"), (4, "beta")]
    got = {r["doc_id"]: r["n_near"] for r in decontaminate.contamination(frame(docs), items, slop=2).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 0}


def test_empty_tables(frame, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert _rows(decontaminate.contamination(frame([(1, "a b")]), none)) == [(False, 1, 2, 0, [], False)]
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.contamination(frame([]), some).count() == 0


def test_filter_keeps_columns(frame, spark):
    items = spark.createDataFrame([(1, "bad words here")], "item_id long, text string")
    docs = frame([(1, "some bad words here"), (2, "good"), (2, None), (None, "good"), (2, "good")])
    kept = decontaminate.without_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r["text"] or "" for r in kept.collect()) == ["", "good", "good", "good"]


def test_near_words_are_of_one_document(spark, frame):
    items = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    common = (9, "beta gamma delta x x x beta gamma delta")
    # Document 1 ends before delta; in 3 the rarest word, alpha, stands one late.
    docs = [common, (1, "alpha beta gamma y"), (2, "delta z"), (3, "beta alpha gamma delta"), (4, "")]
    for partitions in (1, 5):
        df = spark.createDataFrame(docs, "doc_id long, text string")
        df = df.coalesce(1) if partitions == 1 else df.repartition(partitions, "doc_id")
        got = {r["doc_id"]: r["n_near"] for r in decontaminate.contamination(df, items, slop=2).collect()}
        assert got == {9: 0, 1: 0, 2: 0, 3: 1, 4: 0}
