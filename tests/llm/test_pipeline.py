from __future__ import annotations

import re
from pathlib import Path

import brute
import corpus_pipeline
import pytest

import __spark_entry__ as entry_points
from ticketlens.llm import queries
from ticketlens.llm.common import shared_folder, table, whole_groups


def test_queries_are_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert {*queries.QUERIES, "pipeline"} <= set(entry_points.queries())
    assert set(queries.ORACLE_SQL) <= set(entry_points.oracle_sql())


def test_library_does_not_import_the_operators():
    root = Path(__file__).resolve().parents[2]
    for file in (root / "ticketlens").rglob("*.py"):
        if "llm" not in file.relative_to(root).parts:
            assert "llm" not in file.read_text()


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [tuple(r) for r in table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    kept = set(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        after = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "language":
            wanted = {d for d, t in rows.items() if t and any(c.isalpha() for c in t)}
            assert set(after) == wanted
        elif name == "near_duplicates":
            ids = sorted(rows)
            wanted = set(brute.components(ids, [brute.fingerprint(rows[i]) for i in ids]))
            assert set(after) == wanted
        elif name == "decontamination":
            hits = {d for d, _, n, _ in brute.contamination(sorted(rows.items()), items) if n}
            assert set(after) == set(rows) - hits and hits
        else:
            assert set(after) == set(rows) and after != rows
            assert not any(brute.base_spans(t) for t in after.values())
        rows, kept = after, set(after)
        docs = docs.sparkSession.createDataFrame(out.collect(), out.schema)
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r["doc_id"] for r in mixed} == kept and all(r["taken"] <= 3 * r["size"] for r in mixed)


def test_run_is_all_stages(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "size", "target", "taken"} <= set(out.columns) and out.count() > 0


def test_run_on_an_empty_corpus(spark, sf_dir, tmp_path):
    table(spark, sf_dir, "documents").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, sf_dir, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_shared_folder_is_the_setting(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


@pytest.mark.parametrize("rows", [1, 3, 100])
def test_whole_groups(rows):
    import pandas as pd

    frame = pd.DataFrame({"k": [1, 1, 2, 2, 2, 3, 4, 4], "v": range(8)})
    parts = list(whole_groups([frame.iloc[i : i + 2] for i in range(0, 8, 2)], ["k"], rows))
    assert list(pd.concat(parts)["v"]) == list(range(8))
    seen = [set(p["k"]) for p in parts]
    assert sum(map(len, seen)) == len(set().union(*seen))
