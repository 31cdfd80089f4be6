from __future__ import annotations

import random

import brute
from pyspark.sql import functions as F

from ticketlens.llm import pii, queries
from ticketlens.llm.common import table

ODD = [
    None,
    "",
    "4111 1111 1111 1111",
    "4111-1111-1111-1111x a@b.c_d@e.f +1 (234) 567-8901",
    "1.2.3.4.5.6.7.8 0255.1.1.1 256.1.1.1",
    "é😀 a@b.co, +1+2 345 678 90 12",
    "a" * 50_000 + "@" + "b." * 20_000 + "c " + "1" * 30_000 + " " + "9." * 9_000,
    "mail me (x): a(at)b.com",
    "call 212-555-1234 now",
]


def _base(spans):
    return [(s["start"], s["kind"], s["end"]) for s in spans if s["base"]]


def test_query_equals_brute_force(spark, sf_dir):
    texts = {r[0]: r[1] for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    got = queries.op4_personal_data(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        spans = brute.base_spans(texts[r["doc_id"]])
        named = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == n for s in spans) for n in range(4)]
        assert r["base_sha256"] == brute.sha(",".join(named))
        assert set(named) <= set(r["spans"].split(","))  if named else True


def test_random_and_odd_texts(frame):
    random.seed(3)
    texts = ["".join(random.choices("ab1.2-+@ ()é9_4😀%", k=random.randrange(60))) for _ in range(3000)] + ODD
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(frame(rows)).collect()}
    for doc, text in rows:
        assert _base(got[doc]) == brute.base_spans(text)
        assert [tuple(s)[:2] for s in got[doc]] == sorted(tuple(s)[:2] for s in got[doc])


def test_only_functions_of_spark(frame):
    plan = pii.find_personal_data(frame([(1, "a@b.co")]))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_expectation_maximisation_trusts_agreeing_labelers(spark):
    def rows(votes, n):
        return [(0, votes)] * n

    df = spark.createDataFrame(
        rows([1, 1, 1, 0, 1], 50) + rows([1, 1, 0, 0, 1], 30) + rows([-1, -1, 0, -1, -1], 200) + rows([1, -1, 0, -1, -1], 20),
        "kind int, votes array<int>",
    )
    p = {tuple(r["votes"]): r["p"] for r in pii.posteriors(df).collect()}
    assert p[1, 1, 1, 0, 1] > 0.9 and p[-1, -1, 0, -1, -1] < 0.1 and p[1, -1, 0, -1, -1] < 0.5


def test_mask_keeps_columns_and_hides_spans(frame):
    docs = frame([(1, "x a@b.co y"), (2, None), (3, ""), (None, "nothing"), (1, "x a@b.co y")])
    out = pii.masked(docs)
    assert out.columns == docs.columns
    assert sorted((r["text"] or "") for r in out.collect()) == ["", "", "nothing", "x [EMAIL] y", "x [EMAIL] y"]
    same = out.where(F.col("doc_id") == 1).select(*[c for c in docs.columns if c != "text"]).distinct()
    assert same.count() == 1


def test_empty_table(frame):
    assert pii.find_personal_data(frame([])).count() == 0 and pii.masked(frame([])).count() == 0
