from __future__ import annotations

import random

import brute
import numpy as np

from ticketlens.llm import queries, simhash
from ticketlens.llm.common import table


def test_query_equals_brute_force(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    ids, prints = [r[0] for r in rows], [brute.fingerprint(r[1]) for r in rows]
    wanted = set(zip(ids, (f"{p:016x}" for p in prints), brute.components(ids, prints)))
    got = {tuple(r) for r in queries.op8_simhash(spark, sf_dir).collect()}
    assert got == wanted and any(i != c for i, _, c in got)


def test_odd_rows(frame):
    rows = [(5, None), (3, ""), (9, " \t\n"), (None, "a b c d e"), (4, "A b c\x0bd  e"), (4, "A b c\x0bd  e"), (1, "x"), (2, "X")]
    rows += [(7, "word " * 50_000), (None, "only null")]
    got = sorted(simhash.near_duplicates(frame(rows), 4, 4).collect(), key=str)
    prints = [brute.fingerprint(t) for _, t in rows]
    wanted = zip([i for i, _ in rows], (f"{p:016x}" for p in prints), brute.components([i for i, _ in rows], prints))
    assert [tuple(r) for r in got] == sorted(wanted, key=lambda r: f"Row(doc_id={r[0]}, fingerprint='{r[1]}', component_id={r[2]})")
    assert simhash.near_duplicates(frame([]), 4, 4).count() == 0


def test_links_of_dense_prints_with_split_shards(spark, monkeypatch):
    random.seed(2)
    centres = [random.getrandbits(64) for _ in range(4)]
    prints = {0, (1 << 64) - 1}
    for _ in range(600):
        p = random.choice(centres)
        for bit in random.sample(range(64), random.randrange(7)):
            p ^= 1 << bit
        prints.add(p)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    wanted = brute.components(list(range(len(prints))), prints)
    for slot in (simhash.SLOT, 7):
        monkeypatch.setattr(simhash, "SLOT", slot)
        df = spark.createDataFrame([(p,) for p in signed], "fp long").repartition(4)
        edges = simhash.links(df, 4)
        rooted = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
        groups: dict[int, set] = {}
        for at, p in enumerate(signed):
            groups.setdefault(rooted.get(p, p), set()).add(wanted[at])
        assert len(groups) == len(set(wanted)) and all(len(g) == 1 for g in groups.values())


def test_tree_children_are_keyed_by_distance():
    random_prints = np.random.default_rng(0).integers(0, 1 << 63, 300).astype(np.uint64)
    child = simhash.bk_forest(np.zeros(300, np.int64), random_prints)
    parents, edges = np.nonzero(child >= 0)
    kids = child[parents, edges]
    assert sorted(kids) == list(range(1, 300))
    assert (np.bitwise_count(random_prints[parents] ^ random_prints[kids]) == edges).all()


def test_chain_and_star_components(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    edges = spark.createDataFrame(chain + star, "low long, high long").repartition(5)
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert {roots[i] for i in range(1, 201)} == {0} and {roots[1000 + i] for i in range(1, 300)} == {1000}


def test_one_of_each_keeps_columns(frame):
    docs = frame([(3, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "quite different words stand here"), (None, None), (None, "")])
    kept = simhash.one_of_each(docs, 4, 4)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2]


def test_one_of_each_where_ids_repeat(frame):
    far = "other words that have nothing in common with those above"
    rows = [(1, "a b c d"), (1, far), (2, "a b c d"), (2, far), (None, "a b c d"), (None, "alone here it stands now")]
    kept = [(r["doc_id"], r["text"]) for r in simhash.one_of_each(frame(rows), 4, 4).collect()]
    assert sorted(kept, key=str) == sorted([(1, "a b c d"), (1, far), (None, "alone here it stands now")], key=str)
    assert simhash.one_of_each(frame([]), 4, 4).collect() == []
    hot = [(i % 7, "the same words in every row") for i in range(500)]
    assert [r["doc_id"] for r in simhash.one_of_each(frame(hot), 4, 4).collect()] == [0]
