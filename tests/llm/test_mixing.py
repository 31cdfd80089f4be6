from __future__ import annotations

import re

import numpy as np
import pytest

from ticketlens.llm import mixing, queries
from ticketlens.llm.common import table


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_query_properties(spark, sf_dir):
    docs = {r["doc_id"]: r for r in table(spark, sf_dir, "documents").collect()}
    got = {r["doc_id"]: r for r in queries.op10_mixing(spark, sf_dir).collect()}
    assert got == {r["doc_id"]: r for r in queries.op10_mixing(spark, sf_dir).collect()} and set(got) == set(docs)
    names = sorted({d["source"] for d in docs.values()}, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(len(_words(d["text"])) for d in docs.values() if d["source"] == s) for s in names]
    weights = [1 + i % 3 for i in range(len(names))]
    targets, free = dict.fromkeys(names, 0.0), set(range(len(names)))
    left = float(sum(sizes))
    while True:  # reshare until none is above three times its size
        share = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        above = {i for i in free if share[i] > 3 * sizes[i]}
        for i in above or free:
            targets[names[i]] = 3.0 * sizes[i] if above else share[i]
        left -= sum(3 * sizes[i] for i in above)
        free -= above
        if not above:
            break
    for at, name in enumerate(names):
        own = [got[d] for d in docs if docs[d]["source"] == name]
        assert {r["source_size"] for r in own} == {sizes[at]}
        assert all(abs(r["target"] - targets[name]) < 1e-6 * targets[name] for r in own)
        assert abs(sum(r["taken"] for r in own) - targets[name]) <= max(0.02 * targets[name], 3 * queries.BLOCK_WORDS)
    for doc, r in got.items():
        assert r["size"] == len(_words(docs[doc]["text"])) and 0 <= r["taken"] <= 3 * r["size"]


@pytest.mark.parametrize("size", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutations(size):
    index = np.arange(size)
    seen = {tuple(mixing.permute(index, np.full(size, size), np.full(size, key, np.uint64))) for key in range(5)}
    assert all(sorted(p) == list(range(size)) for p in seen)
    assert size < 64 or len(seen) == 5


def test_shares_are_capped_and_reshared():
    assert mixing.shares([10, 1000, 1000], [3, 1, 1], 3) == [30.0, 990.0, 990.0]
    assert mixing.shares([0, 5], [1, 2], 3) == [0.0, 5.0] and mixing.shares([], [], 3) == [] and mixing.shares([0], [1], 3) == [0.0]


def test_the_mix_holds_each_word_as_often_as_counted(frame):
    rows = [(i, " ".join(f"w{i}_{j}" for j in range(i % 40)), None, ["b", "a", None, "é"][i % 4]) for i in range(200)]
    docs = frame(rows + [(500, "x " * 20_000, None, "a"), (501, None, None, "z"), (502, "", None, "b")])
    mix = mixing.mix_sources(docs, 8, 16)
    taken = {r["doc_id"]: r["taken"] for r in mixing.taken_words(mix).collect()}
    texts = [r["text"].split(" ") for r in mixing.mixed_blocks(mix, docs).collect()]
    assert all(len(t) <= 8 for t in texts)
    seen: dict[int, int] = {}
    for word in (w for t in texts for w in t):
        doc = 500 if word == "x" else int(word[1:].split("_")[0])
        seen[doc] = seen.get(doc, 0) + 1
    assert seen == {d: n for d, n in taken.items() if n} and taken[501] == taken[502] == 0
    assert mix.slots.select("number", "slot").distinct().count() == mix.slots.count()


def test_partitions_do_not_matter(frame):
    rows = [(i, "a b c " * (i % 7), None, "s" if i % 3 else None) for i in range(60)] + [(1, "a b", None, "s"), (1, "a b", None, "s"), (None, "q", None, None)]
    a, b = (sorted(map(str, mixing.taken_words(mixing.mix_sources(frame(rows, n), 4, 8)).collect())) for n in (1, 6))
    assert a == b and len(a) == 63


def test_empty_table(frame):
    assert mixing.taken_words(mixing.mix_sources(frame([]), 8, 16)).count() == 0
    assert [r["taken"] for r in mixing.taken_words(mixing.mix_sources(frame([(1, None)]), 8, 16)).collect()] == [0]
