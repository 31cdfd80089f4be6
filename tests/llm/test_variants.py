"""Spelling variants against a plain search."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from ticketlens.llm import queries, variants


def near(words):
    """Near words of each by its neighbourhood: all deletions, at all places."""
    by_gap = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            by_gap[(i, w[:i] + w[i + 1 :])].add(w)
    out = defaultdict(set)
    for group in by_gap.values():
        for w in group:
            out[w] |= group - {w}
    for w in words:
        for i in range(len(w)):
            if (less := w[:i] + w[i + 1 :]) in words:
                out[w].add(less)
                out[less].add(w)
    return out


def plain(rows, shortest=5, least=3, drop=97):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % drop == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= shortest
    words = {w: n for w, n in counts.items() if n >= least and len(w) >= shortest}
    found, form = near(words), {}
    for w, others in found.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 2 * words[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(found[w]), words.get(form.get(w))) for w, n in words.items())


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("alphabet,most", [("ab", 9), ("abcé", 7), ("abcdefgh", 6)])
def test_index_finds_all_and_only_near_words(alphabet, most):
    r = random.Random(most)
    words = sorted({"".join(r.choice(alphabet) for _ in range(r.randint(2, most))) for _ in range(500)} | {"a" * 70, "a" * 71})
    expected = near(set(words))
    got = defaultdict(set)
    for side in (variants.LEFT, variants.RIGHT):
        for q, turned, hit in variants.near_in_shard(words, words, side):
            for a, b in zip(q.tolist(), hit.tolist()):
                got[words[a]].add(turned[b][::-1] if side == variants.LEFT else turned[b])
    assert {w: got[w] for w in words} == {w: expected[w] for w in words}


def test_searched_words_need_not_be_indexed():
    for side in (variants.LEFT, variants.RIGHT):
        ((q, turned, hit),) = variants.near_in_shard(["house", "mouse"], ["zzzzz", "xouse"], side)
        hits = {(a, turned[b][::-1] if side == variants.LEFT else turned[b]) for a, b in zip(q.tolist(), hit.tolist())}
        assert hits <= {(1, "house"), (1, "mouse")}


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    base = ["house", "garden", "mañana", "straße", "letter", "Élan×s", "aaaaa", "aaaaaa", "x" * 300]
    out = []
    for i in range(400):
        words = []
        for _ in range(r.randint(0, 12)):
            w = r.choice(base)
            if r.random() < 0.4:
                at = r.randrange(len(w))
                w = w[:at] + r.choice(["", "e", "ê", w[at] * 2]) + w[at + 1 :]
            words.append(w.upper() if r.random() < 0.1 else w)
        out.append((i, r.choice([" ", "-", "1", "漢"]).join(words)))
    return out + [(None, "House hOuse houses garden" * 3), (900, None), (901, ""), (902, "ab cd"), (902, "house"), (902, "house")] + [
        (1000 + i, " ".join("abcdefghi"[: 6 + m] for m in range(4) for _ in range(3 << m))) for i in range(2)
    ]


def test_groups(frame, rows):
    got = rows_of(variants.group_variants(frame(rows), drop_every=97))
    assert got == plain(rows)
    assert any(r[1] != r[2] and r[1] for r in got), "a chain of forms"


def test_large_halves_are_cut(frame, rows, monkeypatch):
    monkeypatch.setattr(variants, "GROUP_WORDS", 3)
    assert rows_of(variants.group_variants(frame(rows), drop_every=97)) == plain(rows)


def test_empty(frame, rows):
    assert rows_of(variants.group_variants(frame(rows).where("false"))) == []
    assert rows_of(variants.group_variants(frame([(1, None), (2, "1 2")]))) == []


def test_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(queries.op13_variants(spark, sf_dir)) == plain(docs)
