"""Collocations against a plain count, against SQL, and on odd rows."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from compare import connect, differences

from ticketlens.llm import collocations, queries
from ticketlens.llm.collocations import Filter, mine, mine_sql


def plain(rows, least, top):
    counts, total = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            total[lang] += len(words)
            for m in (1, 2, 3, 4):
                counts.update((lang, *words[i : i + m]) for i in range(len(words) - m + 1))
    found = {k: a for k, a in counts.items() if len(k) > 2 and a >= least}
    rows = []
    for (lang, *ws), a in found.items():
        inside = any(
            len(other) > len(ws) + 1
            and other[0] == lang
            and any(list(other[i : i + len(ws)]) == ws for i in range(1, len(other)))
            and 100 * b >= 80 * a
            for other, b in found.items()
        )
        if inside:
            continue
        score, k = min(
            (2_000_000 * a // (counts[(lang, *ws[:k])] + counts[(lang, *ws[k:])]), k) for k in range(1, len(ws))
        )
        rows.append((lang, " ".join(ws), a, counts[(lang, *ws[:k])], counts[(lang, *ws[k:])], total[lang], score))
    out = []
    for lang in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(r[0], rank, *r[1:]) for rank, r in enumerate(own[:top], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    vocabulary = ["a", "b", "New", "York", "é", "the", "x\x00", "w" * 300, "漢字", "l" * 9, "z" * 17]
    out = []
    for i in range(300):
        words = [r.choice(vocabulary) if r.random() < 0.7 else "New York City Hall" for _ in range(r.randint(0, 25))]
        out.append((i, "".join(w + r.choice([" ", "  ", "\t", " ", ". ", "\n", ","]) for w in words), r.choice(["en", "de", None])))
    return out + [(900, None, "en"), (901, "", None), (902, " . ! ", "en"), (903, "solo", "xx")]


@pytest.mark.parametrize("least,top", [(5, 1000), (30, 7), (2, 40)])
def test_against_plain_counts(frame, texts, least, top):
    assert rows_of(mine(frame(texts), least, top)) == plain(texts, least, top)


def test_a_full_filter_changes_nothing(frame, texts, monkeypatch):
    full = np.full(Filter.SIZE // 64, ~np.uint64(0))
    monkeypatch.setattr(Filter, "of", classmethod(lambda cls, rows: Filter(full)))
    assert rows_of(mine(frame(texts[:80]), 3, 50)) == plain(texts[:80], 3, 50)


def test_slabs_and_stripes(texts, monkeypatch):
    """Words do not depend on how texts are cut into slabs, nor counts on when they are handed on."""
    batch = pa.RecordBatch.from_pydict({"lang": [t[2] or "und" for t in texts], "text": [t[1] for t in texts]})
    seen = []
    for size in (40, 10**6):
        monkeypatch.setattr(collocations, "SLAB_BYTES", size)
        words = []
        for slab, _ in collocations.slabs([batch], 0):
            strings = slab.text_of(np.arange(len(slab.ids))).to_pylist()
            words += list(zip(slab.ids.tolist(), strings, slab.follows.tolist()))
        seen.append(words)
    assert seen[0] == seen[1]
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), t[1] or "") for t in texts]
    assert [w for _, w, _ in seen[0]] == [w for t in low for w in re.findall(r"[^.,;:!?\x0A-\x0D\x20\x09]+", t)]
    stripes, sums = collocations.Stripes(["w1", "next"]), Counter()
    rows = np.random.default_rng(0).integers(0, 4, (100, 2))
    for low in range(0, 100, 10):
        stripes.add([rows[low : low + 10, 0], rows[low : low + 10, 1]])
    for b in stripes.merged():
        sums.update({(r["w1"], r["next"]): r["n"] for r in b.to_pylist()})
    assert sums == Counter(map(tuple, rows.tolist()))


def test_repeats_ties_and_empty(frame):
    rows = [(1, "p q", None)] * 4 + [(2, "q p", "und")] * 4 + [(3, "p q", "en")]
    assert rows_of(mine(frame(rows), 4, 10)) == plain(rows, 4, 10)
    assert len(plain(rows, 4, 10)) == 2
    assert rows_of(mine(frame(rows).where("false"), 1, 10)) == []
    assert rows_of(mine(frame([(1, None, None)]), 1, 10)) == []


def test_large_counts_stay_exact(spark, frame):
    """The products of the score and of the coverage are decimals."""
    plan = mine(frame([(1, "a b a b", "en")]), 1, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "decimal" in plan.lower()


def test_query_equals_sql(spark, sf_dir):
    assert differences(queries.op11_collocations(spark, sf_dir), connect(sf_dir), mine_sql(30, 2000)) == ""
