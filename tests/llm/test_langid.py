from __future__ import annotations

import itertools
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np

from ticketlens.llm import langid, queries
from ticketlens.llm.common import table


def test_held_out_accuracy(spark, sf_dir):
    langs = {r[0]: r[1] for r in table(spark, sf_dir, "documents").select("doc_id", "lang").collect()}
    got = queries.op9_language(spark, sf_dir).collect()
    assert len(got) == len(langs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert held and np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in held]) > 0.95


def _model():
    model = langid.train(["the house of the king and the sea"] * 20 + ["der hund und die katze sind ein haus"] * 20, ["en"] * 20 + ["de"] * 20)
    return model


def test_forward_backward_equals_all_paths():
    random = np.random.default_rng(1)
    model = langid.Model(["a", "b", "c"], np.zeros((langid.BUCKETS, 3), np.float32), random.normal(size=(3, 3)), random.normal(size=3))
    scores = random.normal(size=(1, 5, 3))
    used = np.array([[True, True, True, True, False]])
    share, moves = langid.forward_backward(scores, used, model)
    total, each, pairs = 0.0, np.zeros((5, 3)), np.zeros((3, 3))
    for path in itertools.product(range(3), repeat=4):
        weight = model.start[path[0]] + sum(scores[0, t, p] for t, p in enumerate(path))
        weight = np.exp(weight + sum(model.transitions[a, b] for a, b in zip(path, path[1:])))
        total += weight
        for t, p in enumerate(path):
            each[t, p] += weight
        for a, b in zip(path, path[1:]):
            pairs[a, b] += weight
    assert np.allclose(share[0], each / total) and np.allclose(moves, pairs / total)


def test_code_switched_words():
    model = _model()
    words = "the king and the sea der hund und die katze".split()
    share = langid.word_shares(model, [words, [], ["the"]])
    assert [model.languages[i] for i in share[0].argmax(1)] == ["en"] * 5 + ["de"] * 5
    assert share[1].shape == (0, 2) and np.allclose(share[2].sum(1), 1)


def test_odd_rows(frame):
    learn = [(i, "the house of the king and the sea", "en") for i in range(40)]
    learn += [(i, "der hund und die katze sind ein haus", "de") for i in range(40, 80)]
    rows = [(100, None), (101, "12 34 !?"), (102, ""), (None, "the sea"), (103, "der hund " * 30_000), (103, "x" * 5_000), (104, "the sea", None)]
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.identify(frame(learn + rows)).collect() if (r["doc_id"] or 100) >= 100}
    assert {(100, "und"), (101, "und"), (102, "und"), (None, "en"), (103, "de"), (104, "en")} <= got
    assert langid.identify(frame([])).count() == 0
    assert [tuple(r)[2:4] for r in langid.identify(frame([(1, "the sea")])).collect()] == [("und", 0.0)]


def test_marks_alone_are_no_language(spark, frame):
    learned = [(i, "the house of the king", "en") for i in range(40)]
    docs = frame([*learned, (50, "\u0301\u0308 \u0300"), (51, "a\u0301"), (52, "12 \u0301")])
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs).where("doc_id >= 50").collect()}
    assert got[50] == got[52] == ("und", 0.0) and got[51][0] == "en"
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, docs, "").collect()}
    assert kept == {*range(40), 51}


def test_sample_counts_different_texts(frame):
    rows = [(i, f"the house number {i % 1000} of the king", "en") for i in range(1000)]
    rows += [(i, f"der hund nummer {i % 40} und die katze", "de") for i in range(1000, 9000)]
    taken = {}
    train, langid.train = langid.train, lambda texts, names: taken.update(Counter(names)) or train(texts, names)
    try:
        langid.fit(frame(rows), 20)
    finally:
        langid.train = train
    assert set(taken) == {"de", "en"} and all(10 <= n <= 32 for n in taken.values())


def test_filter_keeps_columns(frame):
    docs = frame([(i, "the house of the king", "en") for i in range(20)] + [(30, None), (31, "123")])
    kept = langid.keep_known(docs, 0.4)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == list(range(20))


def test_filter_keeps_mixed_and_unlabelled_texts(spark, frame):
    texts = {"en": "the house of the king and the sea", "de": "der hund und die katze sind ein haus", "fr": "le chat dans une maison avec nous deux"}
    rows = [(i, text, lang) for n, (lang, text) in enumerate(texts.items()) for i in range(40 * n, 40 * n + 40)]
    docs = frame([*rows, (200, " ".join(texts.values()) + " der"), (201, "12 34")])
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, docs, "").collect()}
    assert kept == {*range(120), 200}
    unlabelled = frame([(1, "the sea"), (2, "le chat"), (3, "12 34"), (4, None)])
    assert {r["doc_id"] for r in corpus_pipeline.language(spark, unlabelled, "").collect()} == {1, 2}


def test_long_words_are_cut():
    assert [len(w) for w in langid.WORD.findall("a" * 50)] == [24, 24, 2]
    assert langid.features(["a" * 24, "b"]).max() < langid.BUCKETS


def test_certainty_is_of_words_not_of_the_text():
    share = np.array([[1.0, 0.0], [0.0, 1.0]])
    assert langid.certainty(share) == 1 and langid.certainty(np.full((3, 4), 0.25)) == 0
    assert langid.certainty(np.ones((2, 1))) == 1


def test_stage_drops_what_the_field_cannot_tell(spark, frame):
    learned = [(i, "the house of the king and the sea", "en") for i in range(40)]
    learned += [(i, "der hund und die katze sind ein haus", "de") for i in range(40, 80)]
    rows = [
        (100, "the king and the sea der hund und die katze"),  # two languages
        (101, "\u044d\u0442\u043e \u0442\u0435\u043a\u0441\u0442 \u043d\u0430 \u0434\u0440\u0443\u0433\u043e\u043c \u044f\u0437\u044b\u043a\u0435"),  # letters never learned
        (102, "the sea " * 20_000),
        (103, "the king"),
        (103, "the king"),
        (104, "12 34"),
        (105, None),
        (None, "der hund"),
    ]
    docs = frame(learned + rows)
    out = corpus_pipeline.language(spark, docs, "")
    assert out.columns == docs.columns
    kept = [r["doc_id"] for r in out.collect()]
    assert sorted(k for k in kept if k is not None and k >= 100) == [100, 102, 103, 103] and kept.count(None) == 1
    assert len(kept) == 85
    assert corpus_pipeline.language(spark, frame([]), "").count() == 0
    assert [r["doc_id"] for r in corpus_pipeline.language(spark, frame([(1, "no labels"), (2, "")]), "").collect()] == [1]
