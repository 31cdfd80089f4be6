from __future__ import annotations

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ticketlens.llm import queries, tokens
from ticketlens.llm.common import table

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
JSON = open(PATH, encoding="utf-8").read()
TOKENIZER = Tokenizer.from_file(PATH)
PROVED = tokens.whole_tokens(JSON)
COUNT = tokens.counter(JSON, PROVED)


def _library(text):
    return len(TOKENIZER.encode(text or "", add_special_tokens=False).ids)


def test_query_equals_library(spark, sf_dir):
    texts = {r[0]: r[1] for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    got = queries.op7_token_counts(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        n = _library(texts[r["doc_id"]])
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((texts[r["doc_id"]] or "").encode()), n, n > 1024)


def test_proved_strings_are_one_token():
    assert len(PROVED) > 40_000
    assert all(len(e.ids) == 1 for e in TOKENIZER.encode_batch(sorted(PROVED), add_special_tokens=False))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "'s", "'S", " ", "\n", "\x85", "　", "é", "́", "漢", "1", "²", "٣", "😀", "<|endoftext|>", "<|", "\x00"]), max_size=12).map("".join) | st.text(max_size=30))
def test_any_text(text):
    assert COUNT(text) == _library(text)


def test_odd_rows(frame):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "word " * 40_000 + "x" * 20_000), (3, "<|endoftext|>x"), (3, "<|endoftext|>x")]
    got = sorted((r["doc_id"] or 0, r["n_tokens"]) for r in tokens.token_counts(frame(rows), PATH, 5).collect())
    assert got == sorted((d or 0, _library(t)) for d, t in rows)
    assert tokens.token_counts(frame([]), PATH, 5).count() == 0


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    count = tokens.counter(JSON, PROVED)
    for i in range(50):
        assert count(f"zqxv{chr(97 + i % 26)}jk wq{i}") == _library(f"zqxv{chr(97 + i % 26)}jk wq{i}")


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        tokens.check_supported(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
