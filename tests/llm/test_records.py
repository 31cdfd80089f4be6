"""Record files: checksums, ids against the library, round trips, damage, odd rows."""

from __future__ import annotations

import glob
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ticketlens.llm import queries, records
from ticketlens.llm.crc import _plain, crc32c
from ticketlens.llm.pieces import Encoder

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
LIBRARY = Tokenizer.from_file(PATH)
ODD = [
    "", " ", "It's don't I'LL we'd 'S ''s", "<|endoftext|>a b<|startoftext|>c <|endof", "İstanbul ΣΑΣ Σ é x́̂ ́a ﬁ ǅ",
    "a b\x85c\x1cd e", "漢字 かな 12３ ½ ²", "x\x00y \x00 \x00\x00", "ßẞ ĳ ŉ ſ K ĿÀÈ×÷ºª", "_a_ __ 1_2 a1b22",
    "A" * 5000, "word " * 30_000, "a\n\n\tb\v\fc\r\n",
    "Ã", "ÀÉß×÷ÿ", "çà!!Çé1", "longword" * 4, "Ünïcödé" * 5, "a<b <| x<|y", "'S't'", "x" * 23 + " " + "x" * 24 + " " + "x" * 25,
]


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [1]


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, encoding="utf-8") as file:
        return Encoder(file.read())


def test_checksum():
    assert crc32c([b"123456789"]).tolist() == [0xE3069283]
    rng = np.random.default_rng(5)
    strings = [rng.bytes(n) for n in (0, 1, 2, 3, 4, 5, 7, 8, 9, 16, 17, 31, 33, 64, 100, 999) * 3]
    assert crc32c(strings).tolist() == [_plain(s) for s in strings]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(encoder, text):
    assert encoder.ids(text) == ids_of(text)[:-1]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aZé'sTßÀ.,!1 \ń <|endoftext>Σİ漢\x1c_"), max_size=40))
def test_any_text(encoder, text):
    assert encoder.ids(text) == ids_of(text)[:-1]


def test_long_texts_and_a_full_table(encoder, monkeypatch):
    from ticketlens.llm import pieces

    monkeypatch.setattr(pieces, "SLAB_BYTES", 50)
    small = Encoder(encoder.tokenizer.to_str())
    small.pool = small.pool[:150]
    for text in [*ODD[:5], " ".join(f"wörd{i}, It's" for i in range(300)), "y" * 400 + " z"]:
        assert small.ids(text) == ids_of(text)[:-1]


def test_unknown_tokenizers_are_refused():
    with open(str(public_tokenizers.path("byte_bpe_50k.json")), encoding="utf-8") as file, pytest.raises(ValueError):
        Encoder(file.read())


def expected(rows):
    """Digest rows in document order; rows of one id in any order are told apart by their ids."""
    out, start = [], 0
    for doc_id, text in rows:
        ids = ids_of(text)
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in queries.op12_records(spark, sf_dir).collect())
    assert got == expected(sorted(tuple(r) for r in rows))


def test_files(spark, frame):
    rows = [(i * 7 % 41, ODD[i % len(ODD)]) for i in range(41)] + [(100, None), (101, "x")]
    folder = records.write_tokens(frame(rows, 5), PATH, 1, file_bytes=20_000)
    files = records.file_list(spark, folder).orderBy("part", "number").collect()
    assert len(files) > 2 and sum(f["documents"] for f in files) == len(rows)
    got = [tuple(r) for r in records.read_records(spark, folder).orderBy("start").collect()]
    assert got == expected(sorted(rows, key=lambda r: r[0]))
    # A plain walk over the frames gives the same ids in the same order.
    walked = []
    for f in files:
        data, at = open(f"{folder}/{f['file']}.rec", "rb").read(), 0
        while at < len(data):
            size = int.from_bytes(data[at : at + 8], "little")
            walked.append(records.parse(data[at + 12 : at + 12 + size]))
            at += size + 16
    assert [(d, ids.tolist()) for d, ids in walked] == [(d, ids_of(t)) for d, t in sorted(rows, key=lambda r: r[0])]


def test_shuffled_reads(spark, frame):
    rows = [(i, f"text {i} " * (i % 9)) for i in range(200)]
    folder = records.write_tokens(frame(rows, 4), PATH, 1, file_bytes=2_000)
    one, again, other = (
        [(r["doc_id"], list(r["ids"])) for r in records.read_shuffled(spark, folder, seed, 3).collect()] for seed in (1, 1, 2)
    )
    assert one == again != other
    assert sorted(one) == sorted(other) == [(i, ids_of(t)) for i, t in rows]
    assert [d for d, _ in one] != sorted(d for d, _ in one)


def test_repeats_nulls_and_empty(spark, frame):
    rows = [(5, "b"), (5, "b"), (5, "a a"), (None, "n"), (None, None), (6, "c")]
    got = [tuple(r) for r in records.read_records(spark, records.write_tokens(frame(rows, 3), PATH, 1)).orderBy("start").collect()]
    assert [r[0] for r in got] == [None, None, 5, 5, 5, 6]
    assert [r[1] for r in got] == list(np.cumsum([0] + [r[2] for r in got[:-1]]))
    assert sorted(r[2:] for r in got) == sorted(r[2:] for r in expected(rows))
    empty = records.write_tokens(frame(rows, 1).where("false"), PATH, 1)
    assert records.read_records(spark, empty).collect() == []
    assert records.read_shuffled(spark, empty, 1, 2).collect() == []


def test_damage_is_noticed(spark, frame):
    folder = records.write_tokens(frame([(i, "some words") for i in range(9)], 1), PATH, 1)
    for name in glob.glob(f"{folder}/*.rec"):
        with open(name, "r+b") as file:
            file.seek(40)
            byte = file.read(1)
            file.seek(40)
            file.write(bytes([byte[0] ^ 1]))
    with pytest.raises(Exception, match="damaged"):
        records.read_records(spark, folder).collect()
