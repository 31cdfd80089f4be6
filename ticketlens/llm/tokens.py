"""Token counts by the whole-token shortcut.

Offline, every string of the vocabulary is encoded by itself; those that come back
as one token are proved. A text is cut into pre-tokens, proved ones count one each,
and only the rest is merged (and remembered, up to a bound)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Fixed value: how a byte-level tokenizer cuts a text before it merges bytes.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Merged pre-tokens a Python worker remembers, and the longest of them in characters.
REMEMBERED, REMEMBERED_CHARS = 500_000, 64

_counters: dict[int, Callable[[str], int]] = {}


def whole_tokens(tokenizer_json: str) -> frozenset[str]:
    """The strings of the vocabulary that encode alone as one token and are one pre-token."""
    tokenizer = Tokenizer.from_str(tokenizer_json)
    cut = regex.compile(PRE_TOKENS)
    decoded = {tokenizer.decode([i], skip_special_tokens=False) for i in range(tokenizer.get_vocab_size(False))}
    strings = sorted(s for s in decoded if s and "�" not in s and cut.findall(s) == [s])
    encoded = tokenizer.encode_batch(strings, add_special_tokens=False)
    return frozenset(s for s, e in zip(strings, encoded) if len(e.ids) == 1)


class _Merged(dict):
    """Tokens of each pre-token: proved ones are there from the start."""

    def __init__(self, tokenizer: Tokenizer, proved: frozenset[str]):
        super().__init__(dict.fromkeys(proved, 1))
        self.tokenizer, self.proved = tokenizer, proved

    def __missing__(self, piece: str) -> int:
        n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= REMEMBERED_CHARS:
            if len(self) >= len(self.proved) + REMEMBERED:
                self.clear()
                self.update(dict.fromkeys(self.proved, 1))
            self[piece] = n
        return n


def counter(tokenizer_json: str, proved: frozenset[str]) -> Callable[[str], int]:
    """A function from a text to its number of tokens. Strings of added tokens
    inside a text count as the library counts them by default: one token each."""
    tokenizer = Tokenizer.from_str(tokenizer_json)
    added = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
    special = regex.compile("|".join(map(regex.escape, added))) if added else None
    merged = _Merged(tokenizer, proved)
    cut = regex.compile(PRE_TOKENS).findall

    def count(text: str) -> int:
        if special is None or not special.search(text):
            return sum(map(merged.__getitem__, cut(text)))
        parts = special.split(text)
        return len(parts) - 1 + sum(sum(map(merged.__getitem__, cut(p))) for p in parts)

    return count


def check_supported(tokenizer_json: str) -> None:
    """Raises unless the file describes what the shortcut is proved for: byte-level
    pre-tokens, no normalizer, added tokens that match as they stand."""
    import json

    model = json.loads(tokenizer_json)
    cut = model.get("pre_tokenizer") or {}
    plain = all(
        not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"])
        for t in model.get("added_tokens", [])
    )
    if model.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not plain:
        raise ValueError("only byte-level tokenizers without normalizer and prefix space are supported")


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    limit: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_tokens, over_limit.

    Null and empty texts have 0 bytes and 0 tokens; repeated rows stay repeated; an
    empty table gives an empty one; other columns of `docs` are not read. The
    vocabulary (a bounded file) is read by the driver and broadcast, so executors
    need no copy of it. The longest text is counted whole, in one task."""
    spark: SparkSession = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer_json = file.read()
    check_supported(tokenizer_json)
    shared = spark.sparkContext.broadcast((tokenizer_json, whole_tokens(tokenizer_json)))

    @F.pandas_udf("long")
    def n_tokens(texts: pd.Series) -> pd.Series:
        key = hash(shared.value[0])
        if key not in _counters:
            _counters.clear()
            _counters[key] = counter(*shared.value)
        return texts.map(_counters[key]).astype("int64")

    text = F.coalesce(F.col(text_col), F.lit(""))
    return (
        docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"))
        .select(
            "doc_id",
            F.octet_length("_text").cast("long").alias("n_bytes"),
            n_tokens("_text").alias("n_tokens"),
        )
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
