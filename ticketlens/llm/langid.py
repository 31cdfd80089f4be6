"""Language of texts by a linear-chain conditional random field over their words.

Each word has features: affixes, character n-grams and the word itself (the lexicon),
hashed into one weight table per language. Learned transitions link neighbouring words.
Forward-backward gives each word its probability of being in each language, so that
code-switched texts are labelled word by word; a text's language is the one with the
largest share of its words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import give_back

#: A word is a run of letters; runs of more than 24 letters are cut into several words.
WORD_CHARS = 24
WORD = regex.compile(r"[\p{L}\p{M}]{1,%d}" % WORD_CHARS)
#: Words of one chain: texts are cut into chains of this many words, whatever their length.
CHAIN = 64
BUCKETS = 1 << 17
#: Words labelled at a time.
BATCH_WORDS = 40_000
UNKNOWN = "und"
#: Parts of the hash range that a sample is picked by; far more than texts of a language.
SAMPLE_PARTS = 1 << 50


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (BUCKETS, languages), float32
    transitions: np.ndarray  # (languages, languages)
    start: np.ndarray  # (languages,)
    letters: np.ndarray | None = None  # code points seen in learning; None: all count as seen


def _code_points(words: list[str]) -> np.ndarray:
    """(words, WORD_CHARS) code points, 0 beyond a word's end."""
    return np.array(words, dtype=f"<U{WORD_CHARS}").view(np.uint32).reshape(len(words), WORD_CHARS)


def features(words: list[str]) -> np.ndarray:
    """Bucket numbers, one row per word; unused places hold bucket 0, which has no weight."""
    chars = np.zeros((len(words), WORD_CHARS + 2), np.uint64)
    if words:
        chars[:, 1:-1] = _code_points(words)
    length = np.count_nonzero(chars, axis=1)
    chars[:, 0] = 1
    chars[np.arange(len(words)), length + 1] = 2
    grams: list[np.ndarray] = []
    prime = np.uint64(0x9E3779B97F4A7C15)

    def bucket(value: np.ndarray, kind: int) -> np.ndarray:
        mixed = (value + np.uint64(kind)) * prime
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        return ((mixed >> np.uint64(40)) % np.uint64(BUCKETS - 1)).astype(np.int64) + 1

    widest = min(int(length.max(initial=0)) + 2, WORD_CHARS + 2)
    with np.errstate(over="ignore"):
        for size in (1, 2, 3):
            for at in range(widest - size + 1):
                value = np.zeros(len(words), np.uint64)
                for step in range(size):
                    value = value * np.uint64(0x100000001B3) + chars[:, at + step]
                grams.append(np.where(at + size <= length + 2, bucket(value, size), 0))
        value = np.zeros(len(words), np.uint64)
        for at in range(widest):
            inside = at < length + 2
            value = np.where(inside, value * np.uint64(0x100000001B3) + chars[:, at], value)
            if at == 4:
                grams.append(bucket(value, 5))
        grams.append(bucket(value, 7))
        value = np.zeros(len(words), np.uint64)
        for back in range(4):
            value = value * np.uint64(0x100000001B3) + chars[np.arange(len(words)), np.maximum(length - back, 0)]
        grams.append(bucket(value, 9))
    return np.stack(grams, axis=1)


def forward_backward(scores: np.ndarray, used: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Of padded chains (chains, words, languages): the probability of each language for
    each word, and the expected transitions (languages, languages) summed over all.
    Both passes are scaled at each word, so that no chain is too long for them."""
    length, count = scores.shape[1:]
    local = np.exp(scores - scores.max(axis=2, keepdims=True))
    move = np.exp(model.transitions).astype(scores.dtype)
    ahead, back = np.empty_like(local), np.ones_like(local)

    def scaled(x: np.ndarray) -> np.ndarray:
        return x / x.sum(axis=-1, keepdims=True)

    ahead[:, 0] = scaled(np.exp(model.start).astype(scores.dtype) * local[:, 0])
    for t in range(1, length):
        step = scaled((ahead[:, t - 1] @ move) * local[:, t])
        ahead[:, t] = np.where(used[:, t, None], step, ahead[:, t - 1])
    for t in range(length - 2, -1, -1):
        step = scaled((local[:, t + 1] * back[:, t + 1]) @ move.T)
        back[:, t] = np.where(used[:, t + 1, None], step, 1)
    share = scaled(ahead * back) * used[:, :, None]
    pairs = ahead[:, :-1, :, None] * move * (local[:, 1:] * back[:, 1:])[:, :, None, :]
    pairs *= (used[:, 1:] / pairs.sum(axis=(2, 3)))[:, :, None, None]
    return share, pairs.sum(axis=(0, 1), dtype=np.float64).reshape(count, count)


def train(texts: list[str], languages: list[str], rounds: int = 6, rate: float = 0.5, seed: int = 0) -> Model:
    """Fits the field by gradient ascent (Adagrad) on chains in which stretches of texts
    in different languages alternate, so that transitions are learned too."""
    names = sorted(set(languages))
    random = np.random.default_rng(seed)
    stretches: list[tuple[int, list[str]]] = []
    for text, language in zip(texts, languages):
        words = WORD.findall(text.lower())
        at = 0
        while at < len(words):
            size = int(random.integers(4, CHAIN))
            stretches.append((names.index(language), words[at : at + size]))
            at += size
    order = random.permutation(len(stretches))
    label = np.array([stretches[i][0] for i in order for _ in stretches[i][1]], np.int64)
    words = [w for i in order for w in stretches[i][1]]
    count = len(names)
    model = Model(names, np.zeros((BUCKETS, count), np.float32), np.zeros((count, count)), np.zeros(count))
    if not words:
        return model
    codes, unique = pd.factorize(np.array(words, dtype=object))
    table = features(list(unique))
    model.letters = np.unique(_code_points(list(unique)))
    chains = -(-len(words) // CHAIN)
    squares, move_squares = np.full((BUCKETS, count), 1e-2), np.full((count, count), 1.0)
    batch = 64
    for _ in range(rounds):
        for first in random.permutation(range(0, chains, batch)):
            at = np.arange(first * CHAIN, min((first + batch) * CHAIN, len(words)))
            own = table[codes[at]]
            scores, used = _padded(model.weights[own].sum(axis=1), [len(at)])
            share, moves = forward_backward(scores, used, model)
            wrong = -share.reshape(-1, count)[: len(at)]
            truth = label[at]
            wrong[np.arange(len(at)), truth] += 1
            places = own.ravel()
            for language in range(count):
                step = np.bincount(places, np.repeat(wrong[:, language], own.shape[1]), BUCKETS)
                step[0] = 0
                squares[:, language] += step * step
                model.weights[:, language] += rate * step / np.sqrt(squares[:, language])
            inner = np.flatnonzero(np.arange(1, len(at)) % CHAIN)
            seen = np.bincount(truth[inner] * count + truth[inner + 1], minlength=count * count).reshape(count, count)
            step = seen - moves
            move_squares += step * step
            model.transitions += rate * step / np.sqrt(move_squares)
    return model


def _padded(scores: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Cuts the words of texts into chains: (chains, CHAIN, languages) and a mask."""
    lengths = np.asarray(lengths)
    chains = -(-lengths // CHAIN)
    first = np.concatenate(([0], np.cumsum(chains)[:-1]))
    place = np.repeat(first * CHAIN - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
    out = np.zeros((int(chains.sum()) * CHAIN, scores.shape[1]), scores.dtype)
    used = np.zeros(len(out), bool)
    out[place], used[place] = scores, True
    total = int(chains.sum())
    return out.reshape(total, CHAIN, scores.shape[1]), used.reshape(total, CHAIN)


def word_shares(model: Model, words: list[list[str]]) -> list[np.ndarray]:
    """For each text the probability of each language for each of its words. A word most of
    whose letters were never seen in learning (another alphabet) says nothing: features are
    hashed, so its own would only repeat weights of other words."""
    lengths = [len(w) for w in words]
    if not model.languages or not sum(lengths):
        return [np.zeros((n, len(model.languages)), np.float32) for n in lengths]
    codes, unique = pd.factorize(np.array([w for text in words for w in text], dtype=object))
    scores = np.zeros((len(unique), len(model.languages)), np.float32)
    for at in range(0, len(unique), 20_000):
        some = list(unique[at : at + 20_000])
        for column in features(some).T:
            scores[at : at + 20_000] += model.weights[column]
        if model.letters is not None:
            points = _code_points(some)
            used = points > 0
            seen = (np.isin(points, model.letters) & used).sum(axis=1)
            scores[at : at + 20_000][2 * seen < used.sum(axis=1)] = 0
    padded, used = _padded(scores[codes], lengths)
    shares = np.concatenate(
        [np.zeros((0, len(model.languages)), np.float32)]
        + [
            forward_backward(padded[a : a + 2000], used[a : a + 2000], model)[0][used[a : a + 2000]]
            for a in range(0, len(padded), 2000)
        ]
    )
    return np.split(shares, np.cumsum(lengths)[:-1])


def certainty(share: np.ndarray) -> float:
    """How sure the field is of the languages of a text's words, whichever they are: the
    mean of each word's largest probability, scaled so that 0 is a guess among all
    languages and 1 is certain."""
    count = share.shape[1]
    if count < 2:
        return 1.0
    sure = (share.max(axis=1).mean(dtype=np.float64) - 1 / count) / (1 - 1 / count)
    return float(min(max(sure, 0.0), 1.0))


def _label(model: Model, texts: Iterable[str | None]) -> Iterator[tuple[str, float, int, int, float]]:
    """(language, score, words, words most likely in another language, certainty) of each text."""
    held: list[list[str]] = []

    def flush() -> Iterator[tuple[str, float, int, int, float]]:
        for share in word_shares(model, held):
            if not len(share) or not model.languages:
                yield UNKNOWN, 0.0, len(share), 0, 0.0
                continue
            mean = share.mean(axis=0, dtype=np.float64)
            best = int(mean.argmax())
            other = int((share.argmax(1) != best).sum())
            yield model.languages[best], float(min(mean[best], 1.0)), len(share), other, certainty(share)

    size = 0
    for text in texts:
        held.append(WORD.findall(text.lower()) if text else [])
        size += len(held[-1])
        if size >= BATCH_WORDS:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


_LABEL = pa.struct(
    [
        ("lang_pred", pa.string()),
        ("score", pa.float64()),
        ("n_words", pa.int64()),
        ("n_other", pa.int64()),
        ("certainty", pa.float64()),
    ]
)


def label_column(spark, model: Model, text: Column) -> Column:
    """struct(lang_pred, score, n_words, n_other, certainty) of a text column. Texts are
    taken from the Arrow batch one at a time, so that a worker holds no second copy of it."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double, n_words long, n_other long, certainty double")
    def label(texts: pa.Array) -> pa.Array:
        found = list(_label(shared.value, (t.as_py() for t in texts)))
        columns = list(zip(*found)) if found else [[] for _ in _LABEL]
        out = pa.StructArray.from_arrays(
            [pa.array(column, field.type) for column, field in zip(columns, _LABEL)], fields=list(_LABEL)
        )
        del texts
        give_back()
        return out

    return label(text)


def fit(labelled: DataFrame, per_language: int = 250, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fits on a bounded sample: about `per_language` different texts of each language, at
    most twice as many, picked by a hash of the text. Copies of a text count once, so that
    each language has its share however often its texts repeat. Rows without text or language are left
    out; without any row the model knows no language. The model has a fixed size for each
    language, so it can be broadcast."""
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(
        "text IS NOT NULL AND lang IS NOT NULL"
    )
    texts = rows.select("lang", F.xxhash64("text").alias("_text")).distinct()
    counts = {r["lang"]: r["count"] for r in texts.groupBy("lang").count().collect()}
    if not counts:
        return train([], [])
    wanted = F.lit(False)
    place = F.pmod(F.xxhash64("text"), F.lit(SAMPLE_PARTS))
    for language, n in sorted(counts.items()):
        wanted = wanted | ((F.col("lang") == language) & (place < int(SAMPLE_PARTS * min(1, per_language / n))))
    sample = rows.where(wanted).dropDuplicates(["text", "lang"])
    # In a fixed order, should the bound bind: a rerun learns from the same texts.
    sample = sample.orderBy(F.xxhash64("text"), "lang", "text").limit(2 * per_language * len(counts)).collect()
    sample.sort(key=lambda r: (r["lang"], r["text"]))
    return train([r["text"] for r in sample], [r["lang"] for r in sample])


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> Column:
    """True for rows a model may learn from; the rest is held out."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 != 1


def _lettered(text_col: str) -> Column:
    """The text if it has a letter: combining marks alone are no word of any language."""
    return F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col))


def identify(
    docs: DataFrame,
    per_language: int = 250,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, lang_pred, score, n_words, n_other
    (words most likely in another language).

    A null text, one without letters, and any text when no labelled row exists are `und`
    with score 0. A null doc_id counts as the empty text in the split. Repeated rows stay
    repeated, an empty table gives an empty one, and of other columns none is read.
    Ties between languages go to the first by name."""
    learn = training_rows(docs, id_col)
    model = fit(docs.where(learn), per_language, text_col, lang_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (~learn).alias("held_out"),
        label_column(docs.sparkSession, model, _lettered(text_col)).alias("_l"),
    ).select("doc_id", "held_out", "_l.lang_pred", "_l.score", "_l.n_words", "_l.n_other")


def keep_known(
    docs: DataFrame,
    least: float = 0.25,
    per_language: int = 250,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """`docs` without the rows the field rejects: texts without a letter, and texts whose
    words it cannot tell to be in any of the learned languages (`certainty` below `least`).
    A text in several learned languages is certain word by word and stays.

    Null texts go; without any labelled row nothing is learned and all texts with a letter
    stay; repeated rows stay repeated; an empty table gives an empty one. All columns stay,
    whatever their names."""
    model = fit(docs.where(training_rows(docs, id_col)), per_language, text_col, lang_col)
    lettered = docs.where(F.col(text_col).rlike(r"\p{L}"))
    if not model.languages:
        return lettered
    label = label_column(docs.sparkSession, model, F.col(text_col)).alias("label")
    return lettered.select(F.struct("*").alias("row"), label).where(F.col("label.certainty") >= least).select("row.*")
