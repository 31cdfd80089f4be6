"""Spelling variants by a bidirectional FM-index over the delimited vocabulary.

Two words that differ by one code point agree in the first or in the second half of either.
So a search scheme has two parts: match the first half exactly, from the delimiter on, and
extend to the right over the second, allowing one error; or match the second half exactly and
extend to the left. An index can only be extended to one side: the forward index goes to the
left, the index of the reversed words to the right, and each half starts at the side where
it can grow. A state of a search is an interval of suffix ranks. Words are sorted, so the rank
of the suffix that starts with a word's leading delimiter is the number of the word.

The vocabulary is indexed in shards. A word is indexed under the halves it may share with
words of its own length, one less and one more (at most four), and searched under its own two, so
every search meets all words it can find. Halves that too many words share are cut into
chunks, of indexed words and of searched ones, and each pair of chunks is a group of its own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import give_back, stored

#: Indexed words of a shard, words searched at a time, and the most words of one half in a group.
SHARD_WORDS, SEARCHED, GROUP_WORDS = 60_000, 10_000, 60_000
LEFT, RIGHT = 0, 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class FMIndex:
    """An index of distinct strings, given as code arrays, in sorted order.

    The text is `$ s0 $ s1 $ ... $`; a delimiter ranks by the string behind it, so suffixes
    are compared up to the next delimiter and then by their string's number."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray):
        count = len(sizes)
        heads = np.concatenate(([0], np.cumsum(sizes + 1)))
        text = np.empty(int(heads[-1]) + 1, np.int64)
        is_char = np.ones(len(text), bool)
        is_char[heads] = False
        text[heads], text[is_char] = 1, codes
        rank = np.empty(len(text), np.int64)
        rank[heads], rank[is_char] = np.arange(count + 1), codes + count + 1
        width = 1
        while True:  # doubling: ranks of prefixes of `width` become those of twice as many
            behind = np.zeros(len(text), np.int64)
            behind[:-width] = rank[width:] if width < len(text) else 0
            behind[~is_char] = 0  # a delimiter's rank is final
            order = np.lexsort((behind, rank))
            new = np.ones(len(text), bool)
            new[1:] = (rank[order][1:] != rank[order][:-1]) | (behind[order][1:] != behind[order][:-1])
            rank[order] = np.cumsum(new) - 1
            if new.all() or width >= len(text):
                break
            width *= 2
        self.count, self.length = count, len(text)
        before = np.concatenate(([0], text[:-1]))
        self.last = before[order]  # the character in front of each suffix, 0 in front of the text
        # Places of each character, one after another: how often it stands before a place
        # is found by bisection.
        by_char = np.argsort(self.last, kind="stable")
        self.places = self.last[by_char] * (self.length + 1) + by_char
        top = int(text.max()) + 2
        chars = np.arange(top)
        self.shift = np.searchsorted(np.sort(text), chars) - np.searchsorted(self.places, chars * (self.length + 1))

    def step(self, char: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Bound of the interval with `char` in front."""
        known = np.minimum(char, len(self.shift) - 1)
        return np.searchsorted(self.places, known * (self.length + 1) + place) + self.shift[known]

    def in_front(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each interval the different characters in front of its suffixes, without
        delimiters: number of the interval, character, and the interval with it."""
        bounds, own = np.unique(low * (self.length + 1) + high, return_inverse=True)
        first, last = bounds // (self.length + 1), bounds % (self.length + 1)
        sizes = last - first
        at = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        pairs = np.unique(np.repeat(np.arange(len(bounds)), sizes) * (1 << 32) + self.last[at])
        which, char = pairs >> 32, pairs & 0xFFFFFFFF
        which, char = which[char > 1], char[char > 1]
        lows, highs = self.step(char, first[which]), self.step(char, last[which])
        # Back to the intervals asked for: each takes all characters of its own.
        number = np.bincount(which, minlength=len(bounds))
        starts = np.cumsum(number) - number
        many = number[own]
        pick = np.repeat(starts[own] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        return np.repeat(np.arange(len(low)), many), char[pick], lows[pick], highs[pick]

    def one_error(self, codes: np.ndarray, first: np.ndarray, sizes: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (search, string): strings one error away from a search, whose first `exact`
        codes match. A search is read from its code `first` on, from the delimiter away."""
        number = np.arange(len(sizes))
        low, high = np.ones(len(sizes), np.int64), np.full(len(sizes), self.count + 1)
        done = np.zeros(len(sizes), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        # States with one error: search, codes read, interval.
        empty = np.zeros(0, np.int64)
        wrong = (empty, empty, empty, empty)
        while len(number) or len(wrong[0]):
            s, pos, a, b = wrong
            ended = pos == sizes[s]
            if ended.any():
                at, to = self.step(np.ones(int(ended.sum()), np.int64), a[ended]), self.step(np.ones(int(ended.sum()), np.int64), b[ended])
                hit = at < to
                found.append((s[ended][hit], at[hit]))
            s, pos, a, b = s[~ended], pos[~ended], a[~ended], b[~ended]
            char = codes[first[s] + pos]
            a, b = self.step(char, a), self.step(char, b)
            some = a < b
            grown = [(s[some], pos[some] + 1, a[some], b[some])]
            if len(number):
                here = done[number]
                over = here >= exact[number]
                inside = here < sizes[number]
                char = codes[np.minimum(first[number] + here, len(codes) - 1)]
                if over.any():
                    q, p, c, a, b = number[over], here[over], char[over], low[over], high[over]
                    own, front, lows, highs = self.in_front(a, b)
                    other = (p[own] == sizes[q[own]]) | (front != c[own])
                    own, lows, highs = own[other], lows[other], highs[other]
                    more = p[own] < sizes[q[own]]
                    grown.append((q[own], p[own], lows, highs))  # one more code
                    grown.append((q[own][more], p[own][more] + 1, lows[more], highs[more]))  # another one
                    less = inside[over]
                    grown.append((q[less], p[less] + 1, a[less], b[less]))  # one less
                low, high = self.step(char[inside], low[inside]), self.step(char[inside], high[inside])
                number = number[inside]
                done[number] += 1
                some = low < high
                number, low, high = number[some], low[some], high[some]
            wrong = tuple(np.concatenate(x) for x in zip(*grown))
        if not found:
            return empty, empty
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(w) for w in words], np.int64)
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64), sizes


def near_in_shard(indexed: list[str], searched: list[str], side: int) -> Iterator[tuple[np.ndarray, list[str], np.ndarray]]:
    """Numbers of searched words, the sorted indexed words, and numbers of those near them.

    On the LEFT side words agree in the first half and errors are to its right."""
    turned = sorted({w[::-1] if side == LEFT else w for w in indexed})
    codes, sizes = _codes(turned)
    alphabet = np.unique(codes)
    index = FMIndex(np.searchsorted(alphabet, codes) + 2, sizes)
    for start in range(0, len(searched), SEARCHED):
        block = searched[start : start + SEARCHED]
        # A search is read away from the delimiter that it starts at.
        own, lengths = _codes([w if side == LEFT else w[::-1] for w in block])
        at = np.searchsorted(alphabet, own)
        known = alphabet[np.minimum(at, len(alphabet) - 1)] == own
        own = np.where(known, at + 2, len(alphabet) + 2)  # a code no indexed word has
        half = lengths // 2 if side == LEFT else lengths - lengths // 2
        q, hit = index.one_error(own, np.cumsum(lengths) - lengths, lengths, half)
        yield q + start, turned, hit


def _halves(side: int, size: Column) -> list[Column]:
    """Lengths of the halves by which words of `size` and their neighbours are searched."""
    part = F.floor if side == LEFT else F.ceil
    return [part((size + d) / 2).cast("int") for d in (-1, 0, 1)]


def _half(side: int, word: Column, size: Column) -> Column:
    return F.substr(word, F.lit(1), size) if side == LEFT else F.substr(word, F.length(word) - size + 1, size)


def near_pairs(words: DataFrame, total: int) -> DataFrame:
    """All pairs of near words: word, near, near_n, each once. `words`: word (distinct), n."""
    size = F.length("word")
    own, indexed = [], []
    for side in (LEFT, RIGHT):
        keys = F.array_distinct(F.array(*[_half(side, F.col("word"), h) for h in _halves(side, size)]))
        indexed.append(words.select(F.lit(side).alias("side"), F.explode(keys).alias("key"), "word", "n"))
        half = _half(side, F.col("word"), _halves(side, size)[1])
        own.append(words.select(F.lit(side).alias("side"), half.alias("key"), "word", "n"))
    indexed, own = indexed[0].unionByName(indexed[1]), own[0].unionByName(own[1])
    # Halves of too many words, few by their definition: both sides of them are cut.
    large = indexed.groupBy("side", "key").agg(F.count(F.lit(1)).alias("rows"))
    large = large.where(F.col("rows") > GROUP_WORDS).withColumn("cuts", F.ceil(F.col("rows") / GROUP_WORDS).cast("int"))
    large = large.select("side", "key", "cuts")
    shards = 1 + 4 * total // SHARD_WORDS

    def placed(rows: DataFrame, role: int) -> DataFrame:
        cut = rows.join(large, ["side", "key"], "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
        mine = F.pmod(F.xxhash64("word"), F.col("cuts")).cast("int")
        cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).withColumn("mine", mine)
        cell = ("mine", "other") if role else ("other", "mine")
        shard = F.when(F.col("cuts") == 1, F.pmod(F.xxhash64("side", "key"), F.lit(shards)))
        return cut.select(
            "side",
            F.coalesce(shard, F.lit(-1)).alias("shard"),
            F.when(F.col("cuts") > 1, F.col("key")).alias("key"),
            *[F.when(F.col("cuts") > 1, F.col(c)).alias(f"cell{i}") for i, c in enumerate(cell)],
            F.lit(role).alias("role"),
            "word",
            "n",
        )

    def search(group: pa.Table) -> pa.Table:
        side, role = group["side"][0].as_py(), group["role"].to_numpy()
        is_index = pa.array(role == 1)
        index, asked = group.filter(is_index), group.filter(pa.array(role == 0))
        counts = dict(zip(index["word"].to_pylist(), index["n"].to_pylist()))
        words, out = asked["word"].to_pylist(), [[], [], []]
        if counts and words:
            for q, turned, hit in near_in_shard(list(counts), words, side):
                hits = [turned[i][::-1] if side == LEFT else turned[i] for i in hit.tolist()]
                out[0] += [words[i] for i in q.tolist()]
                out[1] += hits
                out[2] += [counts[h] for h in hits]
        give_back()
        return pa.table(
            [pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())],
            ["word", "near", "near_n"],
        )

    rows = placed(indexed, 1).unionByName(placed(own, 0))
    pairs = rows.groupBy("side", "shard", "key", "cell0", "cell1").applyInArrow(search, "word string, near string, near_n long")
    # A pair may be found from both sides: distinct, and then counted, by one shuffle.
    return pairs.repartition("word").dropDuplicates(["word", "near"])


def count_words(docs: DataFrame, letters: str, shortest: int, drop_every: int | None, id_col: str, text_col: str) -> DataFrame:
    """Occurrences of words: word, n. A word is a maximal run of `letters` (a class without
    brackets), of at least `shortest` code points; A-Z are lower-cased. With `drop_every`, a
    code point is left out of a run in a document whose CRC-32 this number divides."""
    runs = F.regexp_extract_all(F.col(text_col), F.lit(f"([{letters}]{{{shortest},}})"), F.lit(1))
    found = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(runs).alias("run"))
    low = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run"))
    found = found.select("id", low.alias("run"))
    word = F.col("run")
    if drop_every:
        hashed = F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), F.col("run")))
        at = (hashed % F.length("run")).cast("int")
        less = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
        word = F.when(hashed % drop_every == 0, less).otherwise(word)
    counted = found.select(word.alias("word")).where(F.length("word") >= shortest)
    return counted.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _roots(links: DataFrame) -> DataFrame:
    """The last word of each chain of links: word, root. Chains at least double their counts at
    each link, so they are short, and each round halves what is left of them."""
    links = stored(links, "variants-links")
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = links.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
        )
        moved = stored(moved, "variants-links")
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        links = moved.select("word", "root")


def group_variants(
    docs: DataFrame,
    letters: str = r"A-Za-zÀ-ÿ",
    shortest: int = 5,
    least: int = 3,
    drop_every: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are those of `count_words` that occur `least` times. Two are near if one code point
    is inserted, deleted or replaced. The form is the near word of largest n, the smallest
    in code-point order of equal ones, if that n is at least twice the word's, else null; the root is
    the last form of forms. Null and empty texts have no words, repeated rows count each time, a
    null id stands as an empty string in the hash, and an empty table gives no rows. Other
    columns are not read. Words of any length are indexed whole."""
    counts = count_words(docs, letters, shortest, drop_every, id_col, text_col)
    words = stored(counts.where(F.col("n") >= least), "variants-words")
    pairs = near_pairs(words, words.count())
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near"))
    near = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = words.join(near, "word", "left")
    has_form = -F.col("best.minus") >= 2 * F.col("n")
    formed = stored(
        joined.select(
            "word",
            F.when(has_form, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(has_form, -F.col("best.minus")).alias("form_n"),
        ),
        "variants-forms",
    )
    roots = _roots(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
