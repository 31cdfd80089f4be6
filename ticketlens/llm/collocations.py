"""Phrase collocations by the stripes pattern.

A stripe belongs to a prefix of one to three words and counts the words that follow it; a
task keeps the stripes of what it reads as sorted arrays, and stripes are merged elementwise.
They are stored by element (prefix, next word, count), so that the stripe of a very common
prefix is merged by many tasks. Its element 0 is the count of the prefix itself. All that is
asked is read from this one structure: phrase counts, counts of the parts of a cut, and the
largest extension of a phrase to either side.

A phrase cannot occur more often than a part of it. So three passes are made over the texts,
for words, for pairs of frequent words, and for chains of frequent pairs, and a pass leaves
out what the one before shows to be too rare. It asks a Bloom filter of fixed size, so what
it takes for frequent by mistake is counted in vain, and nothing frequent is lost."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ticketlens.llm.common import give_back, stored
from ticketlens.llm.words import text_bytes

#: Bytes of text taken at a time, counted elements held by a task, rows of a batch it returns.
SLAB_BYTES, HELD, BATCH = 2_000_000, 2_000_000, 200_000
#: Bits of a filter, as a power of two: its size is fixed, 8 MB.
FILTER_BITS = 26
#: Bytes of a word that are hashed together; longer words are hashed one by one.
LONG_WORD = 256
UNKNOWN = "und"

_A, _B, _C = (np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _B
        x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def key_of(columns: list[np.ndarray]) -> np.ndarray:
    """One 64-bit key of several columns of word ids."""
    key = columns[0].astype(np.uint64)
    for column in columns[1:]:
        with np.errstate(over="ignore"):
            key = _mix(key * _A + column.astype(np.uint64))
    return key


class Slab:
    """The words of some whole texts: ids (of language and word, never 0), where they stand
    in the lower-cased bytes, and whether the next word follows in the same piece."""

    def __init__(self, raw: np.ndarray, bounds: np.ndarray, languages: np.ndarray):
        byte = np.arange(256)
        lower = np.where((byte >= 65) & (byte <= 90), byte + 32, byte).astype(np.uint8)
        ends_piece = np.isin(byte, list(b".,;:!?\n\v\f\r"))
        inside = ~(ends_piece | np.isin(byte, list(b" \t")))
        self.raw, cuts = lower[raw], ends_piece[raw]
        solid = inside[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[bounds] = True
        begins = solid.copy()
        begins[1:] &= ~solid[:-1] | edge[1:-1]
        self.starts = np.flatnonzero(begins)
        stop = ~solid
        stop[bounds[1:-1][bounds[1:-1] < len(raw)]] = True
        stops = np.append(np.flatnonzero(stop), len(raw))
        at = np.searchsorted(stops, self.starts, "right")
        self.sizes = np.minimum(np.append(self.starts[1:], len(raw)), stops[at]) - self.starts
        self.text = np.searchsorted(bounds, self.starts, "right") - 1
        piece = np.cumsum(cuts)[self.starts]
        self.follows = np.append((piece[1:] == piece[:-1]) & (self.text[1:] == self.text[:-1]), False)[: len(self.starts)]
        self.ids = self._hashed(languages)

    def _hashed(self, languages: np.ndarray) -> np.ndarray:
        padded = np.concatenate([self.raw, np.zeros(16, np.uint8)])
        words = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(padded) - 7,), (1,))
        state = _mix(languages[self.text] + self.sizes.astype(np.uint64))
        own = np.flatnonzero(self.sizes <= LONG_WORD)
        at, part = self.starts[own], 0
        while len(own):
            left = np.minimum(self.sizes[own] - 8 * part, 8).astype(np.uint64)
            keep = np.where(left == 8, ~np.uint64(0), (np.uint64(1) << (left * np.uint64(8))) - np.uint64(1))
            with np.errstate(over="ignore"):
                state[own] = _mix(state[own] * _A + (words[at + 8 * part] & keep))
            part += 1
            more = self.sizes[own] > 8 * part
            own, at = own[more], at[more]
        for i in np.flatnonzero(self.sizes > LONG_WORD).tolist():
            word = self.raw[self.starts[i] : self.starts[i] + self.sizes[i]].tobytes()
            state[i] = np.uint64(xxhash.xxh3_64_intdigest(word, int(state[i])))
        return np.where(state == 0, np.uint64(1), state)

    def text_of(self, which: np.ndarray) -> pa.Array:
        """The words at some places."""
        sizes = self.sizes[which]
        ends = np.cumsum(sizes)
        places = np.repeat(self.starts[which] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        offsets = np.concatenate(([0], ends)).astype(np.int64)
        data = pa.py_buffer(self.raw[places].tobytes())
        return pa.Array.from_buffers(pa.large_string(), len(which), [None, pa.py_buffer(offsets.tobytes()), data])


def slabs(batches: Iterable[pa.RecordBatch], seed: int) -> Iterator[tuple[Slab, np.ndarray]]:
    """Slabs of whole texts, with the language of each text, from batches of (language, text)."""
    for batch in batches:
        languages = np.array(batch.column(0).to_pylist(), object)
        seeds = {x: np.uint64(xxhash.xxh3_64_intdigest(x.encode(), seed)) for x in set(languages.tolist())}
        numbers = np.array([seeds[x] for x in languages], np.uint64)
        raw, bounds = text_bytes(batch.column(1))
        first = 0
        while first + 1 < len(bounds):
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + SLAB_BYTES, "right")) - 1)
            low, high = bounds[first], bounds[last]
            if high > low:
                slab = Slab(raw[low:high], bounds[first : last + 1] - low, numbers[first:last])
                if len(slab.ids):
                    yield slab, languages[first:last]
            first = last
        give_back()


class Stripes:
    """Counts of rows of word ids, kept as sorted arrays and handed on when they are many."""

    def __init__(self, names: list[str]):
        self.names, self.held, self.size = names, [], 0

    def add(self, columns: list[np.ndarray], counts: np.ndarray | None = None) -> None:
        if len(columns[0]):
            ones = np.ones(len(columns[0]), np.int64) if counts is None else counts
            self.held.append([np.asarray(c, np.uint64) for c in columns] + [ones])
            self.size += len(columns[0])

    def full(self) -> bool:
        return self.size > HELD

    def merged(self) -> Iterator[pa.RecordBatch]:
        """What is held, merged elementwise, as batches; then nothing is held."""
        if not self.held:
            return
        *columns, counts = [np.concatenate(c) for c in zip(*self.held)]
        self.held, self.size = [], 0
        order = np.argsort(key_of(columns))
        columns, counts = [c[order] for c in columns], counts[order]
        new = np.ones(len(counts), bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        at = np.flatnonzero(new)
        out = [c[at].view(np.int64) for c in columns] + [np.add.reduceat(counts, at)]
        for low in range(0, len(at), BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(c[low : low + BATCH]) for c in out], [*self.names, "n"])


class Filter:
    """A Bloom filter of fixed size, of two bits for each key: a key's first and last bits."""

    SIZE = 1 << FILTER_BITS

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return keys >> np.uint64(64 - FILTER_BITS), keys & np.uint64((1 << FILTER_BITS) - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for place in self.places(keys):
            found &= (self.bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) != 0
        return found

    @classmethod
    def of(cls, rows: DataFrame) -> Filter:
        """The filter of the keys of all rows; at most its own size comes to the driver."""

        def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = key_of([c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns])
                places = np.concatenate(cls.places(keys))
                bits = (np.uint64(1) << (places & np.uint64(63))).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((places >> np.uint64(6)).astype(np.int64)), pa.array(bits)], ["at", "bits"]
                )

        table = rows.mapInArrow(parts, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
        bits = np.zeros(cls.SIZE // 64, np.uint64)
        bits[table["at"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
        return cls(bits)


def count_words(texts: DataFrame, seed: int) -> DataFrame:
    """Every word of every language: id, lang, word, n."""

    def words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]] = []

        def merged() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            ids, counts = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            text = pa.concat_arrays([h[2] for h in held])
            language = np.concatenate([h[3] for h in held])
            held.clear()
            own, first, at = np.unique(ids, return_index=True, return_inverse=True)
            sums = np.bincount(at, counts).astype(np.int64)
            for low in range(0, len(own), BATCH):
                which = first[low : low + BATCH]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(own[low : low + BATCH].view(np.int64)),
                        pa.array(language[which], pa.string()),
                        text.take(pa.array(which)).cast(pa.string()),
                        pa.array(sums[low : low + BATCH]),
                    ],
                    ["id", "lang", "word", "n"],
                )

        for slab, languages in slabs(batches, seed):
            own, first, counts = np.unique(slab.ids, return_index=True, return_counts=True)
            held.append((own, counts, slab.text_of(first), languages[slab.text[first]]))
            if sum(len(h[0]) for h in held) > HELD // 4:
                yield from merged()
        yield from merged()

    rows = texts.mapInArrow(words, "id long, lang string, word string, n long")
    return rows.groupBy("id", "lang", "word").agg(F.sum("n").alias("n"))


def count_pairs(texts: DataFrame, seed: int, frequent: Filter, least: int) -> DataFrame:
    """Stripes of one word: w1, next, n, of at least `least`; next 0 counts the word itself."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent)

    def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripes = Stripes(["w1", "next"])
        for slab, _ in slabs(batches, seed):
            known = shared.value.has(slab.ids)
            own, counts = np.unique(slab.ids[known], return_counts=True)
            stripes.add([own, np.zeros(len(own), np.uint64)], counts)
            at = np.flatnonzero(known[:-1] & known[1:] & slab.follows[:-1])
            stripes.add([slab.ids[at], slab.ids[at + 1]])
            if stripes.full():
                yield from stripes.merged()
        yield from stripes.merged()

    rows = texts.mapInArrow(pairs, "w1 long, next long, n long")
    return rows.groupBy("w1", "next").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def count_chains(texts: DataFrame, seed: int, frequent: Filter, least: int) -> DataFrame:
    """Stripes of two and three words whose neighbours are frequent pairs: w1, w2, w3 (0 in
    a prefix of two), next, n."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent)

    def chains(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripes = Stripes(["w1", "w2", "w3", "next"])
        for slab, _ in slabs(batches, seed):
            ids = slab.ids
            pair = slab.follows[:-1].copy()
            at = np.flatnonzero(pair)
            pair[at] = shared.value.has(key_of([ids[at], ids[at + 1]]))
            at = np.flatnonzero(pair[:-1] & pair[1:])
            stripes.add([ids[at], ids[at + 1], np.zeros(len(at), np.uint64), ids[at + 2]])
            at = np.flatnonzero(pair[:-2] & pair[1:-1] & pair[2:])
            stripes.add([ids[at], ids[at + 1], ids[at + 2], ids[at + 3]])
            if stripes.full():
                yield from stripes.merged()
        yield from stripes.merged()

    rows = texts.mapInArrow(chains, "w1 long, w2 long, w3 long, next long, n long")
    return rows.groupBy("w1", "w2", "w3", "next").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _word_table(texts: DataFrame, least: int, name: str) -> tuple[DataFrame, int]:
    """The words under a seed with which no frequent word shares its id with another one."""
    for seed in range(8):
        words = stored(count_words(texts, seed), f"{name}-words")
        shared = words.groupBy("id").agg(F.count(F.lit(1)).alias("words"), F.max("n").alias("n"))
        if shared.where((F.col("words") > 1) & (F.col("n") >= least)).isEmpty():
            return words, seed
    raise ValueError("word ids collide under every seed")


def mine(
    docs: DataFrame,
    least: int,
    top: int,
    covered_percent: int = 80,
    lang_col: str = "lang",
    text_col: str = "text",
) -> DataFrame:
    """The first `top` phrases of two to four words of each language: lang, rank, phrase, a,
    l, r, n, score.

    Texts are lower-cased (A-Z), split into pieces at `[.,;:!?]` and line ends, and pieces
    into words at blanks and tabs. A phrase counts if it occurs `least` times (a); cut after
    its first words, the parts occur l and r times, and the score is floor(2000000 a / (l + r))
    at the cut where it is lowest, the first of equal ones. A phrase inside a longer one that
    has at least `covered_percent` of its count is left out. n counts all words of the language.

    A null language is "und", a null or empty text has no words; repeated rows count each
    time; ties are ordered by count and by the phrase's bytes; an empty table, or one without
    frequent phrases, gives no rows. Other columns are not read. A text is read whole, in one task."""
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text"))
    words, seed = _word_table(texts, least, "collocations")
    frequent = words.where(F.col("n") >= least)
    pairs = stored(count_pairs(texts, seed, Filter.of(frequent.select("id")), least), "collocations-pairs")
    is_pair = F.col("next") != 0
    chained = Filter.of(pairs.where(is_pair).select("w1", "next"))
    chains = stored(count_chains(texts, seed, chained, least), "collocations-chains")

    # Every frequent phrase by its word ids: elements of the stripes, and their totals.
    short = F.when(is_pair, F.array("w1", "next")).otherwise(F.array("w1"))
    longer = F.when(F.col("w3") != 0, F.array("w1", "w2", "w3", "next")).otherwise(F.array("w1", "w2", "next"))
    phrases = pairs.select(short.alias("ids"), "n").unionByName(chains.select(longer.alias("ids"), "n"))
    size = F.size("ids")
    candidates = phrases.where(size > 1).withColumnRenamed("n", "a")

    # The largest extension by one word, to the right and to the left.
    ends = F.array(F.expr("slice(ids, 1, size(ids) - 1)"), F.expr("slice(ids, 2, size(ids) - 1)"))
    covers = candidates.where(size > 2).select(F.explode(ends).alias("ids"), "a")
    covers = covers.groupBy("ids").agg(F.max("a").alias("longest"))
    exact = "decimal(20,0)"
    covered = F.lit(100).cast("decimal(3,0)") * F.col("longest").cast(exact) >= F.lit(covered_percent).cast(
        "decimal(3,0)"
    ) * F.col("a").cast(exact)
    kept = candidates.join(covers, "ids", "left").where(F.col("longest").isNull() | ~covered).drop("longest")

    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    part = phrases.select(F.col("ids").alias("part"), F.col("n").alias("f"))
    for name, start, count in (("l", "1", "k"), ("r", "k + 1", "size(ids) - k")):
        cuts = cuts.withColumn("part", F.expr(f"slice(ids, {start}, {count})"))
        cuts = cuts.join(part.withColumnRenamed("f", name), "part").drop("part")
    score = F.expr(f"CAST(2000000 AS decimal(7,0)) * CAST(a AS {exact}) DIV (CAST(l AS {exact}) + CAST(r AS {exact}))")
    best = cuts.withColumn("score", score).groupBy("ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))

    named = best.select("ids", "a", "b.l", "b.r", "b.score", F.posexplode("ids").alias("place", "id"))
    named = named.join(frequent.select("id", "lang", "word"), "id")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"])
    named = named.groupBy("ids", "a", "l", "r", "score").agg(
        F.min("lang").alias("lang"), F.array_join(in_order, " ").alias("phrase")
    )
    first = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = named.withColumn("rank", F.row_number().over(first).cast("long")).where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mine_sql(least: int, top: int) -> str:
    """The same rows in SQL over `documents`."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    grams = " UNION ALL ".join(
        f"SELECT lang, {m} AS m, array_to_string(ws[i:i + {m - 1}], ' ') AS ph FROM "
        f"(SELECT lang, ws, unnest(range(1, len(ws) - {m - 1} + 1)) AS i FROM w)"
        for m in range(1, 5)
    )
    return f"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{upper}', '{lower}') AS t FROM documents),
    p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
    w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p),
    f AS (SELECT lang, m, ph, count(*) AS f FROM ({grams}) GROUP BY ALL),
    c AS (SELECT lang, m, ph, string_split(ph, ' ') AS ws, f AS a FROM f WHERE m > 1 AND f >= {least}),
    x AS (SELECT lang, ph, max(a) AS longest FROM (
        SELECT lang, array_to_string(ws[1:m - 1], ' ') AS ph, a FROM c WHERE m > 2 UNION ALL
        SELECT lang, array_to_string(ws[2:m], ' ') AS ph, a FROM c WHERE m > 2) GROUP BY ALL),
    q AS (SELECT c.lang, c.ph, c.a, c.ws, c.m, unnest(range(1, c.m)) AS k FROM c LEFT JOIN x ON c.lang = x.lang AND c.ph = x.ph
        WHERE x.longest IS NULL OR 100::HUGEINT * x.longest < 80::HUGEINT * c.a),
    s AS (SELECT q.lang, q.ph, q.a, q.k, g.f AS l, h.f AS r, CAST(2000000::HUGEINT * q.a // (g.f + h.f) AS BIGINT) AS score
        FROM q JOIN f g ON g.lang = q.lang AND g.ph = array_to_string(q.ws[1:q.k], ' ')
        JOIN f h ON h.lang = q.lang AND h.ph = array_to_string(q.ws[q.k + 1:q.m], ' ')),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1),
    t AS (SELECT lang, count(*) AS n FROM (SELECT lang, unnest(ws) FROM w) GROUP BY lang)
    SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.ph) AS rank, b.ph AS phrase,
        b.a, b.l, b.r, t.n, b.score FROM b JOIN t ON b.lang = t.lang QUALIFY rank <= {top}"""
