"""Benchmark decontamination by a positional inverted index.

The corpus is indexed once: each segment (about a megabyte of whole documents) is a row
with its terms, and for each term the sorted places where it stands. Test phrases are
then answered from the stored lists alone: the list of a phrase's rarest term in the
segment proposes where the phrase may start, and the lists of its other terms, moved by
their offsets and taken from rare to common, are intersected with it. With a slop, a
term may stand so many words off its place (proximity). The index grows with the corpus
and stays distributed; the test phrases are read in blocks of a fixed size, and only one
block is broadcast at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.llm.common import give_back, stored
from ticketlens.llm.words import text_bytes, word_hashes

#: Bytes of text in a segment, phrases in a block, places checked at a time.
SEGMENT_BYTES, BLOCK_PHRASES, CHECKED = 1_000_000, 100_000, 500_000


def build_index(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per segment: part, number, doc_ids, first_words (int32), terms (uint64,
    sorted), term_starts (int32), postings (int32). Arrays of numbers are binary."""
    id_type = docs.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField("segment", T.LongType()),
            T.StructField("doc_ids", T.ArrayType(id_type)),
            *(T.StructField(n, T.BinaryType()) for n in ("first_words", "terms", "term_starts", "postings")),
        ]
    )

    def segments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            raw, bounds = text_bytes(texts)
            start = 0
            while start < len(ids):
                end = max(start + 1, int(np.searchsorted(bounds, bounds[start] + SEGMENT_BYTES, "right")) - 1)
                end = min(end, len(ids))
                hashes, first = word_hashes(raw[bounds[start] : bounds[end]], bounds[start : end + 1] - bounds[start])
                order = np.argsort(hashes, kind="stable")
                terms, begins = np.unique(hashes[order], return_index=True)
                arrays = [first, terms, np.append(begins, len(order)), order]
                kinds = [np.int32, np.uint64, np.int32, np.int32]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number], pa.int64()),
                        pa.ListArray.from_arrays(pa.array([0, end - start], pa.int32()), ids.slice(start, end - start)),
                        *(pa.array([a.astype(k).tobytes()], pa.binary()) for a, k in zip(arrays, kinds)),
                    ],
                    names=schema.names,
                )
                number, start = number + 1, end
            del raw, bounds, ids, texts
            give_back()

    return stored(docs.select(id_col, text_col).mapInArrow(segments, schema), "index")


@dataclass
class Phrases:
    """Distinct windows of test items: terms (padded), lengths, and the items of each."""

    terms: np.ndarray
    lengths: np.ndarray
    item_starts: np.ndarray
    items: list[str]


def phrases_of(items: list[tuple[str | None, str | None]], window: int) -> Phrases:
    """All windows of `window` words; an item of fewer words, but not none, is one window."""
    raw, bounds = text_bytes(pa.array([t for _, t in items], pa.string()))
    hashes, first = word_hashes(raw, bounds)
    rows, names, lengths = [], [], []
    for (item, _), a, b in zip(items, first[:-1], first[1:]):
        words = hashes[a:b]
        if not len(words):
            continue
        size = min(window, len(words))
        views = np.lib.stride_tricks.sliding_window_view(words, size)
        rows.append(np.pad(views, ((0, 0), (0, window - size))))
        lengths.append(np.full(len(views), size))
        names.extend([item] * len(views))
    if not rows:
        return Phrases(np.zeros((0, window), np.uint64), np.zeros(0, np.int64), np.zeros(1, np.int64), [])
    keyed = np.column_stack([np.concatenate(rows), np.concatenate(lengths).astype(np.uint64)])
    distinct, inverse = np.unique(keyed, axis=0, return_inverse=True)
    pairs = sorted({(int(w), n) for w, n in zip(inverse, names) if n is not None})
    starts = np.searchsorted([w for w, _ in pairs], np.arange(len(distinct) + 1))
    return Phrases(distinct[:, :-1], distinct[:, -1].astype(np.int64), starts, [n for _, n in pairs])


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers starts[i], ..., starts[i] + counts[i] - 1 for all i, in one array."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def find(
    terms: np.ndarray, term_starts: np.ndarray, postings: np.ndarray, first_words: np.ndarray, phrases: Phrases, slop: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase, first word, document) of all occurrences in a segment, with all words inside
    the document of the rarest one. With a slop, the first word is where it would stand if
    none were off its place, which may be outside the document."""
    width = phrases.terms.shape[1]
    used = np.arange(width) < phrases.lengths[:, None]
    known = np.searchsorted(terms, phrases.terms)
    known = np.minimum(known, max(len(terms) - 1, 0))
    if not len(terms) or not len(phrases.lengths):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    present = (terms[known] == phrases.terms) | ~used
    alive = np.flatnonzero(present.all(axis=1))
    known, used = known[alive], used[alive]
    counts = np.diff(term_starts)
    sizes = np.where(used, counts[known], np.iinfo(np.int64).max)
    order = np.argsort(sizes, axis=1, kind="stable")
    total = len(postings) + 1
    # Lists of all terms in one sorted array: term number, then place.
    places = np.repeat(np.arange(len(terms)), counts) * total + postings
    rarest = np.take_along_axis(sizes, order[:, :1], axis=1)[:, 0] if len(alive) else np.zeros(0, np.int64)
    found_phrase, found_start, found_doc = [], [], []
    chunk = np.cumsum(rarest) // CHECKED
    for cut in np.split(np.arange(len(alive)), np.flatnonzero(np.diff(chunk)) + 1):
        if not len(cut):
            continue
        term = known[cut, order[cut, 0]]
        phrase = np.repeat(cut, counts[term])
        place = postings[_ranges(term_starts[term], counts[term])]
        start = place - np.repeat(order[cut, 0], counts[term])
        doc = np.searchsorted(first_words, place, "right") - 1
        for step in range(1, width):
            if not len(phrase):
                break
            offset = order[phrase, step]
            asked = used[phrase, offset]
            term = known[phrase, offset]
            lowest = term * total + np.maximum(start + offset - slop, first_words[doc])
            highest = term * total + np.minimum(start + offset + slop, first_words[doc + 1] - 1)
            at = np.minimum(np.searchsorted(places, lowest), len(places) - 1)
            near = (places[at] >= lowest) & (places[at] <= highest)
            keep = near | ~asked
            phrase, start, doc = phrase[keep], start[keep], doc[keep]
        found_phrase.append(alive[phrase])
        found_start.append(start)
        found_doc.append(doc)
    if not found_phrase:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_phrase), np.concatenate(found_start), np.concatenate(found_doc)


_HITS = "segment long, doc int, spans array<struct<a:int,b:int>>, items array<string>, near array<string>"


def phrase_hits(index: DataFrame, phrases: Phrases, slop: int) -> DataFrame:
    """Documents with exact or near occurrences: the spans of words hit exactly, the
    items with exact occurrences and those with occurrences within the slop."""
    shared = index.sparkSession.sparkContext.broadcast(phrases)

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Phrases = shared.value
        for batch in batches:
            for place in range(batch.num_rows):
                row = batch.slice(place, 1).to_pylist()[0]
                first, terms, begins, postings = (
                    np.frombuffer(row[n], k).astype(k if k is np.uint64 else np.int64)
                    for n, k in (("first_words", np.int32), ("terms", np.uint64), ("term_starts", np.int32), ("postings", np.int32))
                )
                out: dict[int, tuple[list, set, set]] = {}
                for which, off in ((1, 0), (2, slop)) if slop else ((1, 0),):
                    phrase, start, doc = find(terms, begins, postings, first, asked, off)
                    for d, p in set(zip(doc.tolist(), phrase.tolist())):
                        names = asked.items[asked.item_starts[p] : asked.item_starts[p + 1]]
                        found = out.setdefault(d, ([], set(), set()))
                        found[which].update(names)
                        if not slop:  # an occurrence within no words is an exact one
                            found[2].update(names)
                    if which == 1 and len(start):
                        edge = np.zeros(len(postings) + 1, np.int64)
                        np.add.at(edge, start, 1)
                        np.add.at(edge, start + asked.lengths[phrase], -1)
                        hit = np.concatenate(([False], np.cumsum(edge) > 0))
                        turns = np.flatnonzero(np.diff(hit))
                        # A run of hit words may go on in the next document: cut there.
                        for d in set(doc.tolist()):
                            a, b = first[d], first[d + 1]
                            inside = np.flatnonzero(hit[1:][a:b])
                            breaks = np.flatnonzero(np.diff(inside) > 1) if len(turns) else []
                            lows = inside[np.concatenate(([0], np.asarray(breaks, int) + 1))]
                            highs = inside[np.concatenate((np.asarray(breaks, int), [len(inside) - 1]))] + 1
                            out[d][0].extend({"a": int(x), "b": int(y)} for x, y in zip(lows, highs))
                if out:
                    yield pa.RecordBatch.from_pylist(
                        [
                            {"segment": row["segment"], "doc": d, "spans": s, "items": sorted(i), "near": sorted(n)}
                            for d, (s, i, n) in out.items()
                        ],
                        schema=pa.schema(
                            [
                                ("segment", pa.int64()),
                                ("doc", pa.int32()),
                                ("spans", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))),
                                ("items", pa.list_(pa.string())),
                                ("near", pa.list_(pa.string())),
                            ]
                        ),
                    )
                del row, first, terms, begins, postings
            give_back()

    return index.select("segment", "first_words", "terms", "term_starts", "postings").mapInArrow(search, _HITS)


def _blocks(items: DataFrame, id_col: str, text_col: str, window: int) -> Iterator[Phrases]:
    """Test items as they come, so many at a time that a block has a bounded size."""
    held: list[tuple[str | None, str | None]] = []
    size = 0
    rows = items.select(F.col(id_col).cast("string"), text_col).where(F.col(text_col).isNotNull())
    for item, text in rows.toLocalIterator():
        held.append((item, text))
        size += len(text) // 2 + 1
        if size >= BLOCK_PHRASES:
            yield phrases_of(held, window)
            held, size = [], 0
    if held:
        yield phrases_of(held, window)


def contamination(
    docs: DataFrame,
    items: DataFrame,
    window: int = 10,
    slop: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_hit (words inside any occurrence of
    a window), n_items (items with occurring windows), items (their ids as sorted
    strings), spans (runs of hit words, end exclusive), contaminated, and n_near (items
    with a window whose words each stand at most `slop` words off).

    Null and empty texts have no words and no hits; repeated rows of either table stay
    repeated or count once as an item; an item without id hits words but is not listed;
    items without words, an empty table of items and an empty corpus give no hits. Other
    columns are not read. No phrase, document or occurrence is left out."""
    spark: SparkSession = docs.sparkSession
    index = build_index(docs, id_col, text_col)
    hits = spark.createDataFrame([], _HITS)
    for block in _blocks(items, item_id_col, item_text_col, window):
        hits = hits.union(stored(phrase_hits(index, block, slop), "hits"))
    per_doc = hits.groupBy("segment", "doc").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"),
    )

    def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in range(batch.num_rows):
                first = np.frombuffer(batch.column(2)[number].as_py(), np.int32).astype(np.int64)
                ids = batch.column(1)[number].values
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(ids), batch.column(0)[number].as_py(), np.int64)),
                        pa.array(np.arange(len(ids), dtype=np.int32)),
                        ids,
                        pa.array(np.diff(first)),
                    ],
                    names=["segment", "doc", "doc_id", "n_words"],
                )

    id_type = docs.schema[id_col].dataType.simpleString()
    all_docs = index.select("segment", "doc_ids", "first_words").mapInArrow(
        listed, f"segment long, doc int, doc_id {id_type}, n_words long"
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(s["b"] - F.greatest(s["a"], acc["end"]), F.lit(0))).alias("n"),
            F.greatest(acc["end"], s["b"]).alias("end"),
        ),
        lambda acc: acc["n"],
    )
    nothing = F.array().cast("array<string>")
    return (
        all_docs.join(per_doc, ["segment", "doc"], "left")
        .withColumn("n_hit", F.coalesce(covered, F.lit(0)))
        .withColumn("items", F.coalesce("items", nothing))
        .select(
            "doc_id",
            "n_words",
            "n_hit",
            F.size("items").cast("long").alias("n_items"),
            "items",
            F.coalesce("spans", F.array().cast("array<struct<a:int,b:int>>")).alias("spans"),
            (F.col("n_hit") > 0).alias("contaminated"),
            F.size(F.coalesce("near", nothing)).cast("long").alias("n_near"),
        )
    )


def without_contaminated(
    docs: DataFrame,
    items: DataFrame,
    window: int = 10,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """`docs` without the rows whose text holds a window of a test item. All columns stay,
    whatever their names; rows are told apart by their texts, so ids may repeat or be null."""
    key = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    texts = docs.select(key.alias("key"), F.col(text_col).alias("text"))
    found = contamination(texts, items, window, 0, "key", "text", item_id_col, item_text_col)
    bad = stored(found.where("contaminated").select(F.col("doc_id").alias("key")).distinct(), "contaminated")
    rows = docs.select(F.struct("*").alias("row"), key.alias("key"))
    return rows.join(bad, "key", "left_anti").select("row.*")
