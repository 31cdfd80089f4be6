"""Mixing sources to target weights.

Words are packed into fixed-length blocks, source by source. Each output shard draws how
many blocks it takes from each source; its slots are numbered through per source, slot
numbers go through a pseudorandom permutation of the source's blocks (a new one for each
pass over the source), and the blocks are joined by index. Nothing but one row per
source, like the weights themselves, passes through the driver."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import running_total, stored

WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a bucket and shards of a group when running totals are made.
BUCKET_ROWS, GROUP_SHARDS = 20_000, 1_000
#: Slots that one task makes of the draws.
TASK_SLOTS = 400_000


@dataclass
class Source:
    number: int
    source: str | None
    weight: int
    size: int
    target: float
    blocks: int

    @property
    def slots(self) -> float:
        """Blocks to take, so that their words come to the target."""
        return self.target / self.size * self.blocks if self.size else 0.0


def shares(sizes: list[int], weights: list[int], most: float) -> list[float]:
    """Shares of the sum of `sizes` by weight, none above `most` times its size: what
    is cut off goes to the others by weight, until none is above."""
    left, weight = float(sum(sizes)), float(sum(weights))
    targets = [0.0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i] / weights[i], i))
    for at, i in enumerate(order):
        if left * weights[i] <= most * sizes[i] * weight:
            for j in order[at:]:
                targets[j] = left * weights[j] / weight
            break
        targets[i] = float(most * sizes[i])
        left -= targets[i]
        weight -= weights[i]
    return targets


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Image of index[i] under the permutation of 0 .. size[i] - 1 that key[i] names:
    four Feistel rounds on the next power of four, walked until inside."""
    half = np.ceil(np.log2(np.maximum(size, 2)) / 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, waiting = index.astype(np.uint64), np.arange(len(index))
    while len(waiting):
        x, h, m = out[waiting], half[waiting], mask[waiting]
        left, right = x >> h, x & m
        for turn in range(1, 5):
            with np.errstate(over="ignore"):
                noise = _mix64(key[waiting].astype(np.uint64) + right * np.uint64(0x9E3779B97F4A7C15) + np.uint64(turn))
            left, right = right, left ^ (noise & m)
        out[waiting] = (left << h) | right
        waiting = waiting[out[waiting] >= size[waiting].astype(np.uint64)]
    return out.astype(np.int64)


@dataclass
class Mix:
    """`documents`: doc_id, source, size, number, start; `parts`: number, block,
    doc_id, size, start, first_word, words; `slots`: shard, number, slot, block."""

    sources: list[Source]
    documents: DataFrame
    parts: DataFrame
    slots: DataFrame

    def source_table(self) -> DataFrame:
        rows = [(s.number, s.size, s.target, s.blocks) for s in self.sources]
        return self.documents.sparkSession.createDataFrame(
            rows, "number int, source_size long, target double, blocks long"
        )


def draw_slots(spark, sources: list[Source], shard_slots: int, most: int, seed: int) -> DataFrame:
    """All slots of all shards: shard, number (of the source), slot (of the source), block.

    A shard takes the whole part of each source's expected count and draws the rest of
    its slots by one multinomial on the fractions, seeded by its own number. Slots past
    `most` passes over a source stay empty."""
    expected = np.array([s.slots for s in sources])
    total = round(expected.sum())
    shards = -(-total // shard_slots)

    def counts(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for shard in frame["id"]:
                own = total * (shard + 1) // shards - total * shard // shards
                mean = expected / expected.sum() * own
                count = np.floor(mean).astype(np.int64)
                left = int(own - count.sum())
                if left > 0:
                    part = mean - count
                    count = count + np.random.default_rng((seed, shard)).multinomial(left, part / part.sum())
                taken = np.flatnonzero(count)
                yield pd.DataFrame({"shard": shard, "number": taken.astype(np.int32), "n": count[taken]})

    @F.pandas_udf("long")
    def block_of(number: pd.Series, slot: pd.Series, blocks: pd.Series) -> pd.Series:
        size = blocks.to_numpy()
        with np.errstate(over="ignore"):
            key = _mix64(
                np.uint64(seed)
                + number.to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                + (slot.to_numpy() // size).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
            )
        return pd.Series(permute(slot.to_numpy() % size, size, key))

    table = spark.createDataFrame([(s.number, s.blocks) for s in sources], "number int, blocks long")
    counted = spark.range(max(shards, 0)).mapInPandas(counts, "shard long, number int, n long")
    counted = stored(counted.withColumn("group", F.expr(f"shard div {GROUP_SHARDS}")), "draws")
    first = running_total(counted, ["number"], "group", [F.col("shard")], "n", "first")
    # A row becomes as many slots as it counts: spread the rows by the number of slots.
    slots = first.repartition(1 + total // TASK_SLOTS, "shard").select(
        "shard", "number", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("slot")
    )
    return (
        slots.join(F.broadcast(table), "number")
        .where(F.col("slot") < most * F.col("blocks"))
        .select("shard", "number", "slot", block_of("number", "slot", "blocks").alias("block"))
    )


def mix_sources(
    docs: DataFrame,
    block_words: int,
    shard_slots: int,
    most: int = 3,
    weights: tuple[int, ...] = (1, 2, 3),
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> Mix:
    """Plans the mix. Sources by code point, null last, weigh `weights` in turn.

    A null text has no words; a null source is a source; documents without words are
    kept with size 0; repeated rows are documents of their own; an empty table gives no
    slots; other columns are not read. The same rows and seed give the same mix,
    whatever the partitions: documents are packed by a hash of id and text."""
    spark = docs.sparkSession
    words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    sizes = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            words.alias("size"),
            F.xxhash64(id_col, text_col).alias("key"),
        ),
        "sizes",
    )
    sums = sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()
    sums.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    weight = [weights[i % len(weights)] for i in range(len(sums))]
    targets = shares([r["size"] for r in sums], weight, most)
    sources = [
        Source(i, r["source"], weight[i], r["size"], targets[i], -(-r["size"] // block_words))
        for i, r in enumerate(sums)
    ]
    buckets = 1 + sum(r["rows"] for r in sums) // BUCKET_ROWS
    numbers = spark.createDataFrame([(s.source, s.number) for s in sources], "source string, number int")
    named = sizes.join(
        F.broadcast(numbers.withColumnRenamed("source", "_source")), F.col("source").eqNullSafe(F.col("_source"))
    ).drop("_source")
    documents = running_total(
        named.withColumn("bucket", F.pmod(F.col("key"), F.lit(buckets))),
        ["number"],
        "bucket",
        [F.col("key"), F.col("doc_id"), F.col("size")],
        "size",
        "start",
    ).select("doc_id", "source", "size", "number", "start")
    documents = stored(documents, "packed")
    last = F.expr(f"(start + size - 1) div {block_words}")
    parts = (
        documents.where("size > 0")
        .withColumn("block", F.explode(F.sequence(F.expr(f"start div {block_words}"), last)))
        .withColumn("first_word", F.greatest(F.lit(0), F.col("block") * block_words - F.col("start")))
        .withColumn(
            "words", F.least("size", (F.col("block") + 1) * block_words - F.col("start")) - F.col("first_word")
        )
        .select("number", "block", "doc_id", "size", "start", "first_word", "words")
    )
    return Mix(sources, documents, parts, draw_slots(spark, sources, shard_slots, most, seed))


def taken_words(mix: Mix) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken."""
    times = mix.slots.groupBy("number", "block").agg(F.count("*").alias("times"))
    taken = (
        mix.parts.join(times, ["number", "block"])
        .groupBy("number", "start")
        .agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    )
    found = mix.documents.where("size > 0").join(taken, ["number", "start"], "left")
    empty = mix.documents.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return (
        found.unionByName(empty)
        .join(F.broadcast(mix.source_table()), "number")
        .select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
    )


def mixed_blocks(mix: Mix, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mix itself: shard, number, slot, and the words of the slot's block, joined by
    spaces. Texts are looked up by id, which must be unique here."""
    listed = F.regexp_extract_all(F.col(text_col), F.lit(f"({WORD})"), F.lit(1))
    texts = docs.select(F.col(id_col).alias("doc_id"), listed.alias("all"))
    pieces = mix.parts.join(texts, "doc_id").select(
        "number",
        "block",
        F.struct("start", F.slice("all", F.col("first_word") + 1, F.col("words")).alias("words")).alias("piece"),
    )
    blocks = pieces.groupBy("number", "block").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    return mix.slots.join(blocks, ["number", "block"]).select(
        "shard", "number", "slot", F.array_join(F.flatten("pieces.words"), " ").alias("text")
    )
