"""SimHash near-duplicates, linked through BK-trees.

Texts become 64-bit fingerprints. Fingerprints within `radius` bits agree on one of
`radius + 1` bit bands, so each distinct fingerprint goes to one shard per band. A
shard is a BK-tree: children are keyed by their Hamming distance to the parent, and a
search follows only edges within the radius. Trees grow with the corpus, so they are
never broadcast through the driver: the shuffle brings each tree and its queries
together. A shard above a bound is cut into slots, and each pair of slots is a tree of
its own. Only a spanning forest of the links leaves a shard, not all pairs."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import give_back, stored, whole_groups

#: Fingerprints of one slot of a shard; a tree holds two slots at most.
SLOT = 8192
#: Fingerprints searched at a time, and fingerprints of a batch of whole trees.
QUERIES, BATCH = 512, 50_000
SEED = 42


def fingerprint(text: str | None, shingle: int) -> int:
    """SimHash of the shingles of `shingle` words; 0 for a text without words."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (
            digest(joined[a:b], SEED)
            for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
        ),
        np.uint64,
        len(words) - size + 1,
    )
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprint_column(text: Column, shingle: int) -> Column:
    """The fingerprint of a text column as a signed long."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        prints = pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")
        give_back()
        return prints

    return of(text)


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the sets of a[i] and b[i] are joined; a label is the least index of its set."""
    while True:
        first, second = label[a], label[b]
        apart = first != second
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        low, high = np.minimum(first, second)[apart], np.maximum(first, second)[apart]
        np.minimum.at(label, high, low)
        while not np.array_equal(label, shorter := label[label]):
            label = shorter


def bk_forest(shard: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Children by (parent, distance), -1 where there is none. One tree per shard;
    its root is the shard's first fingerprint. Built level by level."""
    child = np.full((len(prints), 65), -1, np.int32)
    waiting = np.arange(len(prints))
    group = shard
    parent = distance = None
    while len(waiting):
        _, first, group = np.unique(group, return_index=True, return_inverse=True)
        nodes = waiting[first]
        if parent is not None:
            child[parent[first], distance[first]] = nodes
        rest = np.ones(len(waiting), bool)
        rest[first] = False
        waiting, group = waiting[rest], group[rest]
        parent = nodes[group]
        distance = np.bitwise_count(prints[waiting] ^ prints[parent]).astype(np.int64)
        group = group * 65 + distance
    return child


def linked(shard: np.ndarray, prints: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint the least index of those it is linked with, in its shard."""
    child = bk_forest(shard, prints)
    _, first, inverse = np.unique(shard, return_index=True, return_inverse=True)
    roots = first[inverse]
    label = np.arange(len(prints))
    for at in range(0, len(prints), QUERIES):
        query = np.arange(at, min(at + QUERIES, len(prints)))
        node = roots[query]
        while len(query):
            distance = np.bitwise_count(prints[query] ^ prints[node]).astype(np.int64)
            near = distance <= radius
            label = unite(label, query[near], node[near])
            found_query, found_node = [], []
            for step in range(-radius, radius + 1):
                edge = distance + step
                fits = (edge > 0) & (edge <= 64)
                to = child[node[fits], edge[fits]]
                found_query.append(query[fits][to >= 0])
                found_node.append(to[to >= 0])
            query, node = np.concatenate(found_query), np.concatenate(found_node)
    return label


def _bands(print_: Column, radius: int) -> Column:
    """(band, its bits) of a fingerprint, one for each of radius + 1 bands."""
    parts, start = [], 0
    for band in range(radius + 1):
        width = (64 - start) // (radius + 1 - band)
        bits = F.shiftrightunsigned(print_, start).bitwiseAND(F.lit((1 << width) - 1))
        parts.append(F.struct(F.lit(band).alias("band"), bits.alias("bits")))
        start += width
    return F.explode(F.array(*parts))


def links(prints: DataFrame, radius: int) -> DataFrame:
    """From distinct `fp` to (low, high): links whose components are those of all
    pairs within `radius` bits. At most one row leaves for each fingerprint and tree."""
    shards = prints.select("fp", _bands(F.col("fp"), radius).alias("s")).select("fp", "s.*")
    large = shards.groupBy("band", "bits").count().where(F.col("count") > SLOT)
    slots = F.ceil(F.col("count") / SLOT).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("slots")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("slots") - 1),
        lambda other: F.struct(F.least(own, other).alias("i"), F.greatest(own, other).alias("j")),
    )
    cells = (
        shards.join(large.select("band", "bits", slots.alias("slots")), ["band", "bits"], "left")
        .withColumn("slots", F.coalesce("slots", F.lit(1)))
        .select("fp", "band", "bits", F.explode(pairs).alias("cell"))
        .select("fp", "band", "bits", "cell.i", "cell.j")
    )
    keys = ["band", "bits", "i", "j"]

    def search(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(batches, keys, BATCH):
            shard = frame.groupby(keys, sort=False).ngroup().to_numpy()
            fps = frame["fp"].to_numpy()
            label = linked(shard, fps.view(np.uint64), radius)
            other = label != np.arange(len(label))
            yield pd.DataFrame({"low": fps[label[other]], "high": fps[other]})

    return cells.repartition(*keys).sortWithinPartitions(*keys, "fp").mapInPandas(search, "low long, high long")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """From undirected edges (low, high) to (node, root), root the least node of the
    component. Alternating large and small stars; each round is stored, since lineage
    would grow. All steps are joins and aggregates that split hot nodes."""
    edges = stored(
        edges.where("low != high")
        .select(F.greatest("low", "high").alias("node"), F.least("low", "high").alias("root"))
        .distinct(),
        "edges",
    )
    before = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.min("root").alias("to"))
        larger = (
            both.join(least, "node")
            .where("root > node")
            .select(F.col("root").alias("node"), F.least("to", "node").alias("root"))
            .distinct()
        )
        least = larger.groupBy("node").agg(F.min("root").alias("to"))
        smaller = larger.join(least, "node").where("root != to").select(F.col("root").alias("node"), F.col("to").alias("root"))
        edges = stored(smaller.union(least.select("node", F.col("to").alias("root"))).distinct(), "edges")
        now = edges.agg(
            F.count("*"),
            F.sum(F.xxhash64("node", "root").cast("decimal(38,0)")),
        ).first()
        if now == before:
            return edges
        before = now
    raise RuntimeError("components did not settle")


def _rooted(prints: DataFrame, radius: int) -> DataFrame:
    """From (doc_id, fp) to (fp, least doc_id, root of its component)."""
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct.select("fp"), radius))
    return distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )


def near_duplicates(
    docs: DataFrame,
    shingle: int,
    radius: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of `docs`: doc_id, fingerprint (16 hex digits), component_id
    (the least doc_id reachable through links of at most `radius` bits).

    Null and empty texts have fingerprint zero and are linked like any other;
    repeated rows stay repeated; a null doc_id takes part, but is a component_id only
    where no other is reachable; an empty table gives an empty one. Other columns of
    `docs` are not read."""
    prints = stored(
        docs.select(F.col(id_col).alias("doc_id"), fingerprint_column(F.col(text_col), shingle).alias("fp")),
        "fingerprints",
    )
    rooted = _rooted(prints, radius)
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return prints.join(named, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(
    docs: DataFrame, shingle: int, radius: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """`docs` with one row of each component: the one with the least doc_id (null last; of
    equal rows any; of several texts under that id the one of least fingerprint, then of
    least hash). Null and empty texts have fingerprint zero and count as one component
    with what links to it; an empty table gives an empty one. All columns stay, whatever
    their names.

    Texts are fingerprinted once. Survivors are found by doc_id and a hash of the text,
    which are as many keys as there are rows, so that a group of copies has no key in common."""
    own, text_hash = F.col(id_col), F.xxhash64(F.col(text_col))
    prints = stored(
        docs.select(own.alias("doc_id"), text_hash.alias("text"), fingerprint_column(F.col(text_col), shingle).alias("fp")),
        "fingerprints",
    )
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "text")
    roots = components(links(prints.select("fp").distinct(), radius)).withColumnRenamed("node", "fp")
    chosen = (
        prints.groupBy("fp")
        .agg(F.min(order).alias("first"))
        .join(roots, "fp", "left")
        .groupBy(F.coalesce("root", "fp"))
        .agg(F.min("first").alias("first"))
        .select(F.col("first.doc_id").alias("least"), F.col("first.text").alias("text"))
    )
    rows = docs.select(F.struct("*").alias("row"), own.alias("own"), text_hash.alias("hash"))
    kept = rows.join(chosen, F.col("own").eqNullSafe(F.col("least")) & (F.col("hash") == F.col("text")))
    return kept.dropDuplicates(["own", "hash"]).select("row.*")
