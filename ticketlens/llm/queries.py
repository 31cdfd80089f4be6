"""The named queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.llm import collocations, decontaminate, langid, licenses, mixing, neighbours, pii, records, simhash, suffixes, tokens, urls, variants
from ticketlens.llm.common import table

SHINGLE, RADIUS = 4, 4
TOKEN_LIMIT = 1024
NEIGHBOURS, HASH_TABLES, PROBES = 20, 6, 24
REPEAT_BYTES = 200
BLOCK_WORDS, SHARD_SLOTS = 32, 8192
END_ID = 1
PHRASE_COUNT, PHRASES = 30, 2000
WORD_LENGTH, WORD_COUNT, DROP_EVERY = 5, 3, 97

#: Rules on hosts and paths, and names of hosts whose URLs are listed.
URL_RULES = [
    urls.Rule("net", "/", "block"),
    urls.Rule("example.net", "/en/", "allow"),
    urls.Rule("example.com", "/de/", "block"),
    urls.Rule("org", "/fr/", "allow"),
]
BAD_HOST = r"(^|\.)(adult-x|ads-track|casino-win|cheap-pills|free-bets|spam-farm)\."


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.search(vectors, vectors.where("vec_id % 20 = 0"), NEIGHBOURS, HASH_TABLES, PROBES)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated",
        "n_near",
    )


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [
        (F.size(kinds) - F.size(F.array_remove(kinds, number))).cast("long").alias(f"n_{kind}")
        for number, kind in enumerate(pii.KINDS)
    ]
    return found.withColumn("base", base).select(
        "doc_id",
        *counts,
        F.sha2(pii.spans_text(F.col("base")), 256).alias("base_sha256"),
        pii.spans_text(F.col("spans")).alias("spans"),
    )


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = suffixes.remove_repeats(table(spark, sf_dir, "documents"), REPEAT_BYTES)
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list is that of all URLs on hosts with a bad name, as the pages give them."""
    pages = table(spark, sf_dir, "pages")
    listed = pages.select("url").where(urls.host_of(F.col("url")).rlike(BAD_HOST))
    return urls.judge(pages, listed, URL_RULES)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    return tokens.token_counts(table(spark, sf_dir, "documents"), path, TOKEN_LIMIT)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), SHINGLE, RADIUS)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(table(spark, sf_dir, "documents"), BLOCK_WORDS, SHARD_SLOTS)
    return mixing.taken_words(mix).select("doc_id", "size", "source_size", "target", "taken")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"), PHRASE_COUNT, PHRASES)


def op12_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    folder = records.write_tokens(table(spark, sf_dir, "documents"), path, END_ID)
    return records.read_records(spark, folder)


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return variants.group_variants(docs, shortest=WORD_LENGTH, least=WORD_COUNT, drop_every=DROP_EVERY)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_neighbours": op1_neighbours,
    "op2_licenses": op2_licenses,
    "op3_decontamination": op3_decontamination,
    "op4_personal_data": op4_personal_data,
    "op5_repeats": op5_repeats,
    "op6_url_filter": op6_url_filter,
    "op7_token_counts": op7_token_counts,
    "op8_simhash": op8_simhash,
    "op9_language": op9_language,
    "op10_mixing": op10_mixing,
    "op11_collocations": op11_collocations,
    "op12_records": op12_records,
    "op13_variants": op13_variants,
}

ORACLE_SQL: dict[str, str] = {
    "op2_licenses": licenses.scan_sql(),
    "op6_url_filter": urls.judge_sql(URL_RULES, f"regexp_matches(host, '{BAD_HOST}')"),
    "op11_collocations": collocations.mine_sql(PHRASE_COUNT, PHRASES),
}
