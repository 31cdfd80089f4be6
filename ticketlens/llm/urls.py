"""URL filter: rules first, then a list of canonical URLs behind a blocked Bloom filter.

The filter is a table of 512-bit blocks (eight longs), built by one aggregation: a listed
URL sets one bit in each long of one block. A page's URL is tested against its one block;
only possible hits go on to the exact hash join with the list, which removes false
positives. The filter grows with the list, so how it is joined is left to Spark: it is
broadcast while Spark finds it small, and shuffled by block beyond that."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that name a visit and not a page.
VISIT_PARAMETER = "^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"
PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"
#: Filter bits for each listed URL; with eight bits set, about one false hit in a thousand.
BITS_PER_URL = 16


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def canonical(url: Column) -> Column:
    """Host without a leading www. or m., path without trailing slashes, and the sorted
    query without visit parameters; no scheme and no fragment. Null without a host."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^#?]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: ~p.rlike(VISIT_PARAMETER) & (p != "")))
    rest = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(host != "", F.concat(host, path, rest))


def rule_for(host: Column, path: Column, rules: list[Rule]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        inside = (host == rule.host) | host.endswith("." + rule.host)
        named = F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(inside & path.startswith(rule.path), named).otherwise(found)
    return found


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bits(key: Column) -> list[Column]:
    """One bit for each of a block's eight longs, by six bits each of a second hash."""
    second = F.xxhash64(key, F.lit(1))
    return [
        F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
        for i in range(8)
    ]


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """The filter of the distinct `key` column: block, w0 .. w7."""
    words = [F.bit_or(bit).alias(f"w{i}") for i, bit in enumerate(_bits(F.col("key")))]
    return keys.groupBy(_block(F.col("key"), blocks).alias("block")).agg(*words)


def judge(
    pages: DataFrame,
    listed: DataFrame,
    rules: list[Rule],
    id_col: str = "page_id",
    url_col: str = "url",
    listed_url_col: str = "url",
) -> DataFrame:
    """One row per row of `pages`: page_id, host, path, rule, verdict, listed.

    The verdict is the rule's; without a rule it is block for a URL whose canonical form
    is listed, else allow. A null URL or one without "://" has an empty host and path, is
    never listed and is allowed. Repeated rows stay repeated, repeated list entries count
    once, an empty list blocks nothing, an empty table gives an empty one, and other
    columns are not read."""
    keys = stored(
        listed.select(canonical(F.col(listed_url_col)).alias("key")).where("key IS NOT NULL").distinct(), "listed"
    )
    blocks = 1 + keys.count() * BITS_PER_URL // 512
    url = F.col(url_col)
    page = pages.select(
        F.col(id_col).alias("page_id"),
        host_of(url).alias("host"),
        path_of(url).alias("path"),
        canonical(url).alias("key"),
    )
    page = page.withColumn("_r", rule_for(F.col("host"), F.col("path"), rules))
    all_set = F.lit(True)
    for i, bit in enumerate(_bits(F.col("key"))):
        all_set = all_set & (F.col(f"w{i}").bitwiseAND(bit) != 0)
    probed = stored(
        page.withColumn("block", _block(F.col("key"), blocks))
        .join(bloom_filter(keys, blocks), "block", "left")
        .select(
            "page_id",
            "host",
            "path",
            F.col("_r.rule").alias("rule"),
            F.col("_r.verdict").alias("verdict"),
            "key",
            F.coalesce(all_set, F.lit(False)).alias("maybe"),
        ),
        "probed",
    )
    exact = probed.where("maybe").join(keys.withColumn("listed", F.lit(True)), "key", "left")
    rest = probed.where("NOT maybe").withColumn("listed", F.lit(False))
    hit = F.coalesce("listed", F.lit(False))
    return exact.unionByName(rest).select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("verdict", F.when(hit, "block").otherwise("allow")).alias("verdict"),
        hit.alias("listed"),
    )


def judge_sql(rules: list[Rule], listed_where: str) -> str:
    """The same rows in SQL; `listed_where` picks the listed ones by `host`."""

    def parts(group: int) -> str:
        return f"regexp_extract(coalesce(url, ''), '{PARTS}', {group})"

    fits = " ".join(
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.name}'"
        for r in sorted(rules, key=lambda r: (len(r.name), r.name), reverse=True)
    )
    verdicts = " ".join(f"WHEN '{r.name}' THEN '{r.verdict}'" for r in rules)
    return f"""WITH a AS (SELECT page_id, url, translate({parts(1)}, '{UPPER}', '{LOWER}') AS host, {parts(2)} AS path,
        list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '(?s)^[^#?]*\\?([^#]*)', 1), '&'),
            lambda p: NOT regexp_matches(p, '{VISIT_PARAMETER}') AND p <> '')) AS kept FROM pages),
    b AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '/+$', '')
        || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS key,
        CASE {fits} END AS rule FROM a),
    l AS (SELECT DISTINCT key FROM b WHERE key IS NOT NULL AND {listed_where})
    SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN CASE rule {verdicts} END
        WHEN l.key IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, l.key IS NOT NULL AS listed
    FROM b LEFT JOIN l ON b.key = l.key"""
