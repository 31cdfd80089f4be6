"""Personal data by weak supervision, in DataFrame functions only.

Patterns propose candidate spans of four kinds. Labelers (strict pattern, gazetteer,
context, surroundings, shape) vote for or against each. Expectation-maximisation over the
counts of vote patterns estimates how far each labeler is to be trusted and gives every
pattern its probability; a naive Bayes classifier of span features is trained on these and
decides on the candidates. Spans of the base rules stay in any case."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import stored

KINDS = ("email", "ip", "card", "phone")
#: What the base rules find, leftmost and without overlaps. Runs are taken
#: whole and never given back, and none starts inside a run, unless a match has just
#: ended there: the matches are those of the plain patterns, in time linear in the text.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Further candidates, which the base rules do not cover.
FURTHER = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[(\[]at[)\]] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]{1,63}){1,4}",
    "phone": r"(?<![0-9A-Za-z.+-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
}
BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Gazetteers and context words by kind.
KNOWN = {
    "email": r"(?i)(?:\.|dot[)\]] ?)(com|org|net|edu|gov|info|io|de|fr|es|it|nl|uk|eu|ch|at|us)$",
    "ip": r"^(?!0|10\.|127\.|169\.254\.|192\.168\.|22[4-9]|2[3-5][0-9])",
    "card": r"^(4|5[1-5]|2[2-7]|3[47]|30|35|36|38|6011|62|65)",
    "phone": r"^(\+(1|7|20|27|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|\(?[2-9][0-9]{2})",
}
CONTEXT = {
    "email": r"(?i)(mail|contact|write|kontakt|contacto|reach|send)",
    "ip": r"(?i)\b(ip|host|server|address|addr|login|gateway|adresse)\b",
    "card": r"(?i)(card|visa|master|amex|credit|debit|karte|carte|tarjeta|payment)",
    "phone": r"(?i)(phone|tel|call|mobile|cell|fax|ruf|appel|llam)",
}
LABELERS = 5
ROUNDS = 20
#: Probability from which the classifier adds a candidate.
ACCEPT = 0.9


def _placed(found: Column, pieces: Column) -> Column:
    """Matches with their places (code points), the text before and the character after,
    from all matches and the pieces of text between them."""
    seen = F.transform(
        found,
        lambda m, i: F.struct(
            m.alias("m"),
            F.length(F.get(pieces, i)).alias("gap"),
            F.right(F.get(pieces, i), F.lit(24)).alias("before"),
            F.left(F.get(pieces, i + 1), F.lit(1)).alias("after"),
        ),
    )
    kind = "array<struct<start:int,end:int,m:string,before:string,after:string>>"
    return F.aggregate(
        seen,
        F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + F.length(x["m"])).alias("at"),
            F.array_append(
                acc["out"],
                F.struct(
                    (acc["at"] + x["gap"]).alias("start"),
                    (acc["at"] + x["gap"] + F.length(x["m"])).alias("end"),
                    x["m"].alias("m"),
                    x["before"].alias("before"),
                    x["after"].alias("after"),
                ),
            ).alias("out"),
        ),
        lambda acc: acc["out"],
    )


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn check."""
    turned = F.split(F.reverse(digits), "")
    total = F.aggregate(
        F.transform(
            turned,
            lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
                d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)
            ),
        ),
        F.lit(0),
        lambda acc, d: acc + F.coalesce(d, F.lit(0)),
    )
    return total % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    """Whether a match of the base pattern is a span of the base rules."""
    digits = _digits(match)
    if kind == "ip":
        return match.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return F.length(digits).between(14, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _votes(kind: str, x: Column, strict: Column) -> Column:
    """-1, 0 or 1 of each labeler."""
    digits = _digits(x["m"])
    gazetteer = (digits if kind == "card" else x["m"]).rlike(KNOWN[kind])
    joined = x["before"].rlike(r"[\p{L}\p{N}_=/#\"'\\]$") | x["after"].rlike(r"[\p{L}\p{N}_%=\"']")
    if kind == "email":
        odd = x["m"].rlike(r"^[._%+-]|\.\.|^[0-9]+@")
    else:
        odd = digits.rlike(r"^(.)\1*$") | x["before"].rlike(r"(?i)(version|v|no|nr|id|#)[ .:]*$")
    return F.array(
        F.when(strict, 1).otherwise(-1),
        F.when(gazetteer, 1).otherwise(-1),
        F.when(x["before"].rlike(CONTEXT[kind]), 1).otherwise(0),
        F.when(joined, -1).otherwise(0),
        F.when(odd, -1).otherwise(1),
    )


def _features(kind: str, x: Column, strict: Column) -> Column:
    """Features of a span for the classifier; each has a few values only."""
    count = F.least(F.length(_digits(x["m"])), F.lit(20)).cast("string")
    marks = F.array_join(
        F.array_sort(F.array_distinct(F.split(F.regexp_replace(x["m"], r"[^ ().@+\[\]-]", ""), ""))), ""
    )
    before = (
        F.when(x["before"].rlike(r"[\p{L}\p{N}_]$"), "word")
        .when(x["before"].rlike(r"\s$"), "space")
        .when(x["before"] == "", "none")
        .otherwise("mark")
    )
    after = F.when(x["after"].rlike(r"[\p{L}\p{N}_]"), "word").when(x["after"].rlike(r"[\s.,;]"), "end").otherwise("mark")
    return F.array(
        F.concat(F.lit("digits:"), count),
        F.concat(F.lit("marks:"), F.left(marks, F.lit(6))),
        F.concat(F.lit("before:"), before),
        F.concat(F.lit("after:"), after),
        F.concat(F.lit("strict:"), strict.cast("string")),
        F.concat(F.lit("known:"), (x["m"]).rlike(KNOWN[kind]).cast("string")),
        F.concat(F.lit("context:"), x["before"].rlike(CONTEXT[kind]).cast("string")),
    )


def _with_digits(spans: Column, least: int) -> Column:
    return F.filter(spans, lambda x: F.length(_digits(x["m"])) >= least)


def _judge(kind: str, role: str) -> Callable[[Column], Column]:
    """From a placed match to a candidate of its kind."""

    def judged(x: Column) -> Column:
        strict = _valid(kind, x["m"]) if role == "base" else F.lit(False)
        return F.struct(
            x["start"].alias("start"),
            F.lit(KINDS.index(kind)).alias("kind"),
            x["end"].alias("end"),
            strict.alias("base"),
            _votes(kind, x, strict).alias("votes"),
            _features(kind, x, strict).alias("features"),
        )

    return judged


def with_candidates(docs: DataFrame, text: str, name: str) -> DataFrame:
    """Adds `name`: the candidates of a text, by start and kind. `text` is a column
    without nulls, `name` one that docs does not have yet."""
    columns = docs.columns
    kinds = [(k, "base", p) for k, p in BASE.items()] + [(k, "further", p) for k, p in FURTHER.items()]
    tell = {"email": F.col(text).contains("@")}
    df = docs
    for kind, role, pattern in kinds:
        found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
        if role == "base" and kind in tell:
            found = F.when(tell[kind], found).otherwise(F.array().cast("array<string>"))
        df = df.withColumn(f"{name}_{role}_{kind}", found)
    lists = {}
    for kind, role, pattern in kinds:
        found = F.col(f"{name}_{role}_{kind}")
        least = {"card": 14}.get(kind, 0)
        placed = _placed(found, F.split(F.col(text), pattern, -1))
        wanted = _with_digits(placed, least) if least else placed
        lists[kind, role] = F.when(F.size(found) > 0, F.transform(wanted, _judge(kind, role)))
    empty = "array<struct<start:int,kind:int,end:int,base:boolean,votes:array<int>,features:array<string>>>"

    def joined(role: str) -> Column:
        return F.flatten(F.array(*[F.coalesce(c, F.array().cast(empty)) for (_, r), c in lists.items() if r == role]))

    df = df.withColumn(f"{name}_all_base", joined("base")).withColumn(f"{name}_all_further", joined("further"))
    base = F.col(f"{name}_all_base")
    apart = F.filter(
        F.col(f"{name}_all_further"),
        lambda f: ~F.exists(base, lambda b: b["base"] & (b["start"] < f["end"]) & (f["start"] < b["end"])),
    )
    return df.withColumn(name, F.array_sort(F.concat(base, apart))).select(*columns, name)


def posteriors(candidates: DataFrame) -> DataFrame:
    """From one row per candidate (kind, votes) to (kind, votes, p): the probability of
    each vote pattern, by expectation-maximisation over the pattern counts. A kind has at
    most 3^5 patterns, so one row holds them all, whatever the number of candidates."""
    counted = candidates.groupBy("kind", "votes").count()
    lists = counted.groupBy("kind").agg(
        F.array_sort(F.collect_list(F.struct("votes", F.col("count").cast("double").alias("n")))).alias("pats")
    )
    pats = F.col("pats")

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)

    def better(post: Column) -> Column:
        all_n = total(F.transform(pats, lambda x: x["n"]))
        yes = total(F.zip_with(pats, post, lambda x, p: x["n"] * p))

        def log_odds(x: Column) -> Column:
            out = F.log((yes + 1) / (all_n - yes + 1))
            for j in range(LABELERS):

                def agree(y: Column, j: int = j) -> Column:
                    return F.when(y["votes"][j] == x["votes"][j], y["n"]).otherwise(0.0)

                same_yes = total(F.zip_with(pats, post, lambda y, p: agree(y) * p))
                same_no = total(F.zip_with(pats, post, lambda y, p: agree(y) * (1 - p)))
                out = out + F.log((same_yes + 1) / (yes + 3)) - F.log((same_no + 1) / (all_n - yes + 3))
            return out

        return F.transform(pats, lambda x: 1 / (1 + F.exp(-log_odds(x))))

    start = F.transform(
        pats,
        lambda x: 1 / (1 + F.exp(-F.aggregate(x["votes"], F.lit(0.0), lambda acc, v: acc + v))),
    )
    post = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda acc, _: better(acc))
    return lists.select("kind", F.explode(F.arrays_zip(pats.alias("pats"), post.alias("p"))).alias("x")).select(
        "kind", F.col("x.pats.votes").alias("votes"), F.col("x.p").alias("p")
    )


@dataclass
class Model:
    """Log odds of features ("kind|feature") and of kinds ("kind|"). Features have a few
    values each, so a model has a fixed size."""

    weights: dict[str, float]

    def accepts(self, candidate: Column) -> Column:
        if not self.weights:
            return candidate["base"]
        pairs = [F.lit(x) for item in sorted(self.weights.items()) for x in item]
        table = F.create_map(*pairs)
        keys = F.transform(
            F.concat(F.array(F.lit("")), candidate["features"]),
            lambda f: F.concat(candidate["kind"].cast("string"), F.lit("|"), f),
        )
        odds = F.aggregate(keys, F.lit(0.0), lambda acc, k: acc + F.coalesce(table[k], F.lit(0.0)))
        return candidate["base"] | (odds > math.log(ACCEPT / (1 - ACCEPT)))


def train(candidates: DataFrame) -> Model:
    """The classifier from (candidates array) rows: features counted with the vote
    patterns' probabilities as weights."""
    each = candidates.select(F.explode("candidates").alias("c")).select("c.kind", "c.votes", "c.features")
    weighted = each.join(F.broadcast(posteriors(each)), ["kind", "votes"])
    sums = (
        weighted.select("kind", "p", F.explode(F.concat(F.array(F.lit("")), F.col("features"))).alias("feature"))
        .groupBy("kind", "feature")
        .agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
        .collect()
    )
    whole = {r["kind"]: r for r in sums if r["feature"] == ""}
    weights = {}
    for r in sums:
        yes, no = whole[r["kind"]]["yes"], whole[r["kind"]]["no"]
        if r["feature"] == "":
            weights[f"{r['kind']}|"] = math.log((yes + 1) / (no + 1))
        else:
            weights[f"{r['kind']}|{r['feature']}"] = math.log((r["yes"] + 1) / (yes + 20)) - math.log(
                (r["no"] + 1) / (no + 20)
            )
    return Model(weights)


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined, in the order of the array."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id and `spans`, an array of (start, kind, end, base),
    by start and kind; kind numbers KINDS, places count code points, ends are exclusive.

    Null and empty texts have no spans; repeated rows stay repeated; an empty table gives
    an empty one; without candidates there is no model and only base spans count. Other
    columns are not read."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    found = stored(with_candidates(rows, "text", "candidates").drop("text"), "candidates")
    model = train(found)
    kept = F.filter("candidates", model.accepts)
    return found.select(
        "doc_id",
        F.transform(
            kept,
            lambda c: F.struct(
                c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), c["base"].alias("base")
            ),
        ).alias("spans"),
    )


def masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with every span in `text_col` replaced by [KIND]; all columns and rows stay.
    Where spans overlap, the one that starts first is replaced and what the other has
    beyond it goes with it. A null text stays null, repeated rows stay repeated, and an
    empty table gives an empty one."""
    hidden = "_pii"
    while any(c.startswith(hidden) for c in docs.columns):
        hidden += "_"
    whole = F.coalesce(F.col(text_col), F.lit(""))
    found = with_candidates(docs.withColumn(f"{hidden}_text", whole), f"{hidden}_text", hidden)
    df = stored(found.drop(f"{hidden}_text"), "candidates")  # the patterns run once
    model = train(df.where(F.size(hidden) > 0).select(F.col(hidden).alias("candidates")))
    spans = F.filter(hidden, model.accepts)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text = F.coalesce(F.col(text_col), F.lit(""))
    built = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(
            s["start"] >= acc["at"],
            F.struct(
                s["end"].alias("at"),
                F.concat(
                    acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.get(names, s["kind"])
                ).alias("out"),
            ),
        ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    clean = F.when(F.size(hidden) > 0, built).otherwise(F.col(text_col))
    return df.select(*[clean.alias(c) if c == text_col else F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])
