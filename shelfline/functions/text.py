"""Normalised texts, their tokens, and how relevant a title is to a query.

A query is one text for a whole table: its side is worked out once, in Python;
titles are columns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.functions.js import LEFT, RIGHT, WHITE, WHITE_IN, let, squeeze
from shelfline.functions.lexicon import ACCESSORIES, AUDIO_BY_LENGTH, AUDIO_QUERY, GROUP_OF, PHRASES, STOPWORDS, singular

#: What a query says about a budget: a keyword and an amount, or an amount of money.
BUDGET_WORDS = rf"under|below|above|over|up{WHITE}*to|upto|within|between|less{WHITE}+than|greater{WHITE}+than|around|approx(?:imately)?"
BUDGET_NOISE = [
    rf"(?i){LEFT}(?:{BUDGET_WORDS}){RIGHT}[^a-zA-Z\d]*?(?:rs\.?|inr|[₹$€])?[^a-zA-Z\d]*?\d[\d,]*",
    rf"[₹$]{WHITE}*\d[\d,]*",
    rf"(?i){LEFT}rs\.?{WHITE}*\d[\d,]*",
    rf"(?i){LEFT}inr{WHITE}*\d[\d,]*",
]


def normalize_text(c: Column) -> Column:
    """Lower case, only letters and digits of ASCII, phrases folded, squeezed;
    null as empty."""
    # White space and all else that goes becomes one space at once.
    out = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " ")
    for first, second, one in PHRASES:
        out = F.regexp_replace(out, rf"{first} {second}(?![a-z0-9])", one)
    return F.trim(out)


def strip_budget(c: Column) -> Column:
    """Without what is said about a budget; null as empty."""
    out = F.coalesce(c, F.lit(""))
    for pattern in BUDGET_NOISE:
        out = F.regexp_replace(out, pattern, " ")
    return squeeze(out)


def normalize_query(c: Column) -> Column:
    return normalize_text(strip_budget(c))


def tokens(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda t: t != "")


def singular_of(t: Column) -> Column:
    n = F.length(t)
    return (
        F.when((n > 4) & t.endswith("ies"), F.concat(F.substring(t, F.lit(1), n - 3), F.lit("y")))
        .when((n > 3) & t.endswith("s") & ~t.endswith("ss"), F.substring(t, F.lit(1), n - 1))
        .otherwise(t)
    )


def canonical(t: Column) -> Column:
    """The name of a token's intent group, or its singular."""
    one = singular_of(t)
    groups = F.create_map(*[F.lit(x) for pair in GROUP_OF.items() for x in pair])
    return F.coalesce(F.element_at(groups, one), one)


def is_accessory(t: Column) -> Column:
    return singular_of(t).isin(ACCESSORIES)


def query_tokens(c: Column) -> Column:
    """Tokens of a normalised query that are no stopwords; repeats stay."""
    return F.filter(tokens(normalize_query(c)), lambda t: ~t.isin(STOPWORDS))


def audio_terms(normalized: Column) -> Column:
    """How many audio terms a text has: the longest first, each once, and
    what one has used no other can."""
    step = lambda acc, term: F.when(
        F.instr(acc["rest"], term) > 0,
        F.struct(
            F.concat(F.substring(acc["rest"], F.lit(1), F.instr(acc["rest"], term) - 1), F.lit(" "), F.substring(acc["rest"], F.instr(acc["rest"], term) + F.length(term), F.length(acc["rest"]))).alias("rest"),
            (acc["n"] + 1).alias("n"),
        ),
    ).otherwise(acc)
    terms = F.array(*[F.lit(t) for t in AUDIO_BY_LENGTH])
    return F.aggregate(terms, F.struct(normalized.alias("rest"), F.lit(0).alias("n")), step, lambda acc: acc["n"])


@dataclass(frozen=True)
class Query:
    """What relevance needs of a query."""

    text: str
    tokens: tuple[str, ...]

    @classmethod
    def of(cls, raw: str | None) -> Query:
        white = WHITE_IN.replace(r"\s", " \\t\\n\\r\\f\\v")
        space = lambda s: re.sub(f"[{white}]+", " ", s).strip(" ")
        text = raw or ""
        for pattern in BUDGET_NOISE:
            text = re.sub(pattern, " ", text, flags=re.ASCII)
        text = re.sub(f"[^a-z0-9{white}]", " ", space(text).lower())
        for first, second, one in PHRASES:
            text = re.sub(rf"{first}[{white}]+{second}(?![a-z0-9])", one, text)
        text = space(text)
        return cls(text, tuple(t for t in text.split(" ") if t and t not in STOPWORDS))

    @property
    def usable(self) -> bool:
        return bool(self.text and self.tokens)

    @property
    def groups(self) -> list[str]:
        return [GROUP_OF.get(singular(t), singular(t)) for t in self.tokens]

    @property
    def for_accessory(self) -> bool:
        return any(singular(t) in ACCESSORIES for t in self.tokens)

    @property
    def for_audio(self) -> bool:
        return any(t in AUDIO_QUERY for t in self.tokens)


def with_relevance(df: DataFrame, query: str | None, title: str = "title", name: str = "relevance") -> DataFrame:
    """``df`` with a struct (score, category, overlap, overlap_ratio, exact,
    penalty, query_used) of each title.

    A blank title or a query without usable tokens gives category UNKNOWN and
    score 0.  Otherwise: 3 for each query token whose group the title has, 1
    more if it is long, 10 if the whole query is in the title, -3 for each
    accessory in the title of a group that the query does not ask for.
    """
    q = Query.of(query)
    t = F.coalesce(F.col(title), F.lit(""))
    if not q.usable:
        return df.withColumn(name, _verdict(F.lit(0), F.lit("UNKNOWN"), F.lit(0), F.lit(0.0), F.lit(False), F.lit(0), F.lit("")))
    groups = q.groups
    total = lambda columns: sum(columns[1:], columns[0]) if columns else F.lit(0)

    def counted(text: Column, words: Column) -> Column:
        of = F.transform(words, lambda x: x["group"])
        has = [F.array_contains(of, g).cast("int") for g in groups]
        stray = F.size(F.filter(words, lambda x: x["accessory"] & ~x["group"].isin(sorted(set(groups)))))
        bonus = total([h for h, word in zip(has, q.tokens, strict=True) if len(word) >= 5])
        return F.struct(total(has).alias("overlap"), bonus.alias("bonus"), stray.alias("penalty"), text.contains(q.text).alias("exact"))

    def scored(text: Column, n: Column) -> Column:
        points = 3 * n["overlap"] + n["bonus"] + F.when(n["exact"], 10).otherwise(0) - 3 * n["penalty"]
        return let(points, lambda score: judged(text, n, score))

    def judged(text: Column, n: Column, score: Column) -> Column:
        ratio = n["overlap"] / F.lit(len(groups))
        found = _category(n, score, ratio, F.lit(not q.for_accessory))
        if q.for_audio:
            found = let(found, lambda c: F.when((c == "LOW") & (audio_terms(text) >= 2), "HIGH").otherwise(c))
        return _verdict(score, found, n["overlap"], ratio, n["exact"], n["penalty"], F.lit(q.text))

    def relevance(text: Column) -> Column:
        none = _verdict(F.lit(0), F.lit("UNKNOWN"), F.lit(0), F.lit(0.0), F.lit(False), F.lit(0), F.when(squeeze(t) == "", "").otherwise(q.text))
        words = F.transform(tokens(text), lambda x: F.struct(canonical(x).alias("group"), is_accessory(x).alias("accessory")))
        return F.when(text == "", none).otherwise(let(words, lambda w: let(counted(text, w), lambda n: scored(text, n))))

    return df.withColumn(name, let(normalize_text(t), relevance))


def _category(n: Column, score: Column, ratio: Column, no_accessory: Column) -> Column:
    """The category of counts (overlap, penalty, exact), audio terms aside."""
    stray = no_accessory & (n["penalty"] > 0)
    return (
        F.when(n["exact"], F.when(stray, "LOW").otherwise("HIGH"))
        .when((n["overlap"] == 0) | (stray & (score < 6)) | ((n["penalty"] > 0) & (ratio < 0.6)), "LOW")
        .when((ratio >= 0.75) | (score >= 6), "HIGH")
        .when((ratio >= 0.4) | (score >= 3), "MEDIUM")
        .otherwise("LOW")
    )


def asked(query: Column) -> Column:
    """What relevance needs of a column of queries: a struct (text, groups,
    long, for_accessory, for_audio), for :func:`relevance_between`."""
    text = normalize_query(query)
    words = F.filter(tokens(text), lambda t: ~t.isin(STOPWORDS))
    return let(words, lambda w: F.struct(
        text.alias("text"), F.transform(w, canonical).alias("groups"), F.transform(w, lambda t: F.length(t) >= 5).alias("long"),
        F.exists(w, is_accessory).alias("for_accessory"), F.exists(w, lambda t: t.isin(AUDIO_QUERY)).alias("for_audio"),
    ))


def relevance_between(title: Column, query: Column) -> Column:
    """As :func:`with_relevance`, of titles to queries of their own rows."""
    groups = query["groups"]

    def counted(text: Column, words: Column) -> Column:
        of = F.transform(words, lambda x: x["group"])
        has = F.transform(groups, lambda g: F.array_contains(of, g))
        stray = F.size(F.filter(words, lambda x: x["accessory"] & ~F.array_contains(groups, x["group"])))
        both = F.zip_with(has, query["long"], lambda a, b: a & b)
        number = lambda flags: F.size(F.filter(flags, lambda x: x))
        return F.struct(number(has).alias("overlap"), number(both).alias("bonus"), stray.alias("penalty"), text.contains(query["text"]).alias("exact"))

    def judged(text: Column, n: Column, score: Column) -> Column:
        ratio = n["overlap"] / F.size(groups)
        found = let(_category(n, score, ratio, ~query["for_accessory"]), lambda c: F.when((c == "LOW") & query["for_audio"] & (audio_terms(text) >= 2), "HIGH").otherwise(c))
        return _verdict(score, found, n["overlap"], ratio, n["exact"], n["penalty"], query["text"])

    def scored(text: Column, n: Column) -> Column:
        return let(3 * n["overlap"] + n["bonus"] + F.when(n["exact"], 10).otherwise(0) - 3 * n["penalty"], lambda score: judged(text, n, score))

    def relevance(text: Column) -> Column:
        usable = (query["text"] != "") & (F.size(groups) > 0)
        used = F.when(usable & (squeeze(F.coalesce(title, F.lit(""))) != ""), query["text"]).otherwise("")
        none = _verdict(F.lit(0), F.lit("UNKNOWN"), F.lit(0), F.lit(0.0), F.lit(False), F.lit(0), used)
        words = F.transform(tokens(text), lambda x: F.struct(canonical(x).alias("group"), is_accessory(x).alias("accessory")))
        return F.when(usable & (text != ""), let(words, lambda w: let(counted(text, w), lambda n: scored(text, n)))).otherwise(none)

    return let(normalize_text(title), relevance)


def _verdict(score, category, overlap, ratio, exact, penalty, used) -> Column:
    parts = {"score": score.cast("int"), "category": category, "overlap": overlap.cast("int"), "overlap_ratio": ratio.cast("double"), "exact": exact, "penalty": penalty.cast("int"), "query_used": used}
    return F.struct(*[c.alias(n) for n, c in parts.items()])
