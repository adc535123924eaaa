"""Numbers out of prices and counts as shops write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfline.functions.js import LEFT, RIGHT, WHITE, WHITE_IN, drop_first, group, leading_number, round_half_up
from shelfline.functions.lexicon import COUNT_CEILING


def _plain(c: Column) -> Column:
    """Digits with one decimal point at most, or null."""
    return F.when(c.rlike(r"\A\d+(\.\d+)?\z"), c.try_cast("double"))


def price_text(c: Column) -> Column:
    """A price without a currency word: rupee sign, commas, white space and
    parentheses are dropped, and a number must remain."""
    return _plain(F.regexp_replace(c, rf"[₹,{WHITE_IN}()]", ""))


def indian_number(c: Column) -> Column:
    """As :func:`price_text`, with the first "rs" or "rs." and the first
    "inr" dropped before."""
    return price_text(drop_first(drop_first(c, r"rs\.?"), "inr"))


def _scaled(c: Column, pattern: str, by: int) -> Column:
    digits = F.regexp_replace(F.regexp_extract(c, pattern, 1), ",", "")
    # Several points: the number in front counts, and none is none.
    return F.when(c.rlike(pattern), round_half_up(leading_number(digits) * by).cast("double"))


def feedback_count(c: Column) -> Column:
    """A count of ratings or reviews: lakh, crore, k and m are scaled, in this
    order; else the number before the end, with what may follow it."""
    low = F.lower(c)
    scaled = [
        (rf"([\d,.]+){WHITE}*lakh", 100_000), (rf"([\d,.]+){WHITE}*crore", 10_000_000),
        (rf"(\d+(?:\.\d+)?){WHITE}*k{RIGHT}", 1_000), (rf"(\d+(?:\.\d+)?){WHITE}*m{RIGHT}", 1_000_000),
    ]
    plain = group(low, rf"([\d,]+){WHITE}*\+?{WHITE}*(?:(?:global|customer|verified){WHITE}+)?(?:ratings?|reviews?)?{WHITE}*\z")
    out = F.regexp_replace(plain, ",", "").try_cast("double")
    for pattern, by in reversed(scaled):
        out = F.when(low.rlike(pattern), _scaled(low, pattern, by)).otherwise(out)
    return F.when(c != "", out)


def _typed_count(c: Column, kind: str, scale: bool) -> Column:
    """The number in front of "rating(s)" or "review(s)"."""
    pattern = rf"([\d.,]+){WHITE}*(k|l)?{WHITE}*{kind}s?"
    low = F.lower(c)
    number = F.regexp_replace(F.regexp_extract(low, pattern, 1), ",", "")
    if not scale:
        return F.when(low.rlike(pattern), group(number, r"^(\d+)").try_cast("double"))
    by = F.element_at(F.create_map(F.lit("k"), F.lit(1_000), F.lit("l"), F.lit(100_000)), F.regexp_extract(low, pattern, 2))
    return F.when(low.rlike(pattern), round_half_up(leading_number(number) * F.coalesce(by, F.lit(1))).cast("double"))


def _bracketed(c: Column, scale: bool) -> Column:
    number = F.regexp_replace(group(c, r"\(([\d.,]+)\)"), ",", "")
    return round_half_up(leading_number(number)).cast("double") if scale else group(number, r"^(\d+)").try_cast("double")


def _positive(c: Column) -> Column:
    return F.when(c > 0, c)


def flipkart_count(c: Column, kind: str) -> Column:
    """Count of ``kind`` ("rating" or "review"); a suffix k or l is passed
    over unused and fractions are cut; else a number in parentheses."""
    return F.coalesce(_positive(_typed_count(c, kind, False)), _positive(_bracketed(c, False)))


def meesho_count(c: Column, kind: str, bare: bool) -> Column:
    """Count of ``kind``, k and l scaled; else a number in parentheses, where
    ``bare`` or the kind is named."""
    bracketed = F.when(F.lit(bare) | F.lower(c).contains(kind), _positive(_bracketed(c, True)))
    return F.coalesce(_positive(_typed_count(c, kind, True)), bracketed)


def plausible_count(text: Column, count: Column) -> Column:
    """Whether a count found in ``text`` is one of feedback."""
    low = F.lower(text)
    bare = F.regexp_replace(F.regexp_replace(text, rf"^[{WHITE_IN}(\[{{]+", ""), rf"[{WHITE_IN})\]}}]+\z", "")
    no = text.rlike(r"[₹$€%]") | low.rlike(rf"{LEFT}(?:bought|emi|month|quantity|discount|sold|offer|deal){RIGHT}")
    number = bare.rlike(r"\A[\d,]+\z") | bare.rlike(rf"\A[\d.]+{WHITE}*[kKmM]{WHITE}*\+?\z")
    ok = (count > 0) & (count < COUNT_CEILING) & ~no & (low.rlike("rating|review") | (number & (count >= 100)))
    return F.coalesce(ok, F.lit(False))
