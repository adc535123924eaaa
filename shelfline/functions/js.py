"""Pins of text and number semantics where Spark's defaults differ from the
ones that the product model was written with."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, Unicode's included, as a class and as its inside.
WHITE_IN = "\\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
WHITE = f"[{WHITE_IN}]"
#: A word boundary, of ASCII words.
LEFT, RIGHT = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
#: The number at the front of a text.
NUMBER = rf"^{WHITE}*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WHITE}+|{WHITE}+\z", "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.regexp_replace(trim(c), f"{WHITE}+", " ")


def group(c: Column, pattern: str, n: int = 1) -> Column:
    """A group of the first match; null where there is none or it is empty."""
    return F.nullif(F.regexp_extract(c, pattern, n), F.lit(""))


def drop_first(c: Column, pattern: str) -> Column:
    """Without the first match of ``pattern``, upper and lower case alike."""
    return F.regexp_replace(c, f"(?is)^(.*?)(?:{pattern})", "$1")


def round_half_up(c: Column) -> Column:
    """The integer above at a half, also below zero."""
    return F.floor(c + F.lit(0.5))


def leading_number(c: Column) -> Column:
    """The number that a text begins with; null if none."""
    return group(c, NUMBER).try_cast("double")


def finite(c: Column) -> Column:
    """Whether a number is neither null, NaN nor infinite."""
    d = c.cast("double")
    return F.coalesce(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), F.lit(False))


def filled(c: Column) -> Column:
    """Whether a text is neither null nor empty."""
    return F.coalesce(c != "", F.lit(False))


def either(*columns: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def decoded(c: Column) -> Column:
    """Percent-decoded with ``+`` as a space; as it is where malformed."""
    return F.coalesce(F.try_url_decode(c), F.replace(c, F.lit("+"), F.lit(" ")))


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often it is named:
    a lambda variable is no alias that the optimiser could write out, and
    stays one where the whole is pushed into a filter."""
    return F.element_at(F.transform(F.array(value), body), 1)
