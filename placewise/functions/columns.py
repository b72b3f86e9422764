"""Null-safe scalar helpers shared by every operator."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

# Characters that a Unicode-aware strip removes; fixed values.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def lookup(key: Column, table: Mapping, default=None) -> Column:
    """Value of `key` in a literal table; a miss or null gives `default`."""
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    hit = F.try_element_at(entries, key)
    return hit if default is None else F.coalesce(hit, F.lit(default))


def banded(value: Column, bands: Sequence[tuple]) -> Column:
    """First band whose upper bound exceeds `value`; null falls to the open last band."""
    *bounded, (_, last) = bands
    first_bound, first = bounded[0]
    expr = F.when(value < first_bound, F.lit(first))
    for bound, result in bounded[1:]:
        expr = expr.when(value < bound, F.lit(result))
    return expr.otherwise(F.lit(last))


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bound a value and keep null as null (`greatest` and `least` alone would skip it)."""
    bounded = value
    if low is not None:
        bounded = F.greatest(bounded, F.lit(low))
    if high is not None:
        bounded = F.least(bounded, F.lit(high))
    return F.when(value.isNotNull(), bounded)


def clip_nonnegative(value: Column) -> Column:
    return clip(value, low=0.0)


def to_numeric(text: Column) -> Column:
    return text.try_cast("double")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def zip5(value: Column) -> Column:
    return F.substring(value.cast("string"), 1, 5)


def is_zip5(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^[0-9]{5}$"), F.lit(False))


def has_keyword(text: Column, keywords: Sequence[str], whole_words: bool = False) -> Column:
    """Any keyword in the text, ignoring case; null counts as no match."""
    pattern = "|".join(keywords)
    if whole_words:
        pattern = rf"\b(?:{pattern})\b"
    return F.coalesce(F.lower(text).rlike(pattern), F.lit(False))


def in_box(lat: Column, lon: Column, lat_range, lon_range) -> Column:
    return lat.between(*lat_range) & lon.between(*lon_range)


def one_decimal(value: Column) -> Column:
    """Text with one digit after the point, rounded from the exact binary value, exact ties to even.

    `format_string` rounds the shortest decimal form instead, which turns 10.35 (stored slightly
    below) into 10.4. Twenty times the value is split exactly into a rounded sum and its error, which
    tells on which side of a half tenth the value lies.
    """
    x = F.abs(value.cast("double"))
    a, b = 16 * x, 4 * x
    s = a + b
    error = (a - (s - (s - a))) + (b - (s - a))
    whole = F.floor(s)
    low, high = F.floor(whole / 2), F.floor((whole + 1) / 2)
    on_half = (s == whole) & (whole % 2 == 1)
    tenths = (
        F.when(on_half & (error < 0), low)
        .when(on_half & (error == 0) & (low % 2 == 0), low)
        .otherwise(high)
    )
    sign = F.when(value < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, F.format_string("%.1f", tenths / 10))


def label_text(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def preview_text(text: Column, length: int = 200) -> Column:
    return F.concat(F.substring(text, 1, length), F.lit("..."))


def fill_text(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def stringify_metadata(columns: Sequence[str]) -> Column:
    """The named columns as one map<string,string>, null as ''."""
    if not columns:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[x for c in columns for x in (F.lit(c), fill_text(F.col(c)))])
