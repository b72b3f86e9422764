"""Date expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from placewise.functions.columns import clip_nonnegative, lookup
from placewise.settings import MONTH_NAMES, SEASONS


def parse_ts(value: Column, formats: Sequence[str] = ()) -> Column:
    """Timestamp from text; what no format can read becomes null."""
    text = value.cast("string")
    tries = [F.try_to_timestamp(text)] + [F.try_to_timestamp(text, F.lit(f)) for f in formats]
    return F.coalesce(*tries)


def date_parts(ts: Column) -> dict[str, Column]:
    """Year, month, day, day of week (Monday = 0), ISO week, quarter."""
    return {
        "year": F.year(ts),
        "month": F.month(ts),
        "day": F.dayofmonth(ts),
        "day_of_week": F.weekday(ts),
        "week_of_year": F.weekofyear(ts),
        "quarter": F.quarter(ts),
    }


def season(month: Column) -> Column:
    return lookup(month, SEASONS)


def is_summer(month: Column) -> Column:
    return F.coalesce(month.isin(6, 7, 8), F.lit(False)).cast("int")


def month_sin(month: Column) -> Column:
    return F.sin(2 * F.pi() * month / 12)


def month_cos(month: Column) -> Column:
    return F.cos(2 * F.pi() * month / 12)


def month_name(month: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(m) for m in MONTH_NAMES]), month)


UNITS = {"M": "month", "W": "week", "month": "month", "week": "week"}


def period_start(ts: Column, freq: str = "month") -> Column:
    """First day of the month or of the Monday-based week, as a date."""
    return F.trunc(F.to_date(ts), UNITS[freq])


def period_step(freq: str = "month") -> Column:
    return F.expr("interval 1 month" if UNITS[freq] == "month" else "interval 7 days")


def period_sequence(first: Column, last: Column, freq: str = "month") -> Column:
    """Every period start from first to last; empty when the range is empty, null when open."""
    empty = F.array().cast("array<date>")
    return F.when(first <= last, F.sequence(first, last, period_step(freq))).when(first > last, empty)


def resolution_days(opened: Column, closed: Column) -> Column:
    """Days between two timestamps, negatives as 0, null when either is missing."""
    micros = F.unix_micros(closed) - F.unix_micros(opened)
    return clip_nonnegative(micros / F.lit(86_400_000_000.0))


def building_age(year_built: Column, as_of_year: int) -> Column:
    return F.lit(float(as_of_year)) - year_built


def month_index(day: Column) -> Column:
    """Months since year 0; a plain integer time axis."""
    return F.year(day) * 12 + F.month(day) - 1
