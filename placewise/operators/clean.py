"""Cleaning of the three raw tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from placewise.functions.columns import has_keyword, in_box, is_zip5, lookup, to_numeric, zip5
from placewise.functions.dates import building_age, date_parts, parse_ts, resolution_days, season
from placewise.settings import (
    BORO_CODES,
    BOROUGH_NAMES,
    BUILDING_ZIP_ALIASES,
    FIRST_YEAR_BUILT,
    INSPECTION_ZIP_ALIASES,
    LAT_RANGE,
    LON_RANGE,
    RODENT_KEYWORDS,
    YEAR_BUILT_ALIASES,
)


def rename_snake(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower().replace(" ", "_") for c in df.columns])


def first_alias(df: DataFrame, aliases: Sequence[str]) -> str | None:
    """First of the names that the table has."""
    return next((a for a in aliases if a in df.columns), None)


def available(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    return [c for c in wanted if c in df.columns]


def dedup_key(df: DataFrame, key: str = "unique_key", newest: str | None = "created_date") -> DataFrame:
    """One row per key, the newest; a plain distinct when the key column is missing.

    A max over a struct combines on the map side, so a key with very many copies does not
    gather in one task as it would under a row_number window. Spark plans it as a sort aggregate: each task
    sorts its own rows by key and ships one row a key. (A hash aggregate of key and newest date would have to
    be joined back, which shuffles all copies of all rows.)
    """
    if key not in df.columns:
        return df.distinct()
    rest = [c for c in df.columns if c != key]
    lead = [newest] if newest in rest else []
    ranked = F.struct(*lead, *[c for c in rest if c not in lead])
    best = df.groupBy(key).agg(F.max(ranked).alias("_row"))
    return best.select(*[F.col(key) if c == key else F.col(f"_row.{c}").alias(c) for c in df.columns])


def clean_complaints(
    df: DataFrame,
    borough_names: Mapping[str, str] = BOROUGH_NAMES,
    lat_range: tuple[float, float] = LAT_RANGE,
    lon_range: tuple[float, float] = LON_RANGE,
    date_formats: Sequence[str] = (),
) -> DataFrame:
    """Dates, calendar parts, borough, zip, resolution days, coordinate box, one row per key."""
    out = rename_snake(df)
    has = set(out.columns)
    dates = [c for c in ("created_date", "closed_date", "due_date") if c in has]
    out = out.withColumns({c: parse_ts(F.col(c), date_formats) for c in dates})
    extra = {}
    if "borough" in has:
        extra["borough"] = lookup(F.upper("borough"), borough_names)
    extra |= {c: to_numeric(F.col(c)) for c in ("latitude", "longitude") if c in has}
    if "incident_zip" in has:
        extra["zip_code"] = zip5(F.col("incident_zip"))
    if extra:
        out = out.withColumns(extra)
    if "borough" in has:
        out = out.dropna(subset=["borough"])
    if "incident_zip" in has:
        out = out.where(is_zip5(F.col("zip_code")))
    if {"latitude", "longitude"} <= has:
        out = out.where(in_box(F.col("latitude"), F.col("longitude"), lat_range, lon_range))
    out = dedup_key(out)
    derived = {}
    if "created_date" in has:
        created = F.col("created_date")
        derived |= date_parts(created)
        derived["season"] = season(F.month(created))
        if "closed_date" in has:
            derived["resolution_days"] = resolution_days(created, F.col("closed_date"))
    return out.withColumns(derived) if derived else out


def clean_inspections(
    df: DataFrame,
    keywords: Sequence[str] = RODENT_KEYWORDS,
    whole_words: bool = False,
    boro_codes: Mapping[str, str] = BORO_CODES,
    date_formats: Sequence[str] = (),
) -> DataFrame:
    """Dates, keyword filter, zip, borough by code or name, coordinates."""
    out = rename_snake(df)
    has = set(out.columns)
    if "violation_description" in has:
        out = out.where(has_keyword(F.col("violation_description"), keywords, whole_words))
    extra = {}
    if "inspection_date" in has:
        extra["inspection_date"] = parse_ts(F.col("inspection_date"), date_formats)
    zip_col = first_alias(out, INSPECTION_ZIP_ALIASES)
    if zip_col:
        extra["zip_code"] = zip5(F.col(zip_col))
    if "boro" in has:
        extra["borough"] = lookup(F.col("boro").cast("string"), boro_codes)
    extra |= {c: to_numeric(F.col(c)) for c in ("latitude", "longitude") if c in has}
    if extra:
        out = out.withColumns(extra)
    if "inspection_date" in has:
        out = out.withColumns({
            "inspection_year": F.year("inspection_date"),
            "inspection_month": F.month("inspection_date"),
        })
    return out


def clean_buildings(df: DataFrame, as_of_year: int) -> DataFrame:
    """Year built within range or unknown, age in `as_of_year`, zip."""
    out = rename_snake(df)
    year_col = first_alias(out, YEAR_BUILT_ALIASES)
    zip_col = first_alias(out, BUILDING_ZIP_ALIASES)
    if year_col:
        out = out.withColumn("year_built", to_numeric(F.col(year_col)))
        year = F.col("year_built")
        out = out.where(year.between(FIRST_YEAR_BUILT, as_of_year) | year.isNull())
        out = out.withColumn("building_age", building_age(year, as_of_year))
    if zip_col:
        out = out.withColumn("zip_code", zip5(F.col(zip_col)))
    return out


def at_place(df: DataFrame, zip_code: str | None = None, borough: str | None = None) -> DataFrame:
    """Rows of the zip if one is given, otherwise of the borough, otherwise all."""
    if zip_code and "zip_code" in df.columns:
        return df.where(F.col("zip_code") == zip_code)
    if borough and "borough" in df.columns:
        return df.where(F.col("borough") == borough)
    return df
