"""Exploration aggregates behind the dashboards and notebooks."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from placewise.operators.features import last_n_rows
from placewise.operators.position import exact_quantiles
from placewise.settings import DEFAULT_BUILDING_AGE


def global_stats(panel: DataFrame) -> DataFrame:
    """One row: mean, sample deviation and maximum used to normalise risk factors."""
    return panel.agg(
        F.avg("complaint_count").alias("complaints_mean"),
        F.stddev_samp("complaint_count").alias("complaints_std"),
        F.max("complaint_count").alias("complaints_max"),
        F.avg("restaurant_violations_nearby").alias("violations_mean"),
        F.stddev_samp("restaurant_violations_nearby").alias("violations_std"),
        F.avg("building_age_mean").alias("building_age_mean"),
        F.stddev_samp("building_age_mean").alias("building_age_std"),
    )


def location_stats(panel: DataFrame, by: str = "zip_code", recent: int = 6, labels: Sequence[str] = ()) -> DataFrame:
    """Totals, the last rows' sum, mean violations and mean age for every place at once.

    A zip has one row per period, so it is ranked and summed in one pass over one shuffle. Another
    `by`, such as borough, may hold most rows: its last rows in (zip, date) order come from a ranked
    branch that is cut per task before the shuffle, its totals from a map-side aggregate.
    """
    has = panel.columns
    means = [
        (F.avg("restaurant_violations_nearby") if "restaurant_violations_nearby" in has else F.lit(0.0)).alias("restaurant_violations"),
        (F.avg("building_age_mean") if "building_age_mean" in has else F.lit(DEFAULT_BUILDING_AGE)).alias("building_age"),
    ]
    total = F.sum("complaint_count").alias("total_complaints")
    tags = [F.max(c).alias(c) for c in labels]
    if by == "zip_code":
        newest = F.row_number().over(Window.partitionBy(by).orderBy(F.col("date").desc()))
        last = F.sum(F.when(F.col("_rank") <= recent, F.col("complaint_count"))).alias("recent_complaints")
        return panel.withColumn("_rank", newest).groupBy(by).agg(total, last, *means, *tags)
    last = last_n_rows(panel, recent, by, ["zip_code", "date"]).groupBy(F.col(by).alias("_by")).agg(F.sum("complaint_count").alias("recent_complaints"))
    return panel.groupBy(by).agg(total, *means, *tags).join(last, F.col(by).eqNullSafe(F.col("_by"))).drop("_by")


def location_stats_or_default(stats: DataFrame, places: DataFrame, by: str = "zip_code") -> DataFrame:
    """Statistics of the asked places; an unknown one gets 0, 0, 0 and the default age."""
    defaults = {"total_complaints": 0, "recent_complaints": 0, "restaurant_violations": 0.0, "building_age": DEFAULT_BUILDING_AGE}
    return places.join(stats, by, "left").fillna(defaults)


def group_sum(df: DataFrame, by: Column | str, value: str = "complaint_count") -> DataFrame:
    return df.groupBy(by).agg(F.sum(value).alias(value))


def group_mean_month(df: DataFrame, value: str = "complaint_count", time: str = "date") -> DataFrame:
    return df.groupBy(F.month(time).alias("month")).agg(F.avg(value).alias(value))


def summary_kpis(panel: DataFrame) -> DataFrame:
    return panel.agg(
        F.count("*").alias("records"),
        F.countDistinct("zip_code").alias("zip_codes"),
        F.min(F.year("date")).alias("first_year"),
        F.max(F.year("date")).alias("last_year"),
        F.sum("complaint_count").alias("total_complaints"),
        F.avg("complaint_count").alias("mean_complaints"),
    )


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per numeric column: count, mean, std, min, exact quartiles, max."""
    names = list(columns or numeric_columns(df))
    quartiles = exact_quantiles(df, names, [0.25, 0.5, 0.75])
    stats = df.agg(*[
        F.struct(
            F.lit(c).alias("column"),
            F.count(c).alias("count"),
            F.avg(c).alias("mean"),
            F.stddev_samp(c).alias("std"),
            F.min(F.col(c).cast("double")).alias("min"),
            *[F.lit(v).cast("double").alias(q) for q, v in zip(("q25", "q50", "q75"), quartiles[c])],
            F.max(F.col(c).cast("double")).alias("max"),
        ).alias(f"s{i}")
        for i, c in enumerate(names)
    ])
    return stats.select(F.inline(F.array(*[f"s{i}" for i in range(len(names))])))


def schema_profile(df: DataFrame) -> DataFrame:
    """Column name, type and non-null count, one row per column."""
    counts = df.agg(*[F.count(f.name).alias(f"c{i}") for i, f in enumerate(df.schema.fields)])
    rows = [
        F.struct(
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("type"),
            F.col(f"c{i}").alias("non_null"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return counts.select(F.inline(F.array(*rows)))


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, all in one pass: column_a, column_b, corr."""
    pairs = list(combinations_with_replacement(columns, 2))
    both = {
        (a, b): F.col(a).isNotNull() & F.col(b).isNotNull() for a, b in pairs
    }
    row = df.agg(*[F.when(F.count(F.when(both[p], 1)) > 1, F.corr(*p)).alias(f"r{i}") for i, p in enumerate(pairs)])
    cells = []
    for i, (a, b) in enumerate(pairs):
        for x, y in {(a, b), (b, a)}:
            cells.append(F.struct(F.lit(x).alias("column_a"), F.lit(y).alias("column_b"), F.col(f"r{i}").alias("corr")))
    return row.select(F.inline(F.array(*cells)))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins between minimum and maximum, the maximum in the last; empty bins included.

    One pass for the bounds, one that counts at most `bins` groups on the map side.
    """
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    low, high = values.agg(F.min("v")).scalar(), values.agg(F.max("v")).scalar()
    flat = F.col("high") == F.col("low")
    start = F.when(flat, F.col("low") - 0.5).otherwise(F.col("low"))
    step = F.when(flat, F.lit(1.0)).otherwise(F.col("high") - F.col("low")) / bins
    edged = values.withColumns({"low": low, "high": high}).withColumns({"start": start, "step": step})
    v, first, width = F.col("v"), F.col("start"), F.col("step")
    guess = F.least(F.floor((v - first) / width), F.lit(bins - 1))
    # a value on an edge belongs to the bin that starts there, whatever the division rounded to
    bin_of = (
        F.when(v < first + guess * width, guess - 1)
        .when((guess < bins - 1) & (v >= first + (guess + 1) * width), guess + 1)
        .otherwise(guess)
    )
    filled = edged.groupBy(bin_of.cast("int").alias("bin")).agg(F.count("*").alias("rows"))
    edges = (
        df.sparkSession.range(bins)
        .select(F.col("id").cast("int").alias("bin"), low.alias("low"), high.alias("high"))
        .select(
            "bin",
            (start + F.col("bin") * step).alias("left_edge"),
            (start + (F.col("bin") + 1) * step).alias("right_edge"),
        )
    )
    return edges.join(filled, "bin", "left").fillna(0, subset=["rows"])


def share_of_total(counts: DataFrame, value: str, name: str = "share_pct") -> DataFrame:
    """Percent of the column total; meant for an aggregate with a row per class."""
    total = counts.agg(F.sum(value)).scalar()
    return counts.withColumn(name, 100.0 * F.col(value) / total)


def top_groups(df: DataFrame, by: str, n: int, value: str = "complaint_count") -> DataFrame:
    """The n groups with the largest totals."""
    return group_sum(df, by, value).orderBy(F.col(value).desc(), F.col(by)).limit(n)
