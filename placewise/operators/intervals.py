"""Forecast confidence: conformal intervals from residuals of forecasts made before their dates.

Forecasts are repeated from earlier origins: the model of an origin sees only rows before it. Sizes of residuals at a place and
a horizon give the width that a share `level` of them stays within, by the rank ceil((n + 1) * level); where a place has too few
for that rank, or fewer than `least`, all places of the horizon are pooled.

Rows meet origins by a list of dates, whose number is a parameter, so the work is the panel times the origins and each model
is a few sums. Ranks come from counts of distinct sizes, not from gathered rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

LEVEL, LEAST, ORIGINS, HORIZONS = 0.8, 10, 24, 3


def origins_before(last: Column, origins: int) -> Column:
    """Array of the `origins` month starts up to and including `last`, newest first."""
    return F.transform(F.sequence(F.lit(0), F.lit(origins - 1)), lambda i: F.add_months(F.trunc(last, "month"), -i))


def seen_from(panel: DataFrame, dates: Column, time: str = "date") -> DataFrame:
    """Each row once for every origin after it, in the column `origin`."""
    return panel.withColumn("origin", F.explode(F.filter(dates, lambda o: o > F.to_date(time))))


def backtest(panel: DataFrame, fit, value: Column, dates: Column, horizons: int = HORIZONS, key: str = "zip_code", time: str = "date", y: str = "complaint_count") -> DataFrame:
    """Forecasts of every origin for its next months: place, origin, horizon (1 is the origin's own month), date, y, y_pred.

    `fit(rows, keys)` gives one model row for each value of the keys, `value` the forecast from its columns and `date`.
    """
    model = fit(seen_from(panel, dates, time), [key, "origin"])
    ahead = F.transform(F.sequence(F.lit(1), F.lit(horizons)), lambda h: F.struct(h.alias("horizon"), F.add_months("origin", h - 1).alias("month")))
    made = model.select("*", F.explode(ahead).alias("a")).select("*", "a.horizon", F.col("a.month").alias(time))
    made = made.select(key, "origin", "horizon", time, value.alias("y_pred"))
    truth = panel.select(key, F.to_date(time).alias(time), F.col(y).cast("double").alias("y")).where("y IS NOT NULL")
    return made.join(truth, [key, time]).select(key, "origin", "horizon", time, "y", "y_pred")


def _width(residuals: DataFrame, keys: Sequence[str], level: float) -> DataFrame:
    """keys, n and width: the residual size of rank ceil((n + 1) * level), null where there are fewer."""
    sizes = residuals.groupBy(*keys, F.abs(F.col("y") - F.col("y_pred")).alias("size")).agg(F.count("*").alias("c"))
    own = Window.partitionBy(*keys)
    upto = sizes.select("*", F.sum("c").over(own.orderBy("size")).alias("upto"), F.sum("c").over(own).alias("n"))
    rank = F.ceil((F.col("n") + 1) * F.lit(level) - F.lit(1e-9))
    return upto.groupBy(*keys).agg(F.first("n").alias("n"), F.min(F.when(F.col("upto") >= rank, F.col("size"))).alias("width"))


def widths(residuals: DataFrame, level: float = LEVEL, least: int = LEAST, key: str = "zip_code") -> DataFrame:
    """place, horizon, width, and `pooled`, which is true where the place's own residuals were too few."""
    own = _width(residuals, [key, "horizon"], level)
    every = _width(residuals, ["horizon"], level).select("horizon", F.col("width").alias("common"))
    few = (F.col("n") < least) | F.col("width").isNull()
    return own.join(every, "horizon").select(key, "horizon", F.when(few, F.col("common")).otherwise(F.col("width")).alias("width"), few.alias("pooled"))


def with_intervals(forecasts: DataFrame, wide: DataFrame, key: str = "zip_code") -> DataFrame:
    """Forecasts (place, horizon, y_pred, ...) with `low`, not below 0, and `high`; null for a place without residuals."""
    joined = forecasts.join(wide.select(key, "horizon", "width", "pooled"), [key, "horizon"], "left")
    return joined.select(*forecasts.columns, F.greatest(F.col("y_pred") - F.col("width"), F.col("width") * 0).alias("low"), (F.col("y_pred") + F.col("width")).alias("high"), "pooled")


def coverage(rows: DataFrame) -> DataFrame:
    """horizon, n and the share of rows (y, low, high) inside their interval."""
    inside = F.col("y").between(F.col("low"), F.col("high"))
    return rows.where("low IS NOT NULL").groupBy("horizon").agg(F.count("*").alias("n"), F.avg(inside.cast("int")).alias("covered"))
