"""Panel features: lags, trailing windows, calendar, trend, encoding, scaling, sequences.

All windows share one specification (location, date), so Spark plans one exchange and one sort.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from placewise.functions.columns import lookup
from placewise.functions.dates import is_summer, month_cos, month_sin, season
from placewise.operators.position import drop_first_n, exact_quantiles
from placewise.session import materialize
from placewise.settings import LAG_PERIODS, ROLLING_WINDOWS, SEQUENCE_LENGTH

EXTERNAL = ["restaurant_violations_nearby", "building_age_mean", "old_building_pct"]
CATEGORICAL = ["borough", "season"]
# Category lists are held on the driver and as literals: longer ones are refused.
MOST_CATEGORIES = 10_000


def location_window(key: str = "zip_code", time: str = "date"):
    return Window.partitionBy(key).orderBy(time)


def lag_columns(target: Column, w, lags: Sequence[int] = LAG_PERIODS) -> dict[str, Column]:
    return {f"lag_{k}": F.lag(target, k).over(w) for k in lags}


def rolling_columns(target: Column, w, windows: Sequence[int] = ROLLING_WINDOWS) -> dict[str, Column]:
    """Mean, sample deviation and maximum of the previous rows, the current one excluded."""
    out = {}
    for k in windows:
        frame = w.rowsBetween(-k, -1)
        out[f"rolling_mean_{k}"] = F.avg(target).over(frame)
        out[f"rolling_std_{k}"] = F.stddev_samp(target).over(frame)
        out[f"rolling_max_{k}"] = F.max(target).over(frame)
    return out


def trend_columns(target: Column, w, shift: int = 0) -> dict[str, Column]:
    """Changes against the previous row and 12 rows back; `shift=1` uses only past values."""
    now = F.lag(target, shift).over(w) if shift else target
    before = F.lag(target, shift + 1).over(w)
    year_ago = F.lag(target, shift + 12).over(w)
    return {
        "mom_change": now - before,
        "yoy_change": now - year_ago,
        "mom_pct_change": F.when(before != 0, (now - before) / before),
    }


def calendar_columns(date: Column) -> dict[str, Column]:
    month = F.month(date)
    return {
        "year": F.year(date),
        "month": month,
        "quarter": F.quarter(date),
        "month_sin": month_sin(month),
        "month_cos": month_cos(month),
        "season": season(month),
        "is_summer": is_summer(month),
    }


def add_features(
    panel: DataFrame,
    target: str = "complaint_count",
    key: str = "zip_code",
    time: str = "date",
    lags: Sequence[int] = LAG_PERIODS,
    windows: Sequence[int] = ROLLING_WINDOWS,
    trend_shift: int = 0,
) -> DataFrame:
    w = location_window(key, time)
    y = F.col(target)
    return panel.withColumns(
        lag_columns(y, w, lags) | rolling_columns(y, w, windows) | trend_columns(y, w, trend_shift)
    ).withColumns(calendar_columns(F.col(time)))


def numeric_features(df: DataFrame, lags: Sequence[int] = LAG_PERIODS, windows: Sequence[int] = ROLLING_WINDOWS) -> list[str]:
    names = [f"lag_{k}" for k in lags]
    names += [f"rolling_{stat}_{k}" for k in windows for stat in ("mean", "std", "max")]
    names += ["year", "month_sin", "month_cos", "is_summer", "mom_change", "yoy_change", "mom_pct_change"]
    return names + [c for c in EXTERNAL if c in df.columns]


def categories_of(df: DataFrame, column: str) -> list[str]:
    """The distinct values in alphabetical order, null as 'Unknown'; more than MOST_CATEGORIES are an error."""
    rows = df.select(F.coalesce(F.col(column), F.lit("Unknown")).alias("c")).distinct().limit(MOST_CATEGORIES + 1).collect()
    if len(rows) > MOST_CATEGORIES:
        raise ValueError(f"{column} has more than {MOST_CATEGORIES} values")
    return sorted(r["c"] for r in rows)


def encode(value: Column, categories: Sequence[str]) -> Column:
    """Index in the category list; null and unseen values count as 'Unknown', appended last if new."""
    known = list(categories)
    if "Unknown" not in known:
        known.append("Unknown")
    places = {c: i for i, c in enumerate(known)}
    return lookup(F.coalesce(value, F.lit("Unknown")), places, places["Unknown"]).cast("int")


@dataclass
class FeatureModel:
    """Fitted statistics: a handful of numbers, used as literals when applied."""

    numeric: list[str]
    medians: dict[str, float | None]
    means: dict[str, float | None]
    scales: dict[str, float | None]
    categories: dict[str, list[str]] = field(default_factory=dict)
    lags: list[int] = field(default_factory=lambda: list(LAG_PERIODS))
    windows: list[int] = field(default_factory=lambda: list(ROLLING_WINDOWS))
    trend_shift: int = 0
    drop_first_key_only: bool = False

    @property
    def names(self) -> list[str]:
        return self.numeric + [f"{c}_encoded" for c in self.categories]

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "model string").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "FeatureModel":
        return cls(**json.loads(spark.read.parquet(path).first()["model"]))

    def prepare(self, panel: DataFrame, target: str = "complaint_count") -> DataFrame:
        """Unscaled features without the first rows of each location, which lack full lags."""
        out = add_features(panel, target, lags=self.lags, windows=self.windows, trend_shift=self.trend_shift)
        out = out.withColumns({f"{c}_encoded": encode(F.col(c), k) for c, k in self.categories.items()})
        return drop_first_n(out, max(self.lags), first_key_only=self.drop_first_key_only)

    def fill(self, df: DataFrame, with_zero: bool = False) -> DataFrame:
        """Null features take the fitted median, or 0."""
        return df.withColumns({
            c: F.coalesce(F.col(c).cast("double"), F.lit(0.0 if with_zero else self.medians[c])) for c in self.numeric
        })

    def scale(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - F.lit(self.means[c])) / F.lit(self.scales[c]) for c in self.numeric})

    def apply(self, panel: DataFrame, target: str = "complaint_count", with_zero: bool = False) -> DataFrame:
        return self.scale(self.fill(self.prepare(panel, target), with_zero))


def fit_features(
    panel: DataFrame,
    target: str = "complaint_count",
    train_before=None,
    lags: Sequence[int] = LAG_PERIODS,
    windows: Sequence[int] = ROLLING_WINDOWS,
    trend_shift: int = 0,
    drop_first_key_only: bool = False,
) -> FeatureModel:
    """Medians, means, population deviations and category lists.

    `train_before` limits the fit to earlier rows (features still see the full history).
    """
    model = FeatureModel(
        numeric=[], medians={}, means={}, scales={}, lags=list(lags), windows=list(windows),
        trend_shift=trend_shift, drop_first_key_only=drop_first_key_only,
    )
    base = model.prepare(panel, target)
    if train_before is not None:
        base = base.where(F.col("date") < F.lit(train_before))
    model.numeric = numeric_features(base, lags, windows)
    listed = [c for c in CATEGORICAL if c in base.columns]
    base = materialize(base.select(*[F.col(c).cast("double").alias(c) for c in model.numeric], *listed))  # read several times
    model.categories = {c: categories_of(base, c) for c in listed}
    middles = exact_quantiles(base, model.numeric, [0.5])
    model.medians = {c: (v[0] if v[0] is not None else 0.0) for c, v in middles.items()}
    model.means, model.scales = scaling_stats(model.fill(base), model.numeric)
    return model


def scaling_stats(df: DataFrame, columns: Sequence[str]) -> tuple[dict[str, float], dict[str, float]]:
    """Mean and population deviation per column; a deviation of 0 becomes 1."""
    row = df.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    return (
        {c: row[f"m{i}"] for i, c in enumerate(columns)},
        {c: row[f"s{i}"] or 1.0 for i, c in enumerate(columns)},
    )


def standard_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / population deviation, the statistics as scalar subqueries of one aggregate."""
    stats = {c: (df.agg(F.avg(c)).scalar(), df.agg(F.stddev_pop(c)).scalar()) for c in columns}
    return df.withColumns({
        c: (F.col(c) - mean) / F.when(std == 0, F.lit(1.0)).otherwise(std) for c, (mean, std) in stats.items()
    })


def feature_matrix(df: DataFrame, names: Sequence[str], output: str = "features") -> DataFrame:
    """Ordered feature vector column."""
    return VectorAssembler(inputCols=list(names), outputCol=output, handleInvalid="keep").transform(df)


def sequences(
    df: DataFrame,
    features: Sequence[str],
    target: str = "complaint_count",
    length: int = SEQUENCE_LENGTH,
    key: str = "zip_code",
    time: str = "date",
) -> DataFrame:
    """The `length` rows before each row as array<struct>, with that row's target; full windows only."""
    frame = location_window(key, time).rowsBetween(-length, -1)
    steps = F.collect_list(F.struct(*features)).over(frame)
    return (
        df.select(key, time, steps.alias("seq"), F.col(target).cast("double").alias("target"))
        .where(F.size("seq") == length)
    )


def last_n_rows(df: DataFrame, n: int, key: str = "zip_code", time: Sequence[str] = ("date",)) -> DataFrame:
    """The newest n rows per key; ranked with a per-task limit before the shuffle."""
    newest = Window.partitionBy(key).orderBy(*[F.col(t).desc() for t in time])
    return df.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= n).drop("_rank")
