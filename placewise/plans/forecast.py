"""Forecast models: lag baseline, additive trend and season, boosted trees, sequence regression, ensemble."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from placewise.functions.columns import clip_nonnegative
from placewise.functions.dates import month_index, period_sequence
from placewise.operators import boosting
from placewise.operators.boosting import BoostedTrees
from placewise.operators.features import FeatureModel, last_n_rows, location_window, sequences
from placewise.operators.intervals import HORIZONS, LEAST, LEVEL, ORIGINS, backtest, coverage, origins_before, widths, with_intervals
from placewise.operators.metrics import weighted_ensemble
from placewise.session import materialize
from placewise.settings import ENSEMBLE_WEIGHTS, SEQUENCE_LENGTH

KEYS = ["zip_code", "date"]


def as_predictions(df: DataFrame, model: str, pred: str, y: str = "complaint_count", keys: Sequence[str] = KEYS) -> DataFrame:
    """The long form shared by every model: keys, model, y, y_pred."""
    return df.select(*keys, F.lit(model).alias("model"), F.col(y).cast("double").alias("y"), F.col(pred).cast("double").alias("y_pred"))


def baseline_lag1(panel: DataFrame, y: str = "complaint_count") -> DataFrame:
    previous = F.lag(y, 1).over(location_window())
    return as_predictions(panel.withColumn("_p", previous).where(F.col("_p").isNotNull()), "baseline", "_p", y)


def fit_additive(panel: DataFrame, key: str | Sequence[str] = "zip_code", time: str = "date", y: str = "complaint_count") -> DataFrame:
    """Per place (or per value of several keys) a linear trend over months and the mean residual per calendar month.

    One aggregate by (place, calendar month) keeps sums; the trend comes from adding at most twelve
    such rows per place, and a mean residual is mean(y) - intercept - slope * mean(t).
    """
    keys = [key] if isinstance(key, str) else list(key)
    t, v = month_index(F.col(time)).cast("double"), F.col(y).cast("double")
    months = panel.where(v.isNotNull()).groupBy(*keys, F.month(time).alias("m")).agg(
        F.count("*").alias("n"), F.sum(v).alias("sy"), F.sum(t).alias("st"),
        F.sum(t * v).alias("sty"), F.sum(t * t).alias("stt"),
    )
    per = months.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("n", "sy", "st", "sty", "stt")],
        F.collect_list(F.struct("m", F.col("n").alias("k"), F.col("sy").alias("a"), F.col("st").alias("b"))).alias("ms"),
    )
    bottom = F.col("n") * F.col("stt") - F.col("st") * F.col("st")
    slope = F.when(bottom > 0, (F.col("n") * F.col("sty") - F.col("st") * F.col("sy")) / bottom).otherwise(F.lit(0.0))
    line = per.withColumn("slope", slope).withColumn(
        "intercept", (F.col("sy") - F.col("slope") * F.col("st")) / F.col("n")
    )
    season = F.map_from_entries(F.transform(
        F.array_sort("ms"),
        lambda x: F.struct(x["m"], x["a"] / x["k"] - F.col("intercept") - F.col("slope") * x["b"] / x["k"]),
    ))
    return line.select(*keys, "slope", "intercept", season.alias("season"))


def additive_value(date: Column) -> Column:
    """Forecast from the model columns of the same row; 0 when they are missing."""
    season = F.coalesce(F.try_element_at("season", F.month(date)), F.lit(0.0))
    value = F.col("intercept") + F.col("slope") * month_index(date) + season
    return F.coalesce(clip_nonnegative(value), F.lit(0.0))


def predict_additive(rows: DataFrame, model: DataFrame, key: str = "zip_code", time: str = "date", output: str = "y_pred") -> DataFrame:
    """Trend plus season, not below 0; a place without a model gets 0."""
    joined = rows.join(model, key, "left")
    return joined.withColumn(output, additive_value(F.col(time))).drop("slope", "intercept", "season")


def additive_forecast(panel: DataFrame, train_before=None) -> DataFrame:
    """Predictions for all rows of the panel from a model of the rows before `train_before`."""
    train = panel if train_before is None else panel.where(F.col("date") < F.lit(train_before))
    return as_predictions(predict_additive(panel, fit_additive(train)), "additive", "y_pred")


def forecast_horizon(panel: DataFrame, months: int = 3, stable_share: float = 0.05) -> DataFrame:
    """Per place: next month, next months' sum, and direction against the same number of last months.

    The grid is extended by `months`; the change counts as stable within `stable_share`.
    """
    panel = materialize(panel.select("zip_code", "date", "complaint_count"))  # read three times
    last = panel.agg(F.max(F.to_date("date"))).scalar()
    model = fit_additive(panel)
    ahead = F.explode(period_sequence(F.add_months(last, 1), F.add_months(last, months)))
    future = model.select("*", ahead.alias("date")).withColumn("y_pred", additive_value(F.col("date")))
    recent = panel.where(F.col("date") > F.add_months(last, -months)).groupBy("zip_code").agg(F.sum("complaint_count").alias("recent"))
    sums = future.groupBy("zip_code").agg(
        F.max(F.when(F.col("date") == F.add_months(last, 1), F.col("y_pred"))).alias("next_month"),
        F.sum("y_pred").alias("next_3_months"),
    )
    change, base = F.col("next_3_months") - F.col("recent"), F.col("recent")
    trend = (
        F.when(change > base * stable_share, "increasing").when(change < -base * stable_share, "decreasing").otherwise("stable")
    )
    return sums.join(recent, "zip_code").select("zip_code", "next_month", "next_3_months", trend.alias("trend"))


def forecast_intervals(panel: DataFrame, months: int = HORIZONS, level: float = LEVEL, origins: int = ORIGINS, least: int = LEAST) -> DataFrame:
    """Per place and month ahead: zip_code, horizon, date, y_pred, low, high and `pooled`, by conformal intervals.

    The widths come from forecasts that were made from the last `origins` months, each from rows before it.
    """
    panel = materialize(panel.select("zip_code", "date", "complaint_count"))  # fitted twice, and the truth of the residuals
    last = panel.agg(F.max(F.to_date("date"))).first()[0]
    residuals = backtest(panel, fit_additive, additive_value(F.col("date")), origins_before(F.lit(last), origins), months)
    ahead = F.transform(F.sequence(F.lit(1), F.lit(months)), lambda h: F.struct(h.alias("horizon"), F.add_months(F.trunc(F.lit(last), "month"), h).alias("date")))
    future = fit_additive(panel).select("*", F.explode(ahead).alias("a")).select("*", "a.horizon", "a.date")
    made = future.select("zip_code", "horizon", "date", additive_value(F.col("date")).alias("y_pred"))
    return with_intervals(made, widths(residuals, level, least))


def interval_coverage(panel: DataFrame, held: int = 12, months: int = HORIZONS, level: float = LEVEL, origins: int = ORIGINS, least: int = LEAST) -> DataFrame:
    """Share of forecasts from the last `held` origins that lie within intervals from the `origins` before them, per horizon.

    An earlier forecast counts only if its date was past at the first held origin, so nothing is known ahead of time.
    """
    panel = materialize(panel.select("zip_code", "date", "complaint_count"))
    last = panel.agg(F.max(F.to_date("date"))).first()[0]
    made = materialize(backtest(panel, fit_additive, additive_value(F.col("date")), origins_before(F.lit(last), held + origins), months))
    first = F.add_months(F.trunc(F.lit(last), "month"), -(held - 1))
    known, later = made.where(F.col("date") < first), made.where(F.col("origin") >= first)
    return coverage(with_intervals(later, widths(known, level, least)))


def yoy_trend(panel: DataFrame, y: str = "complaint_count") -> DataFrame:
    """Per place at its last month: the trailing 12 rows' sum, the 12 before, and the change in percent."""
    w = location_window()
    sums = panel.select(
        "zip_code", "date",
        F.sum(y).over(w.rowsBetween(-11, 0)).alias("last_12"),
        F.when(F.count(y).over(w.rowsBetween(-23, -12)) == 12, F.sum(y).over(w.rowsBetween(-23, -12))).alias("previous_12"),
        F.lead("date").over(w).alias("_next"),
    ).where(F.col("_next").isNull())
    change = F.when(F.col("previous_12") != 0, 100 * (F.col("last_12") - F.col("previous_12")) / F.col("previous_12"))
    return sums.select("zip_code", "last_12", "previous_12", change.alias("yoy_pct"))


def fit_boosted(train: DataFrame, features: Sequence[str], y: str = "complaint_count", validation: Column | None = None, **params) -> BoostedTrees:
    """Gradient-boosted trees on the scaled features, with the settings' parameters; see `boosting.fit`.

    Rows where `validation` holds are not learnt from; boosting stops when the error on them no longer falls.
    """
    return boosting.fit(train, features, y, validation, **params)


def predict_boosted(rows: DataFrame, model: BoostedTrees) -> DataFrame:
    return as_predictions(model.transform(rows).withColumn("y_pred", clip_nonnegative(F.col("y_pred"))), "boosted", "y_pred")


def feature_importance(spark: SparkSession, model: BoostedTrees) -> DataFrame:
    """One row per feature, largest share of the gain first."""
    rows = [(f, float(v)) for f, v in zip(model.features, model.importances())]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(), "feature")


def flat_sequences(rows: DataFrame, features: Sequence[str], y: str = "complaint_count", length: int = SEQUENCE_LENGTH) -> DataFrame:
    """Each row's previous `length` steps as one vector."""
    windows = sequences(rows, features, y, length)
    flat = F.flatten(F.transform("seq", lambda s: F.array(*[s[f].cast("double") for f in features])))
    return windows.select(*KEYS, F.col("target").alias("y"), array_to_vector(flat).alias("features"))


def fit_sequence(train: DataFrame, features: Sequence[str], y: str = "complaint_count", reg: float = 1.0) -> LinearRegressionModel:
    """Ridge regression from the flattened window to the next value; the normal equations need one pass."""
    reader = LinearRegression(
        featuresCol="features", labelCol="y", predictionCol="y_pred", regParam=reg, elasticNetParam=0.0, solver="normal"
    )
    return reader.fit(flat_sequences(train, features, y))


def predict_sequence(rows: DataFrame, model: LinearRegressionModel, features: Sequence[str], y: str = "complaint_count") -> DataFrame:
    scored = model.transform(flat_sequences(rows, features, y))
    return as_predictions(scored.withColumn("y_pred", clip_nonnegative(F.col("y_pred"))), "sequence", "y_pred", "y")


def predict_location(
    panel: DataFrame, features: FeatureModel, model: BoostedTrees, periods: int = 3, places: DataFrame | None = None
) -> DataFrame:
    """Fitted values for the last rows of every place, newest first in `step`; an unknown place gets zeros."""
    fitted = predict_boosted(features.apply(panel), model)
    newest = Window.partitionBy("zip_code").orderBy(F.col("date").desc())
    recent = last_n_rows(fitted, periods).withColumn("step", F.row_number().over(newest)).select("zip_code", "step", "date", "y_pred")
    if places is None:
        return recent
    wanted = places.select("zip_code", F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("step"))
    return wanted.join(recent, ["zip_code", "step"], "left").fillna(0.0, subset=["y_pred"])


def ensemble(predictions: DataFrame, weights: Mapping[str, float] = ENSEMBLE_WEIGHTS) -> DataFrame:
    """Weighted mean per (place, date), over the models that have the key; see `weighted_ensemble`."""
    return weighted_ensemble(predictions, weights)


def train_forecasters(panel: DataFrame, features: FeatureModel, train_before, boosting: Mapping | None = None, validate_before=None, trees: BoostedTrees | None = None) -> dict:
    """Fits all models on rows before `train_before`; returns the models and long predictions for later rows.

    With `validate_before`, the rows from `train_before` up to it decide when boosting stops. `trees` are used as they are.
    """
    table = materialize(features.apply(panel))
    train = table.where(F.col("date") < F.lit(train_before))
    if trees is not None:
        pass
    elif validate_before is None:
        trees = fit_boosted(train, features.names, **(boosting or {}))
    else:
        seen = table.where(F.col("date") < F.lit(validate_before))
        trees = fit_boosted(seen, features.names, validation=F.col("date") >= F.lit(train_before), **(boosting or {}))
    reader = fit_sequence(train, features.numeric)
    later = F.col("date") >= F.lit(train_before)
    parts = [
        baseline_lag1(panel),
        additive_forecast(panel, train_before),
        predict_boosted(table, trees),
        predict_sequence(table, reader, features.numeric),
    ]
    long = parts[0]
    for part in parts[1:]:
        long = long.unionByName(part)
    long = materialize(long.where(later))  # read by the ensemble and by the caller
    return {"boosted": trees, "sequence": reader, "predictions": long.unionByName(ensemble(long))}


def fit_embedding_classifier(df: DataFrame, classes: int, vec: str = "embedding", label: str = "label", hidden: int = 256, max_iter: int = 50):
    """Dense layer and class layer on frozen vectors."""
    dim = df.select(F.size(vec)).first()[0]
    rows = df.select(array_to_vector(F.col(vec).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"))
    head = MultilayerPerceptronClassifier(layers=[dim, hidden, classes], maxIter=max_iter, seed=42, featuresCol="features", labelCol="label")
    return head.fit(rows)


def classify(scores: Column, classes: Sequence, no_evidence=None) -> Column:
    """Struct of predicted class, confidence, probability map and evidence flag from raw class scores."""
    from placewise.functions.scoring import argmax, softmax

    probabilities = softmax(scores)
    names = F.array(*[F.lit(c) for c in classes])
    predicted = F.try_element_at(names, argmax(scores) + 1)
    flag = F.lit(True) if no_evidence is None else predicted != F.lit(no_evidence)
    return F.struct(
        predicted.alias("predicted_class"),
        F.array_max(probabilities).alias("confidence"),
        F.map_from_arrays(names, probabilities).alias("probabilities"),
        flag.alias("is_rat_evidence"),
    )


def save_models(features: FeatureModel, trees: BoostedTrees, spark: SparkSession, path: str) -> None:
    features.save(spark, f"{path}/features")
    trees.save(spark, f"{path}/boosted")


def load_models(spark: SparkSession, path: str) -> tuple[FeatureModel, BoostedTrees]:
    return FeatureModel.load(spark, f"{path}/features"), BoostedTrees.load(spark, f"{path}/boosted")
