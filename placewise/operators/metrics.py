"""Forecast and classification metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from placewise.functions.columns import clip_nonnegative
from placewise.functions.scoring import normalize_weights
from placewise.operators.position import with_position


def _metric_columns(y: Column, pred: Column) -> list[Column]:
    error = y - clip_nonnegative(pred)
    squared = error * error
    spread = F.var_pop(y) * F.count(y)
    return [
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(squared)).alias("rmse"),
        F.when(spread > 0, 1 - F.sum(squared) / spread)
        .when(F.sum(squared) == 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("r2"),
        (100 * F.avg(F.when(y != 0, F.abs(error / y)))).alias("mape"),
    ]


def _scored(predictions: DataFrame, y: str, pred: str) -> DataFrame:
    return predictions.where(F.col(y).isNotNull() & F.col(pred).isNotNull()).withColumns(
        {y: F.col(y).cast("double"), pred: F.col(pred).cast("double")}
    )


def regression_metrics(predictions: DataFrame, y: str = "y", pred: str = "y_pred") -> DataFrame:
    """One row: MAE, RMSE, R2, MAPE (zero targets left out), predictions raised to 0."""
    return _scored(predictions, y, pred).agg(*_metric_columns(F.col(y), F.col(pred)))


def compare_models(predictions: DataFrame, model: str = "model", y: str = "y", pred: str = "y_pred") -> DataFrame:
    return _scored(predictions, y, pred).groupBy(model).agg(*_metric_columns(F.col(y), F.col(pred)))


def best_of(metrics: DataFrame, model: str = "model") -> DataFrame:
    """Model with the lowest error and with the highest R2."""
    return metrics.agg(
        *[F.min_by(model, F.struct(m, model)).alias(f"best_{m}") for m in ("mae", "rmse", "mape")],
        F.min_by(model, F.struct(-F.col("r2"), model)).alias("best_r2"),
    )


def ablation_delta(metrics: DataFrame, base: str, model: str = "model", metric: str = "rmse") -> DataFrame:
    """Metric minus the base row's metric."""
    reference = metrics.where(F.col(model) == base).agg(F.max(metric)).scalar()
    return metrics.select(model, metric, (F.col(metric) - reference).alias("delta"))


def weighted_ensemble(
    predictions: DataFrame,
    weights: Mapping[str, float],
    keys: Sequence[str] = ("zip_code", "date"),
    renormalize: bool = True,
) -> DataFrame:
    """Weighted sum per key over the models that have a weight; by default over those present."""
    share = normalize_weights(weights)
    weight = F.create_map(*[F.lit(x) for kv in share.items() for x in kv])[F.col("model")]
    summed = (
        predictions.where(F.col("model").isin(*share) & F.col("y_pred").isNotNull())
        .withColumn("_w", weight)
        .groupBy(*keys)
        .agg(F.max("y").alias("y"), F.sum(F.col("_w") * F.col("y_pred")).alias("_sum"), F.sum("_w").alias("_all"))
    )
    value = F.col("_sum") / F.col("_all") if renormalize else F.col("_sum")
    return summed.select(*keys, F.lit("ensemble").alias("model"), "y", value.alias("y_pred"))


def residuals(predictions: DataFrame, y: str = "y", pred: str = "y_pred") -> DataFrame:
    return predictions.withColumn("residual", F.col(y) - F.col(pred))


# Coefficients of algorithm AS 241 (Wichura 1988), highest power first: (numerator, denominator) of the
# centre, of the tails up to sqrt(-ln p) = 5, and of the far tails.
NORMAL_CENTRE = (
    (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608),
    (5226.495278852854561, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0),
)
NORMAL_TAIL = (
    (7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734),
    (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0),
)
NORMAL_FAR_TAIL = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772),
    (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0),
)


def _ratio(coefficients: tuple[Sequence[float], Sequence[float]], x: Column) -> Column:
    top, bottom = (reduce(lambda value, c: value * x + F.lit(c), rest, F.lit(first)) for first, *rest in coefficients)
    return top / bottom


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution, exact to about 16 digits; null outside (0, 1)."""
    q = p - 0.5
    t = F.sqrt(-F.ln(F.least(p, 1 - p)))
    tail = F.when(t <= 5, _ratio(NORMAL_TAIL, t - 1.6)).otherwise(_ratio(NORMAL_FAR_TAIL, t - 5))
    value = F.when(F.abs(q) <= 0.425, q * _ratio(NORMAL_CENTRE, 0.180625 - q * q)).otherwise(F.signum(q) * tail)
    return F.when((p > 0) & (p < 1), value)


def qq_points(df: DataFrame, value: str, key: Sequence[str]) -> DataFrame:
    """Sorted values against normal quantiles at the median plotting positions."""
    placed = with_position(df.where(F.col(value).isNotNull()), [value, *key], size="_n")
    i, n = F.col("position"), F.col("_n")
    last = F.pow(F.lit(0.5), 1 / n)
    spot = (
        F.when(i == n, last).when(i == 1, 1 - last).otherwise((i - 0.3175) / (n + 0.365))
    )
    return placed.select(*key, F.col(value).alias("ordered"), i, normal_quantile(spot).alias("theoretical"))


def confusion_matrix(df: DataFrame, classes: Sequence, label: str = "label", pred: str = "pred") -> DataFrame:
    """Actual by predicted counts; all classes as columns, 0 where there is none."""
    return df.groupBy(label).pivot(pred, list(classes)).count().fillna(0)


def classification_report(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted averages.

    One pass over the rows counts (label, pred) pairs; the rest works on that small table.
    """
    pairs = df.groupBy(F.col(label).alias("l"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    sides = pairs.select(
        F.explode(F.array(
            F.struct(F.col("l").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                     F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(F.lit(0)).alias("hits")),
            F.struct(F.col("p").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"),
                     F.lit(0).cast("bigint").alias("hits")),
        )).alias("s")
    ).select("s.*")
    per = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])

    def ratio(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    per = per.select(
        F.col("class").cast("string").alias("class"),
        ratio(F.col("hits"), F.col("predicted")).alias("precision"),
        ratio(F.col("hits"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hits"), F.col("predicted") + F.col("support")).alias("f1"),
        "support", "hits",
    )
    parts = ("precision", "recall", "f1")
    whole = per.agg(
        *[F.avg(c).alias(f"macro_{c}") for c in parts],
        *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"weighted_{c}") for c in parts],
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        F.sum("support").alias("support"),
    ).select(F.inline(F.array(
        F.struct(F.lit("accuracy").alias("class"), *[F.col("accuracy").alias(c) for c in parts], "support"),
        *[
            F.struct(F.lit(f"{kind} avg").alias("class"), *[F.col(f"{kind}_{c}").alias(c) for c in parts], "support")
            for kind in ("macro", "weighted")
        ],
    )))
    return per.drop("hits").unionByName(whole)


def accuracy_pct(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    return df.agg((100 * F.avg((F.col(label) == F.col(pred)).cast("double"))).alias("accuracy_pct"))
