"""Additive forecasts per place: a trend that bends at changepoints, and yearly waves.

The design of a row depends on its month alone, so one aggregate by (place, month), combined per task, holds all there is to
know; a place with a third of all rows is its months by then. Tasks take the months of many places at a time and solve
their normal equations together. Bends are held back by a ridge term, so that the trend breaks only where rows ask for it.

Time runs from 0 at a place's first month to 1 at its last one; the trend goes on with its last slope beyond it. Changepoints
lie evenly in the first `SPAN` of that time. Waves are sines and cosines of the month, of 1 to `WAVES` periods a year.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from placewise.functions.columns import clip_nonnegative
from placewise.functions.dates import month_index
from placewise.settings import ADDITIVE

CHANGEPOINTS, SPAN, WAVES = ADDITIVE["changepoints"], ADDITIVE["span"], ADDITIVE["waves"]
#: Ridge terms of the bends and of the waves; the line itself is free.
BEND_RIDGE, WAVE_RIDGE = ADDITIVE["bend_ridge"], ADDITIVE["wave_ridge"]
#: Places solved together.
PLACES = 512
_MODEL = "first double, last double, line array<double>, points array<double>, bends array<double>, sines array<double>, cosines array<double>"


def design(month: np.ndarray, first: np.ndarray, last: np.ndarray, changepoints: int, waves: int) -> np.ndarray:
    """(..., 2 + changepoints + 2 * waves) matrix of rows; `first` and `last` are the ends of the rows' places."""
    t = (month - first) / np.maximum(last - first, 1)
    points = SPAN * (np.arange(changepoints) + 1) / (changepoints + 1)
    turn = 2 * np.pi * np.mod(month, 12) / 12
    parts = [np.ones_like(t), t, *(np.maximum(t - p, 0) for p in points)]
    parts += [f(k * turn) for f in (np.sin, np.cos) for k in range(1, waves + 1)]
    return np.stack(parts, axis=-1)


def ridge(changepoints: int, waves: int) -> np.ndarray:
    """Diagonal of the ridge term; a trace on the line keeps a place of one month solvable."""
    return np.concatenate([np.full(2, 1e-9), np.full(changepoints, BEND_RIDGE), np.full(2 * waves, WAVE_RIDGE)])


def _solved(changepoints: int, waves: int):
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, PLACES) for whole in batches for at in range(0, whole.num_rows, PLACES)):
            lists, sizes = batch.column(1), np.array([len(x) for x in batch.column(1)])
            rows, place = np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            # months of a place side by side, with weight 0 where it has fewer than the longest
            filled = {}
            for name in ("m", "n", "s"):
                filled[name] = np.zeros((len(sizes), sizes.max()))
                filled[name][rows, place] = lists.flatten().field(name).to_numpy(zero_copy_only=False)
            low = np.where(filled["n"] > 0, filled["m"], np.inf).min(1)
            high = np.where(filled["n"] > 0, filled["m"], -np.inf).max(1)
            x = design(filled["m"], low[:, None], high[:, None], changepoints, waves)
            gram = np.einsum("pt,pti,ptj->pij", filled["n"], x, x) + np.diag(ridge(changepoints, waves))
            solution = np.linalg.solve(gram, np.einsum("pt,pti->pi", filled["s"], x)[..., None])[..., 0]
            points = np.tile(SPAN * (np.arange(changepoints) + 1) / (changepoints + 1), (len(sizes), 1))
            edges = np.cumsum([2, changepoints, waves])
            line, bends, sines, cosines = np.split(solution, edges, axis=1)
            arrays = [pa.array(part.tolist(), pa.list_(pa.float64())) for part in (line, points, bends, sines, cosines)]
            names = [batch.schema.names[0], "first", "last", "line", "points", "bends", "sines", "cosines"]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(low), pa.array(high), *arrays], names)

    return solve


def fit_waves(
    panel: DataFrame, key: str = "zip_code", time: str = "date", y: str = "complaint_count", changepoints: int = CHANGEPOINTS, waves: int = WAVES
) -> DataFrame:
    """Per place: first and last month, line, changepoints with their bends, sines and cosines. Null values do not count."""
    value = F.col(y).cast("double")
    months = panel.where(value.isNotNull()).groupBy(key, month_index(F.col(time)).cast("double").alias("m")).agg(F.count("*").cast("double").alias("n"), F.sum(value).alias("s"))
    places = months.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("m", "n", "s"))).alias("months"))  # one entry a month
    return places.mapInArrow(_solved(changepoints, waves), f"{key} {panel.schema[key].dataType.simpleString()}, {_MODEL}")


def _product(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)


def waves_sum(time: Column, model: Column | None = None) -> Column:
    """Value of a model, which is a struct column or else the columns of the same row."""
    part = (lambda name: F.col(name)) if model is None else (lambda name: model[name])
    month = month_index(time).cast("double")
    t = (month - part("first")) / F.greatest(part("last") - part("first"), F.lit(1.0))
    turn = 2 * F.lit(np.pi) * F.pmod(month, F.lit(12.0)) / 12
    bends = _product(F.transform(part("points"), lambda p: F.greatest(t - p, F.lit(0.0))), part("bends"))
    sines = _product(F.transform(part("sines"), lambda s, i: F.sin((i + 1) * turn)), part("sines"))
    cosines = _product(F.transform(part("cosines"), lambda c, i: F.cos((i + 1) * turn)), part("cosines"))
    return F.get(part("line"), F.lit(0)) + F.get(part("line"), F.lit(1)) * t + bends + sines + cosines


def waves_value(time: Column, model: Column | None = None) -> Column:
    """The same, not below 0, and 0 without a model."""
    return F.coalesce(clip_nonnegative(waves_sum(time, model)), F.lit(0.0))


def predict_waves(rows: DataFrame, model: DataFrame, key: str = "zip_code", time: str = "date", output: str = "y_pred") -> DataFrame:
    """The rows with the forecast; a place without a model gets 0."""
    name = "wave_model"
    while name in rows.columns:
        name += "_"
    packed = model.select(key, F.struct(*[c for c in model.columns if c != key]).alias(name))
    return rows.join(packed, key, "left").withColumn(output, waves_value(F.col(time), F.col(name))).drop(name)
