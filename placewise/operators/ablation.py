"""Which features a linear forecast needs, for every feature group and every rolling fold, from one pass over the rows.

The pass leaves, per fold, the products of all features with each other and with the target (a Gram matrix), added per task and
in one aggregate. From there on no row is read: a model without a group is the same matrix without its rows and columns, a
training set is the sum of the folds before the tested one, and a squared error on a fold follows from its products.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

#: Features of one call; the driver holds a matrix of that order per fold.
MOST_FEATURES, MOST_FOLDS = 2_000, 1_000


def grams(rows: DataFrame, features: Sequence[str], y: str, fold: Column) -> dict[int, np.ndarray]:
    """Per fold the products of (1, features, y); rows with a null in any of them or in the fold are left out."""
    if len(features) > MOST_FEATURES:
        raise ValueError(f"{len(features)} features; at most {MOST_FEATURES} have their products on the driver")
    width = len(features) + 2
    values = F.array(F.lit(1.0), *[F.col(f"`{c}`").cast("double") for c in [*features, y]])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            folds = batch.column(0).to_numpy()
            matrix = batch.column(1).flatten().to_numpy().reshape(-1, width)
            for f in np.unique(folds):
                own = matrix[folds == f]
                found[int(f)] = found.get(int(f), 0) + own.T @ own
        lists = pa.array([g.ravel().tolist() for g in found.values()], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), lists], ["fold", "products"])

    kept = rows.select(fold.cast("int").alias("fold"), values.alias("v")).where("fold IS NOT NULL AND NOT exists(v, x -> x IS NULL)")
    made = kept.mapInArrow(products, "fold int, products array<double>").groupBy("fold").agg(vector_to_array(Summarizer.sum(array_to_vector("products"))).alias("products"))
    found = made.limit(MOST_FOLDS + 1).collect()
    if len(found) > MOST_FOLDS:
        raise ValueError(f"more than {MOST_FOLDS} folds")
    return {r["fold"]: np.array(r["products"]).reshape(width, width) for r in found}


def solved(gram: np.ndarray, kept: Sequence[int], reg: float) -> np.ndarray:
    """Ridge coefficients of (1, kept features) from products; the intercept is free."""
    at = [0, *(k + 1 for k in kept)]
    penalty = np.diag([0.0, *[reg * gram[0, 0]] * len(kept)])
    return np.linalg.lstsq(gram[np.ix_(at, at)] + penalty, gram[at, -1], rcond=None)[0]


def squared_error(gram: np.ndarray, kept: Sequence[int], coefficients: np.ndarray) -> float:
    """Sum of squared errors on the rows behind a Gram matrix."""
    at = [0, *(k + 1 for k in kept)]
    return float(gram[-1, -1] - 2 * coefficients @ gram[at, -1] + coefficients @ gram[np.ix_(at, at)] @ coefficients)


def ablation(rows: DataFrame, features: Sequence[str], groups: Mapping[str, Sequence[str]], y: str, fold: Column, reg: float = 1e-6) -> DataFrame:
    """left_out, fold, rows, rmse and delta of ridge regressions on all earlier folds, tested on each fold but the first.

    `left_out` is '' for all features, else the group without which the model is fitted; `delta` is how much larger its error
    is. `reg` is per row of the training set.
    """
    features, found = list(features), grams(rows, features, y, fold)
    numbers = sorted(found)
    sets = {"": list(range(len(features)))} | {g: [i for i, f in enumerate(features) if f not in set(own)] for g, own in groups.items()}
    out, seen = [], None
    for number in numbers:
        if seen is not None:
            count = found[number][0, 0]
            errors = {g: np.sqrt(max(squared_error(found[number], kept, solved(seen, kept, reg)), 0.0) / count) for g, kept in sets.items()}
            out += [(g, number, int(count), float(e), float(e - errors[""])) for g, e in errors.items()]
        seen = found[number] if seen is None else seen + found[number]
    return rows.sparkSession.createDataFrame(out, "left_out string, fold int, rows bigint, rmse double, delta double")
