"""Boosting on histograms against a plain search over all splits."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from placewise.operators import boosting as B


def shrunk(g, alpha):
    return np.sign(g) * max(abs(g) - alpha, 0)


def plain_tree(x, g, rows, depth, alpha, lam, least, rate, out):
    """Adds the weights of one tree, found by trying every value of every feature, to `out`."""
    def score(part):
        return shrunk(g[part].sum(), alpha) ** 2 / (len(part) + lam)

    best = (1e-12, None, None)
    for f in range(x.shape[1]) if depth else []:
        for v in np.unique(x[rows, f])[:-1]:
            left, right = rows[x[rows, f] <= v], rows[x[rows, f] > v]
            if min(len(left), len(right)) < least:
                continue
            gain = score(left) + score(right) - score(rows)
            if gain > best[0] + 1e-9:
                best = (gain, f, v)
    if best[1] is None:
        out[rows] -= rate * shrunk(g[rows].sum(), alpha) / (len(rows) + lam)
        return
    for side in (rows[x[rows, best[1]] <= best[2]], rows[x[rows, best[1]] > best[2]]):
        plain_tree(x, g, side, depth - 1, alpha, lam, least, rate, out)


def table(spark, x, y, parts=3):
    rows = [(*(None if np.isnan(v) else float(v) for v in r), float(t), i % 5 == 0) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, ", ".join(f"f{i} double" for i in range(x.shape[1])) + ", y double, held boolean").repartition(parts)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 12, (160, 3)).astype(float)
    return x, 3 * x[:, 0] + (x[:, 1] > 5) * 7 + rng.normal(size=160)


@pytest.mark.parametrize("alpha, lam, least", [(0.1, 1.0, 3), (5.0, 0.5, 1), (0.0, 20.0, 10)])
def test_equal_to_a_search_over_all_splits(spark, data, alpha, lam, least):
    x, y = data
    model = B.fit(table(spark, x, y), ["f0", "f1", "f2"], "y", trees=3, depth=3, row_share=1.0, column_share=1.0, alpha=alpha, lam=lam, least=least)
    total = np.full(len(y), y.mean())
    for _ in range(3):
        plain_tree(x, total - y, np.arange(len(y)), 3, alpha, lam, least, 0.1, total)
    assert model.start == pytest.approx(y.mean()) and np.allclose(model.values(x), total)


def test_stored_and_loaded_model_predicts_alike(spark, data, monkeypatch, tmp_path):
    x, y = data
    x = x.copy()
    x[::9, 1] = np.nan
    rows = table(spark, x, y)
    whole = B.fit(rows, ["f0", "f1", "f2"], "y", trees=5, depth=2)
    monkeypatch.setattr(B, "STORED_TREES", 2)
    again = B.fit(rows.repartition(2), ["f0", "f1", "f2"], "y", trees=5, depth=2)
    assert np.allclose(whole.values(x), again.values(x))  # stored sums and other tasks change nothing
    whole.save(spark, str(tmp_path / "model"))
    loaded = B.BoostedTrees.load(spark, str(tmp_path / "model"))
    got = loaded.transform(rows).select("f0", "f1", "f2", "y_pred").collect()
    assert np.allclose([r.y_pred for r in got], whole.values(np.array([[np.nan if v is None else v for v in r[:3]] for r in got])))
    assert whole.importances().sum() == pytest.approx(1) and len(whole.trees) == 5


def test_rows_and_columns_are_drawn(spark, data):
    x, y = data
    model = B.fit(table(spark, x, y), ["f0", "f1", "f2"], "y", trees=6, depth=2, row_share=0.5, column_share=0.4)
    assert all(len(set(t.feature[t.feature >= 0].tolist())) <= 1 for t in model.trees)
    draws = np.random.default_rng(0).integers(-(2**62), 2**62, 20000)
    assert abs((B._mixed(draws, 3) < 0.5).mean() - 0.5) < 0.02 and not np.allclose(B._mixed(draws, 3), B._mixed(draws, 4))


def test_odd_tables(spark):
    flat = spark.createDataFrame([(1.0, None, 2.0, False)] * 5 + [(None, None, None, False)], "f0 double, f1 double, y double, held boolean")
    model = B.fit(flat, ["f0", "f1"], "y", trees=3, depth=2)
    assert [r.y_pred for r in model.transform(flat).collect()] == [2.0] * 6
    assert B.fit(flat.where("y IS NULL"), ["f0", "f1"], "y", trees=3).transform(flat).first().y_pred == 0.0
    assert model.transform(flat.limit(0)).count() == 0


def test_stops_where_the_held_rows_gain_nothing(spark):
    rng = random.Random(8)
    x = np.array([[float(i % 7)] for i in range(300)])
    rows = table(spark, x, np.array([rng.random() for _ in x]))
    assert len(B.fit(rows, ["f0"], "y", validation=F.col("held"), trees=6, depth=2, patience=2).trees) < 6
