"""Waves, intervals and ablation against NumPy and plain loops."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from placewise.operators import ablation as AB
from placewise.operators import intervals as IV
from placewise.plans import forecast as FC
from placewise.plans import waves as WV

DAY = datetime.date
SCHEMA = "zip_code string, date date, complaint_count double, first string, width int"


def months(start, count):
    return [DAY(start + i // 12, i % 12 + 1, 1) for i in range(count)]


def panel(spark, places):
    """Rows of {place: values from 2015-01 on}; the extra columns clash with names used inside."""
    rows = [(z, d, None if v is None else float(v), "x", 7) for z, values in places.items() for d, v in zip(months(2015, len(values)), values)]
    return spark.createDataFrame(rows, SCHEMA)


def plain_waves(values):
    """Coefficients of one place by lstsq on the rows themselves, the ridge as further rows."""
    m = np.array([2015 * 12 + i for i, v in enumerate(values) if v is not None], float)
    y = np.array([v for v in values if v is not None], float)
    x = WV.design(m, np.full(len(m), m.min()), np.full(len(m), m.max()), WV.CHANGEPOINTS, WV.WAVES)
    extra = np.diag(np.sqrt(WV.ridge(WV.CHANGEPOINTS, WV.WAVES)))
    return np.linalg.lstsq(np.vstack([x, extra]), np.concatenate([y, np.zeros(len(extra))]), rcond=None)[0], x


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(3)
    t = np.arange(72)
    bent = 50 + 0.2 * t + np.maximum(t - 30, 0) * 1.5 + 12 * np.sin(2 * np.pi * t / 12) + rng.normal(0, 0.5, 72)
    return {"bent": bent.tolist(), "short": [5.0, 7.0], "one": [4.0], "gaps": [None, 3.0, None, 6.0, 9.0] * 6, "flat": [2.0] * 30}


def test_coefficients_per_place(spark, series):
    table = panel(spark, series)
    model = {r.zip_code: r for r in WV.fit_waves(table.unionAll(table)).collect()}  # doubled rows, halved ridge
    single = {r.zip_code: r for r in WV.fit_waves(table).collect()}
    assert set(single) == set(series) == set(model)
    for place in ("bent", "gaps", "flat"):
        r = single[place]
        expected, _ = plain_waves(series[place])
        assert np.allclose([*r.line, *r.bends, *r.sines, *r.cosines], expected, atol=1e-5)
    assert model["bent"].first == 2015 * 12 and model["bent"].last == 2015 * 12 + 71


def test_waves_follow_a_bend(spark, series):
    table = panel(spark, series)
    got = {(r.zip_code, r.date): r.y_pred for r in WV.predict_waves(table, WV.fit_waves(table)).collect()}
    expected, x = plain_waves(series["bent"])
    assert np.allclose([got["bent", d] for d in months(2015, 72)], np.maximum(x @ expected, 0), atol=1e-6)
    rmse = lambda pred: math.sqrt(np.mean([(p - v) ** 2 for p, v in zip(pred, series["bent"])]))
    straight = {r.date: r.y_pred for r in FC.additive_forecast(table).where("zip_code = 'bent'").collect()}
    assert rmse([got["bent", d] for d in months(2015, 72)]) < 0.5 * rmse([straight[d] for d in months(2015, 72)])
    unknown = panel(spark, {"new": [1.0]})
    assert WV.predict_waves(unknown, WV.fit_waves(table)).first().y_pred == 0.0
    assert WV.fit_waves(table.limit(0)).count() == 0


def plain_width(sizes, level):
    rank = math.ceil((len(sizes) + 1) * level - 1e-9)
    return sorted(sizes)[rank - 1] if rank <= len(sizes) else None


def test_widths_by_rank(spark):
    rng = np.random.default_rng(5)
    rows = [(z, h, float(rng.integers(0, 9)), 3.0) for z, n in (("a", 30), ("b", 9), ("c", 4), ("d", 12)) for h in (1, 2) for _ in range(n)]
    got = {(r.zip_code, r.horizon): r for r in IV.widths(spark.createDataFrame(rows, "zip_code string, horizon int, y double, y_pred double"), 0.9).collect()}
    for h in (1, 2):
        own = {z: [abs(r[2] - r[3]) for r in rows if r[0] == z and r[1] == h] for z in "abcd"}
        common = plain_width(sum(own.values(), []), 0.9)
        for z, sizes in own.items():
            few = len(sizes) < IV.LEAST or plain_width(sizes, 0.9) is None
            assert (got[z, h].width, got[z, h].pooled) == (common if few else plain_width(sizes, 0.9), few)


def test_backtest_sees_only_the_past(spark):
    values = [float(i % 12 + i // 12) for i in range(40)]
    table = panel(spark, {"a": values, "b": values[:30]})
    dates = IV.origins_before(F.lit(DAY(2018, 4, 1)), 4)
    got = IV.backtest(table, FC.fit_additive, FC.additive_value(F.col("date")), dates, 3).collect()
    assert {r.origin for r in got} == {DAY(2018, m, 1) for m in (1, 2, 3, 4)} and {r.zip_code for r in got} == {"a"}
    for r in got:
        assert r.date == DAY(2018, r.origin.month + r.horizon - 1, 1) and r.date <= DAY(2018, 4, 1)
        past = panel(spark, {"a": values[: 36 + r.origin.month - 1]})
        if r.horizon == 1:
            alone = FC.predict_additive(spark.createDataFrame([("a", r.date)], "zip_code string, date date"), FC.fit_additive(past)).first().y_pred
            assert r.y_pred == pytest.approx(alone)


def test_intervals_cover_what_they_promise(spark):
    rng = np.random.default_rng(11)
    places = {f"z{i}": np.maximum(60 + 0.1 * np.arange(96) + rng.normal(0, 5, 96), 0).tolist() for i in range(40)}
    rows = {r.horizon: r for r in FC.interval_coverage(panel(spark, places), held=12, origins=24).collect()}
    assert set(rows) == {1, 2, 3} and all(abs(r.covered - 0.8) <= 0.05 for r in rows.values())
    assert abs(np.mean([r.covered for r in rows.values()]) - 0.8) <= 0.02
    made = FC.forecast_intervals(panel(spark, {"a": [3.0] * 40, "new": [None] * 39 + [2.0]})).collect()
    assert {(r.zip_code, r.horizon) for r in made} == {(z, h) for z in ("a", "new") for h in (1, 2, 3)}
    assert all(r.low <= r.y_pred <= r.high for r in made if r.zip_code == "a") and all(r.low is None for r in made if r.zip_code == "new")


def test_ablation_equals_single_fits(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4))
    rows = [(*map(float, r), float(3 * r[0] - r[2] + rng.normal(0, 0.1)), i % 3, None) for i, r in enumerate(x)] + [(None, 1.0, 1.0, 1.0, 1.0, 0, None), (1.0, 1.0, 1.0, 1.0, None, 0, None)]
    table = spark.createDataFrame(rows, "a double, b double, c double, d double, y double, part int, fold string").repartition(5)
    groups = {"first": ["a", "b"], "last": ["d"]}
    got = {(r.left_out, r.fold): r for r in AB.ablation(table, ["a", "b", "c", "d"], groups, "y", F.col("part"), reg=0.0).collect()}
    assert set(got) == {(g, f) for g in ("", "first", "last") for f in (1, 2)}
    clean = table.where("a IS NOT NULL AND y IS NOT NULL")
    for (left_out, fold), r in got.items():
        kept = [c for c in "abcd" if c not in groups.get(left_out, [])]
        assembled = VectorAssembler(inputCols=kept, outputCol="v").transform(clean)
        model = LinearRegression(featuresCol="v", labelCol="y", solver="normal").fit(assembled.where(F.col("part") < fold))
        error = model.transform(assembled.where(F.col("part") == fold)).agg(F.sqrt(F.avg((F.col("y") - F.col("prediction")) ** 2))).first()[0]
        assert r.rmse == pytest.approx(error, rel=1e-6) and r.rows == 100
        assert r.delta == pytest.approx(r.rmse - got["", fold].rmse)
    assert got["first", 2].delta > 1 and abs(got["last", 2].delta) < 0.1
    assert AB.ablation(table.limit(0), ["a"], {}, "y", F.col("part")).count() == 0
