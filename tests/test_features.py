"""Features, models, metrics."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from placewise.operators import features as W
from placewise.operators import metrics as M
from placewise.plans import forecast as FC


def panel_rows(places=3, months=40, seed=1):
    rng = random.Random(seed)
    start = dt.datetime(2020, 1, 1)
    days = pd.date_range(start, periods=months, freq="MS")
    return [
        (f"z{p}", d.to_pydatetime(), "X" if p % 2 else None, rng.randrange(0, 12), float(rng.randrange(9)), 20.0 + p, 0.1 * p)
        for p in range(places) for d in days
    ]


SCHEMA = "zip_code string, date timestamp, borough string, complaint_count bigint, restaurant_violations_nearby double, building_age_mean double, old_building_pct double"


@pytest.fixture(scope="module")
def panel(spark):
    return spark.createDataFrame(panel_rows(), SCHEMA).repartition(4)


def expected_features():
    pdf = pd.DataFrame(panel_rows(), columns=[c.split()[0] for c in SCHEMA.split(", ")]).sort_values(["zip_code", "date"])
    g = pdf.groupby("zip_code")["complaint_count"]
    for k in W.LAG_PERIODS:
        pdf[f"lag_{k}"] = g.shift(k)
    for k in W.ROLLING_WINDOWS:
        for stat in ("mean", "std", "max"):
            pdf[f"rolling_{stat}_{k}"] = g.transform(lambda x, k=k, stat=stat: getattr(x.shift(1).rolling(k, min_periods=1), stat)())
    pdf["mom_change"], pdf["yoy_change"] = g.diff(), g.diff(12)
    pdf["mom_pct_change"] = g.pct_change().replace([np.inf, -np.inf], np.nan)
    return pdf


def test_windows_equal_pandas(spark, panel):
    want = expected_features()
    names = [c for c in want.columns if c.startswith(("lag_", "rolling_", "mom_", "yoy_"))]
    got = W.add_features(panel).select("zip_code", "date", *[F.col(c).cast("double") for c in names]).toPandas().sort_values(["zip_code", "date"])
    np.testing.assert_allclose(got[names].to_numpy(float), want[names].to_numpy(float), atol=1e-9)


def test_all_windows_share_one_exchange(panel):
    plan = W.add_features(panel)._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("== Initial Plan ==")[-1]
    assert initial.count("Exchange hashpartitioning(zip_code") == 1 and initial.count("Sort [zip_code") == 1


def test_shifted_trend_uses_past_only(spark, panel):
    rows = W.add_features(panel, trend_shift=1).orderBy("zip_code", "date").collect()
    by = {(r["zip_code"], r["date"]): r for r in rows}
    for r in rows:
        if r["lag_2"] is not None:
            assert r["mom_change"] == r["lag_1"] - r["lag_2"]
    assert len(by) == len(rows)


def test_fit_apply_round_trip(spark, panel, tmp_path):
    model = W.fit_features(panel)
    df = model.apply(panel)
    n, = df.agg(F.count("*")).first()
    assert n == 3 * (40 - 12) and len(model.names) == 26
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in model.numeric], *[F.stddev_pop(c).alias(f"s_{c}") for c in model.numeric]).first()
    for c in model.numeric:
        assert stats[f"m_{c}"] == pytest.approx(0, abs=1e-9)
        assert stats[f"s_{c}"] == pytest.approx(1, abs=1e-9) or stats[f"s_{c}"] == 0
    assert model.categories["borough"] == ["Unknown", "X"]
    model.save(spark, str(tmp_path / "m"))
    assert W.FeatureModel.load(spark, str(tmp_path / "m")) == model


def test_fit_on_train_only(panel):
    early = W.fit_features(panel, train_before="2022-01-01")
    late = W.fit_features(panel)
    assert early.means["year"] < late.means["year"]


def test_encode_unseen(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("q",)], "c string")
    got = [r["i"] for r in df.select(W.encode(F.col("c"), ["a", "b"]).alias("i")).collect()]
    assert got == [1, 0, 2, 2]


def test_sequences_stay_inside_a_place(panel):
    got = W.sequences(panel, ["complaint_count"]).collect()
    assert len(got) == 3 * (40 - 12)
    rows = {(r[0], r[1]): r[3] for r in panel_rows()}
    days = sorted({r[1] for r in panel_rows()})
    for r in got:
        i = days.index(r["date"])
        assert [s["complaint_count"] for s in r["seq"]] == [rows[(r["zip_code"], d)] for d in days[i - 12:i]]
        assert r["target"] == rows[(r["zip_code"], r["date"])]


def test_additive_recovers_trend_and_season(spark):
    days = pd.date_range("2018-01-01", periods=48, freq="MS")
    rows = [("a", d.to_pydatetime(), int(100 + 2 * i + (30 if d.month == 7 else 0))) for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "zip_code string, date timestamp, complaint_count bigint")
    pred = {r["date"]: r["y_pred"] for r in FC.additive_forecast(df).collect()}
    assert max(abs(pred[d] - y) for _, d, y in rows) < 6
    flat = spark.createDataFrame([("b", days[0].to_pydatetime(), 5)], "zip_code string, date timestamp, complaint_count bigint")
    assert FC.additive_forecast(flat).first()["y_pred"] == 5.0
    ahead = FC.forecast_horizon(df).first()
    assert ahead["trend"] in ("increasing", "decreasing", "stable") and ahead["next_3_months"] > ahead["next_month"] > 150


def test_predictions_are_not_negative_and_unknown_places_zero(spark, panel):
    model = FC.fit_additive(panel)
    asked = spark.createDataFrame([("nowhere", dt.datetime(2024, 1, 1))], "zip_code string, date timestamp")
    assert FC.predict_additive(asked, model).first()["y_pred"] == 0.0


def test_ensemble_over_present_models(spark):
    d = dt.datetime(2024, 1, 1)
    rows = [("a", d, "m", 1.0, 10.0), ("a", d, "n", 1.0, 20.0), ("b", d, "m", 1.0, 10.0), ("b", d, "other", 1.0, 99.0)]
    df = spark.createDataFrame(rows, "zip_code string, date timestamp, model string, y double, y_pred double")
    weights = {"m": 3, "n": 1}
    got = {r["zip_code"]: r["y_pred"] for r in M.weighted_ensemble(df, weights).collect()}
    assert got == {"a": pytest.approx(12.5), "b": pytest.approx(10.0)}
    plain = {r["zip_code"]: r["y_pred"] for r in M.weighted_ensemble(df, weights, renormalize=False).collect()}
    assert plain["b"] == pytest.approx(7.5)


def test_metrics_edges(spark):
    df = spark.createDataFrame([(0.0, -5.0), (2.0, 1.0), (4.0, 4.0)], "y double, y_pred double")
    row = M.regression_metrics(df).first()
    assert (row["mae"], row["mape"]) == (pytest.approx(1 / 3), pytest.approx(25.0)) and row["r2"] == pytest.approx(1 - 1 / 8)
    zero = M.regression_metrics(spark.createDataFrame([(0.0, 0.0)], "y double, y_pred double")).first()
    assert zero["mape"] is None and zero["r2"] == 1.0


def test_classification_report_against_counts(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(4), rng.choice([0, 1, 2])) for _ in range(500)]
    got = {r["class"]: r for r in M.classification_report(spark.createDataFrame(rows, "label int, pred int")).collect()}
    for c in range(4):
        tp = sum(a == b == c for a, b in rows)
        found, support = sum(b == c for _, b in rows), sum(a == c for a, _ in rows)
        assert got[str(c)]["precision"] == pytest.approx(tp / found if found else 0) and got[str(c)]["recall"] == pytest.approx(tp / support)
        assert got[str(c)]["support"] == support
    assert got["accuracy"]["f1"] == pytest.approx(sum(a == b for a, b in rows) / 500)
    assert got["macro avg"]["recall"] == pytest.approx(np.mean([got[str(c)]["recall"] for c in range(4)]))


def test_qq_points(spark):
    from statistics import NormalDist

    values = [3.0, -1.0, 2.0, 2.0, 7.0]
    df = spark.createDataFrame(list(enumerate(values)), "k int, v double")
    got = M.qq_points(df, "v", ["k"]).orderBy("position").collect()
    n = len(values)
    spots = [1 - 0.5 ** (1 / n)] + [(i - 0.3175) / (n + 0.365) for i in range(2, n)] + [0.5 ** (1 / n)]
    assert [r["ordered"] for r in got] == sorted(values)
    assert [r["theoretical"] for r in got] == pytest.approx([NormalDist().inv_cdf(p) for p in spots])


def test_histogram_like_numpy(spark):
    from placewise.operators.explore import histogram

    rng = random.Random(9)
    values = [float(rng.randrange(0, 31)) for _ in range(800)] + [rng.uniform(0, 30) for _ in range(800)] + [None]
    got = histogram(spark.createDataFrame([(v,) for v in values], "v double"), "v", 50).orderBy("bin").collect()
    counts, edges = np.histogram([v for v in values if v is not None], bins=50)
    assert [r["rows"] for r in got] == list(counts)
    assert [r["left_edge"] for r in got] == pytest.approx(list(edges[:-1])) and got[-1]["right_edge"] == pytest.approx(edges[-1])
    flat = histogram(spark.createDataFrame([(2.0,), (2.0,)], "v double"), "v", 4).orderBy("bin").collect()
    assert [r["rows"] for r in flat] == list(np.histogram([2.0, 2.0], bins=4)[0])


def test_normal_quantile_equals_the_library(spark):
    from statistics import NormalDist

    spots = [1e-300, 1e-20, 1e-9, 0.001, 0.075, 0.0751, 0.3, 0.5, 0.7, 0.925, 0.99, 1 - 1e-12]
    rows = spark.createDataFrame([(p,) for p in [*spots, 0.0, 1.0]], "p double").select("p", M.normal_quantile(F.col("p")).alias("z")).collect()
    assert [r["z"] for r in rows[:-2]] == pytest.approx([NormalDist().inv_cdf(p) for p in spots], rel=1e-12, abs=1e-15)
    assert [r["z"] for r in rows[-2:]] == [None, None]


def test_boosting_stops_on_validation_rows(spark):
    rng = random.Random(8)
    rows = [(float(i % 7), float(rng.random()), i % 4 == 0) for i in range(400)]  # nothing to learn
    table = spark.createDataFrame(rows, "x double, complaint_count double, held boolean")
    free = FC.fit_boosted(table.where("NOT held"), ["x"], trees=8, depth=2)
    held = FC.fit_boosted(table, ["x"], validation=F.col("held"), trees=8, depth=2, patience=3)
    assert len(held.trees) < len(free.trees) == 8


def test_too_many_categories_are_refused(spark):
    with pytest.raises(ValueError):
        W.categories_of(spark.range(W.MOST_CATEGORIES + 5).select(F.col("id").cast("string").alias("c")), "c")


def test_boosted_and_sequence_models_learn(spark):
    days = pd.date_range("2012-01-01", periods=96, freq="MS")
    rng = random.Random(4)
    rows = [
        (f"z{p}", d.to_pydatetime(), "X", max(0, int(20 + 5 * p + 10 * np.sin(2 * np.pi * d.month / 12) + rng.gauss(0, 1))), 1.0, 30.0, 0.5)
        for p in range(4) for d in days
    ]
    table = spark.createDataFrame(rows, SCHEMA)
    features = W.fit_features(table, train_before="2018-01-01", trend_shift=1)
    trained = FC.train_forecasters(table, features, "2018-01-01", {"trees": 10, "depth": 4})
    scores = {r["model"]: r["mae"] for r in M.compare_models(trained["predictions"]).collect()}
    assert set(scores) == {"baseline", "additive", "boosted", "sequence", "ensemble"}
    assert scores["ensemble"] < scores["baseline"] and scores["boosted"] < scores["baseline"]
    importance = FC.feature_importance(spark, trained["boosted"])
    assert importance.count() == 26 and importance.agg(F.sum("importance")).first()[0] == pytest.approx(1)
    asked = spark.createDataFrame([("z0",), ("none",)], "zip_code string")
    got = FC.predict_location(table, features, trained["boosted"], 3, asked).collect()
    assert len(got) == 6 and all(r["y_pred"] == 0 for r in got if r["zip_code"] == "none") and all(r["y_pred"] > 0 for r in got if r["zip_code"] == "z0")
