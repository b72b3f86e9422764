"""Scores, bands, wording."""

import random

import pytest
from pyspark.sql import functions as F

from placewise.functions import columns as C
from placewise.functions import scoring as S
from placewise.plans import reports as R
from placewise.plans.assess import assess_location, default_stats, factor_columns


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_golden_case(spark):
    stats = default_stats()
    f = factor_columns(stats, F.lit(25.0), F.lit(3.0), F.lit(65.0), F.lit(7), F.lit(8.0))
    score = S.risk_score(f)
    row = one(spark, score=score, level=S.risk_level(score), color=S.risk_color(score), **f)
    assert row["historical_complaints"] == 10.0 and row["forecast_risk"] == 4.0
    assert row["restaurant_violations"] == pytest.approx(10 / 3) and row["building_age"] == 7.5 and row["seasonal_factor"] == 8.5
    assert row["score"] == pytest.approx(5.791666666666667)
    assert (row["level"], row["color"]) == ("Low-Moderate", "#ffc107")


def test_missing_forecast_takes_history(spark):
    row = one(spark, **factor_columns(default_stats(), F.lit(120.0), F.lit(5.0), F.lit(None).cast("double"), F.lit(13), F.lit(None).cast("double")))
    assert row["forecast_risk"] == row["historical_complaints"]
    assert row["building_age"] == 9.0 and row["seasonal_factor"] == 5.0 and row["restaurant_violations"] == 5.0


def test_zero_deviation_and_null(spark):
    row = one(spark, a=S.zscore_to_10(F.lit(3.0), F.lit(1.0), F.lit(0.0)), b=S.zscore_to_10(F.lit(None).cast("double"), F.lit(1.0), F.lit(2.0)), c=C.clip_nonnegative(F.lit(None).cast("double")))
    assert row["a"] == 5.0 and row["b"] is None and row["c"] is None


def test_image_bonus_and_bounds(spark):
    low = {n: F.lit(0.0) for n in ("historical_complaints", "forecast_risk", "restaurant_violations", "building_age", "nearby_construction")}
    high = {n: F.lit(10.0) for n in low}
    row = one(
        spark, floor=S.risk_score(low | {"image_evidence": F.lit(0.0)}), bonus=S.risk_score(low | {"image_evidence": F.lit(8.0)}),
        top=S.risk_score(high | {"image_evidence": F.lit(10.0)}), no_bonus=S.risk_score(high | {"nearby_construction": F.lit(0.0), "image_evidence": F.lit(0.0)}),
    )
    assert row["floor"] == 1.0 and row["bonus"] == pytest.approx(1.6) and row["top"] == 10.0 and row["no_bonus"] == pytest.approx(9.0)


def test_contributing_sorted_by_weight_then_order(spark):
    f = {"historical_complaints": F.lit(5.0), "forecast_risk": F.lit(6.0), "restaurant_violations": F.lit(4.99), "seasonal_factor": F.lit(9.0), "image_evidence": F.lit(8.0)}
    got = one(spark, c=S.contributing_factors(f))["c"]
    assert [x["name"] for x in got] == ["historical_complaints", "forecast_risk", "seasonal_factor", "image_evidence"]
    assert [x["weight"] for x in got] == [pytest.approx(0.3), pytest.approx(0.25), 0.0, 0.0]


def test_explanation_texts(spark):
    none = S.contributing_factors({"historical_complaints": F.lit(1.0)})
    row = one(spark, a=S.explain_score(F.lit(2.0), none))
    assert row["a"] == "**Risk Score: 2.0/10 (Low)**\n\nNo major risk factors identified.\n"


def test_one_decimal_rounds_like_the_exact_binary_value(spark):
    rng = random.Random(7)
    values = [0.0, 0.05, 0.15, 0.25, 0.35, 0.45, 6.25, 6.35, 6.75, 10.35, 9.95, 99.95, -6.25, -0.35, 1234.55, 2.675, 1e6 + 0.05]
    values += [rng.uniform(-20, 20) for _ in range(3000)] + [rng.randrange(0, 4000) / 20 for _ in range(3000)] + [rng.randrange(0, 10**6) / 1000 for _ in range(3000)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", C.one_decimal(F.col("v")).alias("t")).collect()
    wrong = [(r["v"], r["t"]) for r in got if r["t"] != f"{r['v']:.1f}"]
    assert wrong == []


def test_softmax_and_argmax(spark):
    row = one(spark, p=S.softmax(F.array(F.lit(1000.0), F.lit(1000.0), F.lit(-1000.0))), i=S.argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0))))
    assert row["p"] == [0.5, 0.5, 0.0] and row["i"] == 1


def test_report_sections(spark):
    bare = R.report_prompt(F.lit("here"), F.lit(6.25))
    full = R.report_prompt(
        F.lit("here"), F.lit(6.5), F.lit(45), samples=F.array(*[F.lit(x) for x in "abcd"]), image_class=F.lit("rat"),
        image_confidence=F.lit(0.875), image_evidence=F.lit(True), context=F.lit("CTX"),
    )
    row = one(spark, bare=bare, full=full)
    assert "**Overall Risk Score:** 6.2/10\n\n## Historical Data\n- Total complaints in area: N/A\n" in row["bare"]
    assert "Image Analysis" not in row["bare"] and "Retrieved Context" not in row["bare"] and "Sample complaint" not in row["bare"]
    assert "- Sample complaint descriptions:\n  - a\n  - b\n  - c\n\n## Forecast Data" in row["full"] and "  - d" not in row["full"]
    assert "- Confidence: 87.5%\n- **WARNING**: Rat evidence" in row["full"] and "\n## Retrieved Context\nCTX\n\n## What to write" in row["full"]


def test_question_prompt_location_is_optional(spark):
    row = one(spark, a=R.question_prompt(F.lit("Q"), F.lit("C")), b=R.question_prompt(F.lit("Q"), F.lit("C"), F.lit("Z")))
    assert "Question: Q\n\n\n\nWhat our records and guidelines say:" in row["a"] and "\n\nLocation context: Z\n\n" in row["b"]


def test_assess_by_borough_and_with_optional_tables(spark):
    import datetime as dt

    rows = [(z, b, dt.datetime(2024, m, 1), m * k, 2.0 * k, 30.0 * k) for z, b, k in (("1", "X", 1), ("2", "X", 2), ("3", "Y", 3)) for m in range(1, 9)]
    panel = spark.createDataFrame(rows, "zip_code string, borough string, date timestamp, complaint_count bigint, restaurant_violations_nearby double, building_age_mean double")
    by_borough = {r["location"]["borough"]: r["historical_stats"] for r in assess_location(panel, "borough", month=1).collect()}
    # the last six rows of X in (zip, date) order all belong to zip 2
    assert by_borough["X"]["recent_complaints"] == 2 * sum(range(3, 9)) and by_borough["X"]["total_complaints"] == 3 * 36
    forecasts = spark.createDataFrame([("1", 100.0)], "zip_code string, predicted double")
    images = spark.createDataFrame([("1", "rat", 0.9), ("2", "no_evidence", 0.9)], "zip_code string, predicted_class string, confidence double")
    at = spark.createDataFrame([("1", 40.7, -74.0)], "zip_code string, latitude double, longitude double")
    got = {r["location"]["zip_code"]: r for r in assess_location(panel, month=7, forecasts=forecasts, images=images, coordinates=at).collect()}
    assert got["1"]["factors"]["forecast_risk"] == 10.0 and got["1"]["factors"]["image_evidence"] == 9.0 and got["1"]["location"]["latitude"] == 40.7
    assert got["3"]["factors"]["forecast_risk"] == got["3"]["factors"]["historical_complaints"] and got["3"]["location"]["latitude"] is None
    assert all(1 <= r["risk_score"] <= 10 for r in got.values())
    wanted = spark.createDataFrame([("3",), ("unknown",)], "zip_code string")
    some = {r["location"]["zip_code"]: r for r in assess_location(panel, month=7, asked=wanted).collect()}
    assert set(some) == {"3", "unknown"} and some["3"]["risk_score"] == got["3"]["risk_score"]
    assert tuple(some["unknown"]["historical_stats"]) == (0, 0, 0.0, 50.0) and some["unknown"]["factors"]["building_age"] == 6.0
    city = assess_location(panel.withColumn("city", F.lit("all")), "city", month=7).collect()
    assert len(city) == 1 and city[0]["historical_stats"]["total_complaints"] == 36 * 6 and city[0]["historical_stats"]["recent_complaints"] == 3 * sum(range(3, 9))


def test_images_reach_the_record(spark):
    from placewise.plans.assess import assess_location, image_evidence

    files = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2"), ("d", "2"), ("lost", "2")], "path string, zip_code string")
    stored = spark.createDataFrame([("a", [9.0, 0.0, 0.0]), ("b", [2.0, 0.0, 5.0]), ("c", [0.0, 0.0, 8.0]), ("d", [0.0, 0.0, 9.0])], "path string, s array<double>")
    found = image_evidence(files, stored, "s", classes=["rat", "burrow", "no_evidence"])
    got = {r["zip_code"]: r for r in found.collect()}
    assert got["1"]["predicted_class"] == "rat" and got["1"]["confidence"] > 0.99 and got["1"]["is_rat_evidence"]
    assert got["2"]["predicted_class"] == "no_evidence" and not got["2"]["is_rat_evidence"]
    rows = [(z, "2020-01-01", 5, 1.0, 30.0) for z in ("1", "2", "3")]
    schema = "zip_code string, date string, complaint_count bigint, restaurant_violations_nearby double, building_age_mean double"
    panel = spark.createDataFrame(rows, schema).withColumn("date", F.to_timestamp("date"))
    records = {r["location"]["zip_code"]: r["factors"]["image_evidence"] for r in assess_location(panel, month=1, images=found).collect()}
    assert records["1"] > 0 and records["2"] == 0 and records["3"] == 0


def test_report_table(spark):
    import datetime as dt

    rows = [(z, dt.datetime(2022 + m // 12, m % 12 + 1, 1), 10 if m < 12 else 15, 2.0, 30.0) for z in "ab" for m in range(24)]
    panel = spark.createDataFrame(rows, "zip_code string, date timestamp, complaint_count bigint, restaurant_violations_nearby double, building_age_mean double")
    contexts = spark.createDataFrame([("a", "CTX")], "zip_code string, context string")
    images = spark.createDataFrame([("b", "burrow", 0.5, True)], "zip_code string, predicted_class string, confidence double, is_rat_evidence boolean")
    got = {r["zip_code"]: r for r in R.report_table(panel, contexts, images, month=7).collect()}
    assert "- Year-over-year trend: +50.0%\n" in got["a"]["prompt"] and "- Total complaints in area: 300\n" in got["a"]["prompt"]
    assert "CTX" in got["a"]["prompt"] and "Image Analysis" not in got["a"]["prompt"]
    assert "- Detected evidence: burrow\n- Confidence: 50.0%\n- **WARNING**" in got["b"]["prompt"] and "Retrieved" not in got["b"]["prompt"]
    assert "- Key factors: Historical complaint volume in the area, Predicted future complaint activity" in got["a"]["summary"]
