"""Cleaning and panel rules on small hand-made tables."""

import datetime as dt

from pyspark.sql import functions as F

from placewise.operators import clean
from placewise.operators.panel import agg_location_period, building_stats, join_buildings, join_violations, trailing_sum, zero_fill
from placewise.plans.master import create_master, dense_panel

RAW = "`Unique Key` string, `Created Date` string, `Closed Date` string, Borough string, `Incident Zip` string, Latitude string, Longitude string"


def raw(spark, rows):
    return spark.createDataFrame(rows, RAW)


def test_clean_complaints_drops_and_derives(spark):
    df = raw(spark, [
        ("1", "2024-01-31 12:00:00", "2024-02-01 00:00:00", "BROOKLYN", "11201-123", "40.7", "-74.0"),
        ("2", "2024-07-01 00:00:00", "2024-06-01 00:00:00", "brooklyn", "11201", "40.4", "-73.6"),
        ("3", "bad", None, "QUEENS", "11101", "41.0", "-74.3"),
        ("4", "2024-01-01 00:00:00", None, "Hoboken", "11101", "40.7", "-74.0"),
        ("5", "2024-01-01 00:00:00", None, "BRONX", "N/A", "40.7", "-74.0"),
        ("6", "2024-01-01 00:00:00", None, "BRONX", None, "40.7", "-74.0"),
        ("7", "2024-01-01 00:00:00", None, "BRONX", "10451", "", "-74.0"),
        ("8", "2024-01-01 00:00:00", None, "BRONX", "10451", "41.01", "-74.0"),
    ])
    got = {r["unique_key"]: r for r in clean.clean_complaints(df).collect()}
    assert set(got) == {"1", "2", "3"}
    one = got["1"]
    assert (one["zip_code"], one["borough"], one["resolution_days"]) == ("11201", "Brooklyn", 0.5)
    assert (one["year"], one["month"], one["day"], one["day_of_week"], one["week_of_year"], one["quarter"], one["season"]) == (2024, 1, 31, 2, 5, 1, "winter")
    assert got["2"]["resolution_days"] == 0.0 and got["2"]["season"] == "summer"
    assert got["3"]["created_date"] is None and got["3"]["resolution_days"] is None and got["3"]["season"] is None


def test_dedup_keeps_newest_and_is_stable_under_a_hot_key(spark):
    rows = [("a", f"2024-01-01 00:00:{i % 60:02d}", i) for i in range(3000)] + [("b", "2024-01-01 00:00:00", 1)]
    df = spark.createDataFrame(rows, "unique_key string, created_date string, v int").repartition(8)
    got = {r["unique_key"]: r["v"] for r in clean.dedup_key(df).collect()}
    assert got == {"a": 2999, "b": 1}
    assert clean.dedup_key(df.select("unique_key")).count() == 2
    assert clean.dedup_key(df.drop("unique_key").select("created_date")).count() == 60


def test_inspections_substring_and_words(spark):
    rows = [("2024-03-05", "Temperature not held", "11201", "3"), ("2024-03-06", "Live RAT seen", "11201", "BROOKLYN"), ("x", None, None, "Brooklyn"), ("2024-01-01", "clean", "1", "1")]
    df = spark.createDataFrame(rows, "inspection_date string, violation_description string, zipcode string, boro string")
    loose = clean.clean_inspections(df).orderBy("inspection_date").collect()
    assert [r["borough"] for r in loose] == ["Brooklyn", None]
    assert [(r["inspection_year"], r["inspection_month"]) for r in loose] == [(2024, 3), (2024, 3)]
    strict = clean.clean_inspections(df, whole_words=True).collect()
    assert [r["violation_description"] for r in strict] == ["Live RAT seen"]


def test_missing_zip_stays_null(spark):
    df = spark.createDataFrame([("rat", None)], "violation_description string, zip string")
    assert clean.clean_inspections(df).first()["zip_code"] is None


def test_buildings_alias_range_and_unknown(spark):
    df = spark.createDataFrame([("1799", "11201.0"), ("1800", "11201.0"), ("2025", "11201"), ("2026", "11201"), ("n/a", None)], "CNSTRCT_YR string, `ZIP` string")
    got = sorted((r["building_age"] is None, r["building_age"] or 0, r["zip_code"]) for r in clean.clean_buildings(df, 2025).collect())
    assert got == [(False, 0.0, "11201"), (False, 225.0, "11201"), (True, 0, None)]


def cleaned(spark, rows):
    return spark.createDataFrame(rows, "unique_key string, zip_code string, created_date timestamp, resolution_days double, borough string")


def ts(*a):
    return dt.datetime(*a)


def test_zero_fill_only_empty_cells(spark):
    rows = [
        ("1", "A", ts(2024, 1, 3), None, "X"),  # a cell with rows but none closed keeps a null mean
        ("2", "A", ts(2024, 3, 3), 2.0, "Y"), ("3", "A", ts(2024, 3, 4), 4.0, "Z"),
        ("4", "B", ts(2024, 2, 3), 1.0, None), ("5", "C", None, 1.0, None),
    ]
    panel = dense_panel(cleaned(spark, rows), tag="borough")
    got = {(r["zip_code"], r["period"].month): (r["complaint_count"], r["avg_resolution_days"], r["borough"]) for r in panel.collect()}
    assert len(got) == 9
    assert got[("A", 1)] == (1, None, "Z") and got[("A", 2)] == (0, 0.0, "Z") and got[("A", 3)] == (2, 3.0, "Z")
    assert got[("B", 1)] == (0, 0.0, None) and got[("B", 2)] == (1, 1.0, None) and got[("B", 3)] == (0, 0.0, None)
    assert [got[("C", m)][0] for m in (1, 2, 3)] == [0, 0, 0]


def test_zero_fill_undated_and_dated_rows_of_one_place(spark):
    rows = [("1", "A", None, 1.0, None), ("2", "A", ts(2024, 1, 3), 2.0, None), ("3", "B", ts(2024, 2, 1), None, None)]
    got = sorted((r["zip_code"], r["period"].month, r["complaint_count"]) for r in dense_panel(cleaned(spark, rows)).collect())
    assert got == [("A", 1, 1), ("A", 2, 0), ("B", 1, 0), ("B", 2, 1)]


def test_weekly_panel_starts_on_monday(spark):
    rows = [("1", "A", ts(2024, 1, 7), 1.0, None), ("2", "A", ts(2024, 1, 22), 1.0, None)]
    got = [r["period"] for r in dense_panel(cleaned(spark, rows), freq="week").orderBy("period").collect()]
    assert got == [dt.date(2024, 1, 1), dt.date(2024, 1, 8), dt.date(2024, 1, 15), dt.date(2024, 1, 22)]


def test_missing_resolution_column_gives_null(spark):
    rows = cleaned(spark, [("1", "A", ts(2024, 1, 3), 3.0, None)]).drop("resolution_days")
    assert agg_location_period(rows).first()["avg_resolution_days"] is None


def test_dense_panel_invariants(spark, small):
    from catalog.base import Tables
    from catalog.standins import complaints

    rows = complaints(Tables(spark, small))
    panel = dense_panel(rows)
    places, months = rows.select("zip_code").distinct().count(), panel.select("period").distinct().count()
    total, n = panel.agg(F.sum("complaint_count"), F.count("*")).first()
    assert (total, n) == (rows.count(), places * months)


def test_trailing_sum_rows_and_calendar(spark):
    monthly = spark.createDataFrame(
        [("A", dt.date(2024, m, 1), m) for m in (1, 2, 9, 10)], "zip_code string, period date, violation_count bigint"
    )
    rows = [r["restaurant_violations_nearby"] for r in trailing_sum(monthly).orderBy("period").collect()]
    assert rows == [1.0, 3.0, 12.0, 22.0]
    calendar = [r["restaurant_violations_nearby"] for r in trailing_sum(monthly, by_calendar=True).orderBy("period").collect()]
    assert calendar == [1.0, 3.0, 9.0, 19.0]


def test_building_stats_count_unknown_in_share(spark):
    df = spark.createDataFrame([("A", 60.0), ("A", None), ("A", 10.0), ("A", 20.0), ("B", None)], "zip_code string, building_age double")
    got = {r["zip_code"]: tuple(r)[1:] for r in building_stats(df).collect()}
    assert got == {"A": (30.0, 20.0, 3, 0.25), "B": (None, None, 0, 0.0)}


def test_missing_building_stats_take_panel_median(spark):
    panel = spark.createDataFrame([("A", 1), ("A", 2), ("B", 1), ("B", 2), ("C", 1), ("C", 2)], "zip_code string, n int")
    df = spark.createDataFrame([("A", 10.0), ("B", 30.0), ("Z", 999.0)], "zip_code string, building_age double")
    got = {(r["zip_code"], r["building_age_mean"], r["building_count"]) for r in join_buildings(panel, df).collect()}
    assert got == {("A", 10.0, 1), ("B", 30.0, 1), ("C", 20.0, None)}


def test_absent_tables_give_defaults(spark):
    panel = spark.createDataFrame([("A", dt.date(2024, 1, 1))], "zip_code string, period date")
    row = join_buildings(join_violations(panel, None), None).first()
    assert (row["restaurant_violations_nearby"], row["building_age_mean"], row["old_building_pct"]) == (0.0, 50.0, 0.5)


def test_create_master_without_optional_tables(spark):
    df = raw(spark, [("1", "2024-01-31 12:00:00", None, "BROOKLYN", "11201", "40.7", "-74.0"), ("2", "2024-03-01 00:00:00", None, "BRONX", "10451", "40.7", "-74.0")])
    got = create_master(df)
    assert got.count() == 6 and "building_age_median" not in got.columns
    assert {r["borough"] for r in got.where("zip_code = '10451'").collect()} == {"Bronx"}


def test_zero_fill_needs_one_shuffle_by_place(spark):
    cells = spark.createDataFrame([("A", dt.date(2024, 1, 1), 1, 1.0)], "zip_code string, period date, complaint_count bigint, avg_resolution_days double")
    plan = zero_fill(cells)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Join" not in plan
