"""Exact positions, splits and quantiles, with one group holding most rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from placewise.operators.position import drop_first_n, exact_quantiles, ranges, sort_columns, split_by_date, split_by_position, split_per_class, with_position
from placewise.sources.readers import with_pages


def skewed(spark, n=4000):
    rng = random.Random(3)
    rows = [(i, "hot" if rng.random() < 0.6 else f"g{rng.randrange(5)}", rng.randrange(50)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id bigint, grp string, v int").repartition(6)


def test_positions_in_groups(spark):
    rows, df = skewed(spark)
    expected = {}
    for g in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0]))
        expected |= {r[0]: (i + 1, len(own)) for i, r in enumerate(own)}
    got = with_position(df, ["-v", "id"], ["grp"], size="n")
    assert {r["id"]: (r["position"], r["n"]) for r in got.collect()} == expected


def test_hot_group_spreads_over_ranges(spark):
    _, df = skewed(spark)
    parts = df.withColumn("p", ranges(df, ["grp", "-v", "id"], 4)).groupBy("p").agg(F.count("*").alias("n"), F.countDistinct("grp").alias("g")).collect()
    assert len(parts) == 4 and max(r["n"] for r in parts) < 2000  # the hot group has about 2,400 rows


def test_ranges_follow_the_order(spark):
    rows = [(None if i % 11 == 0 else i * 7 % 50, None if i % 13 == 0 else f"s{i * 3 % 40}", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "a int, b string, i int").repartition(5)
    for order in (["a", "b", "i"], ["-a", "b", "-i"], ["b", "-a", "i"]):
        got = df.withColumn("p", ranges(df, order, 6)).orderBy(*sort_columns(order)).select("p").collect()
        parts = [r["p"] for r in got]
        assert parts == sorted(parts) and set(parts) == set(range(6))
        placed = with_position(df, order).orderBy(*sort_columns(order)).select("position").collect()
        assert [r["position"] for r in placed] == list(range(1, 3001))


def test_positions_store_nothing(spark):
    _, df = skewed(spark)
    plan = with_position(df, ["v", "id"], ["grp"])._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "ExistingRDD[_range" not in plan and "parquet" not in plan and plan.count("Window ") == 2
    assert with_position(df.limit(0), ["id"]).count() == 0


def test_null_group_is_a_group(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "id int, grp string")
    assert {(r["id"], r["position"]) for r in with_position(df, ["id"], ["grp"]).collect()} == {(1, 1), (2, 2), (3, 1)}


def test_pages_cover_the_whole_read(spark):
    _, df = skewed(spark, 1050)
    got = {r["page"]: r["count"] for r in with_pages(df, ["id"], 100).groupBy("page").count().collect()}
    assert got == {i: 100 for i in range(10)} | {10: 50}


@pytest.mark.parametrize("n", [1, 7, 101])
def test_split_by_position(spark, n):
    df = spark.range(n).withColumnRenamed("id", "k").repartition(3)
    got = [r["split"] for r in split_by_position(df, ["k"]).orderBy("k").collect()]
    a, b = int(n * 0.7), int(n * (0.7 + 0.15))
    assert got == ["train"] * a + ["val"] * (b - a) + ["test"] * (n - b)


def test_split_by_date_keeps_dates_whole(spark):
    rows = [(d, i) for d in range(20) for i in range(50 if d == 3 else 10)]
    df = spark.createDataFrame(rows, "date int, i int")
    per = {}
    for r in split_by_date(df).collect():
        per.setdefault(r["date"], set()).add(r["split"])
    assert all(len(s) == 1 for s in per.values())
    order = [next(iter(per[d])) for d in sorted(per)]
    assert order == sorted(order, key=["train", "val", "test"].index)
    total = len(rows)
    upto = sum(1 for d, _ in rows if per[d] == {"train"})
    assert upto <= total * 0.7


def test_split_per_class(spark):
    rows, df = skewed(spark, 1003)
    got = {r["id"]: r["split"] for r in split_per_class(df, "grp", ["id"]).collect()}
    for g in {r[1] for r in rows}:
        own = sorted(r[0] for r in rows if r[1] == g)
        cut = int(len(own) * 0.8)
        assert [got[i] for i in own] == ["train"] * cut + ["val"] * (len(own) - cut)


def test_drop_first_rows(spark):
    df = spark.createDataFrame([(z, d) for z in "ab" for d in range(5)], "zip_code string, date int")
    assert drop_first_n(df, 2).count() == 6
    kept = drop_first_n(df, 2, first_key_only=True).groupBy("zip_code").count().collect()
    assert {(r["zip_code"], r["count"]) for r in kept} == {("a", 3), ("b", 5)}


def test_exact_quantiles_with_ties_nulls_and_one_value(spark):
    rng = random.Random(5)
    rows = [
        (0.0 if i % 3 else rng.gauss(0, 100), None if i % 7 == 0 else rng.randrange(5), 4.0, None if i else 2.0, None)
        for i in range(5003)
    ]
    df = spark.createDataFrame(rows, "a double, b int, c double, d double, e double").repartition(5)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = exact_quantiles(df, list("abcde"), probs, accuracy=100)
    for i, c in enumerate("abcd"):
        values = [r[i] for r in rows if r[i] is not None]
        assert got[c] == pytest.approx(list(np.quantile(values, probs)), abs=1e-12)
    assert got["e"] == [None] * len(probs)


def test_first_date_trains_whatever_its_share(spark):
    df = spark.createDataFrame([(1,)] * 9 + [(2,)], "date int")
    assert {(r["date"], r["split"]) for r in split_by_date(df).collect()} == {(1, "train"), (2, "test")}
