"""Raw files to models, metrics and indexes."""

from pyspark.sql import functions as F

from placewise.operators.texts import text_embed
from placewise.operators.vectors import attach, vector_search
from placewise.plans.forecast import load_models
from placewise.plans.train import build_indexes, train_forecasting
from placewise.sources.readers import read_through_cache


def write_raw(spark, folder):
    """Four years of complaints in four zips, derived from row numbers."""
    n = F.col("id")
    day = F.date_add(F.lit("2018-01-01").cast("date"), (n % 1461).cast("int"))
    boroughs = F.array(*[F.lit(b) for b in ("MANHATTAN", "BROOKLYN", "BRONX", "QUEENS")])
    zips = F.array(*[F.lit(z) for z in ("10001", "11201", "10451", "11101")])
    words = F.array(*[F.lit(w) for w in ("Rat sighting near garbage", "Mouse droppings in kitchen", "Burrow, backyard \"deep\"\nand wide")])
    spark.range(6000).select(
        n.cast("string").alias("Unique Key"), F.date_format(day, "yyyy-MM-dd HH:mm:ss").alias("Created Date"),
        F.date_format(F.date_add(day, 5), "yyyy-MM-dd HH:mm:ss").alias("Closed Date"),
        F.element_at(boroughs, ((n * 7 + F.floor(n / 11)) % 4 + 1).cast("int")).alias("Borough"),
        F.element_at(zips, ((n * 7 + F.floor(n / 11)) % 4 + 1).cast("int")).alias("Incident Zip"),
        F.lit("40.7").alias("Latitude"), F.lit("-74.0").alias("Longitude"), F.element_at(words, (n % 3 + 1).cast("int")).alias("Descriptor"),
    ).write.option("header", True).option("escape", '"').csv(f"{folder}/complaints")
    spark.range(800).select(
        F.date_format(F.date_add(F.lit("2018-01-01").cast("date"), (n % 1400).cast("int")), "yyyy-MM-dd").alias("inspection_date"),
        F.lit("live mice").alias("violation_description"), F.element_at(zips, (n % 3 + 1).cast("int")).alias("zipcode"),
    ).write.option("header", True).csv(f"{folder}/inspections")
    guides = [("Seal gaps.\n\nStore garbage in closed bins.\n\n" + "Inspect often. " * 40,)]
    spark.createDataFrame(guides, "value string").coalesce(1).write.text(f"{folder}/guidelines")


def test_cache_rebuilds_an_unfinished_table(spark, tmp_path):
    path = str(tmp_path / "cached")
    (tmp_path / "cached").mkdir()
    (tmp_path / "cached" / "part-0.tmp").write_text("left by a failed job")
    assert read_through_cache(spark, path, lambda: spark.range(3)).count() == 3
    assert read_through_cache(spark, path, lambda: spark.range(5)).count() == 3


def test_train_and_search(spark, tmp_path):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    write_raw(spark, raw)
    got = {r["model"]: r["rmse"] for r in train_forecasting(spark, raw, out, 2025, {"trees": 3, "depth": 3}).collect()}
    assert set(got) == {"baseline", "additive", "boosted", "sequence", "ensemble"} and all(v >= 0 for v in got.values())
    master = spark.read.parquet(f"{out}/master")
    assert master.count() == 4 * 48 and master.agg(F.sum("complaint_count")).first()[0] == 6000
    assert master.select("building_age_mean", "old_building_pct").distinct().collect() == [(50.0, 0.5)]
    features, model = load_models(spark, f"{out}/models")
    assert model.transform(features.apply(master)).count() == 4 * 36
    build_indexes(spark, raw, out)
    from pyspark.ml import PipelineModel

    encoder = PipelineModel.load(f"{out}/encoder")
    index = spark.read.parquet(f"{out}/complaint_index")
    assert index.count() == 6000
    asked = text_embed(spark.createDataFrame([(1, "mouse kitchen")], "query_id int, text string"), encoder)
    texts = {r["text"] for r in attach(vector_search(index, asked), index, ["text"]).collect()}
    assert texts == {"Mouse droppings in kitchen"}
    assert spark.read.parquet(f"{out}/guideline_index").count() == 2
