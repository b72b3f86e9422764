"""The whole job: raw files to master table, models, predictions, metrics and search indexes.

    spark-submit -m placewise.plans.train <raw folder> <output folder> [--component all|forecasting|indexes]
"""

from __future__ import annotations

import argparse
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from placewise.operators.clean import clean_complaints
from placewise.operators.features import fit_features
from placewise.operators.metrics import compare_models
from placewise.operators.position import split_by_date
from placewise.operators.texts import build_complaint_index, build_guideline_index, fit_text_embedding
from placewise.plans.forecast import feature_importance, save_models, train_forecasters
from placewise.plans.master import create_master
from placewise.sources import readers
from placewise.sources.writers import write_predictions, write_table


def load_raw(
    spark: SparkSession, raw: str, fmt: str = "csv", multi_line: bool = True
) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Complaints, and inspections and buildings where they exist.

    Line breaks inside quoted CSV values need `multi_line`, which reads each file in one task; use it with many files, or
    switch it off where no value holds a line break.
    """

    def optional(name: str) -> DataFrame | None:
        try:
            reader = spark.read.format(fmt)
            if fmt == "csv":  # all columns are text; a quoted value may hold line breaks
                reader = reader.option("header", True).option("escape", '"').option("multiLine", multi_line)
            return reader.load(f"{raw}/{name}")
        except readers.AnalysisException as missing:
            if "PATH_NOT_FOUND" in (missing.getCondition() or ""):
                return None
            raise

    complaints = optional("complaints")
    if complaints is None:
        raise FileNotFoundError(f"{raw}/complaints")
    return complaints, optional("inspections"), optional("buildings")


def train_forecasting(spark: SparkSession, raw: str, out: str, as_of_year: int, boosting: Mapping | None = None, fmt: str = "csv") -> DataFrame:
    """Master table (built once), models fitted on the earliest 70 % of the dates, and the comparison on the last 15 %."""
    master = readers.read_through_cache(spark, f"{out}/master", lambda: create_master(*load_raw(spark, raw, fmt), as_of_year))
    cuts = split_by_date(master).groupBy("split").agg(F.min("date").alias("first")).collect()
    first = {r["split"]: r["first"] for r in cuts}
    train_before = first.get("val", first["test"])
    features = fit_features(master, train_before=train_before, trend_shift=1)
    held = first["test"] if "val" in first and "test" in first else None
    trained = train_forecasters(master, features, train_before, boosting, validate_before=held)
    save_models(features, trained["boosted"], spark, f"{out}/models")
    write_table(feature_importance(spark, trained["boosted"]), f"{out}/feature_importance")
    write_predictions(trained["predictions"], f"{out}/predictions")
    tested = spark.read.parquet(f"{out}/predictions").where(F.col("date") >= F.lit(first["test"]))
    write_table(compare_models(tested), f"{out}/model_comparison")
    return spark.read.parquet(f"{out}/model_comparison")


def build_indexes(spark: SparkSession, raw: str, out: str, separator: str = "\n\n", fmt: str = "csv") -> None:
    """Search tables over the cleaned complaints and the guideline files."""
    complaints = clean_complaints(load_raw(spark, raw, fmt)[0])
    encoder = fit_text_embedding(complaints, "descriptor")
    encoder.write().overwrite().save(f"{out}/encoder")
    write_table(build_complaint_index(complaints, encoder), f"{out}/complaint_index")
    guidelines = readers.read_documents(spark, f"{raw}/guidelines")
    write_table(build_guideline_index(guidelines, encoder, separator=separator), f"{out}/guideline_index")


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("raw")
    parser.add_argument("out")
    parser.add_argument("--component", choices=["all", "forecasting", "indexes"], default="all")
    parser.add_argument("--as-of-year", type=int, default=2025)
    parser.add_argument("--format", default="csv")
    args = parser.parse_args()
    spark = SparkSession.builder.appName("placewise-train").getOrCreate()
    if args.component in ("all", "forecasting"):
        train_forecasting(spark, args.raw, args.out, args.as_of_year, fmt=args.format).show(truncate=False)
    if args.component in ("all", "indexes"):
        build_indexes(spark, args.raw, args.out, fmt=args.format)


if __name__ == "__main__":
    main()
