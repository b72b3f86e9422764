"""Reading tables, text files and images, and the schemas of the raw inputs."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from placewise.operators.position import with_position
from placewise.settings import IMAGE_CLASSES, PAGE_SIZE
from placewise.sources import manifest

COMPLAINT_SCHEMA = (
    "unique_key string, created_date string, closed_date string, due_date string, borough string, "
    "incident_zip string, latitude string, longitude string, descriptor string, status string, "
    "resolution_description string"
)
INSPECTION_SCHEMA = (
    "inspection_date string, violation_code string, violation_description string, zipcode string, "
    "boro string, latitude string, longitude string"
)
BUILDING_SCHEMA = "yearbuilt string, zipcode string"
MASTER_SCHEMA = (
    "zip_code string, date timestamp, borough string, complaint_count bigint, avg_resolution_days double, "
    "restaurant_violations_nearby double, building_age_mean double, building_age_median double, "
    "building_count bigint, old_building_pct double"
)


def read_csv(
    spark: SparkSession, path: str, schema: str, timestamp_format: str | None = None, multi_line: bool = False
) -> DataFrame:
    """CSV with a header and an explicit schema, so codes such as zips stay text.

    `multi_line` allows line breaks inside quoted values, at the price of one task per file.
    """
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False)
    reader = reader.option("multiLine", multi_line).option("escape", '"')
    if timestamp_format:
        reader = reader.option("timestampFormat", timestamp_format)
    return reader.csv(path)


def read_json(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """Row records as JSON, one a line (or, with `multi_line`, a file as one array); absent fields are null."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def read_filtered(
    table: DataFrame,
    where: Column | str | None = None,
    select: Sequence[str] | None = None,
    order: Sequence[Column | str] | None = None,
    limit: int = -1,
) -> DataFrame:
    """Source read with filter, projection, order and row limit; the scan gets filter and columns."""
    out = table.where(where) if where is not None else table
    if order:
        out = out.orderBy(*order)
    if limit >= 0:
        out = out.limit(limit)
    return out.select(*select) if select else out


def read_complaints(table: DataFrame, limit: int = -1) -> DataFrame:
    """All complaints, or the newest `limit`; a whole read needs no order."""
    newest = [F.col("created_date").desc(), F.col("unique_key")] if limit >= 0 else None
    return read_filtered(table, order=newest, limit=limit)


def read_inspections(table: DataFrame, limit: int = -1) -> DataFrame:
    """Inspections with a pest code or a rodent description."""
    return read_filtered(table, F.col("violation_code").like("04%") | F.col("violation_description").like("%rodent%"), limit=limit)


def read_buildings(table: DataFrame, columns: Sequence[str], limit: int = -1) -> DataFrame:
    """All buildings; with a limit the first ones in the order of the columns, so that the same rows stay on every run."""
    return read_filtered(table, select=columns, order=[F.col(c) for c in columns] if limit >= 0 else None, limit=limit)


def count_rows(table: DataFrame) -> DataFrame:
    return table.agg(F.count("*").alias("row_count"))


def with_pages(table: DataFrame, order: Sequence[str], page_size: int = PAGE_SIZE) -> DataFrame:
    """Whole read cut into offset pages of a total order; column `page` starts at 0."""
    placed = with_position(table, order)
    return placed.withColumn("page", F.floor((F.col("position") - 1) / page_size).cast("bigint"))


def _unpacked(lines: Column) -> Column:
    """(place from 0, content) of every file in the text of a packed one (`writers.write_packed`)."""
    return F.posexplode(F.transform(F.slice(F.split(lines, "\n"), 1, F.regexp_count(lines, F.lit("\n"))), F.unbase64))


def read_documents(spark: SparkSession, folder: str, pattern: str = "*.txt", packed: bool = False) -> DataFrame:
    """One row per text file: file name and whole content. With `packed` one row for each file that the files hold, named
    by the packed file and its place there."""
    files = (
        spark.read.option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .text(folder, wholetext=True)
        .select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("text"), "_metadata.file_path")
    )
    if not packed:
        return files
    each = files.select("source", "file_path", _unpacked(F.col("text")).alias("place", "content"))
    name = F.concat_ws("#", "source", "place")
    return each.select(name.alias("source"), F.col("content").cast("string").alias("text"), F.concat_ws("#", "file_path", "place").alias("file_path"))


def read_images(
    spark: SparkSession,
    folder: str,
    classes: Sequence[str] = IMAGE_CLASSES,
    pattern: str = "*.{jpg,png}",
    folder_prefix: str = "",
    packed: bool = False,
) -> DataFrame:
    """Files below class folders: path, content, class name, label = place in the class list. With `packed` one row for each
    file that the files hold."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(folder)
    )
    if packed:
        each = files.select("path", "modificationTime", _unpacked(F.decode("content", "UTF-8")).alias("place", "content"))
        path = F.concat_ws("#", "path", "place")
        files = each.select(path.alias("path"), "modificationTime", F.length("content").cast("bigint").alias("length"), "content")
    folder_name = F.regexp_extract("path", rf"/{folder_prefix}([^/]+)/[^/]+$", 1)
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), folder_name)
    return (
        files.withColumn("class_name", folder_name)
        .withColumn("label", (place - 1).cast("int"))
        .where(F.col("label") >= 0)
    )


def read_optional(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame | None:
    """The table at `path`, or None when nothing is there; a driver-side check, no job."""
    try:
        return spark.read.format(fmt).schema(schema).load(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" in (missing.getCondition() or ""):
            return None
        raise


def read_through_cache(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], inputs: Sequence[str] | None = None, parameters: Mapping | None = None
) -> DataFrame:
    """The Parquet table at `path`; built and written on the first call.

    A folder without the mark of a finished write, left by a job that failed, is written anew. With `inputs` (folders or files)
    the table is built again whenever one of their files or a parameter is another: the data go to a folder of their own,
    and a manifest with the fingerprint of the inputs makes them the table at once, so readers see the old or the new one whole.
    """
    if inputs is None:
        done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
        if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            build().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)
    mark = manifest.fingerprint(spark, inputs, parameters)
    while True:
        number, content = manifest.latest(spark, path)
        if content and content["fingerprint"] == mark:
            return spark.read.parquet(content["data"])
        folder = manifest.new_folder(path)
        build().write.parquet(folder)
        if manifest.fingerprint(spark, inputs, parameters) != mark:  # an input changed while it was read
            mark = manifest.fingerprint(spark, inputs, parameters)
            continue
        try:
            manifest.publish(spark, path, {"fingerprint": mark, "data": folder}, number)
        except FileExistsError:  # another job was first; its table may do
            continue
