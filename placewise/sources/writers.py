"""Writing tables and predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Overwrite a table; `fmt='csv'` adds a header row."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.save(path)


def write_predictions(df: DataFrame, path: str, keys: Sequence[str] = ("zip_code", "date")) -> None:
    """One table with key, model, truth and prediction, a folder per model."""
    df.select(*keys, "model", "y", "y_pred").write.mode("overwrite").partitionBy("model").parquet(path)


def write_packed(df: DataFrame, path: str, content: Column, by: str, per_file: int = 200) -> None:
    """Small files packed into few: `per_file` of them at most are the lines of one text file (base64), in a folder for each value of `by`.

    A store takes milliseconds to create, commit, list and open a file, however small it is. `packed=True` reads them back one by one.
    """
    line = F.regexp_replace(F.base64(content.cast("binary")), r"\s", "")
    df.select(by, line.alias("value")).write.option("maxRecordsPerFile", per_file).partitionBy(by).text(path)
