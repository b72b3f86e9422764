"""A search index that grows: rows are added, replaced and removed by id, and only changed texts are embedded.

The index is a list of data folders with rows, and of folders with the (id, number) of rows that later runs replaced or removed.
A run compares ids and content hashes, which are narrow columns; stored texts and vectors are not read and no stored row is
rewritten. Reading leaves out the replaced rows. `compact` rewrites only folders in which many rows are gone.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from placewise.session import materialize
from placewise.sources.manifest import latest, new_folder, publish


@dataclass
class Changes:
    """What a run did."""

    added: int
    changed: int
    removed: int
    unchanged: int


def content_hash(columns: Sequence[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def _union(spark: SparkSession, folders: Sequence[str]) -> DataFrame | None:
    return reduce(DataFrame.unionByName, [spark.read.parquet(f) for f in folders]) if folders else None


def _gone(spark: SparkSession, content: dict) -> DataFrame:
    found = _union(spark, content["gone"])
    return found if found is not None else spark.createDataFrame([], "id string, number bigint")


def _stored(spark: SparkSession, content: dict) -> DataFrame | None:
    rows = _union(spark, content["rows"])
    return None if rows is None else rows.join(_gone(spark, content), ["id", "number"], "left_anti")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The live rows, without bookkeeping columns."""
    _, content = latest(spark, path)
    rows = _stored(spark, content) if content else None
    if rows is None:
        raise FileNotFoundError(f"no index at {path}")
    return rows.drop("number", "content")


def upsert(path: str, rows: DataFrame, embed: Callable[[DataFrame], DataFrame], complete: bool = False, key: str = "id") -> Changes:
    """Brings the index to the state of `rows`; `embed` adds the vectors of the rows it gets.

    Rows without an id are left out, and of rows that share one the first by content counts. Ids that are not among the
    rows stay, unless `complete` says that the rows are all there are. Of two runs at once, one ends with FileExistsError.
    """
    spark = rows.sparkSession
    number, content = latest(spark, path)
    content = content or {"rows": [], "gone": []}
    others = [c for c in rows.columns if c != key]
    known = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("id"), *others)
    hashed = known.withColumn("content", content_hash(others))
    ids = hashed.groupBy("id").agg(F.min("content").alias("content"))
    before = _stored(spark, content)
    before = before.select("id", "number", F.col("content").alias("was")) if before is not None else spark.createDataFrame([], "id string, number bigint, was string")
    both = ids.join(before, "id", "full_outer")
    state = (
        F.when(F.col("was").isNull(), "added").when(F.col("content").isNull(), "removed").when(F.col("was") == F.col("content"), "unchanged").otherwise("changed")
    )
    compared = materialize(both.select("id", "content", "number", state.alias("state")))
    counts = {r["state"]: r["count"] for r in compared.groupBy("state").count().collect()}
    new = compared.where("state IN ('added', 'changed')").select("id", "content")
    old = compared.where("state = 'changed'" + (" OR state = 'removed'" if complete else "")).select("id", "number")
    changes = Changes(counts.get("added", 0), counts.get("changed", 0), counts.get("removed", 0) if complete else 0, counts.get("unchanged", 0))
    made = {"rows": list(content["rows"]), "gone": list(content["gone"])}
    if changes.added + changes.changed or not made["rows"]:
        chosen = hashed.join(new, ["id", "content"], "left_semi").dropDuplicates(["id"])
        folder = new_folder(path)
        embed(chosen).withColumn("number", F.lit(number + 1).cast("bigint")).write.parquet(folder)
        made["rows"].append(folder)
    if changes.changed + changes.removed:
        folder = new_folder(path)
        old.write.parquet(folder)
        made["gone"].append(folder)
    if made != content:
        publish(spark, path, made, number)
    return changes


def compact(spark: SparkSession, path: str, share: float = 0.2) -> list[str]:
    """Rewrites folders of which at least `share` of the rows are gone into one; returns those folders.

    Rows keep their numbers, and what is gone is kept for the other folders alone.
    """
    number, content = latest(spark, path)
    if not content:
        return []
    gone = materialize(_gone(spark, content))
    sparse, left = [], []
    for folder in content["rows"]:
        rows = spark.read.parquet(folder).select("id", "number")
        counted = rows.join(gone.withColumn("out", F.lit(1)), ["id", "number"], "left").agg(F.count("*").alias("n"), F.count("out").alias("out")).first()
        (sparse if counted["out"] and counted["out"] >= share * counted["n"] else left).append(folder)
    if not sparse:
        return []
    whole, rest = new_folder(path), new_folder(path)
    moved = _union(spark, sparse)
    moved.join(gone, ["id", "number"], "left_anti").write.parquet(whole)
    gone.join(moved.select("id", "number"), ["id", "number"], "left_anti").write.parquet(rest)
    publish(spark, path, {"rows": [*left, whole], "gone": [rest]}, number)
    return sparse
