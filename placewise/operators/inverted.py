"""An inverted file over unit vectors: approximate search in the nearest lists, exact search by skipping whole parts.

Distributed k-means gives centres; every row belongs to the list of its nearest centre. The index is stored partitioned by
list, so a search reads only the folders it asks for. A list is cut into parts by distance to the centre, and a part knows
its nearest and farthest distance. A list with a third of all rows is many parts, which are separate units of work.

By the triangle inequality no row of a part is nearer to a query than the query's distance to the centre lies outside the
part's range. The exact search takes the k-th distance within a few lists as a bound and reads on only where a part may hold
something nearer. Vectors are compared by cosine distance; that of unit vectors is half their squared straight distance.

The centres and one row per part are held by the driver and by tasks; both are bounded by parameters.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from placewise.operators.vectors import _asked, _blocks, _local_search, _matrix, rank_topk, vector_search
from placewise.session import materialize, scratch_path, scratch_table
from placewise.settings import TOP_K

#: The list of rows without direction, which are at distance 1 from everything.
ZERO = -1
#: Rows that the centres are fitted on, rows of a part, and parts of an index at most (parts grow beyond that).
FIT_ROWS, PART_ROWS, MOST_PARTS = 1_000_000, 50_000, 200_000
#: Rows that a task fits centres on.
TASK_ROWS = 10_000
#: Rounding error of a distance that the bounds allow for.
SLACK = 1e-9


@dataclass
class InvertedFile:
    """A stored index: folder, centres (one row each) and parts (part, list, low, high, rows)."""

    path: str
    centres: np.ndarray
    parts: np.ndarray
    id_type: str
    schema: StructType

    def rows(self, spark: SparkSession, lists: Sequence[int] | None = None) -> DataFrame:
        """id, embedding, part, reach, list and the kept columns; of the given lists only."""
        stored = spark.read.schema(self.schema).parquet(self.path)
        return stored if lists is None else stored.where(F.col("list").isin([int(i) for i in lists]))


def _unit(column: str):
    return F.transform(column, lambda x: x / F.sqrt(F.aggregate(column, F.lit(0.0), lambda a, y: a + y * y)))


def fit_centres(index: DataFrame, lists: int, vec_col: str = "embedding", id_col: str = "id", rows: int = FIT_ROWS, seed: int = 42) -> np.ndarray:
    """Centres by distributed k-means, fitted on the `rows` rows that come first by a hash of their id."""
    units = index.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    units = units.where(F.exists("v", lambda x: x != 0)).withColumn("v", _unit("v"))
    found = units.count()
    if not found:
        return np.zeros((0, 0))
    order = F.struct(F.xxhash64("id").alias("hash"), "id")
    if found > rows:
        last = units.select(order.alias("o")).orderBy("o").limit(rows).agg(F.max("o").alias("o")).withColumnRenamed("o", "last")
        units = units.crossJoin(F.broadcast(last)).where(order <= F.col("last")).drop("last")
    # few rows in order in one task; more are shared among tasks, which an order with a limit would not do
    tasks = -(-min(found, rows) // TASK_ROWS)
    units = units.orderBy(order).coalesce(1) if tasks == 1 else units.repartition(tasks, "id")
    vectors = units.select(array_to_vector("v").alias("features")).persist()
    try:
        return np.array(KMeans(k=lists, seed=seed, maxIter=10, distanceMeasure="cosine").fit(vectors).clusterCenters())
    finally:
        vectors.unpersist()


def _straight(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Straight distance of every row to every centre."""
    squares = (units**2).sum(1)[:, None] + (centres**2).sum(1)[None] - 2 * units @ centres.T
    return np.sqrt(np.maximum(squares, 0))


def _nearest(centres: np.ndarray):
    """Arrow function: nearest centre and the distance to it; list ZERO of a vector without direction."""

    @F.arrow_udf("struct<list:int,reach:double>")
    def nearest(v: pa.Array) -> pa.Array:
        units = _matrix(v, centres.shape[1])
        every = _straight(units, centres)
        own = every.argmin(1)
        reach = every[np.arange(len(own)), own]
        empty = ~units.any(1)
        own[empty], reach[empty] = ZERO, 0.0
        return pa.StructArray.from_arrays([pa.array(own, pa.int32()), pa.array(reach)], ["list", "reach"])

    return nearest


def build(
    index: DataFrame,
    lists: int,
    path: str | None = None,
    id_col: str = "id",
    vec_col: str = "embedding",
    keep: Sequence[str] = (),
    part_rows: int = PART_ROWS,
    fit_rows: int = FIT_ROWS,
) -> InvertedFile:
    """Writes the index of all rows with a vector; `keep` columns are stored for filters.

    Rows are range-partitioned by (list, reach), so that files, and the parts in them, are alike in size whatever the lists
    are; a part never crosses a file.
    """
    spark = index.sparkSession
    path = path or scratch_path(spark, "inverted-file")
    centres = fit_centres(index, lists, vec_col, id_col, fit_rows)
    rows = index.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("embedding"), *keep)
    if not len(centres):
        dim = rows.agg(F.max(F.size("embedding"))).first()[0] or 1
        centres = np.zeros((1, dim))
    placed = rows.withColumn("place", _nearest(centres)("embedding"))
    # stored, as the ranges are counted before the rows are dealt, and each field would ask for the distances again
    placed = scratch_table(placed, "placed").select("*", "place.list", "place.reach").drop("place")
    total = placed.count()
    part_rows = max(part_rows, -(-total // MOST_PARTS))
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // part_rows))
    dealt = placed.repartitionByRange(ranges, "list", "reach", "id").sortWithinPartitions("list", "reach")
    # a part is what a file holds of a list
    dealt = dealt.withColumn("part", F.concat_ws("-", F.spark_partition_id(), "list"))
    dealt.write.partitionBy("list").parquet(path)
    seen = spark.read.schema(dealt.schema).parquet(path).groupBy("part", "list").agg(F.min("reach").alias("low"), F.max("reach").alias("high"), F.count("*").alias("rows"))
    kinds = [("part", object), ("list", np.int64), ("low", float), ("high", float), ("rows", np.int64)]
    parts = np.array([tuple(r) for r in seen.orderBy("list", "low", "part").collect()], dtype=kinds)  # at most ranges + lists
    return InvertedFile(path, centres, parts, index.schema[id_col].dataType.simpleString(), dealt.schema)


def _probes(file: InvertedFile, probes: int):
    """Arrow function: parts of the `probes` nearest lists; all parts for a vector without direction."""
    centres, lists = file.centres, file.parts["list"]
    by_list = {int(i): np.flatnonzero(lists == i) for i in np.unique(lists)}
    names = file.parts["part"].tolist()

    @F.arrow_udf("array<string>")
    def chosen(v: pa.Array) -> pa.Array:
        units = _matrix(v, centres.shape[1])
        near = np.argsort(_straight(units, centres), axis=1, kind="stable")[:, :probes]
        none = np.zeros(0, np.int64)
        found = [range(len(names)) if not u.any() else np.concatenate([by_list.get(int(i), none) for i in row]) for u, row in zip(units, near)]
        return pa.array([[names[p] for p in f] for f in found], pa.list_(pa.string()))

    return chosen


def _beyond(file: InvertedFile):
    """Arrow function: parts that may hold a row nearer than a straight distance `bound`, or as near."""
    centres, parts = file.centres, file.parts
    lists, names = parts["list"], parts["part"].tolist()

    @F.arrow_udf("array<string>")
    def open_parts(v: pa.Array, bound: pa.Array) -> pa.Array:
        units, limit = _matrix(v, centres.shape[1]), bound.to_numpy(zero_copy_only=False)
        away = _straight(units, centres)[:, np.maximum(lists, 0)]
        least = np.maximum(np.maximum(away - parts["high"], parts["low"] - away), 0)
        # cosine distance 1 is a straight distance of sqrt(2) on the same scale
        least[:, lists == ZERO] = np.sqrt(2)
        near = (least <= limit[:, None] + SLACK) | ~units.any(1)[:, None]
        return pa.array([[names[p] for p in np.flatnonzero(row)] for row in near], pa.list_(pa.string()))

    return open_parts


def _search_parts(file: InvertedFile, asked: DataFrame, k: int, digits: int | None, where) -> DataFrame:
    """k nearest rows for every (q, v, part); asked rows meet the rows of their part only."""
    spark = asked.sparkSession
    wanted = {r["part"] for r in asked.select("part").distinct().collect()}  # at most all parts
    lists = sorted({int(p["list"]) for p in file.parts if p["part"] in wanted})
    pool = file.rows(spark, lists)
    pool = pool.where(where) if where is not None else pool
    if _blocks(asked) <= 1:
        queries = asked.select(F.col("q").alias("query_id"), "v", "part")
        near = vector_search(pool, queries, k, query_vec="v", match=("part", "part"), digits=digits)
        return near.drop("rank")
    # many queries: those of a part are dealt to blocks, and the part meets each block in a task of its own
    dim = file.centres.shape[1]
    size = max(1, (32 << 20) // (8 * dim))
    counts = asked.groupBy("part").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("q", "v"), F.col("blocks")).cast("int")
    kept = ["part", "block", "asks", "id", "q", "v"]
    left = asked.join(counts, "part").select("part", block.alias("block"), F.lit(True).alias("asks"), F.lit(None).cast(file.id_type).alias("id"), "q", "v")
    right = pool.join(counts, "part").select("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("asks"), "id", F.lit(None).cast(asked.schema["q"].dataType).alias("q"), F.col("embedding").alias("v"))
    schema = f"query_id {asked.schema['q'].dataType.simpleString()}, id {file.id_type}, distance double"

    def cell(table: pa.Table) -> pa.Table:
        asks = table.column("asks")
        queries, rows = table.filter(asks), table.filter(pa.compute.invert(asks))
        kinds = table.schema.field("q").type, table.schema.field("id").type
        empty = pa.schema([("query_id", kinds[0]), ("id", kinds[1]), ("distance", pa.float64())]).empty_table()
        if not (queries.num_rows and rows.num_rows):
            return empty
        none = pa.nulls(queries.num_rows, pa.string())
        search = _local_search(pa.table({"q": queries.column("q"), "v": queries.column("v"), "m": none}), k, False, kinds, digits)
        own = pa.table({"id": rows.column("id"), "v": rows.column("v"), "m": pa.nulls(rows.num_rows, pa.string())})
        return pa.concat_tables([empty, *(pa.Table.from_batches([b]) for b in search(iter(own.combine_chunks().to_batches())))])

    return left.select(*kept).unionAll(right.select(*kept)).groupBy("part", "block").applyInArrow(cell, schema)


def _queries(file: InvertedFile, queries: DataFrame, query_id: str, query_vec: str) -> DataFrame:
    asked = _asked(queries, query_id, query_vec, None).select("q", "v")
    return asked if len(file.parts) else asked.where(F.lit(False))


def search(
    file: InvertedFile, queries: DataFrame, k: int = TOP_K, probes: int = 8, query_id: str = "query_id", query_vec: str = "embedding", digits: int | None = None, where=None
) -> DataFrame:
    """Approximate k nearest: query_id, id, distance, rank, from the `probes` lists nearest to each query."""
    asked = _queries(file, queries, query_id, query_vec)
    asked = asked.withColumn("part", F.explode(_probes(file, probes)("v")))
    return rank_topk(_search_parts(file, asked, k, digits, where), k)


def open_parts(file: InvertedFile, asked: DataFrame, first: DataFrame, k: int) -> DataFrame:
    """(q, v, parts) that may still hold one of the k nearest, given the hits (query_id, distance, rank) found first."""
    kth = first.where(F.col("rank") == k).select(F.col("query_id").alias("q"), F.sqrt(2 * F.greatest("distance", F.lit(0.0))).alias("bound"))
    bounded = asked.join(kth, "q", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    return bounded.select("q", "v", _beyond(file)("v", "bound").alias("parts"))


def exact_search(
    file: InvertedFile, queries: DataFrame, k: int = TOP_K, probes: int = 2, query_id: str = "query_id", query_vec: str = "embedding", digits: int | None = None, where=None
) -> DataFrame:
    """Exact k nearest, like `vector_search`, and `parts_read`: of how many parts rows were compared with the query.

    A query whose first lists hold fewer than k rows reads all parts. Equal distances are ordered by id.
    """
    asked = _queries(file, queries, query_id, query_vec)
    known = asked.withColumn("first", _probes(file, probes)("v"))
    # read three times: the bound, the parts beyond it, and the result
    first = materialize(rank_topk(_search_parts(file, known.select("q", "v", F.explode("first").alias("part")), k, digits, where), k))
    slack = 0.0 if digits is None else 10.0**-digits
    left = open_parts(file, asked, first.withColumn("distance", F.col("distance") + slack), k)
    read = known.join(left.select("q", "parts"), "q").select("q", "v", "first", F.array_except("parts", "first").alias("more"))
    more = _search_parts(file, read.select("q", "v", F.explode("more").alias("part")), k, digits, where)
    hits = rank_topk(first.select("query_id", "id", "distance").unionAll(more.select("query_id", "id", "distance")), k)
    counted = read.select(F.col("q").alias("query_id"), (F.size("first") + F.size("more")).alias("parts_read"))
    return hits.join(counted, "query_id")


def probes_for(file: InvertedFile, queries: DataFrame, share: float, k: int = TOP_K, most: int = 1_000, query_id: str = "query_id", query_vec: str = "embedding") -> int:
    """The fewest lists that hold `share` of the exact k nearest of the given queries.

    `most` queries, those that come first by a hash of their id, are searched exactly; for each neighbour it counts how many
    lists are nearer to the query than the neighbour's own, and one aggregate over these ranks tells the rest.
    """
    asked = _queries(file, queries, query_id, query_vec).orderBy(F.xxhash64("q"), "q").limit(most)
    hits = exact_search(file, asked, k, query_id="q", query_vec="v").select(F.col("query_id").alias("q"), "id")
    lists = file.rows(queries.sparkSession).select("id", "list")
    centres = file.centres

    @F.arrow_udf("int")
    def rank(v: pa.Array, own: pa.Array) -> pa.Array:
        every, own = _straight(_matrix(v, centres.shape[1]), centres), own.to_numpy(zero_copy_only=False)
        nearer = (every < every[np.arange(len(own)), np.maximum(own, 0)][:, None]).sum(1)
        return pa.array(np.where(own == ZERO, 0, nearer), pa.int32())

    ranks = hits.join(lists, "id").join(asked, "q").groupBy(rank("v", "list").alias("rank")).agg(F.count("*").alias("n"))
    found = sorted((r["rank"], r["n"]) for r in ranks.collect())  # at most one row a list
    total, upto = sum(n for _, n in found), 0
    for place, n in found:
        upto += n
        if upto >= share * total:
            return place + 1
    return 1


def recall(found: DataFrame, exact: DataFrame, k: int = TOP_K) -> DataFrame:
    """One row: queries, and the mean share of each query's exact k nearest that were found."""
    both = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    per = both.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("share"))
    return per.agg(F.count("*").alias("queries"), F.avg("share").alias("recall"))
