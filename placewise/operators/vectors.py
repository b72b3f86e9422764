"""Exact cosine search over an embedding column.

A query side of a checked size is held by every task, and one pass over the index answers it. A larger one stays
distributed: queries and index rows are dealt to cells (a part of the index, a block of the queries), so that a task holds
one part and one block. Either way NumPy multiplies a bounded number of pairs at a time and a task emits at most k rows
per query it saw; no pair table ever exists.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from placewise.settings import TOP_K

# Queries held by every task, and either side of a cell: at most this many bytes of float64.
BLOCK_BYTES = 64 * 1024 * 1024
# Classes whose mean vectors are held on the driver and by every task.
MOST_CLASSES = 10_000
# Rows of a list whose pairs may all be asked for.
MOST_PAIRED = 20_000
# Distances computed at a time, and numbers of the rows that they are computed for.
DISTANCES, NUMBERS = 1 << 19, 1 << 19
# Finds that wait to be ranked.
MOST_HELD = 500
# A vector by its places other than zero.
SPARSE = "struct<size:int,i:array<int>,v:array<float>>"


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows divided by their length; a zero row stays zero."""
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return unit_rows(flat.reshape(-1, dim))


def _rows_of(column: pa.Array, dim: int) -> np.ndarray:
    """Unit rows of a column of arrays or of sparse rows."""
    if not pa.types.is_struct(column.type):
        return _matrix(column, dim)
    _, places, values = column.flatten()
    sizes = pa.compute.list_value_length(places).to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dim))
    out[np.repeat(np.arange(len(column)), sizes), places.flatten().to_numpy()] = values.flatten().to_numpy()
    return unit_rows(out)


def _dense(vector: str, rows: DataFrame) -> Column:
    """A column of arrays or of sparse rows as array<double>."""
    if rows.schema[vector].dataType.simpleString() != SPARSE:
        return F.col(vector).cast("array<double>")
    held = F.map_from_arrays(F.col(vector)["i"], F.col(vector)["v"])
    places = F.sequence(F.lit(0), F.col(vector)["size"] - 1)
    return F.transform(places, lambda p: F.coalesce(F.try_element_at(held, p), F.lit(0.0).cast("float")).cast("double"))


def _asked(queries: DataFrame, qid: str, vec: str, match: str | None) -> DataFrame:
    key = (F.col(match) if match else F.lit(None).cast("string")).cast("string")
    return queries.where(F.col(vec).isNotNull()).select(F.col(qid).alias("q"), F.col(vec).cast("array<double>").alias("v"), key.alias("m"))


def _blocks(vectors: DataFrame) -> int:
    """How many blocks of BLOCK_BYTES the column `v` fills; 0 without rows."""
    seen = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    return -(-8 * seen["n"] * max(seen["dim"] or 0, 1) // BLOCK_BYTES)


def vector_search(
    index: DataFrame,
    queries: DataFrame,
    k: int = TOP_K,
    id_col: str = "id",
    vec_col: str = "embedding",
    query_id: str = "query_id",
    query_vec: str = "embedding",
    where: Column | None = None,
    match: tuple[str, str] | None = None,
    max_distance: float | None = None,
    digits: int | None = None,
) -> DataFrame:
    """Exact k nearest by cosine distance: query_id, id, distance, rank.

    `where` filters the index before any distance is computed. `match=(index_col, query_col)` lets a
    query see only the index rows with its own value, such as its zip. A zero vector has distance 1.
    Distances are compared in full, or rounded to `digits` first.
    """
    pool = index.where(where) if where is not None else index
    kind = pool.schema[vec_col].dataType
    # short numbers and sparse rows travel as they are when one block of queries answers
    own = F.col(vec_col) if kind.simpleString() in ("array<float>", SPARSE) else F.col(vec_col).cast("array<double>")
    pool = pool.where(F.col(vec_col).isNotNull()).select(
        F.col(id_col).alias("id"),
        own.alias("v"),
        (F.col(match[0]) if match else F.lit(None).cast("string")).cast("string").alias("m"),
    )
    asked = _asked(queries, query_id, query_vec, match[1] if match else None)
    q_arrow = to_arrow_type(queries.schema[query_id].dataType)
    id_arrow = to_arrow_type(index.schema[id_col].dataType)
    schema = f"query_id {queries.schema[query_id].dataType.simpleString()}, id {index.schema[id_col].dataType.simpleString()}, distance double"
    options = {"k": k, "matched": match is not None, "types": (q_arrow, id_arrow), "digits": digits}
    blocks = _blocks(asked)
    if blocks == 0:
        return index.sparkSession.createDataFrame([], schema + ", rank int")
    if blocks == 1:
        near = pool.mapInArrow(_local_search(asked.toArrow(), **options), schema)
    else:
        empty = pa.schema([("query_id", q_arrow), ("id", id_arrow), ("distance", pa.float64())]).empty_table()

        def nearest(rows: pa.Table, block: pa.Table) -> pa.Table:
            found = _local_search(block, **options)(iter(rows.to_batches()))
            return pa.concat_tables([empty, *(pa.Table.from_batches([b]) for b in found)])

        near = _in_cells(pool.withColumn("v", _dense("v", pool)), asked, nearest, schema, empty)
    if max_distance is not None:
        near = near.where(F.col("distance") <= max_distance)
    return rank_topk(near, k)


def _in_cells(pool: DataFrame, asked: DataFrame, own: Callable[[pa.Table, pa.Table], pa.Table], schema: str, none: pa.Table) -> DataFrame:
    """`own` on every part of the pool (id, v, m) with every block of the queries (q, v, m); `none` where one is empty.

    Cells hold equal shares whatever the match values are, as rows are dealt by a hash of id and vector.
    """
    parts, blocks = max(_blocks(pool), 1), max(_blocks(asked), 1)

    def dealt(rows: DataFrame, key: str, kept: str, count: int, other: str, other_count: int) -> DataFrame:
        turn = F.pmod(F.xxhash64(key, "v"), F.lit(count)).cast("int")
        copies = F.explode(F.sequence(F.lit(0), F.lit(other_count - 1)))
        return rows.select(key, "v", "m", F.lit(key == "q").alias("asks"), turn.alias(kept), copies.alias(other))

    def cell(table: pa.Table) -> pa.Table:
        asks = table.column("asks")
        rows, block = table.filter(pa.compute.invert(asks)), table.filter(asks)
        if not (rows.num_rows and block.num_rows):
            return none
        return own(rows.select(["id", "v", "m"]), block.select(["q", "v", "m"]))

    # one table of both sides, as two sides of one lineage confuse a cogroup's columns
    left, right = dealt(pool, "id", "part", parts, "block", blocks), dealt(asked, "q", "block", blocks, "part", parts)
    both = left.unionByName(right, allowMissingColumns=True)
    return both.groupBy("part", "block").applyInArrow(cell, schema)


def rank_topk(hits: DataFrame, k: int, query: str = "query_id", by: Sequence[str] = ("distance", "id")) -> DataFrame:
    """Rank per query, k best kept; the limit runs in every task before the shuffle."""
    w = Window.partitionBy(query).orderBy(*by)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _local_search(asked: pa.Table, k: int, matched: bool, types: tuple, digits: int | None):
    """mapInArrow body: the k nearest rows of this task for every query of the block, ties by id."""
    vectors = asked.column("v").combine_chunks()
    dim = len(vectors.flatten()) // len(vectors)
    queries = _matrix(vectors, dim)
    ids = asked.column("q").combine_chunks()
    by_key: dict = {}
    for place, key in enumerate(asked.column("m").to_pylist() if matched else []):
        by_key.setdefault(key, []).append(place)
    by_key.pop(None, None)

    def groups(keys: pa.Array, count: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(queries, rows) that see each other."""
        if not matched:
            yield np.arange(len(queries)), np.arange(count)
            return
        coded = keys.dictionary_encode()
        codes = coded.indices.fill_null(-1).to_numpy()
        for code, key in enumerate(coded.dictionary.to_pylist()):
            if key in by_key:
                yield np.asarray(by_key[key]), np.flatnonzero(codes == code)

    def best(found: list[pa.Table]) -> pa.Table:
        """The first k of each query by distance and id."""
        table = pa.concat_tables(found)
        table = table.take(pa.compute.sort_indices(table, sort_keys=[("q", "ascending"), ("d", "ascending"), ("id", "ascending")]))
        q = table.column("q").to_numpy()
        return table.filter(pa.array(np.arange(len(q)) - np.searchsorted(q, q) < k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [pa.schema([("q", pa.int64()), ("d", pa.float64()), ("id", types[1])]).empty_table()]
        waiting = 0
        bound = np.full(len(queries), np.inf)  # no row beyond it is among the first k
        most = max(1, NUMBERS // dim)
        for batch in (whole.slice(at, most) for whole in batches for at in range(0, whole.num_rows, most)):
            matrix = _rows_of(batch.column(1), dim)
            for places, rows in groups(batch.column(2), batch.num_rows):
                step = max(1, DISTANCES // len(places))
                for part in (rows[at : at + step] for at in range(0, len(rows), step)):
                    every = 1.0 - queries[places] @ matrix[part].T
                    every = every if digits is None else np.round(every, digits)
                    limit = bound[places]
                    q, r = np.nonzero(every <= limit[:, None])
                    if len(part) > k and len(q) > k * len(places):
                        limit = np.minimum(limit, np.partition(every, k - 1, axis=1)[:, k - 1])
                        bound[places] = limit
                        q, r = np.nonzero(every <= limit[:, None])
                    d = every[q, r]
                    held.append(pa.table({"q": places[q], "d": d, "id": batch.column(0).take(pa.array(part[r], pa.int64()))}))
                    waiting += len(q)
                    if waiting > max(DISTANCES // 4, 2 * k * len(queries)) or len(held) > MOST_HELD:
                        held, waiting = [best(held)], 0
                        held_q, held_d = held[0].column("q").to_numpy(), held[0].column("d").to_numpy()
                        full = np.flatnonzero(np.arange(len(held_q)) - np.searchsorted(held_q, held_q) == k - 1)
                        bound[held_q[full]] = np.minimum(bound[held_q[full]], held_d[full])
        table = best(held)
        if table.num_rows:
            table = pa.table({"query_id": ids.take(table.column("q").combine_chunks()).cast(types[0]), "id": table.column("id"), "distance": table.column("d")})
            yield from table.to_batches()

    return run


def attach(hits: DataFrame, index: DataFrame, columns: Sequence[str], id_col: str = "id") -> DataFrame:
    """Payload columns of the hits."""
    payload = index.select(F.col(id_col).alias("id"), *columns)
    return hits.join(payload, "id")


def similarities(vector: Column, queries: np.ndarray) -> Column:
    """Cosine similarity of a row's vector to each row of a small literal matrix, as array<double>."""
    units = unit_rows(np.asarray(queries, dtype=np.float64))
    dim = units.shape[1]

    @F.arrow_udf("array<double>")
    def run(v: pa.Array) -> pa.Array:
        sims = _matrix(v, dim) @ units.T
        offsets = np.arange(0, sims.size + 1, units.shape[0], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(sims.reshape(-1)))

    return run(vector.cast("array<double>"))


def cosine_matrix(items: DataFrame, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """Similarity of every item to every item: id_a, id_b, similarity.

    The answer has a row per pair by definition, so it is meant for a short list such as a few texts
    or one mean vector per class. Parts of the list meet in cells; a list beyond MOST_PAIRED rows is refused.
    """
    if items.limit(MOST_PAIRED + 1).count() > MOST_PAIRED:
        raise ValueError(f"more than {MOST_PAIRED} rows have too many pairs; search for the nearest instead")
    kind = to_arrow_type(items.schema[id_col].dataType)
    id_type = items.schema[id_col].dataType.simpleString()

    def pairs(rows: pa.Table, block: pa.Table) -> pa.Table:
        left, right = rows.column("id").combine_chunks(), block.column("q").combine_chunks()
        a, b = np.repeat(np.arange(len(left)), len(right)), np.tile(np.arange(len(right)), len(left))
        first, second = rows.column("v").combine_chunks(), block.column("v").combine_chunks()
        dim = len(first.flatten()) // len(first)
        value = (_matrix(first, dim) @ _matrix(second, dim).T).ravel()
        return pa.table({"id_a": left.take(pa.array(a, pa.int64())).cast(kind), "id_b": right.take(pa.array(b, pa.int64())).cast(kind), "similarity": value})

    listed = _asked(items, id_col, vec_col, None)
    none = pa.schema([("id_a", kind), ("id_b", kind), ("similarity", pa.float64())]).empty_table()
    return _in_cells(listed.withColumnRenamed("q", "id"), listed, pairs, f"id_a {id_type}, id_b {id_type}, similarity double", none)


def mean_vectors(df: DataFrame, group: str, vec_col: str = "embedding") -> DataFrame:
    """Mean vector per group, combined on the map side."""
    mean = Summarizer.mean(array_to_vector(F.col(vec_col).cast("array<double>")))
    return df.groupBy(group).agg(vector_to_array(mean).alias("embedding"))


def class_scores(df: DataFrame, label: str = "label", vec_col: str = "embedding", output: str = "scores") -> tuple[DataFrame, list]:
    """Similarity to each class's mean vector, and the class list; one mean vector per class is held."""
    rows = mean_vectors(df, label, vec_col).orderBy(label).limit(MOST_CLASSES + 1).collect()
    if len(rows) > MOST_CLASSES:
        raise ValueError(f"{label} has more than {MOST_CLASSES} values")
    matrix = np.asarray([r["embedding"] for r in rows])
    return df.withColumn(output, similarities(F.col(vec_col), matrix)), [r[label] for r in rows]


def pca_2d(df: DataFrame, vec_col: str = "embedding", k: int = 2, keep: Sequence[str] = ()) -> DataFrame:
    """Projection of the mean-centred vectors to k components; each component's largest loading is positive."""
    vectors = df.where(F.col(vec_col).isNotNull()).select(
        *keep, array_to_vector(F.col(vec_col).cast("array<double>")).alias("raw")
    )
    centred = StandardScaler(inputCol="raw", outputCol="centred", withMean=True, withStd=False).fit(vectors).transform(vectors)
    model = PCA(k=k, inputCol="centred", outputCol="projected").fit(centred)
    loadings = model.pc.toArray()
    signs = [float(np.sign(loadings[np.argmax(np.abs(loadings[:, i])), i]) or 1.0) for i in range(k)]
    out = model.transform(centred).withColumn("p", vector_to_array("projected"))
    return out.select(*keep, *[(F.col("p")[i] * signs[i]).alias(f"pc{i + 1}") for i in range(k)])
