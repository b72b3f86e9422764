"""K-d tree sharding: leaves of near equal bytes from recursive splits at distributed weighted medians.

Each document is a small row: its size and a few numbers that describe it (`dimensions`), stored once. All nodes of a level
are split in the same passes: the widest dimension of each node, the bytes in ranges of it, and again in ranges of the one
range that holds the cut, until a single row is left in it: the cut nearest to the share of bytes that the node's left leaves
shall hold. Ties fall back on a hash, so a value that a third of all rows share is split like any other, and equal rows on
the order in which they are stored. Texts never move and no node is gathered: rows are read where they lie, the driver sees one row per node
and at most about `RANGES` sums, and only the slots take a range shuffle of the small rows. Cuts are not stored as tables:
a level that wrote its rows made a file in every task, and creating a file costs more than splitting its few rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from placewise.llm.storage import in_batches, stored

SHARDS = 40
OVERHEAD = 16
DIMENSIONS = ("length", "language", "origin")
#: Ranges that a pass sums up, of all nodes together (16 a node at least).
RANGES = 1 << 14


def described(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, tie and the dimensions, scaled to about 0..1, of every row.

    Size is the text's UTF-8 bytes (a null text has none) and 16. A missing or null lang or source is the empty one.
    """
    text = F.col("text").cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + OVERHEAD
    share = lambda c: (F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) / float(2**32)) if c in docs.columns else F.lit(0.0)
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        size.alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64("doc_id", text).alias("tie"),
        (F.log2(size.cast("double")) / 40).alias("length"),
        share("lang").alias("language"),
        share("source").alias("origin"),
    )


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds rows and bytes of the same node so far in the same part (this row included). Parts come one by one, sorted by node."""
    before, rows_before, bytes_before = None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        nodes = batch.column(batch.schema.get_field_index("node")).to_numpy()
        parts = batch.column(batch.schema.get_field_index("part")).to_numpy()
        sizes = batch.column(batch.schema.get_field_index("size")).to_numpy()
        heads = np.flatnonzero(np.concatenate([[True], (nodes[1:] != nodes[:-1]) | (parts[1:] != parts[:-1])]))
        lengths = np.diff(np.append(heads, len(nodes)))
        sums = np.cumsum(sizes)
        count = np.arange(1, len(nodes) + 1) - np.repeat(heads, lengths)
        total = sums - np.repeat(sums[heads] - sizes[heads], lengths)
        if (parts[0], nodes[0]) == before:
            count[: lengths[0]] += rows_before
            total[: lengths[0]] += bytes_before
        before, rows_before, bytes_before = (parts[-1], nodes[-1]), int(count[-1]), int(total[-1])
        names = [f.name for f in batch.schema]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(count, pa.int64()), pa.array(total, pa.int64())], [*names, "rows_to", "bytes_to"])


def running_totals(rows: DataFrame, order: list) -> DataFrame:
    """`rows` with rows_to and bytes_to: rows and bytes of the same node up to and with this one, in `order`.

    Range-partitioned by node and order, so a large node spreads over many tasks; what earlier partitions hold of a node
    comes from one row per partition and node. Two tasks a core write them, each several partitions, which keep their numbers.
    """
    keys = [F.col("node"), *order]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())
    schema = T.StructType([*ranged.schema.fields, T.StructField("rows_to", T.LongType()), T.StructField("bytes_to", T.LongType())])
    placed = stored(in_batches(ranged.coalesce(2 * rows.sparkSession.sparkContext.defaultParallelism), _running, schema), "running")
    held = placed.groupBy("part", "node").agg(F.max("rows_to").alias("n"), F.max("bytes_to").alias("b"))
    earlier = F.broadcast(held)  # at most partitions + nodes rows, as partitions are ranges of nodes
    before = (
        held.select("part", "node")
        .join(earlier.select(F.col("part").alias("p"), F.col("node").alias("m"), "n", "b"), (F.col("node") == F.col("m")) & (F.col("p") < F.col("part")))
        .groupBy("part", "node")
        .agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    )
    joined = placed.join(F.broadcast(before), ["part", "node"], "left")
    return joined.withColumn("rows_to", F.col("rows_to") + F.coalesce("n", F.lit(0))).withColumn("bytes_to", F.col("bytes_to") + F.coalesce("b", F.lit(0))).select(*rows.columns, "rows_to", "bytes_to")


def leaves_for(docs: DataFrame, target_bytes: int) -> int:
    """Leaves that hold about `target_bytes` each."""
    total = described(docs).agg(F.sum("size")).first()[0] or 0
    return max(1, round(total / target_bytes))


def _left(keys: list[tuple[str, float | int]], with_cut: bool) -> Column:
    """Whether a row comes before the cut row, of which `keys` has the values in the order of sorting, or is it and `with_cut` holds."""
    *front, (name, value) = keys
    found = F.col(name) <= value if with_cut else F.col(name) < value
    for name, value in reversed(front):
        found = (F.col(name) < value) | ((F.col(name) == value) & found)
    return found


def _at_leaves(node: int, leaves: int, cuts: dict[tuple[int, int], Column], leaf: Callable[[int], Column]) -> Column:
    """`leaf` of the node to which the cuts bring a row; leaves of a node are numbered from the node's number."""
    if (node, leaves) not in cuts:
        return leaf(node)
    half = leaves // 2
    return F.when(cuts[node, leaves], _at_leaves(node, half, cuts, leaf)).otherwise(_at_leaves(node + half, leaves - half, cuts, leaf))


def _range(keys: list[tuple[str, float | int]], name: str, low: float | int, high: float | int, ranges: int) -> Column:
    """Number of the range of `name` between `low` and `high` in which a row lies that has the values `keys`; other rows get null."""
    if isinstance(low, float):
        at = F.least(F.floor((F.col(name) - low) / (high - low) * ranges), F.lit(ranges - 1))
    else:
        shift = max(0, (high - low).bit_length() - ranges.bit_length())
        while (high >> shift) - (low >> shift) >= ranges:
            shift += 1
        at = F.shiftright(name, shift) - (low >> shift)
    inside = F.col(name).between(low, high)
    for other, value in keys:
        inside = (F.col(other) == value) & inside
    return F.when(inside, at.cast("bigint"))


def _measured(rows: DataFrame, *by: Column) -> list:
    """Bytes, rows and the least and largest values of each group."""
    ends = [f(c).alias(f"{c}_{end}") for c in (*DIMENSIONS, "tie", "number") for f, end in ((F.min, "low"), (F.max, "high"))]
    return rows.groupBy(*by).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), *ends).collect()


def _cuts(rows: DataFrame, sides: list[tuple[int, int]], at_leaves: Callable[[Callable[[int], Column]], Column]) -> dict[tuple[int, int], Column]:
    """{(node, leaves): whether a row of the node goes left} of the nodes in `sides` that shall be split and have rows."""
    whole = {r["node"]: r for r in _measured(rows, at_leaves(F.lit).alias("node"))}  # one row per node
    found, searched = {}, {}
    for node, leaves in sides:
        if leaves > 1 and node in whole:
            r = whole[node]
            widest = max(DIMENSIONS, key=lambda d: r[f"{d}_high"] - r[f"{d}_low"])
            searched[node] = {"leaves": leaves, "names": [widest, "tie", "number"], "keys": [], "before": 0, "goal": r["bytes"] * (leaves // 2) / leaves, "range": r}
    while True:
        for node, x in list(searched.items()):
            r, names = x["range"], x["names"]
            while r["n"] > 1 and r[f"{names[0]}_low"] == r[f"{names[0]}_high"]:
                x["keys"].append((names[0], r[f"{names.pop(0)}_low"]))
            if r["n"] == 1:
                upto = x["before"] + r["bytes"]
                stays = upto - r["bytes"] / 2 <= x["goal"]  # a row goes where most of it lies
                found[node, x["leaves"]] = _left([*x["keys"], (names[0], r[f"{names[0]}_low"])], stays)
                del searched[node]
        if not searched:
            return found
        ranges = max(16, RANGES // len(searched))

        def of(node: int, ranges: int = ranges) -> Column:
            if node not in searched:
                return F.lit(None).cast("bigint")
            x = searched[node]
            name = x["names"][0]
            return _range(x["keys"], name, x["range"][f"{name}_low"], x["range"][f"{name}_high"], ranges) + node * RANGES

        sums = sorted((r for r in _measured(rows, at_leaves(of).alias("at")) if r["at"] is not None), key=lambda r: r["at"])
        passed = set()
        for r in sums:
            node = r["at"] // RANGES
            x = searched[node]
            if node in passed:
                continue
            if x["before"] + r["bytes"] > x["goal"]:
                x["range"] = r
                passed.add(node)
            else:
                x["before"] += r["bytes"]


def assigned(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of `docs`.

    A node that shall become k leaves gives floor(k/2)/k of its bytes to the left. Slots count from 0 within a shard in
    the order of doc_id (nulls first) and hash. Repeated rows are placed one by one; columns besides doc_id, text, lang and source are not
    read. With fewer rows than shards some shards stay empty.
    """
    rows = stored(described(docs).withColumn("number", F.monotonically_increasing_id()), "described")
    cuts: dict[tuple[int, int], Column] = {}
    at_leaves = lambda leaf: _at_leaves(0, shards, cuts, leaf)
    sides = [(0, shards)]
    while any(k > 1 for _, k in sides):
        cuts |= _cuts(rows, sides, at_leaves)
        sides = [x for node, k in sides for x in ([(node, k // 2), (node + k // 2, k - k // 2)] if k > 1 else [(node, k)])]
    placed = running_totals(rows.select("doc_id", "size", "text_crc32", "tie", at_leaves(F.lit).alias("node")), [F.col("doc_id"), F.col("tie")])
    return placed.select("doc_id", "size", "text_crc32", F.col("node").alias("shard"), (F.col("rows_to") - 1).alias("slot"))


def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    placed = assigned(spark.read.parquet(f"{folder}/documents.parquet"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
