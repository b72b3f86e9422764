"""Token ids in fixed-width bits: every id takes the fewest bits that the vocabulary needs, in blocks of whole documents.

File format (a Parquet folder, so that Spark's commit protocol and every store serve it). One row is one block:

| column | content |
| - | - |
| shard, block | shards in ascending doc_id order; blocks from 0 within each |
| start, n_tokens | offset of the block's first id within its shard; ids in it |
| bits | width of each id |
| doc_ids, lengths | its documents, in order, and the ids of each, the end id included |
| payload | the ids, bit after bit, lowest bit first; id i starts at bit i * bits; the last byte is filled with zeros |

Blocks hold whole documents and are cut as soon as they reach `block_tokens`; a longer document is a block of its own.
Any id is found by arithmetic, and NumPy unpacks a block in one call.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from placewise.llm import vocabularies
from placewise.llm.storage import in_batches, removed_at_end
from placewise.session import scratch_path

BLOCK_TOKENS = 1 << 16
END_ID = 0
BLOCKS = "shard int, block int, start bigint, n_tokens int, bits int, doc_ids array<bigint>, lengths array<int>, payload binary"


def width(vocabulary: int) -> int:
    """Bits that hold every id below `vocabulary`; at least one."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits % 8 == 0:
        return octets[:, : bits // 8].tobytes()
    return np.packbits(np.unpackbits(octets, axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, count: int, bits: int, first: int = 0) -> np.ndarray:
    """`count` ids from number `first` on; reads only the bytes that hold them."""
    begin = first * bits
    octets = np.frombuffer(payload, np.uint8)[begin // 8 : (begin + count * bits + 7) // 8]
    ids = np.zeros((count, 4), np.uint8)
    if bits % 8 == 0:
        ids[:, : bits // 8] = octets.reshape(count, bits // 8)
    elif count:
        loose = np.unpackbits(octets, bitorder="little")[begin % 8 : begin % 8 + count * bits].reshape(count, bits)
        ids[:, : (bits + 7) // 8] = np.packbits(loose, axis=1, bitorder="little")
    return ids.view("<u4").ravel()


def _blocks(path: str, bits: int, block_tokens: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        docs, lengths, parts, held = [], [], [], 0

        def cut() -> pa.RecordBatch:
            row = [shard, block, start, held, bits, docs, lengths, pack(np.concatenate(parts), bits)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], [c.split()[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            names = batch.column(0).to_pylist()
            for at, counts, ids, _, _ in vocabularies.encoded("tokenizers", path, batch.column(1)):
                for name, own in zip(names[at : at + len(counts)], np.split(ids, np.cumsum(counts)[:-1])):
                    docs.append(name)
                    lengths.append(len(own) + 1)
                    parts += [own, np.array([END_ID], np.int32)]
                    held += len(own) + 1
                    if held >= block_tokens:
                        yield cut()
                        block, start = block + 1, start + held
                        docs, lengths, parts, held = [], [], [], 0
        if docs:
            yield cut()

    return write


def write_ids(docs: DataFrame, path: str, vocabulary: str, block_tokens: int = BLOCK_TOKENS) -> None:
    """Encode every whole text, append the end id and write the blocks to `path`, in ascending doc_id order.

    One range shuffle of (doc_id, text); repeated ids are spread by the text's hash. A null doc_id comes first, a null
    text is an empty one (the end id alone), strings of the file's added tokens get their ids as in the library's encoding
    of the whole text, other columns are not read.
    Blocks are written through Spark, so a lost executor's files are made again or never seen.
    """
    bits = width(vocabularies.LibraryWords(vocabulary).size)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    in_batches(placed, _blocks(vocabulary, bits, block_tokens), BLOCKS).write.parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with `first`, the number of ids before each in the whole corpus."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    sizes = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("ids"))  # one row per partition of the writer
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("shard_start"))
    return blocks.join(F.broadcast(starts), "shard").withColumn("first", F.col("start") + F.col("shard_start")).drop("shard_start")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, bits, total, docs, lengths, payload in zip(*(c.to_pylist() for c in batch.columns)):
            ids = unpack(payload, total, bits)
            ends = np.cumsum(lengths)
            starts = ends - lengths
            sums = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(first + starts), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone."""
    rows = read_blocks(spark, path).select("first", "bits", "n_tokens", "doc_ids", "lengths", "payload")
    return in_batches(rows, _digest, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and its ids without the end id."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bits, total, docs, lengths, payload in zip(*(c.to_pylist() for c in batch.columns)):
                own = np.split(unpack(payload, total, bits).astype(np.int32), np.cumsum(lengths)[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array([x[:-1] for x in own], pa.list_(pa.int32()))], ["doc_id", "ids"])

    blocks = spark.read.schema(BLOCKS).parquet(path)
    return in_batches(blocks.select("bits", "n_tokens", "doc_ids", "lengths", "payload"), each, "doc_id bigint, ids array<int>")


def op2_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of all documents, read back from freshly written token files."""
    path = scratch_path(spark, "token-ids")
    write_ids(spark.read.parquet(f"{folder}/documents.parquet"), path, vocabularies.default_path("byte_bpe_50k.json"))
    removed_at_end(spark, path)
    return digests(spark, path)
