"""Byte-level BPE over a corpus: every distinct word is encoded once for all, and its ids are joined back by position.

1. A scan splits whole texts into pre-tokens and cuts them into blocks of whole documents. A block is one row: its
   distinct words, and for every pre-token, in order, the number of its word (the exploded positions, held as arrays).
2. Words are dealt to buckets by their hash, one row per block and bucket, so a word that stands in every text costs one
   entry per block. The task of a bucket encodes each distinct word once and answers every block that asked.
3. Words' ids meet the positions again by block, and documents are reassembled by position.

Decoding joins ids to the token-byte table, whose size is the vocabulary's. Words travel as bytes, never as hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from placewise.llm import arrays, vocabularies
from placewise.llm.storage import in_batches

#: Text of one block: what the task that reassembles it holds at once (a longer document is a block of its own).
BLOCK_BYTES = 8 << 20
#: Words whose ids are put together at once, in whole documents.
WORDS = 1 << 18
_BLOCKS = "block bigint, doc_ids array<bigint>, counts array<int>, words binary, n_bytes bigint, ends binary, n_words int, positions binary, n_positions int"
_ASKED = "bucket int, block bigint, words binary, n_bytes bigint, ends binary, n_words int"
_ANSWERED = "block bigint, bucket int, ids binary, n_ids bigint, lengths binary, n_words int"


def _shrunk(values: np.ndarray) -> bytes:
    """Byte planes, compressed: small numbers in wide integers cost little."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _grown(payload: bytes, count: int, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(payload, count * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, count).T).view(kind).ravel()


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _kinds(schema: str) -> list[pa.DataType]:
    known = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return [known[c.split()[1]] for c in schema.split(", ")]


def _row(schema: str, *values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, _kinds(schema))], _names(schema))


def _rows(table: pa.RecordBatch | pa.Table) -> Iterator[dict]:
    """The rows, made one at a time."""
    for i in range(table.num_rows):
        yield {name: table.column(name)[i].as_py() for name in table.schema.names}


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = 0
    docs, counts, positions, words, known, held = [], [], [], [], {}, 0

    def cut() -> pa.RecordBatch:
        raw = b"".join(words)
        at = np.concatenate(positions)
        ends = np.array([len(w) for w in words], np.int32)
        key = (TaskContext.get().partitionId() << 32) | number
        return _row(_BLOCKS, key, docs, counts, pa.compress(raw, codec="zstd", asbytes=True), len(raw), _shrunk(ends), len(words), _shrunk(at), len(at))

    for batch in batches:
        names, texts = batch.column(0).to_pylist(), arrays.strings(batch.column(1))
        for at, rows in arrays.pieces(texts):
            data, bounds = arrays.laid_out(texts.slice(at, rows))
            starts, ends, text = arrays.pretokens(data, bounds)
            codes, distinct, first = arrays.numbered(arrays.hashes(data, starts, ends))
            raw = data.tobytes()
            place = np.empty(len(distinct), np.int32)
            for i, (key, s, e) in enumerate(zip(distinct.tolist(), starts[first].tolist(), ends[first].tolist())):
                own = known.get(key)
                if own is None:
                    own = known[key] = len(words)
                    words.append(raw[s:e])
                place[i] = own
            positions.append(place[codes])
            docs += names[at : at + rows]
            counts += np.bincount(text, minlength=rows).tolist()
            held += len(raw)
            if held >= BLOCK_BYTES:
                yield cut()
                number += 1
                docs, counts, positions, words, known, held = [], [], [], [], {}, 0
    if docs:
        yield cut()


def _buckets(raw: np.ndarray, lengths: np.ndarray, count: int) -> np.ndarray:
    ends = np.cumsum(lengths, dtype=np.int64)
    return (arrays.hashes(raw, ends - lengths, ends) % np.uint64(count)).astype(np.int64)


def _ask(count: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch.select(["block", "words", "n_bytes", "ends", "n_words"])):
                raw = np.frombuffer(pa.decompress(row["words"], row["n_bytes"], codec="zstd", asbytes=True), np.uint8)
                lengths = _grown(row["ends"], row["n_words"], np.int32).astype(np.int64)
                starts = np.cumsum(lengths) - lengths
                bucket = _buckets(raw, lengths, count)
                order = np.argsort(bucket, kind="stable")
                for own in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
                    part = arrays.gathered(raw, starts[own], lengths[own]).tobytes()
                    sizes = _shrunk(lengths[own].astype(np.int32))
                    yield _row(_ASKED, int(bucket[own[0]]), row["block"], pa.compress(part, codec="zstd", asbytes=True), len(part), sizes, len(own))

    return ask


def _answer(path: str):
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocabularies.RankWords(path)
        known: dict[bytes, list[int]] = {}
        for batch in batches:
            for row in _rows(batch):
                raw = pa.decompress(row["words"], row["n_bytes"], codec="zstd", asbytes=True)
                found, at = [], 0
                for size in _grown(row["ends"], row["n_words"], np.int32).tolist():
                    word = raw[at : at + size]
                    at += size
                    ids = known.get(word)
                    if ids is None:
                        if len(known) >= vocabularies.REMEMBERED_WORDS:
                            known.clear()
                        ids = known[word] = encode(word)
                    found.append(ids)
                flat = np.array([i for ids in found for i in ids], np.int32)
                sizes = np.array([len(ids) for ids in found], np.int32)
                yield _row(_ANSWERED, row["block"], row["bucket"], _shrunk(flat), len(flat), _shrunk(sizes), len(sizes))

    return answer


def _reassemble(count: int, then: Callable[[pa.RecordBatch], pa.RecordBatch]):
    def reassemble(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        out = [then(pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.list_(pa.int32()))], ["doc_id", "ids"]))]
        for row in _rows(blocks):
            raw = np.frombuffer(pa.decompress(row["words"], row["n_bytes"], codec="zstd", asbytes=True), np.uint8)
            order = np.argsort(_buckets(raw, _grown(row["ends"], row["n_words"], np.int32).astype(np.int64), count), kind="stable")
            given = sorted(_rows(answers), key=lambda a: a["bucket"])
            flat = np.concatenate([_grown(a["ids"], a["n_ids"], np.int32) for a in given] or [np.zeros(0, np.int32)])
            sizes = np.concatenate([_grown(a["lengths"], a["n_words"], np.int32) for a in given] or [np.zeros(0, np.int32)])
            lengths, starts = np.empty_like(sizes), np.empty(len(sizes), np.int64)
            lengths[order], starts[order] = sizes, np.cumsum(sizes, dtype=np.int64) - sizes
            places, ends = _grown(row["positions"], row["n_positions"], np.int32), np.cumsum(row["counts"], dtype=np.int64)
            first = 0
            while first < len(ends):  # documents of a bounded number of words at a time
                begin = int(ends[first - 1]) if first else 0
                last = max(int(np.searchsorted(ends, begin + WORDS, "right")), first + 1)
                at = places[begin : int(ends[last - 1])]
                stops = np.append(0, np.cumsum(lengths[at], dtype=np.int64))[np.append(0, ends[first:last] - begin)]
                ids = arrays.gathered(flat, starts[at], lengths[at])
                lists = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(ids, pa.int32()))
                out.append(then(pa.RecordBatch.from_arrays([pa.array(row["doc_ids"][first:last], pa.int64()), lists], ["doc_id", "ids"])))
                first = last
        return pa.Table.from_batches(out)

    return reassemble


ENCODED = "doc_id bigint, ids array<int>"


def encode(docs: DataFrame, ranks: str, then: Callable[[pa.RecordBatch], pa.RecordBatch] = lambda batch: batch, schema: str = ENCODED) -> DataFrame:
    """doc_id and the ids of every whole text, by the ranks of the file, special strings as ordinary text.

    `then` makes other columns (`schema`) of the ids where they are put together, so that they need not travel on.

    A null or empty text has no ids; rows are kept one by one, so repeated rows and null doc_ids stay as they are; other
    columns are not read. The blocks are shuffled once and read by both branches; only distinct words of blocks and their
    ids move besides. A block's number is its task's and its place in it, so a task that runs again makes the same.
    """
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = in_batches(rows, _split, _BLOCKS).repartition("block")
    asked = in_batches(blocks, _ask(buckets), _ASKED).repartition("bucket")
    answers = in_batches(asked, _answer(ranks), _ANSWERED)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_reassemble(buckets, then), schema)


def _bytes_of(batch: pa.RecordBatch, ranks: str):
    """(row, ids, bytes) of every document of a batch with columns doc_id and ids."""
    table, starts, lengths = vocabularies.token_table(ranks)
    lists = batch.column(1)
    for i in range(len(lists)):
        ids = lists[i].values.to_numpy(zero_copy_only=False) if lists[i].is_valid else np.zeros(0, np.int32)
        yield i, ids, arrays.gathered(table, starts[ids], lengths[ids]).tobytes()


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """doc_id and `decoded`, the bytes of its ids; null ids give none."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([raw for _, _, raw in _bytes_of(batch, ranks)], pa.binary())], ["doc_id", "decoded"])

    return in_batches(encoded.select("doc_id", "ids"), each, "doc_id bigint, decoded binary")


DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def digested(ranks: str) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """doc_id, n_tokens, and SHA-256 of the ids and of the decoded bytes, of a batch with doc_id and ids."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [(len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest()) for _, ids, raw in _bytes_of(batch, ranks)]
        sizes, names, texts = zip(*found) if found else ((), (), ())
        columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.string()), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in DIGESTS.split(", ")])

    return each


def op10_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of the ids of all documents and of what they decode to."""
    ranks = vocabularies.default_path("byte_bpe_50k.tiktoken")
    return encode(spark.read.parquet(f"{folder}/documents.parquet"), ranks, digested(ranks), DIGESTS)
