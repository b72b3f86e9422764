"""Aligns the tokens of two tokenizers over the same bytes, and weighs the links by how often the corpus has them.

Both token sequences of a text end at byte offsets. Where a token of either ends at one offset, both texts are cut; between
two cuts lies a group, and every token of the one side is linked to every token of the other side in it.

1. Whole texts are encoded, distinct words once per worker, and the bytes of the tokens are held against the text.
2. Merge path: the ends of both sides are two sorted lists. Binary searches along diagonals of their merge grid, all at
   once, give starting points of pieces with equally many steps, wherever documents begin and end. Pieces are merged side
   by side, none knowing of the others: each emits the cuts inside it. A group that a piece ends but does not begin is
   stitched to what lies behind the last cut of the pieces before it (`merged`).
3. Links are kept as distinct id pairs per document, with how often they occur; documents are gathered to blocks, each with
   a list of its distinct pairs and in how many of its documents they are. Only those lists are shuffled: summed over the
   corpus, ranked within their A id, and joined back to the blocks, which sum up their documents. Which pairs a document
   links, and how often, stays packed in its block: spelled out as arrays it takes more than the text does.

A pair that stands in every text costs one row a block. Null and empty texts, and texts whose tokens spell other bytes, have
no tokens: zeros and an empty digest. Rows are kept one by one, so that equal and null doc_ids each give a row, and repeated
rows count as documents of their own. A very long text is a block of its own; its links are counted by distinct ids in parts
of a bounded number. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from placewise.llm import arrays, byte_bpe, vocabularies
from placewise.llm.storage import in_batches, stored

#: Merge steps of a piece, text of a block, and pairs of ids that are spelled out at once.
STEPS, BLOCK_BYTES, SPELLED = 256, 4 << 20, 1 << 20
_SIDE = np.int64(1 << 32)
_BLOCKS = (
    "block bigint, doc_ids array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, groups_sha256 array<string>, "
    "a array<int>, b array<int>, n_docs array<int>, slots binary, times binary, distinct array<int>"
)
_REPORT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def _diagonals(a: np.ndarray, b: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of `a` and of `b` are merged before each piece of `steps` steps; equal ends merge `a` first."""
    at = np.arange(0, len(a) + len(b), steps)
    low, high = np.maximum(at - len(b), 0), np.minimum(at, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        before = open_.copy()
        before[open_] = a[middle[open_]] <= b[at[open_] - 1 - middle[open_]]
        low, high = np.where(before, middle + 1, low), np.where(open_ & ~before, middle, high)
    return low, at - low


def merged(a: np.ndarray, b: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups of two sorted lists of ends: first and last + 1 of `a`, first and last + 1 of `b`, for every common end."""
    if not len(a) or not len(b):
        return (np.zeros(0, np.int64),) * 4
    i, j = _diagonals(a, b, steps)
    pieces, last = len(i), np.iinfo(np.int64).max
    left, right = np.append(a, last), np.append(b, last)
    cut_a, cut_b = np.full((pieces, steps), -1), np.full((pieces, steps), -1)
    for step in range(min(steps, len(a) + len(b))):
        x, y = left[i], right[j]
        live = np.minimum(x, y) < last
        takes_a = live & (x <= y)
        takes_b = live & ~takes_a
        i = i + takes_a
        cuts = np.flatnonzero(takes_b & (i > 0) & (left[i - 1] == y))
        j = j + takes_b
        cut_a[cuts, step], cut_b[cuts, step] = i[cuts], j[cuts]
    piece, place = np.nonzero(cut_a >= 0)
    end_a, end_b = cut_a[piece, place], cut_b[piece, place]
    # inside a piece a group begins at the cut before it; the first one begins in an earlier piece, at its last cut
    carried_a, carried_b = (np.append(0, np.maximum.accumulate(np.maximum(c.max(1), 0))[:-1]) for c in (cut_a, cut_b))
    opens = np.append(True, piece[1:] != piece[:-1]) if len(piece) else np.zeros(0, bool)
    begin_a = np.where(opens, carried_a[piece], np.append(0, end_a[:-1]) if len(piece) else 0)
    begin_b = np.where(opens, carried_b[piece], np.append(0, end_b[:-1]) if len(piece) else 0)
    return begin_a, end_a, begin_b, end_b


@functools.lru_cache(maxsize=1)
def _spelled(size: int) -> list[str]:
    """Decimal ids, each with nothing, a comma, a bar or a semicolon behind it."""
    return [f"{i}{sign}" for i in range(size) for sign in ("", ",", "|", ";")]


def _groups_digests(ids_a, ids_b, groups, docs_of_groups, size: int, count: int) -> list[str]:
    """SHA-256 of the written groups of each document, '' of one without tokens."""
    begin_a, end_a, begin_b, end_b = groups
    many = (end_a - begin_a) + (end_b - begin_b)
    ends = np.cumsum(many)
    codes = np.empty(len(ids_a) + len(ids_b), np.int64)
    place_a = np.arange(len(ids_a)) + np.repeat(begin_b, end_a - begin_a)
    place_b = np.arange(len(ids_b)) + np.repeat(end_a, end_b - begin_b)
    codes[place_a], codes[place_b] = 4 * ids_a.astype(np.int64) + 1, 4 * ids_b.astype(np.int64) + 1
    codes[place_a[end_a - 1]] += 1
    codes[ends - 1] += 2
    bounds = np.searchsorted(docs_of_groups, np.arange(count + 1))
    written, stops = _spelled(size), np.append(0, ends)[bounds].tolist()
    found = []
    for start, stop in zip(stops, stops[1:]):
        if start == stop:
            found.append("")
            continue
        codes[stop - 1] -= 3
        found.append(hashlib.sha256("".join(map(written.__getitem__, codes[start:stop].tolist())).encode()).hexdigest())
    return found


def _counted(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, number = np.unique(keys, return_inverse=True)
    sums = np.zeros(len(distinct), np.int64)
    np.add.at(sums, number, times)
    return distinct, sums


def linked(ids_a: np.ndarray, ids_b: np.ndarray, groups, docs_of_groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, pair, times) of all distinct id pairs linked in each document; a pair is a * 2**32 + b."""
    begin_a, end_a, begin_b, end_b = groups
    sides = []
    for ids, sizes in ((ids_a, end_a - begin_a), (ids_b, end_b - begin_b)):
        keys, times = np.unique(np.repeat(np.arange(len(sizes)), sizes) * _SIDE + ids, return_counts=True)
        sides.append((keys // _SIDE, keys % _SIDE, times))
    (group, a, times_a), (group_b, b, times_b) = sides
    first, last = np.searchsorted(group_b, group), np.searchsorted(group_b, group, "right")
    ends = np.cumsum(last - first)
    found, at = [(np.zeros(0, np.int64),) * 3], 0
    while at < len(group):
        stop = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SPELLED, "right")), at + 1)
        many = (last - first)[at:stop]
        other = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[at:stop], many)
        doc, pair = np.repeat(docs_of_groups[group[at:stop]], many), np.repeat(a[at:stop], many) * _SIDE + b[other]
        times = np.repeat(times_a[at:stop], many) * times_b[other]
        order = np.lexsort((pair, doc))
        doc, pair, times = doc[order], pair[order], times[order]
        heads = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])))
        found.append((doc[heads], pair[heads], np.add.reduceat(times, heads)))
        at = stop
    doc, pair, times = (np.concatenate(part) for part in zip(*found))
    order = np.lexsort((pair, doc))
    doc, pair, times = doc[order], pair[order], times[order]
    heads = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1]))) if len(doc) else np.zeros(0, np.int64)
    return doc[heads], pair[heads], np.add.reduceat(times, heads) if len(heads) else times


def _spells(tokens, ids: np.ndarray, lengths: np.ndarray, counts: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether the bytes of each text's tokens are the text."""
    table, starts, sizes = tokens
    ends = np.append(0, np.cumsum(lengths))[np.append(0, np.cumsum(counts))]
    right = np.diff(ends) == np.diff(bounds)
    if right.all():
        same = arrays.gathered(table, starts[ids], sizes[ids]) == data
        right[arrays.owner(np.flatnonzero(~same), bounds)] = False
        return right
    for i in np.flatnonzero(right):
        own = ids[counts[:i].sum() : counts[: i + 1].sum()]
        right[i] = np.array_equal(arrays.gathered(table, starts[own], sizes[own]), data[bounds[i] : bounds[i + 1]])
    return right


def aligned(texts: pa.Array, path_a: str, path_b: str):
    """(n_a, n_b, n_groups, n_links, digests, document, pair, times) of a slice of texts."""
    count = len(texts)
    none, blank = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
    data, bounds = arrays.laid_out(pa.compute.if_else(pa.compute.equal(texts, none), none, pa.compute.binary_join_element_wise(none, texts, blank)))
    sides, right = [], np.diff(bounds) > 0
    for kind, path in (("plain tokenizers", path_a), ("pieces", path_b)):
        memory = vocabularies.memory(kind, path)
        ids, counts = memory.ids(data, bounds)
        tokens = vocabularies.token_bytes(kind, path)
        lengths = tokens[2][ids]
        right &= _spells(tokens, ids, lengths, counts, data, bounds)
        sides.append((ids, lengths, counts))
    ends = []
    for k, (ids, lengths, counts) in enumerate(sides):
        kept = np.repeat(right, counts)
        counts = np.where(right, counts, 0)
        # offsets in the joined text, of which texts without tokens are left out
        sides[k] = ids[kept], counts
        ends.append(np.cumsum(lengths[kept]))
    (ids_a, counts_a), (ids_b, counts_b) = sides
    groups = merged(*ends)
    doc = np.repeat(np.arange(count), counts_a)[groups[1] - 1] if len(groups[1]) else np.zeros(0, np.int64)
    links = (groups[1] - groups[0]) * (groups[3] - groups[2])
    size = max(len(vocabularies.token_bytes(kind, path)[2]) for kind, path in (("plain tokenizers", path_a), ("pieces", path_b)))
    n_links = np.zeros(count, np.int64)
    np.add.at(n_links, doc, links)
    digests = _groups_digests(ids_a, ids_b, groups, doc, size, count)
    return counts_a, counts_b, np.bincount(doc, minlength=count), n_links, digests, *linked(ids_a, ids_b, groups, doc)


def _align(path_a: str, path_b: str):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, docs, bytes_held = 0, [], [], 0

        def cut() -> pa.RecordBatch:
            before = np.cumsum([0, *(len(h[0]) for h in held)])
            doc = np.concatenate([h[5] + shift for h, shift in zip(held, before)])
            pair, times = np.concatenate([h[6] for h in held]), np.concatenate([h[7] for h in held])
            distinct, slots, n_docs = np.unique(pair, return_inverse=True, return_counts=True)
            per_doc = np.bincount(doc, minlength=before[-1])
            listed = [docs, *(np.concatenate([h[k] for h in held]) for k in range(4)), [d for h in held for d in h[4]]]
            # a document's slots ascend, so their steps are small
            packed = [byte_bpe._shrunk(np.diff(slots, prepend=0).astype(np.int32)), byte_bpe._shrunk(times)]
            listed += [distinct // _SIDE, distinct % _SIDE, n_docs, *packed, per_doc]
            fields = [f.rsplit(" ", 1) for f in _BLOCKS.split(", ")]
            kinds = {"array<bigint>": pa.int64(), "array<int>": pa.int32(), "array<string>": pa.string()}
            key = (TaskContext.get().partitionId() << 32) | number
            columns = [pa.array([key], pa.int64())]
            for values, (_, kind) in zip(listed, fields[1:]):
                if kind == "binary":
                    columns.append(pa.array([values], pa.binary()))
                    continue
                flat = pa.array(values if isinstance(values, list) else values.astype(kinds[kind].to_pandas_dtype()), kinds[kind])
                columns.append(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat))
            return pa.RecordBatch.from_arrays(columns, [name for name, _ in fields])

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), arrays.strings(batch.column(1))
            for at, rows in arrays.pieces(texts, arrays.PIECE_BYTES // 4):  # splitting and linking take some hundred bytes for each of a text
                own = texts.slice(at, rows)
                held.append(aligned(own, path_a, path_b))
                docs += names[at : at + rows]
                bytes_held += own.nbytes
                if bytes_held >= BLOCK_BYTES:
                    yield cut()
                    number, held, docs, bytes_held = number + 1, [], [], 0
        if held:
            yield cut()

    return align


def blocks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row for each block of documents: their figures, the distinct id pairs, and which of them each document links."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_batches(rows, _align(path_a, path_b), _BLOCKS)


def pair_counts(made: DataFrame) -> DataFrame:
    """a, b, `n` (documents that link the pair) and `best`: no pair of the same `a` is in more documents."""
    listed = made.select(F.explode(F.arrays_zip("a", "b", "n_docs")).alias("p")).select("p.*")
    counts = listed.groupBy("a", "b").agg(F.sum("n_docs").alias("n"))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(most, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in _REPORT.split(", ")]
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}
            packed = row.pop("slots").as_py(), row.pop("times").as_py()
            row = {name: value.values for name, value in row.items()}
            order = np.argsort(row["place"].to_numpy())
            n, best = row["n"].to_numpy()[order], row["best"].to_numpy(zero_copy_only=False)[order]
            per_doc = row["distinct"].to_numpy()
            ends = np.cumsum(per_doc)
            slots, times = (byte_bpe._grown(p, int(per_doc.sum()), kind) for p, kind in zip(packed, (np.int32, np.int64)))
            slots = np.cumsum(slots)
            sums = [np.append(0, np.cumsum(v))[ends] - np.append(0, np.cumsum(v))[ends - per_doc] for v in (np.where(best[slots], times, 0), times * n[slots])] if len(slots) else [np.zeros(len(per_doc), np.int64)] * 2
            given = [row["doc_ids"], row["n_a"], row["n_b"], row["n_groups"], row["n_links"], *map(pa.array, sums), row["groups_sha256"]]
            yield pa.RecordBatch.from_arrays(given, names)


def aligned_documents(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per document: tokens of both sides, groups, links, how many are the best of their A id, and their counts summed."""
    made = stored(blocks(docs, path_a, path_b), "aligned-blocks")
    listed = made.select("block", F.posexplode(F.arrays_zip("a", "b")).alias("place", "p")).select("block", "place", "p.*")
    known = listed.join(stored(pair_counts(made), "pair-counts"), ["a", "b"])
    answers = known.groupBy("block").agg(F.collect_list(F.struct("place", "n", "best")).alias("found"))
    # a block without links has no answer
    answers = answers.select("block", *[F.col(f"found.{c}").alias(c) for c in ("place", "n", "best")])
    none = {"place": "array<int>", "n": "array<bigint>", "best": "array<boolean>"}
    kept = ["doc_ids", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "slots", "times", "distinct"]
    rows = made.select("block", *kept).join(answers, "block", "left").select(*kept, *[F.coalesce(c, F.array().cast(kind)).alias(c) for c, kind in none.items()])
    # two tasks a core write them, each several partitions: the JVM is at its largest here and starts processes for every file
    return in_batches(rows, _summed, _REPORT).coalesce(2 * docs.sparkSession.sparkContext.defaultParallelism)


def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Byte-level tokens of a blank and the text against sentence pieces of the text, for all documents."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return aligned_documents(docs, vocabularies.default_path("byte_bpe_50k.json"), vocabularies.default_path("piece_bpe_32k.model"))
