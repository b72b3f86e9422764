"""Near duplicates by SimHash, with bit-sliced comparison of fingerprints.

A-Z are lower-cased, words are runs of `[^\\x20\\x09-\\x0D]`, and a shingle is four words in a row, joined by blanks; a text of
one to three words is one shingle. A bit of the fingerprint is 1 if more than half of the shingles' XXH64 hashes (seed 42,
repeats included) have it. Two texts are linked if their fingerprints differ in at most `RADIUS` bits.

1. A scan gives each row its fingerprint. Equal fingerprints are one node, combined before the shuffle, so copies cost nothing.
2. The 64 bits are cut into `RADIUS + 2` parts. Where at most `RADIUS` bits differ, two parts at least are equal, so nodes
   meet in one bucket for every two parts: all links are found. Buckets of one node are dropped.
3. A bucket beyond `BLOCK` nodes is dealt to blocks, and every two blocks are a cell. Cells of many buckets are compared
   together in a task of bounded size (`compare`): the fingerprints stand as bit planes, one machine word holds a bit of 64
   of them, and their distances to a query are counted at once by carry-save adders. Once all 64 exceed the radius, the
   word is abandoned. A task keeps no pairs: it hands out one link for every node that it joins to another.
4. Connected components of the links, by rounds over stored tables; the least doc_id of each is its name.

Nothing is estimated and nothing is dropped. Null and empty texts, and texts of blanks, have fingerprint zero and are linked
like any other. Rows are kept one by one: rows with equal or null doc_ids each give a row; a null doc_id names no component,
and a component of such rows alone has a null name. A very long text is hashed a section at a time. An empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from placewise.llm import arrays
from placewise.llm.near_duplicates import components
from placewise.llm.storage import in_batches, stored

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Nodes of one side of a cell, about.
BLOCK = 8192
#: Nodes that a task compares at once, about (a cell is not cut), words of 64 distances updated at once, and bytes of a section.
HELD, WORDS, SECTION = 32768, 32768, 1 << 20

_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _sections(raw: bytes) -> Iterator[bytes]:
    """Cuts of a text at blanks, of about SECTION bytes each."""
    at = 0
    while len(raw) - at > SECTION and (blank := _BLANK.search(raw, at + SECTION)):
        yield raw[at : blank.start()]
        at = blank.end()
    yield raw[at:]


def shingle_hashes(raw: bytes) -> Iterator[list[int]]:
    """Hashes of all shingles of a text, a section at a time; the last words of a section open the next one."""
    words, found = [], False
    for section in _sections(raw.lower()):
        words = words[1 - SHINGLE :] + section.split()
        if len(words) < SHINGLE:
            continue
        joined, found = b" ".join(words), True
        ends = list(itertools.accumulate(len(w) + 1 for w in words))
        yield [xxhash.xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[SHINGLE - 1 :])]
    if words and not found:
        yield [xxhash.xxh64_intdigest(b" ".join(words), SEED)]


def fingerprints_of(texts: pa.Array) -> np.ndarray:
    """The fingerprint of every text."""
    texts = arrays.strings(texts)
    ones, total = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    held, owners, counts = [], [], []

    def count() -> None:
        if held:
            bits = np.unpackbits(np.array(held, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
            sums = np.add.reduceat(bits, np.cumsum(counts) - counts, axis=0, dtype=np.int64)
            np.add.at(ones, owners, sums)
            np.add.at(total, owners, counts)
            held.clear(), owners.clear(), counts.clear()

    for row, text in enumerate(texts):
        for hashes in shingle_hashes(text.as_buffer().to_pybytes()):
            held += hashes
            owners.append(row)
            counts.append(len(hashes))
            if len(held) > HELD:
                count()
    count()
    return np.packbits(2 * ones > total[:, None], axis=1).reshape(-1).view(">u8").astype(np.uint64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = pa.array(fingerprints_of(batch.column(1)).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), marks], ["doc_id", "node"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and `node`, the fingerprint as a signed number, of every row."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_batches(rows, _sign, "doc_id bigint, node bigint")


def distances_within(planes: np.ndarray, words: np.ndarray, queries: np.ndarray, lanes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(pair, lane) of all fingerprints that differ from their query in at most `radius` bits.

    Pair i compares the query with the 64 fingerprints of word `words[i]` of the planes, of which `lanes[i]` says which
    count. Each lane has a counter, stored as bit planes too, that starts so high that the distance `radius + 1` overflows
    it; an overflow stays.
    """
    digits = max(radius.bit_length(), 1)
    start = (1 << digits) - 1 - radius
    counter = [np.full(len(words), _FULL if start >> d & 1 else 0, np.uint64) for d in range(digits)]
    over, live = ~lanes, np.arange(len(words))
    one = np.uint64(1)
    for bit in range(0, 64, 2):
        first = planes[bit][words] ^ (np.uint64(0) - (queries >> np.uint64(bit) & one))
        second = planes[bit + 1][words] ^ (np.uint64(0) - (queries >> np.uint64(bit + 1) & one))
        both = counter[0] ^ first
        carry = (counter[0] & first) | (both & second)
        counter[0] = both ^ second
        for d in range(1, digits):
            counter[d], carry = counter[d] ^ carry, counter[d] & carry
        over |= carry
        if bit % 8 == 6:
            near = np.flatnonzero(over != _FULL)
            if len(near) < len(over):
                words, queries, over, live = words[near], queries[near], over[near], live[near]
                counter = [c[near] for c in counter]
    pair, lane = np.nonzero(np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return live[pair], lane


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Gives linked nodes the least label of either, until no link joins two labels."""
    while True:
        first, second = label[a], label[b]
        apart = first != second
        if not apart.any():
            return
        a, b, first, second = a[apart], b[apart], first[apart], second[apart]
        np.minimum.at(label, np.maximum(first, second), np.minimum(first, second))
        while not np.array_equal(label[label], label):
            label[:] = label[label]


def compare(nodes: np.ndarray, begins: np.ndarray, ends: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For every place a place of its component, where place i is compared with those from begins[i] to ends[i]."""
    bits = np.zeros((64, -(-len(nodes) // 64) * 64), np.uint8)
    bits[:, : len(nodes)] = (nodes >> np.arange(64, dtype=np.uint64)[:, None]) & np.uint64(1)
    planes = np.packbits(bits, axis=1, bitorder="little").view("<u8").astype(np.uint64)
    label = np.arange(len(nodes))
    asks = np.flatnonzero(begins < ends)
    low, high = begins[asks] // 64, (ends[asks] - 1) // 64 + 1
    stops = np.cumsum(high - low)
    at = 0
    while at < len(asks):
        stop = max(int(np.searchsorted(stops, (stops[at - 1] if at else 0) + WORDS, "right")), at + 1)
        many = (high - low)[at:stop]
        query = np.repeat(asks[at:stop], many)
        words = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low[at:stop], many)
        before, after = np.maximum(begins[query] - 64 * words, 0), np.maximum(64 * words + 64 - ends[query], 0)
        lanes = (_FULL << before.astype(np.uint64)) & (_FULL >> after.astype(np.uint64))
        pair, lane = distances_within(planes, words, nodes[query], lanes, radius)
        _join(label, query[pair], words[pair] * 64 + lane)
        at = stop
    return label


def _compared(radius: int):
    def links(cell: np.ndarray, part: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
        """Links inside whole cells. A cell of one block compares its later nodes, one of two blocks its second block."""
        place = np.arange(len(nodes))
        starts = np.flatnonzero(np.append(True, (cell[:, 1:] != cell[:, :-1]).any(0)))
        own = np.searchsorted(starts, place, "right") - 1
        ends = np.append(starts[1:], len(nodes))[own]
        crossing, second = cell[1] != cell[2], part == cell[2]
        others = np.append(0, np.cumsum(second))
        begins = np.where(crossing, np.where(second, ends, ends - (others[ends] - others[starts[own]])), place + 1)
        label = compare(nodes, begins, ends, radius)
        joined = np.flatnonzero(label != place)
        return pa.RecordBatch.from_arrays([pa.array(nodes[label[joined]].view(np.int64)), pa.array(nodes[joined].view(np.int64))], ["a", "b"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            held.append(np.stack([c.to_numpy() for c in batch.columns]))
            count += batch.num_rows
            if count > HELD:
                rows = np.concatenate(held, axis=1)
                edges = np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(0))
                cut = int(edges[-1]) + 1 if len(edges) else 0
                if cut:
                    yield links(rows[:3, :cut], rows[3, :cut], rows[4, :cut].view(np.uint64))
                held, count = [rows[:, cut:]], rows.shape[1] - cut
        if count:
            rows = np.concatenate(held, axis=1)
            yield links(rows[:3], rows[3], np.ascontiguousarray(rows[4]).view(np.uint64))

    return compared


def bucket_keys(node: Column, radius: int = RADIUS) -> Column:
    """Array of the buckets of a fingerprint: one for every two of its radius + 2 parts."""
    parts = radius + 2
    edges = [64 * i // parts for i in range(parts + 1)]
    masks = [(1 << high) - (1 << low) for low, high in zip(edges, edges[1:])]
    signed = [m - (1 << 64) if m >> 63 else m for m in (a | b for a, b in itertools.combinations(masks, 2))]
    return F.array(*[F.xxhash64(F.lit(i), node.bitwiseAND(F.lit(m))) for i, m in enumerate(signed)])


def links(nodes: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between the distinct nodes that join all nodes within the radius; not every pair within it."""
    met = nodes.select("node", F.explode(bucket_keys(F.col("node"), radius)).alias("bucket"))
    full = met.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / block)
    dealt = met.join(full.select("bucket", parts.alias("parts")), "bucket").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    squares = F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1), lambda i: F.struct(F.least(i, F.col("part")).alias("i"), F.greatest(i, F.col("part")).alias("j"))))
    cells = dealt.select("bucket", squares.alias("s"), "part", "node").select("bucket", "s.i", "s.j", "part", "node")
    sorted_cells = cells.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "part")
    return in_batches(sorted_cells, _compared(radius), "a bigint, b bigint")


def components_of(docs: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    signed = stored(fingerprints(docs), "fingerprints")
    nodes = stored(signed.groupBy("node").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    roots = components(stored(links(nodes, radius, block), "fingerprint-links"))
    named = nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    found = named.join(names, "root").select("node", "component_id")
    shown = F.lower(F.lpad(F.hex("node"), 16, "0"))
    return signed.join(found, "node").select("doc_id", shown.alias("fingerprint"), "component_id")


def op11_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of all documents."""
    return components_of(spark.read.parquet(f"{folder}/documents.parquet"))
