"""Near duplicates by ProbMinHash over weighted word shingles, banding and exact verification.

Words are runs of ASCII letters and digits or characters beyond ASCII, A-Z lower-cased. A shingle is five words in a row
(a text of one to four words is one shingle); its weight is how often the text holds it. The similarity is the
probability Jaccard index: the chance that two texts agree in a component of a consistent weighted sample. Without
repeated shingles it is the plain Jaccard index.

1. `signatures`: each shingle sends a Poisson process of rate weight; every arrival has a random component, and each
   component keeps the shingle that arrives first. A text stops as soon as no further arrival can come first anywhere.
2. Texts with equal words share one node (the least id), so copies collapse before any pair is formed.
3. Each band of the signature is a bucket. Every node of a bucket is paired with the least one only, so pairs grow with
   the nodes. All pairs are verified on whole texts.
4. Connected components of verified links. Where a bucket still holds several components, links may be missing between
   nodes that the least one is not similar to: there, nodes are compared across components in square blocks of bounded
   size, by signature and, near the threshold, on their shingles. A block gives only links that join components, so its
   result grows with the nodes.

Nothing is dropped: the only losses are those of 30 bands of 6 components (1 in 10,000 at the threshold itself, less above).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from placewise.llm import arrays
from placewise.llm.storage import free_name, in_batches, shipped, stored

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 30, 6
COMPONENTS = BANDS * ROWS
#: Five standard errors of the signature's estimate below the threshold.
NEAR = THRESHOLD - 5 * (THRESHOLD * (1 - THRESHOLD) / COMPONENTS) ** 0.5
#: Nodes and bytes of text of one side of a block in step 4, about; a longer text is a side of its own.
BLOCK = 1024
BLOCK_BYTES = 16 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_WORD = np.zeros(256, bool)
_WORD[ord("0") : ord("9") + 1] = True
_WORD[ord("a") : ord("z") + 1] = True
_WORD[0x80:] = True


def _shingles(data: np.ndarray, bounds: np.ndarray):
    """(text, shingle, weight) without repetition, words of each text, and the word hashes."""
    data = _LOWER[data]
    starts, ends, text = arrays.runs(_WORD[data], bounds)
    words = arrays.hashes(data, starts, ends)
    count = len(bounds) - 1
    counts = np.bincount(text, minlength=count)
    keys, owner, _ = arrays.windows(words, counts, SHINGLE)
    firsts = np.cumsum(counts) - counts
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    whole = np.zeros(len(short), np.uint64)
    for i in range(SHINGLE - 1):
        has = counts[short] > i
        whole[has] = arrays.mixed(whole[has] * np.uint64(0x9E3779B97F4A7C15) + words[firsts[short][has] + i] + np.uint64(1))
    keys, owner = np.concatenate([keys, whole]), np.concatenate([owner, short])
    codes, _, first = arrays.numbered(arrays.mixed(keys + owner.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
    return owner[first], keys[first], np.bincount(codes, minlength=len(first)).astype(np.float64), counts, words


def probminhash(owner: np.ndarray, keys: np.ndarray, weight: np.ndarray, count: int, components: int = COMPONENTS) -> np.ndarray:
    """The shingle that arrives first in every component of every text, from Poisson arrivals with early termination.

    The n-th waiting time of a shingle and the component it falls in depend on the shingle and n alone, so two texts draw
    alike. After each round only shingles remain whose last arrival is before the text's latest component.
    """
    earliest = np.full(count * components, np.inf)
    winner = np.zeros(count * components, np.uint64)
    active, when, turn = np.arange(len(keys)), np.zeros(len(keys)), 0
    while len(active):
        turn += 1
        draw = arrays.mixed(keys[active] + np.uint64(turn * 0xA0761D6478BD642F % 2**64))
        when[active] += -np.log(((draw >> np.uint64(11)).astype(np.float64) + 1) / 2**53) / weight[active]
        slot = owner[active] * components + (arrays.mixed(draw ^ np.uint64(0xE7037ED1A0B428DB)) % np.uint64(components)).astype(np.int64)
        np.minimum.at(earliest, slot, when[active])
        won = when[active] == earliest[slot]
        winner[slot[won]] = keys[active[won]]
        latest = earliest.reshape(count, components).max(1)
        active = active[when[active] < latest[owner[active]]]
    return winner.reshape(count, components)


def row_id(docs: DataFrame) -> Column:
    """The doc_id; of a row without one a negative hash of its text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1) - F.xxhash64(text).bitwiseAND(F.lit((1 << 63) - 1)))


def _identity(words: np.ndarray, counts: np.ndarray, seed: int) -> np.ndarray:
    """A hash of the words of each text, in order."""
    up = np.full(len(words) + 1, 0xD1342543DE82EF95 + 2 * seed, np.uint64)
    up[0] = 1
    up = np.multiply.accumulate(up)
    inverse = np.full(len(words) + 1, pow(0xD1342543DE82EF95 + 2 * seed, -1, 1 << 64), np.uint64)
    inverse[0] = 1
    inverse = np.multiply.accumulate(inverse)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(arrays.mixed(words + np.uint64(seed)) * up[:-1], out=sums[1:])
    ends = np.cumsum(counts)
    return arrays.mixed((sums[ends] - sums[ends - counts]) * inverse[ends - counts] + counts.astype(np.uint64))


_SIGNED = "row bigint, doc_id bigint, high bigint, low bigint, signature binary, bytes bigint"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = arrays.strings(batch.column(2))
        for at, rows in arrays.pieces(texts):
            data, bounds = arrays.laid_out(texts.slice(at, rows))
            owner, keys, weight, counts, words = _shingles(data, bounds)
            short = probminhash(owner, keys, weight, rows).astype("<u2")
            ids = [pa.array(_identity(words, counts, seed).view(np.int64)) for seed in (1, 2)]
            marks = pa.array([s.tobytes() if c else None for s, c in zip(short, counts)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, rows), batch.column(1).slice(at, rows), *ids, marks, pa.array(np.diff(bounds), pa.int64())], [c.split()[0] for c in _SIGNED.split(", ")])


def signatures(docs: DataFrame) -> DataFrame:
    """row, doc_id, identity of the words (high, low), signature and bytes of every row; null signature without words."""
    rows = docs.select(row_id(docs).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_batches(rows, _sign, _SIGNED)


def similarity(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Probability Jaccard index of texts 0 and 1, 2 and 3, and so on; 0 if one has no words."""
    owner, keys, weight, _, _ = _shingles(data, bounds)
    return _alike(owner, keys, weight, (len(bounds) - 1) // 2)


def _alike(owner: np.ndarray, keys: np.ndarray, weight: np.ndarray, count: int) -> np.ndarray:
    """The same from weighted shingles; those of owners 2i and 2i + 1 are compared."""
    if not len(keys):
        return np.zeros(count)
    pair, left = owner // 2, owner % 2 == 0
    codes, _, first = arrays.numbered(arrays.mixed(keys + pair.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
    a, b = np.zeros(len(first)), np.zeros(len(first))
    a[codes[left]], b[codes[~left]] = weight[left], weight[~left]
    pair = pair[first]
    order = np.lexsort((a / (a + b), pair))
    a, b, pair = a[order], b[order], pair[order]
    counts = np.bincount(pair, minlength=count)
    ends = np.cumsum(counts)
    sum_a, sum_b = np.concatenate([[0.0], np.cumsum(a)]), np.concatenate([[0.0], np.cumsum(b)])
    both = np.flatnonzero((a > 0) & (b > 0))
    own = pair[both]
    more = (sum_a[ends[own]] - sum_a[both]) / a[both]  # from the shingle on, where a leads
    less = (sum_b[both] - sum_b[ends[own] - counts[own]]) / b[both]
    return np.bincount(own, 1 / (more + less), minlength=len(counts))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = pa.concat_arrays([arrays.strings(batch.column(2)), arrays.strings(batch.column(3))])
        n = batch.num_rows
        texts = both.take(pa.array(np.arange(2 * n).reshape(2, n).T.ravel()))
        found = []
        for at, rows in arrays.pieces(texts, 2 * arrays.PIECE_BYTES):
            rows += (at + rows) % 2  # whole pairs: a cut inside a pair is moved behind it
            begin = at + at % 2
            if at + rows > begin:
                found.append(similarity(*arrays.laid_out(texts.slice(begin, at + rows - begin))))
        like = pa.array(np.concatenate(found) >= THRESHOLD - 1e-9 if found else np.zeros(0, bool))
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(like), batch.column(1).filter(like)], ["a", "b"])


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of rows whose whole texts are similar enough."""
    texts = docs.select(row_id(docs).alias("row"), F.col("text").cast("string").alias("text"))
    left = texts.select(F.col("row").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("row").alias("b"), F.col("text").alias("text_b"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return in_batches(rows, _verify, "a bigint, b bigint").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all linked nodes: the least node of each connected component, by large-star and small-star rounds.

    Each round is two aggregates with map-side combining and two joins on nodes, stored; it ends when edges stay the same.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    last = None
    while True:
        mark = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark.n == 0 or mark == last:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = mark
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stored(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(moved.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), "small-star")


def _bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight) in the order of the texts, made a piece at a time."""
    found = []
    for at, rows in arrays.pieces(texts):
        owner, keys, weight, _, _ = _shingles(*arrays.laid_out(texts.slice(at, rows)))
        order = np.argsort(owner, kind="stable")
        found.append((owner[order] + at, keys[order], weight[order]))
    return tuple(np.concatenate(part) for part in zip(*found))


def _across(key: tuple, table: pa.Table) -> pa.Table:
    """Verified links of one block between components, no more than join them.

    Only pairs whose signatures come near the threshold, and that share no earlier band, are compared on their shingles.
    """
    first, second = key[1].as_py(), key[2].as_py()
    nodes, at = np.unique(table.column("node").to_numpy(), return_index=True)
    table = table.take(pa.array(at))
    part, roots, band = table.column("part").to_numpy(), table.column("root").to_numpy(), table.column("number")[0].as_py()
    marks = np.frombuffer(b"".join(table.column("signature").to_pylist()), "<u2").reshape(-1, COMPONENTS)
    rows, columns = np.flatnonzero(part == first), np.flatnonzero(part == second)
    left, right, score = [], [], []
    for i in rows:
        others = columns[columns > i] if first == second else columns
        others = others[roots[others] != roots[i]]
        same = marks[others] == marks[i]
        near = (same.mean(1) >= NEAR) & ~same[:, : band * ROWS].reshape(len(others), band, ROWS).all(2).any(1)
        left.append(np.full(int(near.sum()), i))
        right.append(others[near])
        score.append(same[near].mean(1))
    found: list[tuple[int, int]] = []
    if sum(map(len, left)):
        order = np.argsort(-np.concatenate(score), kind="stable")
        left, right = np.concatenate(left)[order], np.concatenate(right)[order]
        used = np.unique(np.concatenate([left, right]))  # the other texts are not read
        owner, keys, weight = _bags(arrays.strings(table.column("text").combine_chunks()).take(pa.array(used)))
        owner = used[owner]
        lengths = np.bincount(owner, minlength=len(nodes))
        starts = np.cumsum(lengths) - lengths
        label = np.unique(roots, return_inverse=True)[1]
        for at in range(0, len(left), 2048):
            a, b = left[at : at + 2048], right[at : at + 2048]
            apart = label[a] != label[b]  # the others are joined by now
            a, b = a[apart], b[apart]
            two = np.stack([a, b], 1).ravel()
            sizes = lengths[two]
            value = _alike(np.repeat(np.arange(len(two)), sizes), arrays.gathered(keys, starts[two], sizes), arrays.gathered(weight, starts[two], sizes), len(a))
            for i, j in zip(a[value >= THRESHOLD - 1e-9].tolist(), b[value >= THRESHOLD - 1e-9].tolist()):
                if label[i] != label[j]:
                    label[label == label[j]] = label[i]
                    found.append((int(nodes[i]), int(nodes[j])))
    return pa.table({"a": pa.array([min(f) for f in found], pa.int64()), "b": pa.array([max(f) for f in found], pa.int64())})


def _missing(bands: DataFrame, roots: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) across the components that meet in a bucket. Each pair is compared in the first bucket it shares."""
    shipped(bands.sparkSession)
    members = bands.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(nodes.select("node", "bytes"), "node")
    filled = [F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("n"), F.sum("bytes").alias("bytes")]
    mixed = members.groupBy("band").agg(*filled).where("least <> most")
    parts = F.greatest(F.ceil(F.col("n") / BLOCK), F.least(F.col("n"), F.ceil(F.col("bytes") / BLOCK_BYTES)), F.lit(1)).cast("int")
    dealt = members.drop("bytes").join(mixed.select("band", parts.alias("parts")), "band").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    texts = docs.select(row_id(docs).alias("node"), F.col("text").cast("string").alias("text"))
    dealt = dealt.join(nodes.drop("bytes"), "node").join(texts, "node")
    squares = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(F.least(i, F.col("part")).alias("i"), F.greatest(i, F.col("part")).alias("j"))))
    held = ["part", "number", "node", "root", "signature", "text"]
    rows = dealt.select("band", squares.alias("s"), *held).select("band", "s.i", "s.j", *held)
    return rows.groupBy("band", "i", "j").applyInArrow(_across, "a bigint, b bigint").distinct()


def classes(docs: DataFrame) -> DataFrame:
    """row, doc_id and class_id of every row of `docs`: class_id is the least id of its class.

    Rows with equal words are one class. A text without words is a class of its own. Rows that share a doc_id count as
    one document; a row with a null doc_id goes by a hash of its text. Other columns are not read.
    """
    signed = stored(signatures(docs), "signatures")
    nodes = signed.where("signature IS NOT NULL").groupBy("high", "low").agg(F.min("row").alias("node"), F.first("signature").alias("signature"), F.max("bytes").alias("bytes"))
    nodes = stored(nodes, "nodes")
    width = 2 * ROWS
    keys = [F.xxhash64(F.lit(i), F.substring("signature", i * width + 1, width)) for i in range(BANDS)]
    bands = nodes.select("node", F.posexplode(F.array(*keys)).alias("number", "band"))
    full = bands.groupBy("band").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").select("band", "a")
    shared = stored(bands.join(full, "band"), "buckets")  # buckets of one node are gone
    pairs = shared.where("a <> node").select("a", F.col("node").alias("b")).distinct()
    links = stored(verified(pairs, docs), "verified")
    roots = components(links)
    extra = stored(_missing(shared.select("band", "number", "node"), roots, nodes.select("node", "signature", "bytes"), docs), "verified-more")
    if extra.take(1):
        roots = components(links.unionAll(extra))
    named = nodes.select("high", "low", "node").join(roots, "node", "left").select("high", "low", F.coalesce("root", "node").alias("class_id"))
    return signed.where("signature IS NOT NULL").select("row", "doc_id", "high", "low").join(named, ["high", "low"]).select("row", "doc_id", "class_id").unionAll(
        signed.where("signature IS NULL").select("row", "doc_id", F.col("row").alias("class_id"))
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns unchanged, with one row of each class: the one with the least id.

    A row is known by a hash of its id and its text, so different texts that share a doc_id are classed and kept each.
    """
    row, turn = free_name(docs, "row_of_class"), free_name(docs, "turn_of_row")
    marked = docs.withColumn(row, F.xxhash64(row_id(docs), F.coalesce(F.col("text").cast("string"), F.lit(""))))
    alike = classes(marked.select(F.col(row).alias("doc_id"), "text")).select("row", "class_id").distinct()
    named = marked.select(F.col(row).alias("row"), row_id(docs).alias("id")).distinct()
    least = alike.join(named, "row").groupBy("class_id").agg(F.min(F.struct("id", "row")).alias("least"))
    # equal rows are one before the shuffle: the limit on the number runs in every task first
    once = marked.withColumn(turn, F.row_number().over(Window.partitionBy(row).orderBy(F.lit(1)))).where(F.col(turn) == 1)
    once = once.join(least.select(F.col("least.row").alias(row)), row, "left_semi")
    return once.select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and class_id of all documents."""
    return classes(spark.read.parquet(f"{folder}/documents.parquet")).select("doc_id", "class_id")
