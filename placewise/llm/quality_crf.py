"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's score comes from its own shape and that of its neighbours (letters, capitals, signs,
cell bars, repetition, length), and the chain adds weights for each pair of neighbouring states. Forward-backward gives
each line's marginal; the marginals, weighted by length, are the document's share of good text, and a logistic curve
fitted on the labelled documents turns that share into the probability that a reader marks the document as good.

Labels mark documents, not lines, so the fit starts with every line labelled like its document, then lets lines of bad
documents that look good change sides, and fits again. It uses at most `SAMPLE` labelled documents (whole texts), chosen by a hash of
the id; scoring runs inside a scan, with no shuffle, whatever the number of documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from placewise.llm import arrays
from placewise.llm.storage import in_batches

#: Labelled documents that the fit uses at most.
SAMPLE = 3000
#: Documents with at least this score are good.
THRESHOLD = 0.7
#: Good lines of a bad document count as good in the second fit above this marginal.
RELABEL = 0.8

_SIGNS = np.zeros(256, bool)
_SIGNS[[ord(c) for c in "#*$%&|<>{}[]=~^_\\@"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_LETTER = np.zeros(256, bool)
_LETTER[ord("A") : ord("Z") + 1] = True
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[0x80:] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True

OWN = ("size", "words", "word_size", "letters", "capitals", "signs", "bars", "bangs", "digits", "commas", "closed", "repeated", "same_words", "glued_signs", "blank")
AROUND = ("letters", "capitals", "signs", "bars", "bangs", "repeated", "size", "same_words")


def line_features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of all texts, bytes of each line, and lines of each text (an empty text has one empty line)."""
    n = len(data)
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([bounds[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([breaks, bounds[1:]]), kind="stable")
    # A break that ends its text opens an empty line at the next text's first byte: the count below keeps it in its own text.
    counts = np.bincount(arrays.owner(breaks, bounds), minlength=len(bounds) - 1) + 1
    size = (ends - starts).astype(np.float64)

    def counted(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(n + 1, np.int32)
        np.cumsum(mask, out=sums[1:])
        return (sums[ends] - sums[starts]).astype(np.float64)

    solid = ~_SPACE[data]
    after = np.empty(n, bool)
    after[1:] = solid[:-1]
    after[arrays.marked(bounds, n)] = False
    first_of_word = solid & ~after
    words = counted(first_of_word)
    signs = _SIGNS[data]
    glued = np.zeros(n, bool)
    glued[1:] = signs[1:] & _LETTER[data[:-1]]
    letters = counted(_LETTER[data])
    w1, s1 = np.maximum(words, 1), np.maximum(size, 1)
    line = np.repeat(np.arange(len(counts)), counts)
    line_hash = arrays.hashes(data, starts, ends)
    again = arrays.repeated(line, line_hash)[0] & (size > 0)
    ws, we, owner = arrays.runs(solid, bounds)
    at = np.searchsorted(starts, ws, "right") - 1
    same = arrays.repeated(at, arrays.hashes(data, ws, we))[1]
    last = np.where(size > 0, data[np.maximum(ends - 1, 0)] if n else 0, 0)
    own = {
        "size": np.log1p(size),
        "words": np.log1p(words),
        "word_size": np.minimum(size / w1, 40),
        "letters": letters / s1,
        "capitals": counted(_UPPER[data]) / np.maximum(letters, 1),
        "signs": counted(signs) / s1,
        "bars": counted(data == ord("|")) / w1,
        "bangs": counted(data == ord("!")) / w1,
        "digits": counted((data >= 0x30) & (data <= 0x39)) / s1,
        "commas": counted(data == ord(",")) / w1,
        "closed": np.isin(last, [ord(c) for c in ".!?:"]).astype(np.float64),
        "repeated": again.astype(np.float64),
        "same_words": np.bincount(at[same], minlength=len(starts)) / w1,
        "glued_signs": counted(glued) / w1,
        "blank": (words == 0).astype(np.float64),
    }
    edge = np.ones(len(starts), bool)
    firsts = np.cumsum(counts) - counts
    edge[:] = False
    edge[firsts] = True
    final = np.zeros(len(starts), bool)
    final[firsts + counts - 1] = True
    columns = [own[k] for k in OWN]
    for k in AROUND:
        before, following = np.roll(own[k], 1), np.roll(own[k], -1)
        before[edge], following[final] = own[k][edge], own[k][final]
        columns += [before, following]
    columns += [edge.astype(np.float64), final.astype(np.float64), np.repeat(np.log1p(counts), counts)]
    return np.stack(columns, 1), size, counts


@dataclass
class Chain:
    """Weights of the field: `lift` scores a good line over a bad one; `joint[a, b]` scores state b after state a."""

    centre: np.ndarray
    scale: np.ndarray
    lift: np.ndarray
    joint: np.ndarray
    start: np.ndarray
    curve: tuple[float, float] = (1.0, 0.0)

    def scores(self, features: np.ndarray) -> np.ndarray:
        x = np.clip((features - self.centre) / self.scale, -6, 6)
        return x @ self.lift[:-1] + self.lift[-1]


def _steps(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest chain first: (first line of each, lines of each, number of chains that have a t-th line)."""
    order = np.argsort(-counts, kind="stable")
    firsts = (np.cumsum(counts) - counts)[order]
    sizes = counts[order]
    alive = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), "left")
    return firsts, sizes, alive


def forward_backward(good: np.ndarray, counts: np.ndarray, joint: np.ndarray, start: np.ndarray):
    """Marginal of the good state of every line, expected pair counts, and log partition summed over all chains.

    All chains advance together, one line at a time, in rescaled probabilities.
    """
    n = len(good)
    node = np.empty((n, 2))
    top = np.maximum(good, 0)
    node[:, 0], node[:, 1] = np.exp(-top), np.exp(good - top)
    firsts, sizes, alive = _steps(counts)
    move, begin = np.exp(joint), np.exp(start)
    ahead, scale = np.empty((n, 2)), np.empty(n)
    for t, k in enumerate(alive):
        at = firsts[:k] + t
        value = node[at] * (begin if t == 0 else ahead[at - 1] @ move)
        scale[at] = value.sum(1)
        ahead[at] = value / scale[at][:, None]
    back = np.ones((n, 2))
    pairs = np.zeros((2, 2))
    for t in range(len(alive) - 1, 0, -1):
        at = firsts[: alive[t]] + t
        passed = node[at] * back[at] / scale[at][:, None]
        back[at - 1] = passed @ move.T
        pairs += (ahead[at - 1].T @ passed) * move
    marginal = ahead * back
    return marginal[:, 1] / marginal.sum(1), pairs, float(np.log(scale).sum() + top.sum())


def _fit_chain(chain: Chain, x: np.ndarray, counts: np.ndarray, labels: np.ndarray, weight: np.ndarray, rounds: int) -> None:
    """Penalised conditional likelihood of the line labels, by Adam with full batches."""
    firsts = np.cumsum(counts) - counts
    inner = np.ones(len(labels), bool)
    inner[firsts] = False
    y = labels.astype(int)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[np.flatnonzero(inner) - 1], y[inner]), 1)
    opened = np.bincount(y[firsts], minlength=2).astype(float)
    theta = np.concatenate([chain.lift, chain.joint.ravel(), chain.start])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    k = len(chain.lift)
    for step in range(1, rounds + 1):
        lift, joint, start = theta[:k], theta[k : k + 4].reshape(2, 2), theta[k + 4 :]
        good = x @ lift[:-1] + lift[-1]
        marginal, pairs, _ = forward_backward(good, counts, joint, start)
        off = labels - marginal
        begun = marginal[firsts].sum()
        slope = np.concatenate([x.T @ off, [off.sum()], (seen - pairs).ravel(), opened - np.array([len(firsts) - begun, begun])]) / len(labels)
        slope -= 1e-3 * theta
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        theta = theta + 0.15 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8) / (1 + step / 60)
    chain.lift, chain.joint, chain.start = theta[:k], theta[k : k + 4].reshape(2, 2), theta[k + 4 :]


def _shares(marginal: np.ndarray, size: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Length-weighted mean marginal of each document."""
    weight = size + 1.0
    firsts = np.cumsum(counts) - counts
    return np.add.reduceat(marginal * weight, firsts) / np.add.reduceat(weight, firsts) if len(firsts) else np.zeros(0)


def _raised(shares: np.ndarray) -> np.ndarray:
    bound = np.clip(shares, 1e-4, 1 - 1e-4)
    return np.log(bound / (1 - bound))


def _fit_curve(shares: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Logistic curve from share to label, by Newton steps with a small penalty; never falling."""
    x = np.stack([_raised(shares), np.ones(len(shares))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ w)))
        slope = x.T @ (labels - p) - 0.1 * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        w = w + np.linalg.solve(bend, slope)
    return float(max(w[0], 1e-3)), float(w[1])


def fit(texts: pa.Array, labels: np.ndarray) -> Chain | None:
    """A fitted field, or None if the labels are all alike or there are none."""
    labels = np.asarray(labels, float)
    if not len(labels) or labels.min() == labels.max():
        return None
    order = np.arange(len(labels))
    parts = []
    column = arrays.strings(texts)
    for at, rows in arrays.pieces(column):
        parts.append(line_features(*arrays.laid_out(column.slice(at, rows))))
    features, size, counts = (np.concatenate(p) for p in zip(*parts))
    centre, scale = features.mean(0), np.maximum(features.std(0), 1e-6)
    chain = Chain(centre, scale, np.zeros(features.shape[1] + 1), np.zeros((2, 2)), np.zeros(2))
    x = np.clip((features - centre) / scale, -6, 6)
    document = np.repeat(order, counts)
    lines = labels[document]
    for rounds in (60, 60):
        _fit_chain(chain, x, counts, lines, size, rounds)
        marginal, _, _ = forward_backward(x @ chain.lift[:-1] + chain.lift[-1], counts, chain.joint, chain.start)
        lines = np.where((labels[document] == 0) & (marginal > RELABEL), 1.0, labels[document])
        left = np.zeros(len(labels))
        np.maximum.at(left, document, 1 - lines)
        lines = np.where((left[document] == 0) & (labels[document] == 0), 0.0, lines)  # a bad document keeps bad lines
    chain.curve = _fit_curve(_shares(marginal, size, counts), labels)
    return chain


def scores(chain: Chain | None, texts: pa.Array) -> np.ndarray:
    """Probability that each text is good; 1 without a fitted field, as nothing speaks against any text then."""
    if chain is None:
        return np.ones(len(texts))
    column, found = arrays.strings(texts), []
    for at, rows in arrays.pieces(column):
        features, size, counts = line_features(*arrays.laid_out(column.slice(at, rows)))
        marginal, _, _ = forward_backward(chain.scores(features), counts, chain.joint, chain.start)
        a, b = chain.curve
        found.append(1 / (1 + np.exp(-(a * _raised(_shares(marginal, size, counts)) + b))))
    return np.concatenate(found) if found else np.zeros(0)


def held_out(doc_id: Column) -> Column:
    """The quarter of ids that no fit may see; a null id is not in it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_on(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain | None:
    """Fit on labelled documents outside the held-out quarter.

    Labels that contradict each other and null labels are left out. Only doc_id, text and quality are read.
    """
    agreed = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
        .where("low = high")
        .select("doc_id", F.col("low").cast("double").alias("quality"))
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = agreed.orderBy(*order).limit(sample)  # a bounded number of ids
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    table = found.orderBy(*order, F.xxhash64("text")).limit(sample).select("text", "quality").toArrow()
    return fit(table.column("text").combine_chunks(), table.column("quality").to_numpy())


def score(docs: DataFrame, chain: Chain | None) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; a null text is scored like an empty one."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = scores(chain, batch.column(2))
            columns = [batch.column(0), batch.column(1), pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return in_batches(rows, each, "doc_id bigint, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, chain: Chain | None, text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns unchanged, whose text scores as good."""
    at = docs.columns.index(text)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(chain, batch.column(at)) >= THRESHOLD))

    return in_batches(docs, each, docs.schema)


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of all documents by a field fitted on the labels outside the held-out quarter."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return score(docs, fit_on(docs, spark.read.parquet(f"{folder}/labels.parquet")))
