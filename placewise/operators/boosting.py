"""Second-order gradient boosting with L1 and L2 leaf terms, for squared error, on histograms.

1. Quantile sketches of all features, in one pass, give the cuts. Rows become one byte a feature and are stored once.
2. Trees grow a level at a time. A pass gives, for each node and feature, the sums of gradients and the row counts (the second
   derivatives) of every bin; sums are added per task and then, unless all tasks' sums are few bytes, in one aggregate. Of two
   sister nodes only the one with fewer rows is summed, the other is what is left of the parent.
3. The driver sees bins, never rows: it picks the split with the largest gain for each node of the level.
4. Rows learn their node, and what the latest trees say, from the trees themselves, which travel with the pass. Every
   `STORED_TREES` trees the sums so far are written to a new table, which also cuts the lineage.

A row is drawn for a tree by a hash of its content and the tree's number, and a tree's features by a seeded draw, so a task
that runs again does the same. Missing values go to the left. Equal gains take the first feature and the lowest cut.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from placewise.session import scratch_table
from placewise.settings import BOOSTING

#: Trees after which the sums of all trees are stored with the rows.
STORED_TREES = 10
#: Binned rows of a task, and sums that tasks may send to the driver one by one; more are added in an aggregate first.
TASK_BYTES, DRIVER_BYTES = 16 << 20, 64 << 20


@dataclass
class Tree:
    """A full binary tree in heap order; feature -1 marks a leaf. `cut` counts cuts, `value` is the same cut as a number."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    weight: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.zeros(n))

    def nodes(self, columns: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """The leaf, or the deepest node so far, of every row of a (rows, features) matrix."""
        rows, node = np.arange(len(columns)), np.zeros(len(columns), np.int64)
        while True:
            feature = self.feature[node]
            inner = feature >= 0
            if not inner.any():
                return node
            right = columns[rows, np.maximum(feature, 0)] > cuts[node]
            node = np.where(inner, 2 * node + 1 + right, node)


@dataclass
class BoostedTrees:
    """A fitted model over the named feature columns."""

    features: list[str]
    start: float
    trees: list[Tree] = field(default_factory=list)

    def values(self, matrix: np.ndarray) -> np.ndarray:
        total = np.full(len(matrix), self.start)
        for tree in self.trees:
            total += tree.weight[tree.nodes(matrix, tree.value)]
        return total

    def transform(self, rows: DataFrame, output: str = "y_pred") -> DataFrame:
        """`rows` with the prediction."""
        width = len(self.features)

        @F.arrow_udf("double")
        def predicted(x: pa.Array) -> pa.Array:
            return pa.array(self.values(x.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)))

        return rows.withColumn(output, predicted(_vector(self.features)))

    def importances(self) -> np.ndarray:
        """Share of the gain that each feature's splits brought."""
        total = np.zeros(len(self.features))
        for tree in self.trees:
            inner = tree.feature >= 0
            np.add.at(total, tree.feature[inner], tree.gain[inner])
        return total / total.sum() if total.sum() > 0 else total

    def save(self, spark: SparkSession, path: str) -> None:
        """One JSON line for the model and one for every tree."""
        lines = [json.dumps({"tree": -1, "features": self.features, "start": self.start})]
        lines += [json.dumps({"tree": i, **{k: v.tolist() for k, v in vars(t).items()}}) for i, t in enumerate(self.trees)]
        spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedTrees:
        found = sorted((json.loads(r["value"]) for r in spark.read.text(path).collect()), key=lambda x: x["tree"])
        model = cls(found[0]["features"], found[0]["start"])
        model.trees = [Tree(**{k: np.array(v) for k, v in t.items() if k != "tree"}) for t in found[1:]]
        return model


def _vector(features: Sequence[str]) -> Column:
    """Features as an array of doubles; null becomes NaN."""
    return F.array(*[F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(float("nan"))) for f in features])


def _mixed(x: np.ndarray, turn: int) -> np.ndarray:
    """Evenly spread numbers in [0, 1) from 64-bit values and a turn."""
    x = x.view(np.uint64) + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2**53


def quantile_cuts(rows: DataFrame, features: Sequence[str], bins: int, accuracy: int = 10_000) -> list[np.ndarray]:
    """At most bins - 1 ascending cuts per feature, from one pass of quantile sketches."""
    shares = F.array(*[F.lit((i + 1) / bins) for i in range(bins - 1)])
    values = [F.col(f"`{f}`").cast("double") for f in features]
    found = rows.agg(*[F.percentile_approx(F.when(~F.isnan(v), v), shares, accuracy).alias(f"q{i}") for i, v in enumerate(values)]).first()
    highest = rows.agg(*[F.max(F.when(~F.isnan(v), v)).alias(f"m{i}") for i, v in enumerate(values)]).first()
    # nothing lies beyond the highest value, so it is no cut
    return [np.unique([x for x in found[f"q{i}"] or [] if x < highest[f"m{i}"]]) for i in range(len(features))]


_STORED = "bins binary, y double, held boolean, draw bigint, margin double"


def _binned(rows: DataFrame, features: Sequence[str], cuts: list[np.ndarray], y: Column, held: Column, start: float) -> DataFrame:
    width = len(features)

    @F.arrow_udf("binary")
    def placed(x: pa.Array) -> pa.Array:
        matrix = np.nan_to_num(x.flatten().to_numpy(zero_copy_only=False).reshape(-1, width), nan=-np.inf)
        found = np.stack([np.searchsorted(c, matrix[:, i], "left") for i, c in enumerate(cuts)], axis=1).astype(np.uint8)
        return pa.array([r.tobytes() for r in found], pa.binary())

    vector = _vector(features)
    return rows.select(placed(vector).alias("bins"), y.alias("y"), held.alias("held"), F.xxhash64(vector, y).alias("draw"), F.lit(start).alias("margin"))


def _columns(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, ...]:
    bins = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, width)
    return bins, *(batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5))


def _sums(trees: list[Tree], growing: Tree, slots: np.ndarray, width: int, bins: int, turn: int, share: float):
    """Task function: per slot the sums of gradients and the counts of every (feature, bin), and slot -1: held errors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = width * bins
        total, count, error, checked = np.zeros((slots.max() + 1) * size), np.zeros((slots.max() + 1) * size), 0.0, 0
        offsets = np.arange(width) * bins
        for batch in batches:
            columns, y, held, draw, margin = _columns(batch, width)
            held, margin = held.astype(bool), margin.copy()
            for tree in trees:
                margin += tree.weight[tree.nodes(columns, tree.cut)]
            error, checked = error + float(((margin - y)[held] ** 2).sum()), checked + int(held.sum())
            used = np.flatnonzero(~held & (_mixed(draw, turn) < share))
            slot = slots[growing.nodes(columns[used], growing.cut)]
            used, slot = used[slot >= 0], slot[slot >= 0]
            place = (slot[:, None] * size + offsets + columns[used]).ravel()
            total += np.bincount(place, np.repeat((margin - y)[used], width), len(total))
            count += np.bincount(place, minlength=len(count))
        both = np.concatenate([total.reshape(-1, size), count.reshape(-1, size)], axis=1)
        flat = pa.array(np.concatenate([[error, float(checked)], both.ravel()]))
        ends = np.concatenate([[0, 2], 2 + 2 * size * np.arange(1, len(both) + 1)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(both)), pa.int32()), pa.ListArray.from_arrays(pa.array(ends), flat)], ["slot", "sums"])

    return run


def _pass(table: DataFrame, tasks: int, trees: list[Tree], growing: Tree, slots: np.ndarray, width: int, bins: int, *held) -> dict[int, np.ndarray]:
    made = table.mapInArrow(_sums(trees, growing, slots, width, bins, *held), "slot int, sums array<double>")
    if 16 * tasks * (slots.max() + 1) * width * bins > DRIVER_BYTES:
        made = made.groupBy("slot").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))  # a row per node
    found: dict[int, np.ndarray] = {}
    for r in made.collect():
        found[r["slot"]] = found.get(r["slot"], 0) + np.array(r["sums"])
    return found


def _shrunk(g: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0)


def best_split(total: np.ndarray, count: np.ndarray, allowed: np.ndarray, alpha: float, lam: float, least: float) -> tuple[float, int, int, float, float]:
    """(gain, feature, cut, left gradient, left count) of the best split of (feature, bin) sums; feature -1 if none gains."""
    left, n_left = total.cumsum(1)[:, :-1], count.cumsum(1)[:, :-1]
    g, n = total[0].sum(), count[0].sum()

    def score(g, n):
        return _shrunk(g, alpha) ** 2 / (n + lam)

    gains = score(left, n_left) + score(g - left, n - n_left) - score(g, n)
    gains[(n_left < least) | (n - n_left < least)] = -np.inf
    gains[~allowed] = -np.inf
    at = int(gains.argmax()) if gains.size else 0
    if not gains.size or gains.flat[at] <= 1e-12:
        return 0.0, -1, 0, 0.0, 0.0
    f, b = divmod(at, gains.shape[1])
    return float(gains[f, b]), f, b, float(left[f, b]), float(n_left[f, b])


def fit(
    rows: DataFrame,
    features: Sequence[str],
    y: str,
    validation: Column | None = None,
    trees: int = BOOSTING["trees"],
    depth: int = BOOSTING["depth"],
    rate: float = BOOSTING["rate"],
    row_share: float = BOOSTING["row_share"],
    column_share: float = BOOSTING["column_share"],
    least: float = BOOSTING["least"],
    alpha: float = BOOSTING["alpha"],
    lam: float = BOOSTING["lambda"],
    bins: int = BOOSTING["bins"],
    patience: int = BOOSTING["patience"],
    seed: int = BOOSTING["seed"],
) -> BoostedTrees:
    """Fits on the rows with a target. Rows where `validation` holds are not learnt from: boosting stops `patience` trees after
    the one with the least error on them, and later trees are dropped."""
    features, target = list(features), F.col(f"`{y}`").cast("double")
    known = rows.where(target.isNotNull())
    held = F.coalesce(validation, F.lit(False)) if validation is not None else F.lit(False)
    seen = known.agg(F.avg(F.when(~held, target)).alias("start"), F.count("*").alias("rows")).first()
    start, width = seen["start"] or 0.0, len(features)
    model = BoostedTrees(features, start)
    tasks = max(1, -(-seen["rows"] * (width + 40) // TASK_BYTES))
    cuts = quantile_cuts(known.where(~held), features, bins)
    bins = max(max((len(c) for c in cuts), default=0) + 1, 2)
    table = scratch_table(_binned(known, features, cuts, target, held, start).repartition(tasks), "boosting-rows")
    picks, recent, errors = np.random.default_rng(seed), [], []
    for turn in range(trees):
        allowed = np.zeros(width, bool)
        allowed[picks.choice(width, max(1, round(column_share * width)), replace=False)] = True
        tree, known_sums, level = Tree.empty(depth), {}, [0]
        for height in range(depth):
            # of two sisters the one with fewer rows is summed
            asked = [n for n in level if n == 0 or known_sums[n][2]]
            slots = np.full(len(tree.feature), -1)
            slots[asked] = np.arange(len(asked))
            found = _pass(table, tasks, recent, tree, slots, width, bins, turn, row_share)
            if height == 0 and validation is not None and found[-1][1]:
                errors.append(found[-1][0] / found[-1][1])
            for n in level:
                if n in asked:
                    g, c = found[int(slots[n])].reshape(2, width, bins)
                    known_sums[n] = (g, c, True)
            for n in level:
                if n not in asked:
                    parent, sister = known_sums[(n - 1) // 2], known_sums[n + 1 if n % 2 else n - 1]
                    known_sums[n] = (parent[0] - sister[0], parent[1] - sister[1], False)
            below = []
            for n in level:
                g, c, _ = known_sums[n]
                if height == 0:
                    tree.weight[0] = -rate * _shrunk(g[0].sum(), alpha) / (c[0].sum() + lam)
                gain, f, b, left, n_left = best_split(g, c, allowed, alpha, lam, least)
                if f < 0:
                    continue
                tree.feature[n], tree.cut[n], tree.value[n], tree.gain[n] = f, b, cuts[f][b], gain
                whole, n_whole = g[0].sum(), c[0].sum()
                for child, g_own, n_own in ((2 * n + 1, left, n_left), (2 * n + 2, whole - left, n_whole - n_left)):
                    tree.weight[child] = -rate * _shrunk(g_own, alpha) / (n_own + lam)
                    fewer = n_left <= n_whole - n_left
                    known_sums[child] = (None, None, fewer == (child % 2 == 1))
                    below.append(child)
            level = below
            if not level:
                break
        best = int(np.argmin(errors)) if errors else 0
        if errors and len(errors) - 1 - best >= patience:
            break
        if tree.feature[0] < 0 and tree.weight[0] == 0:
            break
        model.trees.append(tree)
        recent.append(tree)
        if len(recent) == STORED_TREES and turn + 1 < trees:
            table = scratch_table(table.mapInArrow(_moved(recent, width), _STORED), "boosting-rows")
            recent = []
    if errors:
        model.trees = model.trees[: int(np.argmin(errors))]  # errors[i] is that of the first i trees
    return model


def _moved(trees: list[Tree], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, _, _, _, margin = _columns(batch, width)
            margin = margin.copy()
            for tree in trees:
                margin += tree.weight[tree.nodes(columns, tree.cut)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(margin)], batch.schema.names)

    return run
