"""Text vectors in which related words are near: a truncated singular value decomposition of the weighted term matrix.

A randomised range finder needs two passes over the rows, and one more for every round of `power`: products of the rows with a
few random directions give a basis of the row space, and the products within that basis give the directions of largest spread.
Tasks add up their rows' products; what reaches the driver is one small dense matrix, whose order is the number of hashed
terms times the number of directions, whatever the number of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from placewise.functions.columns import fill_text
from placewise.session import scratch_table

TERMS, DIMENSION, OVERSAMPLE = 1 << 12, 64, 16
#: Rows of the dense matrix that travel as one row of a table.
STRIPE = 256
#: Entries multiplied at a time, whatever the rows of a batch; a single longer row is taken whole.
ENTRIES = 1 << 15


@dataclass
class SemanticModel:
    """Weighted terms, and the directions (terms x dimension) with their singular values, largest first."""

    terms: PipelineModel
    directions: np.ndarray
    values: np.ndarray


def term_weights(terms: int = TERMS) -> Pipeline:
    """Hashed term counts weighted by rarity, unit length."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol="_text", outputCol="_terms", pattern=r"[^\p{L}\p{N}]+"),
        HashingTF(inputCol="_terms", outputCol="_counts", numFeatures=terms),
        IDF(inputCol="_counts", outputCol="_weighted"),
        Normalizer(inputCol="_weighted", outputCol="_unit"),
    ])


def _sparse(vector: str) -> Column:
    """A sparse vector as (places, values)."""
    held = F.unwrap_udt(vector)
    return F.struct(held["indices"].alias("i"), held["values"].alias("v"))


def _pieces(entries: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Consecutive rows with at most ENTRIES entries, one row at least: first entry of each row, entries of each, terms, values."""
    sizes = pa.compute.list_value_length(entries.field("i")).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        before = ends[at] - sizes[at]
        stop = max(int(np.searchsorted(ends, before + ENTRIES, "right")), at + 1)
        own = entries.slice(at, stop - at).flatten()
        term, value = own[0].flatten().to_numpy(), own[1].flatten().to_numpy()
        yield ends[at:stop] - sizes[at:stop] - before, sizes[at:stop], term, value
        at = stop


def _projected(piece: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], basis: np.ndarray) -> np.ndarray:
    """Every row's products with the basis."""
    begins, sizes, term, value = piece
    made = np.zeros((len(sizes), basis.shape[1]))
    if len(term):
        made[sizes > 0] = np.add.reduceat(basis[term] * value[:, None], begins[sizes > 0])
    return made


def _summed(rows: DataFrame, basis: np.ndarray, inside: bool) -> np.ndarray:
    """A'A times the basis, or within it (`inside`), summed over all rows."""
    height = basis.shape[1] if inside else basis.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((height, basis.shape[1]))
        for batch in batches:
            for piece in _pieces(batch.column(0)):
                made = _projected(piece, basis)
                if inside:
                    total += made.T @ made
                    continue
                _, sizes, term, value = piece
                if len(term):
                    order = np.argsort(term, kind="stable")
                    own = np.repeat(np.arange(len(sizes)), sizes)[order]
                    first = np.flatnonzero(np.diff(term[order], prepend=-1))
                    total[term[order][first]] += np.add.reduceat(made[own] * value[order, None], first)
        stripes = [total[i : i + STRIPE].ravel().tolist() for i in range(0, height, STRIPE)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(stripes)), pa.int32()), pa.array(stripes, pa.list_(pa.float64()))], ["stripe", "sums"])

    made = rows.mapInArrow(run, "stripe int, sums array<double>").groupBy("stripe").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))
    found = sorted((r["stripe"], r["sums"]) for r in made.collect())  # height / STRIPE rows
    return np.concatenate([np.reshape(s, (-1, basis.shape[1])) for _, s in found]) if found else np.zeros((height, basis.shape[1]))


def fit_semantic(docs: DataFrame, text: str = "text", dimension: int = DIMENSION, terms: int = TERMS, power: int = 1, seed: int = 42) -> SemanticModel:
    """Fits on all texts; a null text has no terms, and a table without rows is an error. `power` rounds sharpen a spectrum
    that falls slowly."""
    filled = docs.select(fill_text(F.col(text)).alias("_text"))
    if not filled.take(1):
        raise ValueError("no texts to fit on")
    model = term_weights(terms).fit(filled)
    rows = scratch_table(model.transform(filled).select(_sparse("_unit").alias("a")), "term-weights")
    width = min(dimension + OVERSAMPLE, terms)
    basis = np.random.default_rng(seed).normal(size=(terms, width))
    for _ in range(1 + power):
        basis = np.linalg.qr(_summed(rows, basis, False))[0]
    squares, inner = np.linalg.eigh(_summed(rows, basis, True))
    order = np.argsort(-squares)[: min(dimension, width)]
    return SemanticModel(model, basis @ inner[:, order], np.sqrt(np.maximum(squares[order], 0)))


def semantic_embed(docs: DataFrame, model: SemanticModel, text: str = "text") -> DataFrame:
    """Adds `embedding`, an array<float> of unit length; zeros for a text without known terms."""
    directions = model.directions

    @F.arrow_udf("array<float>")
    def embedded(a: pa.Array) -> pa.Array:
        made = np.concatenate([np.zeros((0, directions.shape[1])), *(_projected(p, directions) for p in _pieces(a))])
        norms = np.linalg.norm(made, axis=1, keepdims=True)
        unit = np.divide(made, norms, out=np.zeros_like(made), where=norms > 1e-12)
        ends = np.arange(0, unit.size + 1, unit.shape[1], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(unit.ravel().astype(np.float32)))

    out = model.terms.transform(docs.withColumn("_text", fill_text(F.col(text))))
    return out.select(*docs.columns, embedded(_sparse("_unit")).alias("embedding"))
