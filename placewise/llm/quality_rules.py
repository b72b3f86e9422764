"""Quality rules as a short-circuit cascade: the rule that rejects most per second runs first, later rules see survivors.

Each rule's cost (seconds a byte) and the texts it rejects are measured on a sample; the order is greedy, by the share of
still standing sample texts a rule rejects per cost. The verdict is the same in every order, only the work differs, so
the sample may be small and need not be drawn evenly. Rules run on Arrow batches inside the scan; nothing is shuffled.

Words are runs without ASCII white space. Null and empty texts have no words and fail `few_words`.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from placewise.llm import arrays
from placewise.llm.storage import in_batches

#: Texts on which cost and selectivity are measured.
SAMPLE = 1000

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER |= _UPPER


class Measures:
    """What rules ask of a batch of texts, each computed once and only if asked."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds, self.count = data, bounds, len(bounds) - 1

    def _per_text(self, flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.bounds[1:]] - sums[self.bounds[:-1]]

    @cached_property
    def solid(self) -> np.ndarray:
        return ~_WHITE[self.data]

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return arrays.runs(self.solid, self.bounds)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.bincount(self.words[2], minlength=self.count)

    @cached_property
    def word_chars(self) -> np.ndarray:
        return self._per_text(self.solid & ((self.data & 0xC0) != 0x80))

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self._per_text(_SYMBOL[self.data])

    @cached_property
    def n_upper(self) -> np.ndarray:
        return self._per_text(_UPPER[self.data])

    @cached_property
    def n_letters(self) -> np.ndarray:
        return self._per_text(_LETTER[self.data])

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines with a word, and those equal to an earlier line, of each text."""
        starts, ends, text = arrays.runs(self.data != 10, self.bounds)
        sums = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(self.solid, out=sums[1:])
        full = sums[ends] > sums[starts]
        starts, ends, text = starts[full], ends[full], text[full]
        earlier = arrays.repeated(text, arrays.hashes(self.data, starts, ends))[1]
        return np.bincount(text, minlength=self.count), np.bincount(text[earlier], minlength=self.count)

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        starts, ends, text = self.words
        window, owner, at = arrays.windows(arrays.hashes(self.data, starts, ends), self.n_words, 3)
        many = at[arrays.repeated(owner, window)[0]]
        covered = np.zeros(len(starts), bool)
        for i in range(3):
            covered[many + i] = True
        return np.bincount(text[covered], minlength=self.count)


#: name -> texts that the rule rejects
Rules = dict[str, Callable[[Measures], np.ndarray]]
BASE: Rules = {
    "few_words": lambda m: m.n_words < 50,
    "repeated_words": lambda m: 100 * m.n_repeat_words > 50 * m.n_words,
}
RULES: Rules = BASE | {
    "many_symbols": lambda m: 10 * m.n_symbols > m.n_words,
    "capitals": lambda m: 2 * m.n_upper > m.n_letters,
    "repeated_lines": lambda m: 10 * m.lines[1] > 4 * m.lines[0],
    "word_size": lambda m: (m.word_chars < 2 * m.n_words) | (m.word_chars > 25 * m.n_words),
}


def _measured(rules: Rules):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = arrays.strings(batch.column(0))
            for at, rows in arrays.pieces(texts):
                data, bounds = arrays.laid_out(texts.slice(at, rows))
                masks, seconds = [], []
                for rule in rules.values():
                    begun = time.perf_counter()
                    masks.append(rule(Measures(data, bounds)))
                    seconds.append(time.perf_counter() - begun)
                found = np.stack(masks, 1)
                columns = [pa.array(found.tolist(), pa.list_(pa.bool_())), pa.array([[s / rows for s in seconds]] * rows, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["rejected", "seconds"])

    return measure


def ordered(docs: DataFrame, rules: Rules = RULES, sample: int = SAMPLE, text: str = "text") -> list[str]:
    """Names of the rules, best first. Of an empty sample the order stays as given.

    The share that is drawn follows from the number of rows, so the parts together send about twice the sample, however many.
    """
    share = min(1.0, 2 * sample / max(docs.count(), 1))
    seen = docs.select(F.col(text).cast("string").alias("text")).sample(share, seed=7).limit(sample)
    rows = in_batches(seen, _measured(rules), "rejected array<boolean>, seconds array<double>").collect()
    names = list(rules)
    if not rows:
        return names
    rejected, cost = np.array([r.rejected for r in rows]), np.array([r.seconds for r in rows]).sum(0) + 1e-9
    standing, left, order = np.ones(len(rows), bool), list(range(len(names))), []
    while left:
        gain = [(rejected[standing, i].sum() / cost[i], -cost[i]) for i in left]
        best = left[max(range(len(left)), key=lambda k: gain[k])]
        order.append(names[best])
        left.remove(best)
        standing &= ~rejected[:, best]
    return order


def cascade(data: np.ndarray, bounds: np.ndarray, rules: list[Callable[[Measures], np.ndarray]], measures: Measures | None = None) -> np.ndarray:
    """Number of the first rule that rejects each text, -1 if none does. Texts already rejected are left out of later work
    as soon as they are half of what is laid out. What `measures` of all texts already hold is not counted again."""
    out = np.full(len(bounds) - 1, -1)
    rows = np.arange(len(out))
    measures = measures or Measures(data, bounds)
    for number, rule in enumerate(rules):
        standing = out[rows] < 0
        if not standing.any():
            break
        if 2 * int((bounds[rows + 1] - bounds[rows])[standing].sum()) < len(measures.data):
            rows = rows[standing]
            sizes = bounds[rows + 1] - bounds[rows]
            measures = Measures(arrays.gathered(data, bounds[rows], sizes), np.concatenate([[0], np.cumsum(sizes)]))
            standing = np.ones(len(rows), bool)
        out[rows[rule(measures) & standing]] = number
    return out


def keep(docs: DataFrame, rules: Rules = RULES, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The rows of `docs`, all columns unchanged, that no rule rejects."""
    steps = [rules[n] for n in ordered(docs, rules, sample, text)]
    at = docs.columns.index(text)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = arrays.strings(batch.column(at))
            masks = [cascade(*arrays.laid_out(texts.slice(a, n)), steps) < 0 for a, n in arrays.pieces(texts)]
            if masks:
                yield batch.filter(pa.array(np.concatenate(masks)))

    return in_batches(docs, each, docs.schema)


MEASURED = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean"


def judged(docs: DataFrame, rules: Rules = RULES, sample: int = SAMPLE) -> DataFrame:
    """One row per row of `docs`: the measures of the base rules for every text, and the cascade's verdict.

    Nulls, ties and repeated rows are judged row by row; columns besides doc_id and text are not read.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    steps = [rules[n] for n in ordered(rows, rules, sample)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = arrays.strings(batch.column(1))
            for at, count in arrays.pieces(texts):
                data, bounds = arrays.laid_out(texts.slice(at, count))
                m = Measures(data, bounds)
                base = np.any([rule(m) for rule in BASE.values()], axis=0)
                kept = (cascade(data, bounds, steps, m) < 0) & ~base
                whole = [m.n_words, m.word_chars, m.n_symbols, m.lines[1], m.n_repeat_words]
                columns = [batch.column(0).slice(at, count), *(pa.array(v, pa.int64()) for v in whole), pa.array(base), pa.array(kept)]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in MEASURED.split(", ")])

    return in_batches(rows, each, MEASURED)


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Measures and verdict of all documents."""
    return judged(spark.read.parquet(f"{folder}/documents.parquet"))


OP7_SQL = r"""
WITH words AS (
    SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
    SELECT doc_id, i, list_slice(w, i, i + 2) AS g FROM words, unnest(range(1, len(w) - 1)) AS u(i)
), twice AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c > 1
), covered AS (
    SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, unnest([0, 1, 2]) AS u(k) GROUP BY doc_id
), lines AS (
    SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT l) AS dup
    FROM documents, unnest(string_split(text, chr(10))) AS u(l) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id
), counted AS (
    SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words,
           CAST(coalesce(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')), 0) AS BIGINT) AS word_chars,
           CAST(coalesce(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')), 0) AS BIGINT) AS n_symbols,
           CAST(coalesce(length(regexp_replace(text, '[^A-Z]', '', 'g')), 0) AS BIGINT) AS upper_letters,
           CAST(coalesce(length(regexp_replace(text, '[^A-Za-z]', '', 'g')), 0) AS BIGINT) AS letters,
           CAST(coalesce(lines.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(lines.dup, 0) AS BIGINT) AS n_dup_lines,
           CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
    FROM words LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
), judged AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 2 * upper_letters > letters OR 10 * n_dup_lines > 4 * n_lines
            OR word_chars < 2 * n_words OR word_chars > 25 * n_words) AS kept
FROM judged
"""
