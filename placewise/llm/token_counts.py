"""Token counts of the sections of whole documents: one encoding per document, spans mapped to sections.

A document is encoded once, as it would be for training. The characters each token covers follow from the vocabulary's
token lengths in bytes; a sorted lookup joins these spans to the section intervals of the same document. A token that
crosses a boundary goes where `rule` says:

* `first`: the section of its first character that lies in any section
* `most`: the section with most of its characters; of equals the earlier one
* `split`: shared, in proportion to the characters in each section

Tokens that touch no section are counted in `n_outside`, so the counts of a document always add up to its tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from placewise.llm import vocabularies
from placewise.llm.storage import in_batches

RULES = ("first", "most", "split")
SECTIONS = "array<struct<name:string,first:int,last:int>>"
COUNTED = "doc_id bigint, n_tokens bigint, n_outside double, section string, first int, last int, n_section double, n_crossing bigint"


def spans(ids: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, data: np.ndarray, bounds: np.ndarray):
    """First and last character (exclusive, within its text) and text of every token. A token inside one character covers it."""
    text = np.repeat(np.arange(len(lengths)), lengths)
    ends = np.cumsum(sizes[ids])
    starts = ends - sizes[ids]
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])  # characters that begin before each byte
    own = lead[bounds[:-1]][text]
    return lead[starts + 1] - 1 - own, lead[ends] - own, text


def attributed(first: np.ndarray, last: np.ndarray, begins: np.ndarray, stops: np.ndarray, rule: str):
    """Of one document: tokens and crossing tokens of each section, and tokens in none. Sections are disjoint and in order."""
    counts, crossing = np.zeros(len(begins)), np.zeros(len(begins), np.int64)
    if not len(begins):
        return counts, crossing, float(len(first))
    low = np.searchsorted(stops, first, "right")  # first section that ends after the token begins
    high = np.searchsorted(begins, last, "left")  # sections that begin before the token ends
    touched = np.maximum(high - low, 0)
    outside = float((touched == 0).sum())
    one = touched == 1
    covered = np.where(one, np.minimum(last, stops[np.minimum(low, len(stops) - 1)]) - np.maximum(first, begins[np.minimum(low, len(begins) - 1)]), 0)
    whole = one & ((covered == last - first) | (rule != "split"))
    np.add.at(counts, low[whole], 1)
    np.add.at(crossing, low[one & (covered < last - first)], 1)
    for i in np.flatnonzero((touched > 0) & ~whole):  # tokens on a boundary
        own = np.arange(low[i], high[i])
        held = np.minimum(last[i], stops[own]) - np.maximum(first[i], begins[own])
        if rule == "first":
            counts[own[0]] += 1
        elif rule == "most":
            counts[own[held.argmax()]] += 1
        else:
            share = held / (last[i] - first[i])
            counts[own] += share
            outside += 1 - share.sum()
        if len(own) > 1:
            crossing[own] += 1
    return counts, crossing, outside


def _count(path: str, rule: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = vocabularies.memory("tokenizers", path).encode.lengths()
        for batch in batches:
            names, sections = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for at, lengths, ids, data, bounds in vocabularies.encoded("tokenizers", path, batch.column(1)):
                first, last, _ = spans(ids, lengths, sizes, data, bounds)
                ends = np.cumsum(lengths)
                rows: list[tuple] = []
                for i, (a, b) in enumerate(zip((ends - lengths).tolist(), ends.tolist())):
                    own = [s for s in sections[at + i] or [] if s and s["first"] is not None and s["last"] is not None and s["last"] > s["first"]]
                    own.sort(key=lambda s: (s["first"], s["last"], s["name"] or ""))
                    begins = np.array([s["first"] for s in own], np.int64)
                    stops = np.array([s["last"] for s in own], np.int64)
                    if len(own) and (begins[1:] < stops[:-1]).any():
                        raise ValueError(f"sections of document {names[at + i]} overlap")
                    counts, crossing, outside = attributed(first[a:b], last[a:b], begins, stops, rule)
                    head = (names[at + i], b - a, outside)
                    rows += [(*head, s["name"], s["first"], s["last"], c, x) for s, c, x in zip(own, counts.tolist(), crossing.tolist())] or [(*head, None, None, None, 0.0, 0)]
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in COUNTED.split(", ")])

    return count


def count_tokens(docs: DataFrame, sections: Column, vocabulary: str, rule: str = "most") -> DataFrame:
    """One row per document and section with its tokens; no shuffle.

    `sections` is an expression over `docs` giving disjoint character intervals (name, first, last exclusive); empty or
    null ones are left out. A document without sections, an empty and a null text give one row with a null section.
    Repeated rows are counted row by row; a null doc_id stays null; other columns are not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), sections.cast(SECTIONS).alias("sections"))
    return in_batches(rows, _count(vocabulary, rule), COUNTED)


def with_sections(docs: DataFrame, table: DataFrame, name: str = "sections") -> DataFrame:
    """Documents with the intervals of a table (doc_id, name, first, last) as one array for `count_tokens`; null-safe on doc_id."""
    gathered = table.groupBy(F.col("doc_id").alias("_section_doc")).agg(F.collect_list(F.struct("name", "first", "last")).alias(name))
    return docs.join(gathered, F.col("doc_id").eqNullSafe(F.col("_section_doc")), "left").drop("_section_doc")


def heading_body_close(text: Column) -> Column:
    """First line, last line (of two or more) and what lies between, as sections; line breaks belong to the body."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    size, lines = F.length(text), F.size(F.split(text, "\n"))
    head = F.when(lines > 1, F.instr(text, "\n") - 1).otherwise(size)
    close = F.when(lines > 1, size - F.length(F.substring_index(text, "\n", -1))).otherwise(size)
    part = lambda name, a, b: F.struct(F.lit(name).alias("name"), a.cast("int").alias("first"), b.cast("int").alias("last"))
    return F.array(part("heading", F.lit(0), head), part("body", head, close), part("close", close, size))


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of heading, body and closing line of all documents."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return count_tokens(docs, heading_body_close(F.col("text")), vocabularies.default_path("byte_bpe_50k.json"))
