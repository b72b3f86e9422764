"""Token counts per section and shards, against plain loops on whole tables."""

import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from placewise.llm import sharding, token_counts
from placewise.llm.queries import QUERIES

LIBRARY = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, node int, part int, first int"


def token_spans(library, text):
    """(first character, last character + 1) of every token; the library's tokens spell one sign per byte."""
    char_of = [i for i, c in enumerate(text) for _ in c.encode()]
    spans, at = [], 0
    for token in library.encode(text, add_special_tokens=False).tokens:
        size = len(token.encode()) if token == "<|endoftext|>" else len(token)
        spans.append((char_of[at], char_of[at + size - 1] + 1))
        at += size
    assert at == len(char_of)
    return spans


def plain_sections(text):
    head, close = (text.index("\n"), text.rindex("\n") + 1) if "\n" in text else (len(text), len(text))
    return [("heading", 0, head), ("body", head, close), ("close", close, len(text))]


def plain_counts(spans, sections, rule):
    counts = {s: 0.0 for s in sections if s[2] > s[1]}
    for a, b in spans:
        held = {s: min(b, s[2]) - max(a, s[1]) for s in counts if min(b, s[2]) > max(a, s[1])}
        if held and rule == "first":
            counts[min(held, key=lambda s: s[1])] += 1
        elif held and rule == "most":
            counts[max(held, key=lambda s: (held[s], -s[1]))] += 1
        else:
            for s, n in held.items():
                counts[s] += n / (b - a)
    return counts


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sections_hold_the_tokens_of_the_library(spark, small, rule):
    library = Tokenizer.from_file(LIBRARY)
    odd = ["é\n\U0001f600\U0001f600\né", "a b\n\nc d", "<|endoftext|>\nx<|endoftext|>\n ", "\n", "no line", "tail \n\n\n  tail", "ﬁ　\nﬁ"]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()] + [(-i - 1, t) for i, t in enumerate(odd)]
    docs = spark.createDataFrame([(*r, "en", None, 0, 1, 2, 3) for r in rows], SCHEMA).repartition(6)
    found = {}
    for r in token_counts.count_tokens(docs, token_counts.heading_body_close(F.col("text")), LIBRARY, rule).collect():
        found.setdefault(r.doc_id, {})[r.section, r.first, r.last] = r.n_section
    for i, text in rows:
        expected = plain_counts(token_spans(library, text), plain_sections(text), rule)
        assert found[i].keys() == expected.keys() and all(abs(found[i][s] - n) < 1e-6 for s, n in expected.items()), i


def test_counts_of_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert token_counts.count_tokens(docs, token_counts.heading_body_close(F.col("text")), LIBRARY).count() == 0


def plain_split(rows, shards):
    """{row number: shard} by splitting one node at a time."""
    out, open_nodes = {}, [(0, shards, list(range(len(rows))))]
    while open_nodes:
        node, leaves, own = open_nodes.pop()
        if leaves == 1 or not own:
            out |= {i: node for i in own}
            continue
        widest = max(sharding.DIMENSIONS, key=lambda d: max(rows[i][d] for i in own) - min(rows[i][d] for i in own))
        goal, upto, sides = sum(rows[i].size for i in own) * (leaves // 2) / leaves, 0, ([], [])
        for i in sorted(own, key=lambda i: (rows[i][widest], rows[i].tie, rows[i].doc_id)):
            upto += rows[i].size
            sides[upto - rows[i].size / 2 > goal].append(i)
        open_nodes += [(node, leaves // 2, sides[0]), (node + leaves // 2, leaves - leaves // 2, sides[1])]
    return out


def test_shards_equal_a_recursive_split(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = sharding.described(docs).collect()
    expected = {rows[i].doc_id: s for i, s in plain_split(rows, 40).items()}
    found = QUERIES["op8_sharding"](spark, small).collect()
    assert {r.doc_id: r.shard for r in found} == expected
    assert all((r.size, r.text_crc32, r.law, r.grown_shard) == (len(texts[r.doc_id].encode()) + 16, zlib.crc32(texts[r.doc_id].encode()), "bytes", None) for r in found)
    slots = {}
    for r in sorted(found, key=lambda r: r.doc_id):
        assert r.slot == slots.get(r.shard, 0)
        slots[r.shard] = r.slot + 1


def test_shards_of_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, None, None, 0, 1, 2, 3) for i, t in enumerate([None, "", "x" * 200000, *["same"] * 40])], SCHEMA)
    rows = sharding.described(docs).collect()
    expected = {rows[i].doc_id: s for i, s in plain_split(rows, 5).items()}
    assert {r.doc_id: r.shard for r in sharding.assigned(docs, 5).collect()} == expected


def test_shards_store_two_tables_whatever_their_number(spark, small, monkeypatch):
    names = []
    monkeypatch.setattr(sharding, "stored", lambda df, name, store=sharding.stored: names.append(name) or store(df, name))
    sharding.assigned(spark.read.parquet(f"{small}/documents.parquet"), 40)
    assert len(names) <= 2  # every table is a file in every task


@pytest.mark.parametrize("ranges", [16, 1 << 14])
def test_shards_split_between_equal_rows(spark, monkeypatch, ranges):
    monkeypatch.setattr(sharding, "RANGES", ranges)
    docs = spark.createDataFrame([*[(7, "copy", "en", "a", 0, 1, 2, 3)] * 50, *[(None, None, None, None, 0, 1, 2, 3)] * 9, *[(i, "x" * i, "de", "b", 0, 1, 2, 3) for i in range(30)]], SCHEMA)
    rows = sharding.described(docs).collect()
    expected = Counter((rows[i].doc_id, s) for i, s in plain_split(rows, 7).items())
    found = sharding.assigned(docs, 7).collect()
    assert Counter((r.doc_id, r.shard) for r in found) == expected
    assert all([r.slot for r in sorted(found, key=lambda r: r.slot) if r.shard == s] == list(range(n)) for s, n in Counter(r.shard for r in found).items())


def test_slots_over_many_partitions_are_stored_in_few_files(spark, small, monkeypatch):
    kept = {"spark.sql.shuffle.partitions": "90", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in kept}
    tables = {}
    monkeypatch.setattr(sharding, "stored", lambda df, name, store=sharding.stored: tables.setdefault(name, store(df, name)))
    try:
        for k, v in kept.items():
            spark.conf.set(k, v)
        found = sharding.assigned(spark.read.parquet(f"{small}/documents.parquet"), 3).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert tables["running"].select("part").distinct().count() > 60
    assert len(tables["running"].inputFiles()) <= 2 * spark.sparkContext.defaultParallelism
    for shard in range(3):
        own = sorted((r for r in found if r.shard == shard), key=lambda r: r.doc_id)
        assert [r.slot for r in own] == list(range(len(own)))
