"""Token alignment against both libraries and plain sets of offsets."""

import collections
import hashlib
import random
import tracemalloc
import types

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from placewise.llm import alignment, arrays, vocabularies
from placewise.llm.alignment import op12_token_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, a int, b int, n bigint, best string, block bigint"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plain_groups(libraries, text):
    """[(ids of A, ids of B)] of every group, by the libraries alone."""
    a, b = libraries
    if not text:
        return []
    raw = (" " + text).encode()
    value = {c: i for i, c in enumerate(vocabularies._visible())}
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(value[c] for c in a.id_to_token(i)) for i in ids_a]
    pieces = [b.id_to_piece(i) for i in ids_b]
    bytes_b = [bytes.fromhex(p[3:5]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in pieces]
    if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
        return []
    ends_a, ends_b = np.cumsum([len(t) for t in bytes_a]).tolist(), np.cumsum([len(t) for t in bytes_b]).tolist()
    groups, i, j = [], 0, 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        x, y = ends_a.index(cut, i) + 1, ends_b.index(cut, j) + 1
        groups.append((ids_a[i:x], ids_b[j:y]))
        i, j = x, y
    return groups


def expected(libraries, rows):
    every = [(i, plain_groups(libraries, t)) for i, t in rows]
    docs, best = collections.Counter(), collections.Counter()
    for _, groups in every:
        docs.update({(x, y) for a, b in groups for x in a for y in b})
    for (x, _), n in docs.items():
        best[x] = max(best[x], n)
    out = []
    for i, groups in every:
        links = [(x, y) for a, b in groups for x in a for y in b]
        written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        digest = hashlib.sha256(written.encode()).hexdigest() if groups else ""
        out.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(docs[p] == best[p[0]] for p in links), sum(docs[p] for p in links), digest))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def test_query(spark, small, libraries):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    rows = op12_token_alignment(spark, small)
    assert rows.columns == COLUMNS
    assert order(tuple(r) for r in rows.collect()) == order(expected(libraries, docs))


def test_odd_texts(spark, libraries):
    rng = random.Random(2)
    signs = [" ", "  ", "\n", "\t", "a", "the", "of", "é", "▁", "\x00", "<s>", "<|endoftext|>", "<0x41>", "\U0001f600", "　", "ﬁ", "x" * 30, ".\n", "'s", "​", "\r", "12345"]
    texts = [None, "", " ", "  ", "\n", "▁", "a▁", "word " * 3000, "x" * 20000, "<|endoftext|>", "é" * 999]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(1, 40))) for _ in range(200)]
    rows = [(None if i % 50 == 49 else i // 2, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, 1, 2, 3, "x", 4) for r in rows], SCHEMA).repartition(5)
    assert order(tuple(r) for r in alignment.aligned_documents(docs, A, B).collect()) == order(expected(libraries, rows))
    assert alignment.aligned_documents(docs.where("text IS NULL"), A, B).collect()[0].n_a == 0
    assert alignment.aligned_documents(docs.limit(0), A, B).collect() == []


@pytest.mark.parametrize("steps", [1, 2, 5, 256])
def test_pieces_of_the_merge_path(steps):
    rng = np.random.default_rng(steps)
    for _ in range(60):
        last = int(rng.integers(1, 200))
        a, b = (np.unique(np.append(rng.integers(1, last + 1, rng.integers(0, 80)), last)) for _ in range(2))
        i, j = alignment._diagonals(a, b, steps)
        every = sorted([(v, 0) for v in a] + [(v, 1) for v in b])
        assert [(x, y) for x, y in zip(i, j)] == [(sum(s == 0 for _, s in every[:d]), sum(s for _, s in every[:d])) for d in range(0, len(every), steps)]
        begin_a, end_a, begin_b, end_b = alignment.merged(a, b, steps)
        cuts = np.intersect1d(a, b)
        assert (a[end_a - 1] == cuts).all() and (b[end_b - 1] == cuts).all() and len(cuts) == len(end_a)
        assert (begin_a == np.append(0, end_a[:-1])).all() and (begin_b == np.append(0, end_b[:-1])).all()


def test_links_in_bounded_parts(monkeypatch):
    rng = np.random.default_rng(0)
    sizes_a, sizes_b = rng.integers(1, 30, 40), rng.integers(1, 30, 40)
    ids_a, ids_b = rng.integers(0, 9, sizes_a.sum()), rng.integers(0, 9, sizes_b.sum())
    ends_a, ends_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
    docs = np.sort(rng.integers(0, 6, 40))
    counts = collections.Counter()
    for g in range(40):
        for x in ids_a[ends_a[g] - sizes_a[g] : ends_a[g]]:
            for y in ids_b[ends_b[g] - sizes_b[g] : ends_b[g]]:
                counts[int(docs[g]), int(x) << 32 | int(y)] += 1
    for spelled in (1, 10, 1 << 20):
        monkeypatch.setattr(alignment, "SPELLED", spelled)
        found = alignment.linked(ids_a, ids_b, (ends_a - sizes_a, ends_a, ends_b - sizes_b, ends_b), docs)
        assert dict(zip(zip(found[0].tolist(), found[1].tolist()), found[2].tolist())) == counts


def test_words_of_pieces_equal_the_library(libraries):
    texts = ["a b", "  a  b ", "a\n b\t c", " x ", "é  ü", "   ", "a" * 50 + " \n \n"]
    memory = vocabularies.memory("pieces", B)
    ids, counts = memory.ids(*arrays.laid_out(arrays.strings(pa.array([" " + t for t in texts]))))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [libraries[1].encode(t) for t in texts]


def test_blocks_are_packed_and_made_in_little_memory(monkeypatch):
    monkeypatch.setattr(alignment, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    rng = random.Random(3)
    known = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choice(known) for _ in range(400)) for _ in range(1000)]
    size = sum(map(len, texts))
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    align = alignment._align(A, B)
    list(align(iter([batch.slice(0, 9)])))  # tables that a worker makes once
    tracemalloc.start()
    made = list(align(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(len(m.column(1)[0]) for m in made) == len(texts)
    assert sum(m.nbytes for m in made) < size  # as arrays of numbers, some 3 bytes for each of the text
    assert most < 30 * size


def test_few_tasks_write_the_documents(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id bigint, text string").repartition(40)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    most = 2 * spark.sparkContext.defaultParallelism
    try:
        spark.conf.set("spark.sql.shuffle.partitions", most + 8)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        made = alignment.aligned_documents(docs, A, B)
        assert made.rdd.getNumPartitions() <= most and made.count() == 40
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
