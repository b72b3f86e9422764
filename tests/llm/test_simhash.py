"""SimHash fingerprints and their components against plain recomputation."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from placewise.llm import simhash
from placewise.llm.simhash import op11_simhash

SCHEMA = "doc_id bigint, text string, node bigint, bucket int, component_id string, least int"


def plain_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(marks, radius=4):
    """Root of each mark, from all pairs."""
    root = {m: m for m in marks}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    values = np.array(sorted(root), np.uint64)
    for i, m in enumerate(values):
        near = np.bitwise_count(values[i + 1 :] ^ m) <= radius
        for other in values[i + 1 :][near]:
            a, b = sorted((find(int(m)), find(int(other))))
            root[b] = a
    return {m: find(m) for m in root}


def expected(rows):
    """(doc_id, fingerprint, component) of all rows (doc_id, text)."""
    marks = [plain_fingerprint(t) for _, t in rows]
    roots, least = plain_components(set(marks)), {}
    for (i, _), m in zip(rows, marks):
        known = least.get(roots[m])
        least[roots[m]] = i if known is None else known if i is None else min(i, known)
    return [(i, f"{m:016x}", least[roots[m]]) for (i, _), m in zip(rows, marks)]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None))


def test_query(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    rows = op11_simhash(spark, small)
    assert rows.columns == ["doc_id", "fingerprint", "component_id"]
    assert order(tuple(r) for r in rows.collect()) == order(expected(docs))


@pytest.mark.parametrize("block", [8192, 7])
def test_components_in_cells(spark, block):
    """Balls of near texts, a chain, copies and odd rows; small blocks give cells of two blocks."""
    rng = random.Random(4)
    texts = [None, "", " \n\t", "one", "ONE two\nthree", "É é \U0001f600 Éa", "w " * 50000, "x" * 100000]
    for _ in range(8):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(150)]
        for _ in range(12):
            words[rng.randrange(150)] = f"n{rng.random()}"
            texts.append(" ".join(words))
    texts += texts[-3:] * 30
    rows = [(None if i % 40 == 39 else i // 2, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, 1, 2, "c", 3) for r in rows], SCHEMA)
    assert order(tuple(r) for r in simhash.components_of(docs, block=block).collect()) == order(expected(rows))
    assert simhash.components_of(docs.limit(0)).collect() == []
    alone = simhash.components_of(docs.where("doc_id IS NULL AND text IS NOT NULL").limit(1)).first()
    assert alone.component_id is None


def test_sections_change_nothing(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["ab", "C", " ", "\n", "\x0b\x0c", "é", "\x85", "　"]) for _ in range(rng.randint(0, 200))) for _ in range(200)]
    for size, held in ((5, 7), (64, 50), (1 << 20, 1 << 15)):
        monkeypatch.setattr(simhash, "SECTION", size)
        monkeypatch.setattr(simhash, "HELD", held)
        assert simhash.fingerprints_of(pa.array(texts)).tolist() == [plain_fingerprint(t) for t in texts]


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7, 10])
def test_bit_slices_count_distances(monkeypatch, radius):
    monkeypatch.setattr(simhash, "WORDS", 100)
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 5, dtype=np.uint64)
    flips = np.zeros(400, np.uint64)
    for _ in range(6):
        flips ^= np.where(rng.random(400) < 0.7, np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64), np.uint64(0))
    nodes = np.unique(base[rng.integers(0, 5, 400)] ^ flips)
    n = len(nodes)
    label = simhash.compare(nodes, np.arange(1, n + 1), np.full(n, n), radius)
    roots = plain_components(set(nodes.tolist()), radius)
    groups = {}
    for m, x in zip(nodes.tolist(), label.tolist()):
        groups.setdefault(roots[m], set()).add(x)
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(label.tolist()))


def test_near_fingerprints_share_a_bucket(spark):
    rng = random.Random(9)
    pairs = []
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 4):
            b ^= 1 << bit
        pairs.append([x - (1 << 64) if x >> 63 else x for x in (a, b)])
    rows = spark.createDataFrame(pairs, "a bigint, b bigint")
    from pyspark.sql import functions as F

    met = rows.select(F.arrays_overlap(simhash.bucket_keys(F.col("a")), simhash.bucket_keys(F.col("b"))).alias("met"))
    assert met.where("met").count() == 300
