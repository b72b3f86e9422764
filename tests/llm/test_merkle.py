"""The Merkle manifest against a plain recomputation, with small blocks, ties, nulls and clashing columns."""

import collections
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from placewise.llm import merkle
from placewise.llm.merkle import op13_merkle_manifest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, grp string, node string, pos bigint, leaf int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(tree, at):
    found = []
    for nodes in tree[:-1]:
        first = at // 16 * 16
        found.append((nodes[first:at], nodes[at + 1 : first + 16]))
        at //= 16
    return found


def brute(rows):
    """(doc_id, leaf, subroot, root, proof, folded root) of all rows (doc_id, source, lang, n_chars, text)."""
    by_source = collections.defaultdict(list)
    for r in rows:
        by_source[r[1]].append((r[0] is not None, r[0] or 0, leaf_of(*r), r))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])]) for s in names}
    upper = levels([trees[s][-1][0] for s in names])
    out = []
    for place, s in enumerate(names):
        for at, (_, _, leaf, r) in enumerate(sorted(by_source[s], key=lambda x: x[:3])):
            path = siblings(trees[s], at) + siblings(upper, place)
            text = r[4]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = leaf_of(*r[:4], text)
            for left, right in path:
                node = sha("".join(left) + node + "".join(right))
            out.append((r[0], leaf, trees[s][-1][0], upper[-1][0], sha("".join("".join(a) + "".join(b) for a, b in path)), node, node == upper[-1][0]))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_query(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()
    rows = op13_merkle_manifest(spark, small)
    assert rows.columns == COLUMNS
    rows = [tuple(r) for r in rows.collect()]
    assert order(rows) == order(brute([tuple(r) for r in docs]))
    assert {r[6] for r in rows} == {True, False}


@pytest.mark.parametrize("height", [1, 2, 3])
def test_rounds_of_blocks(spark, height):
    """Blocks of 16, 256 and 4,096 nodes give one tree; there are more sources than a block of 16 holds."""
    rows = [(i, "hot" if i % 3 else f"s{i % 60}", "en", i, f"Text {i}") for i in range(700)]
    rows += [(5, "hot", None, None, None), (5, "hot", None, None, None), (None, "hot", "en", 1, "NO id"), (1, None, "en", 1, ""), (None, None, None, None, None), (7, "", "en", 3, "É é"), (7, "z", "en", 3, "X" * 100000)]
    docs = spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3], "g", "n", 1, 2) for r in rows], SCHEMA)
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    leaves = merkle.leaves(docs, F.when(chosen, F.translate("text", merkle._UPPER, merkle._LOWER)))
    assert order(tuple(r) for r in merkle.audited(leaves, height).collect()) == order(brute(rows))


def test_versions_share_what_they_do_not_touch(spark):
    base = merkle.Version.built([sha(str(i)) for i in range(300)], 3)
    changed = base.replaced(20, "x")
    assert sorted(changed.copies) == [(0, 20), (1, 1), (2, 0), (3, 0)] and base.top() != changed.top()
    assert changed.replaced(20, sha("20")).top() == base.top()
    both = changed.replaced(299, "y")
    assert both.top() == base.replaced(299, "y").replaced(20, "x").top() and base.node(0, 20) == sha("20")
    docs = spark.createDataFrame([(i, "A", "en", "s", 1, None, None, 0, 0) for i in range(40)], SCHEMA)
    made = merkle.manifest(merkle.leaves(docs, F.when(F.col("doc_id") == 33, F.lit("a"))))
    copies = {r.doc_id: [(c.level, c.place) for c in r.copies] for r in merkle.versions(made, copies=True).collect()}
    assert copies.pop(33) == [(0, 33), (1, 2), (2, 0)] and not any(copies.values())


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert merkle.manifest(merkle.leaves(docs)).root is None
    assert merkle.audited(merkle.leaves(docs)).collect() == []
