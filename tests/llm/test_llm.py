"""The corpus operators against brute force, SQL and exact round trips, with nulls, empty and repeated rows."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from tokenizers import AddedToken, Tokenizer

import corpus_pipeline
from oracle_check import compare, connect
from placewise.llm import arrays, byte_bpe, chat_format, decontamination, near_duplicates, quality_crf, quality_rules, sharding, token_counts, token_files, url_filter, vocabularies
from placewise.llm.queries import ORACLES, QUERIES

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
LIBRARY = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words int, score double, row bigint"
SENTENCE = "the quick brown fox jumps over the lazy dog near a quiet river bank while seven tired men watch from afar"


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def table(spark, texts, ids=None):
    """Documents with extra columns whose names the operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", None, None, 1, 0.5, 7) for i, t in zip(ids, texts)], SCHEMA)


ODD = [None, "", " ", "\n\n", "a", "one two", "É é \U0001f600 ok", SENTENCE, SENTENCE, "word " * 30000, "x" * 100000, "l\n" * 500]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, small, name):
    assert compare(QUERIES[name](spark, small), connect(small), ORACLES[name]) == ""


def test_pretokens_equal_the_pattern():
    rng = random.Random(3)
    signs = [*"ab'strevmld  \n\t12é.ñ!\U0001f600 ß", "'s", "'re", "'ll", " '", "''"]
    pattern = regex.compile(public_tokenizers.PATTERN)
    for _ in range(100):
        texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 25))) for _ in range(20)]
        data, bounds = arrays.laid_out(arrays.strings(pa.array(texts)))
        found = [[] for _ in texts]
        for a, b, i in zip(*arrays.pretokens(data, bounds)):
            found[i].append(data[a:b].tobytes().decode())
        assert found == [pattern.findall(t) for t in texts]


def test_bpe_round_trip(spark, encoding):
    docs = table(spark, ODD, [None, 1, 1, *range(3, len(ODD))])
    encoded = byte_bpe.encode(docs, RANKS)
    expected = sorted((-1 if i is None else i, encoding.encode_ordinary(t or "")) for i, t in [(r.doc_id, r.text) for r in docs.collect()])
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids) for r in encoded.collect()) == expected
    decoded = sorted(bytes(r.decoded) for r in byte_bpe.decode(encoded, RANKS).collect())
    assert decoded == sorted((t or "").encode() for t in ODD)
    assert byte_bpe.encode(docs.limit(0), RANKS).count() == 0


def test_bpe_query(spark, small, encoding):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in QUERIES["op10_byte_bpe"](spark, small).collect():
        ids = np.array(encoding.encode_ordinary(docs[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs.pop(r.doc_id).encode()).hexdigest()
    assert not docs


@pytest.mark.parametrize("bits", [1, 7, 8, 11, 16, 17, 24, 31])
def test_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1001).astype("u4")
    packed = token_files.pack(ids, bits)
    assert len(packed) == (1001 * bits + 7) // 8
    assert (token_files.unpack(packed, 1001, bits) == ids).all()
    assert (token_files.unpack(packed, 500, bits, 333) == ids[333:833]).all()


def test_token_files(spark, small, encoding, tmp_path):
    at = 0
    found = {r.doc_id: r for r in QUERIES["op2_token_files"](spark, small).collect()}
    for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect():
        ids = np.array([*encoding.encode_ordinary(r.text), 0], "<u4")
        assert tuple(found[r.doc_id])[1:] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    token_files.write_ids(table(spark, ODD), str(tmp_path / "odd"), LIBRARY, block_tokens=50)
    assert {r.doc_id: r.ids for r in token_files.read_ids(spark, str(tmp_path / "odd")).collect()} == {i: encoding.encode_ordinary(t or "") for i, t in enumerate(ODD)}
    token_files.write_ids(table(spark, ODD).limit(0), str(tmp_path / "none"), LIBRARY)
    assert token_files.digests(spark, str(tmp_path / "none")).count() == 0


MARK = "<|endoftext|>"
MARKED = [MARK, f"a{MARK}b", f"it {MARK}{MARK}'s  {MARK}  \n{MARK}", f"é{MARK}\U0001f600 \n", MARK[:7], MARK[7:], None, f"<{MARK}|>", f"<|{MARK[1:]}", "plain  words"]


def test_added_tokens_as_in_the_library(spark, tmp_path):
    library = Tokenizer.from_file(LIBRARY)
    rng = random.Random(5)
    texts = MARKED + ["".join(rng.choice([MARK, MARK[:5], MARK[5:], *"a1 é\n'", "  ", "'s"]) for _ in range(rng.randint(0, 20))) for _ in range(300)]
    expected = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert expected[1] == [64, 50256, 65]
    token_files.write_ids(table(spark, texts).coalesce(1), str(tmp_path / "marked"), LIBRARY, block_tokens=50)
    assert {r.doc_id: r.ids for r in token_files.read_ids(spark, str(tmp_path / "marked")).collect()} == expected
    rows = token_counts.count_tokens(table(spark, texts).coalesce(1), token_counts.heading_body_close(F.col("text")), LIBRARY, "first").collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(x) for i, x in expected.items()}
    sections = {(r.doc_id, r.section): r.n_section for r in token_counts.count_tokens(table(spark, [f"a{MARK}\nb{MARK}c\n{MARK}"]), token_counts.heading_body_close(F.col("text")), LIBRARY).collect()}
    assert sections == {(0, "heading"): 2, (0, "body"): 5, (0, "close"): 1}


def test_added_tokens_of_other_files(tmp_path):
    library = Tokenizer.from_file(LIBRARY)
    library.add_tokens([AddedToken("<|end", normalized=False), AddedToken("of the", normalized=True), AddedToken("the", normalized=False), AddedToken("é<", normalized=True)])
    library.save(str(tmp_path / "more.json"))
    texts = ["one of the <|end<|endoftext|>é<|end", "of the", "é<é", "", "of of thé< the"]
    ids, lengths = vocabularies.Memory(vocabularies.LibraryWords(str(tmp_path / "more.json"))).ids(*arrays.laid_out(arrays.strings(pa.array(texts))))
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    library.add_tokens([AddedToken("blank", lstrip=True)])
    library.save(str(tmp_path / "odd.json"))
    with pytest.raises(ValueError, match="blank"):
        vocabularies.LibraryWords(str(tmp_path / "odd.json"))


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(spark, encoding, rule):
    docs = table(spark, ODD + ["ab cd\nefgh\nij kl"])
    rows = token_counts.count_tokens(docs, token_counts.heading_body_close(F.col("text")), LIBRARY, rule).collect()
    sums = collections.defaultdict(float)
    for r in rows:
        sums[r.doc_id, r.n_tokens, r.n_outside] += r.n_section
    assert {k[0]: k[1] for k in sums} == {r.doc_id: len(encoding.encode_ordinary(r.text or "")) for r in docs.collect()}
    assert all(abs(k[1] - k[2] - v) < 1e-6 for k, v in sums.items())


def test_token_boundary_rules():
    first, last = np.array([0, 2, 6]), np.array([2, 6, 8])
    begins, stops = np.array([0, 3]), np.array([3, 8])
    assert token_counts.attributed(first, last, begins, stops, "first")[0].tolist() == [2, 1]
    assert token_counts.attributed(first, last, begins, stops, "most")[0].tolist() == [1, 2]
    assert token_counts.attributed(first, last, begins, stops, "split")[0].tolist() == [1.25, 1.75]


def test_quality_on_held_out(spark):
    folder = "/root/testdata/sf0.01"
    rows = QUERIES["op3_quality"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    docs = table(spark, ODD)
    chain = quality_crf.fit_on(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    assert all(0 <= r.score <= 1 for r in quality_crf.score(docs, chain).collect())
    assert quality_crf.keep_good(docs, chain).columns == docs.columns
    assert quality_crf.fit_on(docs.limit(0), spark.read.parquet(f"{folder}/labels.parquet")) is None


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    good, joint, start = rng.normal(size=7), rng.normal(size=(2, 2)), rng.normal(size=2)
    counts, at, expected = np.array([3, 4]), 0, []
    for n in counts:
        total, share = 0.0, np.zeros(n)
        for states in np.ndindex(*[2] * n):
            w = np.exp(start[states[0]] + sum(good[at + i] * s for i, s in enumerate(states)) + sum(joint[a, b] for a, b in zip(states, states[1:])))
            total += w
            share += w * np.array(states)
        expected += list(share / total)
        at += n
    assert np.allclose(quality_crf.forward_backward(good, counts, joint, start)[0], expected)


def test_rules_on_odd_texts(spark):
    docs = table(spark, ODD)
    rows = {r.doc_id: r for r in quality_rules.judged(docs).collect()}
    assert not any(rows[i].kept for i in range(7)) and rows[9].n_words == 30000 and rows[9].n_repeat_words == 30000
    assert {r.doc_id for r in quality_rules.keep(docs).collect()} == {i for i, r in rows.items() if r.kept}
    assert quality_rules.judged(docs.limit(0)).count() == 0


def words_of(text):
    return re.findall("[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute_classes(docs):
    """Least id of each class, from all pairs."""
    bags = {}
    for i, t in docs.items():
        w = words_of(t)
        bags[i] = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else collections.Counter([tuple(w)] if w else [])
    root = {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = collections.defaultdict(set)
    for i, bag in bags.items():
        for g in bag:
            where[g].add(i)
    for i in docs:
        near = collections.Counter(j for g in bags[i] for j in where[g] if j < i)
        for j, n in near.items():
            a, b = bags[i], bags[j]
            if n / len(a.keys() | b.keys()) > 0.5:
                every = a.keys() | b.keys()
                if sum(1 / sum(max(a[y] / a[x], b[y] / b[x]) for y in every) for x in a.keys() & b.keys()) >= 0.8:
                    low, high = sorted((find(i), find(j)))
                    root[high] = low
    return {i: find(i) for i in docs}


def test_near_duplicates(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert {r.doc_id: r.class_id for r in QUERIES["op9_near_duplicates"](spark, small).collect()} == brute_classes(docs)


@pytest.mark.parametrize("nodes, size", [(3, 1 << 20), (1024, 2500)])
def test_near_duplicates_in_small_blocks(spark, monkeypatch, nodes, size):
    """Two stars of texts that meet in buckets: links between them must be found across blocks, by count or by bytes."""
    monkeypatch.setattr(near_duplicates, "BLOCK", nodes)
    monkeypatch.setattr(near_duplicates, "BLOCK_BYTES", size)
    rng = random.Random(6)
    base, texts = [f"w{rng.randint(0, 10**6)}" for _ in range(200)], []
    for k in range(40):
        changed = list(base)
        for at in rng.sample(range(200), 1 if k % 2 else 3):
            changed[at] = f"n{k}x{at}"
        texts.append(" ".join(changed))
    docs = table(spark, texts)
    expected = brute_classes({r.doc_id: r.text for r in docs.collect()})
    assert {r.doc_id: r.class_id for r in near_duplicates.classes(docs).collect()} == expected


def test_near_duplicates_chain_and_odd_rows(spark):
    rng = random.Random(5)
    text, chain = [f"w{rng.randint(0, 10**6)}" for _ in range(120)], []
    for k in range(12):  # neighbours are similar, the ends are not
        chain.append(" ".join(text))
        text[k * 10] = f"n{k}"
    docs = table(spark, chain + [None, "", "same text", "same text"])
    expected = brute_classes({r.doc_id: r.text for r in docs.collect()})
    assert {r.doc_id: r.class_id for r in near_duplicates.classes(docs).collect()} == expected
    kept = near_duplicates.keep_one(docs.unionAll(docs))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(expected.values()))
    assert near_duplicates.keep_one(docs.limit(0)).count() == 0


def test_texts_that_share_an_id_are_kept_each(spark):
    rng = random.Random(8)
    a, b, c, d, e = ([f"w{rng.randint(0, 10**6)}" for _ in range(120)] for _ in range(5))
    near = lambda text: [*text[:-1], "changed"]
    rows = [(3, b), (5, a), (5, b), (5, a), (7, c), (7, d), (6, near(c)), (8, near(d)), (None, e), (9, e), (10, ["x"]), (10, ["y"])]
    texts, ids = [" ".join(t) for _, t in rows], [i for i, _ in rows]
    kept = near_duplicates.keep_one(table(spark, texts, ids)).collect()
    expected = [(3, b), (5, a), (6, near(c)), (7, d), (None, e), (10, ["x"]), (10, ["y"])]
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted((str(i), " ".join(t)) for i, t in expected)


def test_decontamination(spark):
    items = spark.createDataFrame([(1, SENTENCE), (12, "Short item"), (3, None), (4, "!!"), (None, "lone words here")], "item_id bigint, text string")
    docs = table(spark, [None, "", "a SHORT, item b", "before " + SENTENCE.upper() + " after", "lone words here", "clean", "clean"], [0, 1, 2, 3, 4, 5, 5])
    found = {r.doc_id: r for r in decontamination.report(docs, items).collect()}
    assert [found[i].n_hit for i in range(6)] == [0, 0, 2, len(SENTENCE.split()), 3, 0]
    assert [found[i].n_items for i in range(5)] == [0, 0, 1, 1, 0]
    assert found[2].items_sha256 == hashlib.sha256(b"12").hexdigest()
    assert sorted(r.doc_id for r in decontamination.clean_documents(docs, items).collect()) == [0, 1, 5, 5]
    cut = {r.doc_id: r.text for r in decontamination.clean_spans(docs, items).collect()}
    assert words_of(cut[2]) == ["a", "b"] and words_of(cut[3]) == ["before", "after"]
    assert decontamination.report(docs, items.limit(0)).where("contaminated").count() == 0
    assert decontamination.report(docs.limit(0), items).count() == 0


def test_decontamination_without_broadcast(spark, small, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 0)
    docs, items = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    found = decontamination.report(docs, items)
    assert compare(found, connect(small), ORACLES["op1_decontamination"]) == ""
    odd = table(spark, ODD + ["w " * 20000 + SENTENCE], [None, 1, 1, *range(3, len(ODD) + 1)])
    counts = {r.doc_id: r.n_hit for r in decontamination.report(odd, spark.createDataFrame([(1, SENTENCE)], "item_id bigint, text string")).collect()}
    assert counts[len(ODD)] == len(SENTENCE.split()) and decontamination.report(docs.limit(0), items).count() == 0


def test_urls(spark):
    urls = ["http://a.com/x", "https://Example.COM/en/1", "http://www.example.com/en/", "http://q.net/es/p?x#y", "http://com", "nonsense", None, "x://a.net/fr/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumn("html", F.lit(None).cast("string"))
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(pages, url_filter.rule_table(spark)).collect()}
    assert found[0] == ("a.com", "/x", "com/", "allow") and found[1][2:] == ("example.com/en/", "block")
    assert found[2][2:] == ("www.example.com/en/", "allow") and found[3] == ("q.net", "/es/p", "net/es/", "block")
    assert found[4][:3] == ("com", "", None) and found[5] == ("", "", None, "allow") and found[6] == ("", "", None, "allow")


def test_distrust_travels_back(spark):
    rows = [(0, "http://bad.net/es/", ""), (1, "http://friend.org/", '<a HREF="http://bad.net/es/">'), (2, "http://other.org/", "<a href='/local'>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = {r.host: r for r in url_filter.judged(pages, url_filter.rule_table(spark)).collect()}
    assert found["friend.org"].verdict == "block" and found["friend.org"].distrust == pytest.approx(0.85 * 0.15)
    assert found["other.org"].verdict == "allow"


def test_distrust_does_not_shrink_with_linkers(spark):
    bad, fine = '<a href="http://bad.net/es/">', '<a href="http://other.org/">'
    rows = [("http://bad.net/es/", ""), ("http://other.org/", ""), *((f"http://friend{i}.org/", bad) for i in range(1000))]
    rows += [("http://hub.org/", bad + "".join(f'<a href="http://fine{i}.org/">' for i in range(99))), ("http://half.org/", bad + fine)]
    rows += [("http://com.com/", '<a href="http://trusted.org/">'), ("http://trusted.org/", bad)]
    pages = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id bigint, url string, html string")
    found = {r.host: r for r in url_filter.judged(pages, url_filter.rule_table(spark)).collect()}
    assert {(found[f"friend{i}.org"].verdict, round(found[f"friend{i}.org"].distrust, 9)) for i in range(1000)} == {("block", 0.1275)}
    assert found["hub.org"].distrust == pytest.approx(0.001275) and found["half.org"].distrust == pytest.approx(0.06375)
    assert found["trusted.org"].trust == pytest.approx(0.1275)
    assert [found[h].verdict for h in ("hub.org", "half.org", "other.org")] == ["allow"] * 3


def test_distrust_of_hosts_without_pages(spark):
    rows = [
        ("http://a.org/", "<a href='HTTP://Bad.net/es/1?q'><a href=//bad.net/es/2#x><a href='http://bad.net/fr/'>"),
        ("http://b.org/", '<a href="http://mixed.net/es/"><a href="http://mixed.net/en/"><a href="http://mixed.net">'),
        ("http://c.org/", '<a href="http://own.net/es/">'),
        ("http://own.net/en/", '<a href="/es/">'),
        ("http://e.org/", '<a href="http://e.org/es/"><a href="http://www.example.com/en/">'),
        ("nonsense", '<a href="http://bad.net/good/"><a href="http://mixed.net/es/2">'),
    ]
    pages = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id bigint, url string, html string")
    found = {r.host: (r.verdict, round(r.distrust, 9)) for r in url_filter.judged(pages, url_filter.rule_table(spark)).collect() if r.host}
    assert found == {"a.org": ("block", 0.1275), "b.org": ("allow", 0.0425), "c.org": ("allow", 0), "own.net": ("allow", 0), "e.org": ("allow", 0)}
    counted = url_filter.host_links(pages.unionAll(pages)).where("path IS NULL").collect()
    assert {(r.origin, r.target): r.pages for r in counted} == {("a.org", "bad.net"): 2, ("b.org", "mixed.net"): 2, ("c.org", "own.net"): 2, ("e.org", "www.example.com"): 2}


def test_scores_reach_the_end_of_a_chain(spark):
    names = ["h.com", *(f"h{i}.org" for i in range(1, 13)), "h.net"]
    rows = [(i, f"http://{h}/es/", f'<a href="http://{names[i + 1]}/es/">' if i < 13 else "") for i, h in enumerate(names)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = {r.host: r for r in url_filter.judged(pages, url_filter.rule_table(spark)).collect()}
    for i, h in enumerate(names):
        assert found[h].trust == pytest.approx(0.15 * 0.85**i) and found[h].distrust == pytest.approx(0.15 * 0.85 ** (13 - i))


def test_scores_of_a_circle_settle(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "origin string, target string, pages long")
    seeds = spark.createDataFrame([("a", 1.0, 0.0), ("b", 0.0, 1.0)], "host string, trust double, distrust double")
    found = {r.host: (r.trust, r.distrust) for r in url_filter.propagated(seeds, edges, tolerance=0.01).collect()}
    near, far = 0.15 / (1 - 0.85**2), 0.85 * 0.15 / (1 - 0.85**2)
    assert np.allclose([*found["a"], *found["b"]], [near, far, far, near], atol=0.06)


def test_chat(spark):
    rows = [(1, 0, "user", "<|close|>\n \\<|turn:x|>"), (1, 1, "assistant", None), (2, 0, "assistant", "a|>b\\"), (3, 0, "odd<|role|>", "t"), (3, 0, "odd<|role|>", "t")]
    made = chat_format.formatted(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    read = made.select("conv_id", "valid", chat_format.read_turns(F.col("formatted")).alias("t")).collect()
    assert {r.conv_id: [tuple(t) for t in r.t] for r in read} == {
        1: [("user", "<|close|>\n \\<|turn:x|>"), ("assistant", "")], 2: [("assistant", "a|>b\\")], 3: [("odd<|role|>", "t")] * 2}
    assert {r.conv_id: r.valid for r in read} == {1: True, 2: False, 3: False}


def test_sharding(spark):
    docs = table(spark, ODD * 20, [None if i % 50 == 0 else i // 3 for i in range(len(ODD) * 20)])
    rows = sharding.assigned(docs, 6).collect()
    assert len(rows) == len(ODD) * 20 and sum(r.size for r in rows) == sum(len((t or "").encode()) + 16 for t in ODD) * 20
    slots, held = collections.defaultdict(list), collections.Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        held[r.shard] += r.size
    assert set(slots) == set(range(6)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(held.values()) - min(held.values()) <= 2 * max(r.size for r in rows)
    assert sharding.assigned(docs.limit(0), 6).count() == 0


def test_pipeline(spark, small, encoding):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    source = spark.read.parquet(f"{small}/documents.parquet")
    chain = quality_crf.fit_on(source, spark.read.parquet(f"{small}/labels.parquet"))
    score = quality_crf.scores(chain, pa.array([r.text for r in docs.values()]))
    left = {i: r.text for (i, r), s in zip(docs.items(), score) if s >= quality_crf.THRESHOLD}
    rules = {r.doc_id: r.kept for r in quality_rules.judged(source).collect()}
    left = {i: t for i, t in left.items() if rules[i]}
    classes = brute_classes(left)
    left = {i: t for i, t in left.items() if classes[i] == i}
    grams = set()
    for r in spark.read.parquet(f"{small}/benchmark.parquet").collect():
        w = words_of(r.text)
        grams |= {tuple(w[k : k + 10]) for k in range(len(w) - 9)} or ({tuple(w)} if w else set())
    sizes = {len(g) for g in grams}
    dirty = lambda w: any(tuple(w[k : k + s]) in grams for s in sizes for k in range(len(w) - s + 1))
    expected = {i: encoding.encode_ordinary(t) for i, t in left.items() if not dirty(words_of(t))}
    assert {r.doc_id: r.ids for r in corpus_pipeline.run(spark, small).collect()} == expected
