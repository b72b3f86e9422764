"""Chunking and vector search against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from placewise.operators import texts as X
from placewise.operators import vectors as V


def greedy(text, size, sep):
    """Plain statement of the packing rule."""
    chunks, cur = [], ""
    for p in text.split(sep):
        if len(cur) + len(p) < size:
            cur += p + sep
        else:
            if cur:
                chunks.append(cur.strip())
            cur = p + sep
    if cur:
        chunks.append(cur.strip())
    return chunks


@pytest.mark.parametrize("sep", ["\n\n", "\n", "."])
def test_chunks(spark, sep):
    rng = random.Random(11)
    docs = ["", sep, "a", "x" * 700, f"{'y' * 498}{sep}z", f"{'y' * 500}{sep}{'z' * 500}", " é" * 300]
    for _ in range(60):
        docs.append(sep.join("".join(rng.choice("ab é\t ") for _ in range(rng.randrange(0, 260))) for _ in range(rng.randrange(1, 20))))
    df = spark.createDataFrame(list(enumerate(docs)), "id int, text string")
    got = {}
    for r in X.chunk_text(df, separator=sep).orderBy("id", "chunk_index").collect():
        got.setdefault(r["id"], []).append(r["text"])
    assert got == {i: greedy(d, 500, sep) for i, d in enumerate(docs)}


def vectors(n, dim, seed, copies=0):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, dim))
    if copies:
        m[rng.choice(n, copies, replace=False)] = m[0]
    return m


def frame(spark, m, key):
    return spark.createDataFrame([(i, [float(x) for x in v], str(i % 3)) for i, v in enumerate(m)], f"{key} bigint, embedding array<double>, place string")


def brute(index, queries, k, allowed=lambda q, i: True):
    unit = lambda m: np.divide(m, np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros_like(m), where=np.linalg.norm(m, axis=1, keepdims=True) > 0)
    d = np.round(1 - unit(queries) @ unit(index).T, 9)
    return {
        (q, r + 1): i for q in range(len(queries))
        for r, i in enumerate(sorted((i for i in range(len(index)) if allowed(q, i)), key=lambda i: (d[q, i], i))[:k])
    }


def found(df):
    return {(r["query_id"], r["rank"]): r["id"] for r in df.collect()}


def test_search_equals_brute_force_with_copies(spark):
    index, queries = vectors(700, 16, 1, copies=250), vectors(9, 16, 2)
    index[5], queries[0] = 0.0, index[0]
    got = V.vector_search(frame(spark, index, "id").repartition(7), frame(spark, queries, "query_id"), 12, digits=9)
    assert found(got) == brute(index, queries, 12)


def test_search_with_match_filter_and_small_index(spark):
    index, queries = vectors(40, 8, 3), vectors(6, 8, 4)
    df, asked = frame(spark, index, "id"), frame(spark, queries, "query_id")
    got = V.vector_search(df, asked, 30, match=("place", "place"))
    assert found(got) == brute(index, queries, 30, lambda q, i: q % 3 == i % 3)
    got = V.vector_search(df, asked, 5, where=F.col("id") >= 20)
    assert found(got) == brute(index, queries, 5, lambda q, i: i >= 20)
    assert V.vector_search(df, asked.where("query_id < 0")).count() == 0


def test_search_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_BYTES", 8 * 8)
    index, queries = vectors(50, 8, 5), vectors(7, 8, 6)
    got = V.vector_search(frame(spark, index, "id"), frame(spark, queries, "query_id"), 4)
    assert found(got) == brute(index, queries, 4)
    got = V.vector_search(frame(spark, index, "id"), frame(spark, queries, "query_id"), 4, match=("place", "place"))
    assert found(got) == brute(index, queries, 4, lambda q, i: q % 3 == i % 3)
    pairs = V.cosine_matrix(frame(spark, queries, "id")).collect()
    assert len(pairs) == 49 and all(abs(r["similarity"] - 1) < 1e-12 for r in pairs if r["id_a"] == r["id_b"])


def test_search_computes_few_distances_at_a_time(spark, monkeypatch):
    index, queries = vectors(300, 8, 15, copies=100), vectors(7, 8, 16)
    df, asked = frame(spark, index, "id").coalesce(2), frame(spark, queries, "query_id")
    table = V._asked(asked, "query_id", "embedding", None).toArrow()
    batches = df.select("id", "embedding", F.lit(None).cast("string")).toArrow().to_batches()
    monkeypatch.setattr(V, "DISTANCES", 20)
    run = V._local_search(table, 9, False, (pa.int64(), pa.int64()), 9)
    got = {}
    for batch in run(iter(batches)):
        for r in batch.to_pylist():
            got.setdefault(r["query_id"], []).append(r["id"])
    assert {(q, n + 1): i for q, ids in got.items() for n, i in enumerate(ids)} == brute(index, queries, 9)


def test_near_distances_are_compared_in_full(spark):
    turn = [1e-4, 1.00001e-4, 0.99999e-4]  # distances differ in the 14th digit
    index = np.array([[np.cos(a), np.sin(a)] for a in turn])
    got = V.vector_search(frame(spark, index, "id"), frame(spark, np.array([[1.0, 0.0]]), "query_id"), 3)
    assert found(got) == {(0, 1): 2, (0, 2): 0, (0, 3): 1}


def test_search_by_text_ids(spark):
    index, queries = vectors(60, 4, 7, copies=30), vectors(2, 4, 8)
    df = frame(spark, index, "n").withColumn("id", F.format_string("d%03d", "n"))
    got = found(V.vector_search(df, frame(spark, queries, "query_id"), 6, digits=9))
    assert {k: int(v[1:]) for k, v in got.items()} == brute(index, queries, 6)


def test_rank_is_limited_before_the_shuffle(spark):
    hits = spark.range(100).select((F.col("id") % 3).alias("query_id"), F.col("id"), F.rand(1).alias("distance"))
    plan = V.rank_topk(hits, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan and "Final" in plan


def test_payload_join_is_left_to_the_optimizer(spark):
    index, queries = vectors(40, 8, 3), vectors(6, 8, 4)
    df = frame(spark, index, "id")
    hits = V.vector_search(df, frame(spark, queries, "query_id"))
    joined = V.attach(hits, df, ["place"])
    assert "strategy=broadcast" not in joined._jdf.queryExecution().analyzed().toString()
    known = {r["id"]: r["place"] for r in df.collect()}
    assert joined.count() == hits.count() and all(r["place"] == known[r["id"]] for r in joined.collect())


def test_pca_equals_numpy(spark):
    m = vectors(120, 6, 10) * np.array([5, 3, 1, 1, 1, 1])
    got = V.pca_2d(frame(spark, m, "id"), keep=["id"]).orderBy("id").collect()
    centred = m - m.mean(axis=0)
    _, _, vt = np.linalg.svd(centred, full_matrices=False)
    vt = vt[:2] * np.sign(vt[:2][np.arange(2), np.abs(vt[:2]).argmax(axis=1)])[:, None]
    np.testing.assert_allclose([[r["pc1"], r["pc2"]] for r in got], centred @ vt.T, atol=1e-8)


COMPLAINTS = [
    "Rat sighting in building lobby", "Mouse droppings in kitchen area", "Rodent burrow holes in backyard", "Rats seen near garbage cans at night",
    "Signs of gnawing on food containers", "Multiple rats in basement", "Rat running across sidewalk", "Rodent activity near restaurant",
    "Rats in subway station entrance", "Dead rat found in alley",
]


def test_index_search_context_and_metrics(spark):
    rows = [(str(i), t, "Manhattan" if i < 5 else "Brooklyn", "10001" if i < 5 else "11201", None) for i, t in enumerate(COMPLAINTS)]
    df = spark.createDataFrame(rows, "unique_key string, descriptor string, borough string, zip_code string, status string")
    model = X.fit_text_embedding(df, "descriptor", dimension=2048)
    index = X.build_complaint_index(df, model)
    assert index.first()["metadata"] == {"borough": "Manhattan", "zip_code": "10001", "status": ""}
    questions = spark.createDataFrame([(0, "rats near garbage", ["garbage cans"]), (1, "multiple basement rats", ["Multiple rats in basement", "nothing"])], "query_id int, text string, relevant array<string>")
    asked = X.text_embed(questions, model)
    hits = V.attach(V.vector_search(index, asked, 3), index, ["text", "metadata"])
    first = {r["query_id"]: r["text"] for r in hits.where("rank = 1").collect()}
    assert first == {0: COMPLAINTS[3], 1: COMPLAINTS[5]}
    judged = X.judge_by_text(hits, questions)
    assert {r["query_id"]: r["precision"] for r in X.precision_at_k(judged, 3).collect()} == {0: pytest.approx(1 / 3), 1: pytest.approx(1 / 3)}
    assert X.mean_reciprocal_rank(judged).first()["mrr"] == 1.0
    only = V.vector_search(index, asked, 10, where=X.metadata_equals(borough="Brooklyn", zip_code="11201"))
    assert only.where("query_id = 0").count() == 5
    context = {r["query_id"]: r["context"] for r in X.context_string(hits, None).collect()}
    assert context[0].startswith("## Relevant Historical Complaints\n1. Rats seen near garbage cans at night (Location: 10001, Date: N/A)\n2. ")
    guide = hits.where("rank = 1 and query_id = 1").select("query_id", "rank", F.lit("G").alias("text"))
    both = {r["query_id"]: r["context"] for r in X.context_string(hits, guide).collect()}
    assert "Guidelines" not in both[0] and both[1].endswith("\n## Relevant Health Guidelines\nG\n\n")
    sources = X.answer_sources(hits, guide, 2, 1).where("query_id = 1").orderBy("place").collect()
    assert [r["kind"] for r in sources] == ["complaint", "complaint", "guideline"]


def test_numbered_ids(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",)], "k string")
    assert [r["id"] for r in X.row_id(df, "complaint", order=["k"]).orderBy("k").collect()] == ["complaint_0", "complaint_1", "complaint_2"]


def test_summary_keeps_the_nearest_per_place(spark):
    df = spark.range(300).select(F.col("id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"), F.when(F.col("id") < 250, "hot").otherwise("cold").alias("p"))
    got = {r["place"]: r for r in X.retrieval_summary(df, F.col("id") / 10, F.col("p")).collect()}
    assert got["hot"]["total_complaints"] == 250 and got["cold"]["total_complaints"] == 50
    assert [h["id"] for h in got["hot"]["recent_complaints"]] == [0, 1, 2, 3, 4] and got["cold"]["sample_issues"][-1] == "t259"


def test_answers_with_and_without_a_place(spark):
    from placewise.plans.answer import answer_questions

    rows = [(str(i), t, "10001" if i < 5 else "11201") for i, t in enumerate(COMPLAINTS)]
    df = spark.createDataFrame(rows, "unique_key string, descriptor string, zip_code string")
    model = X.fit_text_embedding(df, "descriptor", dimension=2048)
    docs = spark.createDataFrame([("g.txt", "Store garbage in closed bins.\n\nSeal the basement.")], "source string, text string")
    guides = X.build_guideline_index(docs, model, size=30)
    asked = spark.createDataFrame([(1, "multiple basement rats", None), (2, "rats near garbage", "11201")], "query_id int, question string, zip string")
    got = {r["query_id"]: r for r in answer_questions(asked, X.build_complaint_index(df, model), guides, model, "zip").collect()}
    assert "1. Multiple rats in basement (Location: 11201, Date: N/A)" in got[1]["context"] and "Location: 10001" not in got[2]["context"]
    assert got[2]["context"].count("(Location: 11201") == 5 and "Location context: 11201" in got[2]["prompt"] and "Location context" not in got[1]["prompt"]
    assert [s["kind"] for s in got[2]["sources"]] == ["complaint"] * 3 + ["guideline"] * 2
    assert got[2]["sources"][0]["text"] == COMPLAINTS[3] and got[2]["sources"][3]["text"] == "Store garbage in closed bins."


def test_classifier_head_separates_clusters(spark):
    from placewise.plans.forecast import array_to_vector, fit_embedding_classifier

    rng = np.random.default_rng(3)
    rows = [([float(x) for x in rng.normal(size=6) * 0.2 + (np.arange(6) == c) * 3], c) for c in range(3) for _ in range(40)]
    df = spark.createDataFrame(rows, "embedding array<double>, label int")
    model = fit_embedding_classifier(df, classes=3, hidden=8, max_iter=60)
    scored = model.transform(df.withColumn("features", array_to_vector("embedding")))
    assert scored.where("prediction = label").count() >= 115


def test_summary_counts_every_row_of_a_place(spark):
    df = spark.range(250).select("id", F.lit("p").alias("p"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    row = X.retrieval_summary(df, F.col("id") / 10, F.col("p")).first()
    assert row["total_complaints"] == 250 and len(row["recent_complaints"]) == 5 and len(row["sample_issues"]) == 10


def test_matrix_of_a_long_list_is_refused(spark, monkeypatch):
    monkeypatch.setattr(V, "MOST_PAIRED", 3)
    assert V.cosine_matrix(frame(spark, vectors(3, 4, 1), "id")).count() == 9
    with pytest.raises(ValueError, match="too many pairs"):
        V.cosine_matrix(frame(spark, vectors(4, 4, 1), "id"))


def test_large_batches_are_searched_in_little_memory():
    import tracemalloc

    rng = np.random.default_rng(9)
    index, queries = rng.normal(size=(20_000, 64)), rng.normal(size=(50, 64))
    column = lambda m: pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), 64).cast(pa.list_(pa.float64()))
    asked = pa.table({"q": pa.array(range(50)), "v": column(queries), "m": pa.nulls(50, pa.string())})
    batch = pa.RecordBatch.from_arrays([pa.array(range(20_000)), column(index), pa.nulls(20_000, pa.string())], ["id", "v", "m"])
    run = V._local_search(asked, 3, False, (pa.int64(), pa.int64()), 9)
    tracemalloc.start()
    got = pa.Table.from_batches(list(run(iter([batch]))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    found = {}
    for q, i in zip(got.column("query_id").to_pylist(), got.column("id").to_pylist()):
        found.setdefault(q, []).append(i)
    assert {(q, n + 1): i for q, ids in found.items() for n, i in enumerate(ids)} == brute(index, queries, 3)
    assert peak < 30e6  # the batch's rows and their lengths take 10 MB each, all distances 8 MB


def test_sparse_rows_are_found_like_arrays(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 11} common{i}") for i in range(80)] + [(80, None), (81, "")], "id int, text string")
    model = X.fit_text_embedding(docs, dimension=32)
    asked = X.text_embed(docs.where("id % 9 = 0").withColumnRenamed("id", "query_id"), model)
    want = V.vector_search(X.text_embed(docs, model), asked, 4, digits=9).collect()
    sparse = X.text_embed(docs, model, sparse=True)
    assert sorted(V.vector_search(sparse, asked, 4, digits=9).collect()) == sorted(want)
    monkeypatch.setattr(V, "BLOCK_BYTES", 32 * 8 * 4)
    assert sorted(V.vector_search(sparse, asked, 4, digits=9).collect()) == sorted(want)


def test_questions_search_each_index_once(spark, monkeypatch):
    from placewise.plans import answer as A

    docs = spark.createDataFrame([(str(i), f"rats w{i % 5} near bins", {"zip_code": str(i % 3)}) for i in range(30)], "id string, text string, metadata map<string,string>")
    model = X.fit_text_embedding(docs, dimension=32)
    index = X.text_embed(docs, model, sparse=True)
    questions = spark.createDataFrame([(0, "w1 bins", None), (1, "w2", "1")], "query_id int, question string, place string")
    searched = []
    search = A.vector_search
    monkeypatch.setattr(A, "vector_search", lambda pool, *a, **b: (searched.append((b.get("match"), pool is index)), search(pool, *a, **b))[1])
    rows = {r.query_id: r for r in A.answer_questions(questions, index, index, model, place="place").collect()}
    assert len(searched) == 3  # guidelines, complaints, and complaints by place
    assert all(len(r.sources) == 5 for r in rows.values()) and "Location: 1" in rows[1].prompt and "Location: 0" in rows[0].prompt
