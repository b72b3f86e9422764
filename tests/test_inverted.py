"""The inverted file against brute force: recall, pruned reads, skipped parts, large query sides and odd vectors."""

import numpy as np
import pytest

from placewise.operators import inverted as I
from placewise.operators import vectors as V


def frame(spark, matrix, name, **more):
    rows = [(i, [float(x) for x in v], *(c[i] for c in more.values())) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, [name, "embedding", *more])


def clustered(count, dim, seed, spread=0.15, groups=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    return centres[rng.integers(0, groups, count)] + spread * rng.normal(size=(count, dim))


def nearest(index, queries, k, allowed=None):
    """{(query, rank): id} by distance rounded to 9 digits, then id."""
    distance = np.round(1 - V.unit_rows(queries) @ V.unit_rows(index).T, 9)
    if allowed is not None:
        distance[:, ~allowed] = np.inf
    order = np.lexsort((np.broadcast_to(np.arange(len(index)), distance.shape), distance), axis=1)[:, :k]
    return {(q, r + 1): int(i) for q, row in enumerate(order) for r, i in enumerate(row) if distance[q, i] < np.inf}


def found(hits):
    return {(r.query_id, r["rank"]): r.id for r in hits.collect()}


@pytest.fixture(scope="module")
def built(spark):
    index = np.concatenate([clustered(600, 16, 1), np.zeros((3, 16))])
    index[50:60] = index[50]
    return index, I.build(frame(spark, index, "id", kind=[i % 3 for i in range(len(index))]), 20, keep=["kind"], part_rows=40)


def test_every_row_is_stored_once(spark, built):
    index, file = built
    assert file.parts["rows"].sum() == len(index) and len(set(file.parts["part"])) == len(file.parts)
    rows = {r.id: r for r in file.rows(spark).collect()}
    assert sorted(rows) == list(range(len(index))) and all(rows[i].list == I.ZERO for i in range(600, 603))
    units = V.unit_rows(index)
    every = np.linalg.norm(units[:600, None] - file.centres[None], axis=2)
    assert all(rows[i].reach == pytest.approx(every[i].min(), abs=1e-7) for i in range(600))
    assert max(np.bincount(file.parts["list"] + 1)) > 1  # a long list is several parts


def test_approximate_search_reads_few_lists_and_finds_most(spark, built):
    index, file = built
    queries = clustered(40, 16, 1, spread=0.2)
    asked = frame(spark, queries, "query_id")
    few = I.search(file, asked.limit(1), probes=3)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan and plan.count("Exchange hashpartitioning") == 1
    share = I.recall(I.search(file, asked, probes=4), V.vector_search(frame(spark, index, "id"), asked)).first()
    assert share.queries == 40 and share.recall >= 0.9
    assert found(I.search(file, asked, 7, probes=len(file.centres), digits=9)) != {}


def test_lists_for_a_recall(spark, built):
    index, file = built
    queries = clustered(40, 16, 1, spread=0.3)
    asked = frame(spark, queries, "query_id")
    exact = V.vector_search(frame(spark, index, "id"), asked)
    for share in (0.6, 0.9):
        probes = I.probes_for(file, asked, share)
        assert I.recall(I.search(file, asked, probes=probes), exact).first().recall >= share - 1e-9
        assert probes == 1 or I.recall(I.search(file, asked, probes=probes - 1), exact).first().recall < share


def test_exact_search_skips_parts(spark, built):
    index, file = built
    queries = clustered(30, 16, 1, spread=0.1)
    hits = I.exact_search(file, frame(spark, queries, "query_id"), 6, digits=9)
    assert found(hits) == nearest(index, queries, 6)
    read = {r.query_id: r.parts_read for r in hits.collect()}
    assert np.mean(list(read.values())) < len(file.parts) / 2


def test_exact_search_of_odd_queries(spark, built):
    index, file = built
    queries = np.concatenate([np.zeros((1, 16)), -index[:3], index[50:51], 1e-9 * index[7:8]])
    assert found(I.exact_search(file, frame(spark, queries, "query_id"), 12, digits=9)) == nearest(index, queries, 12)
    more = I.exact_search(file, frame(spark, queries[1:], "query_id"), len(index) + 5, digits=9)
    assert len(found(more)) == len(index) * 5
    kind = np.arange(len(index)) % 3 == 1
    assert found(I.exact_search(file, frame(spark, queries, "query_id"), 5, digits=9, where="kind = 1")) == nearest(index, queries, 5, kind)


def test_many_queries_meet_parts_in_cells(spark, built, monkeypatch):
    index, file = built
    queries = clustered(50, 16, 4)
    monkeypatch.setattr(V, "BLOCK_BYTES", 2000)
    asked = frame(spark, queries, "query_id")
    assert found(I.exact_search(file, asked, 5, digits=9)) == nearest(index, queries, 5)


def test_no_rows(spark):
    index = clustered(30, 4, 2)
    empty = I.build(frame(spark, index, "id").where("id < 0"), 3)
    assert I.search(empty, frame(spark, index, "query_id")).collect() == []
    assert I.exact_search(empty, frame(spark, index, "query_id")).collect() == []
    file = I.build(frame(spark, np.zeros((4, 4)), "id"), 3)
    assert found(I.exact_search(file, frame(spark, index[:1], "query_id"), 2)) == {(0, 1): 0, (0, 2): 1}
    assert I.search(file, frame(spark, index, "query_id").where("query_id < 0")).collect() == []


def test_centres_are_fitted_by_many_tasks(spark, monkeypatch):
    from pyspark.ml.clustering import KMeans

    index = clustered(400, 8, 3)
    seen = []
    fit = KMeans.fit
    monkeypatch.setattr(KMeans, "fit", lambda self, rows: (seen.append((rows.rdd.getNumPartitions(), rows.count())), fit(self, rows))[1])
    monkeypatch.setattr(I, "TASK_ROWS", 50)
    assert I.fit_centres(frame(spark, index, "id"), 6).shape == (6, 8)
    assert I.fit_centres(frame(spark, index, "id"), 6, rows=120).shape == (6, 8)
    assert seen == [(8, 400), (3, 120)]
