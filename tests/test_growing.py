"""Manifests, fingerprinted caches, growing indexes and overlapping chunks."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from placewise.operators import upsert as U
from placewise.operators.texts import chunk_text
from placewise.sources import manifest
from placewise.sources.readers import read_through_cache


def test_cache_follows_its_inputs(spark, tmp_path):
    source, path, built = str(tmp_path / "in"), str(tmp_path / "cache"), []

    def build():
        built.append(1)
        return spark.read.parquet(source).where("id % 2 = 0")

    read = lambda **more: read_through_cache(spark, path, build, [source], more).count()
    spark.range(10).write.parquet(source)
    assert (read(a=1), read(a=1), len(built)) == (5, 5, 1)
    assert (read(a=2), len(built)) == (5, 2)
    spark.range(10).write.mode("append").parquet(source)
    assert (read(a=2), read(a=2), len(built)) == (10, 10, 3)
    content = manifest.latest(spark, path)[1]
    assert len(manifest.vacuum(spark, path, [content["data"]])) == 2 and read(a=2) == 10 and len(built) == 3


def test_an_input_that_changes_while_it_is_read_is_read_again(spark, tmp_path):
    source, built = str(tmp_path / "in"), []
    spark.range(4).write.parquet(source)

    def build():
        rows = spark.createDataFrame(spark.read.parquet(source).collect(), "id bigint")
        if not built:
            spark.range(4).write.mode("append").parquet(source)
        built.append(1)
        return rows

    assert read_through_cache(spark, str(tmp_path / "cache"), build, [source]).count() == 8 and len(built) == 2


def test_two_jobs_publish_one_after_the_other(spark, tmp_path):
    path, results = str(tmp_path / "table"), []

    def job(i):
        try:
            results.append(manifest.publish(spark, path, {"by": i}, 0))
        except FileExistsError:
            results.append("late")

    jobs = [threading.Thread(target=job, args=(i,)) for i in range(4)]
    [j.start() for j in jobs], [j.join() for j in jobs]
    assert sorted(map(str, results)) == ["1", "late", "late", "late"] and manifest.latest(spark, path)[0] == 1
    (tmp_path / "table" / "_manifests" / "0000000002.json").write_text("{not done")
    assert manifest.latest(spark, path)[0] == 1 and manifest.latest(spark, str(tmp_path / "none")) == (0, None)


def test_only_changed_texts_are_embedded(spark, tmp_path):
    path, seen = str(tmp_path / "index"), spark.sparkContext.accumulator(0)

    def embed(rows):
        def count(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return rows.mapInArrow(count, rows.schema).withColumn("embedding", F.array(F.length("text").cast("float")))

    state = lambda: {r.id: (r.text, r.embedding[0]) for r in U.read_index(spark, path).collect()}
    rows = [(str(i), f"text {i}") for i in range(20)]
    with pytest.raises(FileNotFoundError):
        U.read_index(spark, path)
    run = lambda rows, **more: _run(spark, path, seen, embed, rows, **more)
    assert run(rows) == ((20, 0, 0, 0), 20)
    assert run(rows) == ((0, 0, 0, 20), 0) and manifest.latest(spark, path)[0] == 1
    changed = [(i, t + "!" if i in ("3", "4") else t) for i, t in rows if i != "9"] + [("new", "n"), (None, "lost"), ("3", "text 3!")]
    assert run(changed) == ((1, 2, 0, 17), 3)
    assert state() == {i: (t, float(len(t))) for i, t in [*rows, ("3", "text 3!"), ("4", "text 4!"), ("new", "n")]}
    assert run(changed, complete=True) == ((0, 0, 1, 20), 0)
    assert "9" not in state() and len(state()) == 20
    before = state()
    assert len(U.compact(spark, path, share=0.1)) == 1 and U.compact(spark, path, share=0.1) == []
    assert state() == before and run(changed, complete=True) == ((0, 0, 0, 20), 0)
    assert run(rows) == ((1, 2, 0, 17 + 0), 3) and state()["9"] == ("text 9", 6.0)
    assert run([], complete=True)[0] == (0, 0, 21, 0) and state() == {}


def _run(spark, path, seen, embed, rows, **more):
    start = seen.value
    changes = U.upsert(path, spark.createDataFrame(rows, "id string, text string"), embed, **more)
    return (changes.added, changes.changed, changes.removed, changes.unchanged), seen.value - start


def plain_chunks(text, size, separator, overlap):
    done, opened = [], ""
    for paragraph in text.split(separator):
        if len(opened) + len(paragraph) < size:
            opened += paragraph + separator
        else:
            carried = ""
            if opened:
                done.append(opened.strip())
                carried = opened.strip()[-overlap:] + separator if overlap else ""
            opened = carried + paragraph + separator
    return done + ([opened.strip()] if opened else [])


@pytest.mark.parametrize("overlap", [0, 1, 7, 50])
def test_chunks_overlap(spark, overlap):
    rng = random.Random(overlap)
    texts = ["||".join("".join(rng.choice("ab é") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    got = {}
    for r in chunk_text(docs, size=40, separator="||", overlap=overlap).orderBy("n", "chunk_index").collect():
        got.setdefault(r.n, []).append(r.text)
    assert got == {n: plain_chunks(t, 40, "||", overlap) for n, t in enumerate(texts)}
