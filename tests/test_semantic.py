"""The decomposition against NumPy's, and what its vectors are good for."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from placewise.functions.columns import fill_text
from placewise.operators import semantic as S

TOPICS = {
    "pets": "cat dog kitten puppy leash paw fur".split(),
    "food": "bread butter cheese oven flour yeast".split(),
    "cars": "engine wheel brake clutch tyre gear".split(),
}


def corpus(spark, n=240):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        topic = list(TOPICS)[i % 3]
        rows.append((i, topic, " ".join(rng.sample(TOPICS[topic], 3) + [f"w{rng.randrange(200)}"])))
    rows += [(n, None, None), (n + 1, None, "")]
    return spark.createDataFrame(rows, "id int, topic string, text string").repartition(4)


def test_singular_values_equal_numpy(spark):
    docs = corpus(spark)
    model = S.fit_semantic(docs, dimension=8, terms=128, power=4)
    rows = model.terms.transform(docs.select(fill_text(F.col("text")).alias("_text"))).select(vector_to_array("_unit").alias("v")).collect()
    left, values, right = np.linalg.svd(np.array([r.v for r in rows]), full_matrices=False)
    assert np.allclose(model.values, values[:8], rtol=2e-3)
    assert np.allclose(model.directions.T @ model.directions, np.eye(8), atol=1e-9)
    assert np.allclose(np.abs(np.sum(model.directions[:, :2] * right[:2].T, axis=0)), 1, atol=1e-3)


def test_texts_of_a_topic_are_near_without_sharing_words(spark):
    docs = corpus(spark)
    model = S.fit_semantic(docs, dimension=3, terms=256, power=2)
    asked = spark.createDataFrame([(0, "cat"), (1, "puppy"), (2, "oven"), (3, "cheese"), (4, None)], "id int, text string")
    got = {r.id: np.array(r.embedding) for r in S.semantic_embed(asked, model).collect()}
    assert got[0] @ got[1] > 0.9 and got[2] @ got[3] > 0.9 and abs(got[0] @ got[2]) < 0.5
    assert all(abs(np.linalg.norm(got[i]) - 1) < 1e-5 for i in range(4)) and not got[4].any()


def test_empty_table(spark):
    docs = corpus(spark)
    with pytest.raises(ValueError, match="no texts"):
        S.fit_semantic(docs.where("text = 'none'"))
    assert S.semantic_embed(docs.limit(0), S.fit_semantic(docs, dimension=2, terms=32)).count() == 0


def test_products_of_a_large_batch_take_little_memory():
    rng = np.random.default_rng(5)
    sizes = rng.integers(0, 120, 4000)
    sizes[[0, 7, -1]] = 0
    terms = [np.sort(rng.choice(512, n, replace=False)).astype(np.int32) for n in sizes]
    values = [rng.normal(size=n) for n in sizes]
    batch = pa.StructArray.from_arrays([pa.array(terms, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))], ["i", "v"])
    basis = rng.normal(size=(512, 64))
    tracemalloc.start()
    made = np.concatenate([S._projected(p, basis) for p in S._pieces(batch.slice(3))])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    dense = np.zeros((4000, 512))
    for row, (t, v) in enumerate(zip(terms, values)):
        dense[row, t] = v
    assert np.allclose(made, (dense @ basis)[3:])
    assert peak < 60e6  # the entries of all rows times the directions are 120 MB
