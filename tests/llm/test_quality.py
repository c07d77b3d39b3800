import random

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallybook.llm import quality
from tallybook.llm.common import fold


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    rows, marks = [], []
    for i in range(300):
        good = i % 4 != 0
        text = cases.prose(rng, rng.randint(5, 60))
        rows.append((i, text if good else text.upper().replace(" ", "!! "), None, None, 0))
        marks.append((i, int(good)))
    docs = cases.frame(spark, rows).repartition(3).cache()
    return docs, spark.createDataFrame(marks, "doc_id bigint, quality int")


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    model = quality.fit(docs, labels.where(~fold(F.col("doc_id"), 3, 1)), neighbours=9)
    found = quality.predict(docs, model).join(labels, "doc_id").toPandas()
    assert ((found.score >= 0.5).astype(int) == found.quality).mean() >= 0.97


def test_scores_as_by_brute_force(labelled):
    docs, labels = labelled
    model = quality.fit(docs, labels, neighbours=7)
    texts = [r.text.encode() for r in docs.select("text").limit(30).collect()]
    vectors = model.embed(quality.term_counts(texts)).astype(float)
    for text, x in zip(texts, vectors, strict=True):
        cosine = model.vectors.astype(float) @ x
        near = np.argsort(-cosine)[:7]
        weight = np.maximum(cosine[near], 0) ** quality.SHARPNESS
        want = (weight * model.labels[near]).sum() / weight.sum()
        assert model.scores([text])[0] == pytest.approx(want, abs=1e-4)


def test_sample_is_bounded_and_repeatable(labelled):
    docs, labels = labelled
    one, two = (quality.fit(docs, labels, max_labelled=50) for _ in range(2))
    assert len(one.labels) == 50
    assert np.allclose(one.vectors @ one.vectors.T, two.vectors @ two.vectors.T, atol=1e-4)


def test_awkward_rows(spark, labelled):
    docs, labels = labelled
    odd = labels.union(spark.createDataFrame([(None, 1), (5, None), (7, 0), (9999, 1)], labels.schema))
    model = quality.fit(docs, odd)
    rows = cases.rows()
    found = quality.predict(cases.frame(spark, rows), model).collect()
    assert sorted((r.doc_id for r in found), key=str) == sorted((r[0] for r in rows), key=str)
    assert all(0 <= r.score <= 1 for r in found)
    mean = model.labels.mean()
    assert model.scores([b"", b""]).tolist() == [mean, mean]


def test_nothing_labelled_and_empty(spark, labelled):
    docs, labels = labelled
    model = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.predict(docs, model).collect()} == {0.5}
    assert quality.predict(cases.empty(spark), quality.fit(docs, labels)).collect() == []


def test_an_id_votes_once_however_often_it_repeats(spark):
    rows = [(1, f"text number {n} of one id", None, None, 0) for n in range(200)]
    rows += [(2, "another text", None, None, 0)]
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")
    docs = cases.frame(spark, rows).repartition(3)
    one, two = (quality.fit(docs, labels, max_labelled=2) for _ in range(2))
    assert sorted(one.labels.tolist()) == [0, 1] and len(one.vectors) == 2
    assert np.array_equal(one.vectors, two.vectors)
