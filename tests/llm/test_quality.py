"""Held-out accuracy, the compiled columns against the plain model, and rows without text."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from repoloom.llm import quality
from repoloom.llm.common import table
from repoloom.llm.quality import STATISTICS, accepted, fit, quality_scores, statistics, text_statistics, train

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return train(table(spark, SF, "documents"), table(spark, SF, "labels"))


def test_held_out_accuracy(spark, model):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    scores = {r.doc_id: r for r in quality_scores(docs, model).collect()}
    assert len(scores) == docs.count() and all(0 <= r.score <= 1 for r in scores.values())
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in scores.items())
    rows = [(scores[r.doc_id].predicted, r.quality) for r in labels.collect() if scores[r.doc_id].held_out]
    assert len(rows) > 50 and np.mean([p == q for p, q in rows]) > 0.95


def test_labels_held_out_are_not_learnt(spark, model):
    labels = table(spark, SF, "labels")
    flipped = labels.withColumn("quality", quality.F.when(quality.held_out(), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    assert train(table(spark, SF, "documents"), flipped) == model


def test_columns_equal_the_plain_model(make_docs, odd_texts, model):
    docs = make_docs(odd_texts)
    got = {r.doc_id: r for r in quality_scores(docs, model).collect()}
    plain = model.plain_score(np.array([statistics(t or "") for t in odd_texts]))
    for i, p in enumerate(plain):
        assert got[i].score == pytest.approx(p) and got[i].predicted == int(p >= 0.7)
    measured = {r.id: r for r in text_statistics(docs).collect()}
    assert [measured[9][s] for s in STATISTICS] == pytest.approx(statistics(odd_texts[9]))
    assert quality_scores(docs.where("false"), model).count() == 0


def test_accepted_keeps_rows_as_they_are(make_docs, odd_texts, model):
    docs = make_docs(odd_texts)
    kept = accepted(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality_scores(docs, model).where("predicted = 1").collect()}


def test_few_labels(spark, make_docs):
    docs = make_docs(["a b c", "d e f", None])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_scores(docs, train(docs, none)).collect()} == {0.5}
    one = spark.createDataFrame([(0, 1), (0, 1), (1, 1), (2, None), (9, 0)], "doc_id long, quality int")
    assert all(r.score > 0.5 for r in quality_scores(docs, train(docs, one)).collect())


def test_rules_learn_a_conjunction():
    draw = np.random.default_rng(0)
    x = draw.random((3000, len(STATISTICS)))
    y = ((x[:, 2] > 0.4) & (x[:, 5] <= 0.7)).astype(float)
    found = fit(x, y)
    assert ((found.plain_score(x) > 0.5) == y).mean() > 0.97 and len(found.rules) < 80
