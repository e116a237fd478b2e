"""The classifier: held-out accuracy, walking against a plain walk, odd rows."""

import numpy as np
import pytest

from jobsieve.llm import quality_trees as Q

SF = "/root/testdata/sf0.01"


def walk(model, row):
    total = model.base
    for feature, threshold, left, value in zip(model.feature, model.threshold, model.left, model.value):
        node = 0
        while left[node]:
            node = left[node] + (row[feature[node]] > threshold[node])
        total += value[node]
    return 1 / (1 + np.exp(-total))


def test_fit_and_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, len(Q.FEATURES)))
    y = ((x[:, 0] > 0.3) ^ (x[:, 5] > 0)).astype(float)
    model = Q.fit(x, y)
    scores = model.scores(x)
    assert ((scores > 0.5) == (y > 0)).mean() > 0.97
    assert scores[:40] == pytest.approx([walk(model, r) for r in x[:40]])


def test_without_labels_or_with_one_label():
    none = Q.fit(np.zeros((0, len(Q.FEATURES))), np.zeros(0))
    assert none.scores(np.zeros((3, len(Q.FEATURES)))) == pytest.approx([0.5] * 3)
    one = Q.fit(np.zeros((9, len(Q.FEATURES))), np.ones(9))
    assert one.scores(np.zeros((1, len(Q.FEATURES))))[0] > 0.9


def test_features():
    x = Q.features([None, "", " \n", "The cat. THE cat\n\nthe | dog!", "é" * 50, "a" * 300_000])
    assert x.shape == (6, len(Q.FEATURES)) and np.isfinite(x).all()
    by = dict(zip(Q.FEATURES, x[3]))
    assert by["words"] == pytest.approx(np.log1p(7)) and by["lines"] == pytest.approx(np.log1p(2))
    assert by["capital_words"] == pytest.approx(1 / 7) and by["bars"] > 0 and by["exclamations"] > 0
    assert dict(zip(Q.FEATURES, x[4]))["non_ascii"] == 1


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = Q.document_quality(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (Q.fold_of(r.doc_id) == 0) for r in rows)
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_labels_of_the_held_out_fold_are_not_used(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - quality else quality end as quality")
    a, b = Q.train(docs, labels), Q.train(docs, turned)
    assert np.array_equal(a.value, b.value) and np.array_equal(a.threshold, b.threshold)


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(None, None, "s"), (1, "", "s"), (2, "word " * 50_000, None), (3, "fine text here", "s"), (3, "fine text here", "s")],
        "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 0), (3, 1), (3, 0), (2, 1), (2, 1), (None, 1)], "doc_id long, quality int")
    rows = Q.document_quality(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    kept = Q.kept_documents(docs, labels, 0.0)
    assert kept.schema == docs.schema and kept.count() == 5
    assert Q.document_quality(docs.limit(0), labels).count() == 0
    assert Q.document_quality(docs, labels.limit(0)).count() == 5
