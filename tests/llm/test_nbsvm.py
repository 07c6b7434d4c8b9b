"""Operator 5: held-out accuracy, determinism, odd rows."""

import zlib

import numpy as np
import pytest

from tallyspark.llm import nbsvm

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def scored(spark):
    from tallyspark.llm.queries import op5_nb_svm

    return {r.doc_id: r for r in op5_nb_svm(spark, SF).collect()}


def test_held_out_accuracy(spark, scored):
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in scored.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in scored.values())
    held = [(x.quality, scored[x.doc_id].predicted) for x in labels if scored[x.doc_id].held_out]
    good = [p for q, p in held if q == 1]
    bad = [p for q, p in held if q == 0]
    assert sum(good) / len(good) >= 0.98
    assert sum(q == p for q, p in held) / len(held) >= 0.95
    assert sum(bad) / len(bad) <= 0.35


def test_only_texts_and_labels_of_the_learning_fold_count(spark):
    docs = [(i, f"fine words number {i % 7}" if i % 3 else f"junk $$$ {i % 7} $$$") for i in range(200)]
    labels = [(i, int(bool(i % 3))) for i in range(200)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    base = nbsvm.train(frame, spark.createDataFrame(labels, "doc_id long, quality int"))
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in labels]
    flipped += [(None, 0), (5, None), (10**6, 0)]
    again = nbsvm.train(frame.repartition(5), spark.createDataFrame(flipped, "doc_id long, quality int"))
    assert np.array_equal(base[0], again[0]) and base[1:] == again[1:]
    rows = docs[:9] + [(None, None), (1, ""), (2, " \n"), (3, "long " * 50_000), docs[0]]
    wide = spark.createDataFrame([(*r, 0.5, "x") for r in rows], "doc_id long, text string, score double, extra string")
    out = nbsvm.score(wide, base)
    got = out.collect()
    assert len(got) == len(rows) and out.columns == ["doc_id", "text", "extra", "score", "held_out", "predicted"]
    assert [r.predicted for r in got[:9]] == [int(bool(i % 3)) for i in range(9)]
    empty = [r.score for r in got if not (r.text or "").strip()]
    assert len(empty) == 3 and empty[0] == empty[1]
    assert nbsvm.score(wide.limit(0), base).count() == 0


def test_one_class_and_no_labels(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    one = nbsvm.train(docs, spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int"))
    assert all(r.score > 0.99 for r in nbsvm.score(docs, one).collect())
    none = nbsvm.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in nbsvm.score(docs, none).collect()} == {0.5}


def test_features_do_not_depend_on_neighbours():
    texts = [b"same same", b"same", b"", b"x same", None, b"same same"]
    alone = [nbsvm.features([t])[0].tolist() for t in texts]
    assert [f.tolist() for f in nbsvm.features(texts)] == alone


def test_bound_holds_for_the_rows_that_are_fitted(spark, monkeypatch):
    """500 texts under one labelled id: no more than the bound are fitted, whatever the partitioning."""
    docs = [(i, f"good fine text {i}" if i % 2 else f"bad poor junk {i}") for i in range(60)] + [(1, f"good fine text again {i}") for i in range(500)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    one = nbsvm.train(frame.repartition(3), labels, sample=100)
    two = nbsvm.train(frame.repartition(7), labels, sample=100)
    assert np.array_equal(one[0], two[0]) and one[1:] == two[1:]
    few = nbsvm.train(frame, labels, sample=2)
    assert not np.array_equal(one[0], few[0])
