"""Operator 13 against a dense eigendecomposition."""

import math

import numpy as np
import pytest

from tallyspark.llm import whiten
from tests.conftest import SF0001

SCHEMA = "vec_id long, embedding array<double>, x string, n int"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, "clash", 0) for i, v in vectors], SCHEMA)


def check(spark, df, count=4, column="embedding"):
    rows = whiten.integers(df, column)
    model = whiten.fit(rows, count)
    got = whiten.transform(rows, model).collect()
    usable = [(r["vec_id"], [math.floor(256 * c) for c in r[column]]) for r in df.collect()
              if r[column] and all(c is not None and math.isfinite(c) for c in r[column])]
    distinct = sorted({tuple(x) for _, x in usable})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    centred = np.array(distinct, float) - np.array(sums) / n
    e, vectors = np.linalg.eigh(centred.T @ centred / n)
    e, vectors = e[::-1], vectors.T[::-1]
    k = min(count, int((e > 1e-18 * e[0]).sum()))
    by_component = {}
    for r in got:
        by_component.setdefault(r.component, []).append(r)
    assert sorted(by_component) == list(range(1, len(model.components) + 1))
    for c, out in by_component.items():
        assert sorted(r.vec_id if r.vec_id is not None else -1 for r in out) == sorted(v if v is not None else -1 for v, _ in usable)
        assert {r.n for r in out} == {n}
        exact = sorted((v if v is not None else -1, sum((n * a - b) ** 2 for a, b in zip(x, sums))) for v, x in usable)
        assert sorted((r.vec_id if r.vec_id is not None else -1, r.deviation) for r in out) == exact
        assert {round(r.explained / (e[c - 1] / e.sum()), 10) for r in out} == {1.0}
        assert all(0 <= r.identity_error <= 1e-9 for r in out)
    return model, by_component, e, vectors, dict(usable), np.array(sums) / n


def same_up_to_sign(model, vectors, e, by_component, usable, mean):
    for c, out in by_component.items():
        v = vectors[c - 1]
        assert abs(abs(model.components[c - 1] @ v) - 1) < 1e-9
        sign = np.sign(model.components[c - 1] @ v)
        for r in out:
            assert r.whitened == pytest.approx(sign * (np.array(usable[r.vec_id]) - mean) @ v / math.sqrt(e[c - 1]), abs=1e-8)


def test_spread_vectors_with_bad_rows(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, (rng.standard_normal(12) * np.linspace(2, 1, 12)).tolist()) for i in range(300)]
    vectors += [(1000 + i, vectors[5][1]) for i in range(200)]  # a hot vector counts once
    vectors += [(2000, None), (2001, []), (2002, [None] * 12), (2003, [math.nan] * 12), (2004, [1.0] * 11 + [math.inf]), (2005, [-0.0] * 12)]
    model, out, e, dense, usable, mean = check(spark, frame(spark, vectors))
    same_up_to_sign(model, dense, e, out, usable, mean)
    assert len(out) == 4


def test_close_and_large_and_wide(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 90)) * 1000
    model, out, e, dense, usable, mean = check(spark, frame(spark, list(enumerate(base.tolist()))))  # more dimensions than rows
    same_up_to_sign(model, dense, e, out, usable, mean)
    assert len(out) == 4


def test_falling_spectrum_stops_early(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((400, 60)) * np.array([400.0, 200, 100, 50, 25] + [0.1] * 55)
    model, out, e, dense, usable, mean = check(spark, frame(spark, list(enumerate(base.tolist()))))
    same_up_to_sign(model, dense, e, out, usable, mean)
    assert model.steps < 60


def test_repeated_eigenvalues(spark):
    """Plus and minus each axis: every direction has the same variance; the components still are orthonormal and white."""
    axes = [(i, [float(3 * s * (k == i % 6)) for k in range(6)]) for i in range(12) for s in [1 if i < 6 else -1]]
    model, out, e, _, _, _ = check(spark, frame(spark, axes))
    assert np.allclose(model.components @ model.components.T, np.eye(4), atol=1e-12)
    assert len(out) == 4


def test_low_rank_ties_nulls_and_nothing(spark):
    line = [(i, [float(i), 2.0 * i, 5.0]) for i in range(9)] + [(None, [1.0, 2.0, 5.0]), (3, [4.0, 8.0, 5.0])]
    rows = whiten.integers(frame(spark, line))
    out = whiten.transform(rows, whiten.fit(rows)).collect()
    assert {r.component for r in out} == {1} and len(out) == 11 and all(abs(r.explained - 1) < 1e-12 for r in out)
    one = whiten.integers(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]))
    assert whiten.transform(one, whiten.fit(one)).count() == 0
    none = whiten.integers(frame(spark, [(1, None)]))
    assert whiten.fit(none) is None and whiten.transform(none, None).count() == 0


def test_lengths_and_range(spark):
    odd = whiten.integers(frame(spark, [(1, [1.0, 2.0]), (2, [0.5, 1.0]), (3, [1.0]), (4, [1e300, -1e300])]))
    assert {r.vec_id: list(r.x) for r in odd.collect()} == {1: [256, 512], 2: [128, 256], 4: [9223372036854774784, -9223372036854774784]}
    model = whiten.Whitening(1 << 20, [0], np.ones((1, 1)), np.ones(1), 1.0, 0.0, 1)
    assert whiten.deviations(np.array([[3], [1 << 20]]), model) == [9 << 40, None]


def test_given_table(spark):
    model, out, e, dense, usable, mean = check(spark, spark.read.parquet(f"{SF0001}/embeddings.parquet"))
    same_up_to_sign(model, dense, e, out, usable, mean)
