"""Operator 6: recall and exact scores against brute force; odd vectors."""

import itertools
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa

from tallyspark.llm import curve_search, hilbert


def brute(ids, x, every, k):
    out = {}
    for i in [i for i in range(len(ids)) if ids[i] % every == 0]:
        s = x @ x[i]
        order = sorted((j for j in range(len(ids)) if ids[j] != ids[i]), key=lambda j: (-round(s[j], 12), ids[j]))
        out[ids[i]] = [(ids[j], s[j]) for j in order[:k]]
    return out


def run(spark, rows, **kw):
    frame = spark.createDataFrame([(i, v, 1, 0.0) for i, v in rows], "vec_id long, embedding array<float>, rank int, score double").repartition(3)
    got = defaultdict(list)
    for r in curve_search.nearest(frame, **kw).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    return {q: [x[1:] for x in sorted(v)] for q, v in got.items()}


def test_recall_and_exact_scores(spark):
    g = np.random.default_rng(1)
    x = g.standard_normal((3000, 24)).astype("f4")
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("f8")
    x *= g.uniform(0.5, 2.0, (3000, 1))  # unequal lengths
    x = x.astype("f4").astype("f8")
    got = run(spark, [(i, v.tolist()) for i, v in enumerate(x)], every=20, k=20)
    want = brute(list(range(3000)), x, 20, 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    found = sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want)
    assert found / (20 * len(want)) >= 0.9
    assert all(abs(s - x[q] @ x[i]) < 1e-12 for q, v in got.items() for i, s in v)
    assert all(v == sorted(v, key=lambda z: (-z[1], z[0])) for v in got.values())


def test_ties_copies_and_odd_vectors(spark):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(60, 0, -1)] + [(i, [0.0, 1.0, float(i)]) for i in range(100, 110)]
    odd = [(200, None), (220, [0.0, 0.0, 0.0]), (240, [1.0, None, 2.0]), (260, [float("nan"), 1.0, 1.0]), (280, [float("inf"), 0.0, 0.0]), (300, [1.0, 2.0]), (None, [1.0, 0.0, 0.0])]
    got = run(spark, rows + odd, every=20, k=5)
    want = brute([i for i, _ in rows], np.array([v for _, v in rows]), 20, 5)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_repeated_rows_are_rows(spark):
    a, b, c = [1.0, 0.0], [0.5, 0.5], [0.0, 2.0]
    rows = [(20, a)] * 3 + [(20, b)] + [(3, a)] * 2 + [(5, c), (1, b), (40, c)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = sorted(tuple(r) for r in curve_search.nearest(frame, every=20, k=5).collect())
    want = []
    for i, (q, v) in enumerate(rows):
        if q % 20 == 0:
            others = sorted((-float(np.dot(v, x)), j) for n, (j, x) in enumerate(rows) if n != i)
            want += [(q, r, j, -s) for r, (s, j) in enumerate(others[:5], 1)]
    assert got == sorted(want)
    many = spark.createDataFrame([(20, a)] * 60 + [(21, a)] * 30, "vec_id long, embedding array<float>")
    assert [tuple(r) for r in curve_search.nearest(many, k=5).distinct().orderBy("rank").collect()] == [(20, r, 20, 1.0) for r in range(1, 6)]
    assert curve_search.nearest(many, k=5).count() == 300


def test_lengths_beyond_a_double(spark):
    rows = [(0, [1e-200, 2e-200]), (20, [1e200, -1e200]), (40, [1.7e308, 1.7e308]), (60, [5e-324, 0.0]), (7, [1.0, 3.0]), (9, [-1e200, 1e200]), (11, [2.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in curve_search.nearest(frame, every=20, k=20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    inf = float("inf")
    assert set(got) == {0, 20, 40, 60} and all(len(v) == 6 for v in got.values())
    assert got[20][0] == (11, 1e200) and got[20][-1] == (9, -inf) and dict(got[20])[40] == 0.0 and dict(got[20])[7] == -2e200
    assert got[40][:2] == [(7, inf), (11, inf)] and dict(got[40])[0] == 1e-200 * 1.7e308 + 2e-200 * 1.7e308
    assert [i for i, _ in got[60]] == [40, 20, 11, 7, 0, 9] and dict(got[60])[7] == 5e-324 and dict(got[60])[0] == 0.0


def test_recall_on_the_table_of_embeddings(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    table = frame.select("vec_id", "embedding").toArrow()
    ids = table["vec_id"].to_pylist()
    want = brute(ids, np.array(table["embedding"].to_pylist(), "f8"), 20, 20)
    got = defaultdict(set)
    for r in curve_search.nearest(frame, every=20, k=20).collect():
        got[r.query_id].add(r.vec_id)
    assert got.keys() == want.keys()
    assert sum(len(got[q] & {i for i, _ in want[q]}) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_few_rows_and_none(spark):
    assert run(spark, [(0, [1.0, 2.0]), (1, [2.0, 1.0])], every=20, k=20) == {0: [(1, 4.0)]}
    assert run(spark, [(20, [1.0, 2.0])], every=20, k=20) == {}
    assert run(spark, [], every=20, k=20) == {}


def test_scores_of_many_queries_take_bounded_memory():
    g = np.random.default_rng(2)
    table = lambda n: pa.table({"cid": np.arange(n), "rank": np.arange(n), "vector": list(g.standard_normal((n, 4)))})
    q, x = table(4000), table(2000)
    tracemalloc.start()
    got = curve_search._best(q, x, 3, 100)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.num_rows == 4000 and peak < 30 << 20  # the whole matrix has 64 MB


def test_queries_of_a_block_are_dealt(spark, monkeypatch):
    rows = [(c, i, i, i % 2 == 0, [float(i)]) for c in (0, 1) for i in range(400)]
    index = spark.createDataFrame(rows, "curve int, cid long, rank long, query boolean, vector array<double>")
    monkeypatch.setattr(curve_search, "BLOCK", 50)
    monkeypatch.setattr(curve_search, "QUERIES", 20)
    wanted, dealt = curve_search.deal(index, 60)
    parts = defaultdict(lambda: ([], []))
    for side, frame in enumerate((wanted, dealt)):
        for r in frame.collect():
            parts[r.curve, r.block, r.part][side].append((r.cid, r.rank))
    assert max(len(q) for q, _ in parts.values()) <= 40 and max(len(x) for _, x in parts.values()) <= 50
    met = [(c, q, x) for (c, _, _), (qs, xs) in parts.items() for q, _ in qs for x, _ in xs]
    near = {(c, q, x) for c in (0, 1) for q in range(0, 400, 2) for x in range(1, 400, 2) if abs(q - x) <= 60}
    assert len(met) == len(set(met)) and near <= set(met)


def test_curve_visits_neighbouring_cells():
    for dims, bits in ((2, 3), (3, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = hilbert.keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        path = cells[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
