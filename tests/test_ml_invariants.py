"""Invariants for the non-SQL operators (k-means, regression, approximate quartiles)."""

import hashlib
from decimal import Decimal

import numpy as np
from pyspark.sql import functions as F

from tallyspark.functions.exprs import SEG_DEEP_DISCOUNT, SEG_FULL_PRICE, SEG_MIXED, SEG_PREMIUM, SEG_SMALL
from tallyspark.operators import kmeans, profile, regress, segment
from tallyspark.registry import Star

SF = "/root/testdata/sf0.001"


def test_order_segmentation_invariants(spark):
    st = Star(spark, SF)
    seg = segment.order_segmentation(st.orders_og, st.products, k_range=range(2, 5), n_init=2, max_iter=10)
    n_in = segment.load_order_features(st.orders_og, st.products).count()
    rows = seg.segments.select("order_id", "segment_id", "segment_label").collect()
    assert len(rows) == n_in == len({r.order_id for r in rows})
    assert {r.segment_label for r in rows} <= {SEG_DEEP_DISCOUNT, SEG_FULL_PRICE, SEG_PREMIUM, SEG_SMALL, SEG_MIXED}
    assert {r.segment_id for r in rows} == set(range(seg.best_k))
    sweep = seg.sweep.orderBy("k").collect()
    assert [r.k for r in sweep] == [2, 3, 4] and sum(r.selected for r in sweep) == 1


def _lloyd(x, centres, most):
    for _ in range(most):
        near = ((x[:, None] - centres) ** 2).sum(axis=2).round(9).argmin(axis=1)
        moved = np.array([x[near == c].mean(axis=0) if (near == c).any() else centres[c] for c in range(len(centres))])
        if np.abs(moved - centres).max() <= 1e-9:
            break
        centres = moved
    d = ((x[:, None] - centres) ** 2).sum(axis=2)
    near = d.round(9).argmin(axis=1)
    return centres, near, d[np.arange(len(x)), near].sum()


def _silhouette(x, near):
    """All pairs of rows, as the definition has it."""
    d = ((x[:, None] - x) ** 2).sum(axis=2)
    out = []
    for i, c in enumerate(near):
        mine = near == c
        if mine.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, mine].sum() / (mine.sum() - 1)
        b = min(d[i, near == o].mean() for o in set(near) - {c})
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return float(np.mean(out))


def test_many_models_at_once_equal_one_at_a_time(spark):
    """Starts, centres, inertia, silhouette and assignment against plain numpy, with repeated rows and a lone outlier."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.6, (40, 3)) for c in ((0, 0, 0), (4, 0, 1), (0, 5, 2))] + [np.full((1, 3), 30.0), np.ones((25, 3))])
    keys = [f"k{i:03d}" for i in range(len(x))]
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in zip(keys, x)], "key string, x array<double>").repartition(5)
    ks, n_init, most = [2, 3, 4], 3, 20
    starts = []
    for r in range(n_init):
        first = min(range(len(x)), key=lambda i: (hashlib.md5(f"{r}:{keys[i]}".encode()).hexdigest(), keys[i]))
        chosen = [first]
        while len(chosen) < max(ks):
            d = ((x[:, None] - x[chosen]) ** 2).sum(axis=2).min(axis=1).round(9)
            chosen.append(min(range(len(x)), key=lambda i: (-d[i], keys[i])))
        starts.append(x[chosen])
    assert np.allclose(kmeans.starts(rows, n_init, max(ks)), starts)
    best, scores, scans = kmeans.sweep(rows, ks, n_init, most)
    assert scans <= most
    for model, score in zip(best, scores):
        plain = [_lloyd(x, s[: model.k], most) for s in starts]
        want = min(range(n_init), key=lambda r: (round(plain[r][2], 4), r))
        assert model.restart == want and np.allclose(model.centres, plain[want][0]) and abs(model.inertia - plain[want][2]) < 1e-6
        assert abs(score - _silhouette(x, plain[want][1])) < 1e-9
        got = {r.key: r.segment_id for r in kmeans.assign(rows, model).collect()}
        assert got == dict(zip(keys, plain[want][1].tolist()))
    assert kmeans.sweep(rows.limit(0), ks, n_init, most) == ([], [], 0)


def test_one_hot_places_equal_the_full_vectors(spark):
    """Rows given by the places of their ones get the sweep, starts and segments of their full vectors, in any order of rows."""
    rng = np.random.default_rng(5)
    on = np.stack((rng.integers(0, 3, 90), 3 + rng.integers(0, 2, 90)), axis=1)
    on[:5] = (0, 3), (1, 4), (2, 3), (0, 4), (1, 3)
    x = rng.integers(-2, 3, (90, 2)).astype(float)  # few values, so distances tie
    block = np.zeros((90, 5))
    np.put_along_axis(block, on, 1, axis=1)
    keys = [f"k{i:02d}" for i in range(90)]
    short = spark.createDataFrame([(k, v.tolist(), o.tolist()) for k, v, o in zip(keys, x, on)], "key string, x array<double>, on array<int>").repartition(3)
    full = spark.createDataFrame([(k, v.tolist()) for k, v in zip(keys, np.concatenate((x, block), axis=1))], "key string, x array<double>").repartition(4)
    assert np.array_equal(kmeans.starts(short, 2, 4), kmeans.starts(full, 2, 4))
    got, want = kmeans.sweep(short, [2, 4], 2, 15), kmeans.sweep(full, [2, 4], 2, 15)
    assert np.allclose(got[1], want[1])
    for a, b in zip(got[0], want[0]):
        assert a.restart == b.restart and np.allclose(a.centres, b.centres) and abs(a.inertia - b.inertia) < 1e-9
        assert {(r.key, r.segment_id) for r in kmeans.assign(short, a).collect()} == {(r.key, r.segment_id) for r in kmeans.assign(full, b).collect()}


def test_boxes_settle_blocks_and_lose_no_centre(spark, monkeypatch):
    """A row's nearest centre is always among its block's rivals; most blocks of near rows have one rival a model; equal rows part."""
    monkeypatch.setattr(kmeans, "BLOCK", 16)
    rng = np.random.default_rng(9)
    x, on = rng.normal(size=(6000, 2)).round(2), rng.integers(0, 2, (6000, 1))
    data = [(None if i == 7 else f"k{i}", v.tolist(), o.tolist()) for i, (v, o) in enumerate(zip(x, on))]
    rows = spark.createDataFrame(data, "key string, x array<double>, on array<int>")
    packed = kmeans.pack(kmeans.spread(rows).coalesce(2)).toArrow().combine_chunks().to_batches()[0]
    centres = np.concatenate((rng.normal(size=(5, 2)), rng.random((5, 2))), axis=1)
    tools, edges, alone, seen = kmeans._tools(), [0, 2, 5], 0, 0
    for at, boxes, kind in tools.alike(packed):
        form = tools.form_of(kind, centres, (centres**2).sum(axis=1), 4)
        rivals = tools.rivals(boxes, form, edges)
        alone += (rivals.sum(axis=1) == 2).sum()
        for i, b in enumerate(at.tolist()):
            some = tools.matrix(packed["block"][b], 4)
            near = tools.nearest(tools.apart(some, form), edges)
            assert some.shape[1] <= 16 and (rivals[i] >= near.any(axis=1)).all()
            seen += some.shape[1]
    assert seen == 6000 and alone > packed.num_rows / 2
    best, scores, _ = kmeans.sweep(rows, [2, 3], 2, 8)
    plain, want, _ = kmeans.sweep(rows.repartition(3), [2, 3], 2, 8)
    assert np.allclose(scores, want) and all(np.allclose(a.centres, b.centres) for a, b in zip(best, plain))
    same = spark.createDataFrame([(f"k{i}", [1.0]) for i in range(2000)], "key string, x array<double>")
    assert max(map(len, kmeans.spread(same).rdd.glom().collect())) < 1000


def test_blocks_are_full_and_inertia_follows_from_their_sums(spark, monkeypatch):
    """Small Arrow batches do not cut blocks; short blocks count nowhere twice; inertia equals the rows' own distances."""
    monkeypatch.setattr(kmeans, "BLOCK", 16)
    monkeypatch.setattr(kmeans, "SLICE", 50)
    rng = np.random.default_rng(3)
    x, on = rng.normal(size=(3001, 2)), rng.integers(0, 2, (3001, 1))
    rows = spark.createDataFrame([(f"k{i}", v.tolist(), o.tolist()) for i, (v, o) in enumerate(zip(x, on))], "key string, x array<double>, on array<int>")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        packed = kmeans.pack(kmeans.spread(rows).coalesce(1)).toArrow()
        best, scores, _ = kmeans.sweep(rows, [3], 2, 5)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert packed.num_rows <= 3001 / 16 + 2
    full = np.concatenate((x, on == 0, on == 1), axis=1).astype(float)
    d = ((full[:, None] - best[0].centres) ** 2).sum(axis=2)
    assert abs(best[0].inertia - d.min(axis=1).sum()) < 1e-6 and abs(scores[0] - _silhouette(full, d.argmin(axis=1))) < 1e-9


def test_order_segmentation_moves_features_only(spark, monkeypatch):
    written, plain = {}, segment.materialize
    monkeypatch.setattr(segment, "materialize", lambda frame, name: written.setdefault(name, plain(frame, name)))
    st = Star(spark, SF)
    seg = segment.order_segmentation(st.orders_og, st.products, k_range=range(2, 4), n_init=1, max_iter=3)
    assert written["order-features"].columns == ["key", "x", "on"]
    assert seg.segments.count() == written["order-features"].count()


def test_linear_model_against_dense_least_squares(spark):
    """Collinear and constant columns, a level unseen in training, doubles and decimals."""
    rng = np.random.default_rng(8)
    rows = [(Decimal(int(a)) / 100, float(b), 7, "xyz"[i % 3], Decimal(int(y)) / 10000) for i, (a, b, y) in enumerate(
        zip(rng.integers(0, 10**6, 90), rng.integers(0, 50, 90) / 8, rng.integers(-9000, 9000, 90)))]
    rows = [(a, b, c, Decimal(2) * a, lv, y) for a, b, c, lv, y in rows]
    schema = "a decimal(12,2), b double, c int, twice decimal(14,2), level string, y decimal(6,4)"
    model = regress.fit_linear(spark.createDataFrame(rows, schema), ["a", "b", "c", "twice"], ["level"], "y")
    dense = np.array([[1, float(a), b, lv == "y", lv == "z"] for a, b, _, _, lv, _ in rows], float)
    beta, *_ = np.linalg.lstsq(dense, np.array([float(r[-1]) for r in rows]), rcond=None)
    test = spark.createDataFrame([*rows, (Decimal(1), 2.0, 7, Decimal(2), "new", Decimal(0))], schema).select(model.predict().alias("p"))
    assert np.allclose([r.p for r in test.collect()], np.concatenate((dense, [[1, 1, 2, 0, 0]])) @ beta, atol=1e-9)
    empty = regress.fit_linear(spark.createDataFrame([], schema), ["a"], ["level"], "y")
    assert empty.constant == 0 and empty.levels == {"level": {}}


def test_linear_regression_metrics_sane(spark):
    st = Star(spark, SF)
    m = regress.run(st.orders_og, st.products, "linear").first()
    assert m.rmse > 0 and m.mae > 0 and m.r2 <= 1.0 and m.baseline_rmse > 0
    assert m.rmse < m.baseline_rmse * 1.10


def test_training_rows_stay_in_bounded_partitions(spark, monkeypatch):
    monkeypatch.setattr(regress, "PART_ROWS", 100)
    rows = regress.bounded(spark.range(0, 1050, 1, 2))
    assert rows.rdd.getNumPartitions() == 11 and max(map(len, rows.rdd.glom().collect())) <= 130 and rows.count() == rows.distinct().count() == 1050
    assert regress.bounded(spark.range(0, 50, 1, 3)).rdd.getNumPartitions() == 3


def test_approx_quartiles_close_to_exact(spark):
    orders = Star(spark, SF).orders
    approx = {r.column_name: r for r in profile.describe_quartiles_approx(orders, ["sales", "delivery_days"]).collect()}
    n = orders.count()
    values = sorted(r[0] for r in orders.select(F.col("sales").cast("double")).collect())
    for q, key in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75")):
        rank = sum(v <= getattr(approx["sales"], key) for v in values)
        assert abs(rank - q * n) <= n * 0.001 + 1, (q, rank)


def test_shared_tables_follow_their_files(spark, tmp_path):
    from tallyspark.plans.materialize import shared
    from tallyspark.sources.tables import Tables

    built = []

    def build():
        built.append(1)
        return spark.range(3)

    t = Tables(spark, str(tmp_path))
    spark.range(5).write.parquet(t.path("orders"))
    for _ in range(2):
        assert shared(spark, ("x", *t.fingerprint("orders")), build).count() == 3
    assert len(built) == 1
    spark.range(6).write.mode("overwrite").parquet(t.path("orders"))
    shared(spark, ("x", *t.fingerprint("orders")), build)
    assert len(built) == 2
