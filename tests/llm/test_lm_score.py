"""Operator 1 against a plain model."""

import math
import re
from collections import Counter

import pytest

from tallyspark.llm import lm_score


def brute(docs, target):
    tokens = [(t, ["<s>", *re.findall(r"[^\x20\x09-\x0D]+", text or ""), "</s>"]) for t, text in ((d in target and d is not None, x) for d, x in docs)]
    uni, bi = (Counter(), Counter()), (Counter(), Counter())
    for t, w in tokens:
        uni[t].update(w[1:])
        bi[t].update(zip(w, w[1:]))
    n = [sum(u.values()) for u in uni]

    def log_p(m, v, w):
        p0 = (uni[0][w] + uni[1][w]) / sum(n)
        p1 = (uni[m][w] + lm_score.MU * p0) / (n[m] + lm_score.MU)
        before = uni[m]["</s>" if v == "<s>" else v]
        return math.log2((bi[m][v, w] + lm_score.KAPPA * p1) / (before + lm_score.KAPPA))

    out = []
    for _, w in tokens:
        ce = [-sum(log_p(m, *x) for x in zip(w, w[1:])) / (len(w) - 1) for m in (1, 0)]
        out.append((len(w) - 1, *ce, ce[0] - ce[1]))
    return out


def test_matches_plain_model(spark):
    docs = [(1, "the cat sat on the mat"), (2, "the dog sat"), (3, "buy now buy now"), (4, None), (5, ""), (None, "buy the cat"), (7, "the cat sat on the mat"), (7, "the cat sat on the mat"), (8, "a " * 3000)]
    target = spark.createDataFrame([(1, 1), (2, 1), (2, 1), (7, 0), (None, 1), (99, 1)], "doc_id long, quality int")
    rows = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, score string, pid int")
    got = lm_score.cross_entropy_difference(rows, target).collect()
    want = brute(docs, {1, 2, 7})
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    for g, (d, w) in zip(sorted((tuple(r) for r in got), key=key), sorted(zip((d for d, _ in docs), want), key=lambda x: (x[0] is None, x[0] or 0, x[1][0]))):
        assert g[0] == d and g[1] == w[0]
        assert g[2:] == pytest.approx(w[1:], abs=1e-9)


def test_rows_of_one_id_are_spread_and_keep_their_class(spark, monkeypatch):
    docs = [(i, f"w{k} x{k % 3} y") for i in (None, 7) for k in range(20)] + [(8, "w1 y")]
    seen, ask = [], lm_score.groups.ask
    monkeypatch.setattr(lm_score, "GROUP_BYTES", 300)
    monkeypatch.setattr(lm_score.groups, "ask", lambda base, *x: seen.append(base) or ask(base, *x))
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    out = lm_score.cross_entropy_difference(rows, spark.createDataFrame([(7,), (None,)], "doc_id long")).collect()
    for i in (None, 7):
        assert len({r.pid for r in seen[0].collect() if r.doc_id == i}) > 2
    want = sorted(((d[0], *w) for d, w in zip(docs, brute(docs, {7}))), key=lambda x: (x[0] or 0, x[1], round(x[2], 9), round(x[3], 9)))
    got = sorted((tuple(r) for r in out), key=lambda x: (x[0] or 0, x[1], round(x[2], 9), round(x[3], 9)))
    for g, w in zip(got, want, strict=True):
        assert g[:2] == w[:2] and g[2:] == pytest.approx(w[2:], abs=1e-8)


def test_no_target_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    assert len(lm_score.cross_entropy_difference(docs, none).collect()) == 2
    assert lm_score.cross_entropy_difference(docs.limit(0), none).count() == 0


def test_codes():
    import numpy as np

    v = np.array([0, 1, 254, 255, 256, 10**12])
    assert lm_score.large(lm_score.small(v)).tolist() == v.tolist()
    k = np.array([5, 6, 6 + 2**40, 2**55], np.uint64)
    assert lm_score.undeltas(lm_score.deltas(k)).tolist() == k.tolist()
