"""Operators 2 and 3 against brute force, with small windows and forced crowds."""

import hashlib
import random
import re
from collections import Counter

import pytest

from tallyspark.llm import suffix_merge, suffix_tree
from tallyspark.llm.repeats import common_prefix, front_coded, reach

SCHEMA = "doc_id long, text string, n_words string, pid int, blob string"


def corpus(seed: int) -> list[str | None]:
    r = random.Random(seed)
    word = lambda: r.choice(["ab", "ba", "é", "the", "b", "x,", "THE", "zz"])
    shared = [" ".join(word() for _ in range(40)) for _ in range(4)]
    texts: list[str | None] = [None, "", " \t\n", "a", "ab " * 120, "x" * 300, " é " * 30]
    for _ in range(50):
        parts = [" ".join(word() for _ in range(r.randrange(30))) for _ in range(3)]
        for _ in range(r.randrange(3)):
            s = r.choice(shared)
            parts.insert(r.randrange(len(parts)), s[r.randrange(20) :])
        texts.append(r.choice([" ", "\n", "\t "]).join(parts))
    return texts + texts[-6:]


def brute_bytes(texts, window):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + window] for d in data for i in range(len(d) - window + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - window + 1):
            if seen[d[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        kept = bytes(x for x, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def brute_words(texts, window):
    data = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(d[i : i + window]) for d in data for i in range(len(d) - window + 1))
    out = []
    for d in data:
        gone = [0] * len(d)
        for i in range(len(d) - window + 1):
            if seen[tuple(d[i : i + window])] > 1:
                gone[i : i + window] = [1] * window
        kept = " ".join(x for x, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 7, "clash") for i, t in enumerate(texts)], SCHEMA).repartition(3)


@pytest.mark.parametrize("seed,window,crowd", [(1, 25, 20_000), (2, 25, 1), (3, 40, 3), (4, 7, 2)])
def test_bytes_match_brute_force(spark, seed, window, crowd):
    texts = corpus(seed)
    rows = suffix_merge.remove_repeats(frame(spark, texts), window, crowd).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    assert [got[i] for i in range(len(texts))] == brute_bytes(texts, window)
    assert all(hashlib.sha256(bytes(r.kept_text)).hexdigest() == r.kept_sha256 for r in rows)


@pytest.mark.parametrize("seed,window,crowd", [(1, 6, 20_000), (2, 6, 1), (3, 12, 2), (4, 3, 4)])
def test_words_match_brute_force(spark, seed, window, crowd):
    texts = corpus(seed)
    rows = suffix_tree.remove_repeated_words(frame(spark, texts), window, crowd).collect()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows}
    assert [got[i] for i in range(len(texts))] == brute_words(texts, window)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in rows)


def test_empty_table_nulls_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    none = spark.createDataFrame([], schema)
    assert suffix_merge.remove_repeats(none, 20).count() == 0
    assert suffix_tree.remove_repeated_words(none, 5).count() == 0
    rows = [(None, "one two three four five six"), (None, None), (3, "one two three four five six"), (3, "one two three four five six")]
    got = suffix_tree.remove_repeated_words(spark.createDataFrame(rows, schema), 5).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in got) == [(0, 0, 0), (0, 6, 6), (3, 6, 6), (3, 6, 6)]


def test_merge_orders_runs_and_shared_prefixes():
    r = random.Random(0)
    runs = [sorted("".join(r.choice("ab") for _ in range(r.randrange(1, 12))).encode() for _ in range(r.randrange(9))) for _ in range(7)]
    coded = []
    for run in runs:
        shared, sizes, rest = front_coded(run)
        coded.append((memoryview(shared).cast("H").tolist(), memoryview(sizes).cast("H").tolist(), rest))
        assert suffix_tree.unpack(coded[-1]) == run
    order, shared = suffix_merge.merge(coded)
    merged = [runs[i][j] for i, j in order]
    assert merged == sorted(x for run in runs for x in run)
    assert shared[1:] == [common_prefix(x, y) for x, y in zip(merged, merged[1:])]


def test_subtree_nodes_and_reach():
    w = lambda *x: b"".join(i.to_bytes(8, "big") for i in x)
    leaves = [w(1, 2, 3, 4), w(1, 2, 3, 5), w(1, 2, 9), w(1, 7)]
    assert [(d, i, j) for d, i, j, _ in suffix_tree.subtree(leaves)] == [(3, 0, 1), (2, 0, 2), (1, 0, 3)]
    left, right = reach([b"xyz", b"xya", b"xyz", b""], [0, 3, 2, 1], 1, 5)
    assert (left, right) == ([3, 2, 3, 0], [3, 3, 2, 0])
