"""Operator 9 against brute force; components; wide regions."""

import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import lsh_forest
from tallyspark.llm.components import components

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def sets_of(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def roots(n, pairs):
    home = list(range(n))

    def find(i):
        while home[i] != i:
            i = home[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        home[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcde") for _ in range(4))
    texts = [None, "", " ", "one", "ONE", "two words", "two  Words", "a b c d e"]
    for _ in range(25):
        base = [word() for _ in range(r.choice([20, 60, 200]))]
        for _ in range(r.choice([1, 2, 8])):
            copy = list(base)
            for _ in range(r.randrange(4)):
                copy[r.randrange(len(copy))] = word()
            texts.append(r.choice([" ", "\n"]).join(copy))
    chain = [word() for _ in range(150)]
    for i in range(30):  # neighbours are alike, ends are not
        chain = chain[3:] + [word() for _ in range(3)]
        texts.append(" ".join(chain))
    return texts + texts[-3:]


@pytest.mark.parametrize("seed,percent,members,wide", [(1, 85, 20_000, 1_000), (2, 80, 2, 2)])
def test_matches_brute_force(spark, monkeypatch, seed, percent, members, wide):
    monkeypatch.setattr(lsh_forest, "MEMBERS", members)
    texts = corpus(seed)
    s = sets_of(texts)
    pairs = [(i, j) for i in range(len(s)) for j in range(i) if s[i] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j])]
    want = roots(len(texts), pairs)
    ids = list(range(100, 100 + len(texts)))
    rows = spark.createDataFrame([(i, t, 5, "clash") for i, t in zip(ids, texts)], "doc_id long, text string, node int, region string").repartition(3)
    got = {r.doc_id: r for r in lsh_forest.near_duplicates(rows, percent).collect()}
    assert [(got[i].n_shingles, got[i].component_id, got[i].kept) for i in ids] == [(len(x), w + 100, w + 100 == i) for x, w, i in zip(s, want, ids)]


def test_null_and_repeated_ids_and_empty_table(spark):
    text = "one two three four five six seven eight"
    rows = [(None, text), (4, text), (4, text), (2, "alone in here"), (None, "nothing like the others at all"), (None, None)]
    got = lsh_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in got) == [
        (-1, 0, -1, True), (-1, 2, -1, True), (-1, 4, 4, False), (2, 1, 2, True), (4, 4, 4, True), (4, 4, 4, True)]
    assert lsh_forest.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("wide,cell", [(1_000, 4_000), (3, 4_000), (3, 7)])
def test_wide_regions_lose_no_link(spark, monkeypatch, wide, cell):
    """Edited copies around the threshold, in regions wider than WIDE; the rest stays alone."""
    monkeypatch.setattr(lsh_forest, "WIDE", wide)
    monkeypatch.setattr(lsh_forest, "CELL", cell)
    r = random.Random(11)
    base = [f"w{i}" for i in range(250)]
    texts = []
    for i in range(120):
        copy = list(base)
        for j, at in enumerate(r.sample(range(250), 1 + i % 5)):
            copy[at] = f"x{i}.{j}"
        texts.append(" ".join(copy))
    s = sets_of(texts)
    pairs = [(i, j) for i in range(len(s)) for j in range(i) if 100 * len(s[i] & s[j]) >= 85 * len(s[i] | s[j])]
    want = roots(len(texts), pairs)
    got = {x.doc_id: x.component_id for x in lsh_forest.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    assert got == dict(enumerate(want)) and 1 < len(set(want)) < len(texts)


@pytest.mark.parametrize("cell", [4_000, 7, 1])
def test_wide_pairs_are_all_that_could_link_each_once(spark, monkeypatch, cell):
    monkeypatch.setattr(lsh_forest, "CELL", cell)
    r = random.Random(3)
    base = list(range(100))
    sets = []
    for i in range(50):
        x = set(base)
        for at in r.sample(base, 4 + i % 9):
            x.remove(at)
            x.add(1000 * (i + 1) + at)
        sets.append(sorted(x))
    root = [0 if i < 20 else i for i in range(50)]
    one = lsh_forest.signatures([np.array(x, np.uint64) for x in sets])
    rows = [(i, root[i], bytes((one[i] & 255).astype(np.uint8))) for i in range(50)]
    rare = lsh_forest.rare_shingles(spark.createDataFrame(list(enumerate(sets)), "node long, shingles array<long>"), 85)
    nodes = spark.createDataFrame(rows, "node long, root long, sig binary").join(rare, "node").repartition(3)
    got = [(x.u, x.v) for x in lsh_forest.wide_pairs(nodes, lsh_forest.near(85), 85).collect()]
    need = {(i, j) for i in range(50) for j in range(i) if root[i] != root[j] and 100 * len({*sets[i]} & {*sets[j]}) >= 85 * len({*sets[i]} | {*sets[j]})}
    assert len(got) == len(set(got)) and need and need <= set(got)
    assert all(root[u] != root[v] for u, v in got)


def test_across_splits_wide_regions_and_keeps_blocks_whole(monkeypatch):
    g = np.random.default_rng(0)
    sig = g.integers(0, 256, (40, lsh_forest.VALUES)).astype(np.uint8)
    sig[20:] = sig[:20]  # 20 pairs of equal signatures
    node, root = np.arange(40), np.arange(40)
    seen = np.zeros((40, lsh_forest.TREES), np.int64)
    seen[:, :2] = 7, 9  # this region is the first that they share
    for wide in (1_000, 3):
        monkeypatch.setattr(lsh_forest, "WIDE", wide)
        pairs = {(min(a, b), max(a, b)) for u, v in lsh_forest.across(node, root, sig, [np.array([i % 20, 99]) for i in range(40)], seen, 7, 0, True, 92, 85) for a, b in zip(u.tolist(), v.tolist())}
        assert pairs == {(i, i + 20) for i in range(20)}
    seen[:, 2] = -5  # an earlier one gives them
    assert not list(lsh_forest.across(node, root, sig, [np.array([99])] * 40, seen, 7, 0, True, 92, 85))


def test_across_keeps_pairs_that_differ_in_the_next_values(monkeypatch):
    monkeypatch.setattr(lsh_forest, "WIDE", 3)
    g = np.random.default_rng(0)
    sig = g.integers(0, 256, (40, lsh_forest.VALUES)).astype(np.uint8)
    sig[20:] = sig[:20]
    sig[20:, :2] += 1
    seen = np.zeros((40, lsh_forest.TREES), np.int64)
    found = lsh_forest.across(np.arange(40), np.arange(40), sig, [np.array([99])] * 40, seen, 7, 0, True, 92, 85)
    assert {(min(a, b), max(a, b)) for u, v in found for a, b in zip(u.tolist(), v.tolist())} == {(i, i + 20) for i in range(20)}


def test_across_gives_a_link_only_where_it_joins():
    """60 equal nodes: 59 links at most, and one component; a node of another set is linked with none."""
    sig = np.zeros((61, lsh_forest.VALUES), np.uint8)
    sets = [np.arange(100)] * 60 + [np.arange(50, 150)]
    found = [(a, b) for u, v in lsh_forest.across(np.arange(61), np.arange(61), sig, sets, np.zeros((61, lsh_forest.TREES), np.int64), 7, 0, True, 92, 85)
             for a, b in zip(u.tolist(), v.tolist())]
    assert len(found) == 59 and len(set(roots(61, found))) == 2


def test_rare_shingles_of_linked_sets_meet(spark):
    r = random.Random(5)
    base = list(range(100))
    sets = []
    for i in range(60):
        x = set(base)
        for _ in range(r.randrange(25)):
            x.discard(r.choice(base))
            x.add(1000 * (i + 1) + r.randrange(50))
        sets.append(x)
    frame = spark.createDataFrame([(i, sorted(x)) for i, x in enumerate(sets)], "node long, shingles array<long>")
    rows = lsh_forest.rare_shingles(frame, 85).collect()
    rare = {x.node: set(x.rare) for x in rows}
    for x in rows:
        others = set().union(*[s for j, s in enumerate(sets) if j != x.node])
        assert (x.size, x.shared) == (len(sets[x.node]), len(sets[x.node] & others))
    for i, a in enumerate(sets):
        assert len(rare[i]) == len(a) - -(-85 * len(a) // 100) + 1
        for j, b in enumerate(sets[:i]):
            if 100 * len(a & b) >= 85 * len(a | b):
                assert rare[i] & rare[j]


def test_components(spark):
    r = random.Random(0)
    edges = [(i, i + 1) for i in range(50)] + [(200, x) for x in range(100, 160)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(60)]
    edges += [edges[0], (7, 7), (500, 500)]
    want = roots(600, edges)
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: want[i] for e in edges for i in e if e[0] != e[1]}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_only_texts_that_may_be_wanted_are_moved(spark):
    """The full sets of a few nodes take a filter by remainders in front of the exchange of texts."""
    rows = spark.range(0, 400, 1, 4).select(F.xxhash64("id").alias("row_key"), F.concat(F.lit("a b c d e "), F.col("id").cast("string")).cast("binary").alias("text"))
    distinct = rows.select(F.hash("row_key").cast("long").alias("node"), "row_key")
    nodes, seen = distinct.limit(3).select("node"), []
    saved = lsh_forest._saved
    try:
        lsh_forest._saved = lambda df, name: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or saved(df, name)
        got = lsh_forest._full_sets(rows.unionAll(rows), distinct, nodes)
        assert got.count() == 3 and got.select("node").exceptAll(nodes).isEmpty()
    finally:
        lsh_forest._saved = saved
    assert "LeftSemi" in seen[-1] and "pmod(" in seen[-1].lower()
