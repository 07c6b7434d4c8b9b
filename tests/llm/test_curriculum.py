"""Operator 8: targets, totals, positions, odd rows."""

import random
from collections import defaultdict

from tallyspark.llm import curriculum


def fill(sizes, weights, most):
    """Targets by reshaping the excess again and again."""
    total, target, free = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        left = total - sum(t for i, t in enumerate(target) if i not in free)
        level = left / sum(weights[i] for i in free)
        over = {i for i in free if level * weights[i] > most * sizes[i]}
        for i in free - over:
            target[i] = level * weights[i]
        for i in over:
            target[i] = float(most * sizes[i])
        if not over:
            return target
        free -= over
    return target


def test_targets_totals_and_positions(spark):
    r = random.Random(3)
    rows = []
    for i in range(900):
        source = r.choice(["a", "a", "a", "b", "c", "d", "é", "Z", None])
        rows.append((i, "w " * r.randrange(1, 60), source))
    rows += [(1000 + i, None, "e") for i in range(3)] + [(2000, "word " * 4000, "b"), (5, rows[5][1], rows[5][2]), (None, "x y", "a"), (None, "x y", "a")]
    frame = spark.createDataFrame([(*x, 9, "clash") for x in rows], "doc_id long, text string, source string, size int, target string")
    out = curriculum.mix(frame.repartition(4)).collect()
    assert len(out) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    want = dict(zip(order, fill([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 3)))
    taken, largest = defaultdict(int), defaultdict(int)
    for x in out:
        assert x.source_size == sizes[x.source] and abs(x.target - want[x.source]) < 1e-6
        assert x.taken == x.copies * x.size and 0 <= x.copies <= 3
        assert (x.position is None) == (x.copies == 0) == (x.positions is None)
        if x.copies:
            assert x.positions == sorted(x.positions) and 0 <= x.positions[0] and x.positions[-1] <= sum(sizes.values()) + 1e-6
        taken[x.source] += x.taken
        largest[x.source] = max(largest[x.source], x.size)
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    places = [x.position for x in out if x.position is not None]
    assert places == sorted(places) and out[-1].position is None
    again = curriculum.mix(frame.repartition(7)).collect()
    key = lambda x: (x.doc_id is None, x.doc_id or 0, x.size, x.position or -1)
    assert sorted(map(key, out)) == sorted(map(key, again))
    mixed = curriculum.apply_mix(frame)
    assert mixed.columns == frame.columns
    assert mixed.count() == sum(x.copies for x in out)


def test_ramp_moves_a_source(spark):
    rows = [(i, "w w w w", "a" if i % 2 else "c") for i in range(400)] + [(1000 + i, "w", "b") for i in range(10)]
    out = curriculum.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    mean = lambda s: sum(p for x in out if x.source == s and x.copies for p in x.positions) / sum(x.copies for x in out if x.source == s)
    assert mean("a") < mean("c")  # a is asked for early, c late


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert curriculum.mix(none).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert [(x.size, x.taken, x.target) for x in curriculum.mix(blank).collect()] == [(0, 0, 0.0)] * 2


def test_equal_rows_of_two_sources_get_their_own_copies(spark):
    rows = [(1, "w w w w", "a"), (1, "w w w w", "b"), (1, "w w w w", None), *((10 + i, "w w", "b") for i in range(40))]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {x.source: x.copies for x in curriculum.mix(frame).collect() if x.doc_id == 1}
    got = [x.source for x in curriculum.apply_mix(frame).collect() if x.doc_id == 1]
    assert len(set(want.values())) > 1 and {s: got.count(s) for s in want} == want


def test_sources_of_null_and_repeated_ids_meet_their_targets(spark):
    """400 rows with null ids, 400 with one id, and 5,000 fully equal rows each end near their source's target."""
    rows = [(None, f"w{i} x y z", "a") for i in range(400)] + [(7, f"w{i} x y z", "b") for i in range(400)] + [(9, "all the same", "c")] * 5000
    rows += [(1000 + i, "one two three", "d") for i in range(1500)]
    frame = spark.createDataFrame([(*x, {"k": 1}, 0.5) for x in rows], "doc_id long, text string, source string, mix_position map<string, int>, row_key double")
    out = curriculum.mix(frame).collect()
    assert len(out) == len(rows)
    for s in "abcd":
        mine = [x for x in out if x.source == s]
        assert abs(sum(x.taken for x in mine) - mine[0].target) <= max(x.size for x in mine)
        assert all(x.copies <= 3 for x in mine)
    mixed = curriculum.apply_mix(frame)
    assert mixed.columns == frame.columns
    got = {s: n for s, n in mixed.groupBy("source").count().collect()}
    assert got == {s: sum(x.copies for x in out if x.source == s) for s in "abcd"}
    assert mixed.first().asDict()["mix_position"] == {"k": 1}
