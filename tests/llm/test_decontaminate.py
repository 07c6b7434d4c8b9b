"""Operator 7 against brute force."""

import random
import re
import string

import pytest

from tallyspark.llm import decontaminate

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(docs, items, t):
    out = set()
    for item, text in items:
        size = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        if size:
            q = shingles(text, min(5, size))
            for doc, body in docs:
                n = len(q & shingles(body, min(5, size)))
                if n / len(q) >= t:
                    out.add((doc, item, len(q), n))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    r = random.Random(seed)
    words = [f"W{i}" for i in range(60)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.choice([1, 2, 4, 5, 6, 12, 40])))) for i in range(30)] + [(98, None), (99, " ")]
    docs = [(0, None), (1, ""), (2, "w1"), (3, "w1 " * 4000)]
    for i in range(4, 60):
        body = [r.choice(words) for _ in range(r.choice([3, 30, 300]))]
        if i % 2:
            piece = r.choice(items[:30])[1].lower().split()
            if r.random() < 0.5 and len(piece) > 10:
                piece[r.randrange(len(piece))] = "changed"
            body[5:5] = piece
        docs.append((i, r.choice([" ", "\n"]).join(body)))
    d = spark.createDataFrame([(*x, 1, "clash") for x in docs + docs[4:6]], "doc_id long, text string, item_id int, n string").repartition(3)
    b = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, doc_id string")
    got = [(x.doc_id, x.item_id, x.n_shingles, x.n_found) for x in decontaminate.matches(d, b).collect()]
    want = brute(docs, items, 0.8)
    assert len(got) == len(set(got)) and set(got) == want and want
    left = decontaminate.decontaminate(d, b)
    bad = {x[0] for x in want}
    assert left.columns == d.columns
    assert sorted(x.doc_id for x in left.collect()) == sorted(i for i, _ in docs + docs[4:6] if i not in bad)


def test_null_ids_and_empty_tables(spark):
    text = "one two three four five six seven"
    d = spark.createDataFrame([(None, text), (None, "other words"), (1, "a " + text)], "doc_id long, text string")
    b = spark.createDataFrame([(7, text)], "item_id long, text string")
    assert sorted((x.doc_id or -1, x.item_id) for x in decontaminate.matches(d, b).collect()) == [(-1, 7), (1, 7)]
    assert [x.text for x in decontaminate.decontaminate(d, b).collect()] == ["other words"]
    assert decontaminate.matches(d, b.limit(0)).count() == 0
    assert decontaminate.matches(d.limit(0), b).count() == 0
    assert decontaminate.decontaminate(d, b.limit(0)).count() == 3
