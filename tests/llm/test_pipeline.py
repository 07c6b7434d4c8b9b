"""The corpus pipeline: each stage's effect against brute force on its own input."""

import re
import string

import pytest

import corpus_pipeline
from tallyspark.llm import token_files

SF = "/root/testdata/sf0.001"
FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.fixture(scope="module")
def kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = token_files.shared_path(spark, f"test-{name}")
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages_keep_the_columns_of_documents(kept):
    assert all(x.columns == kept[0].columns for x in kept[:-1])
    assert kept[-1].columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_quality_keeps_good_documents(spark, kept):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {r.doc_id for r in kept[1].select("doc_id").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in left for i in good) / len(good) >= 0.97
    assert sum(i not in left for i, q in labels.items() if q == 0) > 0


def test_one_of_each_group_of_near_copies_stays(kept):
    sets = {r.doc_id: shingles(r.text) for r in kept[1].collect()}
    home = {i: i for i in sets}

    def find(i):
        while home[i] != i:
            i = home[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                home[max(x, y)] = min(x, y)
    assert {r.doc_id for r in kept[2].collect()} == {i for i in ids if find(i) == i}


def test_near_copies_with_null_and_repeated_ids(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(5, a, "s"), (5, b, "s"), (3, b, "s"),  # 5 has a text of its own
            (None, c, "s"), (None, c + " more", "s"), (None, c, "r"),  # null ids
            (7, d, "t"), (7, d, "s"), (None, d, "a"),  # equal but for the source
            (None, None, "s"), (None, None, "s"), (8, "", "s"), (8, "", "s")]  # without words
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()]
    null_c = [r for r in got if r[1] and r[1].startswith("c0")]
    assert len(null_c) == 1 and null_c[0] in [(None, c, "r"), (None, c + " more", "s")]
    rest = [(5, a, "s"), (3, b, "s"), (7, d, "s"), *rows[9:]]
    assert sorted(map(str, got)) == sorted(map(str, rest + null_c))


def test_contaminated_documents_go(spark, kept):
    items = [shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in kept[2].collect() if not any(len(q & s) >= 0.8 * len(q) for s in [shingles(r.text)] for q in items if q)}
    assert {r.doc_id for r in kept[3].collect()} == clean


def test_mix_and_token_files(kept):
    size = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows)
    before, after = kept[3].collect(), kept[4].collect()
    assert abs(size(after) - size(before)) < 0.1 * size(before)
    last = sorted(kept[5].collect(), key=lambda r: r.start)
    assert sorted(r.doc_id for r in last) == sorted(r.doc_id for r in after)
    assert [r.start for r in last] == [sum(x.n_tokens for x in last[:i]) for i in range(len(last))]
