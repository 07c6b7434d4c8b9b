"""Pipeline stages on odd tables: clashing names, maps, nulls, ties, no rows."""

import pytest

import corpus_pipeline

SCHEMA = ("doc_id long, text string, source string, score double, predicted int, near_key long, row_key string, contaminated_key long, "
          "mix_positions array<int>, doc_ int, tags map<string, int>, lang string")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "the secret answer of the benchmark is seven and a half")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def rows():
    out = []
    for i in range(40):
        said = f"good clear sentence number {i} about topic {i * 7} and place {i * 3}" if i % 2 else f"junk spam click {i} win {i * 5} now"
        out.append((i, said))
    out += [(100, out[1][1]), (None, out[3][1]), (None, None), (200, ""), (201, "good clear sentence: the secret answer of the benchmark is seven and a half"), (5, out[5][1]), (5, out[5][1])]
    return [(i, t, "ab"[k % 2], 9.5, 8, 7, "mine", 6, [5], 4, {"k": k}, None) for k, (i, t) in enumerate(out)]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:4])
def test_columns_come_through(spark, folder, name, stage):
    docs = spark.createDataFrame(rows(), SCHEMA)
    out = stage(spark, docs, folder)
    assert out.dtypes == docs.dtypes
    got = out.collect()
    assert got and all((r.score, r.predicted, r.near_key, r.row_key, r.contaminated_key, r.mix_positions, r.doc_) == (9.5, 8, 7, "mine", 6, [5], 4) for r in got)
    texts = [r.text for r in got]
    if name == "minhash_near_dedup":
        assert len([t for t in texts if t]) == len({t for t in texts if t}) and texts.count(None) == 1 and texts.count("") == 1
    if name == "benchmark_decontamination":
        assert len(got) == docs.count() - 1 and not any("secret" in (t or "") for t in texts)
    assert stage(spark, docs.limit(0), folder).count() == 0
