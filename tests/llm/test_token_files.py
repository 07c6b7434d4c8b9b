"""Operator 4: Elias-Fano codes, exact round trips of token files."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm import token_files
from tallyspark.llm.elias_fano import EliasFano, encode


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(10**6), 10**12), max_size=600).map(sorted))
def test_elias_fano_round_trip(values):
    v = np.array(values, np.int64)
    e = EliasFano(encode(v))
    assert e.all().tolist() == values
    assert [e[i] for i in range(len(e))] == values


def test_elias_fano_is_small():
    v = np.cumsum(np.random.default_rng(0).integers(1, 1000, 20_000))
    assert len(encode(v)) * 8 / len(v) < 2 + np.log2(1000) + 1


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_files_round_trip(spark, path):
    from tokenizers import Tokenizer

    texts = [
        None, "", "plain words here", "a<|endoftext|>b <|STARTOFTEXT|> <|startoftext|>", "İSTANBUL Σίσυφος ΟΔΟΣ ßẞ ﬁ",
        "it's we'll 'S ,.,. 12345 \U0001F600 \x01 \x1c \x85 　", "very " * 5000, "tie", "tie",
    ]
    rows = [(i if i < 7 else 7, t, "clash", 0) for i, t in enumerate(texts)] + [(None, "no id", "clash", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string, start long").repartition(4)
    out = token_files.shared_path(spark, "test-tokens")
    token_files.write(docs, out, path, end_id=1)
    got = sorted(token_files.read(spark, out).collect(), key=lambda r: r.start)
    tokenizer = Tokenizer.from_file(path)
    want, start = [], 0
    for i, t, *_ in [rows[-1], *rows[:-1]]:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes()))
        start += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in got] == want


def test_small_shards_and_empty_table(spark, path, monkeypatch):
    monkeypatch.setattr(token_files, "CALL_BYTES", 50)
    monkeypatch.setattr(token_files.bpe_stream, "MEMO", 5)
    memo = token_files.LibraryEncoder(path)
    words = [f"w{i}x{i * 7}," for i in range(200)]
    for w in (words, words[::-1]):
        text = " ".join(w)
        got = memo.texts([text.encode(), b"", (text + " \x01 a\x01b <|endoftext|> é").encode()])
        want = [memo.tokenizer.encode(t, add_special_tokens=False).ids for t in (text, "", text + " \x01 a\x01b <|endoftext|> é")]
        assert [x.tolist() for x in got] == want
    a, b = (token_files.shard(0, n, [n], [3], b"abcdef", 2) + b"\n" for n in (0, 1))
    assert [(x[1], x[2], x[3].tolist()) for x in token_files.shards(a + b)] == [(0, [0], [0, 3]), (1, [1], [0, 3])]
    out = token_files.shared_path(spark, "test-none")
    token_files.write(spark.createDataFrame([], "doc_id long, text string"), out, path)
    assert token_files.read(spark, out).count() == 0


def test_texts_are_encoded_a_bounded_part_at_a_time(path, monkeypatch):
    """A batch of many texts reaches the encoder in runs of TEXT_BYTES; ids are those of all at once."""
    library, calls = token_files.encoder(path), []
    texts = [b"some words 12" * (i % 5) + b" x%d" % i for i in range(200)] + [None, b"", b"long " * 400]
    want = [x.tolist() for x in library.texts([t or b"" for t in texts])]
    monkeypatch.setattr(token_files, "TEXT_BYTES", 1000)
    plain = library.texts
    monkeypatch.setattr(library, "texts", lambda some: calls.append(sum(map(len, some))) or plain(some))
    batch = pa.RecordBatch.from_arrays([pa.array([*range(202), None]), pa.array([t or b"" for t in texts], pa.binary())], ["doc_id", "text"])
    got = list(token_files.encoded(iter([batch]), library))
    assert [n for n, _ in got] == [*range(202), None] and [x.tolist() for _, x in got] == want
    assert len(calls) > 5 and max(calls) <= 2000 and list(token_files.encoded(iter([batch.slice(0, 0)]), library)) == []


def test_encoder_keeps_rules_and_compact_words_only(path):
    """The library has the merges, so no second copy stays; remembered words cost their bytes, two bytes an id and two bounds."""
    library = token_files.LibraryEncoder(path)
    letters = "abcdefghijklmno"
    text = " ".join(a + b + c for a in letters for b in letters for c in letters).encode()
    assert library.texts([text])[0].tolist() == library.tokenizer.encode(text.decode(), add_special_tokens=False).ids
    assert not hasattr(library.model, "rank") and library.memo.ids.kept.itemsize == library.width == 2
    memo, n = library.memo, len(library.memo.slots)
    assert n == len(letters) ** 3 and memo.slots.itemsize == 4 and len(memo.text_end) == len(memo.ids_end) == n + 1


def test_few_rows_go_to_python_at_a_time(spark):
    """Inside the block a batch has so many rows at most; the setting before is back, after an error too."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        yield from (pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"]) for b in batches)

    with token_files.batches_of(spark, 7):
        assert max(r.n for r in spark.range(0, 100, 1, 1).mapInArrow(sizes, "n long").collect()) == 7
    assert spark.conf.get(name) == before
    with pytest.raises(ZeroDivisionError), token_files.batches_of(spark, 7):
        1 / 0
    assert spark.conf.get(name) == before
