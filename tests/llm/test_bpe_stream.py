"""Operator 12 against the tokenizers library and against plain merging."""

import hashlib
import random
from array import array

import pytest

from tallyspark.llm import bpe_stream as bpe

ODD = ["a", "b", "th", "e", "'", "'s", "'re", "r", "v", "l", "ll", "!", "1", "²", "é", "é", "́", "Σ", "İ", "中", "가", "각",
       "ᆨ", "<|endoftext|>", "<|startoftext|>", "<|", "<|ENDOFTEXT|>", " ", "\u0085", "\x1c", " ", "ing", "hun", " ", "\n", "\U0001F600", "ſ", "K", "\0"]


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def whole(encoder, text):
    return encoder.texts([text.encode()])[0].tolist()


def odd_texts(rng, n):
    for k in range(n):
        t = "".join(rng.choice(ODD) for _ in range(rng.randint(0, 60)))
        if k % 3 == 0:
            t = t.replace(" ", "").replace("\n", "")
        yield "".join(rng.choice("abehinrstu") for _ in range(rng.randint(200, 900))) if k % 7 == 0 else t


def test_small_windows_and_pieces_equal_the_library(path, library, monkeypatch):
    """Words over many windows, parts over many pieces, texts over many slices."""
    monkeypatch.setattr(bpe, "PIECE", 7)
    monkeypatch.setattr(bpe, "TOGETHER", 20)
    monkeypatch.setattr(bpe, "BATCH", 200)
    monkeypatch.setattr(bpe, "SLICE", 50)
    monkeypatch.setattr(bpe, "MEMO", 100)
    monkeypatch.setattr(bpe, "WINDOW", 5)
    model = bpe.Model(path)
    encoder, decoder = bpe.Encoder(model), bpe.Decoder(model)
    for text in odd_texts(random.Random(2), 3000):
        ids = library.encode(text, add_special_tokens=False).ids
        assert whole(encoder, text) == ids, text
        assert decoder.feed(ids[:3]) + decoder.feed(ids[3:]) + decoder.close() == library.decode(ids, skip_special_tokens=False)


def test_every_character(path, library):
    encoder = bpe.Encoder(bpe.load(path))
    codes = [*range(1, 0x3100), *range(0x3100, 0x110000, 61)]
    for c in (chr(c) for c in codes if not 0xD800 <= c < 0xE000):
        text = f"a{c}b 'S{c}{c}"
        assert whole(encoder, text) == library.encode(text, add_special_tokens=False).ids, hex(ord(c))


def random_merges(rng, letters, n):
    """A merge list in which every part is made before it is used, and every token is made once."""
    tokens, pairs, product = list(letters), [], []
    for _ in range(20 * n):
        a, b = rng.choice(tokens), rng.choice(tokens)
        if len(pairs) < n and a + b not in tokens and len(a + b) <= 6:
            pairs.append((a, b))
            product.append(a + b)
            tokens.append(a + b)
    return pairs, product


def merged(text, pairs):
    parts = list(text)
    for a, b in pairs:
        i = 0
        while i + 1 < len(parts):
            if parts[i] == a and parts[i + 1] == b:
                parts[i : i + 2] = [a + b]
            i += 1
    return parts


def test_lookahead_is_sufficient():
    """Tokens that end ``lookahead`` before the end of any text are the same for every longer text; some lists need nearly all of it."""
    rng = random.Random(11)
    tight = 0
    for _ in range(150):
        pairs, product = random_merges(rng, "abc", rng.randint(2, 14))
        enough, needed = bpe.lookahead(pairs, product, len), 0
        for _ in range(12):
            text = "".join(rng.choice("abc") for _ in range(40))
            ends = []
            for n in range(len(text) + 1):
                at, bounds = 0, set()
                for t in merged(text[:n], pairs):
                    at += len(t)
                    bounds.add(at)
                ends.append(bounds)
            for n in range(len(text) + 1):
                for later in range(n, len(text) + 1):
                    differ = [x for x in ends[n] ^ {y for y in ends[later] if y <= n} if x <= n]
                    if differ:
                        needed = max(needed, n - min(differ) + 1)
        assert needed <= enough
        tight += needed >= enough / 2
    assert tight > 20


def test_memory_is_a_window(path, monkeypatch):
    model = bpe.load(path)
    out, most = array("I"), 0
    t = bpe.Transducer(model, out)
    rng = random.Random(3)
    for _ in range(300):
        t.feed(bytes(rng.choices(b"aehinst", k=100)))
        most = max(most, len(t.pending))
    t.close()
    assert most <= model.window and sum(model.size[i] for i in out) == 30_000


def test_byte_level_state_machine():
    """Characters parted between tokens, bytes that are no UTF-8, ids without a token."""

    class Model:
        decoder, byte_of = "ByteLevel", {c: b for b, c in enumerate(bpe.byte_letters())}
        tokens = {b: c for b, c in enumerate(bpe.byte_letters())} | {300: "<|end of text|>"}

    d = bpe.Decoder(Model)
    data = "é\U0001F600".encode() + b"\xff" + "ü".encode()[:1]
    assert "".join([*(d.feed([b]) for b in data), d.feed([999, 300]), d.feed([0xC3]), d.close()]) == "é\U0001F600��<|end of text|>�"


def test_other_files_are_refused():
    P = pytest.importorskip("public_tokenizers")
    with pytest.raises(ValueError):
        bpe.Model(P.path("byte_bpe_50k.json"))


def test_round_trip_through_spark(spark, path, library):
    texts = ["", None, " \n ", "Hello, WORLD's  é", "x" * 200_000, "word " * 50_000, "ü" * 70_000 + " end", *odd_texts(random.Random(9), 200)]
    rows = [(i if i % 5 else None, t, "clash", 1) for i, t in enumerate(texts)] + [(7, "again", "clash", 1)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    encoded = bpe.encode(docs, path)
    got = sorted(map(tuple, bpe.digests(encoded, path).collect()), key=str)
    texts_back = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in bpe.decode(encoded, path).collect())
    want, back = [], []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        said = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()))
        back.append((i is None, i or 0, said))
    assert got == sorted(want, key=str)
    assert texts_back == sorted(back)
    assert bpe.digests(bpe.encode(docs.limit(0), path), path).count() == 0
