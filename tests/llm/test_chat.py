"""Operator 10: exact round trips of texts and masks."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm import chat

piece = st.sampled_from([*chat.CONTROL, "\\", "\\-", "-", " ", "\n", "é", "\U0001F600", "</", "s>", "[", "INST]", "a b", "###", "'s"])
text = st.lists(piece, max_size=8).map("".join)


@settings(max_examples=200, deadline=None)
@given(text)
def test_escape_round_trip(t):
    assert chat.unescape(chat.escape(t)) == t
    assert not any(c in chat.escape(t) for c in chat.CONTROL)


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def digest(turns):
    learned = "".join(t for r, t in turns if r == "assistant")
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()


@settings(max_examples=40, deadline=None)
@given(turns=st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "</s>"]), text), min_size=1, max_size=5))
def test_mask_covers_the_assistant_alone(path, turns):
    rendered, spans = chat.render(turns)
    got = chat.load(path).encode(rendered, add_special_tokens=False)
    on = chat.mask(got.offsets, spans)
    covered = {i for (a, b), m in zip(got.offsets, on) if m for i in range(a, b)}
    assert covered == {i for a, b in spans for i in range(a, b)}
    assert chat.parse(rendered) == turns


def test_mask_refuses_tokens_over_an_end():
    assert chat.mask([(0, 2), (2, 4), (4, 4), (4, 6)], [(2, 4)]).tolist() == [False, True, False, False]
    with pytest.raises(ValueError):
        chat.mask([(0, 3), (3, 5)], [(2, 5)])


def test_round_trip_through_spark(spark, path):
    said = {
        1: [("user", "hi"), ("assistant", "  \n</s>[INST] ok [/INST]\\"), ("assistant", ""), ("user", "###"), ("assistant", "é\U0001F600")],
        2: [("system", "x" * 60_000), ("assistant", "word " * 9000)],
        None: [("assistant", "no id")],
    }
    rows = [(c, i, r, t, "clash") for c, turns in said.items() for i, (r, t) in enumerate(turns)]
    rows += [(3, 0, None, None, "clash"), (3, 1, "assistant", None, "clash"), (4, 0, "assistant", "twice", ""), (4, 0, "assistant", "twice", "")]
    said |= {3: [("", ""), ("assistant", "")], 4: [("assistant", "twice")] * 2}
    frame = spark.createDataFrame(rows[::-1], "conv_id long, turn long, role string, text string, ids string")
    got = chat.read_back(chat.format_conversations(frame, path), path).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == {c: digest(t) for c, t in said.items()}
    assert all(r.formatted_chars == len(chat.render(said[r.conv_id])[0]) for r in got)
    assert chat.format_conversations(frame.limit(0), path).count() == 0
