"""Operator 10: chat formatting with offset-aligned loss masks.

A conversation is rendered as a whole,

    <|endoftext|>role<|endoftext|>text<|endoftext|>role<|endoftext|>text ... <|endoftext|>

and encoded once, with offsets. Texts and roles are escaped, so a control string in them
is never one: a backslash is doubled, and ``\\-`` is put behind a control string's first character.
The spans of the assistant's texts and the tokens' spans are both sorted; a binary search
for each end gives the tokens under the loss mask. The delimiter is a token of its own, so
no token reaches over the end of a text (it is an error if one does).
"""

from __future__ import annotations

import hashlib
import os
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .ship import ship

DELIMITER = "<|endoftext|>"
CONTROL = (DELIMITER, "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\([\\-])")
LEARNED = "assistant"

_tokenizers: dict = {}


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\-" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" if m[1] == "\\" else "", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """Formatted conversation and the spans of the texts to learn, in code points."""
    parts, spans, at = [DELIMITER], [], len(DELIMITER)
    for role, text in turns:
        for x, learn in ((escape(role), False), (escape(text), role == LEARNED)):
            if learn:
                spans.append((at, at + len(x)))
            parts += (x, DELIMITER)
            at += len(x) + len(DELIMITER)
    return "".join(parts), spans


def mask(offsets: list[tuple[int, int]], spans: list[tuple[int, int]]) -> np.ndarray:
    """Whether each token lies in a span; both are sorted. Raises ValueError if a token reaches over a span's end."""
    starts, ends = [x[0] for x in offsets], [x[1] for x in offsets]
    out = np.zeros(len(offsets), bool)
    for a, b in spans:
        i, j = bisect_right(ends, a), bisect_left(starts, b)
        if i < j:
            if starts[i] < a or ends[j - 1] > b:
                raise ValueError("a token reaches over the end of a text")
            out[i:j] = True
    return out


def load(path: str):
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def format_conversations(rows: DataFrame, tokenizer: str) -> DataFrame:
    """One row a conversation: conv_id, n_turns, ids (little-endian uint32), loss_mask (packed bits, first token first), formatted_chars.

    ``rows``: conv_id, turn, role, text; further columns are ignored. Turns are ordered by
    turn, role, text, nulls first; repeated rows are repeated turns. A null text or role is
    empty; rows with a null conv_id are one conversation. An empty table gives no rows.
    A conversation is read in order by one task, as its encoding needs all of it.
    """
    ship(rows.sparkSession)
    keys = ["conv_id", "turn", "role", "text"]
    rows = rows.select(*keys).repartition("conv_id").sortWithinPartitions(*keys).select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(tokenizer)

        def finished(name: int | None, turns: list[tuple[str, str]]) -> pa.RecordBatch:
            text, spans = render(turns)
            got = model.encode(text, add_special_tokens=False)
            bits = np.packbits(mask(got.offsets, spans), bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([
                pa.array([name], pa.int64()), pa.array([len(turns)], pa.int64()), pa.array([np.array(got.ids, "<u4").tobytes()], pa.binary()),
                pa.array([bits], pa.binary()), pa.array([len(text)], pa.int64()),
            ], ["conv_id", "n_turns", "ids", "loss_mask", "formatted_chars"])

        name, turns = None, []
        for batch in batches:
            for conv, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "role", "text"))):
                if turns and conv != name:
                    yield finished(name, turns)
                    turns = []
                name = conv
                turns.append((role or "", text or ""))
        if turns:
            yield finished(name, turns)

    return rows.mapInArrow(run, "conv_id long, n_turns long, ids binary, loss_mask binary, formatted_chars long")


def parse(text: str) -> list[tuple[str, str]]:
    """Turns of a formatted conversation."""
    parts = [unescape(x) for x in text.split(DELIMITER)[1:-1]]
    return list(zip(parts[::2], parts[1::2]))


def read_back(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """Digests of what ``format_conversations`` wrote, from ids and masks alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    ship(formatted.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(tokenizer)
        for batch in batches:
            out = []
            for conv, ids, bits in zip(*(batch[c].to_pylist() for c in ("conv_id", "ids", "loss_mask"))):
                ids = np.frombuffer(ids, "<u4")
                on = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(ids), bitorder="little")
                text = model.decode(ids.tolist(), skip_special_tokens=False)
                turns = parse(text)
                edge = np.flatnonzero(np.diff(np.concatenate(([0], on, [0])).astype(np.int8)))
                learned = "".join(unescape(model.decode(ids[i:j].tolist(), skip_special_tokens=False)) for i, j in edge.reshape(-1, 2))
                said = "".join(f"{role}\n{text}\n" for role, text in turns)
                out.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(text)))
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            cols = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return formatted.select("conv_id", "ids", "loss_mask").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
