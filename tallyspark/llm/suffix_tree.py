"""Operator 3: substring de-duplication with prefix-partitioned suffix trees over words.

Suffixes are dealt to groups by a prefix: ``k`` words where few suffixes share them,
more where many do, so that a group fits in memory (``repeats`` step 1). Each group builds its
subtree: sorted suffixes, the prefix lengths that neighbours share, and from these the
internal nodes. A deep node is the common prefix of the leaves below it; where their
left contexts part, it is a maximal repeat. ``repeats.reach`` visits the nodes from the
deepest up and finds for each leaf the repeats of ``window`` words or more around it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import WORD, Plan, common_prefix, reach, repeated

SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def unpack(run: tuple) -> list[bytes]:
    out, last, at = [], b"", 0
    for n, size in zip(run[0], run[1]):
        last = last[:n] + run[2][at : at + size]
        at += size
        out.append(last)
    return out


def subtree(suffixes: list[bytes]) -> list[tuple[int, int, int, list[int]]]:
    """Internal nodes of the subtree of sorted suffixes, children first.

    A node: depth in words, first and last leaf, and the leaves at which its second and
    further children begin.
    """
    nodes: list[tuple[int, int, int, list[int]]] = []
    path: list[tuple[int, int, list[int]]] = [(0, 0, [])]
    for i in range(1, len(suffixes) + 1):
        depth = common_prefix(suffixes[i - 1], suffixes[i]) // WORD if i < len(suffixes) else 0
        first = i - 1
        while path[-1][0] > depth:
            d, first, cuts = path.pop()
            nodes.append((d, first, i - 1, cuts))
        if path[-1][0] < depth:
            path.append((depth, first, []))
        path[-1][2].append(i)
    return nodes


def match_by_subtrees(runs: list, need: int) -> list[tuple[list[int], list[int]]]:
    """Reach of every suffix from the nodes of its group's subtree (a group: equal first words)."""
    rows = sorted((s, r, i) for r, run in enumerate(runs) for i, s in enumerate(unpack(run)))
    out = [([0] * len(run[0]), [0] * len(run[0])) for run in runs]
    start = 0
    for end in range(1, len(rows) + 1):
        if end == len(rows) or rows[end][0][:WORD] != rows[start][0][:WORD]:
            group = rows[start:end]
            start = end
            if len(group) == 1:
                continue
            shared = [0] * len(group)
            for depth, _, _, cuts in subtree([x[0] for x in group]):
                for c in cuts:
                    shared[c] = depth
            left, right = reach([runs[r][3][i] for _, r, i in group], shared, WORD, need)
            for (_, r, i), m, n in zip(group, left, right):
                out[r][0][i], out[r][1][i] = m, n
    return out


def plan(window: int = 35, crowd: int = 20_000):
    k = max(1, window * 2 // 5)
    return lambda buckets: Plan(window, k, (k + window) // 2, True, match_by_subtrees, buckets, crowd)


def _digest(extra, mask, first, last, ids) -> pa.Table:
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    if extra is None:
        return pa.table([pa.array([], t) for t in types], names)
    data, start, end, begin, stop = extra
    gone = np.concatenate(([0], np.cumsum(mask)))
    b, e = begin[~mask], stop[~mask]
    keep = np.zeros(len(data) + 1, np.int32)  # kept words with the byte behind each, which becomes a space
    np.add.at(keep, b, 1)
    np.add.at(keep, e + 1, -1)
    keep = np.cumsum(keep[:-1]) > 0
    data = data.copy()
    data[e] = 32
    flat = data[keep].tobytes()
    to = np.concatenate(([0], np.cumsum(keep)))
    texts = [flat[i:j].rstrip(b" ") for i, j in zip(to[start].tolist(), to[np.minimum(end + 1, len(data))].tolist())]
    return pa.table([
        ids.combine_chunks(), last - first, gone[last] - gone[first],
        pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array([t.decode() for t in texts], pa.string()),
    ], names).cast(pa.schema(list(zip(names, types))))


def remove_repeated_words(docs: DataFrame, window: int = 35, crowd: int = 20_000) -> DataFrame:
    """Remove each word covered by ``window`` consecutive words whose sequence also starts anywhere else.

    One row per row of ``docs`` (doc_id, text; further columns are ignored): n_words,
    n_removed, kept_sha256 and ``kept_text``, the kept words joined by one space. A null
    or empty text has no words; a null doc_id stays null; repeated rows are separate
    documents. An empty table gives no rows. ``crowd``: suffixes in one subtree at most.
    """
    return repeated(docs, plan(window, crowd), _digest, SCHEMA)
