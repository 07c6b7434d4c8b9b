"""Operator 2: substring de-duplication by merging front-coded sorted suffix runs.

Every text group sorts its suffixes into a run, in which a string is written as the
length of the prefix that it shares with the one before and the rest; only that
crosses the exchange. A bucket merges the runs of all groups with a loser tree whose
entries know the prefix they share with the last string that came out. Two entries
with different known prefixes are ordered without looking at a byte; with equal ones
the comparison starts behind the known prefix (Ng and Kakehi's merge; exchanging only
what prefix statistics leave undecided follows Bingmann, Sanders and Schimek). The
prefixes shared with the string before come out with the merged order; ``repeats.reach``
turns them into the stretches to remove.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import Plan, common_prefix, reach, repeated

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text binary"


class Run:
    """A front-coded run; ``text`` is its head, ``known`` the prefix shared with the last output."""

    __slots__ = ("shared", "sizes", "rest", "next", "offset", "text", "known")

    def __init__(self, shared: list[int], sizes: list[int], rest: bytes):
        self.shared, self.sizes, self.rest = shared, sizes, rest
        self.next = self.offset = self.known = 0
        self.text: bytes | None = b""
        self.advance()

    def advance(self) -> None:
        """The next string; what it shares with the one before is known from the coding."""
        i = self.next
        if i == len(self.shared):
            self.text, self.known = None, -1
            return
        n, end = self.shared[i], self.offset + self.sizes[i]
        self.text, self.known = self.text[:n] + self.rest[self.offset : end], n
        self.next, self.offset = i + 1, end


def beats(a: Run, b: Run) -> bool:
    """Whether a's head comes first; the loser's known prefix becomes the one shared with the winner."""
    if a.known != b.known:
        return a.known > b.known
    if a.text is None:
        return True
    x, y = a.text, b.text
    n = common_prefix(x, y, a.known)
    first = n == len(x) or (n < len(y) and x[n] < y[n])
    if first:
        b.known = n
    else:
        a.known = n
    return first


def merge(runs: list[tuple[list[int], list[int], bytes]]) -> tuple[list[tuple[int, int]], list[int]]:
    """The merged order as (run, place in it), and the prefix that each string shares with the one before."""
    live = [(i, Run(*r)) for i, r in enumerate(runs) if r[0]]
    size = 1
    while size < len(live):
        size *= 2
    spent = Run([], [], b"")
    tree = [spent] * size  # losers, by inner node; node 1 is the root
    leaf = {}
    level = [spent] * size
    for i, (number, r) in enumerate(live):
        r.known = 0
        leaf[id(r)] = (number, size + i)
        level[i] = r
    while len(level) > 1:
        half = len(level) // 2
        won = []
        for i in range(half):
            x, y = level[2 * i], level[2 * i + 1]
            first = beats(x, y)
            won.append(x if first else y)
            tree[half + i] = y if first else x
        level = won
    top = level[0]
    order, shared = [], []
    while top.text is not None:
        number, node = leaf[id(top)]
        order.append((number, top.next - 1))
        shared.append(top.known)
        top.advance()
        node //= 2
        while node:
            other = tree[node]
            if not beats(top, other):
                tree[node], top = top, other
            node //= 2
    return order, shared


def match_by_merge(runs: list, need: int) -> list[tuple[list[int], list[int]]]:
    order, shared = merge([r[:3] for r in runs])
    left, right = reach([runs[r][3][i] for r, i in order], shared, 1, need)
    out = [([0] * len(r[0]), [0] * len(r[0])) for r in runs]
    for (r, i), m, n in zip(order, left, right):
        out[r][0][i], out[r][1][i] = m, n
    return out


def plan(window: int = 400, crowd: int = 20_000):
    k = max(1, window * 2 // 5)
    return lambda buckets: Plan(window, k, (k + window) // 2, False, match_by_merge, buckets, crowd)


def _digest(extra, mask, first, last, ids) -> pa.Table:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    if extra is None:
        return pa.table([pa.array([], t) for t in types], names)
    data = extra[0]
    gone = np.concatenate(([0], np.cumsum(mask)))
    enters = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask & ~np.concatenate(([False], mask[:-1])), out=enters[1:])
    kept = data[~mask].tobytes()
    to = np.arange(len(gone)) - gone
    texts = [kept[i:j] for i, j in zip(to[first].tolist(), to[last].tolist())]
    return pa.table([
        ids.combine_chunks(), last - first, gone[last] - gone[first], enters[last] - enters[first],
        pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array(texts, pa.binary()),
    ], names).cast(pa.schema(list(zip(names, types))))


def remove_repeats(docs: DataFrame, window: int = 400, crowd: int = 20_000) -> DataFrame:
    """Remove each byte covered by a ``window``-byte string that also starts anywhere else.

    One row per row of ``docs`` (doc_id, text; further columns are ignored): n_bytes,
    n_removed, n_spans, kept_sha256 and the kept bytes ``kept_text`` (which need not be
    valid UTF-8 where a span begins inside a code point). A null text counts as
    empty; a null doc_id stays null; repeated rows are separate documents, so their text
    of ``window`` bytes or more goes. An empty table gives no rows. ``crowd``: different
    contexts of one prefix that a task joins at most (see ``repeats``).
    """
    return repeated(docs, plan(window, crowd), _digest, SCHEMA)
