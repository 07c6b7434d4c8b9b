"""Windows of a document that start anywhere else too: shared frame of the two substring operators.

A window is ``window`` consecutive symbols (bytes or words) of one document. Sorting
every suffix of a corpus costs many times its size, so only *anchor* suffixes take part:
in each window, the slice of ``k`` symbols with the least hash among its ``window - k + 1``
slices is its anchor. The choice depends on the window's content alone, so equal windows
hold equal anchors at equal offsets, and nothing is lost. An anchor has two contexts:
the suffix that starts at it, cut at ``window`` symbols, and the ``window - k`` symbols to its left.

1. Prefix statistics. Each anchor sends hashes of its first ``k`` and ``mid`` symbols and of both
   contexts. An anchor whose ``k``-prefix is unique is settled: no window of its is repeated.
   Anchors with equal contexts are settled too; one of them stands for all.
2. Suffix order. The rest go, as strings, to the operator's own method (merged sorted
   runs, or suffix subtrees), which gives the prefix lengths that suffixes share in sorted
   order. Joining suffixes from the longest shared prefix down, the smaller set into the
   larger, and comparing left contexts of neighbours gives each anchor its longest reach
   to either side over all partners that agree in ``window`` symbols at least. All those
   stretches contain the anchor, so their union is one interval.
3. Crowded prefixes. A prefix with more than ``crowd`` different contexts is dealt by its ``mid``
   symbols, and its windows that a match shorter than ``mid`` could explain are compared one
   by one, by hash; if ``mid`` is crowded too, all its windows are. Equal windows of a group
   are sent once, so this has no crowds. It is exact, only longer.

Hashes have 64 bits; two different strings among n collide with probability n^2 / 2^65.
"""

from __future__ import annotations

import marshal
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import groups
from .text import BYTE_SYMBOL, Rolling, chunks, covered, joined, sliding_min, word_bounds, word_hashes

CHUNK = 1 << 20
WORD = 8
#: Bits of an anchor's code: its strings are sent; it has an equal; it is dealt by its mid prefix; all its windows are compared.
SEND, EQUAL, DEEP, OPEN = 1, 2, 4, 8


@dataclass(frozen=True)
class Plan:
    """window, k and mid in symbols; resolve: ``(runs, need) -> (left reach, right reach)`` per run."""

    window: int
    k: int
    mid: int
    words: bool
    resolve: Callable
    buckets: int
    crowd: int = 20_000

    @property
    def width(self) -> int:
        return self.window - self.k + 1


class Group:
    """Symbols of one text group, chunk by chunk (bounded scratch arrays)."""

    def __init__(self, plan: Plan, table: pa.Table):
        self.plan, self.parts = plan, []
        texts = [t or b"" for t in table["text"].to_pylist()]
        base = 0
        for i, j in chunks(np.array([len(t) for t in texts], np.int64), CHUNK):
            data, start, end = joined(texts[i:j])
            if plan.words:
                wb, we = word_bounds(data)
                unit, first, last = word_hashes(data, wb, we), np.searchsorted(wb, start), np.searchsorted(wb, end)
                extra = (data, start, end, wb, we)
            else:
                unit, first, last, extra = data, start, end, (data, start, end)
            self.parts.append((base, unit, first, last, extra))
            base += len(unit)
        self.size = base

    def rolling(self, unit: np.ndarray) -> Rolling:
        return Rolling(unit if self.plan.words else BYTE_SYMBOL[unit])

    def anchors(self) -> dict[str, np.ndarray]:
        p = self.plan
        found: list[tuple[np.ndarray, ...]] = []
        for base, unit, first, last, _ in self.parts:
            if len(unit) < p.window:
                continue
            roll = self.rolling(unit)
            key = roll.every(p.k)
            low = np.uint64(32)
            least = sliding_min(((key >> low) << low) | np.arange(len(key), dtype=np.uint64), p.width)
            long = last - first >= p.window
            ok = covered(first[long], (last - first)[long] - p.window + 1, len(least) + 1)[: len(least)]
            of = (least[ok] & np.uint64(0xFFFFFFFF)).astype(np.int64)  # each window's anchor: never falls
            start = np.flatnonzero(ok)
            new = np.flatnonzero(np.diff(of, prepend=-1))
            at, lo, hi = of[new], start[new], start[np.append(new[1:], len(of)) - 1] if len(of) else new
            doc = np.searchsorted(first, at, "right") - 1
            # empty documents share a start with the next one: take the last that starts there
            left = np.minimum(p.width - 1, at - first[doc])
            right = np.minimum(p.window, last[doc] - at)
            both = roll.slices(at - left, at + right) + left.astype(np.uint64)
            found.append((at + base, lo + base, hi + base, left, right, key[at], roll.slices(at, at + np.minimum(p.mid, right)), both))
        names = ("at", "lo", "hi", "left", "right", "head", "mid", "full")
        if not found:
            return {n: np.zeros(0, np.uint64 if n in ("head", "mid", "full") else np.int64) for n in names}
        return {n: np.concatenate(x) for n, x in zip(names, zip(*found))}

    def distinct(self, a: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Different suffixes by (bucket, head, full): first anchor, its index for each anchor, bucket, repeated."""
        bucket = (a["head"] % np.uint64(self.plan.buckets)).astype(np.int64)
        order = np.lexsort((a["full"], a["head"], bucket))
        h, f = a["head"][order], a["full"][order]
        new = np.ones(len(order), bool)
        new[1:] = (h[1:] != h[:-1]) | (f[1:] != f[:-1])
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        return order[new], which, bucket[order[new]], np.bincount(which, minlength=int(new.sum())) > 1

    def contexts(self, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[bytes, bytes]]:
        """Suffix and reversed left context of anchors, as bytes (8 a word)."""
        bases = np.array([x[0] for x in self.parts])
        w = WORD if self.plan.words else 1
        ahead = [x[1].astype(">u8").tobytes() if self.plan.words else x[1].tobytes() for x in self.parts]
        back = [x[1][::-1].astype(">u8").tobytes() if self.plan.words else x[1][::-1].tobytes() for x in self.parts]
        out = []
        for part, a, m, n in zip((np.searchsorted(bases, at, "right") - 1).tolist(), at.tolist(), left.tolist(), right.tolist()):
            i = (a - self.parts[part][0]) * w
            j = len(back[part]) - i
            out.append((ahead[part][i : i + n * w], back[part][j : j + m * w]))
        return out

    def window_hashes(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for base, unit, _, _, _ in self.parts:
            i, j = np.searchsorted(at, (base, base + len(unit)))
            if i < j:
                s = at[i:j] - base
                out[i:j] = self.rolling(unit).slices(s, s + self.plan.window)
        return out


def _split(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of a sorted bucket array."""
    cut = np.flatnonzero(np.diff(bucket)) + 1
    first = np.concatenate(([0], cut)).astype(int) if len(bucket) else []
    last = np.concatenate((cut, [len(bucket)])).astype(int)
    return [(int(bucket[i]), int(i), int(j)) for i, j in zip(first, last)] if len(bucket) else []


# --- step 1: prefix statistics ---------------------------------------------------------


def _send_prefixes(plan: Plan, pid: int, table: pa.Table, _: list) -> list:
    g = Group(plan, table)
    a = g.anchors()
    first, _, bucket, twice = g.distinct(a)
    out = []
    for b, i, j in _split(bucket):
        x = first[i:j]
        out.append((b, pid, marshal.dumps((a["head"][x].tobytes(), a["mid"][x].tobytes(), a["full"][x].tobytes(), twice[i:j].tobytes()))))
    return out


def _count_prefixes(plan: Plan, inbox: list) -> list:
    got = [marshal.loads(x[2]) for x in inbox]
    head, mid, full = (np.concatenate([np.frombuffer(x[i], np.uint64) for x in got]) for i in range(3))
    copies = np.concatenate([np.frombuffer(x[3], np.uint8) for x in got]).astype(np.int64) + 1
    order = np.lexsort((np.arange(len(head)), full, mid, head))
    h, m, f, n = head[order], mid[order], full[order], copies[order]

    def levels(new: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Sum of ``of`` over each run, for every row."""
        run = np.cumsum(new) - 1
        return np.bincount(run, of)[run].astype(np.int64)

    new_h, new_m, new_f = (np.ones(len(h), bool) for _ in range(3))
    new_h[1:] = h[1:] != h[:-1]
    new_m[1:] = new_h[1:] | (m[1:] != m[:-1])
    new_f[1:] = new_m[1:] | (f[1:] != f[:-1])
    equal = levels(new_f, n) > 1
    kinds, kinds_mid = levels(new_h, new_f), levels(new_m, new_f)
    crowded = kinds > plan.crowd
    how = np.where(kinds > 1, SEND, 0)
    how[crowded] = np.where(kinds_mid[crowded] == 1, DEEP, np.where(kinds_mid[crowded] > plan.crowd, OPEN, SEND | DEEP))
    code = np.where(equal, EQUAL | np.where(new_f, how, 0), how).astype(np.uint8)
    back = np.empty(len(code), np.uint8)
    back[order] = code
    sizes = np.cumsum([0, *(len(x[3]) for x in got)])
    return [(b, pid, marshal.dumps(back[i:j].tobytes())) for (b, pid, _), i, j in zip(inbox, sizes, sizes[1:])]


# --- step 2: suffix strings, and the windows of crowded prefixes -----------------------------


def common_prefix(x: bytes, y: bytes, start: int = 0) -> int:
    """Length of the common prefix, given that ``start`` bytes are known to agree."""
    most, step = min(len(x), len(y)), 32
    while start < most:
        p, q = x[start : start + step], y[start : start + step]
        if p != q:
            n = min(len(p), len(q))
            gap = int.from_bytes(p[:n], "big") ^ int.from_bytes(q[:n], "big")
            return start + (n - (gap.bit_length() + 7) // 8 if gap else n)
        start += step
        step = 256
    return most


def front_coded(strings: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """Sorted strings as (prefix shared with the one before, rest length, rests)."""
    shared, rest, last = [], [], b""
    for s in strings:
        n = common_prefix(last, s)
        shared.append(n)
        rest.append(s[n:])
        last = s
    return np.array(shared, np.uint16).tobytes(), np.array([len(x) for x in rest], np.uint16).tobytes(), b"".join(rest)


def packed(strings: list[bytes]) -> tuple[bytes, bytes]:
    return np.array([len(x) for x in strings], np.uint16).tobytes(), b"".join(strings)


def unpacked(sizes: bytes, flat: bytes) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(sizes, np.uint16).astype(np.int64)).tolist()
    return [flat[i:j] for i, j in zip([0, *ends], ends)]


def _open_windows(plan: Plan, a: dict[str, np.ndarray], codes: np.ndarray) -> np.ndarray:
    """Starts of the windows to compare one by one."""
    hi = np.where(codes & OPEN, a["hi"], np.minimum(a["hi"], a["at"] - (plan.window - plan.mid) - 1))
    at = _ranges(a["lo"], np.where(codes & (OPEN | DEEP), hi, a["lo"] - 1))
    return np.unique(at)


def _send_runs(plan: Plan, pid: int, table: pa.Table, inbox: list) -> list:
    g = Group(plan, table)
    a = g.anchors()
    first, which, bucket, _ = g.distinct(a)
    codes = np.frombuffer(b"".join(marshal.loads(x[2]) for x in inbox), np.uint8)
    pick = np.flatnonzero(codes & SEND)
    at = first[pick]
    to = np.where(codes[pick] & DEEP, (a["mid"][at] % np.uint64(plan.buckets)).astype(np.int64), bucket[pick])
    strings = g.contexts(a["at"][at], a["left"][at], a["right"][at])
    mail = defaultdict(lambda: [b"", b"", b"", b"", b"", b"", b"", b"", b""])
    mail[pid % plan.buckets][0] = codes.tobytes()
    order = np.argsort(to, kind="stable")
    for b, i, j in _split(to[order]):
        run = sorted((*strings[x], int(pick[x])) for x in order[i:j].tolist())
        mail[b][1:7] = np.array([x[2] for x in run], np.uint32).tobytes(), *front_coded([x[0] for x in run]), *packed([x[1] for x in run])
    hashes, times = np.unique(g.window_hashes(_open_windows(plan, a, codes[which] if len(codes) else which)), return_counts=True)
    to = (hashes % np.uint64(plan.buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    for b, i, j in _split(to[order]):
        x = order[i:j]
        mail[b][7:] = hashes[x].tobytes(), (times[x] > 1).tobytes()
    return [(b, pid, marshal.dumps(tuple(x))) for b, x in mail.items()]


def reach(left: list[bytes], shared: list[int], unit: int, need: int) -> tuple[list[int], list[int]]:
    """Longest reach to the left and to the right of each suffix, in symbols, over the partners that agree in ``need``.

    ``left``: reversed left contexts in suffix order; ``shared[i]``: symbols that suffixes
    i - 1 and i share. Sets of suffixes join from the longest shared prefix down; a suffix
    that joins a set is compared with its neighbours by left context only, since any other
    member agrees less to the left, and no more to the right, than one of these two.
    """
    n = len(left)
    far_left, far_right = [0] * n, [0] * n
    widest = max(map(len, left), default=0) // unit
    joins = sorted((i for i in range(1, n) if shared[i] + widest >= need), key=shared.__getitem__, reverse=True)
    members: dict[int, list] = {}
    home = list(range(n))

    def find(i: int) -> int:
        while home[i] != i:
            home[i] = home[home[i]]
            i = home[i]
        return i

    for i in joins:
        depth = shared[i]
        x, y = find(i - 1), find(i)
        p, q = members.pop(x, None) or [(left[x], x)], members.pop(y, None) or [(left[y], y)]
        if len(p) < len(q):
            x, y, p, q = y, x, q, p
        home[y] = x
        for s, me in q:
            at = bisect_left(p, (s, me))
            for t, other in p[max(0, at - 1) : at + 1]:
                both = common_prefix(s, t) // unit
                if both + depth >= need:
                    for z in (me, other):
                        if both > far_left[z]:
                            far_left[z] = both
                        if depth > far_right[z]:
                            far_right[z] = depth
            p.insert(at, (s, me))
        members[x] = p
    return far_left, far_right


def _match_runs(plan: Plan, inbox: list) -> list:
    got = [marshal.loads(x[2]) for x in inbox]
    runs = [(np.frombuffer(x[2], np.uint16).tolist(), np.frombuffer(x[3], np.uint16).tolist(), x[4], unpacked(x[5], x[6])) for x in got]
    far = plan.resolve(runs, plan.window)
    hashes = np.concatenate([np.frombuffer(x[7], np.uint64) for x in got])
    times = np.concatenate([np.frombuffer(x[8], np.uint8) for x in got]).astype(np.int64) + 1
    _, which = np.unique(hashes, return_inverse=True)
    again = np.bincount(which, times)[which] > 1 if len(hashes) else np.zeros(0, bool)
    sizes = np.cumsum([0, *(len(x[8]) for x in got)])
    out = []
    for (b, pid, _), x, (m, n), i, j in zip(inbox, got, far, sizes, sizes[1:]):
        out.append((b, pid, marshal.dumps((x[0], x[1], np.array(m, np.uint16).tobytes(), np.array(n, np.uint16).tobytes(), hashes[i:j][again[i:j]].tobytes()))))
    return out


# --- result: the symbols that repeated windows cover -----------------------------------------


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All integers of the closed ranges, one range after the other."""
    n = np.maximum(0, last - first + 1)
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(first - (ends - n), n)


def _marks(plan: Plan, g: Group, inbox: list) -> np.ndarray:
    """Mask of the group's symbols that a repeated window covers."""
    got = [marshal.loads(x[2]) for x in inbox]
    a = g.anchors()
    if not len(a["at"]):
        return np.zeros(g.size, bool)
    first, which, _, _ = g.distinct(a)
    codes = np.frombuffer(next(x[0] for x in got if x[0]), np.uint8)
    equal = (codes & EQUAL) > 0
    left, right = np.where(equal, a["left"][first], 0), np.where(equal, a["right"][first], 0)
    ids, m, n = (np.concatenate([np.frombuffer(x[i], t) for x in got]).astype(np.int64) for i, t in ((1, np.uint32), (2, np.uint16), (3, np.uint16)))
    left[ids], right[ids] = np.maximum(left[ids], m), np.maximum(right[ids], n)
    left, right = left[which], right[which]
    some = left + right >= plan.window
    rest = _open_windows(plan, a, codes[which])
    rest = rest[np.isin(g.window_hashes(rest), np.concatenate([np.frombuffer(x[4], np.uint64) for x in got]))]
    starts = np.concatenate(((a["at"] - left)[some], rest))
    ends = np.concatenate(((a["at"] + right)[some], rest + plan.window))
    return covered(starts, ends - starts, g.size)


def repeated(docs: DataFrame, plan: Callable[[int], Plan], digest: Callable, schema: str) -> DataFrame:
    """Rows of ``digest(part, mask, rows)`` for every chunk of every group."""
    n = groups.group_count(docs)
    p = plan(n)
    base = groups.text_groups(docs, n)

    def rows(pid: int, table: pa.Table, inbox: list) -> pa.Table:
        g = Group(p, table)
        mask = _marks(p, g, inbox) if inbox else np.zeros(g.size, bool)
        out, row = [], 0
        for start, unit, first, last, extra in g.parts:
            ids = table["doc_id"].slice(row, len(first))
            row += len(first)
            out.append(digest(extra, mask[start : start + len(unit)], first, last, ids))
        return pa.concat_tables(out) if out else empty

    empty = digest(None, None, None, None, None)
    mail = groups.answer(groups.ask(base, None, lambda *x: _send_prefixes(p, *x)), lambda x: _count_prefixes(p, x))
    mail = groups.answer(groups.ask(base, mail, lambda *x: _send_runs(p, *x)), lambda x: _match_runs(p, x))
    return groups.finish(base, mail, rows, schema).select("doc_id", *[F.col(c.split()[0]) for c in schema.split(", ")[1:]])
