"""Operator 1: language-model scoring by cross-entropy difference.

Two bigram models, of the target documents and of all others (the background), are matched: same
order, same smoothing, one vocabulary, which is every token of the corpus. A document is
<s> w1 ... wn </s>, and each token after <s> is scored. With counts c of a model, N its tokens
and p0 the pooled frequency of a token in the whole corpus,

    p1(w)   = (c(w) + MU p0(w)) / (N + MU)
    p(w|v)  = (c(v w) + KAPPA p1(w)) / (c(v) + KAPPA)

A document's score is the mean over its tokens of log2 p_background - log2 p_target: the target's
cross-entropy less the background's. Lower is more like the target.

Counts cover the whole corpus. Each text group sends its different n-grams, sorted and
delta-coded, with their counts to the buckets, and gets back the corpus counts of just
these; n-grams are 56-bit hashes. A frequent n-gram costs one entry a group.
"""

from __future__ import annotations

import marshal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import groups
from .ship import ship
from .text import U64, chunks, joined, mix, word_bounds, word_hashes

MU, KAPPA = 1000.0, 20.0
GROUP_BYTES = 8 << 20
CHUNK = 1 << 20
START, END, TOTAL = (U64(x) for x in (0x51ED270B0F5C2A11, 0x2127599BF4325C37, 0x880355F21E6D1965))
SCHEMA = "doc_id long, n_tokens long, ce_target double, ce_background double, score double"


def small(values: np.ndarray) -> tuple[bytes, bytes]:
    """Counts as bytes, 255 and more apart."""
    return np.minimum(values, 255).astype(np.uint8).tobytes(), values[values >= 255].astype(np.uint64).tobytes()


def large(code: tuple[bytes, bytes]) -> np.ndarray:
    out = np.frombuffer(code[0], np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(code[1], np.uint64).astype(np.int64)
    return out


def deltas(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte planes one after the other (the upper ones are mostly zero)."""
    d = np.diff(keys, prepend=U64(0))
    return d.view(np.uint8).reshape(-1, 8)[:, :7].T.tobytes()


def undeltas(code: bytes) -> np.ndarray:
    n = len(code) // 7
    d = np.zeros((n, 8), np.uint8)
    d[:, :7] = np.frombuffer(code, np.uint8).reshape(7, n).T
    return np.cumsum(d.view(np.uint64).ravel(), dtype=np.uint64)


class Tokens:
    """Tokens of a text group with their n-gram keys."""

    def __init__(self, table: pa.Table):
        texts = [t or b"" for t in table["text"].to_pylist()]
        found, counts = [], []
        for i, j in chunks(np.array([len(t) for t in texts], np.int64), CHUNK):
            data, start, end = joined(texts[i:j])
            begin, stop = word_bounds(data)
            words = word_hashes(data, begin, stop)
            last = np.searchsorted(begin, end)
            found.append(np.insert(words, last, END))
            counts.append(last - np.searchsorted(begin, start) + 1)
        self.token, self.sizes = np.concatenate(found), np.concatenate(counts)
        self.first = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        before = np.empty_like(self.token)
        before[1:] = self.token[:-1]
        before[self.first] = START
        ones = mix(self.token) >> U64(8)
        twos = mix(before * U64(0x9E3779B97F4A7C15) + mix(self.token ^ U64(0x5555))) >> U64(8)
        keys = np.concatenate((ones, twos, [TOTAL >> U64(8)]))
        self.keys, self.which = np.unique(keys, return_inverse=True)
        self.end = np.searchsorted(self.keys, mix(np.array([END])) >> U64(8))[0]


def _buckets(keys: np.ndarray, n: int) -> np.ndarray:
    """Ranges of the key space, so that each bucket's keys are consecutive."""
    return ((keys >> U64(24)) * U64(n) >> U64(32)).astype(np.int64)


def _send(n: int, pid: int, table: pa.Table, inbox: list) -> list:
    t = Tokens(table)
    wanted = {marshal.loads(x[2]) for x in inbox}
    chosen = np.array([d in wanted for d in table["doc_id"].to_pylist()])
    per_token = np.repeat(chosen, t.sizes)
    weight = np.concatenate((per_token, per_token, [0])).astype(np.float64)
    target = np.bincount(t.which, weight, len(t.keys)).astype(np.int64)
    both = np.bincount(t.which, minlength=len(t.keys))
    target[t.which[-1]], both[t.which[-1]] = per_token.sum(), len(per_token)
    bucket = _buckets(t.keys, n)
    cuts = np.searchsorted(bucket, np.arange(n + 1))
    return [(b, pid, marshal.dumps((deltas(t.keys[i:j]), small(target[i:j]), small(both[i:j] - target[i:j]))))
            for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i]


def _add(inbox: list) -> list:
    got = [marshal.loads(x[2]) for x in inbox]
    keys = [undeltas(x[0]) for x in got]
    known, which = np.unique(np.concatenate(keys), return_inverse=True)
    sums = [np.bincount(which, np.concatenate([large(x[i]) for x in got]), len(known)).astype(np.int64)[which] for i in (1, 2)]
    cuts = np.cumsum([0, *map(len, keys)])
    return [(b, pid, marshal.dumps((small(sums[0][i:j]), small(sums[1][i:j])))) for (b, pid, _), i, j in zip(inbox, cuts, cuts[1:])]


def _entropy(t: Tokens, count: np.ndarray, pooled: np.ndarray) -> np.ndarray:
    """log2 p of each token under the model with these corpus counts (by key)."""
    n = len(t.token)
    one, two = t.which[:n], t.which[n : 2 * n]
    before = np.empty(n, np.int64)
    before[1:] = one[:-1]
    before[t.first] = t.end  # as many documents start as end
    total = count[t.which[-1]]
    p1 = (count[one] + MU * (pooled[one] / pooled[t.which[-1]])) / (total + MU)
    return np.log2((count[two] + KAPPA * p1) / (count[before] + KAPPA))


def _score(pid: int, table: pa.Table, inbox: list) -> pa.Table:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    if not table.num_rows:
        return pa.table([pa.array([], pa.int64())] * 2 + [pa.array([], pa.float64())] * 3, names)
    t = Tokens(table)
    got = [marshal.loads(x[2]) for x in inbox]
    target, other = (np.concatenate([large(x[i]) for x in got]).astype(np.float64) for i in (0, 1))
    pooled = target + other
    ce = [-np.add.reduceat(_entropy(t, c, pooled), t.first) / t.sizes for c in (target, other)]
    return pa.table([table["doc_id"].combine_chunks().cast(pa.int64()), pa.array(t.sizes.astype(np.int64)), *map(pa.array, ce), pa.array(ce[0] - ce[1])], names)


def cross_entropy_difference(docs: DataFrame, target: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; further columns are ignored): n_tokens, ce_target, ce_background, score.

    ``target``: doc_ids of the target documents (null and unknown ones are ignored,
    repeats do no harm). Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; n_tokens counts </s> too.
    A null or empty text is </s> alone. A model without documents is the pooled
    distribution. Rows that share a doc_id are separate documents of one class; a null
    doc_id is background. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    n = groups.group_count(docs, GROUP_BYTES)
    base = groups.text_groups(docs, n)  # by doc_id and text: rows that share a doc_id are spread

    def labels(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(b.num_rows, np.int32)), b["pid"], pa.array([marshal.dumps(x) for x in b["doc_id"].to_pylist()], pa.binary())],
                ["bucket", "pid", "blob"])

    chosen = target.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    chosen = chosen.join(base.select("doc_id", "pid").distinct(), "doc_id").mapInArrow(labels, groups.LETTER)
    mail = groups.answer(groups.ask(base, chosen, lambda *x: _send(n, *x)), _add)
    return groups.finish(base, mail, _score, SCHEMA)
