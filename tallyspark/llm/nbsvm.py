"""Operator 5: quality classifier, Naive Bayes support vectors.

A document's features are indicators of its n-grams: single words and word pairs
(A-Z lower-cased), byte trigrams, and runs of three word marks, where a mark says whether
a word repeats the one before and which kinds of characters it holds. They are hashed to ``SLOTS``.
Each indicator is scaled by its log-count ratio between the classes; a linear model
with hinge loss is fitted on these by dual coordinate descent. A sigmoid, fitted on the
margins of a left-out part of the sample, turns margins into scores.

Fitting uses a sample of at most ``SAMPLE`` labelled rows (those with the least hash of their
doc_id); scoring reads every document once, without a shuffle, with ``SLOTS`` weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ship import ship
from .text import BYTE_SYMBOL, Rolling, U64, chunks, joined, mix, word_bounds, word_hashes

SLOTS = 1 << 18
SAMPLE = 6_000
CHUNK = 1 << 18
EPOCHS, COST, SMOOTH = 20, 1.0, 1.0
THRESHOLD = 0.3
#: Bits by byte: upper-case, lower-case, digit, other ASCII, beyond ASCII.
_KIND = np.array([1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 else 4 if 48 <= b <= 57 else 8 if b < 128 else 16 for b in range(256)], np.uint8)


def features(texts: list[bytes | None]) -> list[np.ndarray]:
    """Sorted slots of each text's different n-grams."""
    data, start, end = joined(texts)
    folded = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    begin, stop = word_bounds(data)
    words = word_hashes(folded, begin, stop)
    n = len(words)
    kinds = np.bitwise_or.reduceat(_KIND[data], np.stack((begin, stop), 1).ravel())[::2] if n else np.zeros(0, np.uint8)
    again = np.zeros(n, np.uint8)
    again[1:] = words[1:] == words[:-1]
    first, last = np.searchsorted(begin, start), np.searchsorted(begin, end)
    again[first[first < n]] = 0  # a text's first word repeats nothing
    marks = mix((kinds | again << 5).astype(np.uint64) + U64(11))

    def slots(values: np.ndarray, salt: int) -> np.ndarray:
        return (mix(values ^ U64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % U64(SLOTS)).astype(np.int64)

    pairs = slots(Rolling(words).every(2), 2)
    runs = slots(Rolling(marks).every(3), 3)
    ones = slots(words, 1)
    grams = slots(Rolling(BYTE_SYMBOL[data]).every(3), 4)
    seen = np.zeros(SLOTS, bool)
    out = []
    for i, j, a, b in zip(first.tolist(), last.tolist(), start.tolist(), end.tolist()):
        seen[ones[i:j]] = True
        seen[pairs[i : max(i, j - 1)]] = True
        seen[runs[i : max(i, j - 2)]] = True
        seen[grams[a : max(a, b - 2)]] = True
        f = np.flatnonzero(seen)
        seen[f] = False
        out.append(f)
    return out


def fit(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, float, float, float]:
    """Slot weights, bias and the two numbers of the sigmoid, from features and 0/1 labels.

    With one class only, every score is that class; without rows, every score is 0.5.
    """
    if len(set(labels.tolist())) < 2:
        return np.zeros(SLOTS, np.float32), 0.0, 0.0, 0.0 if not len(labels) else 40.0 if labels[0] else -40.0
    y = np.where(labels > 0, 1.0, -1.0)
    fold = np.arange(len(rows)) % 5 == 0  # for the sigmoid only
    if len(set(y[fold])) < 2 or len(set(y[~fold])) < 2:
        fold[:] = True
    learn = np.ones(len(y), bool) if fold.all() else ~fold
    weights, bias = descend([r for r, f in zip(rows, learn) if f], y[learn])
    slope, shift = sigmoid(np.array([margin(weights, bias, r) for r, f in zip(rows, fold) if f]), y[fold])
    weights, bias = descend(rows, y)
    return weights.astype(np.float32), bias, slope, shift


def margin(weights: np.ndarray, bias: float, f: np.ndarray) -> float:
    return float(weights[f].sum(dtype=np.float64)) / np.sqrt(len(f) + 1.0) + bias


def descend(rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for hinge loss on ratio-scaled indicators, rows scaled to comparable length."""
    p, q = np.full(SLOTS, SMOOTH), np.full(SLOTS, SMOOTH)
    for f, s in zip(rows, y):
        (p if s > 0 else q)[f] += 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    scaled = [ratio[f] / np.sqrt(len(f) + 1.0) for f in rows]
    square = np.array([x @ x + 1.0 for x in scaled])
    w, bias, alpha = np.zeros(SLOTS), 0.0, np.zeros(len(rows))
    most = np.where(y > 0, COST * len(y) / (2 * (y > 0).sum()), COST * len(y) / (2 * (y < 0).sum()))  # classes weigh alike
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        worst = 0.0
        for i in order.permutation(len(rows)):
            f, x = rows[i], scaled[i]
            g = y[i] * (w[f] @ x + bias) - 1.0
            new = min(max(alpha[i] - g / square[i], 0.0), most[i])
            if step := new - alpha[i]:
                w[f] += step * y[i] * x
                bias += step * y[i]
                alpha[i] = new
                worst = max(worst, abs(step))
        if worst < 1e-3:
            break
    return w * ratio, bias


def sigmoid(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of 1 / (1 + exp(-(slope * margin + shift))) by Newton steps on smoothed targets."""
    up, down = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -35, 35)))
        w = p * (1 - p) + 1e-9
        g = np.array([((t - p) * margins).sum() - 1e-3 * a, (t - p).sum()])
        h = np.array([[(w * margins * margins).sum() + 1e-3, (w * margins).sum()], [(w * margins).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a + np.clip(step[0], -1, 1), b + np.clip(step[1], -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def held_out() -> Column:
    """Whether crc32 of the doc_id as text leaves no remainder by 5; a null doc_id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _batches(batches: Iterator[pa.RecordBatch], step) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch["text"].to_pylist()
        for i, j in chunks(np.array([len(t or b"") for t in texts], np.int64), CHUNK):
            yield step(batch.slice(i, j - i), features(texts[i:j]))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple:
    """Model from the labelled rows that are not held out, of these the ``sample`` with the least hash of doc_id.

    The bound holds for the rows that are fitted: labels are bounded first, and the rows that
    they meet (a doc_id may stand in many) once more, by doc_id, label and a hash of the text. Labels that are null, or whose doc_id is null or not in ``docs``, teach nothing; one
    doc_id with several labels or texts gives several rows. Only text and quality are used.
    """
    ship(docs.sparkSession)
    some = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("tie")).join(some, "doc_id").select("doc_id", "quality", "tie", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(batches, lambda b, f: pa.RecordBatch.from_arrays(
            [b["doc_id"], b["quality"], b["tie"], pa.array([x.astype(np.int32) for x in f], pa.list_(pa.int32()))], ["doc_id", "quality", "tie", "f"]))

    def learn(table: pa.Table) -> pa.Table:
        order = pa.compute.sort_indices(table.select(["doc_id", "quality", "tie"]), sort_keys=[(c, "ascending") for c in ("doc_id", "quality", "tie")]).to_numpy()
        rows = [np.asarray(part.flatten()) for chunk in table["f"].chunks for part in (chunk.slice(i, 1) for i in range(len(chunk)))]
        weights, *rest = fit([rows[i] for i in order], table["quality"].to_numpy()[order])
        return pa.table([pa.array([weights.tobytes()]), *[pa.array([float(x)]) for x in rest]], ["weights", "bias", "slope", "shift"])

    found = rows.mapInArrow(extract, "doc_id long, quality int, tie long, f array<int>")
    found = found.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "tie").limit(sample)
    got = found.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(
        learn, "weights binary, bias double, slope double, shift double").collect()
    if not got:
        return fit([], np.zeros(0))
    return np.frombuffer(bytes(got[0].weights), np.float32), got[0].bias, got[0].slope, got[0].shift


def score(docs: DataFrame, model: tuple) -> DataFrame:
    """All columns of ``docs`` (those named score, predicted or held_out are replaced), score in [0, 1] and predicted.

    Null and empty texts have no features: their score is the sigmoid of the bias alone.
    Repeated rows score alike; no order or partitioning changes a score. An empty table
    gives no rows.
    """
    ship(docs.sparkSession)
    weights, bias, slope, shift = model
    docs = docs.drop("score", "predicted", "held_out")
    rows = docs.withColumn("text", F.col("text").cast("binary"))
    schema = rows.withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(batch: pa.RecordBatch, found: list[np.ndarray]) -> pa.RecordBatch:
            m = np.array([margin(weights, bias, f) for f in found])
            p = 1 / (1 + np.exp(-np.clip(slope * m + shift, -35, 35)))
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, "score"])

        return _batches(batches, one)

    out = rows.mapInArrow(run, schema)
    return out.withColumn("text", F.col("text").cast("string")).withColumns({
        "held_out": held_out(), "predicted": (F.col("score") >= THRESHOLD).cast("int")})
