"""k-means for many (k, restart) models at once.

A sweep fits k = 2..8 with several restarts each. All models share the rows, so one scan an
iteration assigns every row to its centre in every model and sums up the new centres of all of
them; a sweep takes at most ``max_iter`` scans instead of one per model and iteration.
Models whose centres have stopped moving leave the scan.

Starts are deterministic: a restart's first centre is the row whose key has the least MD5 with the restart's
number, the next ones are farthest-first (the row with the greatest distance to its nearest
centre so far). One sequence serves every k of its restart, so starts take max(k) scans.

A row is ``x``, an array of doubles, and optionally ``on``, the places of the ones in a one-hot block
behind it (as many in every row). Centres hold both parts in full. Rows with equal ``on`` that
follow each other share that part of the distances, so a row costs its few numbers, not a number a level.

The scans of a sweep read the rows as blocks of numbers, written once (``pack``): a block is one
value to Spark, so a scan costs little beside the sums. A block's rows lie near each other and it knows
the box that they fill and their sum. If the whole box is nearest to one centre of a model, the block
counts for it by its sum; only blocks that a model divides are read row by row for it, many of them at once. The more rows
there are, the smaller the boxes and the fewer the divided blocks. No row is left out.

A scan sends (models x k) sums a task, added up in Spark; rows never leave their
partitions, and the driver holds centres only. Squared distances are rounded to nine places
before they are compared, so ties fall to the first centre or least key on every layout.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.plans.materialize import materialize

PLACES = 9
STILL = 1e-9
MARGIN = 1e-6
BLOCK = 32  # rows of a block; a box is tested at the cost of a few rows
PIECE = 131_072  # rows that are halved into blocks together
SLICE = 4_096  # rows whose distances are in memory at once


@dataclass
class Model:
    """Centres of one k (rows), the sum of squared distances of all rows to their centres, and the length of the one-hot block."""

    k: int
    restart: int
    centres: np.ndarray
    inertia: float = 0.0
    slots: int = 0


def _points(rows: DataFrame) -> DataFrame:
    """``rows`` with ``on``, empty where there is no one-hot block."""
    return rows if "on" in rows.columns else rows.withColumn("on", F.array().cast("array<int>"))


def _tools() -> SimpleNamespace:
    """Functions for tasks, made here so that they travel by value (workers need not have this package)."""
    block, places, margin, together, kept = BLOCK, PLACES, MARGIN, SLICE, {}

    def space(name: str, shape: tuple, kind: type = float) -> np.ndarray:
        """Memory kept from block to block; fresh pages for each would cost more than the sums."""
        size = int(np.prod(shape))
        if name not in kept or kept[name].size < size:
            kept[name] = np.empty(size, kind)
        return kept[name][:size].reshape(shape)

    def leaves(x: np.ndarray) -> Iterator[np.ndarray]:
        """Places of the rows of ``x`` in pieces of at most a block, halved in the widest column."""
        waiting = [np.arange(len(x))]
        while waiting:
            at = waiting.pop()
            if len(at) <= block:
                yield at
                continue
            some, half = x[at], -(-len(at) // (2 * block)) * block  # whole blocks
            order = np.argpartition(some[:, np.ptp(some, axis=0).argmax()], half)
            waiting += [at[order[half:]], at[order[:half]]]

    def blocks(x: pa.Array, on: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of near rows with equal ``on``: places of the rows, matrix (x, 1 and the square of the whole row; a column a row), on."""
        n = len(x)
        if not n:
            return
        x = x.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        on = on.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        order = np.lexsort(on.T) if on.shape[1] else np.arange(n)
        edges = [0, *(np.flatnonzero((np.diff(on[order], axis=0) != 0).any(axis=1)) + 1).tolist(), n]
        for a, b in zip(edges, edges[1:]):
            for at in leaves(x[order[a:b]]):
                at = order[a:b][at]
                rows = np.empty((x.shape[1] + 2, len(at)))
                rows[:-2], rows[-2], rows[-1] = x[at].T, 1, (x[at] ** 2).sum(axis=1) + on.shape[1]
                yield at, rows, on[at[0]]

    def alike(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The blocks of a batch by ``on``: places in the batch, boxes (least x, greatest x, sum of the rows; a row a block), on."""
        n = batch.num_rows
        if n:
            boxes = np.frombuffer(b"".join(batch["box"].to_pylist())).reshape(n, -1)
            on = batch["on"].flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            kinds, which = np.unique(on, axis=0, return_inverse=True) if on.shape[1] else (on[:1], np.zeros(n, int))
            for k, kind in enumerate(kinds):
                at = np.flatnonzero(which.ravel() == k)
                yield at, boxes[at], kind.astype(int)

    def matrix(some: pa.Scalar, height: int) -> np.ndarray:
        return np.frombuffer(some.as_buffer()).reshape(height, -1)

    def stack(batch: pa.RecordBatch, at: np.ndarray, height: int) -> np.ndarray:
        """The blocks at some places as one array: height, blocks, rows. Short ones end in rows of zeros, which count nowhere."""
        found = [matrix(some, height) for some in batch["block"].take(pa.array(at))]
        out = np.zeros((height, len(found), max((some.shape[1] for some in found), default=1)))
        for i, some in enumerate(found):
            out[:, i, : some.shape[1]] = some
        return out

    def slices(stacked: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
        """The rows of the stacked blocks at some places, side by side, in pieces of about ``SLICE``."""
        step = max(1, together // stacked.shape[2])
        for a in range(0, len(at), step):
            yield stacked.take(at[a : a + step], axis=1).reshape(len(stacked), -1)

    def form_of(on: np.ndarray, centres: np.ndarray, squares: np.ndarray, height: int) -> np.ndarray:
        """Matrix whose product with the rows of a block is |row|^2 - 2 row . centre + squares, a row a centre."""
        p = height - 2
        form = np.empty((len(centres), height))
        form[:, :p] = centres[:, :p]
        form[:, p] = centres[:, p + on].sum(axis=1)
        form[:, : p + 1] *= -2
        form[:, p] += squares
        form[:, -1] = 1
        return form

    def apart(rows: np.ndarray, form: np.ndarray, name: str = "d") -> np.ndarray:
        """The product, for each centre (first axis) and row; valid until the next call with this ``name``."""
        return np.matmul(form, rows, out=space(name, (len(form), rows.shape[1])))

    def rivals(boxes: np.ndarray, form: np.ndarray, edges: Sequence[int]) -> np.ndarray:
        """Whether each centre could be the nearest one of its model to a point of the box: boxes x centres.

        What the centre nearest to the box's middle is nearer by there is compared with what another could
        gain up to the box's farthest corner; those that lose by ``MARGIN`` at least are out. One rival owns the box.
        """
        p = form.shape[1] - 2
        middle, half = (boxes[:, :p] + boxes[:, p : 2 * p]) / 2, (boxes[:, p : 2 * p] - boxes[:, :p]) / 2
        at, half, out = form[:, :p] @ middle.T + form[:, p, None], half.T, np.empty((len(form), len(boxes)), bool)
        for a, b in zip(edges, edges[1:]):
            k, part, own = b - a, form[a:b, :p], at[a:b]
            best, least = own.argmin(axis=0), own.min(axis=0)
            gain = np.matmul(np.abs(part[:, None] - part).reshape(k * k, p), half, out=space("gain", (k * k, len(boxes)))).reshape(k, k, -1)
            mine = np.take_along_axis(gain, best[None, None], axis=0)[0]
            np.less_equal(own - least - mine, margin, out=out[a:b])
        return out.T

    def nearest(d: np.ndarray, edges: Sequence[int]) -> np.ndarray:
        """Whether each row belongs to each centre of all models: 1 for the first centre with the least rounded distance."""
        near, i, size = space("near", d.shape), 0, np.diff(edges)
        while i < len(size):
            j = i
            while j < len(size) and size[j] == size[i]:
                j += 1
            part = d[edges[i] : edges[j]].reshape(j - i, size[i], -1)
            least = part.min(axis=1)
            hit = np.less_equal(part, (least + 2 * 10.0**-places)[:, None], out=space("hit", part.shape, bool))
            if np.count_nonzero(hit) > least.size:  # only these can tie once they are rounded
                m, r = np.nonzero(np.count_nonzero(hit, axis=1) > 1)
                first = np.maximum(part[m, :, r], 0).round(places).argmin(axis=1)
                hit[m, :, r] = first[:, None] == np.arange(size[i])
            near[edges[i] : edges[j]] = hit.reshape(-1, d.shape[1])
            i = j
        return near

    return SimpleNamespace(**{f.__name__: f for f in (blocks, alike, matrix, stack, slices, form_of, apart, rivals, nearest)})


def pack(rows: DataFrame) -> DataFrame:
    """Blocks of near rows with equal ``on``: on, the block's matrix (x, 1 and the square of the row; a column a row) as
    doubles, its box (least x, greatest x, sum of the rows), and its keys (ends and bytes; a null is empty, others follow a letter)."""
    tools, piece = _tools(), PIECE

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows in batches of about ``PIECE``."""
        waiting, n = [], 0
        for batch in batches:
            waiting.append(batch)
            n += batch.num_rows
            if n >= piece:
                yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
                waiting, n = [], 0
        if n:
            yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in pieces(batches):
            names = pc.fill_null(pc.binary_join_element_wise("k", batch["key"].cast(pa.string()), ""), "")
            found = []
            for at, some, on in tools.blocks(batch["x"], batch["on"]):
                x = some[:-2]
                box = np.concatenate((x.min(axis=1), x.max(axis=1), some.sum(axis=1)))
                key = names.take(pa.array(at)).to_pylist()
                key = [k.encode() for k in key]
                found.append((on.tolist(), some.tobytes(), box.tobytes(), np.cumsum([0, *map(len, key)]).tobytes() + b"".join(key)))
            if found:
                kinds = [pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], ["on", "block", "box", "keys"])

    return _points(rows).select("key", "x", "on").mapInArrow(run, "on array<int>, block binary, box binary, keys binary")


def _sums(packed: DataFrame, size: int, part: Callable) -> np.ndarray:
    """Sum of what ``part(total, batch)`` adds to ``size`` doubles, over all batches of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            part(total, batch)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["i", "value"])

    out = np.zeros(size)
    found = packed.select("on", "block", "box").mapInArrow(run, "i int, value double").groupBy("i").agg(F.sum("value").alias("value")).toArrow()
    out[found["i"].to_numpy()] = found["value"].to_numpy()
    return out


def _farthest(packed: DataFrame, chosen: np.ndarray, slots: int) -> list[tuple[list[float], list[int]]]:
    """For each restart (first axis) the row farthest from all of its centres; the least key on a tie.

    A block is read only if its box could hold a row as far as the farthest so far.
    """
    places, margin, tools = PLACES, MARGIN, _tools()
    restarts, centres = len(chosen), chosen.reshape(-1, chosen.shape[2])
    squares, height = (centres**2).sum(axis=1), centres.shape[1] - slots + 2
    p = height - 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [None] * restarts
        for batch in batches:
            for at, boxes, on in tools.alike(batch):
                form = tools.form_of(on, centres, squares, height)
                rest = form[:, p] - (centres[:, :p] ** 2).sum(axis=1) + len(on)  # the one-hot block's part
                far = np.maximum(np.abs(boxes[:, None, :p] - centres[:, :p]), np.abs(boxes[:, None, p : 2 * p] - centres[:, :p]))
                bound = ((far**2).sum(axis=2) + rest).reshape(len(at), restarts, -1).min(axis=2)
                for i in np.argsort(-bound.max(axis=1), kind="stable").tolist():
                    could = [r for r in range(restarts) if best[r] is None or bound[i, r] + margin >= -best[r][0]]
                    if not could:
                        continue
                    some = tools.matrix(batch["block"][int(at[i])], height)
                    d = tools.apart(some, form).reshape(restarts, -1, some.shape[1])[could].min(axis=1)
                    d = np.maximum(d, 0).round(places)
                    for r, of, most in zip(could, d, d.max(axis=1).tolist()):
                        if best[r] is None or -most <= best[r][0]:
                            blob, n = batch["keys"][int(at[i])].as_py(), some.shape[1]
                            ends = np.frombuffer(blob, np.int64, n + 1) + 8 * (n + 1)
                            key, j = min((blob[ends[j] : ends[j + 1]], j) for j in np.flatnonzero(of == most).tolist())
                            if best[r] is None or (-most, key) < best[r][:2]:
                                best[r] = (-most, key, some[:p, j].tolist(), on.tolist())
        got = [(r, d, key[1:].decode() if key else None, x, on) for r, (d, key, x, on) in ((r, b) for r, b in enumerate(best) if b)]
        columns = zip(*got) if got else [()] * 5
        kinds = [pa.int32(), pa.float64(), pa.string(), pa.list_(pa.float64()), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["r", "d", "k", "x", "on"])

    got = packed.select("on", "block", "box", "keys").mapInArrow(run, "r int, d double, k string, x array<double>, on array<int>")
    return [tuple(point) for _, point in sorted(got.groupBy("r").agg(F.min_by(F.struct("x", "on"), F.struct("d", "k"))).collect())]


def _full(points: Sequence[tuple[list[float], list[int]]], slots: int) -> np.ndarray:
    """Points in full length, the ones of their one-hot block set."""
    out = np.zeros((len(points), len(points[0][0]) + slots))
    for row, (x, on) in zip(out, points):
        row[: len(x)] = x
        row[[len(x) + i for i in on]] = 1
    return out


def starts(rows: DataFrame, n_init: int, most: int, packed: DataFrame | None = None) -> np.ndarray:
    """Farthest-first centres of every restart: (n_init, most, dimensions). ``packed``: the blocks of ``rows``, if they are written."""
    rows = _points(rows)
    first = [F.min_by(F.struct("x", "on"), F.struct(F.md5(F.concat(F.lit(f"{r}:"), "key").cast("binary")), "key")).alias(f"r{r}") for r in range(n_init)]
    *first, last = rows.agg(*first, F.max(F.array_max("on"))).first()
    slots = 0 if last is None else last + 1
    chosen = _full([tuple(point) for point in first], slots)[:, None]
    packed = pack(rows) if packed is None else packed
    while chosen.shape[1] < most:
        chosen = np.concatenate((chosen, _full(_farthest(packed, chosen, slots), slots)[:, None]), axis=1)
    return chosen


def _cluster_sums(packed: DataFrame, edges: list[int], centres: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, sum of squares and sum of the rows of each centre of all models, in one scan.

    A block that lies whole in a model's cluster gives its sum; only models that may divide a block look at its rows.
    """
    tools = _tools()
    squares, width, height = (centres**2).sum(axis=1), centres.shape[1] + 2, centres.shape[1] - slots + 2
    p, model = height - 2, np.repeat(np.arange(len(edges) - 1), np.diff(edges))

    def part(total: np.ndarray, batch: pa.RecordBatch) -> None:
        total = total.reshape(len(centres), width)
        for at, boxes, on in tools.alike(batch):
            form = tools.form_of(on, centres, squares, height)
            near = tools.rivals(boxes, form, edges)
            divided = np.add.reduceat(near, edges[:-1], axis=1, dtype=int) > 1
            sums = (near & ~divided[:, model]).T.astype(float) @ boxes[:, 2 * p :]
            read = np.flatnonzero(divided.any(axis=1))
            stacked = tools.stack(batch, at[read], height)
            for of, a, b in zip(divided[read].T, edges, edges[1:]):
                for some in tools.slices(stacked, np.flatnonzero(of)):
                    sums[a:b] += tools.nearest(tools.apart(some, form[a:b]), [0, b - a]) @ some.T
            total[:, : p + 2] += sums
            total[:, p + 2 + on] += sums[:, p, None]

    found = _sums(packed, len(centres) * width, part).reshape(len(centres), width)
    return found[:, p], found[:, p + 1], np.delete(found, [p, p + 1], axis=1)


def lloyd(packed: DataFrame, models: list[Model], max_iter: int) -> int:
    """Move all models' centres to the means of their rows, in one scan an iteration; returns the scans.

    A centre without rows stays where it is.
    """
    live, scans = list(models), 0
    while live and scans < max_iter:
        edges = np.cumsum([0, *(m.k for m in live)]).tolist()
        centres = np.concatenate([m.centres for m in live])
        count, _, sums = _cluster_sums(packed, edges, centres, models[0].slots)
        scans += 1
        count = count[:, None]
        moved = np.where(count > 0, sums / np.maximum(count, 1), centres)
        still = []
        for m, a, b in zip(live, edges, edges[1:]):
            if np.abs(moved[a:b] - m.centres).max() > STILL:
                still.append(m)
            m.centres = moved[a:b]
        live = still
    return scans


def costs(packed: DataFrame, models: list[Model]) -> None:
    """Fill in every model's inertia, in one scan: a cluster's follows from its size, sum and sum of squares."""
    edges = np.cumsum([0, *(m.k for m in models)]).tolist()
    centres = np.concatenate([m.centres for m in models])
    count, within, sums = _cluster_sums(packed, edges, centres, models[0].slots)
    cost = within - 2 * (sums * centres).sum(axis=1) + count * (centres**2).sum(axis=1)
    for m, a, b in zip(models, edges, edges[1:]):
        m.inertia = float(max(cost[a:b].sum(), 0))


def silhouettes(packed: DataFrame, models: list[Model]) -> list[float]:
    """Mean silhouette of squared distances of each model over all rows, in two scans.

    A row's mean squared distance to a cluster follows from the cluster's size, sum and sum
    of squares, so no pairs of rows are formed. A row alone in its cluster counts 0.
    """
    edges = np.cumsum([0, *(m.k for m in models)]).tolist()
    centres = np.concatenate([m.centres for m in models])
    squares, height = (centres**2).sum(axis=1), centres.shape[1] - models[0].slots + 2
    count, within, sums = _cluster_sums(packed, edges, centres, models[0].slots)
    filled = np.maximum(count, 1)
    means, spreads = sums / filled[:, None], within / filled
    tools = _tools()

    def part(total: np.ndarray, batch: pa.RecordBatch) -> None:
        for at, _, on in tools.alike(batch):
            form, of_means = tools.form_of(on, centres, squares, height), tools.form_of(on, means, spreads, height)
            for some in tools.slices(tools.stack(batch, at, height), np.arange(len(at))):
                near = tools.nearest(tools.apart(some, form), edges).T
                mean = tools.apart(some, of_means, "mean").T
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    mine = near[:, a:b] > 0
                    n = np.broadcast_to(count[a:b], mine.shape)[mine]
                    own = mean[:, a:b][mine] * n / np.maximum(n - 1, 1)
                    other = np.where(mine | (count[a:b] == 0), np.inf, mean[:, a:b]).min(axis=1)
                    greater = np.maximum(own, other)
                    total[k] += np.where((n > 1) & (greater > 0) & np.isfinite(other), (other - own) / np.where(greater > 0, greater, 1), 0.0).sum()

    n = count[: edges[1]].sum()
    return [float(s / n) if n else 0.0 for s in _sums(packed, len(models), part)]


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt evenly over all cores: a scan is computation, so a small table should not be one task.

    Rows that are near lie together, by ``on`` and ``x``; the key's hash parts equal rows.
    """
    spark = rows.sparkSession
    order = [c for c in ("on", "x") if c in rows.columns]
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartitionByRange(parts, *order, F.xxhash64("key")).sortWithinPartitions(*order)


def sweep(rows: DataFrame, ks: Sequence[int], n_init: int = 10, max_iter: int = 50) -> tuple[list[Model], list[float], int]:
    """Best restart of every k (least inertia to four places, then the first), their silhouettes, and the Lloyd scans.

    ``rows``: key (unique string), x (array<double>, one length, no nulls) and perhaps on (array<int>, one length). Without rows there are no models.
    """
    if rows.isEmpty():
        return [], [], 0
    rows = _points(rows)
    packed = materialize(pack(rows), "k-blocks")
    chosen = starts(rows, n_init, max(ks), packed)
    slots = chosen.shape[2] - len(rows.first()["x"])
    models = [Model(k, r, chosen[r, :k], slots=slots) for k in ks for r in range(n_init)]
    scans = lloyd(packed, models, max_iter)
    costs(packed, models)
    best = [min((m for m in models if m.k == k), key=lambda m: (round(m.inertia, 4), m.restart)) for k in ks]
    return best, silhouettes(packed, best), scans


def assign(rows: DataFrame, model: Model, column: str = "segment_id") -> DataFrame:
    """``rows`` with the number of each one's centre, by DataFrame functions; ``x`` and ``on`` are dropped."""
    slots = model.slots
    p = model.centres.shape[1] - slots
    ones = round(model.centres[0, p:].sum())  # of a row, and so of a mean of rows

    def apart(c: list[float]) -> Column:
        numbers = sum(((F.get("x", F.lit(i)) - v) * (F.get("x", F.lit(i)) - v) for i, v in enumerate(c[:p])), F.lit(0.0))
        if not slots:
            return F.round(numbers, PLACES)
        levels = F.array(*map(F.lit, c[p:])).cast("array<double>")
        shared = sum((F.get(levels, F.get("on", F.lit(i))) for i in range(ones)), F.lit(0.0))
        return F.round(numbers + (F.lit(sum(v * v for v in c[p:])) + ones - 2 * shared), PLACES)

    distance = F.array(*map(apart, model.centres.tolist()))
    return rows.withColumn(column, (F.array_position(distance, F.array_min(distance)) - 1).cast("int")).drop("x", "on")
