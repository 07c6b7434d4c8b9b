"""Operator 9: near-duplicates by an LSH forest over MinHash signatures.

1. Each document becomes a set of shingle hashes, a signature of ``VALUES`` minima, and a
   node (documents with equal sets are one node).
2. The forest: tree t orders the nodes by the signature read from its own start. Nodes that
   share the first ``DEPTH`` values of a tree are a region; a pair with similarity 0.85 shares no
   region of any of the ``TREES`` trees with probability 2e-8, one with 0.8 with 3e-6.
3. Links, first pass: in every tree's sorted order, where neighbours have the longest
   common prefixes, each node is compared by signature with the few before it, its best
   partner is confirmed on the full sets, and components are formed.
4. Links, second pass: only regions that still hold different components matter. A cell's nodes are
   first compared by signature alone; those alike to a node of another component come again with
   their full sets, so a pair is settled on the spot, and a link is given only if it joins two
   components of the cell: at most one a node, however many pairs are near the threshold. Pairs within a component need no look:
   they cannot change it. A region's largest component is dealt over several tasks.
   Regions with ``WIDE`` nodes or more are first dealt at random into cells of about that
   size, ``ROUNDS`` times, so that a large group of copies becomes one component by at most one link a node.
   Nodes of regions that then still have ``WIDE`` nodes or ``CELL_SHINGLES`` shingles or more outside the largest component are dealt by
   their rarest shingles instead, in cells of bounded size, and confirmed behind them; every pair that could reach the
   threshold meets in one of them, so a wide region loses no link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .ship import ship
from .text import Rolling, U64, chunks, joined, mix, word_bounds, word_hashes
from .token_files import shared_path

VALUES, TREES, DEPTH = 128, 24, 4
BEFORE = 3
CHUNK = 1 << 18
MEMBERS = 20_000
CELL_SHINGLES = 4_000_000
WIDE = 1_000
ROUNDS = 2
CELL = 4_000
PLACES = 1 << 21
SHINGLE = 5
_ODD = mix(np.arange(1, VALUES + 1, dtype=U64) * U64(0xA0761D6478BD642F)) | U64(1)
_ADD = mix(np.arange(1, VALUES + 1, dtype=U64) * U64(0xE7037ED1A0B428DB))


def near(percent: int) -> int:
    """Equal values by which a pair is worth confirming: 4.2 standard deviations below the mean at the threshold."""
    p = percent / 100
    return int(VALUES * (p - 4.2 * (p * (1 - p) / VALUES) ** 0.5))


def shingle_sets(texts: list[bytes | None], n: int = SHINGLE) -> list[np.ndarray]:
    """Sorted different hashes of the ``n``-word shingles of each text, A-Z lower-cased; a shorter text is one shingle."""
    data, start, end = joined(texts)
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    begin, stop = word_bounds(data)
    words = word_hashes(data, begin, stop)
    first, last = np.searchsorted(begin, start), np.searchsorted(begin, end)
    roll = Rolling(words)
    every = roll.slices(np.arange(max(0, len(words) - n + 1)), np.arange(max(0, len(words) - n + 1)) + n)
    out = []
    for i, j in zip(first.tolist(), last.tolist()):
        if j - i >= n:
            out.append(np.unique(every[i : j - n + 1]))
        elif j > i:
            out.append(roll.slices(np.array([i]), np.array([j])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """``VALUES`` 32-bit minima of each set, which must not be empty."""
    flat = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1])).astype(np.int64)
    out = np.empty((len(sets), VALUES), np.uint32)
    for i in range(VALUES):
        out[:, i] = np.minimum.reduceat(((flat * _ODD[i] + _ADD[i]) >> U64(32)).astype(np.uint32), starts)
    return out


def node_ids(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit id of each set, the same for equal sets."""
    return np.array([mix(np.array([mix(s).sum(dtype=np.uint64) + U64(len(s))], np.uint64))[0] for s in sets], np.uint64).view(np.int64)


def _batches(batches: Iterator[pa.RecordBatch], step) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch["text"].to_pylist()
        for i, j in chunks(np.array([len(t or b"") for t in texts], np.int64), CHUNK):
            yield step(batch.slice(i, j - i), shingle_sets(texts[i:j]))


def _sign(batch: pa.RecordBatch, sets: list[np.ndarray]) -> pa.RecordBatch:
    some = [i for i, s in enumerate(sets) if len(s)]
    nodes, short, regions = [None] * len(sets), [None] * len(sets), [None] * len(sets)
    if some:
        sig = signatures([sets[i] for i in some])
        tree = np.empty((len(some), TREES), np.uint64)
        for t in range(TREES):
            part = sig[:, DEPTH * t : DEPTH * (t + 1)].astype(np.uint64)
            key = np.full(len(some), t + 1, np.uint64)
            for k in range(DEPTH):
                key = mix(key * U64(0x9E3779B97F4A7C15) + part[:, k])
            tree[:, t] = key
        for i, node, row, key in zip(some, node_ids([sets[i] for i in some]).tolist(), (sig & 255).astype(np.uint8), tree.view(np.int64).tolist()):
            nodes[i], short[i], regions[i] = node, row.tobytes(), key
    return pa.RecordBatch.from_arrays([
        batch["doc_id"], batch["row_key"], pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()),
        pa.array(short, pa.binary()), pa.array(regions, pa.list_(pa.int64())),
    ], ["doc_id", "row_key", "n_shingles", "node", "sig", "regions"])


def _saved(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _neighbours(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Pairs of each row and the ``BEFORE`` rows before it in the sorted order, of one region and alike by signature."""
    tail: tuple | None = None
    for batch in batches:
        region, node = (batch[c].to_numpy() for c in ("region", "node"))
        sig = np.frombuffer(b"".join(batch["sig"].to_pylist()), np.uint8).reshape(-1, VALUES)
        if tail:
            region, node, sig = (np.concatenate(x) for x in zip(tail, (region, node, sig)))
        skip = len(tail[0]) if tail else 0
        found = [[], [], []]
        for back in range(1, BEFORE + 1):
            at = np.arange(max(back, skip), len(node))
            at = at[region[at] == region[at - back]]
            same = (sig[at] == sig[at - back]).sum(axis=1)
            alike = same >= least
            at, same = at[alike], same[alike]
            for x, y in zip(found, (node[at], node[at - back], same)):
                x.append(y)
        u, v, same = (np.concatenate(x) for x in found)
        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v)), pa.array(same.astype(np.int32))], ["u", "v", "same"])
        tail = tuple(x[-BEFORE:] for x in (region, node, sig))


def shared_counts(mine: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many elements each of ``others`` has in common with ``mine``; all sorted, without repeats."""
    out = np.empty(len(others), np.int64)
    for i in range(0, len(others), 256):
        some = others[i : i + 256]
        values = np.concatenate(some)
        hit = mine[np.minimum(np.searchsorted(mine, values), len(mine) - 1)] == values
        out[i : i + 256] = np.add.reduceat(hit.astype(np.int64), np.cumsum([0, *map(len, some)])[:-1])
    return out


def partners(m: int, see: np.ndarray, sig: np.ndarray, size: np.ndarray, seen: np.ndarray, region: int, least: int, percent: int) -> np.ndarray:
    """Of the nodes ``see`` of a cell those that could reach the threshold with node ``m`` by size and signature.

    ``seen``: the regions of each node that are not dealt by shingles (zeros behind): of the regions
    that a pair shares, only the first compares it.
    """
    see = see[100 * np.minimum(size[see], size[m]) >= percent * np.maximum(size[see], size[m])]
    see = see[(sig[see] == sig[m]).sum(axis=1) >= least]
    if len(see):
        mine = seen[m][seen[m] != 0]
        earlier = mine[mine < region] if region in mine else mine
        see = see[~np.isin(seen[see], earlier).any(axis=1)]
    return see


def alike(root: np.ndarray, sig: np.ndarray, size: np.ndarray, seen: np.ndarray, region: int, major: int, whole: bool, least: int, percent: int) -> np.ndarray:
    """Which nodes of a cell have ``partners`` of another component; the others can give no link there."""
    keep = np.zeros(len(root), bool)
    others = np.arange(len(root)) if whole else np.flatnonzero(root == major)
    for m in np.flatnonzero(root != major).tolist():
        see = others[(root[others] != root[m]) & ((root[others] == major) | (others > m))]
        see = partners(m, see, sig, size, seen, region, least, percent)
        keep[see] = True
        keep[m] |= len(see) > 0
    return keep


def across(node: np.ndarray, root: np.ndarray, sig: np.ndarray, sets: list[np.ndarray], seen: np.ndarray, region: int, major: int, whole: bool, least: int, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between different components of a cell that join them, and no others.

    A node is compared with the nodes of other components, its ``partners`` in full (``sets``); a link
    joins the two components, so none is given between them again.
    """
    label = np.unique(root, return_inverse=True)[1]
    size = np.array(list(map(len, sets)), np.int64)
    others = np.arange(len(node)) if whole else np.flatnonzero(root == major)
    for m in np.flatnonzero(root != major).tolist():
        see = others[(label[others] != label[m]) & ((root[others] == major) | (others > m))]
        see = partners(m, see, sig, size, seen, region, least, percent)
        if len(see):
            both = shared_counts(sets[m], [sets[i] for i in see])
            see = see[100 * both >= percent * (size[see] + size[m] - both)]
        if len(see):
            see = see[np.unique(label[see], return_index=True)[1]]
            label[np.isin(label, label[see])] = label[m]
            yield np.full(len(see), node[m]), node[see]


def within(node: np.ndarray, root: np.ndarray, sig: np.ndarray, earlier: list[np.ndarray], size: np.ndarray, shared: np.ndarray, side: np.ndarray, low: int, high: int, least: int, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a cell, whose nodes have one rare shingle in common; otherwise as ``across``.

    Nodes of side ``low`` meet those of side ``high``. ``earlier``: each node's smaller rare
    shingles; a pair that has one of them in common is given there.
    """
    right = np.flatnonzero(side == high)
    for m in np.flatnonzero(side == low).tolist():
        see = right[right > m] if low == high else right
        see = see[root[see] != root[m]]
        see = see[(100 + percent) * np.minimum(shared[see], shared[m]) >= percent * (size[see] + size[m])]
        see = see[(sig[see] == sig[m]).sum(axis=1) >= least]
        if len(see) and len(earlier[m]):
            sizes = [len(earlier[i]) for i in see]
            hit = np.isin(np.concatenate([earlier[i] for i in see]), earlier[m])
            see = np.delete(see, np.unique(np.repeat(np.arange(len(see)), sizes)[hit]))
        if len(see):
            yield np.full(len(see), node[m]), node[see]


def rare_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """(node, rare, size, shared, common): of each set its n - ceil(percent * n / 100) + 1 rarest shingles, in one
    order for all, its size n, how many of its shingles occur in a second set, and those of the
    rarest that do.

    Two sets that reach the threshold have ceil(percent * n / 100) elements in common of either, so
    each has one of them among its first in any common order; the rarest first leaves
    the fewest pairs. Shingles are cut to 32 bits, which can only add pairs.
    """
    each = sets.select("node", F.explode("shingles").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count("node").alias("often"))
    n = F.size("all")
    first = n - F.ceil(n * percent / 100).cast("int") + 1
    rarest = F.slice("all", F.lit(1), first)
    short = lambda x: x["shingle"].bitwiseAND(0xFFFFFFFF)
    cut = F.transform(rarest, short)
    common = F.array_sort(F.array_distinct(F.transform(F.filter(rarest, lambda x: x["often"] > 1), short)))
    return each.join(often, "shingle").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("often", "shingle"))).alias("all")).select(
        "node", cut.alias("rare"), n.cast("long").alias("size"), F.size(F.filter("all", lambda x: x["often"] > 1)).cast("long").alias("shared"), common.alias("common"))


def _groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Rows with equal ``keys``, of rows sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch[k].to_numpy() for k in keys]
        turn = np.any([np.diff(c) != 0 for c in cols], axis=0)
        cuts = [0, *(np.flatnonzero(turn) + 1).tolist(), batch.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            if held and tuple(held[-1][k][0].as_py() for k in keys) != tuple(c[i] for c in cols):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def _pair_rows(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for u, v in pairs:
        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"])


def _matrix(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint8).reshape(-1, VALUES)


def _seen(t: pa.Table) -> np.ndarray:
    return np.array([(x or []) + [0] * (TREES - len(x or [])) for x in t["seen"].to_pylist()], np.int64)


def _alike(batches: Iterator[pa.RecordBatch], least: int, percent: int, whole_parts: bool) -> Iterator[pa.RecordBatch]:
    """The rows that ``alike`` keeps of every (region, part) of rows sorted by them; parts as in ``_across``."""
    for t in _groups(batches, "region", "part"):
        whole = whole_parts or t["part"][0].as_py() == 0
        keep = alike(t["root"].to_numpy(), _matrix(t), t["size"].to_numpy(), _seen(t), t["region"][0].as_py(), t["major"][0].as_py(), whole, least, percent)
        if keep.any():
            yield from t.filter(pa.array(keep)).to_batches()


def _across(batches: Iterator[pa.RecordBatch], least: int, percent: int, whole_parts: bool) -> Iterator[pa.RecordBatch]:
    """``across`` for every (region, part) of rows sorted by them; the first part, or every one, is compared as a whole."""
    for t in _groups(batches, "region", "part"):
        whole = whole_parts or t["part"][0].as_py() == 0
        column = t["shingles"].combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        flat, edge = column.flatten().to_numpy(), np.cumsum([0, *t["size"].to_pylist()])
        sets = [np.sort(flat[i:j]) for i, j in zip(edge, edge[1:])]
        yield from _pair_rows(across(t["node"].to_numpy(), t["root"].to_numpy(), _matrix(t), sets, _seen(t), t["region"][0].as_py(), t["major"][0].as_py(), whole, least, percent))


def _within(batches: Iterator[pa.RecordBatch], least: int, percent: int) -> Iterator[pa.RecordBatch]:
    """``within`` for every (shingle, low, high) of rows sorted by them."""
    for t in _groups(batches, "shingle", "low", "high"):
        earlier = [np.asarray(x, np.int64) for x in t["earlier"].to_pylist()]
        yield from _pair_rows(within(t["node"].to_numpy(), t["root"].to_numpy(), _matrix(t), earlier, t["size"].to_numpy(), t["shared"].to_numpy(), t["side"].to_numpy(), t["low"][0].as_py(), t["high"][0].as_py(), least, percent))


def majors(rows: DataFrame, key: str) -> DataFrame:
    """(``key``, major, n, held, minor, minor_held) of keys with several components: the largest, all nodes and
    their shingles (column ``size``), and those outside the largest."""
    one = rows.groupBy(key, "root").agg(F.count("node").alias("n"), F.sum("size").alias("held"))
    sizes = one.groupBy(key).agg(F.max_by(F.struct("root", "n", "held"), F.struct("n", "root")).alias("top"),
                                 F.sum("n").alias("n"), F.sum("held").alias("held"), F.count("root").alias("kinds"))
    return sizes.where("kinds > 1").select(key, F.col("top.root").alias("major"), "n", "held",
                                           (F.col("n") - F.col("top.n")).alias("minor"), (F.col("held") - F.col("top.held")).alias("minor_held"))


def wide_pairs(nodes: DataFrame, least: int, percent: int) -> DataFrame:
    """(u, v) of different components that share a rare shingle and could reach the threshold.

    ``nodes``: node, root, sig, size, shared, common (see ``rare_shingles``). A shingle's nodes outside its
    largest component are dealt into sides of about ``CELL``, those of the largest into
    further sides; each two sides that can hold a pair meet in one cell.
    """
    at = nodes.select("node", "root", "size", F.explode("common").alias("shingle"))
    deal = majors(at, "shingle").select(
        "shingle", "major", F.ceil(F.col("minor") / CELL).cast("int").alias("minors"), F.ceil((F.col("n") - F.col("minor")) / CELL).cast("int").alias("mains"))
    rows = at.drop("size").join(deal, "shingle")
    mine = F.col("root") == F.col("major")
    spot = F.xxhash64("node")
    side = F.when(mine, F.col("minors") + F.pmod(spot, F.col("mains"))).otherwise(F.pmod(spot, F.col("minors"))).cast("int")
    last = F.col("minors") + F.when(mine, 0).otherwise(F.col("mains")) - 1
    rows = rows.withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    rows = rows.select("shingle", "node", "side", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"))
    rows = rows.join(nodes, "node").withColumn("earlier", F.filter("common", lambda x: x < F.col("shingle")))
    rows = rows.repartition("shingle", "low", "high").sortWithinPartitions("shingle", "low", "high", "node")
    rows = rows.select("shingle", "low", "high", "side", "node", "root", "sig", "size", "shared", "earlier")
    return rows.mapInArrow(lambda x: _within(x, least, percent), "u long, v long")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (u, v) whose full sets have 100 * intersection >= percent * union."""
    x = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    y = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    either = F.size("a") + F.size("b") - F.col("both")
    return pairs.join(x, "u").join(y, "v").select("u", "v", "a", "b", both.alias("both")).where(100 * F.col("both") >= percent * either).select("u", "v")


def _contracted(first: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after ``links`` between nodes have joined the components of ``first``."""
    roots = first.withColumnRenamed("root", "r")
    for end in ("u", "v"):
        links = links.join(roots.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("r", end)).drop("r")
    second = _saved(components(links.select("u", "v")), "components")
    ends = first.join(second.select(F.col("node").alias("root"), F.col("root").alias("root2")), "root", "full").select(
        F.coalesce("node", "root").alias("node"), F.coalesce("root2", "root").alias("root"))
    return _saved(ends.unionAll(second.select("node", "root")).distinct(), "components")


def _dealt(member: DataFrame, first: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of regions with several components, with their root, and each region's deal."""
    rooted = member.join(first, "node", "left").withColumn("root", F.coalesce("root", "node"))
    deal = majors(rooted, "region")
    wide = (F.col("minor") >= WIDE) | (F.col("minor_held") >= CELL_SHINGLES)
    parts = F.ceil(F.greatest(F.col("n") / MEMBERS, F.col("held") / CELL_SHINGLES)).cast("int")
    cells = F.ceil(F.greatest(F.col("n") / WIDE, F.col("held") / CELL_SHINGLES)).cast("int")
    return rooted, deal.select("region", "major", wide.alias("wide"), parts.alias("parts"), cells.alias("cells"))


def _full_sets(rows: DataFrame, distinct: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles) of ``nodes`` (node, repeats do no harm), from one of each node's texts.

    Texts whose key's remainder no wanted key has stay where they are: the remainders, ``PLACES`` at
    most, go to every task, and the join by the full key has few texts to move.
    """
    wanted = _saved(nodes.distinct().join(distinct.select("node", "row_key"), "node"), "wanted")
    place = F.pmod("row_key", F.lit(PLACES))
    places = wanted.select(place.alias("place")).distinct()
    some = rows.withColumn("place", place).join(F.broadcast(places), "place", "left_semi").drop("place")
    return _saved(some.join(wanted, "row_key").dropDuplicates(["row_key"]).select("node", "text").mapInArrow(
        lambda x: _batches(x, _set_rows), "node long, shingles array<long>"), "sets")


def _cell_links(cells: DataFrame, full_sets, least: int, percent: int, whole_parts: bool = False) -> DataFrame:
    """(u, v) of the links that join components of a cell (region, part): by signature first, then on full sets."""
    columns = ["region", "part", "node", "root", "major", "sig", "size", "seen"]

    def sorted_cells(df: DataFrame, *more: str) -> DataFrame:
        return df.repartition("region", "part").sortWithinPartitions("region", "part", "node").select(*columns, *more)

    some = _saved(sorted_cells(cells).mapInArrow(
        lambda x: _alike(x, least, percent, whole_parts),
        "region long, part int, node long, root long, major long, sig binary, size long, seen array<long>"), "alike")
    rows = sorted_cells(some.join(full_sets(some.select("node")), "node"), "shingles")
    return rows.mapInArrow(lambda x: _across(x, least, percent, whole_parts), "u long, v long")


def _wide_round(member: DataFrame, first: DataFrame, full_sets, number: int, least: int, percent: int) -> DataFrame | None:
    """``first`` after the nodes of wide regions have met in random cells; None if no region is wide."""
    rooted, deal = _dealt(member, first)
    deal = _saved(deal.where("wide"), "wide-regions")
    if deal.isEmpty():
        return None
    cell = F.pmod(F.xxhash64("node", F.lit(number)), F.col("cells")).cast("int")
    rows = rooted.join(deal, "region").withColumn("part", cell).withColumn("seen", F.array().cast("array<long>"))
    return _contracted(first, _saved(_cell_links(rows, full_sets, least, percent, True).distinct(), "links"))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; further columns are ignored): n_shingles, component_id, kept, row_key, component.

    Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a document's set is its different 5-word
    shingles, or its words as one if they are fewer. Documents are linked if 100 *
    intersection >= ``percent`` * union (80 or more, for which the forest is laid out);
    component_id is the smallest doc_id that links reach. A document without words, or null,
    is linked with nothing. Rows that share a doc_id are linked by their texts alone, and
    a null doc_id is no candidate for the smallest unless there is no other. kept: doc_id =
    component_id (both null counts). Repeated rows stay rows. row_key is a hash of doc_id and text;
    component is a key of the linked texts that does not depend on ids, null for a document
    without words. An empty table gives no rows.
    """
    if percent < 80:
        raise ValueError("the forest is laid out for 80 percent or more")
    least = near(percent)
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("doc_id", "text").alias("row_key"))
    signed = _saved(rows.mapInArrow(
        lambda x: _batches(x, _sign), "doc_id long, row_key long, n_shingles long, node long, sig binary, regions array<long>"), "signed")
    nodes = signed.where("node IS NOT NULL")

    # regions with more than one node, and the rows of their nodes
    distinct = nodes.groupBy("node").agg(F.min("row_key").alias("row_key"), F.min("doc_id").alias("doc_id"))
    distinct = _saved(distinct, "nodes")
    keys = nodes.select("node", "regions").dropDuplicates(["node"]).select("node", F.posexplode("regions").alias("tree", "region"))
    shared = keys.groupBy("region").agg(F.count("node").alias("n")).where("n > 1").select("region")
    start = ((F.col("tree") + 1) * DEPTH).cast("int")
    own = nodes.select("node", "sig", F.col("n_shingles").alias("size")).dropDuplicates(["node"])
    member = keys.join(shared, "region").select("region", "node", start.alias("start"))
    member = _saved(member.join(own, "node").select("region", "node", "sig", "size", "start"), "members")

    def full_sets(wanted: DataFrame) -> DataFrame:
        return _full_sets(rows, distinct, wanted)

    # first pass: best neighbour in the sorted orders
    turned = F.concat(F.expr("substring(sig, start + 1)"), F.expr("substring(sig, 1, start)"))
    order = member.withColumn("turned", turned).repartition("region").sortWithinPartitions("region", "turned", "node").select("region", "node", "sig")
    best = order.mapInArrow(lambda x: _neighbours(x, least), "u long, v long, same int").groupBy("u").agg(F.max_by("v", F.struct("same", "v")).alias("v"))
    best = _saved(best, "best")
    ends = best.select(F.explode(F.array("u", "v")).alias("node"))
    links = _saved(confirmed(best, full_sets(ends), percent), "links")
    first = _saved(components(links), "components")

    # second pass: pairs of different components within a region
    for number in range(ROUNDS):
        found = _wide_round(member, first, full_sets, number, least, percent)
        if found is None:
            break
        first = found
    rooted, deal = _dealt(member, first)
    deal = deal.drop("cells")
    mixed = _saved(rooted.join(deal, "region"), "mixed")
    wide = _saved(mixed.where("wide").select("node", "root", "sig").dropDuplicates(["node"]), "wide")
    wide_sets = full_sets(wide.select("node"))
    wide = _saved(wide.join(rare_shingles(wide_sets, percent).drop("rare"), "node"), "wide")
    mixed = mixed.where("NOT wide")
    seen = mixed.groupBy("node").agg(F.collect_list("region").alias("seen"))  # TREES at most
    mixed = mixed.join(seen, "node")
    own: Column = F.array(F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    mixed = mixed.withColumn("part", F.explode(F.when(F.col("root") == F.col("major"), own).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
    pairs = _cell_links(mixed, full_sets, least, percent)
    by_rare = confirmed(wide_pairs(wide, least, percent).distinct(), wide_sets, percent)
    more = _saved(pairs.unionAll(by_rare).distinct(), "links")
    ends = _contracted(first, more)
    named = distinct.join(ends, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = named.join(lowest, "root").select("node", "component_id", F.col("root").alias("component"))
    out = signed.select("doc_id", "n_shingles", "node", "row_key").join(named, "node", "left")
    least_id = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.withColumn("component_id", least_id).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", "kept", "row_key", "component")


def _set_rows(batch: pa.RecordBatch, sets: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch["node"], pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "shingles"])
