"""Operator 6: nearest neighbours by inner product with shifted space-filling curves.

Vectors get one more coordinate, sqrt(longest^2 - length^2), zero for queries, which
turns the largest inner product into the smallest angle. Each of ``CURVES`` Hilbert curves
orders all vectors by its own shifted projection; Spark sorts the keys by range, and a
vector's rank follows from its place in its partition. A query's candidates are the vectors
within ``window`` ranks of it on any curve; their inner products are exact, and the best of
all curves are merged. Equal vectors are indexed once and unfolded at the end.

The index holds curves, ranks and ids; vectors join it once, in the table's own element type,
when their blocks are known. Lengths are scaled before they are squared, so any finite
vector finds its place.

The window is calibrated on a documented bound of ``PROBES`` queries: their true neighbours
are found against all rows, and the window is the rank distance that takes in the
share ``recall`` of them. Vectors are read in blocks of ``BLOCK`` ranks, and a block's queries are dealt
into parts of about ``QUERIES`` and scored ``SLICE`` at a time, so its size costs time, not memory.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from . import hilbert
from .ship import ship
from .token_files import shared_path

CURVES = 16
PROBES = 128
BLOCK = 4096
QUERIES = 2048
SLICE = 256


def _saved(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of the rows with q; where sums of infinities meet, those of the scaled vectors, scaled back."""
    out = (x * q).sum(axis=1)
    if (lost := np.isnan(out)).any():
        high, top = np.abs(x[lost]).max(axis=1), np.abs(q).max()
        out[lost] = (x[lost] / high[:, None] * (q / top)).sum(axis=1) * high * top
    return out


def _best(queries: pa.Table, rows: pa.Table, k: int, reach: int | None) -> pa.Table:
    """The k best rows for each query, within ``reach`` ranks: (qid, found: [(class, score)])."""
    q, x = _matrix(queries["vector"]), _matrix(rows["vector"])
    ids, out = rows["cid"].to_numpy(), []
    qid = queries["cid"].to_numpy()
    if len(ids):
        place = None if reach is None else rows["rank"].to_numpy()
        asked = None if reach is None else queries["rank"].to_numpy()
        most, everyone = np.abs(x).max(), np.arange(len(ids))
        with np.errstate(over="ignore", under="ignore", invalid="ignore"):
            for first in range(0, len(q), SLICE):
                part = q[first : first + SLICE]
                score = part @ x.T
                for i in range(len(part)):
                    at = everyone if reach is None else np.flatnonzero(np.abs(place - asked[first + i]) <= reach)
                    rough = score[i][at]
                    if len(at) > k and np.isfinite(rough).all():
                        slack = 1e-12 * np.abs(part[i]).sum() * most  # more than a product's rounding
                        at = at[rough >= np.partition(rough, len(at) - k)[len(at) - k] - slack]
                    exact = _products(x[at], part[i])
                    at = at[order := np.lexsort((ids[at], -exact))[:k]]
                    out.append([{"cid": int(c), "score": float(s)} for c, s in zip(ids[at], exact[order])])
    else:
        out = [[] for _ in qid]
    return pa.table([pa.array(qid), pa.array(out, pa.list_(pa.struct([("cid", pa.int64()), ("score", pa.float64())])))], ["qid", "found"])


FOUND = "qid long, found array<struct<cid: long, score: double>>"


def merged(found: DataFrame, k: int) -> DataFrame:
    """One list of the k best classes for each query, from lists of at most k each."""
    flat = F.array_distinct(F.flatten(F.collect_list(F.transform("found", lambda x: F.struct((-x["score"]).alias("less"), x["cid"].alias("cid"))))))
    return found.groupBy("qid").agg(F.slice(F.array_sort(flat), 1, k).alias("best"))


def prepare(table: DataFrame) -> tuple[DataFrame, int, float, float]:
    """(vec_id, vector) of the rows that take part, their width, greatest component, and greatest length as a multiple of that."""
    kind = "float" if isinstance(table.schema["embedding"].dataType.elementType, FloatType) else "double"
    rows = table.select("vec_id", F.col("embedding").cast(f"array<{kind}>").alias("vector")).where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~bad).withColumn("top", F.array_max(F.transform("vector", F.abs)).cast("double")).where("top > 0")
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + F.pow(x.cast("double") / F.col("top"), F.lit(2.0)))
    length = F.max(F.log("top") + F.log(squares) / 2)  # as a logarithm: a length may be beyond a double
    widths = rows.groupBy(F.size("vector").alias("width")).agg(F.count("vec_id").alias("n"), F.max("top").alias("high"), length.alias("length"))
    most = widths.orderBy(F.desc("n"), F.desc("width")).first()
    if most is None:
        return rows.select("vec_id", "vector"), 0, 0.0, 0.0
    return rows.where(F.size("vector") == most.width).select("vec_id", "vector"), most.width, most.high, math.exp(most.length - math.log(most.high))


def deal(index: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Queries and rows of ``index`` by (curve, block, part): each query meets every block within ``window`` ranks of it in one part.

    A block with many queries has as many parts as ``QUERIES`` asks for, and its rows go to all of them.
    """
    lo, hi = (F.floor((F.col("rank") + x) / BLOCK).cast("long") for x in (-window, window))
    wanted = index.where("query").select("curve", "cid", "rank", F.explode(F.sequence(lo, hi)).alias("block"))
    parts = F.ceil(F.count("cid") / QUERIES).cast("int").alias("parts")
    many = _saved(wanted.groupBy("curve", "block").agg(parts), "query-parts")
    part = F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int").alias("part")
    wanted = wanted.join(many, ["curve", "block"]).select("curve", "block", "cid", "rank", part)
    block = F.floor(F.col("rank") / BLOCK).cast("long").alias("block")
    dealt = index.where(~F.col("query")).select("curve", "cid", "rank", block).join(many, ["curve", "block"])
    return wanted, dealt.select("curve", "block", "cid", "rank", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))


def carry(dealt: DataFrame, vectors: DataFrame) -> DataFrame:
    """``dealt`` with its vectors: a vector meets all its places at once, so it crosses the join once and not once a curve."""
    places = dealt.groupBy("cid").agg(F.collect_list(F.struct("curve", "block", "part", "rank")).alias("places"))
    fresh = [F.col(c).alias(c) for c in ("cid", "vector")]  # new column ids for the cogroup
    return places.join(vectors, "cid").select(*fresh, F.explode("places").alias("p")).select("cid", "vector", "p.*")


def nearest(table: DataFrame, every: int = 20, k: int = 20, recall: float = 0.94, curves: int = CURVES) -> DataFrame:
    """For each vec_id divisible by ``every``: the ``k`` nearest found, (query_id, rank, vec_id, score).

    ``table``: vec_id, embedding; further columns are ignored. Rows with a null vec_id, a null or
    zero vector, or one with null or non-finite components take no part, nor do vectors whose
    width is not the table's most frequent one. Ties go to the smaller vec_id. Every row is a query or
    candidate of its own, repeated rows too: a query leaves out just its own row, each row of a
    repeated query gives its list, and a list names a vec_id as often as rows have it.
    Products that overflow are infinite, those that underflow zero, and count as such.
    Queries get all candidates if there are fewer than ``k``; an empty table gives no rows.
    """
    spark = table.sparkSession
    ship(spark)
    rows, width, top, longest = prepare(table)
    if not width:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # equal vectors are one class, named by its least vec_id; its k + 1 least members are enough
    counted = rows.groupBy("vec_id", "vector").agg(F.count("vec_id").alias("copies"))
    place = F.row_number().over(W.partitionBy("vector").orderBy("vec_id"))
    few = counted.withColumn("place", place).where(F.col("place") <= k + 1)
    sorted_ids = F.sort_array(F.collect_list(F.struct("vec_id", F.least("copies", F.lit(k + 1)).cast("int").alias("copies"))))
    members = F.slice(F.flatten(F.transform(sorted_ids, lambda m: F.array_repeat(m["vec_id"], m["copies"]))), 1, k + 1)
    classes = few.groupBy("vector").agg(F.min("vec_id").alias("name"), members.alias("members"))
    # a vec_id may name several vectors, so classes get numbers, rising with their least vec_id (ties go by them)
    classes = _saved(classes.orderBy("name", "vector").withColumn("cid", F.monotonically_increasing_id()), "classes")
    asked = counted.where(F.col("vec_id") % every == 0).join(classes.select("vector", "cid"), "vector")
    asked = _saved(asked.select("cid", F.col("vec_id").alias("query_id"), "copies"), "asked")
    queries = classes.join(asked.select("cid").distinct(), "cid", "left_semi").select("cid", "vector")

    def place_rows(query: bool):
        def run(batches):
            for batch in batches:
                x = _matrix(batch["vector"])
                if query:  # only a query's direction matters
                    x = x / np.abs(x).max(axis=1, keepdims=True)
                    x = np.column_stack((x / np.sqrt((x * x).sum(axis=1, keepdims=True)), np.zeros(len(x))))
                else:
                    x = x / top / longest
                    x = np.column_stack((x, np.sqrt(np.maximum(0.0, 1 - (x * x).sum(axis=1)))))
                for c in range(curves):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(x), c, np.int32)), pa.array(hilbert.curve_keys(x, c)), batch["cid"],
                        pa.array(np.full(len(x), query))], ["curve", "key", "cid", "query"])
        return run

    schema = "curve int, key long, cid long, query boolean"
    keyed = classes.select("cid", "vector").mapInArrow(place_rows(False), schema).unionAll(queries.mapInArrow(place_rows(True), schema))
    parts = max(curves, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = keyed.repartitionByRange(parts, "curve", "key", "cid").sortWithinPartitions("curve", "key", "cid", "query")

    def number(batches):
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seen, seen + n))], [*batch.schema.names, "part", "at"])
            seen += n

    index = _saved(keyed.mapInArrow(number, f"{schema}, part int, at long"), "curve-index")
    # ranks count on over partitions; only their differences within a curve matter
    bases = index.groupBy("part").agg(F.count("cid").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    index = index.join(F.broadcast(bases), "part").select("curve", "cid", "query", (F.col("base") + F.col("at")).alias("rank"))
    data = index.where(~F.col("query"))

    # calibration: true neighbours of PROBES queries, and how far they are on the nearest curve
    probes = _saved(queries.orderBy(F.xxhash64("cid"), "cid").limit(PROBES), "probes")
    probe_rows = probes.toArrow()

    def truth(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            yield from _best(probe_rows, t, k + 1, None).to_batches()

    true = merged(classes.select("cid", "vector").mapInArrow(truth, FOUND), k + 1)
    true = true.select("qid", F.explode("best.cid").alias("cid")).where("qid <> cid")
    ends = true.join(data.select("cid", "curve", "rank"), "cid").join(
        index.where("query").select(F.col("cid").alias("qid"), "curve", F.col("rank").alias("qrank")), ["qid", "curve"])
    gaps = ends.groupBy("qid", "cid").agg(F.min(F.abs(F.col("rank") - F.col("qrank"))).alias("gap"))
    window = gaps.agg(F.percentile("gap", recall)).first()[0]
    window = max(4 * k, math.ceil(window or 0))

    vectors = classes.select("cid", "vector")
    wanted, dealt = (carry(x, vectors) for x in deal(index, window))

    def search(q: pa.Table, x: pa.Table) -> pa.Table:
        return _best(q, x, k + 1, window)

    found = wanted.groupBy("curve", "block", "part").cogroup(dealt.groupBy("curve", "block", "part")).applyInArrow(search, FOUND)
    best = merged(found, k + 1).select("qid", F.explode("best").alias("b")).select("qid", F.col("b.cid").alias("cid"), (-F.col("b.less")).alias("score"))
    own = queries.select(F.col("cid").alias("qid"), "cid", F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x).alias("score"))
    best = best.where("qid <> cid").unionAll(own)
    full = best.join(classes.select("cid", "members", F.posexplode("members").alias("at", "vec_id")), "cid")
    full = full.join(asked.withColumnRenamed("cid", "qid"), "qid")
    own_row = (F.col("cid") == F.col("qid")) & (F.col("at") + 1 == F.array_position("members", F.col("query_id")))
    order = W.partitionBy("query_id", "qid").orderBy(F.desc("score"), "vec_id", "cid", "at")
    full = full.where(~own_row).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return full.select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")
