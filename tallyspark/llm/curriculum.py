"""Operator 8: mix sources to target weights along a time-varying curriculum (DataFrame functions only).

Targets. Each source has a weight; weights share the words of all sources, a target
stops at ``most`` times its source's size, and the excess goes to the others by weight.
With sources in the order of most * size / weight, the level at which the first j are
stopped is (all - their caps) / (the weights left); the largest of these is the true one.

Positions. A source's weight at training time t in [0, 1] runs in a line from ``ramp[0]`` to
``ramp[1]`` (mean 1) times its share. Its integral is the cumulative demand for the
source's words, and its inverse at the words that stand before a document, over the
target, is the document's time. Whole passes over a source come first, then a part of one:
the documents whose middle lies before the rest of the target. Documents of a source
are ordered by the MD5 of their id and text; running sums go by 4,096 slices of that order, so
that no task needs all rows of a source. Equal rows are one entry with a multiplicity, which the
target cuts where it falls: a source of one row repeated ends as near its target as any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .token_files import shared_path

WEIGHTS = (5, 2, 1)
RAMPS = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
WORDS = r"[^\x20\x09-\x0D]+"
SLICE_DIGITS = 3
RUN = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def pick(values: tuple, index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, ramps: tuple = RAMPS, most: int = 3) -> DataFrame:
    """One row a source of (source, size): its order, size, target and ramp. Windows run over sources only."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = by.withColumn("sid", F.row_number().over(order) - 1)
    by = by.withColumn("weight", pick(weights, F.col("sid"))).withColumn("ramp", pick(tuple(float(r[0]) for r in ramps), F.col("sid")))
    all_ = W.orderBy((F.lit(float(most)) * F.col("source_size") / F.col("weight")), "sid")
    before, rest = all_.rowsBetween(W.unboundedPreceding, -1), all_.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.partitionBy(F.lit(0))
    total = F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0))) / F.sum("weight").over(rest)
    by = by.withColumn("level", level.cast("double"))
    return by.withColumn("target", F.least((most * F.col("source_size")).cast("double"), F.max("level").over(everything) * F.col("weight"))).withColumn("words", total).drop("level", "weight")


def _entries(docs: DataFrame, identity: list[Column], weights: tuple, ramps: tuple, most: int) -> DataFrame:
    """One row for all rows of a source that are equal by ``identity``.

    row_key, source, doc_id, size, n (rows), start (words of the source before them), passes, more (how many
    of the n rows are taken once more), source_size, target, ramp, words. Sizes are written once to the
    shared folder, as later steps read them three times.
    """
    spark = docs.sparkSession
    path = shared_path(spark, "mix-sizes")
    said = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))
    rows = docs.select(F.col("doc_id"), "source", word_count(F.col("text")).alias("size"), F.md5(said.cast("binary")).alias("key"), F.xxhash64(*identity).alias("row_key"))
    same = rows.groupBy("source", "key", "row_key").agg(F.min("doc_id").alias("doc_id"), F.min("size").alias("size"), F.count(F.lit(1)).alias("n"))
    same.write.parquet(path)
    sizes = spark.read.parquet(path).withColumn("slice", F.substring("key", 1, SLICE_DIGITS)).withColumn("held", F.col("size") * F.col("n"))
    sources = targets(sizes.select("source", F.col("held").alias("size")), weights, ramps, most)
    slices = sizes.groupBy("source", "slice").agg(F.sum("held").alias("words"))
    ahead = W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    slices = slices.select("source", "slice", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("base"))
    per_slice = slices.alias("a").join(sources.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select(
        F.col("a.source").alias("s"), F.col("a.slice").alias("l"), "base", "source_size", "target", "ramp", "words")
    within = W.partitionBy("source", "slice").orderBy("key", "row_key").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = sizes.withColumn("inner", F.sum("held").over(within))
    rows = rows.join(per_slice, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("l")))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    rows = rows.withColumn("passes", passes).withColumn("start", F.col("base") + F.col("inner") - F.col("held"))
    left = F.col("target") - F.col("passes") * F.col("source_size") - F.col("start")
    # rows i with i * size + size / 2 < left
    more = F.when(F.col("size") == 0, F.when(left > 0, F.col("n")).otherwise(0)).otherwise(
        F.least(F.greatest(F.ceil(left / F.col("size") - 0.5), F.lit(0)), F.col("n")))
    return rows.select("row_key", "source", "doc_id", "size", "n", "start", "passes", more.cast("long").alias("more"), "source_size", "target", "ramp", "words")


def _position(copy: Column, row: Column) -> Column:
    """Place in the mix of the ``row``-th of equal rows, in pass ``copy``."""
    middle = F.col("start") + row * F.col("size") + F.col("size") / 2
    x = F.least((copy * F.col("source_size") + middle) / F.col("target"), F.lit(1.0))
    # ramp r falls or rises in a line to 2 - r: demand r t + (1 - r) t^2 = x
    r = F.col("ramp")
    return 2 * x / (r + F.sqrt(r * r + 4 * (1 - r) * x)) * F.col("words")


def _each(entries: DataFrame, count: Column, name: str) -> DataFrame:
    """``entries`` once for each number below ``count``, in runs that are dealt out, so many equal rows are many tasks."""
    runs = entries.withColumn("count_", count).withColumn("run_", F.explode(F.sequence(F.lit(0), F.floor((F.col("count_") - 1) / RUN).cast("long"))))
    runs = runs.repartition("row_key", "run_")
    first = F.col("run_") * RUN
    return runs.withColumn(name, F.explode(F.sequence(first, F.least(first + RUN, F.col("count_")) - 1))).drop("count_", "run_")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, ramps: tuple = RAMPS, most: int = 3) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source; further columns are ignored), sorted by training position.

    size (words; null text: 0), source_size, target, taken (words the mix takes, repeats
    counted), copies, position (of the first copy, in words of the mix; null if none is
    taken) and positions of all copies. A null source is a source, the last one; a source
    without words has target 0 and is not taken; a null doc_id is ordered like an empty
    one. Rows with equal doc_id, text and source follow each other, and as many of them are taken as the target needs. An empty table gives no rows. The same rows give the same result
    however they are partitioned. The sizes are written when this is called.
    """
    rows = _each(_entries(docs, [F.col("doc_id"), F.col("text")], weights, ramps, most), F.col("n"), "row")
    rows = rows.withColumn("copies", F.col("passes") + F.when(F.col("row") < F.col("more"), 1).otherwise(0))
    positions = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda c: _position(c, F.col("row"))))
    rows = rows.withColumn("positions", positions).withColumn("position", F.get("positions", F.lit(0)))
    return rows.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "position", "positions", "source", "row_key",
    ).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def apply_mix(docs: DataFrame, weights: tuple = WEIGHTS, ramps: tuple = RAMPS, most: int = 3) -> DataFrame:
    """Rows of ``docs``, all columns, each as often as the mix takes it, sorted by training position. See ``mix``.

    Rows that are equal in every column are one entry. Columns may have any name and type.
    """
    kinds = dict(docs.dtypes)
    maps = [c for c, t in kinds.items() if "map<" in t or "variant" in t]
    identity = [F.col(f"`{c}`") for c in docs.columns if c not in maps]
    identity += [F.to_json(F.struct(*[F.col(f"`{c}`") for c in maps]))] if maps else []
    plan = _entries(docs, identity, weights, ramps, most).withColumn("taken", F.col("n") * F.col("passes") + F.col("more")).where("taken > 0")
    plan = plan.select(F.col("row_key").alias("plan_key"), F.col("source").alias("plan_source"), "n", "start", "size", "passes", "taken", "source_size", "target", "ramp", "words")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_")
    rows = docs.select(whole, F.xxhash64(*identity).alias("row_key")).join(
        plan, (F.col("row_key") == F.col("plan_key")) & F.col("doc_.source").eqNullSafe(F.col("plan_source"))).drop("plan_key")
    single = rows.where("n = 1").withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("taken") - 1)))
    fields = [c for c in plan.columns if c not in ("plan_key", "plan_source")]
    several = rows.where("n > 1").groupBy("row_key", "plan_source").agg(F.first("doc_").alias("doc_"), *[F.first(c).alias(c) for c in fields])
    several = _each(several, F.col("taken"), "j").select(*single.columns)
    out = single.unionAll(several)
    full = F.col("j") < F.col("n") * F.col("passes")
    copy = F.when(full, F.floor(F.col("j") / F.col("n"))).otherwise(F.col("passes"))
    row = F.when(full, F.pmod(F.col("j"), F.col("n"))).otherwise(F.col("j") - F.col("n") * F.col("passes"))
    return out.withColumn("mix_position", _position(copy, row)).orderBy("mix_position").select("doc_.*")
