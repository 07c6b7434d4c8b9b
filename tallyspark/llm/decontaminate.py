"""Operator 7: benchmark decontamination by size-partitioned MinHash containment (DataFrame functions only).

Items are partitioned by size: class c holds items of 2^c to 2^(c+1) - 1 shingles. An
item's sketch is its m smallest shingle hashes, where m is one more than the
shingles that an item of the class may miss and still be contained to ``threshold``; a document that
contains the item so far holds one of them at least, however long it is. So the search
probes each document's shingle hashes for sketch hashes and loses nothing. Documents
with a hit are verified: their shingles, as strings, against all shingles of all items.
Which way a join goes is left to the planner, which knows the size of the written tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .token_files import shared_path

GAPS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAPS), "")


def hashes(w: Column, n: int) -> Column:
    """Hash of every n consecutive words."""
    following = [lambda i, k=k: F.get(w, i + k) for k in range(1, n)]
    return F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(0))), lambda x, i: F.xxhash64(F.lit(n), x, *[f(i) for f in following]))


def strings(w: Column, n: int) -> Column:
    """Every n consecutive words, joined by spaces."""
    return F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))


def row_key() -> Column:
    """Tells rows apart whatever their doc_id is."""
    return F.xxhash64("doc_id", "text")


def matches(docs: DataFrame, items: DataFrame, threshold: float = 0.8, n: int = 5) -> DataFrame:
    """(row_key, doc_id, item_id, n_shingles, n_found, containment) of documents that contain items.

    ``docs``: doc_id, text; ``items``: item_id, text; further columns are ignored. Containment: the share of the
    item's different ``n``-word shingles that occur in the document, ``threshold`` or more. An item
    of fewer words is one shingle; one without words, or null, is contained nowhere, and
    a document without words contains nothing. A null doc_id or item_id is kept as it is;
    rows that share doc_id and text count as one, rows that share an item_id are taken
    together as one set of shingles. Empty tables give no rows.
    """
    spark = docs.sparkSession
    w = F.col("w")
    parts = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    parts = parts.withColumn("n", F.least(F.size("w"), F.lit(n)))
    lengths = sorted(r[0] for r in parts.select("n").distinct().collect())  # n values at most
    shingles = None
    for k in lengths:
        some = parts.where(F.col("n") == k).select("item_id", F.lit(k).alias("n"), F.explode(F.arrays_zip(strings(w, k).alias("s"), hashes(w, k).alias("h"))).alias("z"))
        some = some.select("item_id", "n", "z.s", "z.h")
        shingles = some if shingles is None else shingles.unionAll(some)
    if shingles is None:
        return docs.select(row_key().alias("row_key"), "doc_id").limit(0).crossJoin(items.select("item_id").limit(0)).selectExpr(
            "row_key", "doc_id", "item_id", "0L AS n_shingles", "0L AS n_found", "0D AS containment")
    path = shared_path(spark, "item-shingles")
    one = W.partitionBy("item_id")
    shingles = shingles.distinct().withColumn("q", F.count("s").over(one)).withColumn("place", F.row_number().over(one.orderBy("h", "s")))
    shingles.write.parquet(path)
    shingles = spark.read.parquet(path)
    upper = F.expr("shiftleft(1L, length(bin(q))) - 1")  # of the item's size class
    sketch = shingles.where(F.col("place") <= upper - F.ceil(F.lit(threshold) * upper - F.lit(1e-9)) + 1).select(F.col("h").alias("sketch")).distinct()

    base = docs.select("doc_id", "text", row_key().alias("row_key"))
    probes = base.select("row_key", words(F.col("text")).alias("w")).select("row_key", F.explode(F.array_distinct(F.concat(*[hashes(w, k) for k in lengths]))).alias("h"))
    hit = probes.join(sketch, F.col("h") == F.col("sketch"), "left_semi").select("row_key").distinct()
    path = shared_path(spark, "candidates")
    hit.write.parquet(path)
    found = base.join(spark.read.parquet(path), "row_key", "left_semi").dropDuplicates(["row_key"])
    found = found.select("row_key", "doc_id", words(F.col("text")).alias("w"))
    held = None
    for k in lengths:
        some = found.where(F.size(w) >= k).select("row_key", "doc_id", F.lit(k).alias("n"), F.explode(F.array_distinct(strings(w, k))).alias("s"))
        held = some if held is None else held.unionAll(some)
    pairs = held.join(shingles.select("item_id", "n", "s", "q"), ["n", "s"]).groupBy("row_key", "doc_id", "item_id").agg(F.max("q").alias("n_shingles"), F.count("s").alias("n_found"))
    return pairs.withColumn("containment", F.col("n_found") / F.col("n_shingles")).where(F.col("containment") >= threshold)


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = 0.8, n: int = 5) -> DataFrame:
    """Rows of ``docs``, all columns, that contain no item; see ``matches`` for what that means."""
    path = shared_path(docs.sparkSession, "contaminated")
    matches(docs, items, threshold, n).select("row_key").distinct().write.parquet(path)
    bad = docs.sparkSession.read.parquet(path)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_")  # columns may have any name
    return docs.select(whole, row_key().alias("row_key")).join(bad, "row_key", "left_anti").select("doc_.*")
