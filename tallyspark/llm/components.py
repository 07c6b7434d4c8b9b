"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a grouped minimum and a join, so a node with very many edges is one row of
the minimum and a skewed join key that AQE splits. Edge tables between steps are written
to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_files import shared_path


def _saved(edges: DataFrame) -> tuple[DataFrame, tuple]:
    spark = edges.sparkSession
    path = shared_path(spark, "edges")
    edges.write.parquet(path)
    edges = spark.read.parquet(path)
    state = edges.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return edges, tuple(state)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v longs): root is the smallest node that it reaches.

    Rows with a null end, loops and repeated edges do no harm; no edges give no rows.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, state = _saved(edges)
    if not state[0]:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        # large-star: neighbours above a node move to the least of its neighbourhood
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        edges = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small-star: neighbours below a node, and the node, move to the least of them
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        edges = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(least.select("u", F.col("m").alias("v"))).distinct()
        before = state
        edges, state = _saved(edges)
        if state == before:
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
