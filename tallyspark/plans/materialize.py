"""Cut lineage by writing an intermediate table into the shared checkpoint folder.

``spark.checkpoint.dir`` names shared storage on a cluster; the table written
there survives executor loss (unlike cached or locally checkpointed blocks), and
reading it back gives downstream plans a fresh, short lineage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyspark.session import scratch_table_path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet under the checkpoint folder and read it back."""
    path = scratch_table_path(df.sparkSession, f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def shared(spark: SparkSession, key: tuple, build: Callable[[], DataFrame]) -> DataFrame:
    """The table written for ``key``, built at its first use in this application.

    ``key`` holds the fingerprint of the inputs (file sizes and times), so changed
    data is built anew. The table lives in the checkpoint folder as long as the
    application remembers it; nothing is kept in executors' memory.
    """
    known = spark.sparkContext.__dict__.setdefault("_tallyspark_tables", {})
    if key not in known:
        path = scratch_table_path(spark, f"{key[0]}-{uuid.uuid4().hex[:12]}")
        build().write.parquet(path)
        known[key] = path
    return spark.read.parquet(known[key])


def bucketed(spark: SparkSession, key: tuple, column: str, buckets: int, build: Callable[[], DataFrame]) -> DataFrame:
    """As ``shared``, written as ``buckets`` sorted files by the hash of ``column``.

    Tables with equal buckets of their key columns are joined and grouped by them without an exchange. The
    rows are dealt by the column before the write, so a bucket is one file; the number
    of buckets is the caller's, by size (some 128 MB a bucket). The table is external, in the shared folder.
    """
    known = spark.sparkContext.__dict__.setdefault("_tallyspark_tables", {})
    key = (*key, column, buckets)
    if key not in known:
        name = f"{key[0]}_{uuid.uuid4().hex[:12]}"
        rows = build().repartition(buckets, column)
        rows.write.bucketBy(buckets, column).sortBy(column).option("path", scratch_table_path(spark, name)).saveAsTable(name)
        known[key] = name
    return spark.table(known[key])
