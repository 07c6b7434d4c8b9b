"""Access to the driver's parquet tables (one parquet file/folder per table)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


class Tables:
    """Lazy reader: ``Tables(spark, d).lineitem`` is ``spark.read.parquet(...)``.

    Reads are lazy, so a later ``select``/``filter`` still prunes columns and
    pushes predicates into the parquet scan.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def path(self, name: str) -> str:
        return os.path.join(self.sf_dir, f"{name}.parquet")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def size(self, *names: str) -> int:
        """Bytes of the files of some tables (a listing)."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([self.path(n) for n in names])
        return files.agg(F.sum("length")).first()[0] or 0

    def fingerprint(self, *names: str) -> tuple:
        """Paths, sizes and times of the files of some tables (a listing, no content is read)."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([self.path(n) for n in names])
        stat = files.agg(F.count("path"), F.sum("length"), F.max("modificationTime"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")))
        return (self.sf_dir, *names, *stat.first())

    def __getattr__(self, name: str) -> DataFrame:
        if name in DRIVER_TABLES:
            return self.read(name)
        raise AttributeError(name)
