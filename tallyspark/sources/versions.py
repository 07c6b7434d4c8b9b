"""Tables that are replaced in full or by partition without a moment in which readers lose the old one.

A refresh writes a new version beside the published ones, checks it, and publishes it by
creating one empty marker file, the only step that readers can see. A refresh that fails at
any point leaves the old version as it was. Older versions but one are then removed, so
a reader that has started on the previous one can finish.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

KEEP = 2
_PUBLISHED = "_published"


class Unpublished(ValueError):
    """The path holds no published version."""


def _fs(spark: SparkSession, path: str):
    """Hadoop's file system of a path, so any store Spark reaches will do."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def published(spark: SparkSession, path: str) -> list[str]:
    """Names of the published versions, oldest first."""
    fs, Path = _fs(spark, path)
    folder = Path(f"{path}/{_PUBLISHED}")
    return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The version published last; raises ``Unpublished`` if there is none."""
    names = published(spark, path)
    if not names:
        raise Unpublished(path)
    return spark.read.parquet(f"{path}/{names[-1]}")


def refresh(df: DataFrame, path: str, check: Callable[[DataFrame], None] | None = None, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Replace the table at ``path`` by ``df`` and return the new version as read back.

    ``check`` gets the written version and raises to refuse it; what was written is then
    removed and the old version stays published. One refresh of a path runs at a time.
    """
    spark = df.sparkSession
    names = published(spark, path)
    number = int(names[-1].split("-")[1]) + 1 if names else 1
    name = f"version-{number:012d}-{uuid.uuid4().hex[:8]}"
    fs, Path = _fs(spark, path)
    try:
        df.write.partitionBy(*partition_by).parquet(f"{path}/{name}")
        new = spark.read.parquet(f"{path}/{name}")
        if check:
            check(new)
        fs.create(Path(f"{path}/{_PUBLISHED}/{name}"), False).close()
    except Exception:
        fs.delete(Path(f"{path}/{name}"), True)
        raise
    for old in names[: max(0, len(names) + 1 - KEEP)]:
        fs.delete(Path(f"{path}/{_PUBLISHED}/{old}"), False)
        fs.delete(Path(f"{path}/{old}"), True)
    return new


def replace_partitions(df: DataFrame, path: str, partition_by: tuple[str, ...]) -> None:
    """Overwrite only the partitions that ``df`` has rows of; the other folders are not touched."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)
