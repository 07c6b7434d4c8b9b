"""CSV with quarantine: malformed lines are kept apart, counted and never half-read.

A line is malformed if it has another number of fields than the header or a field that its
column's type cannot hold. Spark's reader marks such lines; the whole parse is written
once, because a later column selection would let it skip the very fields that are wrong.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.plans.materialize import materialize

LINE = "_malformed_line"
FILE = "_source_file"
ORDINAL = "_ordinal"


@dataclass
class Loaded:
    """Rows that fit the schema; malformed lines with their file; counts a file."""

    good: DataFrame
    bad: DataFrame
    report: DataFrame


def ordinal() -> F.Column:
    """A row's place in its files: path, start of the block that was read, and place within the read.

    It grows with the file's own order on every layout of tasks, so "the first row" can be
    taken as a file has it, also behind shuffles.
    """
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))


def load_csv(spark: SparkSession, path: str, schema: T.StructType | str, date_format: str | None = None, with_ordinal: bool = False, header: bool = True) -> Loaded:
    """Read CSV with a header line a file (or none); ``good`` has ``schema``'s columns (and _ordinal if asked for), ``bad`` the raw lines.

    Empty lines are no rows; quoted fields may hold line feeds only if the file is not split,
    so they are not supported. Parsing and writing run when this is called.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    fields = T.StructType([*schema.fields, T.StructField(LINE, T.StringType(), True)])
    reader = spark.read.schema(fields).option("header", header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", LINE)
    if date_format:
        reader = reader.option("dateFormat", date_format)
    parsed = reader.csv(path).select("*", F.col("_metadata.file_path").alias(FILE), *([ordinal().alias(ORDINAL)] if with_ordinal else []))
    table = materialize(parsed, "csv-parsed")
    good = table.where(F.col(LINE).isNull())
    report = table.groupBy(FILE).agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col(LINE).isNull()).alias("good"), F.count(LINE).alias("bad"))
    return Loaded(good.select(*schema.names, *([ORDINAL] if with_ordinal else [])), table.where(F.col(LINE).isNotNull()).select(FILE, LINE), report)
