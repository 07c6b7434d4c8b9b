"""Readers and sinks.

Readers always take an explicit schema: schema inference costs an extra pass
over the data and silently changes types between files. Sinks write Parquet
(types survive, unlike CSV) or tables; appends are opt-in because they are not
idempotent on reruns.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.sources.raw import RAW_COLUMNS
from tallyspark.sources.schema import CUSTOMER_COLUMNS, ORDER_TYPES, PRODUCT_COLUMNS

RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in RAW_COLUMNS])

CUSTOMERS_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in CUSTOMER_COLUMNS])
PRODUCTS_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in PRODUCT_COLUMNS])
_TYPES = {"string": T.StringType(), "date": T.DateType(), "int": T.IntegerType(), "boolean": T.BooleanType()} | {
    f"decimal({p},{s})": T.DecimalType(p, s) for p, s in ((12, 2), (4, 2), (6, 4))}
ORDERS_SCHEMA = T.StructType([T.StructField(c, _TYPES[t], True) for c, t in ORDER_TYPES.items()])


def read_csv(spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA,
             date_format: str | None = None) -> DataFrame:
    """Header CSV with an explicit schema (dates parsed by ``date_format``)."""
    r = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
    if date_format:
        r = r.option("dateFormat", date_format)
    return r.csv(path)


def read_optional_table(spark: SparkSession, name: str) -> DataFrame | None:
    """The table if the catalog has it, else None."""
    return spark.table(name) if spark.catalog.tableExists(name) else None


def upper_case_columns(df: DataFrame) -> DataFrame:
    """Upper-case every column name (warehouse convention)."""
    return df.toDF(*[c.upper() for c in df.columns])


def key_first(df: DataFrame, key: str, rename: dict[str, str] | None = None) -> DataFrame:
    """Key column first, values after (optionally renamed)."""
    out = df.select(key, *[c for c in df.columns if c != key])
    return out.withColumnsRenamed(rename) if rename else out


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite",
                  partition_by: Iterable[str] | None = None) -> None:
    """Overwrite (default) or append a Parquet dataset, optionally partitioned."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header CSV, no index column."""
    df.write.mode(mode).option("header", True).csv(path)


def save_table(df: DataFrame, name: str, mode: str = "overwrite",
               partition_by: Iterable[str] | None = None, bucket_by: tuple[int, str] | None = None) -> None:
    """(re)create a managed table. Bucketing on the join key lets later
    joins on that key run without a shuffle of this side."""
    w = df.write.mode(mode).format("parquet")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if bucket_by:
        w = w.bucketBy(bucket_by[0], bucket_by[1]).sortBy(bucket_by[1])
    w.saveAsTable(name)


def manifest(spark: SparkSession, table: str) -> tuple[int, int]:
    """Files and bytes of a table, from a listing of its folder (no content is read). A temporary view of that name is passed over."""
    name = table if "." in table else f"`{spark.catalog.currentDatabase()}`.{table}"
    location = spark.sql(f"DESCRIBE FORMATTED {name}").where("col_name = 'Location'").first()["data_type"]
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(location)
    files, size = listing.agg(F.count("path"), F.coalesce(F.sum("length"), F.lit(0))).first()
    return files, size


@contextmanager
def using_database(spark: SparkSession, database: str | None) -> Iterator[None]:
    """``USE database`` (created if absent) inside the block; the database before is current again after it."""
    if not database:
        yield
        return
    before = spark.catalog.currentDatabase()
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    spark.sql(f"USE {database}")
    try:
        yield
    finally:
        spark.sql(f"USE {before}")


def _root_message(error: Exception) -> str:
    """First line of the innermost cause's message."""
    text = str(error)
    causes = [line.split(": ", 1)[-1] for line in text.splitlines() if line.startswith("Caused by: ")]
    while getattr(error, "_cause", None) is not None:
        error = error._cause
    return (str(error).splitlines() or causes[-1:] or [text])[0][:500]


def load_star(tables: dict[str, DataFrame], mode: str = "overwrite", database: str | None = None) -> DataFrame:
    """Load star tables parents first (customers, products, orders) in ``database`` and
    report (table, status, rows, files, bytes, error).

    Row counts come from an ``Observation`` on the write itself, not from a second scan; files and
    bytes from a listing after it. A table that fails is reported as FAILED with its error;
    tables behind it are SKIPPED, as they refer to it.
    """
    spark = next(iter(tables.values())).sparkSession
    report, failed = [], False
    with using_database(spark, database):
        for name in ("customers", "products", "orders"):
            if name not in tables:
                continue
            target = f"{database}.{name}" if database else name
            if failed:
                report.append((target, "SKIPPED", None, None, None, None))
                continue
            obs = Observation(f"load_{name}")
            df = tables[name].observe(obs, F.count(F.lit(1)).alias("rows"))
            partition = ["order_year"] if name == "orders" and "order_year" in df.columns else None
            try:
                save_table(df, name, mode, partition_by=partition)
                report.append((target, "OK", int(obs.get["rows"]), *manifest(spark, name), None))
            except (PySparkException, Py4JJavaError) as e:
                failed = True
                report.append((target, "FAILED", None, None, None, _root_message(e)))
    return spark.createDataFrame(report, "table string, status string, rows bigint, files bigint, bytes bigint, error string")


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append",
               properties: dict[str, str] | None = None) -> None:
    """Append (or overwrite) into a relational database over JDBC."""
    df.write.jdbc(url, table, mode=mode, properties=properties or {})
