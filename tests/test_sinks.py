"""Source / sink round trips (all inside the Spark process; no external service)."""

import os
import tempfile

from pyspark.sql import functions as F

from tallyspark.sources import io


def test_parquet_and_csv_round_trip(spark):
    d = tempfile.mkdtemp(prefix="sink-")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    io.write_parquet(df, os.path.join(d, "p"), partition_by=["k"])
    assert sorted(r.v for r in spark.read.parquet(os.path.join(d, "p")).collect()) == [1, 2]
    io.write_csv(df, os.path.join(d, "c"))
    back = io.read_csv(spark, os.path.join(d, "c"), schema=df.schema)
    assert sorted(tuple(r) for r in back.collect()) == [("a", 1), ("b", 2)]


def test_load_star_reports_rows_and_optional_source(spark):
    db = "tallyspark_test_db"
    tables = {
        "customers": spark.createDataFrame([("C1", "x")], "customer_id string, customer_name string"),
        "products": spark.createDataFrame([("P1", "c", "s")], "product_id string, category string, sub_category string"),
        "orders": spark.createDataFrame([("O1", 2020), ("O2", 2021)], "order_id string, order_year int"),
    }
    report = {r.table: r.rows for r in io.load_star(tables, database=db).collect()}
    assert report == {f"{db}.customers": 1, f"{db}.products": 1, f"{db}.orders": 2}
    assert io.read_optional_table(spark, f"{db}.orders").count() == 2
    assert io.read_optional_table(spark, f"{db}.missing") is None


def test_upper_case_and_key_first(spark):
    df = spark.createDataFrame([(1.0, "2020-01-01")], "forecast double, month string")
    assert io.upper_case_columns(df).columns == ["FORECAST", "MONTH"]
    out = io.key_first(df, "month", {"forecast": "forecast_sales"})
    assert out.columns == ["month", "forecast_sales"]
    assert out.select(F.col("forecast_sales")).first()[0] == 1.0


def test_star_job_writes_partitioned_fact(spark):
    from tallyspark.plans.jobs import star_job

    out = tempfile.mkdtemp(prefix="star-")
    paths = star_job(spark, "/root/testdata/sf0.001", out)
    orders = spark.read.parquet(paths["orders"])
    assert "order_year" in orders.columns
    assert any(name.startswith("order_year=") for name in os.listdir(paths["orders"]))
    assert orders.count() == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
