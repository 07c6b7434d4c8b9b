"""End-to-end jobs: outputs on disk against the operators they are made of."""

import os

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import forecast
from tallyspark.plans import jobs
from tallyspark.registry import Star
from tallyspark.sources.io import RAW_SCHEMA

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def star(spark):
    return Star(spark, SF)


def _read(spark, folder, name):
    return spark.read.parquet(os.path.join(str(folder), name))


def test_csv_to_star(spark, star, tmp_path):
    """The whole path from a CSV file, with a renamed category header and the columns that are dropped."""
    raw = star.raw_export
    renamed = raw.withColumnRenamed("Category", "Category of Goods").withColumns({"Product ID": F.lit("P"), "Product Name": F.lit("N")})
    path = str(tmp_path / "export")
    renamed.write.option("header", True).csv(path)
    schema = type(RAW_SCHEMA)([f for f in renamed.schema])
    from tallyspark.sources.io import read_csv

    counts = jobs.cleaning_job(read_csv(spark, path, schema), str(tmp_path / "out"))  # takes the raw header
    assert counts.first() is not None
    want = star.cleaned
    for name in ("customers", "products", "orders"):
        got = _read(spark, tmp_path / "out", name)
        frame = getattr(want, name)
        assert got.count() == frame.count()
        assert got.select(*frame.columns).exceptAll(frame).count() == 0


def test_csv_job_reads_the_export_schema(spark, star, tmp_path):
    path = str(tmp_path / "export")
    star.raw_export.write.option("header", True).csv(path)
    jobs.csv_job(path, str(tmp_path / "out"), spark)
    assert _read(spark, tmp_path / "out", "orders").count() == star.cleaned.orders.count()


def test_forecast_job(spark, star, tmp_path):
    metrics = jobs.forecast_job(star.orders, str(tmp_path)).collect()
    assert len(metrics) == 1
    assert _read(spark, tmp_path, "forecast").count() == forecast.DEFAULT_PERIODS
    assert _read(spark, tmp_path, "backtest").count() == forecast.HOLDOUT
    assert _read(spark, tmp_path, "series_report").first().status == "ok"


def test_regression_job(spark, star, tmp_path):
    row = jobs.regression_job(star.orders_og, star.products, str(tmp_path), "linear").first()
    assert row.rows == sum(r.orders for r in _read(spark, tmp_path, "tier_report").collect())
    assert row.improvement == pytest.approx((row.baseline_rmse - row.rmse) / row.baseline_rmse)


def test_segmentation_and_rfm_jobs(spark, star, tmp_path):
    jobs.segmentation_job(star.orders_og, star.products, str(tmp_path), n_init=2, max_iter=5)
    segments = _read(spark, tmp_path, "order_segments")
    assert segments.count() == sum(r.orders for r in _read(spark, tmp_path, "segment_summary").collect())
    assert _read(spark, tmp_path, "k_sweep").where("selected").count() == 1
    jobs.rfm_job(star.orders_og, str(tmp_path), n_init=2, max_iter=5)
    assert _read(spark, tmp_path, "rfm").count() == star.orders_og.select("customer_id").distinct().count()


def test_extract_job_and_views(spark, star, tmp_path):
    jobs.extract_job(star.orders, star.customers, star.products, str(tmp_path))
    assert _read(spark, tmp_path, "flat_extract").count() == star.orders.count()
    from tallyspark.sources.star import register_star

    register_star(spark, SF)
    joined = spark.sql("SELECT count(*) AS n FROM orders JOIN customers USING (customer_id) JOIN products USING (product_id)")
    assert joined.first().n == star.orders.count()
