"""End-to-end jobs: each reads its inputs, runs the operators and writes its
outputs as Parquet (the reference's CSV hand-offs, with types kept).

Output layout for scale: the fact is partitioned by ``order_year`` so the
year slicer and yearly marts prune files; intermediate results that feed several
outputs are written once under the shared checkpoint folder.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import clean, forecast, regress, segment
from tallyspark.plans.materialize import materialize
from tallyspark.sources.io import read_csv, write_parquet


def cleaning_job(raw: DataFrame, out_dir: str, strict_first_format: bool = False) -> DataFrame:
    """Entry 1: raw export -> customers / products / orders Parquet + stage counts."""
    raw = materialize(raw, "raw")  # read by the cleaning and by the stage counts
    cleaned = clean.clean(raw, strict_first_format)
    write_parquet(cleaned.customers, os.path.join(out_dir, "customers"))
    write_parquet(cleaned.products, os.path.join(out_dir, "products"))
    write_parquet(cleaned.orders, os.path.join(out_dir, "orders"), partition_by=["order_year"])
    return clean.drop_counts(raw)


def segmentation_job(orders: DataFrame, products: DataFrame, out_dir: str, n_init: int = 10,
                     max_iter: int = 50) -> DataFrame:
    """M7: order segments + summary + k sweep."""
    seg = segment.order_segmentation(orders, products, n_init=n_init, max_iter=max_iter)
    write_parquet(seg.segments, os.path.join(out_dir, "order_segments"))
    write_parquet(seg.sweep, os.path.join(out_dir, "k_sweep"))
    summary = segment.segment_summary(seg.segments)
    write_parquet(summary, os.path.join(out_dir, "segment_summary"))
    return summary


def rfm_job(orders: DataFrame, out_dir: str, n_init: int = 10, max_iter: int = 50) -> DataFrame:
    """M8: customer RFM segments."""
    seg = segment.rfm_segments(orders, n_init=n_init, max_iter=max_iter)
    write_parquet(seg.segments, os.path.join(out_dir, "rfm"))
    return seg.segments


def forecast_job(orders: DataFrame, out_dir: str, periods: int = forecast.DEFAULT_PERIODS,
                 keys: tuple[str, ...] = ()) -> DataFrame:
    """Series report, forecast, backtest rows and backtest metrics."""
    write_parquet(forecast.series_report(orders, keys), os.path.join(out_dir, "series_report"))
    write_parquet(forecast.forecast(orders, keys, periods), os.path.join(out_dir, "forecast"))
    errors = materialize(forecast.backtest_errors(orders, keys), "backtest")
    rounded = errors.withColumns({c: F.round(c, 2) for c in ("actual", "predicted")})
    write_parquet(rounded, os.path.join(out_dir, "backtest"))
    metrics = forecast.backtest_metrics(errors, keys)
    write_parquet(metrics, os.path.join(out_dir, "backtest_metrics"))
    return metrics


def regression_job(orders: DataFrame, products: DataFrame, out_dir: str, model_type: str = "gbt") -> DataFrame:
    """Tier report of the regression rows, and one row of metrics."""
    write_parquet(regress.tier_report(regress.regression_frame(orders, products)), os.path.join(out_dir, "tier_report"))
    metrics = regress.run(orders, products, model_type)
    write_parquet(metrics, os.path.join(out_dir, "metrics"))
    return metrics


def csv_job(path: str, out_dir: str, spark: SparkSession) -> DataFrame:
    """CSV export -> star tables as one job."""
    return cleaning_job(read_csv(spark, path), out_dir)


def star_job(spark, sf_dir: str, out_dir: str, buckets: int | None = None) -> dict[str, str]:
    """Build the star tables once from the driver tables and write them as
    Parquet: customers, products, and the line-grain fact partitioned by
    ``order_year`` (year slicers prune whole folders). With ``buckets`` the fact
    is first hash-clustered on (order_year, customer_id), so each year folder
    holds ``buckets`` files with customers grouped, rather than one file per
    write task."""
    from tallyspark.sources.star import star_customers, star_orders_line, star_products
    from tallyspark.sources.tables import Tables

    t = Tables(spark, sf_dir)
    paths = {name: os.path.join(out_dir, name) for name in ("customers", "products", "orders")}
    write_parquet(star_customers(t), paths["customers"])
    write_parquet(star_products(t), paths["products"])
    fact = star_orders_line(t)
    if buckets:
        fact = fact.repartition(buckets, "order_year", "customer_id")
    write_parquet(fact, paths["orders"], partition_by=["order_year"])
    return paths


def extract_job(orders: DataFrame, customers: DataFrame, products: DataFrame, out_dir: str) -> None:
    """The flat extract (inner 3-way join), replaced in full at each refresh."""
    from tallyspark.operators.marts import flat_extract

    write_parquet(flat_extract(orders, customers, products), os.path.join(out_dir, "flat_extract"))
