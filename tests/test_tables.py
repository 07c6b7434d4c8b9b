"""Quarantined, versioned, bucketed and loaded tables; empty slices; first rows in file order."""

import datetime as dt
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import clean, marts
from tallyspark.registry import Star
from tallyspark.sources import io, quarantine, versions
from tests.conftest import SF0001
from tests.test_plans import _plan


def test_malformed_lines_are_kept_apart(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,day,v\na,31/12/2020,1.50\nb,01/02/2021,2,9\nc,01/02/2021,x\nd,,\n")
    (tmp_path / "b.csv").write_text("k,day,v\ne,2021-01-01,1\nf,03/04/2021\n")
    loaded = quarantine.load_csv(spark, str(tmp_path), "k string, day date, v decimal(4,2)", date_format="dd/MM/yyyy", with_ordinal=True)
    assert [tuple(r) for r in loaded.good.orderBy("_ordinal").select("k", "day", "v").collect()] == [("a", dt.date(2020, 12, 31), Decimal("1.50")), ("d", None, None)]
    assert sorted(r._malformed_line for r in loaded.bad.collect()) == ["b,01/02/2021,2,9", "c,01/02/2021,x", "e,2021-01-01,1", "f,03/04/2021"]
    report = {os.path.basename(r._source_file): (r.lines, r.good, r.bad) for r in loaded.report.collect()}
    assert report == {"a.csv": (4, 2, 2), "b.csv": (2, 0, 2)}


def test_dates_by_option(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,day\na,31.12.2020\n")
    got = io.read_csv(spark, str(tmp_path / "a.csv"), io.T.StructType.fromDDL("k string, day date"), date_format="dd.MM.yyyy")
    assert got.first().day == dt.date(2020, 12, 31)


def test_first_rows_in_file_order(spark, tmp_path):
    """The file's order contradicts the dates: the option keeps the file's first row, the default the earliest."""
    star = Star(spark, SF0001)
    rows = star.raw_export.where("`Customer ID` IS NOT NULL AND Sales IS NOT NULL").orderBy(F.desc("Order ID"), "Order Date").limit(300)
    path = str(tmp_path / "export.csv")
    rows.toPandas().to_csv(path, index=False)
    raw = quarantine.load_csv(spark, path, io.RAW_SCHEMA, with_ordinal=True).good
    lines = [r.asDict() for r in rows.collect()]
    cleaned = clean.clean(raw, ordinal="_ordinal")
    usable = {r["Order ID"] for r in cleaned.usable.select("Order ID").collect()}
    seen, pairs = {}, []
    for r in lines:
        if r["Order ID"] in usable:
            seen.setdefault(r["Customer ID"], r["State"])
            pair = (r["Category"], r["Sub-Category"])
            if pair not in pairs:
                pairs.append(pair)
    assert {r.customer_id: r.state for r in cleaned.customers.collect()} == seen
    numbered = {(r.category, r.sub_category): r.product_id for r in cleaned.products.collect()}
    assert numbered == {p: f"PROD-{i:04d}" for i, p in enumerate(pairs, 1)}
    default = clean.clean(raw.drop("_ordinal")).products
    assert {(r.category, r.sub_category): r.product_id for r in default.collect()} != numbered


def test_a_refresh_that_fails_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(versions.Unpublished):
        versions.read_current(spark, path)
    versions.refresh(spark.range(5), path)
    breaking = spark.range(100).select(F.when(F.col("id") == 77, F.raise_error(F.lit("half way"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="half way"):
        versions.refresh(breaking, path)
    assert versions.read_current(spark, path).count() == 5

    def refuse(new):
        raise ValueError(f"{new.count()} rows")

    with pytest.raises(ValueError, match="9 rows"):
        versions.refresh(spark.range(9), path, check=refuse)
    assert versions.read_current(spark, path).count() == 5
    running = versions.read_current(spark, path)
    versions.refresh(spark.range(6), path)
    assert running.count() == 5 and versions.read_current(spark, path).count() == 6  # a reader of the old version ends well
    for n in (7, 8):
        versions.refresh(spark.range(n), path)
    assert len(versions.published(spark, path)) == versions.KEEP
    assert sorted(x for x in os.listdir(path) if x.startswith("version")) == versions.published(spark, path)


def test_one_year_rewrites_one_folder(spark, tmp_path):
    path = str(tmp_path / "by_year")
    df = spark.createDataFrame([(1, 2020), (2, 2021), (3, 2022)], "v int, order_year int")
    versions.replace_partitions(df, path, ("order_year",))
    before = {y: sorted(os.listdir(f"{path}/order_year={y}")) for y in (2020, 2021, 2022)}
    versions.replace_partitions(spark.createDataFrame([(9, 2021)], "v int, order_year int"), path, ("order_year",))
    after = {y: sorted(os.listdir(f"{path}/order_year={y}")) for y in (2020, 2021, 2022)}
    assert [y for y in before if before[y] != after[y]] == [2021]
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("v", "order_year").collect()) == [(1, 2020), (3, 2022), (9, 2021)]


def test_bucketed_star_joins_without_an_exchange(spark):
    star = Star(spark, SF0001)
    orders = star.bucketed("orders_bucketed", "lineitem orders", lambda: star.orders)
    customers = star.bucketed("customers_bucketed", "customer nation region", lambda: star.customers)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        ledger = marts.customer_ledger(orders, customers)
        plan = _plan(ledger)
        plain = _plan(marts.customer_ledger(star.orders, star.customers))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "Exchange" not in plan and "SortMergeJoin" in plan and "Exchange" in plain
    assert ledger.agg(F.sum("orders")).first()[0] == star.orders.join(star.customers, "customer_id", "left_semi").count()


def test_manifest_passes_over_a_temporary_view(spark):
    spark.range(3).write.mode("overwrite").saveAsTable("manifest_check")
    spark.range(3).createOrReplaceTempView("manifest_check")
    try:
        assert io.manifest(spark, "manifest_check")[0] > 0
    finally:
        spark.catalog.dropTempView("manifest_check")


def test_buckets_grow_with_the_files():
    from tallyspark.registry import BUCKET_INPUT, buckets_for

    assert buckets_for(0) == buckets_for(BUCKET_INPUT) == 8
    assert buckets_for(100 * BUCKET_INPUT) == 100 and buckets_for(100 * BUCKET_INPUT + 1) == 101


def test_load_reports_files_and_a_failure(spark):
    tables = {
        "customers": spark.createDataFrame([("C1",)], "customer_id string"),
        "products": spark.range(3).select(F.raise_error(F.lit("no such thing")).cast("string").alias("product_id")),
        "orders": spark.createDataFrame([("O1", 2020)], "order_id string, order_year int"),
    }
    before = spark.catalog.currentDatabase()
    report = [r.asDict() for r in io.load_star(tables, database="tallyspark_load_db").collect()]
    assert spark.catalog.currentDatabase() == before
    assert [(r["table"].split(".")[1], r["status"], r["rows"]) for r in report] == [("customers", "OK", 1), ("products", "FAILED", None), ("orders", "SKIPPED", None)]
    assert report[0]["files"] >= 1 and report[0]["bytes"] > 0 and "no such thing" in report[1]["error"]


def test_empty_slices(spark):
    star = Star(spark, SF0001)
    empty = star.sliced(years=[1900])
    assert tuple(marts.guarded_kpi(empty).first()) == ("no rows", 0, 0.0, 0.0, None)
    assert marts.guarded(empty, marts.kpi) is None and marts.tier_margin(empty).count() == 0
    assert marts.guarded(star.sliced(years=[1997]), marts.kpi)[0].first().orders > 0
    assert "LocalTableScan" in _plan(marts.guarded_kpi(star.orders.where("false"))) or "FileScan" not in _plan(marts.guarded_kpi(star.orders.where("false")))


def test_sketches_merge_within_their_bound(spark):
    rows = spark.range(200_000).select((F.col("id") % 40_000).alias("customer_id"), (F.col("id") % 5).cast("int").alias("order_year"), F.lit("q").alias("order_quarter"),
                                       (F.col("id") % 3).cast("string").alias("ship_mode"), F.lit(1).cast("decimal(12,2)").alias("sales"), F.lit(1).cast("decimal(12,2)").alias("profit"))
    sketches = marts.customer_sketches(rows)
    assert sketches.count() == 15  # a row a combination, whatever the customers
    for by in ("order_year", "ship_mode"):
        got = marts.checked_customers(rows, sketches, by).collect()
        assert all(r.sketch_within_bound for r in got)
    total = marts.sketched_kpi(sketches.withColumn("all", F.lit(1)), "all").first()
    assert abs(total.estimated_customers - 40_000) <= 0.03 * 40_000 and total.orders == 200_000
