"""Plan-shape checks for the scale properties the README promises."""

import contextlib
import io

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"


def _plan(df, mode="simple"):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def test_top3_uses_partial_window_group_limit(spark):
    plan = _plan(entry.queries()["q3_top_customers"](spark, SF))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_dq_suite_shuffles_keys_and_sums_only(spark):
    """No grouping sets: the flags are summed without a key, and each key check carries its key alone."""
    plan = _plan(entry.queries()["dq_dirty"](spark, SF))
    assert "spark_grouping_id" not in plan and "partial_sum" in plan


def test_pivot_columns_need_no_second_run(spark):
    plan = _plan(entry.queries()["pivot_profit_region_year"](spark, SF))
    assert "Join" not in plan  # reads the written extract


def test_marts_move_only_the_columns_they_read(spark):
    """No mart of the flat extract carries its text columns and dates through the joins; the result is the whole extract's."""
    for name, unread in (("pivot_sales_city_region", "l_discount"), ("subcategory_summary", "o_orderdate"), ("region_summary", "p_type")):
        plan = _plan(entry.queries()[name](spark, SF))
        assert "FileScan parquet [l_orderkey" in plan and unread not in plan
        assert not any(c in plan for c in ("c_name", "l_quantity", "o_orderpriority"))
    narrow = entry.registry.Star(spark, SF).written("region", "order_year", "profit")
    assert narrow.columns == ["region", "order_year", "profit"]


def test_kpi_joins_no_dimension(spark):
    plan = _plan(entry.queries()["kpi_overall"](spark, SF))
    assert "c_custkey" not in plan and "p_partkey" not in plan


def test_scan_reads_only_needed_columns(spark):
    plan = _plan(entry.queries()["q5_discount_tiers"](spark, SF))
    li_scan = [line for line in plan.splitlines() if "FileScan parquet [l_orderkey" in line][0]
    for unused in ("l_shipdate", "l_returnflag", "l_linestatus", "l_suppkey"):
        assert unused not in li_scan


def test_dimension_join_not_forced_to_broadcast(spark):
    """With broadcasting disabled by size, the customer join falls back to a
    shuffle join: no explicit hint pins it (only nation/region are checked small)."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = _plan(entry.queries()["q1_margin_trend"](spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "SortMergeJoin" in plan
    # customers are pre-aggregated per key before the join
    assert "partial_sum" in plan


def test_bounded_broadcast_checks_size(spark):
    from tallyspark.plans.joins import bounded_broadcast, fits

    small = spark.range(10)
    big = spark.range(1000)
    assert fits(small, 10) and not fits(big, 10)
    fact = spark.range(100_000).withColumnRenamed("id", "k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        hinted = _plan(fact.join(bounded_broadcast(small.withColumnRenamed("id", "k"), 10), "k"))
        plain = _plan(fact.join(bounded_broadcast(big.withColumnRenamed("id", "k"), 10), "k"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "BroadcastHashJoin" in hinted
    assert "BroadcastHashJoin" not in plain and "SortMergeJoin" in plain


def test_margin_band_reads_the_fact_once(spark):
    """Customers' and products' margins come from one scan; partial sums run before the exchange."""
    plan = _plan(entry.queries()["n2_margin_band"](spark, SF))
    assert sum("FileScan parquet" in x and "l_orderkey" in x for x in plan.splitlines()) == 1
    assert "partial_sum(UnscaledValue(profit_margin" in plan


def test_flat_extract_derives_columns_after_its_joins(spark, tmp_path):
    """Rows of the plain joins, with orphans, null and repeated keys; no derived column crosses an exchange."""
    import datetime as dt

    from tallyspark.operators import marts
    from tallyspark.sources import star
    from tallyspark.sources.tables import Tables

    t = Tables(spark, str(tmp_path))
    day = dt.datetime(1997, 5, 4)
    for name, rows, schema in (
        ("region", [(0, "ASIA")], "r_regionkey int, r_name string"),
        ("nation", [(7, "JAPAN", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        ("customer", [(1, "C#1", 7, "A"), (1, "C#1b", 7, "B"), (2, "C#2", 99, "A"), (None, "C", 7, "A")], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string"),
        ("part", [(5, "T", "b"), (5, "T", "c"), (6, None, None), (None, "T", "b")], "p_partkey long, p_type string, p_brand string"),
        ("orders", [(10, 1, day, "2-HIGH"), (10, 2, day, None), (11, None, None, "5-LOW"), (51, 1, None, "1-URGENT"), (None, 1, day, "2-HIGH")], "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string"),
        ("lineitem", [(10, 5, 1, 2.0, 9.5, 0.1, 0.02), (10, 5, 1, 2.0, 9.5, 0.1, 0.02), (51, 6, 3, None, 0.0, None, 0.0), (51, None, 1, 1.0, 1.0, 0.0, 0.0), (12, 5, 1, 1.0, 1.0, 0.0, 0.0), (None, 5, 1, 1.0, 1.0, 0.0, 0.0)],
         "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(t.path(name))
    c, p = star.star_customers(t), star.star_products(t)
    got = marts.flat_extract_of(*star.line_tables(t), c, p, star.ORDER_KEY, star.line_columns)
    want = marts.flat_extract(star.star_orders_line(t), c, p)
    assert got.columns == want.columns and got.count() == want.count() == 10
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = marts.flat_extract_of(*star.line_tables(t), c, p, star.ORDER_KEY, star.line_columns)
        text = plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = text.splitlines()
    exchanged = [lines[i + 1] for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]
    assert exchanged and not any("order_quarter" in line or "profit_margin" in line for line in exchanged)
