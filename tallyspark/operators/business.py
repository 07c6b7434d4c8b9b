"""The seven business queries (Q1-Q7) as DataFrame jobs.

Typing rule: money sums stay exact decimals until the final ``round`` (then
bigint); mean margins come from exact decimal sums (``exact_avg``), so results
do not depend on partitioning or row order.

Scale: every query that joins the fact to a dimension pre-aggregates the fact
on the join key first (eager aggregation). Map-side partial aggregation then
collapses a hot customer/product inside each map task, so the join shuffles at
most one row per key per task instead of every fact row, and a key holding a
third of all rows never lands whole in one join task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.exprs import (
    TIER_ZERO_LABEL_SQL,
    discount_tier,
    exact_avg,
    full_name,
    money,
)


def _partials(fact: DataFrame, keys: list[str], count_rows: bool = False) -> DataFrame:
    """Decomposable partial sums of the money/margin measures per ``keys``."""
    aggs = [
        F.sum("sales").alias("p_sales"),
        F.sum("profit").alias("p_profit"),
        F.sum("profit_margin").alias("p_margin"),
        F.count("profit_margin").alias("p_margin_n"),
    ]
    if count_rows:
        aggs.append(F.count(F.lit(1)).alias("p_rows"))
    return fact.groupBy(*keys).agg(*aggs)


def _avg_from_partials() -> F.Column:
    return F.sum("p_margin").cast("double") / F.sum("p_margin_n")


def q1_margin_trend(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Q1: region x year sales, profit, mean margin and its change vs prior year."""
    part = _partials(orders, ["customer_id", "order_year"])
    j = part.join(customers.select("customer_id", "region"), "customer_id")
    g = j.groupBy("region", "order_year").agg(
        F.sum("p_sales").alias("s"), F.sum("p_profit").alias("p"), _avg_from_partials().alias("m"))
    w = Window.partitionBy("region").orderBy("order_year")
    return g.select(
        "region",
        F.col("order_year").cast("bigint").alias("order_year"),
        money("s").alias("total_sales"),
        money("p").alias("total_profit"),
        F.round("m", 4).alias("avg_profit_margin"),
        F.round(F.col("m") - F.lag("m").over(w), 4).alias("margin_change_vs_prior_year"),
    ).orderBy("region", "order_year")


def q2_category_rank(orders: DataFrame, products: DataFrame) -> DataFrame:
    """Q2: category x sub-category totals with global sales rank and worst-margin rank.

    The two global windows run on the aggregated result (one row per category
    pair), never on the fact.
    """
    part = _partials(orders, ["product_id"])
    j = part.join(products.select("product_id", "category", "sub_category"), "product_id")
    perf = j.groupBy("category", "sub_category").agg(
        F.sum("p_sales").alias("s"), F.sum("p_profit").alias("p"), _avg_from_partials().alias("m"))
    return perf.select(
        "category",
        "sub_category",
        money("s").alias("total_sales"),
        money("p").alias("total_profit"),
        F.round("m", 4).alias("avg_margin"),
        F.rank().over(Window.orderBy(F.col("s").desc())).cast("bigint").alias("sales_rank"),
        F.rank().over(Window.orderBy(F.col("m").asc())).cast("bigint").alias("margin_rank_worst_first"),
    ).orderBy("sales_rank", "category", "sub_category")


def q3_top_customers(orders: DataFrame, customers: DataFrame, top_n: int = 3) -> DataFrame:
    """Q3: top ``top_n`` customers by profit within each region.

    Ties on profit are broken by ``customer_id``. The ``rn <= n`` filter is
    planned as a partial+final ``WindowGroupLimit``: each task keeps only its
    top rows per region before the exchange, so a region's window partition
    never holds all its customers.
    """
    part = orders.groupBy("customer_id").agg(F.sum("profit").alias("p"))
    j = part.join(customers.select("customer_id", "region", "customer_name", "last_name"), "customer_id")
    cp = j.groupBy("region", "customer_id", "customer_name", "last_name").agg(F.sum("p").alias("total_profit"))
    w = Window.partitionBy("region").orderBy(F.col("total_profit").desc(), F.col("customer_id").asc())
    ranked = cp.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= top_n)
    return ranked.select(
        "region",
        full_name("customer_name", "last_name").alias("customer"),
        money("total_profit").alias("total_profit"),
    ).orderBy("region", F.col("total_profit").desc(), "customer")


def q4_running_sales(orders: DataFrame) -> DataFrame:
    """Q4: quarterly sales and the running total ordered by quarter label."""
    g = orders.groupBy("order_quarter").agg(F.sum("sales").alias("s"))
    w = Window.orderBy("order_quarter").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return g.select(
        "order_quarter",
        money("s").alias("quarterly_sales"),
        money(F.sum("s").over(w)).alias("running_total_sales"),
    ).orderBy("order_quarter")


def q5_discount_tiers(orders: DataFrame, zero_label: str = TIER_ZERO_LABEL_SQL) -> DataFrame:
    """Q5: discount buckets with order count, mean margin and total profit,
    ordered by each bucket's smallest discount (an unselected aggregate)."""
    g = orders.groupBy(discount_tier("discount", zero_label).alias("discount_bucket")).agg(
        F.count(F.lit(1)).alias("num_orders"),
        exact_avg("profit_margin").alias("m"),
        F.sum("profit").alias("p"),
        F.min("discount").alias("min_discount"),
    )
    return g.orderBy("min_discount").select(
        "discount_bucket",
        F.col("num_orders").cast("bigint").alias("num_orders"),
        F.round("m", 4).alias("avg_profit_margin"),
        money("p").alias("total_profit"),
    )


def q6_city_tier(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Q6: region x city tier totals, mean margin and distinct customers."""
    part = _partials(orders, ["customer_id"])
    j = part.join(customers.select("customer_id", "region", "city_type"), "customer_id")
    g = j.groupBy("region", "city_type").agg(
        F.sum("p_sales").alias("s"), F.sum("p_profit").alias("p"), _avg_from_partials().alias("m"),
        F.count_distinct("customer_id").alias("customers"))
    return g.select(
        "region",
        "city_type",
        money("s").alias("total_sales"),
        money("p").alias("total_profit"),
        F.round("m", 4).alias("avg_margin"),
        F.col("customers").cast("bigint").alias("customers"),
    ).orderBy("region", F.col("total_profit").desc())


def q7_ship_mode(orders: DataFrame) -> DataFrame:
    """Q7: per ship mode mean delivery days, order count and mean order value."""
    g = orders.groupBy("ship_mode").agg(
        F.avg("delivery_days").alias("d"),
        F.count(F.lit(1)).alias("n"),
        exact_avg("sales").alias("v"),
    )
    return g.select(
        "ship_mode",
        F.round("d", 1).alias("avg_delivery_days"),
        F.col("n").cast("bigint").alias("num_orders"),
        F.round("v", 0).cast("bigint").alias("avg_order_value"),
    ).orderBy("avg_delivery_days", "ship_mode")
