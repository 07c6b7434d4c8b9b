"""Dashboard / workbook / app datasets: KPI card, slicers, pivots, summaries
and the flat extract (A8-A12, A29-A33, P11-P17, S12).

The interactive app joins orders LEFT products LEFT customers (orphans kept);
the workbook extract joins INNER (orphans dropped). Both are kept, per query.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.exprs import TIER_ZERO_LABEL, discount_tier, exact_avg, money, tier_rank


def app_view(orders: DataFrame, products: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders LEFT JOIN products LEFT JOIN customers (keeps orphan orders)."""
    return orders.join(products, "product_id", "left").join(customers, "customer_id", "left")


def flat_extract(orders: DataFrame, customers: DataFrame, products: DataFrame) -> DataFrame:
    """Orders JOIN customers JOIN products, every column (drops orphans)."""
    return orders.join(customers, "customer_id").join(products, "product_id")


def flat_extract_of(lines: DataFrame, headers: DataFrame, customers: DataFrame, products: DataFrame, key: str,
                    columns: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """``flat_extract`` of a fact that is still in two narrow tables, lines and their orders.

    Products join the lines and customers join the orders, so that no wide row crosses an exchange twice; ``columns``
    derives the fact's columns last, with the dimensions' columns behind them.
    """
    own = [c for c in customers.columns if c != "customer_id"] + [c for c in products.columns if c != "product_id"]
    joined = lines.join(products, "product_id").join(headers.join(customers, "customer_id"), key)
    rows = columns(joined, own)
    return rows.select("product_id", "customer_id", *[c for c in rows.columns if c not in ("product_id", "customer_id")])


def apply_slicers(
    df: DataFrame,
    regions: Sequence[str] | None = None,
    categories: Sequence[str] | None = None,
    city_types: Sequence[str] | None = None,
    date_range: tuple[dt.date, dt.date] | None = None,
    years: Sequence[int] | None = None,
    segments: Sequence[str] | None = None,
) -> DataFrame:
    """IN-list filters (an empty list means no filter) and an
    inclusive date range applied only when both ends are given. All are plain
    predicates, so they reach the parquet scan / partition filter."""
    for c, values in (("region", regions), ("category", categories), ("city_type", city_types),
                      ("order_year", years), ("segment", segments)):
        if values:
            df = df.where(F.col(c).isin(*values))
    if date_range and len(date_range) == 2 and all(d is not None for d in date_range):
        df = df.where(F.col("order_date").between(F.lit(date_range[0]), F.lit(date_range[1])))
    return df


def sliced(orders: DataFrame, products: DataFrame, customers: DataFrame, **slicers) -> DataFrame:
    """The app's filtered frame: orders with the slicers applied, joined only to the
    dimensions that a slicer in use needs, and those filtered first. A slicer on a dimension
    drops orders without a match, as filtering the left join does."""
    own = {k: slicers.get(k) for k in ("date_range", "years")}
    out = apply_slicers(orders, **{k: v for k, v in own.items() if v})
    of = {"regions": "region", "city_types": "city_type", "segments": "segment"}
    if used := {k: v for k in of if (v := slicers.get(k))}:
        dim = apply_slicers(customers, **used).select("customer_id", *(of[k] for k in used))
        out = out.join(dim, "customer_id")
    if values := slicers.get("categories"):
        out = out.join(apply_slicers(products, categories=values).select("product_id", "category"), "product_id")
    return out


def kpi(df: DataFrame) -> DataFrame:
    """Orders, total sales, total profit, mean margin over a (filtered) frame."""
    return df.agg(
        F.count(F.lit(1)).cast("bigint").alias("orders"),
        F.sum("sales").alias("s"),
        F.sum("profit").alias("p"),
        exact_avg("profit_margin").alias("m"),
    ).select("orders", money("s", 2).alias("total_sales"), money("p", 2).alias("total_profit"),
             F.round("m", 4).alias("avg_margin"))


def slicer_options(orders: DataFrame, customers: DataFrame, products: DataFrame) -> DataFrame:
    """P15 over the app's left-joined frame, computed from distinct keys: the
    fact is reduced to its distinct customer / product keys map-side, and only
    those are joined to the dimensions. """
    cust = orders.select("customer_id").distinct().join(
        customers.select("customer_id", "region", "city_type"), "customer_id")
    prod = orders.select("product_id").distinct().join(
        products.select("product_id", "category"), "product_id")
    parts = [cust.select(F.lit("region").alias("field"), F.col("region").alias("value")),
             prod.select(F.lit("category").alias("field"), F.col("category").alias("value")),
             cust.select(F.lit("city_type").alias("field"), F.col("city_type").alias("value"))]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.where(F.col("value").isNotNull()).distinct().orderBy("field", "value")


def profit_by_region_keys(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """A10 over the app's (sliced) frame, pre-aggregated per customer first (orphan
    customers land in the NULL region, as with the left join)."""
    part = orders.groupBy("customer_id").agg(F.sum("profit").alias("p"))
    j = part.join(customers.select("customer_id", "region"), "customer_id", "left")
    return j.groupBy("region").agg(money(F.sum("p"), 2).alias("total_profit")).orderBy("total_profit")


def date_bounds(df: DataFrame) -> DataFrame:
    """Min and max order date for the date-range control."""
    return df.agg(F.min("order_date").alias("min_order_date"), F.max("order_date").alias("max_order_date"))


def sales_by_quarter(orders: DataFrame) -> DataFrame:
    """Total sales per quarter label."""
    return orders.groupBy("order_quarter").agg(money(F.sum("sales"), 2).alias("total_sales")).orderBy("order_quarter")


def tier_margin(df: DataFrame) -> DataFrame:
    """Mean margin (4 dp) and order count per discount tier, in the fixed
    tier order; tiers with no rows are simply absent."""
    g = df.groupBy(discount_tier("discount", TIER_ZERO_LABEL).alias("discount_tier")).agg(
        F.round(exact_avg("profit_margin"), 4).alias("avg_margin"),
        F.count(F.lit(1)).cast("bigint").alias("orders"),
    )
    return g.withColumn("tier_order", tier_rank("discount_tier").cast("bigint")).orderBy("tier_order")


def pivot_sum(df: DataFrame, row: str, column: str, measure: str, values: Sequence) -> DataFrame:
    """2-D SUMIF table with one column for each of ``values``, which the caller
    takes from a dimension or the dates, so that the fact runs once."""
    out = df.groupBy(row).pivot(column, list(values)).agg(F.sum(measure))
    cols = [c for c in out.columns if c != row]
    return out.select(row, *[money(F.col(f"`{c}`"), 2).alias(str(c)) for c in cols]).orderBy(row)


def group_summary(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Orders, sales, profit and mean margin per key."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("bigint").alias("orders"),
        money(F.sum("sales"), 2).alias("total_sales"),
        money(F.sum("profit"), 2).alias("total_profit"),
        F.round(exact_avg("profit_margin"), 4).alias("avg_margin"),
    ).orderBy(*keys)


def margin_by_region_year(df: DataFrame) -> DataFrame:
    """Mean margin by region x year (the dashboard's trend line)."""
    return df.groupBy("region", "order_year").agg(
        F.round(exact_avg("profit_margin"), 4).alias("avg_margin"),
        F.count(F.lit(1)).cast("bigint").alias("orders"),
    ).withColumn("order_year", F.col("order_year").cast("bigint")).orderBy("region", "order_year")


def category_scatter(df: DataFrame) -> DataFrame:
    """Sales against mean margin per category / sub-category."""
    return df.groupBy("category", "sub_category").agg(
        money(F.sum("sales"), 2).alias("total_sales"),
        F.round(exact_avg("profit_margin"), 4).alias("avg_margin"),
    ).orderBy("category", "sub_category")


def profit_city_region(df: DataFrame) -> DataFrame:
    """Profit by city tier x region (heat-map source, long form)."""
    return df.groupBy("city_type", "region").agg(
        money(F.sum("profit"), 2).alias("total_profit")).orderBy("city_type", "region")


def head_preview(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """First ``n`` rows under an explicit order (a top-n is the feature)."""
    return df.orderBy(*order_by).limit(n)


def customer_ledger(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Every customer with the number, sum and span of their orders (0 and NULL without any).

    On tables bucketed by customer_id neither the join nor the grouping needs an exchange.
    """
    sums = orders.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("sales").alias("s"), F.sum("profit").alias("p"),
        F.min("order_date").alias("first_order"), F.max("order_date").alias("last_order"))
    joined = customers.select("customer_id", "region", "segment").join(sums, "customer_id", "left")
    return joined.select("customer_id", "region", "segment", F.coalesce("orders", F.lit(0)).cast("bigint").alias("orders"),
                         money("s", 2).alias("total_sales"), money("p", 2).alias("total_profit"), "first_order", "last_order")


SKETCH_BITS = 14  # standard error of a count: 0.83 / sqrt(2^14), about 0.65 %
SLICES = ("order_year", "order_quarter", "ship_mode")


def customer_sketches(orders: DataFrame, by: Sequence[str] = SLICES) -> DataFrame:
    """One mergeable sketch of the customers, with orders, sales and profit, for each combination of slicer values.

    It has a row a combination, not a customer, so a dashboard's slices read it instead of the fact.
    """
    return orders.groupBy(*by).agg(F.hll_sketch_agg("customer_id", F.lit(SKETCH_BITS)).alias("customers"),
                                   F.count(F.lit(1)).alias("orders"), F.sum("sales").alias("s"), F.sum("profit").alias("p"))


def sketched_kpi(sketches: DataFrame, by: str) -> DataFrame:
    """A6 / A12 by one slicer from the sketches alone: estimated distinct customers, orders, sales, profit."""
    merged = sketches.groupBy(by).agg(F.hll_union_agg("customers").alias("u"), F.sum("orders").cast("bigint").alias("orders"), F.sum("s").alias("s"), F.sum("p").alias("p"))
    return merged.select(by, F.hll_sketch_estimate("u").alias("estimated_customers"), "orders", money("s", 2).alias("total_sales"), money("p", 2).alias("total_profit"))


def checked_customers(orders: DataFrame, sketches: DataFrame, by: str, bound: float = 0.03) -> DataFrame:
    """The slicer's rows with the exact count of customers beside, and whether the estimate is within ``bound`` of it."""
    exact = orders.select(by, "customer_id").distinct().groupBy(by).agg(F.count("customer_id").alias("customers"))
    joined = sketched_kpi(sketches, by).join(exact, by)
    return joined.select(by, "customers", (F.abs(F.col("estimated_customers") - F.col("customers")) <= bound * F.col("customers")).alias("sketch_within_bound"),
                         "orders", "total_sales", "total_profit")


def guarded_kpi(df: DataFrame) -> DataFrame:
    """The KPI row with a status, in one aggregate: ``ok``, or ``no rows`` with zero sums and no margin.

    Nothing runs twice to find out whether a slice is empty; a filter that the optimiser can
    prove empty becomes an empty relation and reads no file.
    """
    card = kpi(df)
    none = F.col("orders") == 0
    return card.select(F.when(none, "no rows").otherwise("ok").alias("status"), "orders",
                       *[F.when(none, 0.0).otherwise(F.col(c)).alias(c) for c in ("total_sales", "total_profit")], "avg_margin")


def guarded(df: DataFrame, *outputs: Callable[[DataFrame], DataFrame]) -> list[DataFrame] | None:
    """The dashboard's frames of a slice, or None if it has no rows; the check stops at the first row found."""
    return None if df.isEmpty() else [f(df) for f in outputs]


def year_totals(extract: DataFrame) -> DataFrame:
    """Rows and sales of an extract by year."""
    return extract.groupBy("order_year").agg(F.count(F.lit(1)).alias("orders"), money(F.sum("sales"), 2).alias("total_sales")).orderBy("order_year")


def load_summary(loaded) -> DataFrame:
    """A CSV load (``quarantine.Loaded``) in one row: lines, good and bad ones, and the sums of the good ones."""
    counts = loaded.report.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("lines", "good", "bad")])
    sums = loaded.good.agg(money(F.sum("sales"), 2).alias("total_sales"), F.sum("quantity").alias("total_quantity"), F.max("order_date").alias("last_date"))
    return counts.crossJoin(sums)  # one row each
