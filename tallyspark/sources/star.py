"""Driver tables -> the store-sales star schema (customers, products, orders).

The reference works on one flat store export normalised into a 3-table star.
The driver supplies TPC-H-like tables instead; these views map them onto the
same star columns and types so every downstream operator runs unchanged.

Scale notes
-----------
* No dimension is joined with a hint: file statistics and AQE decide, which makes the
  25-row geography a broadcast and lets ``customer`` and ``part`` shuffle when they grow.
* The line-grain fact is ``lineitem JOIN orders`` on the order key: the one
  large-large join, hash-partitioned on the key at both sides.
* The order-grain fact aggregates lines per order key *before* joining, so the
  join input is already partitioned on the join key (no extra exchange for the
  aggregated side) and map-side partial aggregation shrinks the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.exprs import profit_margin, quarter_label
from tallyspark.sources.schema import ORDER_COLUMNS
from tallyspark.sources.tables import Tables

# --- fixed values: mapping of driver columns onto star columns --------------
SHIP_MODE_BY_PRIORITY = {
    "1-URGENT": "Same Day",
    "2-HIGH": "First Class",
    "3-MEDIUM": "Second Class",
}
SHIP_MODE_DEFAULT = "Standard Class"
CITY_TYPE_BUCKETS = 20          # c_custkey % 20: < 9 Tier 1, < 17 Tier 2, else Village
CITY_TIER1_BELOW = 9
CITY_TIER2_BELOW = 17
DISCOUNT_SCALE = 4              # driver discounts 0-0.10 scaled to 0-0.40
TAX_PROFIT_FACTOR = 5           # profit rate = 5 * tax - 0.02
TAX_PROFIT_OFFSET = "0.02"
ORDER_KEY = "o_orderkey"         # the key of lines and orders
POSTAL_MISSING_MOD = 50         # postal code missing when o_orderkey % 50 = 1
# dirty star: customers with key % 40 = 7 and products with key % 25 = 3 occur twice;
# order keys with remainder 5 by these numbers break one rule each
DIRTY_CUSTOMER, DIRTY_PRODUCT = (40, 7), (25, 3)
DIRTY_ORDERS = dict(customer=97, product=89, discount=83, quantity=79, sales=73, date=71, margin=67, year=61, month=59, quarter=53)
DIRTY_REMAINDER = 5
# ---------------------------------------------------------------------------


def _t(spark_or_tables, sf_dir: str | None = None) -> Tables:
    if isinstance(spark_or_tables, Tables):
        return spark_or_tables
    return Tables(spark_or_tables, sf_dir)


def ship_mode_of(priority: str | Column) -> Column:
    p = F.col(priority) if isinstance(priority, str) else priority
    expr = None
    for key, mode in SHIP_MODE_BY_PRIORITY.items():
        expr = (F.when(p == key, F.lit(mode)) if expr is None else expr.when(p == key, F.lit(mode)))
    return expr.otherwise(F.lit(SHIP_MODE_DEFAULT))


def city_type_of(custkey: Column) -> Column:
    b = custkey % CITY_TYPE_BUCKETS
    return (
        F.when(b < CITY_TIER1_BELOW, F.lit("Tier 1"))
        .when(b < CITY_TIER2_BELOW, F.lit("Tier 2"))
        .otherwise(F.lit("Village"))
    )


def geography(t: Tables) -> DataFrame:
    """nation JOIN region -> (nationkey, state, region); the planner sees the files' sizes."""
    region = t.region.select("r_regionkey", "r_name")
    return t.nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", F.col("n_name").alias("state"), F.col("r_name").alias("region"))


def star_customers(spark_or_tables, sf_dir: str | None = None) -> DataFrame:
    """customers(customer_id bigint, customer_name, last_name, segment, city_type, region, state)."""
    t = _t(spark_or_tables, sf_dir)
    c = t.customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return c.join(geography(t), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("customer_id"),
        F.substring_index("c_name", "#", 1).alias("customer_name"),
        F.substring_index("c_name", "#", -1).alias("last_name"),
        F.col("c_mktsegment").alias("segment"),
        city_type_of(F.col("c_custkey")).alias("city_type"),
        "region",
        "state",
    )


def star_products(spark_or_tables, sf_dir: str | None = None) -> DataFrame:
    """products(product_id bigint, category, sub_category)."""
    t = _t(spark_or_tables, sf_dir)
    return t.part.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("sub_category"),
    )


def _money_columns(sales: Column, discount_raw: Column, tax_raw: Column) -> dict[str, Column]:
    sales = sales.cast("decimal(12,2)")
    discount = (discount_raw.cast("decimal(4,2)") * DISCOUNT_SCALE).cast("decimal(4,2)")
    tax = tax_raw.cast("decimal(4,2)")
    rate = tax * TAX_PROFIT_FACTOR - F.lit(TAX_PROFIT_OFFSET).cast("decimal(4,2)")
    profit = F.round(sales * (F.lit(1) - discount) * rate, 2).cast("decimal(12,2)")
    return {"sales": sales, "discount": discount, "profit": profit}


def _finish_orders(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Date-derived and ratio columns shared by both fact grains."""
    return df.withColumns({
        "profit_margin": profit_margin("profit", "sales"),
        "order_year": F.year("order_date"),
        "order_month": F.month("order_date"),
        "order_quarter": quarter_label("order_date"),
    }).select(*ORDER_COLUMNS, *(extra or []))


def star_orders_line(spark_or_tables, sf_dir: str | None = None, dirty_ship_date: bool = False) -> DataFrame:
    """Line-grain fact (one row per lineitem), the canonical fact for the
    business queries. ``order_id`` = ``orderkey-linenumber`` is deliberately not
    unique (the driver repeats line numbers), which the DQ suite reports.

    ``dirty_ship_date`` takes the ship date from ``l_shipdate`` instead, so
    ship-before-order rows exist for the data-quality checks.
    """
    lines, headers = line_tables(_t(spark_or_tables, sf_dir), dirty_ship_date)
    return line_columns(lines.join(headers, ORDER_KEY), dirty_ship_date=dirty_ship_date)


def headers_of(t: Tables) -> DataFrame:
    """The order's own columns, one row an order."""
    return t.orders.select(F.col("o_orderkey").alias(ORDER_KEY), F.col("o_custkey").alias("customer_id"), "o_orderdate", "o_orderpriority")


def line_tables(t: Tables, dirty_ship_date: bool = False) -> tuple[DataFrame, DataFrame]:
    """The line-grain fact in its two narrow tables, lines and orders, which ``line_columns`` reads once joined."""
    lines = t.lineitem.select(F.col("l_orderkey").alias(ORDER_KEY), F.col("l_partkey").alias("product_id"), "l_linenumber", "l_quantity",
                              "l_extendedprice", "l_discount", "l_tax", *(["l_shipdate"] if dirty_ship_date else []))
    return lines, headers_of(t)


def line_columns(j: DataFrame, extra: list[str] | None = None, dirty_ship_date: bool = False) -> DataFrame:
    """The star's columns of joined lines and orders, and ``extra`` columns behind them."""
    order_date = F.col("o_orderdate").cast("date")
    ship_date = (F.col("l_shipdate").cast("date") if dirty_ship_date
                 else F.date_add(order_date, F.col("l_linenumber")))
    m = _money_columns(F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax"))
    base = j.select(
        F.concat(F.col(ORDER_KEY).cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("order_id"),
        "customer_id",
        "product_id",
        order_date.alias("order_date"),
        ship_date.alias("ship_date"),
        ship_mode_of("o_orderpriority").alias("ship_mode"),
        m["sales"].alias("sales"),
        F.col("l_quantity").cast("int").alias("quantity"),
        m["discount"].alias("discount"),
        m["profit"].alias("profit"),
        F.datediff(ship_date, order_date).alias("delivery_days"),
        ((F.col(ORDER_KEY) % POSTAL_MISSING_MOD) == 1).alias("postal_code_missing"),
        *(extra or []),
    )
    return _finish_orders(base, extra)


def dirty_star(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(customers, products, orders) in which every data-quality check finds something."""
    customers, products = star_customers(t), star_products(t)
    twice = customers.where(F.col("customer_id") % DIRTY_CUSTOMER[0] == DIRTY_CUSTOMER[1])
    customers = customers.unionAll(twice).drop("last_name")
    twice = products.where(F.col("product_id") % DIRTY_PRODUCT[0] == DIRTY_PRODUCT[1])
    products = products.unionAll(twice).drop("sub_category")
    orders = star_orders_line(t, dirty_ship_date=True)
    key = F.substring_index("order_id", "-", 1).cast("bigint")
    changes = {
        "customer": ("customer_id", -F.col("customer_id")),
        "product": ("product_id", -F.col("product_id")),
        "discount": ("discount", F.lit("1.20")),
        "quantity": ("quantity", F.lit(0)),
        "sales": ("sales", F.lit(0)),
        "date": ("order_date", F.lit(None)),
        "margin": ("profit_margin", F.col("profit_margin") + F.lit("0.5").cast("decimal(6,4)")),
        "year": ("order_year", F.col("order_year") + 1),
        "month": ("order_month", F.lit(13)),
        "quarter": ("order_quarter", F.lit("none")),
    }
    new = {}
    for rule, (name, value) in changes.items():
        hit = key % DIRTY_ORDERS[rule] == DIRTY_REMAINDER
        new[name] = F.when(hit, value.cast(orders.schema[name].dataType)).otherwise(F.col(name))
    return customers, products, orders.withColumns(new).drop("postal_code_missing")


def order_grain_lines(t: Tables) -> DataFrame:
    """Lines folded to one row per order key (partial aggregation map-side)."""
    return t.lineitem.groupBy("l_orderkey").agg(
        F.sum(F.col("l_extendedprice").cast("decimal(12,2)")).cast("decimal(12,2)").alias("sales_raw"),
        F.sum(F.col("l_quantity").cast("int")).alias("quantity"),
        F.max(F.col("l_discount").cast("decimal(4,2)")).alias("discount_raw"),
        F.max(F.col("l_tax").cast("decimal(4,2)")).alias("tax_raw"),
        F.min("l_partkey").alias("product_id"),
        F.min("l_linenumber").alias("first_line"),
    )


def star_orders(spark_or_tables, sf_dir: str | None = None, keep_order_key: bool = False) -> DataFrame:
    """Order-grain fact, unique ``order_id`` = ``ORD-`` + 8-digit order key."""
    lines, headers = order_tables(_t(spark_or_tables, sf_dir))
    return order_columns(lines.join(headers, ORDER_KEY), [ORDER_KEY] if keep_order_key else None)


def order_tables(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The order-grain fact in its two narrow tables, folded lines and orders, which ``order_columns`` reads once joined."""
    return order_grain_lines(t).withColumnRenamed("l_orderkey", ORDER_KEY), headers_of(t)


def order_columns(j: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """The star's columns of joined folded lines and orders, and ``extra`` columns behind them."""
    order_date = F.col("o_orderdate").cast("date")
    ship_date = F.date_add(order_date, F.col("first_line"))
    m = _money_columns(F.col("sales_raw"), F.col("discount_raw"), F.col("tax_raw"))
    base = j.select(
        F.format_string("ORD-%08d", F.col(ORDER_KEY)).alias("order_id"),
        "customer_id",
        "product_id",
        order_date.alias("order_date"),
        ship_date.alias("ship_date"),
        ship_mode_of("o_orderpriority").alias("ship_mode"),
        m["sales"].alias("sales"),
        "quantity",
        m["discount"].alias("discount"),
        m["profit"].alias("profit"),
        F.datediff(ship_date, order_date).alias("delivery_days"),
        ((F.col(ORDER_KEY) % POSTAL_MISSING_MOD) == 1).alias("postal_code_missing"),
        *(extra or []),
    )
    return _finish_orders(base, extra)


def register_star(spark: SparkSession, sf_dir: str, grain: str = "line") -> None:
    """Register ``customers``, ``products`` and ``orders`` temp views for SQL use."""
    t = Tables(spark, sf_dir)
    star_customers(t).createOrReplaceTempView("customers")
    star_products(t).createOrReplaceTempView("products")
    fact = star_orders_line(t) if grain == "line" else star_orders(t)
    fact.createOrReplaceTempView("orders")
