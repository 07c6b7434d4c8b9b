"""Published findings that the reference states as numbers without code (N1-N6),
plus the orders-per-customer profile (A23) they rest on.

All windows here run over already-aggregated rows (a handful of tiers or
modes), never over the fact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.exprs import TIER_ZERO_LABEL_SQL, discount_tier, exact_avg, money


def _tier_totals(orders: DataFrame) -> DataFrame:
    return orders.groupBy(discount_tier("discount", TIER_ZERO_LABEL_SQL).alias("discount_bucket")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("profit").alias("p"),
        exact_avg("profit_margin").alias("m"),
        F.min("discount").alias("min_discount"),
    )


def n1_tier_share(orders: DataFrame) -> DataFrame:
    """Each tier's share of orders and of total profit."""
    t = _tier_totals(orders)
    everything = Window.partitionBy()
    return t.select(
        "discount_bucket",
        F.col("n").cast("bigint").alias("num_orders"),
        F.round(F.col("n").cast("double") / F.sum("n").over(everything), 4).alias("share_of_orders"),
        money("p").alias("total_profit"),
        F.round(F.col("p").cast("double") / F.sum("p").over(everything).cast("double"), 4).alias("share_of_profit"),
        F.round("m", 4).alias("avg_profit_margin"),
    ).orderBy("discount_bucket")


def n2_margin_band(orders: DataFrame, customers: DataFrame, products: DataFrame) -> DataFrame:
    """Spread (max - min) of group mean margins by region, city tier and category.

    One pass over the fact: each row counts for its customer and for its product, and
    margins are summed by (kind, id) with map-side partial sums. Only these rows meet the
    dimensions, stacked the same way with the groups that each member belongs to.
    """
    types = {f.schema[c].dataType for f, c in ((orders, "customer_id"), (orders, "product_id"), (customers, "customer_id"), (products, "product_id"))}
    id_type = types.pop() if len(types) == 1 else "string"

    def member(kind: str, key: str):
        return F.struct(F.lit(kind).alias("kind"), F.col(key).cast(id_type).alias("id"))

    def group(dimension: str):
        return F.struct(F.lit(dimension).alias("dimension"), F.col(dimension).cast("string").alias("grp"))

    stacked = orders.select(F.inline(F.array(member("customer", "customer_id"), member("product", "product_id"))), "profit_margin")
    sums = stacked.groupBy("kind", "id").agg(F.sum("profit_margin").alias("sm"), F.count("profit_margin").alias("nm"))
    members = customers.select(member("customer", "customer_id").alias("m"), F.array(group("region"), group("city_type")).alias("groups"))
    members = members.unionAll(products.select(member("product", "product_id").alias("m"), F.array(group("category")).alias("groups")))
    joined = sums.join(members.select("m.*", "groups"), ["kind", "id"])
    groups = joined.select("sm", "nm", F.inline("groups")).groupBy("dimension", "grp").agg(
        (F.sum("sm").cast("double") / F.sum("nm")).alias("avg_m"))
    return groups.groupBy("dimension").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_groups"),
        F.round(F.min("avg_m"), 4).alias("min_avg_margin"),
        F.round(F.max("avg_m"), 4).alias("max_avg_margin"),
        F.round(F.max("avg_m") - F.min("avg_m"), 4).alias("margin_band"),
    ).orderBy("dimension")


def orders_per_customer(orders: DataFrame) -> DataFrame:
    """Number of orders per customer."""
    return orders.groupBy("customer_id").agg(F.count("order_id").cast("bigint").alias("num_orders"))


def n3_repeat_profile(orders: DataFrame) -> DataFrame:
    """Distribution of orders per customer, with each bucket's customer share."""
    per = orders_per_customer(orders)
    dist = per.groupBy("num_orders").agg(F.count(F.lit(1)).alias("c"))
    everything = Window.partitionBy()
    return dist.select(
        F.col("num_orders").alias("orders_per_customer"),
        F.col("c").cast("bigint").alias("num_customers"),
        F.round(F.col("c").cast("double") / F.sum("c").over(everything), 4).alias("share_of_customers"),
        (F.col("num_orders") > 1).alias("repeat_buyer"),
    ).orderBy("orders_per_customer")


def n4_repeat_whatif(orders: DataFrame, reorder_rate: float = 0.10) -> DataFrame:
    """If ``reorder_rate`` of customers reorder once, extra orders x average
    order value x average margin gives the extra profit."""
    g = orders.agg(
        F.count_distinct("customer_id").alias("customers"),
        F.count(F.lit(1)).alias("orders"),
        exact_avg("sales").alias("aov"),
        exact_avg("profit_margin").alias("m"),
    )
    extra_orders = F.col("customers").cast("double") * F.lit(reorder_rate)
    return g.select(
        F.col("customers").cast("bigint").alias("customers"),
        F.col("orders").cast("bigint").alias("orders"),
        F.round("aov", 2).alias("avg_order_value"),
        F.round("m", 4).alias("avg_margin"),
        F.lit(reorder_rate).alias("reorder_rate"),
        F.round(extra_orders, 2).alias("extra_orders"),
        F.round(extra_orders * F.col("aov") * F.col("m"), 2).alias("extra_profit"),
    )


def n5_shipmode_anomaly(orders: DataFrame) -> DataFrame:
    """Each ship mode's mean delivery days against the mean over all other
    modes' orders; flags a faster-labelled mode that is not faster."""
    g = orders.groupBy("ship_mode").agg(
        F.sum("delivery_days").alias("d"), F.count("delivery_days").alias("n"))
    everything = Window.partitionBy()
    others = (F.sum("d").over(everything) - F.col("d")).cast("double") / (F.sum("n").over(everything) - F.col("n"))
    mine = F.col("d").cast("double") / F.col("n")
    return g.select(
        "ship_mode",
        F.round(mine, 4).alias("avg_delivery_days"),
        F.round(others, 4).alias("others_avg_delivery_days"),
        (mine >= others).alias("not_faster_than_others"),
    ).orderBy("ship_mode")


def n6_weak_tier(orders: DataFrame) -> DataFrame:
    """The discount tier with the least and the most total profit (ties by label)."""
    t = _tier_totals(orders)
    return t.agg(
        F.min_by("discount_bucket", F.struct("p", "discount_bucket")).alias("weakest_tier"),
        F.min("p").alias("wp"),
        F.max_by("discount_bucket", F.struct("p", F.col("discount_bucket"))).alias("strongest_tier"),
        F.max("p").alias("sp"),
    ).select(
        "weakest_tier",
        money("wp").alias("weakest_total_profit"),
        "strongest_tier",
        money("sp").alias("strongest_total_profit"),
    )
