"""Data-quality checks D1-D16 (+ order_month / order_quarter) as one DataFrame
of ``(check, violations, passed)`` rows.

* Schema checks compare column sets on the driver (metadata only).
* Row checks are one aggregate without a key; the key checks are one narrow aggregate
  over the fact's and the dimensions' key values (see ``key_violations``).
* The NULL behaviour of each check follows the reference (a NULL fails a
  range check but passes an ordering / ratio check).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.exprs import fails_if, fails_unless, quarter_label
from tallyspark.sources.schema import CUSTOMER_COLUMNS, ORDER_COLUMNS, PRODUCT_COLUMNS

CORE_FIELDS = ["order_id", "customer_id", "product_id", "sales", "profit", "order_date"]


def row_checks(orders: DataFrame) -> dict[str, Column]:
    """Violation flags evaluated per fact row (D9-D16 and the two added checks)."""
    recomputed = F.round(F.try_divide(F.col("profit").cast("double"), F.col("sales").cast("double")), 4)
    core_nulls = sum((F.col(c).isNull().cast("int") for c in CORE_FIELDS), F.lit(0))
    return {
        "discount_in_valid_range": fails_unless(F.col("discount").between(0, 1)),
        "quantity_positive": fails_unless(F.col("quantity") > 0),
        "sales_positive": fails_unless(F.col("sales") > 0),
        "no_null_core_fields": core_nulls,
        "ship_date_not_before_order_date": fails_if(F.col("ship_date") < F.col("order_date")),
        "profit_margin_matches_profit_over_sales": fails_if(
            F.abs(recomputed - F.col("profit_margin").cast("double")) > 0.001),
        "order_year_matches_order_date": fails_unless(F.col("order_year") == F.year("order_date")),
        "delivery_days_non_negative": fails_unless(F.col("delivery_days") >= 0),
        "order_month_matches_order_date": fails_unless(F.col("order_month") == F.month("order_date")),
        "order_quarter_matches_order_date": fails_unless(F.col("order_quarter") == quarter_label("order_date")),
    }


def orphan_keys(fact: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Distinct fact keys with no match in the dimension. A NULL key is
    an orphan unless the dimension also holds a NULL key (set semantics)."""
    fk = fact.select(F.col(key).alias("k")).distinct()
    dk = dim.select(F.col(key).alias("d")).distinct()
    return fk.join(dk, fk["k"].eqNullSafe(dk["d"]), "left_anti").select(F.col("k").alias(key))


def _schema_checks(customers: DataFrame, products: DataFrame, orders: DataFrame) -> DataFrame:
    rows = []
    for name, df, required in (("customers_schema", customers, CUSTOMER_COLUMNS),
                               ("products_schema", products, PRODUCT_COLUMNS),
                               ("orders_schema", orders, ORDER_COLUMNS)):
        missing = len(set(required) - set(df.columns))
        rows.append((name, missing))
    return orders.sparkSession.createDataFrame(rows, "check string, violations bigint")


def row_violations(orders: DataFrame) -> DataFrame:
    """(check, violations) of the row checks: one aggregate without a key, so nothing but its few sums is shuffled."""
    checks = row_checks(orders)
    flags = [F.coalesce(F.sum(x if n == "no_null_core_fields" else x.cast("int")), F.lit(0)).cast("bigint").alias(n) for n, x in checks.items()]
    return orders.agg(*flags).unpivot([], list(checks), "check", "violations")


#: Each fact key's checks: name of its uniqueness check, and of its foreign-key check if it has a dimension.
KEY_CHECKS = {
    "customer_id": ("customer_id_unique", "orders_customer_fk"),
    "product_id": ("product_id_unique", "orders_product_fk"),
    "order_id": ("order_id_unique", None),
}


def key_violations(fact: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """(check, violations) of every key: repeated values in its own table, and fact keys its dimension lacks.

    One pass over the fact's key columns alone: (field, value) pairs of the fact and of the
    dimensions are stacked with their source and counted. Partial sums come first, so a
    hot key is one row a task; a NULL is one value on both sides.
    """

    def pairs(df: DataFrame, names: list[str], f: int, d: int) -> DataFrame:
        each = F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias("k")) for n in names])
        return df.select(F.inline(each)).select("field", "k", F.lit(f).alias("f"), F.lit(d).alias("d"))

    names = [n for n in KEY_CHECKS if n in fact.columns]
    rows = pairs(fact, names, 1, 0)
    for n, dim in dims.items():
        rows = rows.unionAll(pairs(dim, [n], 0, 1))
    g = rows.groupBy("field", "k").agg(F.sum("f").alias("f"), F.sum("d").alias("d"))
    found = {}
    for n in names:
        unique, orphan = KEY_CHECKS[n]
        mine = F.col("field") == n
        found[unique] = F.count_if(mine & (F.col("d" if n in dims else "f") > 1))
        if orphan and n in dims:
            found[orphan] = F.count_if(mine & (F.col("f") > 0) & (F.col("d") == 0))
    return g.agg(*[x.cast("bigint").alias(n) for n, x in found.items()]).unpivot([], list(found), "check", "violations")


def run_checks(customers: DataFrame, products: DataFrame, orders: DataFrame) -> DataFrame:
    """All checks as ``(check, violations, passed)``: schema checks from metadata, row
    checks from one aggregate, key checks from one narrow aggregate."""
    out = _schema_checks(customers, products, orders).unionByName(row_violations(orders))
    out = out.unionByName(key_violations(orders, {"customer_id": customers, "product_id": products}))
    return out.withColumn("passed", F.col("violations") == 0).orderBy("check")
