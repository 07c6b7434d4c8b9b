"""``raw_export``: the flat, dirty, all-string store export the cleaning
pipeline starts from, derived from the driver tables.

It is the order-grain star denormalised to the reference's 18 Title Case
columns, with the export's dirt injected by rules on the order key: a second
date format, unparseable dates, missing ship modes / regions / postal codes,
exact duplicate rows and blank rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.sources.star import ORDER_KEY, Tables, order_columns, order_tables, star_customers, star_products

# --- fixed values: dirt-injection rules on o_orderkey, and the export's columns
BAD_DATE_MOD, BAD_DATE_REM = 700, 5      # 'n/a' order date (checked first)
ALT_FORMAT_MOD = 33                      # yyyy/MM/dd order date when key % 33 = 0
NULL_SHIP_MOD, NULL_SHIP_REM = 100, 7    # ship mode missing
NULL_REGION_MOD, NULL_REGION_REM = 500, 3
NULL_POSTAL_MOD, NULL_POSTAL_REM = 50, 1
DUPLICATE_MOD = 250                      # rows exported twice when key % 250 = 0
BLANK_ROWS = 5                           # fully empty trailing rows
POSTAL_BASE, POSTAL_SPAN = 100000, 800000
RAW_COLUMNS = [
    "Order ID", "Order Date", "Ship Date", "Ship Mode", "Customer ID", "Customer Name",
    "Last Name", "Segment", "City Type", "Region", "State", "Postal Code", "Category",
    "Sub-Category", "Sales", "Quantity", "Discount", "Profit",
]
# ---------------------------------------------------------------------------


def _null_when(cond, value):
    return F.when(cond, F.lit(None).cast("string")).otherwise(value)


def raw_export(tables: Tables) -> DataFrame:
    # dimensions join the narrow tables; the fact's columns are derived last, so no wide row crosses these exchanges
    lines, headers = order_tables(tables)
    c, p = star_customers(tables), star_products(tables)
    own = [x for x in (*c.columns, *p.columns) if x not in ("customer_id", "product_id")]
    j = order_columns(lines.join(headers.join(c, "customer_id"), ORDER_KEY).join(p, "product_id"), [ORDER_KEY, *own])
    k = F.col(ORDER_KEY)
    order_text = (
        F.when(k % BAD_DATE_MOD == BAD_DATE_REM, F.lit("n/a"))
        .when(k % ALT_FORMAT_MOD == 0, F.date_format("order_date", "yyyy/MM/dd"))
        .otherwise(F.date_format("order_date", "dd-MM-yyyy"))
    )
    rows = j.select(
        F.col("order_id").alias("Order ID"),
        order_text.alias("Order Date"),
        F.date_format("ship_date", "dd-MM-yyyy").alias("Ship Date"),
        _null_when(k % NULL_SHIP_MOD == NULL_SHIP_REM, F.col("ship_mode")).alias("Ship Mode"),
        F.col("customer_id").cast("string").alias("Customer ID"),
        F.col("customer_name").alias("Customer Name"),
        F.col("last_name").alias("Last Name"),
        F.col("segment").alias("Segment"),
        F.col("city_type").alias("City Type"),
        _null_when(k % NULL_REGION_MOD == NULL_REGION_REM, F.col("region")).alias("Region"),
        F.col("state").alias("State"),
        _null_when(k % NULL_POSTAL_MOD == NULL_POSTAL_REM,
                   (F.lit(POSTAL_BASE) + k % POSTAL_SPAN).cast("string")).alias("Postal Code"),
        F.col("category").alias("Category"),
        F.col("sub_category").alias("Sub-Category"),
        F.col("sales").cast("string").alias("Sales"),
        F.col("quantity").cast("string").alias("Quantity"),
        F.col("discount").cast("string").alias("Discount"),
        F.col("profit").cast("string").alias("Profit"),
        # exported twice when the key rule says so: one pass, no re-computation
        F.explode(F.when(k % DUPLICATE_MOD == 0, F.array(F.lit(1), F.lit(2)))
                  .otherwise(F.array(F.lit(1)))).alias("_copy"),
    )
    blank = rows.sparkSession.range(BLANK_ROWS).select(
        *[F.lit(None).cast("string").alias(c) for c in RAW_COLUMNS])
    return rows.drop("_copy").unionByName(blank)
