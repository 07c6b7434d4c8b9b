"""The cleaning pipeline: flat raw export -> (customers, products, orders).

Order of steps (it changes answers): rename -> drop blank rows -> drop exact
duplicates -> parse both dates -> fill ship mode with its mode (computed after
dedup, before unusable rows are dropped) -> flag missing postal codes -> drop
rows missing a required field -> engineer margin / delivery / period columns
-> split into the star, snake_case names.

Scale notes: "first row per customer" and "first appearance per product pair"
are aggregates (``min_by`` / ``min`` of a (date, id) struct), not windows
partitioned by key, so map-side partial aggregation collapses a hot customer
before the shuffle. Only the product numbering runs a global window, and that
is over the distinct (category, sub-category) pairs, a dimension domain.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.exprs import (
    PRODUCT_ID_FORMAT,
    parse_mixed_date,
    profit_margin,
    quarter_label,
    snake_case,
)
from tallyspark.plans.joins import bounded_broadcast
from tallyspark.plans.materialize import materialize as write_and_read

MAX_PAIRS = 100_000

# --- fixed values: the export's required fields and the star's columns ----------
REQUIRED = ["Order Date", "Ship Date", "Sales", "Profit", "Region"]
CUSTOMER_FIELDS = ["Customer ID", "Customer Name", "Last Name", "Segment", "City Type", "Region", "State"]
ORDER_FIELDS = [
    "Order ID", "Customer ID", "Product ID", "Order Date", "Ship Date", "Ship Mode",
    "Sales", "Quantity", "Discount", "Profit", "Profit Margin", "Delivery Days",
    "Order Year", "Order Month", "Order Quarter", "Postal Code Missing",
]
# --------------------------------------------------------------------------------


def to_snake_case(df: DataFrame) -> DataFrame:
    """Strip / lower / space and '-' to '_' on every header."""
    return df.toDF(*[snake_case(c) for c in df.columns])


def drop_blank_rows(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Drop rows where every column (or every one of ``fields``) is NULL."""
    return df.na.drop(how="all", subset=fields)


def typed(df: DataFrame, strict_first_format: bool = False) -> DataFrame:
    """F1 + casts: dates parsed, money as decimals (bad text -> NULL)."""
    return df.withColumns({
        "Order Date": parse_mixed_date("Order Date", strict_first_format),
        "Ship Date": parse_mixed_date("Ship Date", strict_first_format),
        "Sales": F.col("Sales").try_cast("decimal(12,2)"),
        "Quantity": F.col("Quantity").try_cast("double").try_cast("int"),
        "Discount": F.col("Discount").try_cast("decimal(4,2)"),
        "Profit": F.col("Profit").try_cast("decimal(12,2)"),
    })


def ship_mode_mode(df: DataFrame) -> str | None:
    """Most frequent non-null ship mode, smallest value on a tie. One
    scalar comes back to the driver (a bounded result, like the reference's
    ``mode()[0]``)."""
    row = df.agg(F.mode("Ship Mode", True).alias("m")).first()
    return row["m"] if row else None


@dataclass
class Cleaned:
    customers: DataFrame
    products: DataFrame
    orders: DataFrame
    usable: DataFrame


def prepare(raw: DataFrame, strict_first_format: bool = False, ordinal: str | None = None) -> DataFrame:
    """The raw export without blank and repeated rows, typed. With ``ordinal`` (a column of
    places in the file) the first copy of a row is the one that stays."""
    df = raw.withColumnRenamed("Category of Goods", "Category")
    if ordinal is None:
        return typed(drop_blank_rows(df).dropDuplicates(), strict_first_format)
    names = [c for c in df.columns if c != ordinal]
    df = drop_blank_rows(df, names).groupBy(*[F.col(f"`{c}`") for c in names]).agg(F.min(ordinal).alias(ordinal))
    return typed(df, strict_first_format)


def first_seen(df: DataFrame, first_key: Column, date: str | None) -> DataFrame:
    """Least ``first_key`` of each (category, sub-category). The key is a struct, whose least would need every row sorted;
    with ``date``, its first field, only the rows of a pair's first date are compared."""
    pair = ["Category", "Sub-Category"]
    if date:
        firsts = write_and_read(df.groupBy(*pair).agg(F.min(date).alias("_date")), "clean_dates").withColumnsRenamed({"Category": "_cat", "Sub-Category": "_sub"})
        same = F.col("Category").eqNullSafe(F.col("_cat")) & F.col("Sub-Category").eqNullSafe(F.col("_sub")) & (F.col(date) == F.col("_date"))
        df = df.join(bounded_broadcast(firsts, MAX_PAIRS), same, "left_semi")
    return df.groupBy(*pair).agg(F.min(first_key).alias("first_seen"))


def clean(
    raw: DataFrame,
    strict_first_format: bool = False,
    fill_mode: str | None = None,
    prepared: DataFrame | None = None,
    ordinal: str | None = None,
) -> Cleaned:
    """Run the whole pipeline; returns star tables (snake_case columns).

    First rows (a customer's fields, the numbering of products) are taken by date and order id; with
    ``ordinal``, a column of places in the file (``quarantine.ordinal``), by file order instead.

    The deduplicated, typed export (``prepared``, or written here) is a table in the
    shared checkpoint folder (``spark.checkpoint.dir``): it feeds the mode, the three
    star tables and the surrogate-key lookup, so it is computed once, survives executor
    loss, and downstream plans stay small.
    """
    df = prepared if prepared is not None else write_and_read(prepare(raw, strict_first_format, ordinal), "clean_typed")
    mode = fill_mode if fill_mode is not None else ship_mode_mode(df)
    df = df.withColumns({
        "Ship Mode": F.coalesce(F.col("Ship Mode"), F.lit(mode)),
        "Postal Code Missing": F.col("Postal Code").isNull(),
    })
    df = df.na.drop(how="any", subset=REQUIRED)
    df = df.withColumns({
        "Profit Margin": profit_margin("Profit", "Sales"),
        "Delivery Days": F.datediff("Ship Date", "Order Date"),
        "Order Year": F.year("Order Date"),
        "Order Month": F.month("Order Date"),
        "Order Quarter": quarter_label("Order Date"),
    })
    first_key = F.col(ordinal) if ordinal else F.struct("Order Date", "Order ID", *[c for c in df.columns if c not in ("Order Date", "Order ID")])

    customers = df.groupBy("Customer ID").agg(
        F.min_by(F.struct(*CUSTOMER_FIELDS[1:]), first_key).alias("c")
    ).select("Customer ID", "c.*")

    pairs = first_seen(df, first_key, None if ordinal else "Order Date")
    numbering = Window.orderBy("first_seen", "Category", "Sub-Category")
    products = pairs.select(
        F.format_string(PRODUCT_ID_FORMAT, F.row_number().over(numbering)).alias("Product ID"),
        "Category", "Sub-Category",
    )

    # A few pairs hold all rows, so the pairs are written and, if their count proves
    # small, broadcast: the fact is not dealt by pair.
    products = write_and_read(products, "clean_products")
    lookup = bounded_broadcast(products, MAX_PAIRS).withColumnsRenamed({"Category": "_cat", "Sub-Category": "_sub"})
    orders = (
        df.drop("Product ID", "Product Name")
        .join(lookup, F.col("Category").eqNullSafe(F.col("_cat"))
              & F.col("Sub-Category").eqNullSafe(F.col("_sub")), "left")
        .select(*ORDER_FIELDS)
    )
    return Cleaned(
        customers=to_snake_case(customers),
        products=to_snake_case(products),
        orders=to_snake_case(orders),
        usable=df,
    )


def _usable(strict_first_format: bool) -> F.Column:
    """Required fields present after typing (the row survives the P8 drop)."""
    return (
        parse_mixed_date("Order Date", strict_first_format).isNotNull()
        & parse_mixed_date("Ship Date", strict_first_format).isNotNull()
        & F.col("Sales").try_cast("decimal(12,2)").isNotNull()
        & F.col("Profit").try_cast("decimal(12,2)").isNotNull()
        & F.col("Region").isNotNull()
    )


def drop_counts(raw: DataFrame) -> DataFrame:
    """Row counts at each cleaning stage, in one pass.

    Rows are grouped by their full content once (the same shuffle the dedup
    needs; partial aggregation collapses repeated rows map-side). Each distinct
    row carries its copy count, so raw, non-blank, distinct and usable counts
    all come from one aggregate over the groups.
    """
    cols = raw.columns
    blank = F.lit(True)
    for c in cols:
        blank = blank & F.col(f"`{c}`").isNull()
    groups = raw.groupBy(*[F.col(f"`{c}`") for c in cols]).agg(F.count(F.lit(1)).alias("_copies"))
    kept = ~blank
    return groups.agg(
        F.sum("_copies").cast("bigint").alias("raw_rows"),
        F.sum(F.when(kept, F.col("_copies"))).cast("bigint").alias("non_blank_rows"),
        F.count_if(kept).cast("bigint").alias("distinct_rows"),
        F.count_if(kept & _usable(False)).cast("bigint").alias("usable_rows"),
        F.count_if(kept & _usable(True)).cast("bigint").alias("usable_rows_strict"),
        F.count_if(kept & ~_usable(False)).cast("bigint").alias("dropped_unusable"),
    ).withColumn("dropped_ratio", F.round(F.col("dropped_unusable") / F.col("distinct_rows"), 4))
