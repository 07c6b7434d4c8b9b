"""Shared Column builders.

Everything here is a plain ``pyspark.sql.functions`` expression, so it stays
inside whole-stage codegen; no Python UDFs anywhere in the library.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the reference's labels and thresholds) ---------
# Discount tiers: 0 / up to 0.10 / up to 0.20 / up to 0.30 / above.
TIER_ZERO_LABEL = "0%"
TIER_ZERO_LABEL_SQL = "0% (no discount)"
TIER_LABELS = ["0%", "1-10%", "11-20%", "21-30%", "30%+"]
TIER_BOUNDS = [0.10, 0.20, 0.30]
# Segment labels for k-means clusters, in rule order.
SEG_DEEP_DISCOUNT = "Deep-Discount, Thin-Margin"
SEG_FULL_PRICE = "Full-Price, High-Margin"
SEG_PREMIUM = "Premium Basket"
SEG_SMALL = "Small Basket, Low Engagement"
SEG_MIXED = "Mixed / Moderate"
# Surrogate product key format.
PRODUCT_ID_FORMAT = "PROD-%04d"
# ---------------------------------------------------------------------------


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def discount_tier(discount: str | Column, zero_label: str = TIER_ZERO_LABEL) -> Column:
    """Bucket a 0-1 discount fraction. NULL falls through to ``30%+``."""
    d = col(discount)
    return (
        F.when(d == 0, F.lit(zero_label))
        .when(d <= TIER_BOUNDS[0], F.lit(TIER_LABELS[1]))
        .when(d <= TIER_BOUNDS[1], F.lit(TIER_LABELS[2]))
        .when(d <= TIER_BOUNDS[2], F.lit(TIER_LABELS[3]))
        .otherwise(F.lit(TIER_LABELS[4]))
    )


def tier_rank(tier: str | Column) -> Column:
    """1-based position of a tier label in the fixed tier order (0 if unknown)."""
    return F.array_position(F.array(*[F.lit(t) for t in TIER_LABELS]), col(tier))


def profit_margin(profit: str | Column, sales: str | Column) -> Column:
    """round(profit / sales, 4) as decimal(6,4); x/0 gives NULL, not an error."""
    ratio = F.try_divide(col(profit).cast("double"), col(sales).cast("double"))
    return F.round(ratio, 4).cast("decimal(6,4)")


def quarter_label(d: str | Column) -> Column:
    """Calendar quarter label such as ``2019Q2``."""
    d = col(d)
    return F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))


def parse_mixed_date(s: str | Column, strict_first_format: bool = False) -> Column:
    """Day-first ``d-M-yyyy`` or ``yyyy/M/d`` text to date; bad text gives NULL.

    With ``strict_first_format`` only the dominant ``d-M-yyyy`` form parses,
    which reproduces the behaviour of inferring one format from the data.
    """
    s = col(s)
    day_first = F.try_to_date(s, "d-M-yyyy")
    if strict_first_format:
        return day_first
    return F.coalesce(day_first, F.try_to_date(s, "yyyy/M/d"))


def full_name(first: str | Column, last: str | Column) -> Column:
    """``first || ' ' || last``; NULL if either part is NULL."""
    return F.concat(col(first), F.lit(" "), col(last))


def exact_avg(c: str | Column) -> Column:
    """Mean as double from an exact decimal sum: independent of row order."""
    return F.sum(col(c)).cast("double") / F.count(col(c))


def money(c: str | Column, scale: int = 0) -> Column:
    """Round a decimal money value; scale 0 becomes a bigint."""
    r = F.round(col(c), scale)
    return r.cast("bigint") if scale == 0 else r.cast("double")


def fails_unless(ok: Column) -> Column:
    """Violation flag where a NULL outcome counts as a failure."""
    return ~F.coalesce(ok, F.lit(False))


def fails_if(bad: Column) -> Column:
    """Violation flag where a NULL outcome counts as a pass."""
    return F.coalesce(bad, F.lit(False))


def snake_case(name: str) -> str:
    """Header normalisation: strip, lower-case, space and '-' to '_'."""
    return name.strip().lower().replace(" ", "_").replace("-", "_")
