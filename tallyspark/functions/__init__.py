from tallyspark.functions.exprs import (  # noqa: F401
    TIER_LABELS,
    TIER_ZERO_LABEL,
    TIER_ZERO_LABEL_SQL,
    discount_tier,
    exact_avg,
    fails_if,
    fails_unless,
    full_name,
    money,
    parse_mixed_date,
    profit_margin,
    quarter_label,
    snake_case,
    tier_rank,
)
