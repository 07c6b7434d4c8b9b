"""Columns of the star tables, in one place."""

# --- fixed values ---------------------------------------------------------------
CUSTOMER_COLUMNS = ["customer_id", "customer_name", "last_name", "segment", "city_type", "region", "state"]
PRODUCT_COLUMNS = ["product_id", "category", "sub_category"]
ORDER_TYPES = {
    "order_id": "string", "customer_id": "string", "product_id": "string", "order_date": "date", "ship_date": "date",
    "ship_mode": "string", "sales": "decimal(12,2)", "quantity": "int", "discount": "decimal(4,2)", "profit": "decimal(12,2)",
    "profit_margin": "decimal(6,4)", "delivery_days": "int", "order_year": "int", "order_month": "int",
    "order_quarter": "string", "postal_code_missing": "boolean",
}
# --------------------------------------------------------------------------------
ORDER_COLUMNS = list(ORDER_TYPES)
