"""DuckDB SQL for the queries on bucketed, refreshed, sketched and quarantined tables."""

from __future__ import annotations

from tallyspark.oracle import _APP, _KPI_SELECT, _SLICER_WHERE, with_star

_STATUS = "SELECT CASE WHEN orders = 0 THEN 'no rows' ELSE 'ok' END AS status, orders, coalesce(total_sales, 0) AS total_sales, coalesce(total_profit, 0) AS total_profit, avg_margin FROM ({kpi})"


def _sketch(by: str) -> str:
    return with_star("", f"""
SELECT {by}, COUNT(DISTINCT customer_id) AS customers, true AS sketch_within_bound, COUNT(*) AS orders,
       CAST(round(SUM(sales), 2) AS DOUBLE) AS total_sales, CAST(round(SUM(profit), 2) AS DOUBLE) AS total_profit
FROM s_orders GROUP BY {by}""")


SQL: dict[str, str] = {
    "kpi_status_filtered": with_star(_APP, _STATUS.format(kpi=_KPI_SELECT + _SLICER_WHERE)),
    "kpi_status_empty": with_star(_APP, _STATUS.format(kpi=_KPI_SELECT + " WHERE order_year = 1900 AND region = 'ASIA'")),
    "customers_by_year_sketch": _sketch("order_year"),
    "customers_by_ship_mode_sketch": _sketch("ship_mode"),
    "customer_ledger": with_star("", """
SELECT c.customer_id, region, segment, (SELECT COUNT(*) FROM s_orders o WHERE o.customer_id = c.customer_id) AS orders,
       CAST(round(total_sales, 2) AS DOUBLE) AS total_sales, CAST(round(total_profit, 2) AS DOUBLE) AS total_profit, first_order, last_order
FROM s_customers c LEFT JOIN (SELECT customer_id, SUM(sales) AS total_sales, SUM(profit) AS total_profit, MIN(order_date) AS first_order, MAX(order_date) AS last_order
                              FROM s_orders GROUP BY customer_id) USING (customer_id)"""),
    "refreshed_extract_by_year": with_star("", """
SELECT order_year, COUNT(*) AS orders, CAST(round(SUM(sales), 2) AS DOUBLE) AS total_sales
FROM s_orders JOIN s_customers USING (customer_id) JOIN s_products USING (product_id) GROUP BY order_year"""),
    "csv_quarantine": with_star("""
lines AS (SELECT *, k % 97 = 3 OR k % 83 = 5 OR k % 89 = 4 AS bad FROM (SELECT *, CAST(regexp_extract(order_id, '([0-9]+)$', 1) AS BIGINT) AS k FROM s_orders_og))""", """
SELECT COUNT(*) AS lines, COUNT(*) FILTER (WHERE NOT bad) AS good, COUNT(*) FILTER (WHERE bad) AS bad, CAST(round(SUM(sales) FILTER (WHERE NOT bad), 2) AS DOUBLE) AS total_sales,
       CAST(SUM(quantity) FILTER (WHERE NOT bad) AS BIGINT) AS total_quantity, MAX(order_date) FILTER (WHERE NOT bad) AS last_date
FROM lines"""),
}
