"""DuckDB SQL for the k-means queries: farthest-first starts, assignment and means as recursive queries;
and for the linear regression: Gauss-Jordan elimination of the normal equations over standardised columns."""

from __future__ import annotations

from tallyspark.oracle import _FEATS, _REG, RFM, STAR

NUMERIC = ("sales", "quantity", "discount", "profit_margin", "delivery_days")


def _z(c: str, source: str) -> str:
    x = f"CAST({c} AS DOUBLE)"
    return (f"CASE WHEN (SELECT stddev_pop({x}) FROM {source}) > 0 THEN ({x} - (SELECT avg({x}) FROM {source})) / (SELECT stddev_pop({x}) FROM {source}) ELSE 0.0 END")


def _kmeans(size: int) -> str:
    """CTEs from ``pts`` (id, key, x DOUBLE[size]) to the sweep and the best models' assignments."""
    means = ", ".join(f"avg(x[{i}])" for i in range(1, size + 1))
    total = ", ".join(f"sum(x[{i}])" for i in range(1, size + 1))
    d2 = "pow(array_distance({a}, {b}), 2)"
    return f"""
ff AS (
  SELECT r, 1 AS n, [arg_min(x, {{'h': md5(r::VARCHAR || ':' || key), 'key': key}})] AS cs FROM pts, range(10) AS t(r) GROUP BY r
  UNION ALL
  SELECT r, n + 1, list_append(any_value(cs), arg_min(x, {{'d': -round(pow(list_min(list_transform(cs, lambda c: array_distance(x, c))), 2), 9), 'key': key}}))
  FROM ff, pts WHERE n < 8 GROUP BY r, n),
lloyd AS (
  SELECT k, r, 0 AS it, c, cs[c] AS y, true AS live FROM ff, range(2, 9) AS t(k), range(1, k + 1) AS u(c) WHERE n = 8
  UNION ALL
  SELECT k, r, it + 1, c, new, bool_or(array_distance(new, y) > 1e-9) OVER (PARTITION BY k, r)
  FROM (SELECT l.k, l.r, l.it, l.c, l.y, coalesce(m.y, l.y) AS new
        FROM lloyd l LEFT JOIN (
          SELECT k, r, c, [{means}]::DOUBLE[{size}] AS y
          FROM (SELECT k, r, x, list_position(ds, list_min(ds)) AS c
                FROM (SELECT k, r, x, list_transform(ys, lambda y: round(pow(array_distance(x, y), 2), 9)) AS ds
                      FROM pts, (SELECT k, r, list(y ORDER BY c) AS ys FROM lloyd WHERE live GROUP BY k, r))) GROUP BY k, r, c) m ON m.k = l.k AND m.r = l.r AND m.c = l.c
        WHERE l.live AND l.it < 50)),
final AS MATERIALIZED (SELECT k, r, c, arg_max(y, it) AS y FROM lloyd GROUP BY k, r, c),
models AS MATERIALIZED (SELECT k, r, list(y ORDER BY c) AS ys FROM final GROUP BY k, r),
cost AS MATERIALIZED (SELECT k, r, round(sum(pow(list_min(list_transform(ys, lambda y: array_distance(x, y))), 2)), 4) AS inertia FROM models, pts GROUP BY k, r),
best AS MATERIALIZED (SELECT k, arg_min(r, {{'i': inertia, 'r': r}}) AS r, min(inertia) AS inertia FROM cost GROUP BY k),
near AS MATERIALIZED (
  SELECT k, p.id, any_value(p.x) AS x, arg_min(c, round({d2.format(a='p.x', b='y')}, 9) + c * 1e-11) AS c
  FROM final JOIN best USING (k, r), pts p GROUP BY k, p.id),
stats AS MATERIALIZED (SELECT k, c, count(*) AS n, sum(array_inner_product(x, x)) AS s2, [{total}]::DOUBLE[{size}] AS s FROM near GROUP BY k, c),
sil AS MATERIALIZED (
  SELECT k, round(avg(CASE WHEN n > 1 AND other IS NOT NULL AND greatest(own, other) > 0 THEN (other - own) / greatest(own, other) ELSE 0 END), 6) AS silhouette
  FROM (SELECT near.k, near.id, any_value(stats.n) FILTER (WHERE stats.c = near.c) AS n,
               min(CASE WHEN stats.c = near.c THEN (array_inner_product(x, x) + s2 / n - 2 * array_inner_product(x, s) / n) * n / greatest(n - 1, 1) END) AS own,
               min(CASE WHEN stats.c <> near.c THEN array_inner_product(x, x) + s2 / n - 2 * array_inner_product(x, s) / n END) AS other
        FROM near JOIN stats ON near.k = stats.k GROUP BY near.k, near.id) GROUP BY k),
chosen AS MATERIALIZED (SELECT arg_max(k, {{'s': silhouette, 'k': -k}}) AS k FROM sil)"""


_LEVELS = [f"list_transform((SELECT list(DISTINCT {c} ORDER BY {c}) FROM feats), lambda l: ({c} = l)::INT::DOUBLE)" for c in ("category", "ship_mode")]
_ORDER_POINTS = f"""
pts AS MATERIALIZED (
  SELECT order_id AS id, order_id AS key,
         list_resize([{', '.join(_z(c, 'feats') for c in NUMERIC)}] || {_LEVELS[0]} || {_LEVELS[1]}, 16, 0.0)::DOUBLE[16] AS x
  FROM feats)"""
_ORDERS = f"WITH RECURSIVE {STAR},{_FEATS},{_ORDER_POINTS},{_kmeans(16)}"
_SEGMENTS = f"""{_ORDERS},
seg AS (SELECT feats.*, (near.c - 1)::INT AS segment_id FROM feats JOIN near ON near.id = feats.order_id JOIN chosen ON chosen.k = near.k),
shape AS (
  SELECT segment_id, avg(discount::DOUBLE) > (SELECT avg(discount::DOUBLE) FROM seg) AS deep,
         avg(profit_margin::DOUBLE) > (SELECT avg(profit_margin::DOUBLE) FROM seg) AS rich,
         avg(sales::DOUBLE) > (SELECT avg(sales::DOUBLE) FROM seg) AS big FROM seg GROUP BY segment_id),
named AS (
  SELECT seg.*, CASE WHEN deep AND NOT rich THEN 'Deep-Discount, Thin-Margin' WHEN rich AND NOT deep THEN 'Full-Price, High-Margin'
                     WHEN big AND rich THEN 'Premium Basket' WHEN NOT big THEN 'Small Basket, Low Engagement' ELSE 'Mixed / Moderate' END AS segment_label
  FROM seg JOIN shape USING (segment_id))
"""
_RFM_SEGMENTS = f"""WITH RECURSIVE base AS ({RFM}),
pts AS MATERIALIZED (SELECT customer_id AS id, customer_id::VARCHAR AS key, [{', '.join(_z(c, 'base') for c in ('recency', 'frequency', 'monetary'))}]::DOUBLE[3] AS x FROM base),{_kmeans(3)}
SELECT customer_id, recency, frequency, monetary, (near.c - 1)::INT AS segment_id FROM base JOIN near ON near.id = customer_id JOIN chosen ON chosen.k = near.k"""

SQL: dict[str, str] = {
    "kmeans_sweep": f"{_ORDERS}\nSELECT k::INT AS k, inertia, silhouette, k = (SELECT k FROM chosen) AS selected FROM best JOIN sil USING (k)",
    "order_segments": f"{_SEGMENTS} SELECT * FROM named",
    "segment_summary": f"""{_SEGMENTS} SELECT segment_label, count(order_id)::BIGINT AS orders, round(avg(sales::DOUBLE), 3) AS avg_sales, round(avg(discount::DOUBLE), 3) AS avg_discount,
       round(avg(profit_margin::DOUBLE), 3) AS avg_margin, round(sum(profit)::DOUBLE, 3) AS total_profit FROM named GROUP BY segment_label""",
    "cluster_profile": f"""{_SEGMENTS} SELECT segment_id, round(avg(discount::DOUBLE), 6) AS avg_discount, round(avg(profit_margin::DOUBLE), 6) AS avg_profit_margin,
       round(avg(sales::DOUBLE), 6) AS avg_sales, round(avg(quantity::DOUBLE), 6) AS avg_quantity, count(*)::BIGINT AS orders FROM named GROUP BY segment_id""",
    "segment_summary_short": f"""{_SEGMENTS} SELECT segment_label, count(order_id)::BIGINT AS orders, round(avg(profit_margin::DOUBLE), 6) AS avg_margin FROM named GROUP BY segment_label""",
    "rfm_segments": _RFM_SEGMENTS,
}

# columns: constant, standardised numeric ones, all levels but the first of category and ship mode, and the label last
_X = ("sales", "quantity", "discount", "delivery_days")
_LINEAR = f"""WITH RECURSIVE {STAR},{_REG},
tr AS (SELECT * FROM reg WHERE bucket < 8),
rows_ AS MATERIALIZED (
  SELECT bucket, profit_margin::DOUBLE AS y,
         [1.0::DOUBLE] || [{', '.join(f"({c}::DOUBLE - (SELECT avg({c}::DOUBLE) FROM tr)) / (SELECT stddev_pop({c}::DOUBLE) FROM tr)" for c in _X)}]
         || {' || '.join(f"list_transform((SELECT list(DISTINCT {c} ORDER BY {c}) FROM tr)[2:], lambda l: ({c} = l)::INT::DOUBLE)" for c in ("category", "ship_mode"))} AS x
  FROM reg),
cells AS (SELECT i, j, sum(xy[i] * xy[j]) AS v FROM (SELECT x || [y] AS xy FROM rows_ WHERE bucket < 8), range(1, 99) AS a(i), range(1, 99) AS b(j)
          WHERE i <= len(xy) AND j <= len(xy) GROUP BY i, j),
m0 AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY j) AS r FROM cells GROUP BY i)),
gj AS (
  SELECT 1 AS p, m FROM m0
  UNION ALL
  SELECT p + 1, list_transform(m, lambda r, i: list_transform(r, lambda v, j: CASE WHEN i = p THEN v / m[p][p] ELSE v - r[p] * m[p][j] / m[p][p] END)) FROM gj WHERE p < len(m)),
beta AS (SELECT list_transform(m[:len(m) - 1], lambda r: r[len(r)]) AS b FROM gj WHERE p = len(m)),
test AS (SELECT y, list_inner_product(x, (SELECT b FROM beta)) AS f, (SELECT avg(y) FROM rows_ WHERE bucket < 8) AS mean FROM rows_ WHERE bucket >= 8),
g AS (SELECT sqrt(avg((y - mean) ** 2)) AS baseline_rmse, sqrt(avg((y - f) ** 2)) AS rmse, avg(abs(y - f)) AS mae, 1 - sum((y - f) ** 2) / (var_pop(y) * count(*)) AS r2 FROM test)
SELECT 'linear' AS model, (SELECT count(*) FROM reg)::BIGINT AS rows, round(baseline_rmse, 6) AS baseline_rmse, round(rmse, 6) AS rmse, round(mae, 6) AS mae,
       round(r2, 6) AS r2, round((baseline_rmse - rmse) / baseline_rmse, 6) AS improvement FROM g"""
SQL["reg_metrics_linear"] = _LINEAR
