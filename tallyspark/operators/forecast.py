"""Monthly series, Holt-Winters forecasting and backtest (M9-M12), for one
series or many (one per key, e.g. region), entirely in Spark SQL expressions.

Layout: the fact is aggregated to (key, month) sums, then each key's months are
folded into one ordered array (its length is the number of months in the data,
independent of the row volume). Holt-Winters is an ``aggregate()`` fold over
that array; the (alpha, beta, gamma) grid is evaluated inside the same row with
``transform`` (no cross join) and the least-SSE point is chosen with a second
fold. Keys are independent rows, so many series spread over all tasks.

Specification (additive trend; additive season of 12 when the series has at
least 24 points, else none):
  seasonal init: level = mean(first 12), trend = (mean(next 12) - level) / 12,
                 season_i = y_i - level; the fold runs over every point.
  non-seasonal:  level = y1, trend = y2 - y1; the fold starts at y2.
  step:          f = l + b + s;  l' = a(y - s) + (1 - a)(l + b);
                 b' = g_b(l' - l) + (1 - g_b) b;  s' = c(y - l - b) + (1 - c) s;
                 SSE += (y - f)^2; the season array is a ring (head used, new
                 value appended).
  forecast h:    l + h b + s[(h - 1) mod 12].
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------
SEASON = 12
MIN_SEASONAL_POINTS = 24
GRID = [0.1, 0.3, 0.5, 0.7, 0.9]
HOLDOUT = 6
MIN_EXTRA_POINTS = 6            # backtest needs more than holdout + 6 points
DEFAULT_PERIODS = 6
MAPE_EPS = 2.220446049250313e-16  # float64 machine epsilon
# -------------------------------------------------------------------------------


def monthly_series(
    orders: DataFrame,
    keys: Sequence[str] = (),
    value: str = "sales",
    date: str = "order_date",
    trim_edges: bool = True,
) -> DataFrame:
    """Month-start sums per key, empty months filled with 0, and the
    first and last month dropped when there are more than two (they are
    treated as partial).

    The month sums of a key are folded into one month -> sum map (its size is
    the number of months in the data), and the calendar is generated and
    gap-filled in the same row: one pass over the fact, no join back.
    """
    keys = list(keys)
    sums = orders.groupBy(*keys, F.trunc(date, "MM").alias("month")).agg(F.sum(value).alias("y"))
    per_key = sums.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("month", F.col("y").cast("double")))).alias("by_month"),
        F.min("month").alias("lo"),
        F.max("month").alias("hi"),
    )
    calendar = per_key.select(
        *keys, "lo", "hi", "by_month",
        F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 MONTH"))).alias("month"))
    filled = calendar.select(
        *keys, "month", "lo", "hi",
        F.coalesce(F.try_element_at("by_month", F.col("month")), F.lit(0.0)).alias("y"))
    if trim_edges:
        n_months = F.months_between("hi", "lo") + 1
        filled = filled.where((n_months <= 2) | ((F.col("month") > F.col("lo")) & (F.col("month") < F.col("hi"))))
    return filled.select(*keys, "month", "y")


def series_arrays(monthly: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per key: ``months`` and ``ys`` arrays in month order."""
    keys = list(keys)
    g = monthly.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("month", "y"))).alias("pts"))
    return g.select(*keys, F.col("pts.month").alias("months"), F.col("pts.y").alias("ys"))


def _grid_sql() -> str:
    pts = [f"named_struct('a', {a}D, 'b', {b}D, 'c', {c}D)" for a in GRID for b in GRID for c in GRID]
    return "array(" + ", ".join(pts) + ")"


def _sum(arr: str) -> str:
    return f"aggregate({arr}, 0D, (acc, x) -> acc + x)"


_SEASONAL_FOLD = """
aggregate({ys},
  named_struct('l', {l0}, 'b', {b0}, 's', transform(slice({ys}, 1, 12), x -> x - {l0}), 'sse', 0D),
  (st, y) -> named_struct(
    'l', p.a * (y - st.s[0]) + (1D - p.a) * (st.l + st.b),
    'b', p.b * ((p.a * (y - st.s[0]) + (1D - p.a) * (st.l + st.b)) - st.l) + (1D - p.b) * st.b,
    's', concat(slice(st.s, 2, 11), array(p.c * (y - st.l - st.b) + (1D - p.c) * st.s[0])),
    'sse', st.sse + (y - (st.l + st.b + st.s[0])) * (y - (st.l + st.b + st.s[0]))))"""

_PLAIN_FOLD = """
aggregate(slice({ys}, 2, size({ys}) - 1),
  named_struct('l', {ys}[0], 'b', {ys}[1] - {ys}[0], 's', CAST(array() AS array<double>), 'sse', 0D),
  (st, y) -> named_struct(
    'l', p.a * y + (1D - p.a) * (st.l + st.b),
    'b', p.b * ((p.a * y + (1D - p.a) * (st.l + st.b)) - st.l) + (1D - p.b) * st.b,
    's', st.s,
    'sse', st.sse + (y - (st.l + st.b)) * (y - (st.l + st.b))))"""


def hw_fit(ys: str = "ys") -> Column:
    """Best grid fit for the array column ``ys``: struct(alpha, beta, gamma,
    seasonal, l, b, s, sse). Ties on SSE keep the smallest (alpha, beta, gamma)."""
    l0 = f"({_sum(f'slice({ys}, 1, 12)')} / 12D)"
    l1 = f"({_sum(f'slice({ys}, 13, 12)')} / 12D)"
    b0 = f"(({l1} - {l0}) / 12D)"
    seasonal = f"size({ys}) >= {MIN_SEASONAL_POINTS}"
    fold = (f"IF({seasonal}, {_SEASONAL_FOLD.format(ys=ys, l0=l0, b0=b0)}, "
            f"{_PLAIN_FOLD.format(ys=ys)})")
    fits = (f"transform({_grid_sql()}, p -> named_struct('alpha', p.a, 'beta', p.b, 'gamma', p.c, "
            f"'seasonal', {seasonal}, 'st', {fold}))")
    # the fits are one array; a null start takes the first
    return F.expr(f"array_sort({fits}, (x, y) -> CASE WHEN x.st.sse < y.st.sse THEN -1 WHEN x.st.sse > y.st.sse THEN 1 ELSE 0 END)[0]")


def hw_forecast_arrays(series: DataFrame, periods: int = DEFAULT_PERIODS, keys: Sequence[str] = ()) -> DataFrame:
    """Fit each row's ``ys`` and emit ``periods`` forecasts after its last month."""
    keys = list(keys)
    fitted = series.where(F.size("ys") >= 2).withColumn("fit", hw_fit("ys"))
    h = F.col("h")
    season_term = F.when(F.col("fit.seasonal"), F.col("fit.st.s")[(h - 1) % SEASON]).otherwise(F.lit(0.0))
    return fitted.select(*keys, "months", "fit", F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("h")).select(
        *keys,
        F.add_months(F.element_at("months", -1), h).alias("month"),
        "h",
        (F.col("fit.st.l") + h * F.col("fit.st.b") + season_term).alias("forecast"),
        F.col("fit.alpha").alias("alpha"),
        F.col("fit.beta").alias("beta"),
        F.col("fit.gamma").alias("gamma"),
        F.col("fit.seasonal").alias("seasonal"),
        F.col("fit.st.sse").alias("sse"),
    )


def forecast(orders: DataFrame, keys: Sequence[str] = (), periods: int = DEFAULT_PERIODS,
             value: str = "sales") -> DataFrame:
    """Forecast ``periods`` months per key; ``forecast_sales`` rounded to 2 dp."""
    s = series_arrays(monthly_series(orders, keys, value), keys)
    f = hw_forecast_arrays(s, periods, keys)
    done = f.select(*keys, "month", F.round("forecast", 2).alias("forecast_sales"),
                    "alpha", "beta", "gamma", "seasonal", F.lit("ok").alias("status"))
    return done.unionByName(_skipped(s.where(F.size("ys") < 2), done, keys))


def _skipped(series: DataFrame, like: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each series that is too short: its last month and the reason, nothing else."""
    known = {**{k: F.col(k) for k in keys}, "month": F.element_at("months", -1), "status": F.lit("too short")}
    return series.select(*[known.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in like.schema])


def series_report(orders: DataFrame, keys: Sequence[str] = (), holdout: int = HOLDOUT, value: str = "sales") -> DataFrame:
    """M12's report: range and length of each monthly series, and how a backtest would split it."""
    keys = list(keys)
    s = series_arrays(monthly_series(orders, keys, value), keys)
    n = F.size("ys").cast("bigint")
    enough = n > holdout + MIN_EXTRA_POINTS
    return s.select(
        *keys, F.get("months", F.lit(0)).alias("first_month"), F.element_at("months", -1).alias("last_month"), n.alias("months_total"),
        F.when(enough, n - holdout).alias("train_months"), F.when(enough, F.lit(holdout).cast("bigint")).alias("test_months"),
        F.when(enough, F.get("months", (n - holdout - 1).cast("int"))).alias("train_end"),
        F.when(enough, F.lit("ok")).otherwise("too short").alias("status"))


def backtest(orders: DataFrame, keys: Sequence[str] = (), holdout: int = HOLDOUT,
             value: str = "sales") -> DataFrame:
    """Hold out the last ``holdout`` months, fit on the rest (seasonal iff
    the *train* part has >= 24 points), and return actual vs predicted rows.
    A series with <= holdout + 6 points gives one row that says so."""
    found = backtest_errors(orders, keys, holdout, value)
    return found.withColumns({"actual": F.round("actual", 2), "predicted": F.round("predicted", 2)})


def backtest_errors(orders: DataFrame, keys: Sequence[str] = (), holdout: int = HOLDOUT,
                    value: str = "sales") -> DataFrame:
    """The rows of ``backtest`` before rounding."""
    keys = list(keys)
    s = series_arrays(monthly_series(orders, keys, value), keys)
    enough = F.size("ys") > holdout + MIN_EXTRA_POINTS
    train = s.where(enough).select(
        *keys,
        F.slice("months", 1, F.size("months") - holdout).alias("months"),
        F.slice("ys", 1, F.size("ys") - holdout).alias("ys"),
        F.slice("ys", -holdout, holdout).alias("test_ys"),
    )
    f = hw_forecast_arrays(train, holdout, keys)
    actual = train.select(*keys, F.posexplode("test_ys").alias("i", "actual")).withColumn("h", F.col("i") + 1)
    done = f.join(actual, [*keys, "h"]).select(
        *keys, "month", "h", "actual", F.col("forecast").alias("predicted"), "alpha", "beta", "gamma", "seasonal", F.lit("ok").alias("status"))
    return done.unionByName(_skipped(s.where(~enough), done, keys))


def backtest_metrics(bt: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """MAPE (denominator max(|y|, eps)), MAE, RMSE per key over the holdout rows of
    ``backtest_errors``; rounded at the end only. A skipped series has no metrics."""
    keys = list(keys)
    err = F.col("actual") - F.col("predicted")
    return bt.where("status = 'ok'").groupBy(*keys).agg(
        F.round(F.avg(F.abs(err) / F.greatest(F.abs("actual"), F.lit(MAPE_EPS))), 6).alias("mape"),
        F.round(F.avg(F.abs(err)), 2).alias("mae"),
        F.round(F.sqrt(F.avg(err * err)), 2).alias("rmse"),
        F.count(F.lit(1)).cast("bigint").alias("test_points"),
    )
