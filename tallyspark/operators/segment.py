"""Order segmentation and customer RFM segmentation with k-means.

* Scaling is plain SQL: ``(x - mean) / stddev_pop`` (0 when the spread is 0),
  the population convention of the reference's scaler. The few global
  statistics come back to the driver as scalars (one row, bounded).
* Categoricals are one-hot encoded by ``features.encoder``, shared with the regression.
* Scaled feature rows are written once to the shared folder; every scan reads that table.
* k-means fits all restarts of all k in one scan an iteration, from deterministic
  starts (``kmeans``); the sweep scores each k by the squared Euclidean silhouette
  over all rows (distributed, no pairwise distances).
* Cluster labels compare each cluster's means with the global means (strict
  ``>``), computed from the k-row profile with a window over those k rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.exprs import (
    SEG_DEEP_DISCOUNT,
    SEG_FULL_PRICE,
    SEG_MIXED,
    SEG_PREMIUM,
    SEG_SMALL,
)
from tallyspark.operators import features, kmeans
from tallyspark.plans.materialize import materialize

# --- fixed values ---------------------------------------------------------------
NUMERIC_FEATURES = ["sales", "quantity", "discount", "profit_margin", "delivery_days"]
CATEGORICAL_FEATURES = ["category", "ship_mode"]
K_RANGE = range(2, 9)
# --------------------------------------------------------------------------------


class NoRepeatCustomers(ValueError):
    """RFM is meaningless when every customer has exactly one order."""


def load_order_features(orders: DataFrame, products: DataFrame) -> DataFrame:
    """M2: orders LEFT JOIN products (pruned), rows missing a feature dropped."""
    return features.complete_rows(features.with_category(orders, products), NUMERIC_FEATURES + CATEGORICAL_FEATURES)


def dropped_feature_rows(orders: DataFrame, products: DataFrame) -> DataFrame:
    """Rows dropped for missing features, and their share."""
    df = features.with_category(orders, products)
    complete = F.lit(True)
    for c in NUMERIC_FEATURES + CATEGORICAL_FEATURES:
        complete = complete & F.col(c).isNotNull()
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~complete).alias("dropped")).select(
        "rows", "dropped", F.round(F.col("dropped") / F.col("rows"), 4).alias("dropped_ratio"))


def standardize(df: DataFrame, cols: Sequence[str], prefix: str = "z_") -> DataFrame:
    """Population z-scores; a zero spread gives 0. Adds ``{prefix}{col}``."""
    stats = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m_{c}") for c in cols],
                   *[F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}") for c in cols]).first()
    out = df
    for c in cols:
        m, s = stats[f"m_{c}"], stats[f"s_{c}"]
        z = (F.col(c).cast("double") - F.lit(m)) / F.lit(s) if s else F.lit(0.0)
        out = out.withColumn(f"{prefix}{c}", z)
    return out


def featurize(df: DataFrame, numeric: Sequence[str] = NUMERIC_FEATURES,
              categorical: Sequence[str] = CATEGORICAL_FEATURES) -> DataFrame:
    """M1: ``df`` with ``features``, the z-scores beside the one-hot block."""
    scaled = standardize(df, numeric)
    return features.encoder([f"z_{c}" for c in numeric], categorical).fit(scaled).transform(scaled)


def point(frame: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> list[Column]:
    """The row of ``featurize`` as k-means reads it: x, the z-scores, and on, the places of the ones in the one-hot block."""
    places, before = [], 0
    for c in categorical:
        places.append((F.col(f"{c}__number") + before).cast("int"))
        before += frame.schema[f"{c}__levels"].metadata["ml_attr"]["num_attrs"]
    return [F.array(*[F.col(f"z_{c}").cast("double") for c in numeric]).alias("x"), *([F.array(*places).alias("on")] if places else [])]


def sweep(rows: DataFrame, k_range: Sequence[int] = K_RANGE, n_init: int = 10,
          max_iter: int = 50) -> tuple[int, DataFrame, dict[int, kmeans.Model]]:
    """M3 + M4: inertia and silhouette for each k; best k = highest silhouette (to six places, first on ties).

    ``rows`` has key, x and on (see ``kmeans.sweep``). Returns (best_k, sweep rows as a
    DataFrame, best model by k); the scans run when this is called. No rows: best_k 0, no sweep rows."""
    models, scores, _ = kmeans.sweep(rows, list(k_range), n_init, max_iter)
    found = [(m.k, round(m.inertia, 4), round(s, 6)) for m, s in zip(models, scores)]
    best_k = max(found, key=lambda r: (r[2], -r[0]))[0] if found else 0
    table = rows.sparkSession.createDataFrame([(k, i, s, k == best_k) for k, i, s in found],
                                              "k int, inertia double, silhouette double, selected boolean")
    return best_k, table, {m.k: m for m in models}


def _assigned(rows: DataFrame, models: dict[int, kmeans.Model], best_k: int) -> DataFrame:
    """``rows`` with segment_id; without rows there is no model, and no row to assign."""
    if not best_k:
        return rows.drop("key", "x", "on").withColumn("segment_id", F.lit(0))
    return kmeans.assign(rows, models[best_k]).drop("key")


def label_segments(assigned: DataFrame, cluster_col: str = "segment_id") -> DataFrame:
    """M6: name each cluster from its mean discount / margin / sales against the
    global means (strict ``>``), first matching rule wins."""
    profile = assigned.groupBy(cluster_col).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("discount").cast("double")).alias("d"),
        F.avg(F.col("profit_margin").cast("double")).alias("m"),
        F.avg(F.col("sales").cast("double")).alias("s"),
        F.sum(F.col("discount").cast("double")).alias("sd"),
        F.sum(F.col("profit_margin").cast("double")).alias("sm"),
        F.sum(F.col("sales").cast("double")).alias("ss"),
    )
    everything = Window.partitionBy()  # over the k profile rows only
    n_all = F.sum("n").over(everything)
    hd = F.col("d") > F.sum("sd").over(everything) / n_all
    hm = F.col("m") > F.sum("sm").over(everything) / n_all
    hv = F.col("s") > F.sum("ss").over(everything) / n_all
    label = (F.when(hd & ~hm, F.lit(SEG_DEEP_DISCOUNT))
             .when(hm & ~hd, F.lit(SEG_FULL_PRICE))
             .when(hv & hm, F.lit(SEG_PREMIUM))
             .when(~hv, F.lit(SEG_SMALL))
             .otherwise(F.lit(SEG_MIXED)))
    labels = profile.select(cluster_col, label.alias("segment_label"))
    return assigned.join(F.broadcast(labels), cluster_col, "left")  # k rows: bounded by k


def one_hot_block(orders: DataFrame, products: DataFrame) -> DataFrame:
    """The one-hot half of M1 as rows: orders per (field, level), counted from the encoded vectors."""
    rows = load_order_features(orders, products)
    fitted = features.encoder([], CATEGORICAL_FEATURES).fit(rows)
    names = [(c, x) for c, levels in zip(CATEGORICAL_FEATURES, fitted.stages[0].labelsArray) for x in levels]
    slots = F.posexplode(vector_to_array("features")).alias("slot", "on")
    counts = fitted.transform(rows).select(slots).groupBy("slot").agg(F.sum("on").cast("bigint").alias("orders"))
    table = rows.sparkSession.createDataFrame([(i, *n) for i, n in enumerate(names)], "slot int, field string, level string")
    return counts.join(table, "slot", "full").select("field", "level", "orders").orderBy("field", "level")


def cluster_profile(segments: DataFrame, cluster_col: str = "segment_id") -> DataFrame:
    """Mean discount, margin, sales and quantity per cluster."""
    return segments.groupBy(cluster_col).agg(
        *[F.round(F.avg(F.col(c).cast("double")), 6).alias(f"avg_{c}")
          for c in ("discount", "profit_margin", "sales", "quantity")],
        F.count(F.lit(1)).cast("bigint").alias("orders"),
    ).orderBy(cluster_col)


def segment_summary(segments: DataFrame) -> DataFrame:
    """Per label count, mean sales / discount / margin, total profit (3 dp)."""
    return segments.groupBy("segment_label").agg(
        F.count("order_id").cast("bigint").alias("orders"),
        F.round(F.avg(F.col("sales").cast("double")), 3).alias("avg_sales"),
        F.round(F.avg(F.col("discount").cast("double")), 3).alias("avg_discount"),
        F.round(F.avg(F.col("profit_margin").cast("double")), 3).alias("avg_margin"),
        F.round(F.sum("profit").cast("double"), 3).alias("total_profit"),
    ).orderBy(F.col("orders").desc(), "segment_label")


def segment_summary_short(segments: DataFrame) -> DataFrame:
    """Per label count and mean margin, by count descending."""
    return segments.groupBy("segment_label").agg(
        F.count("order_id").cast("bigint").alias("orders"),
        F.round(F.avg(F.col("profit_margin").cast("double")), 6).alias("avg_margin"),
    ).orderBy(F.col("orders").desc(), "segment_label")


@dataclass
class Segmentation:
    best_k: int
    sweep: DataFrame
    segments: DataFrame


def order_segmentation(orders: DataFrame, products: DataFrame, k_range: Sequence[int] = K_RANGE,
                       n_init: int = 10, max_iter: int = 50) -> Segmentation:
    """M7: features -> sweep -> final fit at best k -> labels."""
    names = [*orders.columns, "category", "sub_category"]
    # the star is built once; scaling, encoding and the features read it
    rows = featurize(materialize(load_order_features(orders, products), "order-rows"))
    rows = rows.select(*names, F.col("order_id").alias("key"), *point(rows, NUMERIC_FEATURES, CATEGORICAL_FEATURES))
    # only the features move; the orders' other columns stay where they are
    points = materialize(kmeans.spread(rows.select("key", "x", "on")), "order-features")
    best_k, table, models = sweep(points, k_range, n_init, max_iter)
    return Segmentation(best_k, table, label_segments(_assigned(rows, models, best_k)))


def rfm(orders: DataFrame) -> DataFrame:
    """Recency (days from max order date + 1), frequency (order ids),
    monetary (sales sum) per customer; raises if nobody ordered twice."""
    per = materialize(orders.groupBy("customer_id").agg(
        F.max("order_date").alias("last"), F.count("order_id").alias("frequency"),
        F.sum("sales").alias("monetary"), F.count(F.lit(1)).alias("n")), "per-customer")
    guard = per.agg(F.max("n").alias("max_n"), F.max("last").alias("max_date")).first()
    if guard is None or guard["max_n"] is None or guard["max_n"] <= 1:
        raise NoRepeatCustomers("every customer has exactly one order; RFM is not meaningful")
    snapshot = F.date_add(F.lit(guard["max_date"]), 1)
    return per.select(
        "customer_id",
        F.datediff(snapshot, "last").cast("bigint").alias("recency"),
        F.col("frequency").cast("bigint").alias("frequency"),
        F.col("monetary").cast("double").alias("monetary"),
    )


def rfm_segments(orders: DataFrame, k_range: Sequence[int] = K_RANGE, n_init: int = 10,
                 max_iter: int = 50) -> Segmentation:
    """M8: scale R/F/M, sweep k, fit, one segment per customer."""
    cols = ["recency", "frequency", "monetary"]
    table = materialize(rfm(orders), "rfm")  # one row a customer; read by scaling, every fit and the result
    rows = featurize(table, cols, []).select("customer_id", *cols, F.col("customer_id").cast("string").alias("key"), *point(table, cols, []))
    rows = materialize(kmeans.spread(rows), "rfm-features")
    best_k, sweep_table, models = sweep(rows, k_range, n_init, max_iter)
    return Segmentation(best_k, sweep_table, _assigned(rows, models, best_k))


def scaled_features(orders: DataFrame, products: DataFrame) -> DataFrame:
    """The standardised numeric feature block per order (SQL-checkable part of M1)."""
    df = standardize(load_order_features(orders, products), NUMERIC_FEATURES)
    return df.select("order_id", *[F.round(f"z_{c}", 6).alias(f"z_{c}") for c in NUMERIC_FEATURES])

