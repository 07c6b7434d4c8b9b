"""Profit-margin regression (M13-M19): key-based split, train-mean baseline, a
fitted model, and RMSE / MAE / R^2 with relative improvement.

The 80/20 split is a pure function of the order id (``pmod(id, 10) < 8``) rather
than ``randomSplit``, whose membership depends on partitioning; it is
reproducible on any cluster layout and checkable in SQL. Metrics are plain
aggregates over the prediction column. The feature rows are written once to the
shared folder; fitting and both evaluations read that table.

The linear model is solved from its normal equations: one aggregate sums all products of the
numeric columns by pair of levels, exactly (decimals), and the few sums give X'X and X'y. Its
predictions are a plain expression, so no row leaves the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction
from itertools import combinations_with_replacement

from pyspark.ml import Estimator
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.operators import features, marts
from tallyspark.plans.materialize import materialize

# --- fixed values ---------------------------------------------------------------
NUMERIC = ["sales", "quantity", "discount", "delivery_days"]
CATEGORICAL = ["category", "ship_mode"]
LABEL = "profit_margin"
REQUIRED = ["sales", "profit", "discount", "quantity", "category", "ship_mode", "delivery_days", "profit_margin"]
TRAIN_BUCKETS = 8   # of 10
PART_ROWS = 500_000  # most training rows in a partition
# --------------------------------------------------------------------------------


def regression_frame(orders: DataFrame, products: DataFrame) -> DataFrame:
    """The rows that the regression uses, required fields present and sales above zero."""
    return features.complete_rows(features.with_category(orders, products), REQUIRED, positive=["sales"])


def split_bucket(order_id: str = "order_id") -> Column:
    """Digits at the end of the order id, mod 10."""
    return F.pmod(F.regexp_extract(F.col(order_id), r"(\d+)$", 1).cast("bigint"), F.lit(10))


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deterministic 80/20 split."""
    b = split_bucket()
    return df.where(b < TRAIN_BUCKETS), df.where(b >= TRAIN_BUCKETS)


def split_summary(df: DataFrame) -> DataFrame:
    """Rows and mean label per side of the split."""
    side = F.when(split_bucket() < TRAIN_BUCKETS, F.lit("train")).otherwise(F.lit("test"))
    return df.groupBy(side.alias("split")).agg(
        F.count(F.lit(1)).cast("bigint").alias("rows"),
        F.round(F.sum(LABEL).cast("double") / F.count(LABEL), 6).alias("mean_margin"),
    ).orderBy("split")


def metrics(pred: DataFrame, label: str = LABEL, prediction: str = "prediction") -> DataFrame:
    """RMSE, MAE and R^2 of ``prediction`` against ``label`` in one aggregate."""
    y = F.col(label).cast("double")
    e = y - F.col(prediction).cast("double")
    g = pred.agg(
        F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
        F.sum(e * e).alias("sse"), F.var_pop(y).alias("vy"), F.count(F.lit(1)).alias("n"))
    return g.select(
        F.sqrt("mse").alias("rmse"), "mae",
        (F.lit(1.0) - F.col("sse") / (F.col("vy") * F.col("n"))).alias("r2"))


def train_mean(train: DataFrame) -> float:
    return train.agg(F.avg(F.col(LABEL).cast("double"))).first()[0]


def baseline(train: DataFrame, test: DataFrame) -> DataFrame:
    """Predict the training mean for every test row; rounded for the report only."""
    mean = train_mean(train)
    m = metrics(test.withColumn("prediction", F.lit(mean)))
    return m.select(F.round(F.lit(mean), 6).alias("train_mean"),
                    *[F.round(c, 6).alias(c) for c in ("rmse", "mae", "r2")])


def estimator(model_type: str) -> Estimator:
    """Gradient-boosted trees with the reference's settings."""
    if model_type != "gbt":
        raise ValueError(f"no estimator named {model_type!r}; 'linear' is fitted by fit_linear")
    return GBTRegressor(labelCol=LABEL, maxIter=50, maxDepth=5, seed=42)


@dataclass
class Linear:
    """Coefficients of a linear model: the constant, one a numeric column, one a level (the first level of a column has 0)."""

    constant: float
    numeric: dict[str, float]
    levels: dict[str, dict[str, float]]

    def predict(self) -> Column:
        """The prediction as an expression; an unknown level adds 0."""
        out = F.lit(self.constant)
        for c, b in self.numeric.items():
            out = out + F.col(c).cast("double") * b
        for c, by_level in self.levels.items():
            pairs = [F.lit(x) for pair in by_level.items() for x in pair]
            if pairs:
                out = out + F.coalesce(F.create_map(*pairs)[F.col(c)], F.lit(0.0))
        return out


def _solve(a: list[list[Fraction]], b: list[Fraction]) -> list[Fraction]:
    """Exact elimination; a column that the earlier ones determine gets 0."""
    n = len(b)
    rows = [[*r, y] for r, y in zip(a, b)]
    used: list[tuple[int, int]] = []
    for c in range(n):
        p = next((r for r in range(n) if rows[r][c] and all(r != u for u, _ in used)), None)
        if p is None:
            continue
        used.append((p, c))
        for r in range(n):
            if r != p and rows[r][c]:
                f = rows[r][c] / rows[p][c]
                rows[r] = [x - f * y for x, y in zip(rows[r], rows[p])]
    out = [Fraction(0)] * n
    for p, c in used:
        out[c] = rows[p][n] / rows[p][c]
    return out


def fit_linear(train: DataFrame, numeric: list[str], categorical: list[str], label: str = LABEL) -> Linear:
    """Least squares from one aggregate.

    Columns are exact decimals or integers (a double is taken to nine places), so the sums by
    pair of levels do not depend on partitioning; they are as many rows as pairs of levels that occur. The system is solved as
    fractions, where collinear columns show exactly. No rows give a model that predicts 0.
    """
    kinds = dict(train.dtypes)
    decimal = {c: "decimal(18,9)" if kinds[c] in ("double", "float") else "decimal(18,4)" for c in (*numeric, label)}  # any product fits
    rows = train.select(*[F.col(c).cast(t).alias(c) for c, t in decimal.items()], *categorical)
    names = [*numeric, label]
    products = list(combinations_with_replacement(names, 2))
    sums = [F.sum(F.col(c)).alias(f"s{i}") for i, c in enumerate(names)]
    sums += [F.sum(F.col(a) * F.col(b)).alias(f"p{i}") for i, (a, b) in enumerate(products)]
    groups = rows.groupBy(*categorical).agg(F.count(F.lit(1)).alias("n"), *sums).collect()
    levels = {c: sorted({g[c] for g in groups})[1:] for c in categorical}
    columns = [("1", None), *((c, None) for c in numeric), *((c, x) for c in categorical for x in levels[c])]
    size = len(columns)
    xx, xy = [[Fraction(0)] * size for _ in range(size)], [Fraction(0)] * size
    for g in groups:
        total = {"1": Fraction(g["n"])} | {c: Fraction(g[f"s{i}"]) for i, c in enumerate(names)}
        product = {frozenset(pair): Fraction(g[f"p{i}"]) for i, pair in enumerate(products)}
        on = [(k, "1" if x is not None else c) for k, (c, x) in enumerate(columns) if x is None or g[c] == x]
        for k, a in on:
            xy[k] += total[label] if a == "1" else product[frozenset((a, label))]
            for m, b in on:
                xx[k][m] += total[b] if a == "1" else total[a] if b == "1" else product[frozenset((a, b))]
    beta = [float(v) for v in _solve(xx, xy)]
    found = dict(zip(columns, beta))
    return Linear(found["1", None], {c: found[c, None] for c in numeric}, {c: {x: found[c, x] for x in levels[c]} for c in categorical})


def tier_report(frame: DataFrame) -> DataFrame:
    """Mean margin and rows per discount tier over the regression rows."""
    return marts.tier_margin(frame)


def bounded(rows: DataFrame) -> DataFrame:
    """``rows`` in partitions of about ``PART_ROWS`` at most: the trees keep their rows in memory, much larger than in the file."""
    parts = -(-rows.count() // PART_ROWS)
    return rows.repartition(parts) if parts > rows.rdd.getNumPartitions() else rows


def run(orders: DataFrame, products: DataFrame, model: str | Estimator = "gbt") -> DataFrame:
    """One row: rows used, baseline RMSE, model RMSE / MAE / R^2, improvement over the unrounded baseline. Fitting runs when this is called."""
    frame = regression_frame(orders, products)
    frame = materialize(frame.select("order_id", LABEL, *NUMERIC, *CATEGORICAL), "regression")
    train, test = split(frame)
    if model == "linear":
        name, predicted = model, test.withColumn("prediction", fit_linear(train, NUMERIC, CATEGORICAL).predict())
    else:
        name = model if isinstance(model, str) else type(model).__name__
        chosen = estimator(model) if isinstance(model, str) else model
        double = lambda df: df.withColumn(LABEL, F.col(LABEL).cast("double"))
        predicted = features.encoder(NUMERIC, CATEGORICAL, chosen).fit(bounded(double(train))).transform(double(test))
    base = metrics(test.withColumn("prediction", F.lit(train_mean(train)))).select(F.col("rmse").alias("baseline_rmse"))
    found = metrics(predicted).crossJoin(base)  # one row each
    rows = frame.agg(F.count("order_id").cast("bigint").alias("rows"))
    return found.crossJoin(rows).select(
        F.lit(name).alias("model"), "rows", "baseline_rmse", "rmse", "mae", "r2",
        ((F.col("baseline_rmse") - F.col("rmse")) / F.col("baseline_rmse")).alias("improvement"),
    )


def rounded(report: DataFrame) -> DataFrame:
    """``run``'s row with its figures to six places, as it is shown."""
    return report.select("model", "rows", *[F.round(c, 6).alias(c) for c in ("baseline_rmse", "rmse", "mae", "r2", "improvement")])
