"""Data audit of a frame: null counts, blank and duplicate rows, column types
and a describe() including string columns (A18-A22).

Everything is one-pass aggregation: per-column null counts fold into a single
``agg``; duplicate rows are counted from one group-by over all columns. Quartiles
are exact, by distributed selection: histograms narrow the range that holds a wanted
rank, all columns and ranks in each pass, until few values are left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.plans.materialize import materialize


def _c(name: str):
    return F.col(f"`{name}`")


def null_counts(df: DataFrame) -> DataFrame:
    """Null count per column, only columns with at least one null."""
    cols = df.columns
    wide = df.agg(*[F.count_if(_c(c).isNull()).cast("bigint").alias(f"c{i}") for i, c in enumerate(cols)])
    long = wide.unpivot([], [f"c{i}" for i in range(len(cols))], "slot", "null_count")
    names = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(f"c{i}"), F.lit(c))])
    return long.where(F.col("null_count") > 0).select(
        names[F.col("slot")].alias("column_name"), "null_count").orderBy("column_name")


def duplicate_counts(df: DataFrame) -> DataFrame:
    """A19 + A20: fully-null rows, and extra copies of exactly repeated rows."""
    cols = df.columns
    blank = F.lit(True)
    for c in cols:
        blank = blank & _c(c).isNull()
    groups = df.groupBy(*[_c(c) for c in cols]).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.sum(F.when(blank, F.col("n")).otherwise(0)).cast("bigint").alias("blank_rows"),
        F.sum(F.col("n") - 1).cast("bigint").alias("duplicate_rows"),
        F.sum("n").cast("bigint").alias("rows"),
    )


def column_types(df: DataFrame) -> DataFrame:
    """(column_name, type, rows) of every column; the types come from the schema."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("type")) for c, t in df.dtypes])
    return df.agg(F.count(F.lit(1)).alias("rows")).select(F.explode(pairs).alias("p"), "rows").select("p.*", "rows").orderBy("column_name")


QUARTILES = (0.25, 0.5, 0.75)


BINS = 4096
FEW = 20_000


def _range_counts(df: DataFrame, ranges: list[tuple[str, float, float]]) -> dict[int, list[tuple[float, float, int]]]:
    """For each (column, low, high) its values' bins in order, as (least, greatest, count); one job over all ranges.

    Counts are summed map-side, so a task sends BINS rows a range at most, however many rows it has.
    """
    slots = []
    for i, (c, lo, hi) in enumerate(ranges):
        x = _c(c)
        # halves, so that the width of the range is no infinity
        bin_ = F.least(F.floor((x / 2 - lo / 2) / (hi / 2 - lo / 2) * BINS), F.lit(BINS - 1)) if hi / 2 > lo / 2 else F.lit(0).cast("long")
        slots.append(F.when(x.between(lo, hi), F.struct(F.lit(i).alias("i"), bin_.cast("long").alias("bin"), x.alias("x"))))
    found = df.select(F.explode(F.array_compact(F.array(*slots))).alias("s")).groupBy("s.i", "s.bin").agg(
        F.min("s.x").alias("lo"), F.max("s.x").alias("hi"), F.count("s.x").alias("n"))
    out: dict[int, list[tuple[float, float, int]]] = {i: [] for i in range(len(ranges))}
    for r in sorted(found.collect()):
        out[r["i"]].append((r["lo"], r["hi"], r["n"]))
    return out


def _values(df: DataFrame, ranges: list[tuple[str, float, float]]) -> dict[int, list[tuple[float, int]]]:
    """The different values of each range with their counts, ascending; one job. Ranges hold FEW values each, or one."""
    slots = [F.when(_c(c).between(lo, hi), F.struct(F.lit(i).alias("i"), _c(c).alias("x"))) for i, (c, lo, hi) in enumerate(ranges)]
    found = df.select(F.explode(F.array_compact(F.array(*slots))).alias("s")).groupBy("s.i", "s.x").count()
    out: dict[int, list[tuple[float, int]]] = {i: [] for i in range(len(ranges))}
    for i, x, n in sorted(map(tuple, found.collect())):
        out[i].append((x, n))
    return out


def exact_quantiles(df: DataFrame, bounds: dict[str, tuple[int, float, float]], at: Sequence[float] = QUARTILES) -> dict[str, list[float | None]]:
    """Exact, linearly interpolated quantiles of several double columns, by distributed selection.

    ``bounds``: each column's number of values, least and greatest. A pass cuts every range that
    holds a wanted rank into BINS parts and counts them; the part with the rank is the next
    range, until it holds FEW values at most or a single one. As many wanted ranks as there
    are columns and quantiles go through each pass together: one pass for up to BINS * FEW evenly spread
    rows, one more for each further factor of BINS. Then one job brings the ranges' values. Nulls are left out;
    no values give None. Values are finite.
    """
    wanted = {}  # (column, rank) -> (low, high, rows below, rows inside)
    for c, (n, lo, hi) in bounds.items():
        for q in at if n else ():
            first = int(q * (n - 1))
            for rank in {first, min(first + 1, n - 1)}:
                wanted[c, rank] = (lo, hi, 0, n)
    while True:
        open_ = sorted({(c, lo, hi) for (c, _), (lo, hi, _, inside) in wanted.items() if inside > FEW and lo < hi})
        if not open_:
            break
        counts = _range_counts(df, open_)
        for (c, rank), (lo, hi, below, _) in list(wanted.items()):
            if (c, lo, hi) in open_:
                for a, b, n in counts[open_.index((c, lo, hi))]:
                    if rank < below + n:
                        wanted[c, rank] = (a, b, below, n)
                        break
                    below += n
    left = sorted({(c, lo, hi) for (c, _), (lo, hi, _, _) in wanted.items() if lo < hi})
    values = _values(df, left) if left else {}
    found = {}
    for (c, rank), (lo, hi, below, _) in wanted.items():
        for x, n in values[left.index((c, lo, hi))] if lo < hi else [(lo, rank - below + 1)]:
            if rank < below + n:
                found[c, rank] = x
                break
            below += n
    out: dict[str, list[float | None]] = {}
    for c, (n, _, _) in bounds.items():
        out[c] = []
        for q in at:
            rank = q * (n - 1)
            a = found.get((c, int(rank)))
            out[c].append(a if a is None or rank == int(rank) else a + (found[c, int(rank) + 1] - a) * (rank - int(rank)))
    return out


def describe_columns(df: DataFrame, numeric: Sequence[str], text: Sequence[str] = ()) -> DataFrame:
    """Long-form describe: (column_name, statistic, value, text_value).

    Numeric columns: count, mean, std (sample), min, max and exact, linearly interpolated
    quartiles. Text columns: count, unique, top (most frequent, smallest value on a
    tie), freq, all from one grouping on the column. The numeric columns are written once as
    a narrow table; that, one aggregate and the selection's passes run when this is called.
    """
    spark = df.sparkSession
    stats = ("count", "mean", "std", "min", "max")
    if numeric:
        df_numbers = materialize(df.select(*[_c(c).cast("double").alias(c) for c in numeric]), "describe")
        row = df_numbers.agg(*[f(_c(c)).alias(f"{c}|{k}") for c in numeric for f, k in zip((F.count, F.avg, F.stddev_samp, F.min, F.max), stats)]).first()
        quartiles = exact_quantiles(df_numbers, {c: (row[f"{c}|count"], row[f"{c}|min"], row[f"{c}|max"]) for c in numeric})
        found = [(c, k, None if row[f"{c}|{k}"] is None else float(row[f"{c}|{k}"])) for c in numeric for k in stats]
        found += [(c, f"{int(q * 100)}%", v) for c in numeric for q, v in zip(QUARTILES, quartiles[c])]
    else:
        found = []
    out = spark.createDataFrame(found, "column_name string, statistic string, value double").select(
        "column_name", "statistic", F.round("value", 4).alias("value"), F.lit(None).cast("string").alias("text_value"))
    for c in text:
        freq = df.where(_c(c).isNotNull()).groupBy(_c(c).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n"))
        top = freq.agg(
            F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("count"), F.count("v").cast("double").alias("unique"),
            F.max("n").cast("double").alias("freq"), F.min_by("v", F.struct((-F.col("n")).alias("a"), F.col("v").alias("b"))).alias("top"))
        rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("statistic"), F.col(k).alias("value"), F.lit(None).cast("string").alias("text_value")) for k in ("count", "unique", "freq")],
                       F.struct(F.lit(c).alias("column_name"), F.lit("top").alias("statistic"), F.lit(None).cast("double").alias("value"), F.col("top").alias("text_value")))
        out = out.unionByName(top.select(F.inline(rows)))
    return out.orderBy("column_name", "statistic")


def describe_quartiles_approx(df: DataFrame, numeric: Sequence[str], accuracy: int = 100_000) -> DataFrame:
    """Quartiles with ``percentile_approx``: per-task memory bounded by
    ``accuracy``, rank error at most 1/accuracy of the row count."""
    aggs = [F.percentile_approx(_c(c).cast("double"), [0.25, 0.5, 0.75], accuracy).alias(c) for c in numeric]
    wide = df.agg(*aggs)
    long = wide.unpivot([], list(numeric), "column_name", "q")
    return long.select("column_name", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"),
                       F.col("q")[2].alias("p75"))
