"""Hand-made frames for the semantic quirks the operators must reproduce."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.functions.exprs import discount_tier, parse_mixed_date, profit_margin, quarter_label
from tallyspark.operators import clean, forecast, quality, segment

D = dt.date


def test_mixed_date_parse(spark):
    df = spark.createDataFrame([("15-03-2020",), ("2020/03/07",), ("7-3-2020",), ("n/a",), (None,)], "s string")
    got = [r[0] for r in df.select(parse_mixed_date("s").alias("d")).collect()]
    assert got == [D(2020, 3, 15), D(2020, 3, 7), D(2020, 3, 7), None, None]
    strict = [r[0] for r in df.select(parse_mixed_date("s", True).alias("d")).collect()]
    assert sum(x is not None for x in strict) == 2


def test_zero_sales_margin_is_null_and_flagged(spark):
    df = spark.createDataFrame([(Decimal("1.00"), Decimal("0.00")), (Decimal("0.00"), Decimal("0.00")),
                                (Decimal("-1.00"), Decimal("0.00"))], "profit decimal(12,2), sales decimal(12,2)")
    assert [r[0] for r in df.select(profit_margin("profit", "sales")).collect()] == [None, None, None]
    flags = df.select(quality.row_checks(df.withColumn("profit_margin", F.lit(None)))["sales_positive"]).collect()
    assert all(r[0] for r in flags)


def test_null_discount_falls_into_top_tier(spark):
    df = spark.createDataFrame([(None,), (Decimal("0.00"),), (Decimal("0.10"),), (Decimal("0.31"),)],
                               "discount decimal(4,2)")
    assert [r[0] for r in df.select(discount_tier("discount")).collect()] == ["30%+", "0%", "1-10%", "30%+"]
    flags = [r[0] for r in df.select(quality.row_checks(df)["discount_in_valid_range"]).collect()]
    assert flags == [True, False, False, False]


def test_quarter_label(spark):
    df = spark.createDataFrame([(D(2019, 5, 2),)], "d date")
    assert df.select(quarter_label("d")).first()[0] == "2019Q2"


def test_mode_tie_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("a",), ("b",)], "`Ship Mode` string")
    assert clean.ship_mode_mode(df) == "a"


def _raw_rows(spark, rows):
    from tallyspark.sources.io import RAW_SCHEMA
    return spark.createDataFrame(rows, RAW_SCHEMA)


def _raw(order_id, category, sub, date="01-02-2020", cust="C1"):
    return (order_id, date, "03-02-2020", "Standard Class", cust, "Asha", "Rao", "Consumer", "Tier 1",
            "South", "Kerala", "560001", category, sub, "100.00", "1", "0.10", "10.00")


def test_null_product_pair_gets_one_id(spark):
    raw = _raw_rows(spark, [_raw("O1", None, None), _raw("O2", None, None, "02-02-2020"),
                            _raw("O3", "Tech", "Phones", "03-02-2020")])
    c = clean.clean(raw)
    products = c.products.collect()
    assert len(products) == 2
    null_id = [p["product_id"] for p in products if p["category"] is None]
    assert len(null_id) == 1
    ids = {r["order_id"]: r["product_id"] for r in c.orders.collect()}
    assert ids["O1"] == ids["O2"] == null_id[0] == "PROD-0001"
    assert ids["O3"] == "PROD-0002"


def test_first_row_per_customer_is_earliest(spark):
    late = list(_raw("O9", "Tech", "Phones", "05-02-2020"))
    late[5] = "Later"
    raw = _raw_rows(spark, [tuple(late), _raw("O1", "Tech", "Phones", "01-02-2020")])
    c = clean.clean(raw)
    assert c.customers.first()["customer_name"] == "Asha"


def test_month_gap_filled_with_zero(spark):
    df = spark.createDataFrame([(D(2019, 1, 15), Decimal("5.00")), (D(2019, 3, 2), Decimal("7.00"))],
                               "order_date date, sales decimal(12,2)")
    got = {r["month"]: r["y"] for r in forecast.monthly_series(df, trim_edges=False).collect()}
    assert got == {D(2019, 1, 1): 5.0, D(2019, 2, 1): 0.0, D(2019, 3, 1): 7.0}
    trimmed = forecast.monthly_series(df).collect()
    assert [(r["month"], r["y"]) for r in trimmed] == [(D(2019, 2, 1), 0.0)]


@pytest.mark.parametrize("months,expect", [(12, None), (13, False), (29, False), (30, True)])
def test_backtest_length_rules(spark, months, expect):
    # months + 2 edge months, trimmed by the series builder
    rows = [(D(2010 + (m // 12), m % 12 + 1, 15), Decimal(100 + m * 3 + (m % 12) * 7)) for m in range(months + 2)]
    df = spark.createDataFrame(rows, "order_date date, sales decimal(12,2)")
    bt = forecast.backtest(df).collect()
    if expect is None:
        assert [(r.status, r.predicted) for r in bt] == [("too short", None)]
    else:
        assert len(bt) == 6 and all(r["seasonal"] is expect for r in bt)


def test_holt_winters_matches_reference_values(spark):
    o = spark.read.parquet("/root/testdata/sf0.01/orders.parquet").select(
        F.col("o_orderdate").cast("date").alias("order_date"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("sales"))
    rows = forecast.forecast(o).orderBy("month").collect()
    assert [(r.alpha, r.beta, r.gamma) for r in rows][0] == (0.1, 0.1, 0.3)
    assert [r.forecast_sales for r in rows] == [49894711.54, 48728554.82, 52643705.86,
                                                48255197.33, 48954422.65, 49103450.56]


def test_rfm_raises_without_repeat_customers(spark):
    df = spark.createDataFrame([(f"O{i}", f"C{i}", D(2020, 1, i + 1), Decimal("1.00")) for i in range(3)],
                               "order_id string, customer_id string, order_date date, sales decimal(12,2)")
    with pytest.raises(segment.NoRepeatCustomers):
        segment.rfm(df)


def test_orphan_keys(spark):
    orders = spark.createDataFrame([("O1", "C1"), ("O2", "C9"), ("O3", None)], "order_id string, customer_id string")
    customers = spark.createDataFrame([("C1",)], "customer_id string")
    assert orders.transform(lambda o: quality.orphan_keys(o, customers, "customer_id")).count() == 2
    with_null = spark.createDataFrame([("C1",), (None,)], "customer_id string")
    assert quality.orphan_keys(orders, with_null, "customer_id").count() == 1


def test_duplicate_null_keys_count_as_duplicates(spark):
    cust = spark.createDataFrame([(None,), (None,), ("C1",)], "customer_id string")
    prods = spark.createDataFrame([("P1", "a", "b")], "product_id string, category string, sub_category string")
    orders = spark.createDataFrame([], "order_id string, customer_id string, product_id string")
    facts = spark.createDataFrame([("C1",)], "customer_id string")
    got = quality.key_violations(facts, {"customer_id": cust})
    assert {r["check"]: r["violations"] for r in got.collect()} == {"customer_id_unique": 1, "orders_customer_fk": 0}
    schema = {r["check"]: r["violations"] for r in quality._schema_checks(cust, prods, orders).collect()}
    assert schema == {"customers_schema": 6, "products_schema": 0, "orders_schema": 13}


def _orders_frame(spark, rows):
    """Minimal star orders rows: (order_id, customer_id, product_id), other fields valid."""
    full = [(o, c, p, D(2020, 1, 1), D(2020, 1, 2), "Standard Class", Decimal("10.00"), 1, Decimal("0.10"),
             Decimal("1.00"), Decimal("0.1000"), 1, 2020, 1, "2020Q1", False) for o, c, p in rows]
    return spark.createDataFrame(full, "order_id string, customer_id string, product_id string, order_date date, "
                                       "ship_date date, ship_mode string, sales decimal(12,2), quantity int, "
                                       "discount decimal(4,2), profit decimal(12,2), profit_margin decimal(6,4), "
                                       "delivery_days int, order_year int, order_month int, order_quarter string, "
                                       "postal_code_missing boolean")


def test_key_and_row_checks(spark):
    orders = _orders_frame(spark, [("O1", "C1", "P1"), ("O1", "C9", "P1"), ("O3", None, "P2")])
    prods = spark.createDataFrame([("P1", "a", "b"), ("P1", "a", "c")], "product_id string, category string, sub_category string")
    cust = spark.createDataFrame([("C1",), ("C1",)], "customer_id string")
    res = {r["check"]: r["violations"] for r in quality.run_checks(cust, prods, orders).collect()}
    assert res["order_id_unique"] == 1
    assert res["customer_id_unique"] == 1 and res["product_id_unique"] == 1
    assert res["orders_customer_fk"] == 2          # C9 and NULL
    assert res["orders_product_fk"] == 1           # P2
    assert res["sales_positive"] == 0 and res["no_null_core_fields"] == 1
    cust_null = spark.createDataFrame([("C1",), (None,)], "customer_id string")
    res = {r["check"]: r["violations"] for r in quality.run_checks(cust_null, prods, orders).collect()}
    assert res["orders_customer_fk"] == 1          # NULL matches the dimension's NULL


def test_short_series_say_so(spark):
    rows = [("a", D(2020, m, 1), Decimal("10.00")) for m in range(1, 13)] + [("b", D(2020, 5, 1), Decimal("7.00"))]
    df = spark.createDataFrame(rows, "k string, order_date date, sales decimal(12,2)")
    got = forecast.forecast(df, ["k"]).where("status <> 'ok'").collect()
    assert [(r.k, r.month, r.forecast_sales) for r in got] == [("b", D(2020, 5, 1), None)]
    back = forecast.backtest(df, ["k"])
    assert {(r.k, r.status) for r in back.collect()} == {("a", "too short"), ("b", "too short")}
    assert forecast.backtest_metrics(forecast.backtest_errors(df, ["k"]), ["k"]).count() == 0
    report = {r.k: (r.months_total, r.train_months, r.status) for r in forecast.series_report(df, ["k"]).collect()}
    assert report == {"a": (10, None, "too short"), "b": (1, None, "too short")}


def test_exact_quantiles(spark, monkeypatch):
    """Several columns at once, in one pass and in many, with a heavy value, a far outlier and no values."""
    import random

    from tallyspark.operators import profile

    r = random.Random(1)
    columns = {
        "none": [], "one": [3.0], "two": [1.0, 2.0], "heavy": [5.0] * 1000 + [1.0], "far": [r.random() for _ in range(900)] + [1e300, -1e300],
        "mixed": [r.choice([r.random(), 0.5, float(r.randrange(9))]) for _ in range(3001)],
    }
    size = max(map(len, columns.values())) + 1
    df = spark.createDataFrame([tuple(v[i] if i < len(v) else None for v in columns.values()) for i in range(size)], ", ".join(f"{c} double" for c in columns))
    bounds = {c: (len(v), min(v, default=None), max(v, default=None)) for c, v in columns.items()}

    def at(values, q):
        i = q * (len(values) - 1)
        return values[int(i)] + (values[min(int(i) + 1, len(values) - 1)] - values[int(i)]) * (i - int(i))

    want = {c: [at(sorted(v), q) for q in profile.QUARTILES] if v else [None] * 3 for c, v in columns.items()}
    for bins, few in ((4096, 20_000), (64, 10), (2, 1)):
        monkeypatch.setattr(profile, "BINS", bins)
        monkeypatch.setattr(profile, "FEW", few)
        got = profile.exact_quantiles(df, bounds)
        assert {c: pytest.approx(v) if v[0] is not None else v for c, v in got.items()} == want


def test_cluster_names_take_the_first_matching_rule(spark):
    from tallyspark.functions import exprs

    rows = [(0, "0.40", "0.05", "10"), (1, "0.10", "0.30", "20"), (2, "0.40", "0.30", "90"), (3, "0.10", "0.05", "1"), (4, "0.10", "0.05", "95")]
    df = spark.createDataFrame([(i, Decimal(d), Decimal(m), Decimal(s)) for i, d, m, s in rows],
                               "segment_id int, discount decimal(4,2), profit_margin decimal(6,4), sales decimal(12,2)")
    got = {r.segment_id: r.segment_label for r in segment.label_segments(df).collect()}
    assert got == {0: exprs.SEG_DEEP_DISCOUNT, 1: exprs.SEG_FULL_PRICE, 2: exprs.SEG_PREMIUM, 3: exprs.SEG_SMALL, 4: exprs.SEG_MIXED}


def test_money_text_with_three_decimals_rounds(spark):
    df = spark.createDataFrame([("12.345",), ("12.344",), ("x",)], "s string")
    got = [r[0] for r in df.select(F.expr("try_cast(s AS decimal(12,2))")).collect()]
    assert got == [Decimal("12.35"), Decimal("12.34"), None]
