"""Known totals of the derived views at sf0.01 (FIXTURES sections 3.1 and 3.3)."""

from pyspark.sql import functions as F

from tallyspark.operators import business, clean
from tallyspark.registry import Star

SF = "/root/testdata/sf0.01"


def test_star_totals(spark):
    o = Star(spark, SF).orders
    r = o.agg(F.count(F.lit(1)), F.sum("sales"), F.sum("profit"), F.min("profit"), F.sum("discount")).first()
    assert r[0] == 60000
    assert str(r[1]) == "3183256271.63"
    assert str(r[2]) == "457680628.41"
    assert str(r[3]) == "-2094.02"
    assert str(r[4]) == "11980.44"


def test_q5_tiers(spark):
    rows = business.q5_discount_tiers(Star(spark, SF).orders).collect()
    assert [r.num_orders for r in rows] == [2941, 12032, 18170, 11921, 14936]
    assert [r.avg_profit_margin for r in rows] == [0.1782, 0.1695, 0.1508, 0.1337, 0.1160]


def test_cleaning_counts(spark):
    raw = Star(spark, SF).raw_export
    counts = clean.drop_counts(raw).first()
    assert (counts.raw_rows, counts.distinct_rows, counts.usable_rows, counts.usable_rows_strict) == \
        (14807, 14743, 14691, 14250)
    c = clean.clean(raw)
    assert c.orders.count() == 14691
    assert c.orders.where(F.col("ship_mode") == "Standard Class").count() == 5966
    assert c.orders.agg(F.sum("delivery_days")).first()[0] == 31762
