"""Columns that must not depend on the order of rows or on Java's rounding, and texts that are read once."""

from functools import reduce
from operator import add

from pyspark.sql import functions as F

from barloom.functions import columns, text


def test_two_decimals_round_the_exact_value(spark):
    """F3 of round 3."""
    values = [0.125, 0.375, 2.675, 1.005, 0.005, -2.5, -0.001, 0.995, 999.995, 0.0, 75.685, 123456.785, 5e-324, *[i / 1000 for i in range(5, 9000, 10)], *[i / 8 for i in range(1, 99, 2)]]
    rows = spark.createDataFrame([(x,) for x in values], "x double").select("x", columns.two_decimals(F.col("x")).alias("t"), F.format_string("%.2f", "x").alias("java")).collect()
    assert all(r.t == f"{r.x:.2f}" for r in rows) and any(r.java != r.t for r in rows)
    shown = spark.createDataFrame([(None,), (1.5e9,), (2.345e6,), (12.0,), (-7e12,)], "x double").select(columns.human_money("x")).collect()
    assert [r[0] for r in shown] == [None, "$1.50B", f"${2.345:.2f}M", "$12.00", "$-7.00T"]


def test_mean_at_the_limit_is_not_above_it(spark):
    """F2 of round 3: sums of doubles make the first mean 50.00000000000001."""
    at = [6.73, 104.4, 68.4, 23.98, 60.57, 35.92]
    assert reduce(add, at) / 6 > 50
    rows = [("at", x) for x in at] + [("above", x) for x in at] + [("above", 50.01), ("tiny", 50.0), ("tiny", 50.0 + 1e-13), ("none", None), ("inf", float("inf")), ("nulls", None), ("nulls", 51.0)]
    got = spark.createDataFrame(rows, "k string, x double").groupBy("k").agg(columns.mean_above("x", 50).alias("a")).collect()
    assert {r.k: r.a for r in got} == {"at": False, "above": True, "tiny": True, "none": None, "inf": True, "nulls": True}


def test_hits_lower_a_text_once(spark):
    """F6 of round 3: inside a lambda the text was lower-cased for each word."""
    df = spark.createDataFrame([("Strong LOSS, losses; growth", 2, 1), (None, None, None), ("", 0, 0)], "t string, p int, n int")
    score = [text.hits(F.col("t"), w) for w in (text.POSITIVE, text.NEGATIVE)]
    assert all((r[0], r[1]) == (r.p, r.n) for r in df.select(*score, "p", "n").collect())
    assert "lambda" not in df.select(*score)._jdf.queryExecution().toString()
