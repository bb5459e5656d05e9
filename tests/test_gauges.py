"""Gates, weights and calibration on hand-made cases, as the driver's tables don't reach each of their limits."""

import datetime as dt
import math

from pyspark.sql import functions as F

from barloom.operators import gauges, reports


def test_gates_and_weights(spark):
    rows = [(8.0, 10.0, 2.0, 10.0), (7.0, 10.0, 0.0, 10.0), (9.0, 10.0, 3.0, 10.0), (0.0, 0.0, 0.0, 5.0), (0.0, 0.0, 0.0, 0.0)]
    g = spark.createDataFrame(rows, "a double, b double, c double, d double").coalesce(1).select(gauges.quality_gate(*map(F.col, "abcd")).alias("x")).collect()
    assert [r.x for r in g] == [True, False, False, False, True]
    rows = [(0.1, 0.1, False), (0.013, 0.506, False), (0.3, -0.2, False), (0.1, 0.1, True), (0.0, 0.5, True), (None, None, False), (0.1, 0.3, None)]
    w = spark.createDataFrame(rows, "p double, o double, r boolean").coalesce(1).select(gauges.ensemble_weight(F.col("p"), F.col("o"), F.col("r")).alias("w")).collect()
    assert [round(r.w, 3) for r in w] == [0.5, 0.9, 0.2, 0.65, 0.9, 0.2, 0.75]
    k = spark.createDataFrame([(-0.08,), (-0.081,), (None,)], "c double").coalesce(1).select(gauges.pooled_usable(F.col("c")).alias("u")).collect()
    assert [r.u for r in k] == [True, False, True]


def test_event_scores(spark):
    rows = [(True, 0, 0, 9, 0), (False, 2, 1, 4, 2), (False, 5, 3, 3, 3), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "h boolean, e int, d int, n int, s int").coalesce(1)
    v = gauges.event_volatility(F.col("h"), F.col("e"), F.col("d"), F.col("n"))
    got = [(round(r.v, 6), round(r.s, 6)) for r in df.select(v.alias("v"), gauges.event_sentiment(F.col("h"), F.col("n"), F.col("s"), v).alias("s")).collect()]
    assert got == [(2.0, -0.25), (1.0, -0.05), (0.3, 0.0), (0.0, 0.0)]


def test_composites(spark):
    df = spark.createDataFrame([(10.0, 4.0, 110.0, 120.0, 100.0), (None, 0.0, None, 0.0, 100.0), (0.0, None, 50.0, 80.0, 0.0)], "e double, r double, t double, c double, p double").coalesce(1)
    score, confidence = gauges.estimate_composite(*map(F.col, "ertcp"))
    got = [(round(r.s, 6), round(r.c, 6)) for r in df.select(score.alias("s"), confidence.alias("c")).collect()]
    # All four; none; without a price only the estimate says something, and a target and a consensus count as 0.
    assert got == [(0.56, 0.25), (0.0, 0.0), (round(-0.3 / 0.7, 6), 0.175)]


def test_calibration_is_the_greatest_likelihood(spark):
    """Newton's method in plain Python gives the same sigmoid."""
    data = [(x / 10, 1.0 if (x * 7) % 10 < 5 + x / 8 else 0.0) for x in range(-30, 31)]
    slope, intercept = gauges.platt(spark.createDataFrame(data, "x double, y double"), "x", "y")
    a = b = 0.0
    for _ in range(50):
        p = [1 / (1 + math.exp(-(a * x + b))) for x, _ in data]
        ga, gb = sum((y - q) * x for (x, y), q in zip(data, p)), sum(y - q for (_, y), q in zip(data, p))
        w = [q * (1 - q) for q in p]
        haa, hab, hbb = sum(v * x * x for (x, _), v in zip(data, w)), sum(v * x for (x, _), v in zip(data, w)), sum(w)
        det = haa * hbb - hab * hab
        a, b = a + (ga * hbb - gb * hab) / det, b + (gb * haa - ga * hab) / det
    assert math.isclose(slope, a, rel_tol=1e-3) and math.isclose(intercept, b, rel_tol=1e-3, abs_tol=1e-4)


def test_sessions_wrap(spark):
    name, share = gauges.session_position(F.col("m"))
    got = [(r.n, round(r.s, 4)) for r in spark.createDataFrame([(239,), (240,), (765,), (1199,), (1200,), (0,)], "m int").coalesce(1).select(name.alias("n"), share.alias("s")).collect()]
    assert got == [("overnight", 0.9979), ("pre", 0.0), ("regular", 0.5), ("after", 0.9958), ("overnight", 0.0), ("overnight", 0.5)]


def test_holidays_are_closed(spark):
    """Noon in New York on Martin Luther King's day, a day later, a weekend; and without holidays."""
    df = spark.createDataFrame([(dt.datetime(2025, 1, 20, 17),), (dt.datetime(2025, 1, 21, 17),), (dt.datetime(2025, 1, 25, 17),)], "t timestamp").coalesce(1)
    got = df.select(reports.session_of(F.col("t")).alias("a"), reports.session_of(F.col("t"), ()).alias("b")).collect()
    assert [tuple(r) for r in got] == [("closed", "regular"), ("regular", "regular"), ("closed", "closed")]
