"""Window primitives, as-of joins and calendars against pandas and by hand."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import windows
from barloom.functions.columns import any_date, clip, erf, gaussian_cdf, scaled_number
from barloom.operators.asof import asof_join, densify

DAY = dt.date(2024, 1, 1)


def frame(spark, values, name="x"):
    return spark.createDataFrame([("A", DAY + dt.timedelta(days=i), i + 1, v) for i, v in enumerate(values)], f"ticker string, date date, _row int, {name} double")


def column(df, name):
    return [r[name] for r in df.orderBy("date").collect()]


def same(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert (g is None) == bool(pd.isna(w)) and (g is None or abs(g - w) < 1e-9), (got, list(want))


SERIES = [1.0, 2.5, None, 2.0, 4.0, 4.0, None, 3.0, 7.0, 6.5, 6.0]


def test_rolling_matches_pandas(spark):
    df, s = frame(spark, SERIES), pd.Series(SERIES, dtype=float)
    for fn, name in ((F.avg, "mean"), (F.stddev_samp, "std"), (F.sum, "sum"), (F.max, "max")):
        same(column(df.withColumn("y", windows.rolling(fn, "x", 4, 2)), "y"), getattr(s.rolling(4, min_periods=2), name)())
    same(column(df.withColumn("y", windows.rolling_quantile("x", 0.7, 5, 3)), "y"), s.rolling(5, min_periods=3).quantile(0.7))


def test_exponential_means_match_pandas(spark):
    df, s = frame(spark, [None, *SERIES]), pd.Series([np.nan, *SERIES], dtype=float)
    for adjust in (False, True):
        got = windows.exponential_mean(df, "ticker", "date", {"y": ("x", 3, 2)}, adjust=adjust)
        same(column(got, "y"), s.ewm(span=3, adjust=adjust, min_periods=2).mean())
    seeded = windows.exponential_mean(frame(spark, [1.0, 2.0, 3.0, 6.0]), "ticker", "date", {"y": ("x", 3, 1)}, seeded=True)
    same(column(seeded, "y"), [np.nan, np.nan, 2.0, 4.0])


def test_runs_and_ranks(spark):
    df = frame(spark, [1.0, 2.0, 3.0, 3.0, 2.0, 1.0, 5.0])
    got = windows.run_length(df, F.col("x") - windows.lag("x"), "run")
    assert column(got, "run") == [0, 1, 2, 0, -1, -2, 1]
    rows = [("d", float(v) if v else None) for v in (3, 1, 3, None, 2)]
    ranked = spark.createDataFrame(rows, "date string, x double").withColumn("p", windows.percent_rank_shared("x", "date"))
    want = pd.Series([3, 1, 3, np.nan, 2]).rank(pct=True)
    same(sorted((r.p for r in ranked.collect()), key=lambda v: (v is None, v)), sorted(want, key=lambda v: (pd.isna(v), v)))


@pytest.mark.parametrize("n", [4, 5, 7, 75])
def test_quintiles(spark, n):
    df = spark.range(1, n + 1).select(F.col("id").alias("r")).withColumn("q", windows.quintile(F.col("r"), F.lit(n)))
    assert [r.q for r in df.orderBy("r").collect()] == [min(5, 1 + int((r - 1) / max(1, n / 5))) for r in range(1, n + 1)]


def test_no_lookahead(spark):
    """Rows up to a day don't change when later ones go."""
    from barloom.operators import prices

    rng = np.random.default_rng(3)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 90)))
    rows = [("A", DAY + dt.timedelta(days=i), float(c), float(c * 1.01), float(c * 0.99), float(c), float(100 + i % 7)) for i, c in enumerate(close)]
    bars = spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume double")
    build = lambda b: prices.regimes(prices.rsi_divergence(prices.rsi(prices.macd(prices.trend(prices.volume(prices.returns(b)))))))
    cut = DAY + dt.timedelta(days=59)
    whole = build(bars).where(F.col("date") <= F.lit(cut)).orderBy("date").collect()
    assert build(bars.where(F.col("date") <= F.lit(cut))).orderBy("date").collect() == whole


def test_asof_join(spark):
    d = lambda k: DAY + dt.timedelta(days=k)
    left = spark.createDataFrame([("A", d(k)) for k in (0, 2, 5, 9)] + [("B", d(5))], "ticker string, date date")
    right = spark.createDataFrame([("A", d(2), 1.0), ("A", d(2), 2.0), ("A", d(6), 3.0), ("C", d(0), 9.0)], "ticker string, date date, v double")
    at = lambda **k: {(r.ticker, (r.date - DAY).days): r.v for r in asof_join(left, right, "date", ["ticker"], **k).collect()}
    assert at() == {("A", 0): None, ("A", 2): 2.0, ("A", 5): 2.0, ("A", 9): 3.0, ("B", 5): None}
    assert at(inclusive=False)[("A", 2)] is None
    assert at(direction="forward") == {("A", 0): 2.0, ("A", 2): 2.0, ("A", 5): 3.0, ("A", 9): None, ("B", 5): None}
    assert at(tolerance=2)[("A", 5)] is None
    assert at(direction="nearest")[("A", 5)] == 3.0


def test_densify(spark):
    df = spark.createDataFrame([("A", DAY, 1.0), ("A", DAY + dt.timedelta(days=3), 2.0)], "ticker string, date date, x double")
    assert column(densify(df, ["ticker"], "date"), "x") == [1.0, None, None, 2.0]


def test_columns(spark):
    import math

    df = spark.createDataFrame([("$1.5B", "03/04/2024", 0.3), ("12,345", "2024-03-04", -1.2), ("4%", "x", None)], "s string, d string, x double")
    rows = df.select(scaled_number("s").alias("n"), any_date("d").alias("d"), erf(F.col("x")).alias("e"), clip("x", -1, 0).alias("c"), gaussian_cdf(F.col("x"), F.lit(1.0)).alias("g")).collect()
    assert [r.n for r in rows] == [1.5e9, 12345.0, 4.0]
    assert [r.d for r in rows] == [dt.date(2024, 3, 4)] * 2 + [None]
    assert abs(rows[0].e - math.erf(0.3)) < 2e-7 and abs(rows[1].e - math.erf(-1.2)) < 2e-7
    assert [r.c for r in rows] == [0.0, -1.0, None] and rows[1].g == 0.15 and rows[2].g is None
