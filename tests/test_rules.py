"""Rules with limits: exact tests of hits, splits, drift, changes worth storing, flows of statements."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from barloom.operators import blends, evaluation, fundamentals, gauges, modelling, reports
from barloom.sources import tables

DAY = dt.date(2024, 1, 1)
NOW = dt.datetime(2024, 1, 10, 12)


def tail(k: int, n: int, p: float) -> float:
    return math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))


def bound(k: int, n: int, target: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if tail(k, n, middle) < target else (low, middle)
    return low


def test_binomial_tests_and_intervals(spark):
    cases = [(0, 1), (1, 1), (0, 10), (5, 10), (10, 10), (9, 9), (3, 9), (7, 19), (12, 20), (260, 500), (240, 500), (990, 1000), (1, 1000)]
    df = spark.createDataFrame(cases, "k int, n int")
    low, high = evaluation.exact_interval(F.col("k"), F.col("n"))
    a, b = evaluation.exact_interval(F.col("k"), F.col("n"), one_sided=False)
    rows = df.select("k", "n", evaluation.binomial_tail(F.col("k"), F.col("n")).alias("p"), evaluation.accuracy_test(F.col("k"), F.col("n")).alias("t"), evaluation.gate_p(F.col("k"), F.col("n")).alias("g"), low.alias("low"), high.alias("high"), a.alias("a"), b.alias("b")).collect()
    for r in rows:
        want = tail(r.k, r.n, 0.5)
        assert abs(r.p - want) < 1e-10
        assert (r.t is None) == (r.n < 10) and r.g == (r.p if r.n >= 20 else 1.0)
        assert abs(r.low - (bound(r.k, r.n, 0.05) if r.k else 0.0)) < 1e-9 and r.high == 1.0
        assert abs(r.a - (bound(r.k, r.n, 0.025) if r.k else 0.0)) < 1e-9 and abs(r.b - (bound(r.k + 1, r.n, 0.975) if r.k < r.n else 1.0)) < 1e-9
    worse = next(r for r in rows if (r.k, r.n) == (240, 500))
    assert worse.p > 0.8  # worse than chance proves nothing
    thirds = df.select("k", "n", evaluation.binomial_tail(F.col("k"), F.col("n"), 1 / 3).alias("p")).collect()
    assert all(abs(r.p - tail(r.k, r.n, 1 / 3)) < 1e-10 for r in thirds)


@pytest.mark.parametrize(("n", "horizon"), [(49, 1), (50, 1), (90, 5), (100, 5), (299, 21), (300, 21), (120, 20)])
def test_split_has_gaps_behind_its_parts(spark, n, horizon):
    df = spark.createDataFrame([("A", DAY + dt.timedelta(days=i), i) for i in range(n)], "ticker string, date date, i int")
    got = {r.i: r.part for r in modelling.split_in_time(df, horizon).collect()}
    if n < 50 or (horizon >= 21 and n < 300):
        assert not got
        return
    gap = max(7, horizon) + 3
    a = max(30, int(n * 0.7))
    b = min(max(a + gap + 10, int(n * 0.85)), n)
    want = {i: "train" if i < a else "validation" if a + gap <= i < b else "test" if i >= b + gap else None for i in range(n)}
    assert got == want


def test_start_without_a_test(spark):
    df = spark.createDataFrame([("A", DAY + dt.timedelta(days=i), "train") for i in range(10)], "ticker string, date date, part string")
    assert gauges.out_of_sample_start(df, df).first().start == DAY + dt.timedelta(days=8)


def test_drift_statuses(spark):
    rows = []
    for d in range(91):
        day, recent = DAY + dt.timedelta(days=d), d >= 70
        up = d % 2 == 0
        rows.append(("steady", day, 0.1 if up else -0.1, 0.1 if up else -0.1, 0.8 if up else 0.2))
        rows.append(("wrong", day, 0.1 if up else -0.1, (-1 if recent else 1) * (0.1 if up else -0.1), 0.5))
        rows.append(("shifted", day, 5.0 + d / 100 if recent else d / 100, 1.0, 0.9))
        rows.append(("blurred", day, 0.1 if up else -0.1, 0.1 if up else -0.1, (0.4 if up else 0.6) if recent else (0.9 if up else 0.1)))
        if d >= 86:
            rows.append(("short", day, 1.0, 1.0, 0.5))
    df = spark.createDataFrame(rows, "k string, date date, prediction double, realised double, p double")
    got = {r.k: r for r in evaluation.drift(df, ["k"], "date", 60).collect()}
    assert {k: r.status for k, r in got.items()} == {"steady": "OK", "wrong": "WARNING", "shifted": "WARNING", "blurred": "WARNING", "short": "insufficient_data"}
    assert got["wrong"].alerts == ["accuracy"] and "high psi" in got["shifted"].alerts and got["blurred"].alerts == ["brier"] and got["short"].psi is None
    assert got["steady"].base_accuracy == 1.0 and got["wrong"].recent_accuracy == 0.0 and got["steady"].n == 91


def test_changes_worth_storing(spark):
    at = lambda minutes: NOW - dt.timedelta(minutes=minutes)
    stored = spark.createDataFrame([("a", at(30), 0.50, 0.1), ("a", at(90), 9.0, 9.0), ("b", at(61), 0.5, 0.1), ("c", at(60), 0.5, None), ("d", at(5), None, 0.2), ("e", at(10), 0.5, 0.1), ("e", NOW - dt.timedelta(days=31), 1.0, 1.0)], "k string, ts timestamp, x_sentiment double, y_sentiment double")
    new = spark.createDataFrame([("a", NOW, 0.55, 0.1, 1), ("b", NOW, 0.5, 0.1, 1), ("c", NOW, 0.5, 0.06, 1), ("d", NOW, 0.04, 0.2, 1), ("e", NOW, 0.56, 0.1, 1), ("f", NOW, None, None, 1)], "k string, ts timestamp, x_sentiment double, y_sentiment double, extra int")
    kept = {r.k for r in tables.changed(stored, new, ["k"], "ts").collect()}
    # a: .05 isn't more than .05, as 0.55 - 0.50 is in binary; decided as the same subtraction in doubles
    assert kept == {"b", "c", "e", "f"} | ({"a"} if 0.55 - 0.50 > 0.05 else set())
    sink = tables.store_changed(stored, new, ["k"], "ts").collect()
    assert sum(r.k == "e" for r in sink) == 2 and min(r.ts for r in sink if r.k == "e") == at(10)  # the old row of a key that wrote went


def test_sources_that_count(spark):
    rows = [("T", "rss_news", 0.5, 10.0), ("T", "finviz", 0.0, 3.0), ("T", "economic_event", 0.9, 7.0), ("T", "short_interest", 0.9, 2.0), ("T", "reddit", 0.4, 5.0), ("T", "marketaux", None, 4.0)]
    r = blends.blended_confidence(spark.createDataFrame(rows, "ticker string, source string, confidence double, volume double"), ["ticker"]).first()
    assert (r.sources, r.articles, r.volume) == (2, 17.0, 31.0)


def test_outlook_at_its_limits(spark):
    rows = [(100.0, 2.0, None, None), (100.0, 2.1, -9.0, 1.0), (100.0, None, 0.5, 9.0), (100.0, None, None, 0.6), (100.0, -0.5, None, None), (100.0, -2.0, None, None), (100.0, -2.1, None, None), (0.0, 5.0, None, None), (100.0, None, None, None), (100.0, 0.0, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "price double, a double, b double, c double")
    got = [r[0] for r in df.select(reports.outlook(F.col("price"), [F.col("a"), F.col("b"), F.col("c")])).collect()]
    assert got == ["Slightly Bullish", "Bullish", "Neutral", "Slightly Bullish", "Neutral", "Slightly Bearish", "Bearish", "Neutral", "Neutral", "Neutral"]
    sure = spark.createDataFrame([(0.5, None, 0.75), (None, 0.0, None), (0.999, None, None)], "a double, b double, c double")
    assert [r[0] for r in sure.select(reports.mean_confidence([F.col("a"), F.col("b"), F.col("c")])).collect()] == [62, 50, 99]


def test_band_and_confidence(spark):
    df = spark.createDataFrame([(100.0, 0.0, 0.1, 0.2), (100.0, 0.0, 0.0, 0.2), (100.0, 0.0, -0.1, 0.2), (100.0, 0.0, None, 0.2)], "p double, m double, q double, s double")
    low, high = modelling.price_band(*[F.col(c) for c in "pmqs"])
    assert [round(math.log(r[0] / 100), 9) for r in df.select(high, low).collect()] == [0.1, 0.4, 0.4, 0.4]
    one = spark.range(1)
    full = lambda hit, c, **more: round(one.select(modelling.full_confidence(F.lit(hit), F.lit(c), F.lit(0.5), F.lit(0.0), F.lit(0.0), F.lit(False), F.lit(1.0), F.lit(False), **{k: F.lit(v) for k, v in more.items()})).first()[0], 6)
    assert full(0.4, -1.0) == 0.05 and full(0.9, 1.0) == round(0.65 * 0.85, 6)
    assert full(0.9, 1.0, regime=-0.5) == round(0.65 * 0.85 * 0.95, 6) and full(0.9, 1.0, regime=-3.0) == round(0.65 * 0.85 * 0.9, 6)
    assert full(0.9, 1.0, vol_ratio=2.5) == round(0.65 * 0.85 * 0.95, 6) and full(0.9, 1.0, vol_ratio=9.0) == round(0.65 * 0.85 * 0.9, 6)


FIELDS = "symbol string, segments map<string,double>, revenue double, costOfRevenue double, grossProfit double, grossProfitRatio double, operatingExpenses double, researchAndDevelopmentExpenses double, sellingGeneralAndAdministrativeExpenses double, operatingIncome double, totalOtherIncomeExpensesNet double, incomeBeforeTax double, incomeTaxExpense double, netIncome double"


def test_flows(spark):
    rows = [
        ("seg", {"Cloud Segment": 60.0, "Ads": 34.0, "Lost": -1.0}, 100.0, 40.0, None, None, 30.0, 10.0, 15.0, 99.0, -8.0, None, 4.0, 12.0),
        ("five", {"All": 95.0}, 100.0, None, 70.0, None, 80.0, 50.0, 40.0, 20.0, 5.0, 3.0, -1.0, 9.0),
        ("ratio", None, 100.0, None, None, 0.25, None, None, None, 20.0, 0.0, 30.0, None, -5.0),
        ("none", None, None, None, None, None, None, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, FIELDS)
    got = {}
    for r in fundamentals.flow_links(df).collect():
        got.setdefault(r.symbol, {})[r.source, r.target] = r.value
    assert got["seg"] == {
        ("Cloud", "Total Revenue"): 60.0, ("Ads", "Total Revenue"): 34.0, ("Other Revenue", "Total Revenue"): 6.0, ("Total Revenue", "Cost of Revenue"): 40.0, ("Total Revenue", "Gross Profit"): 60.0,
        ("Gross Profit", "Operating Expenses"): 30.0, ("Operating Expenses", "R&D"): 10.0, ("Operating Expenses", "SG&A"): 15.0, ("Operating Expenses", "Other OpEx"): 5.0, ("Gross Profit", "Operating Income"): 30.0,
        ("Operating Income", "Other/Interest Expense"): 8.0, ("Operating Income", "Income Before Tax"): 22.0, ("Income Before Tax", "Taxes"): 4.0, ("Income Before Tax", "Net Income"): 12.0,
    }
    # Exactly 5 % has no rest; expenses above gross profit leave no operating income; parts above the whole are as stated.
    assert got["five"] == {
        ("All", "Total Revenue"): 95.0, ("Total Revenue", "Cost of Revenue"): 30.0, ("Total Revenue", "Gross Profit"): 70.0, ("Gross Profit", "Operating Expenses"): 80.0, ("Operating Expenses", "R&D"): 50.0,
        ("Operating Expenses", "SG&A"): 40.0, ("Other/Interest Income", "Income Before Tax"): 5.0, ("Income Before Tax", "Net Income"): 3.0,
    }
    assert got["ratio"] == {("Sales/Operations", "Total Revenue"): 100.0, ("Total Revenue", "Cost of Revenue"): 75.0, ("Total Revenue", "Gross Profit"): 25.0, ("Gross Profit", "Operating Income"): 20.0, ("Operating Income", "Income Before Tax"): 20.0}
    assert "none" not in got
    nodes = {(r.symbol, r.node): (r.kind, r.value) for r in fundamentals.flow_nodes(df).collect()}
    assert nodes["seg", "Cloud"] == ("segment", 60.0) and nodes["seg", "Total Revenue"] == ("revenue", 100.0) and nodes["five", "Gross Profit"] == ("profit", 70.0)
    assert nodes["five", "Operating Income"] == ("profit", 0.0) and nodes["five", "Total Revenue"][1] == 100.0 and sum(s == "none" for s, _ in nodes) == 7
