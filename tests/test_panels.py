"""Filled panels, facts, sessions, requests and figures of reports on hand-made cases, with nulls, ties and empty tables."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from barloom.functions.columns import SECTOR_IDS, sector_id
from barloom.operators import blends, fundamentals, modelling, news, panels, reports
from barloom.sources.tables import unexpired

D = dt.date(2024, 1, 1)


def day(n: int) -> dt.date:
    return D + dt.timedelta(days=n)


def test_gaps_are_filled_both_ways(spark):
    rows = [("a", day(0), None), ("a", day(1), 10.0), ("a", day(2), None), ("a", day(3), 12.0), ("b", day(0), None), ("c", day(0), 0.0), ("c", day(1), 5.0)]
    got = {(r.ticker, r.date): r for r in panels.cleaned(spark.createDataFrame(rows, "ticker string, date date, close double")).collect()}
    assert [got["a", day(i)].close for i in range(4)] == [10.0, 10.0, 10.0, 12.0]
    assert got["a", day(3)].returns == pytest.approx(0.2) and got["a", day(3)].log_returns == pytest.approx(math.log(1.2))
    assert got["b", day(0)].close is None and got["c", day(1)].returns is None and got["a", day(0)].day_of_week == 0 and got["a", day(3)].volatility is None
    assert panels.cleaned(spark.createDataFrame([], "ticker string, date date, close double")).count() == 0


def test_indicators(spark):
    rows = [("GS10", day(0), 1.0), ("GS10", day(1), float("nan")), ("GS10", day(2), 3.0), ("GS10", day(2), 2.0), ("XX", day(0), 1.0), ("GS2", day(0), None), ("UNRATE", day(1), 4.0)]
    long = panels.indicator_series(spark.createDataFrame(rows, "code string, date date, value double"))
    assert sorted((r.indicator, r.value) for r in long.collect()) == [("TREASURY_10Y", 1.0), ("TREASURY_10Y", 2.0), ("TREASURY_10Y", 3.0), ("UNEMPLOYMENT", 4.0)]
    assert sorted((r.indicator, r.date, r.value, r.change) for r in panels.latest_indicators(long).collect()) == [("TREASURY_10Y", day(2), 3.0, 2.0), ("UNEMPLOYMENT", day(1), 4.0, None)]
    assert len(panels.INDICATORS) == 13


def test_held_returns(spark):
    closes = spark.createDataFrame([("a", day(0), 10.0), ("a", day(4), 20.0), ("b", day(2), 5.0)], "ticker string, date date, close double")
    market = spark.createDataFrame([(day(0), 100.0), (day(9), 110.0)], "date date, market_close double")
    trades = spark.createDataFrame([(1, "a", day(1), day(30)), (2, "b", day(0), day(3)), (3, "x", day(1), day(2)), (4, None, None, None)], "id int, ticker string, entry date, exit date")
    got = {r.id: r for r in panels.held_returns(trades, closes, market).collect()}
    assert len(got) == 4 and (got[1].entry_close, got[1].exit_close) == (10.0, 20.0)
    assert got[1].excess_return == pytest.approx(math.log(2) - math.log(1.1))
    assert got[2].entry_close is None and got[2].held_return is None and got[3].held_return is None


def test_mentions(spark):
    t = lambda n: dt.datetime(2024, 1, 10) - dt.timedelta(hours=n)
    rows = [("f", "x", t(1), ["a", "A"], None, None), ("f", "x", t(2), None, ["a"], None), ("g", "x", t(0), None, None, "A"), ("f", "", t(0), None, None, "a"), ("f", None, t(3), None, None, "a"), ("f", "old", t(500), ["a"], None, None), ("f", "none", t(1), None, None, None)]
    rows += [("f", f"n{i:02}", t(10 + i), ["a"], None, None) for i in range(9)]
    df = spark.createDataFrame(rows, "feed string, title string, published_at timestamp, tickers array<string>, symbols array<string>, ticker string")
    got = panels.mentions(df, F.lit(dt.datetime(2024, 1, 10))).collect()
    # Two articles of the feed without a title and two of the same one leave room for four others among its eight.
    assert sorted((r.ticker, r.feed, r.title) for r in got) == [("A", "f", "n00"), ("A", "f", "n01"), ("A", "f", "n02"), ("A", "f", "n03"), ("A", "g", "x")]


def test_predictions_of_windows(spark):
    part = lambda rows: spark.createDataFrame(rows, "ticker string, price_change double, current_price double")
    long = panels.windows_long({"next_day": part([("a", 1.0, 100.0), ("b", -3.0, 100.0), ("z", 1.0, 0.0)]), "7_day": part([("a", None, 100.0), ("c", 3.0, 100.0)]).withColumn("more", F.lit(1))})
    assert sorted((r.ticker, r.window, r.more) for r in long.collect())[:2] == [("a", "7_day", 1), ("a", "next_day", None)]
    assert {r.ticker: (r.mean_change, r.windows) for r in panels.mean_predicted_change(long, ["ticker"]).collect()} == {"a": (0.5, 2), "b": (-3.0, 1), "c": (3.0, 1), "z": (0.0, 1)}
    assert [(r.ticker, r.window, r.shown) for r in panels.top_mover(long, []).collect()] == [("b", "next_day", "-3.00%")]
    assert panels.top_mover(long.where("ticker = 'z'"), []).count() == 0


def test_report_distances(spark):
    days = spark.createDataFrame([("a", day(0)), ("a", day(5)), ("a", day(5)), ("a", day(200)), ("b", day(1))], "ticker string, day date")
    told = spark.createDataFrame([("a", day(5)), ("a", day(5)), ("a", day(8)), ("a", None)], "ticker string, date date")
    got = sorted((r.ticker, r.day, r.has_today, r.days_to_next, r.days_since_last) for r in panels.report_distances(days, told).collect())
    assert got == [("a", day(0), 0, 5, 90), ("a", day(5), 1, 3, 90), ("a", day(200), 0, 90, 90), ("b", day(1), 0, 90, 90)]


def test_arrays_of_reports(spark):
    df = spark.createDataFrame([(["n"], ["o", "p"]), (None, ["o"]), (None, None)], "u array<string>, p array<string>")
    assert [r.a for r in df.select(panels.all_reports(df, "u", "p").alias("a")).collect()] == [["n", "o", "p"], ["o"], []]


def test_composites_fall_back(spark):
    rows = [(1, 1, 0.9, 0.1, 0.2, {"x": 0.3}, 5.0, 1.0), (2, 1, None, 0.1, 0.2, None, None, 1.0), (3, 1, None, None, 0.2, {"x": 0.3}, None, None), (4, 1, None, None, None, {"x": 0.3, "y": None, "z": 0.5}, None, 0.0), (5, 1, None, None, None, None, None, None), (6, 1, 0.1, None, None, None, 1.0, None), (6, 2, 0.2, None, None, None, 2.0, None)]
    df = spark.createDataFrame(rows, "k int, t int, composite_sentiment double, blended_sentiment double, rss_sentiment double, sources map<string,double>, news_count double, finviz_volume double")
    got = {r.k: (r.composite_sentiment, r.news_count) for r in blends.sentiment_series(df, ["k"], "t").collect()}
    assert got == {1: (0.9, 5), 2: (0.1, 1), 3: (0.2, 1), 4: (0.4, 0), 5: (0.0, 1), 6: (0.2, 2)}
    bare = blends.sentiment_series(df.select("k", "t"), ["k"], "t").collect()
    assert len(bare) == 6 and {(r.composite_sentiment, r.news_count) for r in bare} == {(0.0, 1)}


def test_filing_confidence(spark):
    rows = [("a", 0.3, "10-K", 2000), ("a", None, "4", 10), ("b", None, None, None), ("c", -0.3, "S-8", None), ("c", 0.3, "144", 500)]
    got = {r.k: r for r in blends.filing_confidence(spark.createDataFrame(rows, "k string, score double, form string, length int"), ["k"]).collect()}
    assert got["a"].confidence == pytest.approx(0.25 / 8 + 0.1 + 0.25 + 0.2 + 0.1)
    assert got["b"].confidence == pytest.approx(0.25 + 0.1) and got["b"].score == 0.0
    dev = math.sqrt(0.18)
    assert got["c"].confidence == pytest.approx(0.25 * 2 / 8 + 0.2 + 0.25 * (1 - dev / 0.5) + 0.2 * (0.25 + 0.35) / 2)


def test_facts(spark):
    columns = "symbol string, fact string, unit string, val double, start string, end string, filed string, form string, frame string, fy int, fp string"
    f = lambda *rows: fundamentals.normalise(spark.createDataFrame([("s", fact, "USD", v, a, b, filed, form, frame, fy, fp) for fact, v, a, b, filed, form, frame, fy, fp in rows], columns))
    q = f(
        ("A", 1.0, "2023-01-01", "2023-03-31", "2023-05-01", "10-Q", None, 2023, "q1"),  # 50 + 15 + 10 + 2 + 2
        ("B", 2.0, "2023-01-01", "2023-03-31", "2023-05-01", "10-Q", "CY2023Q1", None, None),  # 50 + 20 + 10 + 2 + 1
        ("A", 3.0, "2023-10-01", "2023-12-31", None, "10-K", None, 2023, "FY"),  # a year's label
        ("A", 4.0, "2023-12-31", "2023-12-31", None, "10-K", "CY2023Q4I", 2023, "Q4"),  # an instant
        ("A", 5.0, "2023-04-01", "2023-06-30", None, "8-K", None, None, None),  # no quarter
        ("C", 6.0, "2023-04-01", "2023-06-30", None, "8-K", None, 2023, "Q2"),  # no candidate
        ("A", None, "2023-07-01", "2023-09-30", None, "10-Q", None, 2023, "Q3"),
    )
    assert {r.val: (r.year, r.quarter, r.days) for r in q.where("val > 1").collect()} == {2.0: (2023, 1, 89), 3.0: (2023, 4, 91), 4.0: (2023, 4, None), 5.0: (None, None, 90), 6.0: (2023, 2, 90)}
    assert sorted((r.period, r.val, r.score) for r in fundamentals.best_quarters(q, {"A": 0, "B": 1}).collect()) == [("2023-06-30", 5.0, 52), ("2023-Q1", 2.0, 83)]
    year = ("2023-01-01", "2023-12-31")
    y = f(
        ("Revenues", 1.0, *year, "2024-02-01", "10-K", None, 2023, "FY"), ("SalesRevenueNet", 2.0, *year, "2024-03-01", "10-K", None, 2023, "FY"), ("Revenues", 3.0, *year, "2024-03-01", "10-K/A", None, 2023, "fy"),
        ("Revenues", 4.0, *year, "2024-09-01", "8-K", None, 2023, None), ("Assets", 5.0, None, "2023-12-31", None, "10-K", None, 2023, None), ("Assets", 6.0, "2023-10-01", "2023-12-31", None, "10-K", None, 2023, "FY"), ("Other", 7.0, *year, None, "10-K", None, 2023, "FY"),
    )
    assert {r.metric: r.val for r in fundamentals.annual_metrics(y).collect()} == {"revenue": 3.0, "assets": 5.0}
    assert len(fundamentals.METRICS) == 8 and fundamentals.annual_metrics(y.limit(0)).count() == 0


def test_sessions(spark):
    at = lambda *x: dt.datetime(*x)
    times = [at(2025, 7, 3, 13, 30), at(2025, 7, 4, 0, 0), at(2025, 7, 3, 7, 59), at(2025, 7, 3, 8, 0), at(2025, 12, 31, 23, 0), None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i int, t timestamp")
    name, opens, closes = reports.next_session(F.col("t"))
    got = {r.i: (r.n, r.o, r.c) for r in df.select("i", name.alias("n"), opens.alias("o"), closes.alias("c")).collect()}
    assert got[0] == ("after", at(2025, 7, 3, 16, 0), at(2025, 7, 3, 16, 0))  # 9:30 itself has begun
    assert got[1] == ("pre", at(2025, 7, 7, 4, 0), None)  # a holiday and a weekend lie between
    assert got[2] == ("pre", at(2025, 7, 3, 4, 0), None) and got[3] == ("regular", at(2025, 7, 3, 9, 30), at(2025, 7, 3, 9, 30))
    assert got[4] == ("pre", at(2026, 1, 2, 4, 0), at(2025, 12, 31, 20, 0)) and got[5] == (None, None, None)
    closed = tuple((dt.date(2025, 7, 3) + dt.timedelta(days=i)).isoformat() for i in range(20))
    assert df.where("i = 0").select(reports.next_session(F.col("t"), closed)[1].alias("o")).collect()[0].o is None


def test_requests(spark):
    rows = [([" aapl", "BRK.B"], 252), ([], 1), (None, 1), (["a"] * 11, 1), (["toolong1"], 1), (["a", "A "], 1), (["a"], 0), (["a"], 2521), (["a"], None), (["a", None], 1), (["a b"], 1)]
    df = spark.createDataFrame(rows, "t array<string>, d int").coalesce(1)
    plain, verdict = reports.request_verdict(F.col("t"), F.col("d"))
    got = df.select(plain.alias("p"), verdict.alias("v")).collect()
    assert [r.v for r in got] == ["ok", "empty", "empty", "many", "invalid", "duplicate", "days", "days", "days", "invalid", "invalid"] and got[0].p == ["AAPL", "BRK.B"]


def test_figures_of_reports(spark):
    df = spark.createDataFrame([(1, True, None, 5, 20, 0.3), (2, None, None, 0, None, None), (3, False, False, None, 4, 0.05)], "i int, a boolean, b boolean, t int, f int, c double").coalesce(1)
    got = df.select(reports.report_completeness([F.col("a"), F.col("b")], F.col("t"), F.col("f")).alias("x"), reports.model_quality([F.col("c"), F.lit(float("nan"))]).alias("q")).collect()
    assert [(round(r.x, 6), r.q) for r in got] == [(round((0.5 + 0.5 + 1) / 3, 6), "GOOD"), (0.0, "UNKNOWN"), (0.2, "LOW")]
    assert [(r.i, r.place) for r in reports.top_with_default(df, [], "t", 2, "i").collect()] == [(1, 1), (2, 2)]
    assert [(r.i, r.total, r.has_more) for r in reports.page(df, [F.col("i")], 2, 1).collect()] == [(2, 3, True)]
    assert [r.has_more for r in reports.page(df, [F.col("i")], 2, 2).collect()] == [False] and reports.page(df, [F.col("i")], 3, 2).count() == 0
    models = spark.createDataFrame([("w", True, 1.0, 2.0, None, None, True, None, True), ("w", True, 3.0, 2.0, 0.7, 0.4, False, True, None), ("w", None, 9.0, 9.0, None, None, True, True, True), ("v", False, 4.0, None, None, None, None, None, None)],
                                   "w string, has_holdout boolean, eval_rmse double, baseline_rmse double, hit_rate double, correlation double, beats_baseline boolean, beats_last_baseline boolean, production_ready boolean")
    s = {r.w: r for r in reports.holdout_summary(models, "w").collect()}
    assert (s["w"].models, s["w"].held, s["w"].rmse, s["w"].baseline, s["w"].hits, s["w"].correlation, s["w"].win_rate, s["w"].wins_last, s["w"].ready_rate) == (3, 2, 2.0, 2.0, 0.6, 0.2, 0.5, 2, 0.5)
    assert (s["v"].held, s["v"].rmse, s["v"].hits, s["v"].wins_last) == (0, 4.0, None, 0)


def test_levels(spark):
    rows = [("a", day(i), 100.0 + i % 2, 101.0 + i % 2, 99.0, 10.0 if i < 30 else 20.0) for i in range(31)]
    last = reports.technical_levels(spark.createDataFrame(rows, "ticker string, date date, close double, high double, low double, volume double")).where(F.col("date") == day(30)).collect()[0]
    assert last.from_sma20 == pytest.approx((100 / 100.5 - 1) * 100) and last.from_sma50 is None and last.from_high == pytest.approx((100 / 102 - 1) * 100) and last.from_low == pytest.approx((100 / 99 - 1) * 100)
    assert last.band_place == "middle" and last.volume_ratio == pytest.approx(20 / 10.5) and last.volume_label == "above average"


def test_variants(spark):
    """A feature that holds the label makes its variant better; a window without labels has no result."""
    rows = [("train" if i % 3 else "test", float(i % 7), float(i * 37 % 11), float(i % 7), None) for i in range(300)]
    df = spark.createDataFrame(rows, "part string, told double, noise double, y double, none double")
    got = {(r.window, r.variant): r for r in modelling.compare_variants(df, {"w": "y", "v": "none"}, {"with": ["told", "noise"], "without": ["noise"]}, rounds=3, depth=3).collect()}
    assert set(got) == {("w", "with"), ("w", "without")} and got["w", "with"].n == got["w", "without"].n == 100
    assert got["w", "with"].rmse < 0.5 * got["w", "without"].rmse
    assert modelling.compare_variants(df.limit(0), {"w": "y"}, {"with": ["told"]}).count() == 0


def test_article_filters(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [(1, "Bullish", t(0), "Tech", "Alpha", None, ["aapl", "X"]), (2, "bullish", t(9), "Health Care", None, "beta", ["X", "AAPL"]), (3, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "i int, sentiment string, published_at timestamp, industry string, title string, snippet string, tickers array<string>").coalesce(1)
    ids = lambda **by: [r.i for r in news.filtered(df, **by).collect()]
    assert ids() == [1, 2, 3] and ids(sentiment="BULLISH") == [1, 2]
    assert ids(start="2024-01-01") == [1, 2] and ids(end="2024-01-01") == [1] and ids(start="2024-01-01 01:00:00", end="2024-01-02") == [2]
    assert ids(sector="technology") == [1] and ids(sector="Energy, healthcare") == [2] and ids(tag="CARE") == [2]
    assert ids(search="ALPHA") == [1] and ids(search="Beta") == [2] and ids(tickers=["AAPL"]) == [1] and ids(tickers=["x "]) == [2]
    assert news.filtered(df.limit(0), sentiment="x").count() == 0


def test_top_posts(spark):
    rows = [(1, "buy moon", None, 5), (2, "buy", "rocket", 9), (3, "up", "", None), (4, "buy", "sell", 99), (5, "crash", None, 1), (6, None, None, 7), (7, " ", "", 7), (8, "bull", None, 9)]
    got = news.top_posts(spark.createDataFrame(rows, "i int, title string, body string, score int"), [], "i").collect()
    assert sorted((r.label, r.place, r.i, r.bullish, r.bearish) for r in got) == [("bearish", 1, 5, 0, 1), ("bullish", 1, 2, 2, 0), ("bullish", 2, 8, 1, 0)]


def test_expired_rows_hide_older_ones(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    rows = [("a", 1, t(1), "fmp_x", t(9)), ("a", 2, t(2), "fmp_x", t(3)), ("b", 3, t(1), "fmp_y", None), ("b", 4, t(2), "other", t(1)), ("c", 5, None, "fmp_x", t(9)), ("c", 6, t(1), "fmp_x", t(5)), ("d", 7, t(1), None, None)]
    df = spark.createDataFrame(rows, "k string, i int, ts timestamp, endpoint string, expires_at timestamp")
    assert sorted(r.i for r in unexpired(df, "k", "ts", F.lit(t(5)), "^fmp").collect()) == [3, 6]
    assert sorted(r.i for r in unexpired(df.drop("expires_at"), "k", "ts", F.lit(t(5))).collect()) == [2, 4, 6, 7]


def test_sector_ids(spark):
    df = spark.createDataFrame([("XLK",), ("xlb",), ("ABC",), (None,)], "f string").coalesce(1)
    assert [r.s for r in df.select(sector_id("f").alias("s")).collect()] == [0, 10, 1, 1] and sorted(SECTOR_IDS.values()) == list(range(11))


def test_alerts_of_lists(spark):
    stocks = spark.createDataFrame([("l", "a", 10.0, 100.0), ("l", "b", 5.0, 10.0), ("m", "a", 1.0, None)], "list string, symbol string, price double, volume double")
    rows = [
        ("l", "a", "price_above", "9.5", None, True), ("l", "a", "price_above", "10", True, False), ("l", "b", "price_below", "5.5", None, True), ("l", "b", "price_below", "x", None, False),
        ("l", "a", "volume_spike", None, None, True), ("l", "b", "volume_spike", None, True, False), ("m", "a", "volume_spike", None, None, False), ("l", "z", "price_above", "1", True, True), ("l", "z", "price_above", "1", None, None),
        ("l", "a", "earnings", "2024-01-02 12:00:00", None, True), ("l", "a", "earnings", "2024-01-02 12:00:01", None, False), ("l", "a", "earnings", "2023-12-31 12:00:01", None, True), ("l", "a", "earnings", "2023-12-31 12:00:00", None, False), ("l", "a", "other", "1", True, False),
    ]
    alerts = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, list string, symbol string, type string, value string, triggered boolean, want boolean")
    got = reports.triggered(alerts, stocks, ["list"], F.lit(dt.datetime(2024, 1, 1, 12))).collect()
    assert len(got) == len(rows) and all(r.triggered == r.want for r in got), [r for r in got if r.triggered != r.want]
