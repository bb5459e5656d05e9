"""The simulation against a plain day-by-day one, and what it is made of."""

import datetime as dt
import math
import random

import pytest

from barloom.operators import evaluation, portfolio
from barloom.streaming import trades as live

DAY = dt.date(2024, 1, 1)


def plain(prices, signals, index, hold, slots, stop, start, market_neutral, cost=0.001):
    """Day by day, as a loop: mark what is held, close, then open from the top fifth of what isn't held."""
    closes, spy = {}, dict(index)
    for d, t, c in sorted(prices):
        closes.setdefault(t, []).append((d, c))
    dates = sorted({d for d, _, _ in prices})
    dates = dates[int(len(dates) * 0.8) :] if start is None else [d for d in dates if d >= start]
    predicted = {(t, d): p for d, t, p in signals}
    tickers = sorted(closes)
    spy_days = sorted(spy)

    def price(t, day):
        known = [c for d, c in closes[t] if d <= day and c > 0]
        return known[-1] if known else None

    def spy_move(day):
        at = spy_days.index(day) if day in spy else 0
        return math.log(spy[day] / spy[spy_days[at - 1]]) if market_neutral and at > 0 else 0.0

    held, before, daily, log = {}, {}, [], []
    for i, day in enumerate(dates):
        r, n = 0.0, len(held)
        for t in held:
            now = price(t, day)
            r += (math.log(now / before[t]) - spy_move(day)) / n
            before[t] = now
        for t, (entered, entry) in list(held.items()):
            if math.log(price(t, day) / entry) <= stop or i - entered >= hold:
                own = math.log(price(t, day) / entry)
                index_move = math.log([spy[d] for d in spy_days if d <= day][-1] / [spy[d] for d in spy_days if d <= dates[entered]][-1]) if market_neutral else 0.0
                r -= cost / n
                log.append((t, dates[entered], day, i - entered, round(own - index_move - cost, 9), round(1 / n, 9)))
                del held[t]
        names = sorted(((-predicted[t, day], t) for t in tickers if t not in held and (t, day) in predicted))
        top = [t for p, t in names[: max(1, int(len(names) * 0.2))] if p < 0]
        for t in top[: slots - len(held)]:
            held[t], before[t] = (i, dict(closes[t])[day]), dict(closes[t])[day]
        daily.append((day, r))
    return sorted(log), daily


def table(rng, names, days, busy=1.0):
    """Prices with gaps; signals of names that have a price on their day, on a share of the days."""
    at = lambda k: DAY + dt.timedelta(days=k)
    prices = [(at(k), t, rng.uniform(9, 11)) for t in names for k in range(days) if rng.random() < 0.8]
    quiet = {at(k) for k in range(days) if rng.random() > busy}
    signals = [(d, t, round(rng.uniform(-1, 2), 3)) for d, t, _ in prices if rng.random() < 0.8 and d not in quiet]
    return prices, signals, [(at(k), rng.uniform(90, 110)) for k in range(days)]


@pytest.mark.parametrize("seed", range(4))
def test_simulation_equals_the_plain_one(spark, seed):
    rng = random.Random(seed)
    prices, signals, index = table(rng, [f"T{i:02}" for i in range(18)], 60, busy=(1.0, 0.3, 0.15, 0.7)[seed])
    other = [s for s in signals if rng.random() < 0.4]
    start = None if seed == 3 else DAY + dt.timedelta(days=5)
    p = spark.createDataFrame(prices, "date date, ticker string, close double")
    k = spark.createDataFrame([("x", *r) for r in signals] + [("y", *r) for r in other], "strategy string, date date, ticker string, prediction double")
    x = spark.createDataFrame(index, "date date, market_close double")
    for hold, slots, neutral in ((1, 1, True), (5, 3, False), (8, 2, True)):
        begin = start and str(start)
        held = stored_once(portfolio.positions(p, k, hold, slots, stop=-0.06, start=begin))
        log = portfolio.trades(p, held, x if neutral else None, begin).collect()
        daily = portfolio.daily_returns(p, held, x if neutral else None, begin).collect()
        for name, mine in (("x", signals), ("y", other)):
            want, days = plain(prices, mine, index, hold, slots, -0.06, start, neutral)
            got = sorted((r.ticker, r.entry_date, r.exit_date, r.bars_held, round(r["return"], 9), round(r.weight, 9)) for r in log if r.strategy == name)
            assert got == want
            each = {r.date: r.r for r in daily if r.strategy == name}
            if each:
                assert each.keys() == {d for d, _ in days} and all(abs(each[d] - r) < 1e-9 for d, r in days)


def stored_once(df):
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def test_spans_are_several_and_apart(spark):
    """Sparse signals fall into many spans, which run in tasks of their own."""
    rng = random.Random(9)
    prices, signals, _ = table(rng, "ABCDEFGH", 300, busy=0.1)
    p = spark.createDataFrame(prices, "date date, ticker string, close double")
    k = spark.createDataFrame([("x", *r) for r in signals], "strategy string, date date, ticker string, prediction double")
    rows = portfolio.spans(portfolio.exits(p, k, 3, 2, start=str(DAY))).collect()
    found = {}
    for r in rows:
        low, high = found.get(r.span, (10**9, -1))
        found[r.span] = (min(low, r.i), max(high, r.i + (r.k or 10**6)))
    edges = [found[s] for s in sorted(found)]
    assert len(edges) > 5 and all(a[1] <= b[0] for a, b in zip(edges, edges[1:]))


def test_stop_follows_the_horizon(spark):
    prices = spark.createDataFrame([(DAY + dt.timedelta(days=i), "A", c) for i, c in enumerate((100.0, 96.0, 94.0, 91.0))], "date date, ticker string, close double")
    signals = spark.createDataFrame([("s", DAY, "A", 1.0)], "strategy string, date date, ticker string, prediction double")
    at = lambda h: portfolio.positions(prices, signals, h, start=str(DAY)).first()
    assert [at(h).exit_price for h in (5, 7, 21)] == [94.0, 94.0, 91.0] and at(1).exit_price == 96.0


def test_empty_and_missing(spark):
    prices = spark.createDataFrame([(DAY, "A", 1.0), (DAY, "C", -1.0)], "date date, ticker string, close double")
    signals = spark.createDataFrame([("s", DAY, "B", 1.0), ("s", DAY, "C", 1.0), ("s", DAY, "D", None)], "strategy string, date date, ticker string, prediction double")
    assert portfolio.positions(prices, signals, 5, start=str(DAY)).count() == 0
    assert portfolio.positions(prices.limit(0), signals, 5).count() == 0
    last = portfolio.positions(prices, spark.createDataFrame([("s", DAY, "A", 1.0)], signals.schema), 5, start=str(DAY))
    assert not last.first().closed and portfolio.trades(prices, last, start=str(DAY)).count() == 0


def test_stats_of_trades(spark):
    rows = [("s", DAY, DAY + dt.timedelta(days=800), 0.1, 5), ("s", DAY, DAY + dt.timedelta(days=1), -0.1, 1), ("s", DAY, DAY, 0.3, 3)]
    s = evaluation.trade_stats(spark.createDataFrame(rows, "strategy string, entry_date date, exit_date date, return double, bars_held int"), ["strategy"]).first()
    assert (s.n, round(s.win_rate, 4), s.bars, s["median"], round(s.per_year, 4)) == (3, 0.6667, 3.0, 0.1, round(3 / (800 / 365.25), 4))


def test_idle_symbol_is_forgotten(spark, tmp_path):
    """A symbol that isn't traded for long starts with a new baseline: the last price of A alerts with its state and not without."""
    at = lambda minutes: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)
    batches = [[("A", 100.0, 1.0, at(0))], [("B", 50.0, 1.0, at(600))], [("B", 50.0, 1.0, at(601))], [("A", 110.0, 1.0, at(602))]]
    for rows in batches:
        spark.createDataFrame(rows, live.TRADE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run(name, idle):
        stream = spark.readStream.schema(live.TRADE).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = live.alert_stream(stream, late="10 minutes", idle=idle).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.processAllAvailable()
        q.stop()
        return [(r.symbol, r.price) for r in spark.table(name).collect()]

    assert run("kept", 172_800) == [("A", 110.0)]
    assert run("forgotten", 3_600) == []
