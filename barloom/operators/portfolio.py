"""Portfolio simulation: candidates, exits and daily marks are joins and windows; only the slots are a sequential matter.

A day's names are ranked by prediction. What a strategy can buy on a day is among the best ``2 * slots`` of them, as no more than
``slots`` are held, so a day has that many short rows whatever the number of names. Where a pick would be closed
doesn't depend on what else is held and is found for all of them at once. Days on which no earlier pick can be open cut a strategy
into spans, which pass through tasks of their own; a span's rows pass in order of day, with no more than ``slots`` positions in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.columns import ratio

#: The log return at which a position is closed, by rows that it may be held, and for other horizons.
STOPS = {1: -0.03, 5: -0.05, 21: -0.08}
STOP = -0.05
#: Share of a day's free names that may be bought, round-trip cost, share of dates that come before the simulation.
SHARE = 0.2
COST = 0.001
BEFORE = 0.8


def trading_days(prices: DataFrame, start: str | None = None) -> DataFrame:
    """(date, i): the days of the simulation, numbered from 0; by default the last fifth of all dates. Days, not rows, are sorted in one task."""
    days = prices.select("date").distinct()
    w = W.orderBy("date")
    placed = days.select("date", F.row_number().over(w).alias("_k"), F.count("*").over(W.partitionBy()).alias("_n"))
    after = F.col("_k") - 1 >= F.floor(F.col("_n") * F.lit(BEFORE)) if start is None else F.col("date") >= F.lit(start).cast("date")
    return placed.where(after).select("date", (F.row_number().over(w) - 1).alias("i"))


def marks(prices: DataFrame, days: DataFrame) -> DataFrame:
    """(ticker, i, close): the last close of each ticker up to each day, from its first one on. Closes that aren't positive are left out."""
    known = prices.where("close > 0").select("ticker", "date", "close")
    span = F.broadcast(days.agg(F.min("date").alias("_first"), F.max("i").alias("_last")))
    # A close before the first day holds from that day on, a later one from its own.
    placed = known.join(days, "date", "left").crossJoin(span).withColumn("_i", F.when(F.col("date") < F.col("_first"), -1).otherwise(F.col("i")))
    placed = placed.where("_i IS NOT NULL").withColumn("_next", F.lead("_i").over(W.partitionBy("ticker").orderBy("date")))
    held = F.sequence(F.greatest("_i", F.lit(0)), F.coalesce(F.col("_next") - 1, F.col("_last")))
    return placed.where(F.coalesce(F.col("_next") - 1, F.col("_last")) >= F.greatest("_i", F.lit(0))).select("ticker", F.explode(held).alias("i"), "close")


def candidates(signals: DataFrame, slots: int) -> DataFrame:
    """(strategy, date, ticker, prediction) -> what may be bought: the best ``2 * slots`` of a day, rising ones only, with place and the day's number of names."""
    w = W.partitionBy("strategy", "date")
    ranked = signals.where(F.col("prediction").isNotNull()).withColumns({"n": F.count("*").over(w), "place": F.row_number().over(w.orderBy(F.desc("prediction"), "ticker"))})
    return ranked.where((F.col("place") <= 2 * slots) & (F.col("prediction") > 0))


def exits(prices: DataFrame, signals: DataFrame, hold: int, slots: int = 10, stop: float | None = None, start: str | None = None) -> DataFrame:
    """Prices (date, ticker, close) and signals (strategy, date, ticker, prediction) -> every pick with where it would be closed.

    That is the first of the next ``hold`` days whose log return reaches ``stop`` (by default that of the horizon), else the last of
    them; ``closed`` is false and ``k`` NULL where the days end before. Days are the market's; a ticker without a row keeps its last close.
    A pick without a positive close on its day goes. ``signalled`` lists after how many days the ticker has a signal again.
    """
    stop = STOPS.get(hold, STOP) if stop is None else stop
    days = trading_days(prices, start)
    daily = marks(prices, days)
    entries = prices.where("close > 0").select("ticker", "date", F.col("close").alias("entry_price"))
    picks = candidates(signals, slots).join(days, "date").join(entries, ["ticker", "date"]).select("strategy", "ticker", "i", "place", "n", "entry_price")
    told = signals.where(F.col("prediction").isNotNull()).join(days, "date").select("strategy", "ticker", "i").distinct().withColumn("_told", F.lit(True))
    path = picks.select("*", F.explode(F.sequence(F.lit(1), F.lit(hold))).alias("k")).withColumnRenamed("i", "entry_i").withColumn("i", F.col("entry_i") + F.col("k"))
    path = path.join(daily, ["ticker", "i"]).join(told, ["strategy", "ticker", "i"], "left")
    done = (F.ln(ratio("close", "entry_price")) <= stop) | (F.col("k") >= hold)
    met = path.groupBy("strategy", "ticker", F.col("entry_i").alias("i")).agg(
        F.min(F.when(done, F.struct("k", "close"))).alias("_exit"), F.array_sort(F.collect_list(F.when(F.col("_told"), F.col("k")))).alias("signalled"),
    )
    out = picks.join(met, ["strategy", "ticker", "i"], "left")
    return out.select("strategy", "ticker", "i", "place", "n", "entry_price", F.col("_exit.k").alias("k"), F.col("_exit.close").alias("exit_price"), F.col("_exit").isNotNull().alias("closed"), F.coalesce("signalled", F.array().cast("array<int>")).alias("signalled"))


def spans(picks: DataFrame) -> DataFrame:
    """Picks with their span: a new one starts on a day by which every earlier pick is closed. Days of a strategy, not picks, are sorted in one task."""
    days = picks.groupBy("strategy", "i").agg(F.max(F.coalesce(F.col("i") + F.col("k"), F.lit(2**31 - 1))).alias("_end"))
    w = W.partitionBy("strategy").orderBy("i")
    days = days.withColumn("_open", F.max("_end").over(w.rowsBetween(W.unboundedPreceding, -1)))
    days = days.withColumn("span", F.sum(F.when(F.col("_open") > F.col("i"), 0).otherwise(1)).over(w)).select("strategy", "i", "span")
    return picks.join(days, ["strategy", "i"])


def positions(prices: DataFrame, signals: DataFrame, hold: int, slots: int = 10, stop: float | None = None, start: str | None = None, share: float = SHARE) -> DataFrame:
    """What is bought: strategy, ticker, i, k, entry_price, exit_price, closed.

    Each day positions are closed first, then opened while slots are free: from the top ``share`` of the names that have a
    signal and aren't held, in order of place. A ticker may be bought on the day it is sold.
    """
    order = ["strategy", "span", "i", "place"]
    each = spans(exits(prices, signals, hold, slots, stop, start)).repartition("strategy", "span").sortWithinPartitions(*order)

    def fold(batches: Iterator) -> Iterator:
        span = day = None
        held: dict[str, tuple] = {}  # ticker -> day of entry, day of exit or None, days with a signal
        top = free = passed = 0
        for pdf in batches:
            taken = []
            for r in pdf.itertuples():
                if (r.strategy, r.span) != span:
                    span, day, held = (r.strategy, r.span), None, {}
                if r.i != day:
                    day = r.i
                    held = {t: h for t, h in held.items() if h[1] is None or h[1] > day}
                    names = r.n - sum(day - entered in told for entered, _, told in held.values())
                    top, free, passed = max(1, int(names * share)), slots - len(held), 0
                buy = r.ticker not in held and free > 0 and passed < top
                passed += r.ticker not in held
                if buy:
                    free -= 1
                    held[r.ticker] = (day, day + int(r.k) if r.closed else None, set(r.signalled))
                taken.append(buy)
            yield pdf[taken]

    return each.mapInPandas(fold, each.schema).select("strategy", "ticker", "i", "k", "entry_price", "exit_price", "closed")


def open_counts(held: DataFrame, last: DataFrame) -> DataFrame:
    """Positions -> (strategy, ticker, i, day, n_open): each day that one is open at the start of, with how many are."""
    day = F.explode(F.sequence(F.col("i") + 1, F.coalesce(F.col("i") + F.col("k"), F.col("_last"))))
    days = held.crossJoin(F.broadcast(last)).where(F.coalesce(F.col("i") + F.col("k"), F.col("_last")) > F.col("i")).select("strategy", "ticker", "i", "entry_price", "k", day.alias("day"))
    return days.withColumn("n_open", F.count("*").over(W.partitionBy("strategy", "day")))


def trades(prices: DataFrame, held: DataFrame, index: DataFrame | None = None, start: str | None = None, cost: float = COST) -> DataFrame:
    """Closed positions: dates, prices, ``return`` (log, less the index's over the same days and the cost), abs_return, index_return, bars_held, weight at the close."""
    days = trading_days(prices, start)
    weights = open_counts(held, days.agg(F.max("i").alias("_last"))).where(F.col("day") == F.col("i") + F.col("k")).select("strategy", "ticker", "i", (1 / F.col("n_open")).alias("weight"))
    done = held.where("closed").join(weights, ["strategy", "ticker", "i"]).withColumn("_out", F.col("i") + F.col("k"))
    entry, out = days.select(F.col("date").alias("entry_date"), "i"), days.select(F.col("date").alias("exit_date"), F.col("i").alias("_out"))
    done = done.join(entry, "i").join(out, "_out")
    if index is not None:
        marked = marks(index.select(F.lit("index").alias("ticker"), "date", F.col("market_close").alias("close")), days)
        done = done.join(marked.select("i", F.col("close").alias("_a")), "i", "left").join(marked.select(F.col("i").alias("_out"), F.col("close").alias("_b")), "_out", "left")
        market = F.coalesce(F.ln(ratio("_b", "_a")), F.lit(0.0))
    else:
        market = F.lit(0.0)
    own = F.ln(ratio("exit_price", "entry_price"))
    return done.select("strategy", "ticker", "entry_date", "exit_date", "entry_price", "exit_price", (own - market - cost).alias("return"), (own - cost).alias("abs_return"), market.alias("index_return"), F.col("k").alias("bars_held"), "weight")


def daily_returns(prices: DataFrame, held: DataFrame, index: DataFrame | None = None, start: str | None = None, cost: float = COST) -> DataFrame:
    """Positions -> (strategy, date, r): log return of the portfolio on every day, open positions of equal weight.

    A position's day counts its move less the index's of that day; its last one pays the cost. Days without positions have 0.
    """
    days = trading_days(prices, start)
    daily = marks(prices, days)
    moves = daily.select("ticker", "i", F.col("close").alias("_now"), F.lag("close").over(W.partitionBy("ticker").orderBy("i")).alias("_before")).withColumnRenamed("i", "day")
    met = open_counts(held, days.agg(F.max("i").alias("_last"))).join(moves, ["ticker", "day"])
    own = F.ln(ratio("_now", F.when(F.col("day") == F.col("i") + 1, F.col("entry_price")).otherwise(F.col("_before"))))
    if index is not None:
        own_days = index.select("date", F.ln(ratio("market_close", F.lag("market_close").over(W.orderBy("date")))).alias("_m"))
        met = met.join(days.join(own_days, "date").select(F.col("i").alias("day"), "_m"), "day", "left")
        own = own - F.coalesce("_m", F.lit(0.0))
    paid = F.when(F.col("day") == F.col("i") + F.col("k"), cost).otherwise(0.0)
    sums = met.groupBy("strategy", "day").agg(F.sum((own - paid) / F.col("n_open")).alias("r"))
    every = held.select("strategy").distinct().crossJoin(F.broadcast(days))
    return every.join(sums.withColumnRenamed("day", "i"), ["strategy", "i"], "left").select("strategy", "date", F.coalesce("r", F.lit(0.0)).alias("r"))
