"""Features from outside prices, each known one price row later than its source.

Sentiment rolls over documents, transactions over calendar days, earnings and short interest are as-of lookups.
Fundamentals take what was known on the day; ``point_in_time=False`` spreads the newest document over all history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.columns import clip, fill, flag, ratio
from barloom.functions.windows import lag, last_known, rolling
from barloom.operators.asof import asof_join, densify

#: Transaction codes that count as buying and as selling.
BUYS, SELLS = ("P", "M", "A"), ("S", "D")


def insider_daily(transactions: DataFrame, buys: tuple[str, ...] = BUYS, sells: tuple[str, ...] = SELLS) -> DataFrame:
    """(ticker, date, code, shares, price) -> sums by ticker and day. A row may be both a purchase, by code, and a sale, by sign; its sign in net sums is the purchase's."""
    buy, sell = F.col("code").isin(*buys) | (F.col("shares") > 0), F.col("code").isin(*sells) | (F.col("shares") < 0)
    shares, price = F.abs("shares"), F.when(fill("price", 0.0) > 0, F.col("price")).otherwise(1.0)
    direction = F.when(buy, 1).when(sell, -1).otherwise(0)
    value = shares * price
    return transactions.groupBy("ticker", "date").agg(
        F.sum(direction * shares).alias("net_shares"), F.sum(F.when(buy, 1).otherwise(0)).alias("buys"), F.sum(F.when(sell, 1).otherwise(0)).alias("sells"),
        F.sum(F.when(buy, value).otherwise(0.0)).alias("buy_value"), F.sum(F.when(sell, value).otherwise(0.0)).alias("sell_value"),
        F.sum(direction * value).alias("net_value"), F.count("*").alias("transactions"),
    )


def insider_features(daily: DataFrame) -> DataFrame:
    """Daily sums -> 30 and 90 day sums, share of purchases, clusters, and z-scores of 90 day sums against 360 days of them."""
    measures = [c for c in daily.columns if c not in ("ticker", "date")]
    dense = densify(daily, ["ticker"], "date").na.fill(0, measures)
    total = lambda c, n: rolling(F.sum, c, n, 1)
    df = dense.withColumns({
        "insider_net_shares_30d": total("net_shares", 30), "insider_net_shares_90d": total("net_shares", 90),
        "insider_buy_value_30d": total("buy_value", 30), "insider_sell_value_30d": total("sell_value", 30), "insider_net_value_30d": total("net_value", 30),
        "_b": total("buys", 30), "_s": total("sells", 30), "_t90": total("transactions", 90), "_v90": total("net_value", 90),
    })
    z = lambda c: clip(ratio(F.col(c) - rolling(F.avg, c, 360, 90), rolling(F.stddev_samp, c, 360, 90)), -5, 5)
    return df.withColumns({
        "insider_buy_ratio_30d": F.col("_b") / (F.col("_b") + F.col("_s") + 1e-6),
        "insider_cluster": flag((F.col("_b") >= 3) & (F.col("_s") == 0)),
        "insider_available": flag(F.col("_t90") > 0),
        "insider_activity_z_90d": z("_t90"), "insider_net_value_z_90d": z("_v90"),
    }).drop("_b", "_s", "_t90", "_v90")


def one_row_later(prices: DataFrame, features: DataFrame, columns: list[str]) -> DataFrame:
    """Prices with features of the same day, each moved to the next price row."""
    met = prices.join(features.select("ticker", "date", *columns), ["ticker", "date"], "left")
    return met.withColumns({c: lag(c) for c in columns})


def sentiment_features(documents: DataFrame, sources: tuple[str, ...] = ()) -> DataFrame:
    """(ticker, date, sentiment, news_count) of days with documents -> means, momentum, spread and spikes over documents.

    ``source_count`` counts a day's sources where it is given, else a day has one. Each of ``sources`` is a column of scores
    that gets a mean over seven documents of its own.
    """
    s, n = F.col("sentiment"), F.col("news_count").cast("double")
    counted = fill(F.col("source_count").cast("double"), 0.0) if "source_count" in documents.columns else F.lit(1.0)
    df = documents.withColumns({"sent_mean_1d": s, "sent_mean_7d": rolling(F.avg, s, 7, 3), "sent_mean_30d": rolling(F.avg, s, 30, 10), "sent_std_7d": rolling(F.stddev_samp, s, 7, 3), **{f"sent_{c}_mean_7d": rolling(F.avg, F.col(c), 7, 3) for c in sources}})
    return df.withColumns({
        "sent_momentum": F.col("sent_mean_7d") - F.col("sent_mean_30d"), "news_count_1d": n, "news_count_7d": fill(rolling(F.sum, n, 7, 1), 0.0), "news_spike": fill(n / (rolling(F.avg, n, 30, 10) + 1e-6), 0.0),
        "sentiment_available": F.lit(1), "sent_source_count": counted,
    })


SENTIMENT = ("sent_mean_1d", "sent_mean_7d", "sent_mean_30d", "sent_momentum", "sent_std_7d", "news_count_1d", "news_count_7d", "news_spike", "sentiment_available", "sent_source_count")
INSIDER = (
    "insider_net_shares_30d", "insider_net_shares_90d", "insider_buy_value_30d", "insider_sell_value_30d", "insider_net_value_30d", "insider_buy_ratio_30d", "insider_cluster", "insider_available",
    "insider_activity_z_90d", "insider_net_value_z_90d",
)


def feature_matrix(df: DataFrame, sentiment: DataFrame, transactions: DataFrame, earnings: DataFrame, shorts: DataFrame, fundamentals: DataFrame, long_rate: DataFrame, short_rate: DataFrame, sources: tuple[str, ...] = (), insider: tuple[str, ...] = INSIDER) -> DataFrame:
    """Rows of the price block -> with the columns of sentiment, insiders, earnings, short interest, fundamentals and macro, each as known the row before.

    Every block joins or carries on by ticker and date, so that rows stay where the price block's windows have put them.
    """
    scored = sentiment_features(sentiment, sources)
    df = one_row_later(df, scored, [*SENTIMENT, *[f"sent_{c}_mean_7d" for c in sources]])
    df = one_row_later(df, insider_features(insider_daily(transactions)), list(insider))
    df = short_interest_features(earnings_features(df, earnings), shorts)
    return macro_features(fundamental_features(df, fundamentals), long_rate, short_rate)


def earnings_features(prices: DataFrame, earnings: DataFrame) -> DataFrame:
    """(ticker, date, eps, eps_estimated) as of each price row, the next row on: surprise, beat, recency, relative surprise."""
    known = asof_join(prices, earnings.withColumn("_day", F.col("date")), "date", ["ticker"])
    gap = F.col("eps") - F.col("eps_estimated")
    df = known.withColumns({
        "earnings_surprise": gap,
        "earnings_beat": F.when(gap > 0.001, 1).when(gap < -0.001, -1).when(gap.isNotNull(), 0),
        "earnings_recency": 1 / (F.datediff("date", "_day") + 1.0),
        "earnings_surprise_pct": F.when(F.abs("eps_estimated") > 0.01, clip(ratio(gap, F.abs("eps_estimated")), -5, 5)).when(gap.isNotNull(), 0.0),
        "days_since_earnings": fill(F.least(F.lit(90), F.datediff("date", "_day")), 90),
    })
    moved = ["earnings_surprise", "earnings_beat", "earnings_recency", "earnings_surprise_pct"]
    return df.withColumns({c: lag(c) for c in moved}).drop("eps", "eps_estimated", "_day")


def short_interest_features(prices: DataFrame, reports: DataFrame) -> DataFrame:
    """(ticker, date, short_pct, days_to_cover) as of each price row, the next row on."""
    known = asof_join(prices, reports, "date", ["ticker"])
    df = known.withColumns({"si_short_float_pct": clip("short_pct", 0, 100), "si_days_to_cover": clip("days_to_cover", 0, 60), "si_available": flag(F.col("short_pct").isNotNull())})
    return df.withColumns({"si_short_float_pct": lag("si_short_float_pct"), "si_days_to_cover": lag("si_days_to_cover"), "si_available": fill(lag("si_available"), 0)}).drop("short_pct", "days_to_cover")


#: Bounds of fundamentals.
BOUNDS = {"pe": (-50, 200), "pb": (0, 50), "dividend_yield": (0, 30), "roe": (-100, 200), "beta": (-3, 5)}


def fundamental_features(prices: DataFrame, documents: DataFrame, point_in_time: bool = True) -> DataFrame:
    """(ticker, date, pe, pb, dividend_yield, roe, beta) -> bounded, as known on each row."""
    names = list(BOUNDS)
    if point_in_time:
        known = asof_join(prices, documents.select("ticker", "date", *names), "date", ["ticker"])
    else:
        newest = documents.groupBy("ticker").agg(*[F.max_by(c, "date").alias(c) for c in names])
        known = prices.join(newest, "ticker", "left")
    return known.withColumns({f"fund_{c}": clip(c, *BOUNDS[c]) for c in names}).withColumns({f"fund_{c}": lag(f"fund_{c}") for c in names}).drop(*names)


def macro_daily(indicator: DataFrame) -> DataFrame:
    """(date, value) at release dates -> every day with the last value."""
    days = densify(indicator.withColumn("ticker", F.lit("macro")), ["ticker"], "date")
    return days.withColumn("value", last_known("value")).drop("ticker")


def macro_features(prices: DataFrame, long_rate: DataFrame, short_rate: DataFrame) -> DataFrame:
    """Spread of two rates and the short one, and their changes, one row later."""
    a, b = macro_daily(long_rate).withColumnRenamed("value", "_long"), macro_daily(short_rate).withColumnRenamed("value", "_short")
    df = prices.join(a, "date", "left").join(b, "date", "left").withColumns({"_l": last_known("_long"), "_s": last_known("_short")})
    df = df.withColumns({"macro_spread": lag(F.col("_l") - F.col("_s")), "macro_short": lag("_s")})
    df = df.withColumns({"macro_spread_chg": fill(F.col("macro_spread") - lag("macro_spread"), 0.0), "macro_short_chg": fill(F.col("macro_short") - lag("macro_short"), 0.0)})
    return df.withColumns({"macro_spread": fill("macro_spread", 0.0), "macro_short": fill("macro_short", 0.0)}).drop("_long", "_short", "_l", "_s")


def event_distances(calendar: DataFrame, days: DataFrame) -> DataFrame:
    """(date, importance) of events and the days to describe -> whether one is today, days to the next and since the last, number and weight within a week."""
    weight = F.when(F.col("importance") == "high", 3).when(F.col("importance") == "medium", 2).otherwise(1)
    # Each event goes to the days of the week before it; the nearest days come from windows over all days, one row each.
    ahead = calendar.select(F.explode(F.sequence(F.date_sub("date", 6), F.col("date"))).alias("day"), weight.alias("_w"))
    week = ahead.groupBy("day").agg(F.count("*").alias("_n"), F.sum("_w").alias("_w"))
    dated = days.select("day", F.lit(True).alias("_asked"), F.lit(None).cast("date").alias("_e")).union(calendar.select("date", F.lit(False), "date")).groupBy("day").agg(F.max("_asked").alias("_asked"), F.max("_e").alias("_e"))
    w = W.orderBy("day")
    dated = dated.withColumns({"_last": F.last("_e", True).over(w.rowsBetween(W.unboundedPreceding, 0)), "_next": F.first("_e", True).over(w.rowsBetween(0, W.unboundedFollowing))})
    near = lambda d: fill(F.when(d <= 90, d), 30)
    return dated.where("_asked").join(week, "day", "left").select(
        "day", flag(F.col("_e").isNotNull()).alias("has_today"), near(F.datediff("_next", "day")).alias("days_to_next"), near(F.datediff("day", "_last")).alias("days_since_last"),
        fill("_n", 0).alias("week_density"), fill("_w", 0).alias("week_importance"),
    )


