"""Panels that are filled both ways, prices as of a day, indicators by code, mentions under several keys, predictions of several windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.columns import fill, flag, ratio
from barloom.functions.windows import last_known, next_known, rolling, series
from barloom.operators.asof import densify

#: Indicators by name and the code of their series.
INDICATORS = {
    "GDP": "GDP", "REAL_GDP": "GDPC1", "REAL_GDP_PER_CAPITA": "A939RX0Q048SBEA", "CPI": "CPIAUCSL", "UNEMPLOYMENT": "UNRATE", "INFLATION": "FPCPITOTLZGUSA", "FEDERAL_FUNDS_RATE": "FEDFUNDS",
    "TREASURY_10Y": "GS10", "TREASURY_2Y": "GS2", "TREASURY_30Y": "GS30", "RETAIL_SALES": "RSXFSN", "DURABLES": "UMDMNO", "NONFARM_PAYROLL": "PAYEMS",
}


def both_ways(x: str) -> Column:
    """The last known value of a series, before its first one that one; NULL only where a series has no value at all."""
    return F.coalesce(last_known(x), next_known(x))


def cleaned(bars: DataFrame) -> DataFrame:
    """Bars with gaps -> filled both ways, with returns, log returns, their deviation over 20 rows (NULL while one of them is missing) and parts of the date.

    A close of 0 has no return after it. Monday is day 0.
    """
    values = [c for c in bars.columns if c not in ("ticker", "date")]
    df = bars.withColumns({c: both_ways(c) for c in values})
    df = df.withColumn("returns", ratio("close", F.lag("close").over(series())) - 1)
    return df.withColumns({
        "log_returns": F.log1p("returns"), "volatility": rolling(F.stddev_samp, "returns", 20, 20),
        "day_of_week": F.weekday("date"), "month": F.month("date"), "quarter": F.quarter("date"),
    })


def indicator_series(observations: DataFrame, codes: dict[str, str] = INDICATORS) -> DataFrame:
    """(code, date, value) -> (indicator, date, value) of the listed codes. NULL and NaN are no observations; other codes go."""
    names = F.create_map(*[F.lit(x) for name, code in codes.items() for x in (code, name)])
    seen = observations.where(F.col("code").isin(*codes.values()) & F.col("value").isNotNull() & ~F.isnan("value"))
    return seen.select(F.element_at(names, F.col("code")).alias("indicator"), "date", "value")


def latest_indicators(long: DataFrame) -> DataFrame:
    """(indicator, date, value) -> the newest value of each, and its change against the one before; at one date the greater value counts."""
    each = long.groupBy("indicator", "date").agg(F.max("value").alias("value"))
    each = each.withColumn("_p", F.row_number().over(W.partitionBy("indicator").orderBy(F.desc("date")))).where("_p <= 2")
    of = lambda p, c: F.max(F.when(F.col("_p") == p, F.col(c)))
    return each.groupBy("indicator").agg(of(1, "date").alias("date"), of(1, "value").alias("value"), (of(1, "value") - of(2, "value")).alias("change"))


def filled_panel(bars: DataFrame, *daily: DataFrame) -> DataFrame:
    """Bars with the columns of tables by date, all filled both ways within each ticker. Values before a table's first day come from later ones: no feature for training."""
    met = reduce(lambda a, b: a.join(b, "date", "left"), daily, bars)
    return met.withColumns({c: both_ways(c) for c in met.columns if c not in ("ticker", "date")})


def held_returns(trades: DataFrame, closes: DataFrame, market: DataFrame) -> DataFrame:
    """(ticker, entry, exit, ...) -> with the closes as of both days, the log return, the market's and the excess; NULL before a ticker's first day.

    Both price tables are made dense by day, so that each lookup is one equi-join by ticker and day, which no frequent ticker makes
    hot; days behind a ticker's last one take that one's close.
    """
    dense = densify(closes.select("ticker", "date", "close"), ["ticker"], "date").select("ticker", F.col("date").alias("_day"), last_known("close").alias("_close"))
    index = market.select(F.lit("").alias("ticker"), "date", F.col("market_close").alias("close"))
    index = densify(index, ["ticker"], "date").select(F.col("date").alias("_day"), last_known("close").alias("_close"))
    ends = closes.groupBy("ticker").agg(F.max("date").alias("_last"))
    last = market.agg(F.max("date")).scalar()
    df = trades.join(ends, "ticker", "left")
    for side in ("entry", "exit"):
        df = df.withColumn("_day", F.least(side, "_last")).join(dense, ["ticker", "_day"], "left").withColumnRenamed("_close", f"{side}_close").drop("_day")
        df = df.withColumn("_day", F.least(F.col(side), last)).join(index, "_day", "left").withColumnRenamed("_close", f"_{side}_market").drop("_day")
    own, whole = F.ln(ratio("exit_close", "entry_close")), F.ln(ratio("_exit_market", "_entry_market"))
    return df.withColumns({"held_return": own, "market_return": whole, "excess_return": own - whole}).drop("_last", "_entry_market", "_exit_market")


#: Days that articles are looked back for, and how many of a feed are looked at.
MENTION_DAYS, MENTIONS = 7, 8


def mentions(articles: DataFrame, now: Column, days: int = MENTION_DAYS, k: int = MENTIONS) -> DataFrame:
    """(feed, title, published_at, tickers, symbols, ticker) -> (ticker, feed, title, published_at): the newest k of each feed and ticker, each title once for a ticker.

    A name counts under any of the three keys, in upper case; articles without a title count among the k and then go. Of several with one title the newest stays.
    """
    keys = F.array_distinct(F.transform(F.filter(F.concat(F.coalesce("tickers", F.array()), F.coalesce("symbols", F.array()), F.array("ticker")), lambda x: x.isNotNull()), F.upper))
    recent = articles.where(F.col("published_at") >= now - F.make_dt_interval(days=F.lit(days)))
    each = recent.select(F.explode(keys).alias("ticker"), "feed", "title", "published_at")
    newest = W.partitionBy("ticker", "feed").orderBy(F.desc("published_at"), "title")
    each = each.withColumn("_n", F.row_number().over(newest)).where((F.col("_n") <= k) & (fill("title", "") != ""))
    once = W.partitionBy("ticker", "title").orderBy(F.desc("published_at"), "feed")
    return each.withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n")


def windows_long(parts: dict[str, DataFrame]) -> DataFrame:
    """Predictions of each window below one another, with the window's name; columns that one lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("window", F.lit(name)) for name, df in parts.items()])


def percent_change() -> Column:
    """Predicted change in percent of the price; 0 without either."""
    return fill(ratio("price_change", F.when(F.col("current_price") > 0, F.col("current_price"))) * 100, 0.0)


def mean_predicted_change(long: DataFrame, keys: list[str]) -> DataFrame:
    """Mean predicted change in percent over the windows that are there."""
    return long.groupBy(*keys).agg(F.avg(percent_change()).alias("mean_change"), F.count("*").alias("windows"))


def top_mover(long: DataFrame, keys: list[str]) -> DataFrame:
    """The name and window with the largest predicted change by size of each group, among all names. Ties go to the first name and, within one, to the greater change and last window. Groups without a change have none."""
    moved = long.withColumn("change", percent_change()).where("change <> 0")
    place = W.partitionBy(*keys).orderBy(F.abs("change").desc(), "ticker")
    best = moved.groupBy(*keys, "ticker").agg(F.max_by(F.struct("change", "window"), F.struct(F.abs("change"), F.col("change"), F.col("window"))).alias("b"))
    best = best.select(*keys, "ticker", "b.*").withColumn("_n", F.row_number().over(place)).where("_n = 1").drop("_n")
    shown = F.concat(F.when(F.col("change") >= 0, "+").otherwise(""), F.format_string("%.2f", "change"), F.lit("%"))
    return best.withColumn("shown", shown)


def all_reports(df: DataFrame, upcoming: str, past: str) -> Column:
    """Two arrays of reports as one, missing ones as empty; the upcoming ones first."""
    kind = df.schema[upcoming].dataType
    return F.concat(F.coalesce(upcoming, F.array().cast(kind)), F.coalesce(past, F.array().cast(kind)))


#: Fixed value: days to and since a report that isn't known or is further away.
NO_REPORT = 90


def report_distances(days: DataFrame, reports: DataFrame, most: int = NO_REPORT) -> DataFrame:
    """(ticker, day) and (ticker, date) -> for each day once: whether a report is on it, days to the next and since the last one on other days, ``most`` if none is nearer.

    Both tables are united and sorted once by ticker and day; the nearest reports before and after are carried along.
    """
    told = reports.select("ticker", F.col("date").alias("day"), F.lit(False).alias("_asked"), F.col("date").alias("_e"))
    asked = days.select("ticker", "day", F.lit(True), F.lit(None).cast("date"))
    each = told.union(asked).groupBy("ticker", "day").agg(F.max("_asked").alias("_asked"), F.max("_e").alias("_e"))
    w = W.partitionBy("ticker").orderBy("day")
    each = each.withColumns({"_last": F.last("_e", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)), "_next": F.first("_e", ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing))})
    near = lambda d: fill(F.least(d, F.lit(most)), most)
    return each.where("_asked").select(
        "ticker", "day", flag(F.col("_e").isNotNull()).alias("has_today"), near(F.datediff("_next", "day")).alias("days_to_next"), near(F.datediff("day", "_last")).alias("days_since_last"),
    )
