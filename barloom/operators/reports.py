"""Figures of reports: distributions, surprises, growth, completeness, market mood."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.columns import bands, clean, clip, fill, half_up, ratio
from barloom.functions.windows import rolling


def sentiment_distribution(df: DataFrame, keys: list[str]) -> DataFrame:
    """Volume and its share by class of score: above 0.1, below -0.1, between."""
    label = F.when(F.col("score") > 0.1, "positive").when(F.col("score") < -0.1, "negative").otherwise("neutral")
    sums = df.groupBy(*keys, label.alias("class")).agg(F.sum("volume").alias("volume"))
    return sums.withColumn("percent", ratio("volume", F.sum("volume").over(W.partitionBy(*keys))) * 100)


def extremes(df: DataFrame, keys: list[str], tie: str, band: float = 0.3, k: int = 3) -> DataFrame:
    """The k highest scores above the band and the k lowest below its negative."""
    side = F.when(F.col("score") > band, "bullish").when(F.col("score") < -band, "bearish")
    w = W.partitionBy(*keys, "side").orderBy(F.abs("score").desc(), tie)
    return df.withColumn("side", side).where("side is not null").withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def source_breakdown(df: DataFrame, by: str, k: int = 5) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"), F.avg("score").alias("score")).orderBy(F.desc("n"), by).limit(k)


def impact(df: DataFrame, tie: str, least: float = 0.3, k: int = 3) -> DataFrame:
    return df.withColumn("impact", F.abs("score") * F.col("confidence")).where(F.col("impact") > least).orderBy(F.desc("impact"), tie).limit(k)


def engagement(df: DataFrame, tie: str, k: int = 5) -> DataFrame:
    """score + votes + 2 * comments of posts with more than 5, 10 or 5 of them."""
    busy = (F.col("score") > 5) | (F.col("votes") > 10) | (F.col("comments") > 5)
    return df.where(busy).withColumn("engagement", F.col("score") + F.col("votes") + 2 * F.col("comments")).orderBy(F.desc("engagement"), tie).limit(k)


def surprise_pct(actual: Column, estimate: Column) -> Column:
    """Against the estimate with its sign; 0 where that is 0."""
    return F.when(estimate == 0, 0.0).otherwise(ratio(actual - estimate, F.abs(estimate)) * 100)


def mean_growth(df: DataFrame, key: str, x: str, pairs: int = 3, least: int = 4) -> DataFrame:
    """Mean relative growth of the newest pairs of reports, pairs from zero left out, for keys with enough reports."""
    w = W.partitionBy(key).orderBy(F.desc("date"))
    df = df.withColumns({"_p": F.row_number().over(w), "_b": F.lead(x).over(w), "_n": F.count("*").over(W.partitionBy(key))})
    use = df.where((F.col("_n") >= least) & (F.col("_p") <= pairs) & (F.col("_b") != 0))
    return use.groupBy(key).agg(F.avg((F.col(x) - F.col("_b")) / F.abs("_b") * 100).alias("growth"))


def beat_rates(df: DataFrame, key: str, k: int = 8) -> DataFrame:
    """Shares of the newest k reports above, below and at their estimates."""
    newest = df.withColumn("_p", F.row_number().over(W.partitionBy(key).orderBy(F.desc("date")))).where(F.col("_p") <= k)
    share = lambda c: F.count_if(c) / F.count("*") * 100
    return newest.groupBy(key).agg(share(F.col("actual") > F.col("estimate")).alias("beat"), share(F.col("actual") < F.col("estimate")).alias("miss"), share(F.col("actual") == F.col("estimate")).alias("meet"), F.count("*").alias("n"))


def payout_growth(df: DataFrame, key: str, x: str) -> DataFrame:
    """The newest four against the four before, for keys with eight; share of the newest three steps that don't fall."""
    w = W.partitionBy(key).orderBy(F.desc("date"))
    df = df.withColumns({"_p": F.row_number().over(w), "_b": F.lead(x).over(w)}).where("_p <= 8")
    new, old = F.sum(F.when(F.col("_p") <= 4, F.col(x))), F.sum(F.when(F.col("_p") > 4, F.col(x)))
    steady = F.avg(F.when((F.col("_p") <= 3) & F.col("_b").isNotNull(), F.when(F.col(x) >= F.col("_b"), 1.0).otherwise(0.0)))
    return df.groupBy(key).agg(F.count("*").alias("_n"), (ratio(new - old, old) * 100).alias("growth"), steady.alias("consistency")).where("_n = 8").drop("_n")


def dispersion(low: Column, high: Column, mean: Column) -> tuple[Column, Column]:
    spread = ratio(high - low, mean) * 100
    return spread, F.when(spread > 30, "wide").when(spread < 15, "narrow").when(spread.isNotNull(), "moderate")


def buy_sell(buys: Column, sells: Column) -> tuple[Column, Column]:
    """Ratio, NULL with no sales, and its band."""
    x = ratio(buys, sells)
    return x, F.when((sells == 0) & (buys > 0), "buying").when(x > 1.5, "buying").when(x < 0.67, "selling").otherwise("balanced")


def completeness(flags: dict[str, float]) -> Column:
    """Sum of the weights of columns that have a value."""
    parts = [F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in flags.items()]
    return sum(parts[1:], parts[0])


def report_completeness(raw: list[Column], technicals: Column, factors: Column, full: int = 10) -> Column:
    """Mean completeness of what is there: shares of raw feeds, and numbers of technicals and of factors against ``full``; 0 without any.

    A part is absent where all raw flags, or a number, are NULL; a number of 0 is absent too.
    """
    some = F.coalesce(*raw).isNotNull()
    feeds = F.when(some, sum((F.when(c, 1.0).otherwise(0.0) for c in raw[1:]), F.when(raw[0], 1.0).otherwise(0.0)) / len(raw))
    known = F.filter(F.array(feeds, *[F.when(n > 0, F.least(n / full, F.lit(1.0))) for n in (technicals, factors)]), lambda x: x.isNotNull())
    return fill(F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(known), F.lit(0)), 0.0)


#: The least mean confidence of each tier.
QUALITIES = [(0.35, "HIGH"), (0.20, "GOOD"), (0.10, "MODERATE")]


def model_quality(windows: list[Column]) -> Column:
    """Tier of the mean confidence of the windows that have a finite one."""
    known = F.filter(F.array(*[clean(c) for c in windows]), lambda x: x.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(known), F.lit(0))
    return F.coalesce(bands(mean, QUALITIES, "LOW"), F.lit("UNKNOWN"))


def top_with_default(df: DataFrame, keys: list[str], x: str, k: int, tie: str) -> DataFrame:
    """The k rows of each group with the greatest value, a missing one being 0."""
    w = W.partitionBy(*keys).orderBy(fill(x, 0).desc(), tie)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page of rows, from 1 on, with the number of all and whether more follow. A page behind the last has no rows."""
    total = df.agg(F.count("*")).scalar()
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size)
    return rows.withColumn("total", total).withColumn("has_more", F.col("total") > number * size)


def technical_levels(bars: DataFrame) -> DataFrame:
    """Bars -> distances in percent from means over 20, 50 and 200 rows and from the extremes of 252, width and place of the bands of two deviations, volume against its mean of 20.

    Means need all their rows; extremes take what there is. NULL where a mean is missing or 0.
    """
    mean = lambda c, n: rolling(F.avg, c, n, n)
    percent = lambda base: (ratio("close", base) - 1) * 100
    df = bars.withColumns({"_m": mean("close", 20), "_d": rolling(F.stddev_samp, "close", 20, 20), "_r": ratio("volume", mean("volume", 20))})
    upper, lower = F.col("_m") + 2 * F.col("_d"), F.col("_m") - 2 * F.col("_d")
    edge = (upper - lower) * 0.2
    return df.withColumns({
        "from_sma20": percent("_m"), "from_sma50": percent(mean("close", 50)), "from_sma200": percent(mean("close", 200)),
        "from_high": percent(rolling(F.max, "high", 252, 1)), "from_low": percent(rolling(F.min, "low", 252, 1)),
        "band_width": ratio(upper - lower, "close") * 100,
        "band_place": F.when(upper.isNotNull(), F.when(F.col("close") > upper - edge, "upper").when(F.col("close") < lower + edge, "lower").otherwise("middle")),
        "volume_ratio": F.col("_r"), "volume_label": F.when(F.col("_r") > 1.2, "above average").when(F.col("_r") < 0.8, "below average").when(F.col("_r").isNotNull(), "normal"),
    }).drop("_m", "_d", "_r")


def holdout_summary(models: DataFrame, window: str) -> DataFrame:
    """Models of each window -> how many have held-out rows; of these the medians of error, baseline, hits and correlation, shares that beat the baseline and are ready, and how many beat the last value.

    A window without such models has the median error of all of them and no other figure. Missing hits count 0.5, a missing correlation 0;
    a model that isn't compared with the last value is taken by its baseline. Medians are exact: a window's distinct values meet in one task.
    """
    held = F.coalesce("has_holdout", F.lit(False))
    of = lambda x: F.when(held, x)
    share = lambda c: F.avg(of(F.when(c, 1.0).otherwise(0.0)))
    beats_last = F.coalesce("beats_last_baseline", "beats_baseline")
    return models.groupBy(window).agg(
        F.count("*").alias("models"), F.count_if(held).alias("held"), F.coalesce(F.median(of(F.col("eval_rmse"))), F.median("eval_rmse")).alias("rmse"),
        F.median(of(F.col("baseline_rmse"))).alias("baseline"), F.median(of(fill("hit_rate", 0.5))).alias("hits"), F.median(of(fill("correlation", 0.0))).alias("correlation"),
        share(F.col("beats_baseline")).alias("win_rate"), F.count_if(held & beats_last).alias("wins_last"), share(F.col("production_ready")).alias("ready_rate"),
    )


def outlook(price: Column, changes: list[Column]) -> Column:
    """Outlook of the first window that has a prediction, by its change in percent of the price; no price or no change is 0."""
    change = F.coalesce(*changes)
    percent = F.when((price != 0) & (change != 0), 100 * change / price).otherwise(0.0)
    return F.when(percent > 2, "Bullish").when(percent > 0.5, "Slightly Bullish").when(percent < -2, "Bearish").when(percent < -0.5, "Slightly Bearish").otherwise("Neutral")


def mean_confidence(windows: list[Column]) -> Column:
    """Whole percent of the mean confidence of the windows that have one; 50 without any."""
    known = F.filter(F.array(*windows), lambda c: c.isNotNull() & (c != 0))
    mean = F.aggregate(known, F.lit(0.0), lambda a, c: a + c) / F.nullif(F.size(known), F.lit(0))
    return F.coalesce((100 * mean).cast("int"), F.lit(50))


def risk_label(risks: list[Column], chances: list[Column]) -> Column:
    """Risks less chances: above 2 high, above 0 moderate, below -2 low, between balanced."""
    n = lambda cs: sum((F.when(c, 1).otherwise(0) for c in cs[1:]), F.when(cs[0], 1).otherwise(0))
    return bands(n(risks) - n(chances), [(3, "high"), (1, "moderate"), (-2, "balanced")], "low")


#: The greatest score of each mood.
MOODS = ((20, "Extreme Fear"), (40, "Fear"), (60, "Neutral"), (80, "Greed"))


def mood(score: Column) -> Column:
    out = F.when(score <= MOODS[0][0], MOODS[0][1])
    for most, label in MOODS[1:]:
        out = out.when(score <= most, label)
    return F.when(score.isNotNull(), out.otherwise("Extreme Greed"))


def fear_greed(index: DataFrame, volatility: DataFrame, offsets: tuple[int, ...] = (0, 1, 5, 21, 252)) -> DataFrame:
    """Daily closes of an index and of volatility -> the mood at offsets of rows from the last day.

    Momentum is 50 plus four times the percentage by which the close exceeds its mean of up to 125 rows; calm is 50
    plus five times that by which volatility is below its mean of up to 50. They count .65 and .35, within 0 to 100. The
    first needs 21 values and the second 11; where one is missing, the other counts alone, and without both there is no score.
    """
    w = W.orderBy("date")  # one row a day
    past = w.rowsBetween(W.unboundedPreceding, 0)
    over = lambda x, n, least: F.when(F.count(x).over(past) >= least, ratio(F.col(x), F.avg(x).over(w.rowsBetween(-(n - 1), 0))) * 100 - 100)
    df = index.join(volatility, "date", "full_outer").withColumns({"_m": clip(50 + 4 * over("close", 125, 21), 0, 100), "_v": clip(50 - 5 * over("vix", 50, 11), 0, 100)})
    df = df.withColumn("offset", F.row_number().over(W.orderBy(F.desc("date"))) - 1).where(F.col("offset").isin(*offsets))
    score = half_up(F.coalesce(0.65 * F.col("_m") + 0.35 * F.col("_v"), "_m", "_v"))
    return df.select("offset", "date", score.cast("long").alias("score")).withColumn("mood", mood(F.col("score")))


def mood_sentiment(score: Column) -> Column:
    return (score - 50) / 100


def technical_summary(rsi: Column, macd: Column, short: Column, long: Column) -> Column:
    """Share of rising among all signals, and the band it falls into.

    RSI below 30 or above 70 gives two signals, below 40 or above 60 one; the sign of ``macd`` two; a short mean above or
    not above the long one, where both are known, one. No signal is neutral.
    """
    points = lambda *xs: sum((fill(x, 0) for x in xs[1:]), fill(xs[0], 0))
    crossed = short.isNotNull() & long.isNotNull()
    up = points(F.when(rsi < 30, 2).when(rsi < 40, 1), F.when(macd > 0, 2), F.when(crossed & (short > long), 1))
    down = points(F.when(rsi > 70, 2).when(rsi > 60, 1), F.when(macd < 0, 2), F.when(crossed & (short <= long), 1))
    return F.coalesce(bands(ratio(up, up + down) * 100, [(70, "Strong Buy"), (55, "Buy"), (45, "Neutral"), (30, "Sell")], "Strong Sell"), F.lit("Neutral"))


#: Days on which the exchange in New York is closed besides weekends.
HOLIDAYS = (
    "2025-01-01", "2025-01-20", "2025-02-17", "2025-04-18", "2025-05-26", "2025-06-19", "2025-07-04", "2025-09-01", "2025-11-27", "2025-12-25",
    "2026-01-01", "2026-01-19", "2026-02-16", "2026-04-03", "2026-05-25", "2026-06-19", "2026-07-03", "2026-09-07", "2026-11-26", "2026-12-25",
)


def session_of(ts: Column, holidays: tuple[str, ...] = HOLIDAYS) -> Column:
    """Trading session in New York: before 4, pre-market to 9:30, regular to 16, after hours to 20. Weekends and holidays are closed; other years' holidays are the caller's to give."""
    local = F.from_utc_timestamp(ts, "America/New_York")
    minute = F.hour(local) * 60 + F.minute(local)
    open_ = F.when((minute >= 240) & (minute < 570), "pre").when((minute >= 570) & (minute < 960), "regular").when((minute >= 960) & (minute < 1200), "after").otherwise("closed")
    shut = F.weekday(local) >= 5
    return F.when(shut | F.date_format(local, "yyyy-MM-dd").isin(*holidays) if holidays else shut, "closed").otherwise(open_)


#: Sessions and the minutes of the day in New York at which they start and end.
SESSIONS = (("pre", 240, 570), ("regular", 570, 960), ("after", 960, 1200))
#: Days that are looked ahead for a session.
LOOK_AHEAD = 10


def next_session(ts: Column, holidays: tuple[str, ...] = HOLIDAYS, days: int = LOOK_AHEAD) -> tuple[Column, Column, Column]:
    """Name and start of the next session, today's included, and the end of the present one, as times in New York; NULL if none is near, or none is open."""
    local = F.from_utc_timestamp(ts, "America/New_York")
    today = F.to_date(local)
    shut = lambda d: (F.weekday(d) >= 5) | (F.date_format(d, "yyyy-MM-dd").isin(*holidays) if holidays else F.lit(False))
    at = lambda d, minutes: d.cast("timestamp") + F.make_dt_interval(mins=F.lit(minutes))
    open_days = F.filter(F.sequence(today, F.date_add(today, days - 1)), lambda d: ~shut(d))
    starts = F.flatten(F.transform(open_days, lambda d: F.array(*[F.struct(at(d, a).alias("time"), F.lit(name).alias("name")) for name, a, _ in SESSIONS])))
    following = F.try_element_at(F.filter(starts, lambda s: s["time"] > local), F.lit(1))
    close = F.lit(None).cast("timestamp")
    for _, a, b in reversed(SESSIONS):
        close = F.when((local >= at(today, a)) & (local < at(today, b)), at(today, b)).otherwise(close)
    return following["name"], following["time"], F.when(~shut(today), close)


#: Symbols, and bounds of days and of symbols in a request.
SYMBOL, DAYS, BATCH = "^[A-Z0-9.\\-]{1,6}$", (1, 2520), 10


def request_verdict(tickers: Column, days: Column) -> tuple[Column, Column]:
    """Symbols as they are looked up, and the first rule that a request breaks: empty, many, invalid, duplicate, days, or ok."""
    plain = F.transform(tickers, lambda x: F.upper(F.trim(x)))
    bad = F.exists(plain, lambda x: F.coalesce(~F.rlike(x, F.lit(SYMBOL)), F.lit(True)))
    n = fill(F.size(tickers), 0)
    verdict = F.when(n <= 0, "empty").when(n > BATCH, "many").when(bad, "invalid").when(F.size(F.array_distinct(plain)) < n, "duplicate").when(fill(~days.between(*DAYS), True), "days").otherwise("ok")
    return F.when(verdict == "ok", plain), verdict


def watch_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """Best and worst name, volume, active, rising and falling names."""
    return df.groupBy(*keys).agg(
        F.max_by("ticker", F.struct("change", "ticker")).alias("best"), F.min_by("ticker", F.struct("change", "ticker")).alias("worst"), F.sum("volume").alias("volume"),
        F.count_if(F.col("volume") > 0).alias("active"), F.count_if(F.col("change") > 0).alias("up"), F.count_if(F.col("change") < 0).alias("down"))


def watch_alerts(df: DataFrame, keys: list[str], above: float, below: float) -> DataFrame:
    """Prices beyond limits, and volumes above 1.5 times the list's mean."""
    mean = F.avg("volume").over(W.partitionBy(*keys))
    return df.withColumns({"price_alert": F.when(F.col("close") >= above, "above").when(F.col("close") <= below, "below"), "volume_alert": fill(F.col("volume") > 1.5 * mean, False)})


#: Fixed value: how many times the list's mean a volume must exceed.
SPIKE = 1.5


def triggered(alerts: DataFrame, stocks: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """Alerts (keys, symbol, type, value as text, triggered) against lists of stocks (keys, symbol, price, volume) -> with ``triggered`` anew.

    Prices must be beyond the value, a volume above ``SPIKE`` times its list's mean, a report's moment less than a day ago and at most one
    ahead. An alert whose stock isn't listed stays as it is; one of an unknown type, or with a value that can't be read, isn't triggered.
    """
    listed = stocks.select(*keys, "symbol", F.col("price").alias("_price"), F.col("volume").alias("_volume"), F.avg("volume").over(W.partitionBy(*keys)).alias("_mean"), F.lit(True).alias("_listed"))
    value = F.col("value").try_cast("double")
    ahead = (F.unix_micros(F.col("value").try_cast("timestamp")) - F.unix_micros(now)) / 86_400_000_000
    kind = F.col("type")
    hit = (
        F.when(kind == "price_above", F.col("_price") > value).when(kind == "price_below", F.col("_price") < value)
        .when(kind == "volume_spike", F.col("_volume") > SPIKE * F.col("_mean")).when(kind == "earnings", (ahead > -1) & (ahead <= 1))
    )
    met = alerts.join(listed, [*keys, "symbol"], "left")
    return met.withColumn("triggered", F.when(F.col("_listed"), fill(hit, False)).otherwise(F.col("triggered"))).select(*alerts.columns)
