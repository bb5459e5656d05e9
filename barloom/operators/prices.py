"""Price features: every one is a column over the bars of a ticker in order of date.

All defaults and bounds are part of a feature. Features that the next need are computed one level before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.columns import clip, fill, flag, ratio
from barloom.functions.windows import change, exponential_mean, lag, last_known, numbered, percent_rank_shared, rolling, rolling_corr, rolling_quantile, rolling_slope, run_length, series


def returns(bars: DataFrame) -> DataFrame:
    """Log returns over 1, 5 and 21 rows, volatility, range, gap."""
    w = series()
    log = lambda k: F.ln(ratio("close", F.lag("close", k).over(w)))
    df = bars.withColumns({"log_return_1d": log(1), "log_return_5d": log(5), "log_return_21d": log(21)})
    return df.withColumns({
        "volatility_20d": rolling(F.stddev_samp, "log_return_1d", 20, 5),
        "intraday_range": fill(ratio(F.col("high") - F.col("low"), "close"), 0.0),
        "overnight_gap": fill(ratio("open", lag("close")) - 1, 0.0),
    })


def volume(df: DataFrame) -> DataFrame:
    """Volume against its means, and a z-score over 60 rows."""
    v = F.col("volume")
    mean, dev = rolling(F.avg, v, 60, 20), rolling(F.stddev_samp, v, 60, 20)
    return df.withColumns({"volume_ratio": ratio(v, rolling(F.avg, v, 20, 5)), "volume_z60": fill(clip(ratio(v - mean, dev), -5, 5), 0.0)})


def volume_volatility(df: DataFrame) -> DataFrame:
    """Volume ratio over volatility, and -1 times the signs of return and volume's rise: positive when they diverge. Needs ``returns`` and ``volume``."""
    signs = F.signum("log_return_1d") * F.signum(F.col("volume") - lag("volume"))
    return df.withColumns({"volume_vol_ratio": fill(F.col("volume_ratio") / (F.col("volatility_20d") + 1e-6), 0.0), "price_vol_divergence": fill(signs * -1, 0.0) + 0.0})


def volatility_index(df: DataFrame, index: DataFrame) -> DataFrame:
    """(date, vix) -> with the index's log return, its volatility and its level, all of the row before; the last two carry on, the level is 20 at first."""
    w = W.orderBy("date")  # one row a day: the index alone
    v = index.withColumn("_r", F.ln(ratio("vix", F.lag("vix").over(w)))).withColumn("_s", rolling(F.stddev_samp, "_r", 20, 5, w)).select("date", "_r", "_s", F.col("vix").alias("_l"))
    df = df.join(v, "date", "left").withColumns({"_r": lag("_r"), "_s": lag("_s"), "_l": lag("_l")})
    return df.withColumns({"vix_return_1d": fill("_r", 0.0), "vix_vol_20d": fill(last_known("_s"), 0.0), "vix_level": fill(last_known("_l"), 20.0)}).drop("_r", "_s", "_l")


def own_sector(df: DataFrame, funds: DataFrame) -> DataFrame:
    """Output of ``returns`` with ``sector``, and funds (sector, date, close) -> returns of the own sector's fund over 1, 5, 20 and 60 rows, its volatility, and the excess over it; all of the row before."""
    w = series("sector")
    log = lambda k: F.ln(ratio("close", F.lag("close", k).over(w)))
    f = funds.select("sector", "date", *[log(k).alias(f"_r{k}") for k in (1, 5, 20, 60)]).withColumn("_v", rolling(F.stddev_samp, "_r1", 20, 5, w))
    df = df.join(f, ["sector", "date"], "left").withColumn("_vl", lag("_v"))
    df = df.withColumns({**{f"sector_etf_return_{k}d": fill(lag(f"_r{k}"), 0.0) for k in (1, 5, 20, 60)}, "sector_etf_vol_20d": fill(last_known("_vl"), 0.0)})
    return df.withColumns({"excess_vs_sector_5d": fill(lag("log_return_5d"), 0.0) - F.col("sector_etf_return_5d"), "excess_vs_sector_20d": fill(lag("log_return_21d"), 0.0) - F.col("sector_etf_return_20d")}).drop("_r1", "_r5", "_r20", "_r60", "_v", "_vl")


def trend(df: DataFrame) -> DataFrame:
    """Distance from moving means, momentum and its acceleration."""
    sma20 = rolling(F.avg, "close", 20, 20)
    df = df.withColumns({
        "price_vs_sma20": ratio("close", sma20) - 1,
        "price_vs_sma50": fill(ratio("close", rolling(F.avg, "close", 50, 20)) - 1, 0.0),
        "trend_20d": flag(F.col("close") > sma20),
        "momentum_5d": change("close", 5),
        "volume_momentum_5d": fill(change("volume", 5), 0.0),
    })
    return df.withColumn("momentum_accel", fill(F.col("momentum_5d") - lag("momentum_5d"), 0.0)).withColumn("momentum_5d", fill("momentum_5d", 0.0))


def bollinger(df: DataFrame) -> DataFrame:
    sma, dev = rolling(F.avg, "close", 20, 20), rolling(F.stddev_samp, "close", 20, 20)
    return df.withColumns({"bb_position": fill(clip(ratio(F.col("close") - sma, 2 * dev), -3, 3), 0.0), "bb_width": fill(clip(ratio(4 * dev, sma), 0, 0.5), 0.0)})


def macd(df: DataFrame, spans: tuple[int, int, int] = (12, 26, 9), least: tuple[int, int, int] = (8, 18, 6)) -> DataFrame:
    """Difference of two exponential means, its own exponential mean, and what is between, over the close."""
    df = exponential_mean(df, "ticker", "date", {"_fast": ("close", spans[0], least[0]), "_slow": ("close", spans[1], least[1]), "_signal": (("_fast", "_slow"), spans[2], least[2])})
    return df.withColumn("_macd", F.col("_fast") - F.col("_slow")).withColumns({
        "macd_norm": fill(clip(ratio("_macd", "close"), -0.1, 0.1), 0.0),
        "macd_signal_norm": fill(clip(ratio("_signal", "close"), -0.1, 0.1), 0.0),
        "macd_hist_norm": fill(clip(ratio(F.col("_macd") - F.col("_signal"), "close"), -0.05, 0.05), 0.0),
    }).drop("_fast", "_slow", "_macd", "_signal")


def true_range(df: DataFrame) -> DataFrame:
    before = lag("close")
    return df.withColumn("true_range", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def atr(df: DataFrame) -> DataFrame:
    df = true_range(df)
    return df.withColumn("atr_norm", fill(clip(ratio(rolling(F.avg, "true_range", 14, 5), "close"), 0, 0.2), 0.0)).drop("true_range")


def year_range(df: DataFrame) -> DataFrame:
    """Distance from the highest and lowest close of 252 rows."""
    top, low = rolling(F.max, "close", 252, 60), rolling(F.min, "close", 252, 60)
    return df.withColumns({"dist_52w_high": fill(clip(ratio(F.col("close") - top, top), -1, 0), 0.0), "dist_52w_low": fill(clip(ratio(F.col("close") - low, low), 0, 5), 0.0)})


def rsi(df: DataFrame, n: int = 14, least: int = 5, no_loss: float | None = 50.0) -> DataFrame:
    """Relative strength by plain means. ``no_loss`` is its value where no row lost, and also before ``least`` rows."""
    w = series()
    diff = F.col("close") - F.lag("close").over(w)
    df = df.withColumns({"_gain": F.when(diff > 0, diff).otherwise(0.0), "_loss": F.when(diff < 0, -diff).otherwise(0.0)})
    value = 100 - 100 / (1 + ratio(rolling(F.avg, "_gain", n, least), rolling(F.avg, "_loss", n, least)))
    return df.withColumn("rsi", F.coalesce(value, F.lit(no_loss))).drop("_gain", "_loss")


def rsi_divergence(df: DataFrame) -> DataFrame:
    """1 where the price fell while strength rose over 14 rows, -1 for the contrary, seen one row later."""
    df = numbered(df)
    price, strength = rolling_slope("close", 14, 5), rolling_slope("rsi", 14, 5)
    df = df.withColumn("_d", F.when((price < 0) & (strength > 0), 1).when((price > 0) & (strength < 0), -1).otherwise(0))
    return df.withColumn("rsi_divergence", fill(lag("_d"), 0)).drop("_d", "_row")


def candle(df: DataFrame) -> DataFrame:
    """Where the close lies in the day's range, and the shares of body and wicks."""
    span = F.col("high") - F.col("low")
    return df.withColumns({
        "clv": fill(clip(ratio((F.col("close") - F.col("low")) - (F.col("high") - F.col("close")), span), -1, 1), 0.0),
        "candle_body_ratio": fill(clip(ratio(F.abs(F.col("close") - F.col("open")), span), 0, 1), 0.0),
        "upper_wick_ratio": fill(clip(ratio(F.col("high") - F.greatest("open", "close"), span), 0, 1), 0.0),
        "lower_wick_ratio": fill(clip(ratio(F.least("open", "close") - F.col("low"), span), 0, 1), 0.0),
    })


def return_scores(df: DataFrame) -> DataFrame:
    z = lambda n, k: fill(clip(ratio(F.col("log_return_1d") - rolling(F.avg, "log_return_1d", n, k), rolling(F.stddev_samp, "log_return_1d", n, k)), -4, 4), 0.0)
    return df.withColumns({"ret_zscore_5d": z(5, 3), "ret_zscore_10d": z(10, 5)})


def gap_fill(df: DataFrame) -> DataFrame:
    """Whether the day turned back the night's gap, and how often over ten rows."""
    day = F.col("close") - F.col("open")
    df = df.withColumn("gap_filled", flag(((F.col("overnight_gap") > 0) & (day < 0)) | ((F.col("overnight_gap") < 0) & (day > 0))))
    return df.withColumn("gap_fill_rate_10d", fill(rolling(F.avg, F.col("gap_filled").cast("double"), 10, 3), 0.5))


def volume_spike(df: DataFrame) -> DataFrame:
    v = F.col("volume")
    z = fill(clip(ratio(v - rolling(F.avg, v, 10, 5), rolling(F.stddev_samp, v, 10, 5)), -3, 5), 0.0)
    df = df.withColumn("volume_spike_z", z)
    return df.withColumn("volume_return_interaction", fill(clip(F.col("volume_spike_z") * F.signum("log_return_1d"), -5, 5), 0.0))


def balance_slope(df: DataFrame) -> DataFrame:
    """Slope of on-balance volume over ten rows, against mean volume."""
    df = numbered(df).withColumn("_signed", fill(F.col("volume") * F.signum("log_return_1d"), 0.0))
    df = df.withColumn("_obv", F.sum("_signed").over(series().rowsBetween(W.unboundedPreceding, 0)))
    slope = ratio(rolling_slope("_obv", 10, 5), rolling(F.avg, "volume", 10, 5))
    return df.withColumn("obv_slope_10d", fill(clip(slope, -3, 3), 0.0)).drop("_row", "_signed", "_obv")


def calendar(df: DataFrame) -> DataFrame:
    return df.withColumns({"is_monday": flag(F.weekday("date") == 0), "is_friday": flag(F.weekday("date") == 4)})


def consecutive_days(df: DataFrame) -> DataFrame:
    df = run_length(df, F.col("close") - lag("close"), "consecutive_days")
    return df.withColumn("consecutive_days", clip("consecutive_days", -7, 7))


def range_expansion(df: DataFrame) -> DataFrame:
    span = F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    return df.withColumn("range_expansion", fill(clip(ratio(rolling(F.avg, span, 5, 3), rolling(F.avg, span, 20, 10)), 0.3, 3), 1.0))


def against_market(df: DataFrame, index: DataFrame) -> DataFrame:
    """Return beyond the index, the index's volatility, and whether that is high against its own past."""
    w = W.orderBy("date")  # one row a day: the index alone
    m = index.withColumn("_m", F.ln(ratio("market_close", F.lag("market_close").over(w))))
    m = m.withColumn("_v", rolling(F.stddev_samp, "_m", 20, 5, w))
    m = m.withColumn("_lag", F.lag("_v").over(w)).withColumn("_q", rolling_quantile("_lag", 0.7, 60, 20, w))
    m = m.select("date", "_m", fill("_v", 0.0).alias("spy_vol_20d"), flag(F.col("_v") > F.col("_q")).alias("spy_vol_regime"))
    return df.join(m, "date", "left").withColumn("rel_strength_spy", fill(F.col("log_return_1d") - F.col("_m"), 0.0)).drop("_m")


def regimes(df: DataFrame) -> DataFrame:
    """High volatility against 60 rows, rising calm and falling turmoil, and a score of both; known one row later."""
    before = df.withColumns({"_sum": rolling(F.sum, "log_return_1d", 20, 10)}).withColumns({"_vl": lag("volatility_20d"), "_rl": lag("_sum")})
    q = before.withColumns({"_q7": rolling_quantile("_vl", 0.7, 60, 20), "_q3": rolling_quantile("_vl", 0.3, 60, 20)})
    bull = flag((F.col("_rl") > 0) & (F.col("_vl") < F.col("_q3")))
    bear = flag((F.col("_rl") < 0) & (F.col("_vl") > F.col("_q7")))
    out = q.withColumns({"vol_regime": flag(F.col("volatility_20d") > F.col("_q7")), "regime_bull_low_vol": bull, "regime_bear_high_vol": bear, "regime_score": bull - bear})
    return out.drop("_sum", "_vl", "_rl", "_q7", "_q3")


def volatility_shape(df: DataFrame) -> DataFrame:
    """Autocorrelation of absolute returns, and short against long volatility; known one row later."""
    a = df.withColumn("_a", F.abs("log_return_1d"))
    a = a.withColumn("_al", F.coalesce(lag("_a"), F.lit(0.0)))
    a = a.withColumns({"_c": rolling_corr(F.col("_a"), F.col("_al"), 20, 10), "_s5": rolling(F.stddev_samp, "log_return_1d", 5, 3), "_s60": rolling(F.stddev_samp, "log_return_1d", 60, 20)})
    a = a.withColumns({"_r": ratio("_s5", "volatility_20d"), "_t": ratio("_s5", "_s60") - 1})
    return a.withColumns({
        "vol_cluster_autocorr": fill(clip(lag("_c"), -1, 1), 0.0),
        "vol_ratio_5_20": fill(clip(lag("_r"), 0.2, 5), 1.0),
        "vol_term_slope": fill(clip(lag("_t"), -3, 3), 0.0),
    }).drop("_a", "_al", "_c", "_s5", "_s60", "_r", "_t")


def group_momentum(groups: DataFrame) -> DataFrame:
    """Bars of groups -> their returns and volatility, as known one row later, with the shared percentile rank of 20-row momentum (three groups or more)."""
    df = returns(groups).withColumns({"_m20": change("close", 20), "_r20": F.ln(ratio("close", lag("close", 20)))})
    df = df.withColumn("_rank", F.when(F.count("_m20").over(W.partitionBy("date")) >= 3, percent_rank_shared("_m20", "date")))
    return df.select(
        "ticker", "date", fill(lag("log_return_1d"), 0.0).alias("sector_etf_return_1d"), fill(lag("log_return_5d"), 0.0).alias("sector_etf_return_5d"),
        fill(lag("_r20"), 0.0).alias("sector_etf_return_20d"), fill(lag("volatility_20d"), 0.0).alias("sector_etf_vol_20d"), fill(lag("_rank"), 0.5).alias("sector_momentum_rank"),
    )


def excess_momentum(df: DataFrame) -> DataFrame:
    """With the group's 5-row return: excess of momentum, both rising, and momentum whose sign has turned."""
    m, s = F.col("momentum_5d"), F.col("sector_etf_return_5d")
    df = df.withColumns({"_m1": F.lag(m).over(series()), "_m6": F.lag(m, 6).over(series())})
    return df.withColumns({
        "excess_momentum_5d": fill(F.col("_m1") - s, 0.0),
        "dual_momentum_flag": flag((F.col("_m1") > 0) & (s > 0)),
        "momentum_reversal": flag(F.signum("_m1") != F.signum("_m6")),
    }).drop("_m1", "_m6")


def interactions(df: DataFrame) -> DataFrame:
    """Products of features of several blocks; those of blocks that ``df`` lacks are left out."""
    c, have = F.col, set(df.columns)
    made = {
        "momentum_x_volume": (("momentum_5d", "volume_ratio"), lambda: clip(c("momentum_5d") * c("volume_ratio"), -5, 5)),
        "sentiment_x_momentum": (("sent_mean_7d", "momentum_5d"), lambda: clip(fill("sent_mean_7d", 0.0) * c("momentum_5d"), -1, 1)),
        "vol_x_rsi": (("volatility_20d", "rsi"), lambda: clip(fill("volatility_20d", 0.01) * (c("rsi") - 50) / 50, -1, 1)),
        "vix_x_sentiment": (("vix_level", "sent_mean_7d"), lambda: clip(fill("vix_level", 0.0) * fill("sent_mean_7d", 0.0), -5, 5)),
        "insider_x_momentum": (("insider_net_value_30d", "momentum_5d"), lambda: clip(fill("insider_net_value_30d", 0.0) * F.signum("momentum_5d"), -5, 5)),
    }
    return df.withColumns({name: fill(value(), 0.0) for name, (needs, value) in made.items() if have.issuperset(needs)})


#: Rows without these are no rows of the matrix.
CORE = ("log_return_1d", "volatility_20d", "volume_ratio", "price_vs_sma20", "rsi")


def price_block(bars: DataFrame, index: DataFrame) -> DataFrame:
    """All features of prices and of the market, for every bar. What goes through Arrow comes first, while rows are narrow."""
    df = returns(macd(bars))
    for step in (volume, volume_volatility, trend, bollinger, atr, year_range, rsi, rsi_divergence, candle, return_scores, gap_fill, volume_spike, balance_slope, calendar, consecutive_days, range_expansion, regimes, volatility_shape):
        df = step(df)
    return against_market(df, index)


def core_rows(df: DataFrame) -> DataFrame:
    return df.na.drop(subset=list(CORE))


def features(bars: DataFrame, index: DataFrame) -> DataFrame:
    """The price block with its interactions; rows without the core features go."""
    return core_rows(interactions(price_block(bars, index)))
