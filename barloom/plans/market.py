"""Queries of the price block and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.columns import ratio
from barloom.functions.windows import percent_rank_shared, quintile
from barloom.operators import prices
from barloom.sources.tables import bars, market

DIGITS = 6


def day():
    return F.date_format("date", "yyyy-MM-dd").alias("date")


def shown(df: DataFrame, *columns: str) -> DataFrame:
    """Key and columns; real numbers are rounded and dates written alike on both sides of the comparison."""
    kinds = dict(df.dtypes)
    return df.select("ticker", day(), *[(F.round(c, DIGITS) + F.lit(0.0)).alias(c) if kinds[c] == "double" else F.col(c).cast("long").alias(c) for c in columns])


PANEL = """WITH trades AS (
  SELECT {name} AS ticker, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS price, l_quantity,
         struct_pack(a := l_orderkey, b := l_linenumber, c := l_partkey, d := l_suppkey) AS tr
  FROM lineitem JOIN part ON l_partkey = p_partkey),
p AS (SELECT ticker, date, arg_min(price, tr) AS open, max(price) AS high, min(price) AS low, arg_max(price, tr) AS close, sum(l_quantity) AS volume
      FROM trades GROUP BY ticker, date)"""
BRANDS = PANEL.format(name="p_brand")
OVER = "OVER (PARTITION BY ticker ORDER BY date)"


def frame(n: int) -> str:
    return f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def rolled(fn: str, x: str, n: int, least: int) -> str:
    """fn with {} for its argument."""
    return f"(CASE WHEN count({x}) {frame(n)} >= {least} THEN {fn.format(x)} {frame(n)} END)"


def mean(x: str, n: int, k: int) -> str:
    return rolled("avg({})", x, n, k)


def dev(x: str, n: int, k: int) -> str:
    return rolled("stddev_samp({})", x, n, k)


def bound(x: str, low: float, high: float) -> str:
    return f"(CASE WHEN ({x}) IS NOT NULL THEN greatest({low}::DOUBLE, least({high}::DOUBLE, {x})) END)"


def filled(x: str, value: float) -> str:
    return f"coalesce({x}, {value})"


def over(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


RETURNS = BRANDS + f""",
r AS (SELECT *, ln({over("close", f"lag(close) {OVER}")}) AS r1, ln({over("close", f"lag(close, 5) {OVER}")}) AS r5, ln({over("close", f"lag(close, 21) {OVER}")}) AS r21 FROM p),
v AS (SELECT *, {dev("r1", 20, 5)} AS vol20 FROM r)"""


def select(source: str, **columns: str) -> str:
    """The last SELECT: whole columns are named with a leading underscore, which goes."""
    parts = [f"CAST({x} AS BIGINT) AS {n[1:]}" if n[0] == "_" else f"round({x}, {DIGITS}) + 0.0::DOUBLE AS {n}" for n, x in columns.items()]
    return f"\nSELECT ticker, CAST(date AS VARCHAR) AS date, {', '.join(parts)} FROM {source}"


QUERIES, ORACLES = {}, {}


def query(name: str, sql: str, *columns: str):
    """Registers a function from bars to features with its SQL."""

    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: shown(fn(bars(spark, sf_dir)), *columns)
        ORACLES[name] = sql
        return fn

    return register


def ohlcv_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(bars(spark, sf_dir), "open", "high", "low", "close", "volume")


QUERIES["ohlcv_panel"] = ohlcv_panel
ORACLES["ohlcv_panel"] = BRANDS + select("p", open="open", high="high", low="low", close="close", volume="volume")

query("log_returns", RETURNS + select("v", log_return_1d="r1", log_return_5d="r5", log_return_21d="r21"), "log_return_1d", "log_return_5d", "log_return_21d")(prices.returns)
query("rolling_stats", RETURNS + select("v", volatility_20d="vol20", intraday_range=filled(over("high - low", "close"), 0), overnight_gap=filled(over("open", f"lag(close) {OVER}") + " - 1", 0)), "volatility_20d", "intraday_range", "overnight_gap")(prices.returns)
query("volume_zscore", BRANDS + select("p", volume_ratio=over("volume", mean("volume", 20, 5)), volume_z60=filled(bound(over(f"volume - {mean('volume', 60, 20)}", dev("volume", 60, 20)), -5, 5), 0)), "volume_ratio", "volume_z60")(prices.volume)
query(
    "trend_momentum",
    BRANDS + f""", m AS (SELECT *, {mean("close", 20, 20)} AS s20, {mean("close", 50, 20)} AS s50, {over("close", f"lag(close, 5) {OVER}")} - 1 AS m5, {over("volume", f"lag(volume, 5) {OVER}")} - 1 AS vm5 FROM p)"""
    + select("m", price_vs_sma20=over("close", "s20") + " - 1", price_vs_sma50=filled(over("close", "s50") + " - 1", 0), _trend_20d="CASE WHEN close > s20 THEN 1 ELSE 0 END", momentum_5d=filled("m5", 0), volume_momentum_5d=filled("vm5", 0), momentum_accel=filled(f"m5 - lag(m5) {OVER}", 0)),
    "price_vs_sma20", "price_vs_sma50", "trend_20d", "momentum_5d", "volume_momentum_5d", "momentum_accel",
)(prices.trend)
query("bollinger", BRANDS + f", b AS (SELECT *, {mean('close', 20, 20)} AS s, {dev('close', 20, 20)} AS d FROM p)" + select("b", bb_position=filled(bound(over("close - s", "2 * d"), -3, 3), 0), bb_width=filled(bound(over("4 * d", "s"), 0, 0.5), 0)), "bb_position", "bb_width")(prices.bollinger)


def _ewm(x: str, span: int, least: int) -> str:
    """Recursive exponential mean of a column without gaps after its first value."""
    a = 2 / (span + 1)
    up = "OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)"
    return f"(CASE WHEN count({x}) {up} >= {least} THEN list_reduce(list({x}) FILTER ({x} IS NOT NULL) {up}, lambda a, x: a * {1 - a!r} + x * {a!r}) END)"


query(
    "macd",
    BRANDS + f", e AS (SELECT *, {_ewm('close', 12, 8)} - {_ewm('close', 26, 18)} AS m FROM p), s AS (SELECT *, {_ewm('m', 9, 6)} AS sig FROM e)"
    + select("s", macd_norm=filled(bound("m / close", -0.1, 0.1), 0), macd_signal_norm=filled(bound("sig / close", -0.1, 0.1), 0), macd_hist_norm=filled(bound("(m - sig) / close", -0.05, 0.05), 0)),
    "macd_norm", "macd_signal_norm", "macd_hist_norm",
)(prices.macd)
TR = f"greatest(high - low, coalesce(abs(high - lag(close) {OVER}), high - low), coalesce(abs(low - lag(close) {OVER}), high - low))"
query("atr", BRANDS + f", t AS (SELECT *, {TR} AS tr FROM p)" + select("t", atr_norm=filled(bound(over(mean("tr", 14, 5), "close"), 0, 0.2), 0)), "atr_norm")(prices.atr)
query(
    "dist_52w",
    BRANDS + f", x AS (SELECT *, {rolled('max({})', 'close', 252, 60)} AS hi, {rolled('min({})', 'close', 252, 60)} AS lo FROM p)" + select("x", dist_52w_high=filled(bound(over("close - hi", "hi"), -1, 0), 0), dist_52w_low=filled(bound(over("close - lo", "lo"), 0, 5), 0)),
    "dist_52w_high", "dist_52w_low",
)(prices.year_range)
RSI = BRANDS + f""",
g AS (SELECT *, close - lag(close) {OVER} AS d FROM p),
h AS (SELECT *, CASE WHEN d > 0 THEN d ELSE 0 END AS gain, CASE WHEN d < 0 THEN -d ELSE 0 END AS loss, row_number() {OVER} AS n FROM g),
i AS (SELECT *, coalesce(100 - 100 / (1 + {mean("gain", 14, 5)} / nullif({mean("loss", 14, 5)}, 0)), 50) AS rsi FROM h)"""
query("rsi", RSI + select("i", rsi="rsi"), "rsi")(prices.rsi)
query(
    "rsi_divergence",
    RSI + f", j AS (SELECT *, round({rolled('regr_slope({}, n)', 'close', 14, 5)}, 9) AS ps, round({rolled('regr_slope({}, n)', 'rsi', 14, 5)}, 9) AS rs FROM i), k AS (SELECT *, CASE WHEN ps < 0 AND rs > 0 THEN 1 WHEN ps > 0 AND rs < 0 THEN -1 ELSE 0 END AS dv FROM j)"
    + select("k", _rsi_divergence=f"coalesce(lag(dv) {OVER}, 0)"),
    "rsi_divergence",
)(lambda df: prices.rsi_divergence(prices.rsi(df)))
query(
    "candle_shape",
    BRANDS + select("p", clv=filled(bound(over("(close - low) - (high - close)", "high - low"), -1, 1), 0), candle_body_ratio=filled(bound(over("abs(close - open)", "high - low"), 0, 1), 0), upper_wick_ratio=filled(bound(over("high - greatest(open, close)", "high - low"), 0, 1), 0), lower_wick_ratio=filled(bound(over("least(open, close) - low", "high - low"), 0, 1), 0)),
    "clv", "candle_body_ratio", "upper_wick_ratio", "lower_wick_ratio",
)(prices.candle)
query("ret_zscore", RETURNS + select("v", ret_zscore_5d=filled(bound(over(f"r1 - {mean('r1', 5, 3)}", dev("r1", 5, 3)), -4, 4), 0), ret_zscore_10d=filled(bound(over(f"r1 - {mean('r1', 10, 5)}", dev("r1", 10, 5)), -4, 4), 0)), "ret_zscore_5d", "ret_zscore_10d")(lambda df: prices.return_scores(prices.returns(df)))
query(
    "gap_fill_rate",
    BRANDS + f", g AS (SELECT *, coalesce({over('open', f'lag(close) {OVER}')} - 1, 0) AS gap FROM p), f AS (SELECT *, CASE WHEN (gap > 0 AND close < open) OR (gap < 0 AND close > open) THEN 1.0 ELSE 0.0 END AS f FROM g)"
    + select("f", _gap_filled="f", gap_fill_rate_10d=filled(mean("f", 10, 3), 0.5)),
    "gap_filled", "gap_fill_rate_10d",
)(lambda df: prices.gap_fill(prices.returns(df)))
SPIKE = filled(bound(over(f"volume - {mean('volume', 10, 5)}", dev("volume", 10, 5)), -3, 5), 0)
query(
    "volume_spike",
    RETURNS + f", z AS (SELECT *, {SPIKE} AS z FROM v)" + select("z", volume_spike_z="z", volume_return_interaction=filled(bound("z * sign(r1)", -5, 5), 0)),
    "volume_spike_z", "volume_return_interaction",
)(lambda df: prices.volume_spike(prices.returns(df)))
query(
    "obv_slope",
    RETURNS + f", o AS (SELECT *, row_number() {OVER} AS n, sum(coalesce(volume * sign(r1), 0)) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS obv FROM v)"
    + select("o", obv_slope_10d=filled(bound(over(rolled("regr_slope({}, n)", "obv", 10, 5), mean("volume", 10, 5)), -3, 3), 0)),
    "obv_slope_10d",
)(lambda df: prices.balance_slope(prices.returns(df)))
query("calendar_flags", BRANDS + select("p", _is_monday="CASE WHEN isodow(date) = 1 THEN 1 ELSE 0 END", _is_friday="CASE WHEN isodow(date) = 5 THEN 1 ELSE 0 END"), "is_monday", "is_friday")(prices.calendar)
query(
    "consecutive_days",
    BRANDS + f", s AS (SELECT *, coalesce(sign(close - lag(close) {OVER}), 0) AS s FROM p), c AS (SELECT *, CASE WHEN s = lag(s) {OVER} THEN 0 ELSE 1 END AS new FROM s), g AS (SELECT *, sum(new) {OVER} AS run FROM c)"
    + select("g", consecutive_days=bound("sum(s) OVER (PARTITION BY ticker, run ORDER BY date)::DOUBLE", -7, 7)),
    "consecutive_days",
)(prices.consecutive_days)
SPAN = "nullif(high - low, 0)"
query("range_expansion", BRANDS + select("p", range_expansion=filled(bound(over(mean(SPAN, 5, 3), mean(SPAN, 20, 10)), 0.3, 3), 1)), "range_expansion")(prices.range_expansion)
INDEX = RETURNS + f""",
m AS (SELECT date, avg(close) AS mc FROM p GROUP BY date),
m1 AS (SELECT *, 1 AS ticker, ln(mc / lag(mc) OVER (ORDER BY date)) AS mr FROM m),
m2 AS (SELECT *, {dev("mr", 20, 5)} AS mv FROM m1),
m3 AS (SELECT *, lag(mv) OVER (ORDER BY date) AS ml FROM m2),
m4 AS (SELECT *, {rolled("quantile_cont({}, 0.7)", "ml", 60, 20)} AS mq FROM m3)"""
QUERIES["rel_strength"] = lambda spark, sf_dir: shown(prices.against_market(prices.returns(b := bars(spark, sf_dir)), market(b)), "rel_strength_spy", "spy_vol_20d", "spy_vol_regime")
ORACLES["rel_strength"] = INDEX + ", z AS (SELECT v.*, mr, mv, mq FROM v LEFT JOIN m4 USING (date))" + select("z", rel_strength_spy="coalesce(r1 - mr, 0)", spy_vol_20d="coalesce(mv, 0)", _spy_vol_regime="CASE WHEN mv > mq THEN 1 ELSE 0 END")
REGIME = RETURNS + f""",
a AS (SELECT *, lag(vol20) {OVER} AS vl, {rolled("sum({})", "r1", 20, 10)} AS s20 FROM v),
b AS (SELECT *, lag(s20) {OVER} AS rl, {rolled("quantile_cont({}, 0.7)", "vl", 60, 20)} AS q7, {rolled("quantile_cont({}, 0.3)", "vl", 60, 20)} AS q3 FROM a),
c AS (SELECT *, CASE WHEN rl > 0 AND vl < q3 THEN 1 ELSE 0 END AS bull, CASE WHEN rl < 0 AND vl > q7 THEN 1 ELSE 0 END AS bear FROM b)"""
query("vol_regime", REGIME + select("c", _vol_regime="CASE WHEN vol20 > q7 THEN 1 ELSE 0 END"), "vol_regime")(lambda df: prices.regimes(prices.returns(df)))
query("regime_score", REGIME + select("c", _regime_bull_low_vol="bull", _regime_bear_high_vol="bear", _regime_score="bull - bear"), "regime_bull_low_vol", "regime_bear_high_vol", "regime_score")(lambda df: prices.regimes(prices.returns(df)))
query(
    "vol_autocorr",
    RETURNS + f""", a AS (SELECT *, abs(r1) AS ab FROM v), b AS (SELECT *, coalesce(lag(ab) {OVER}, 0) AS al FROM a),
c AS (SELECT *, {rolled("corr({}, al)", "ab", 20, 10)} AS c, {dev("r1", 5, 3)} AS s5, {dev("r1", 60, 20)} AS s60 FROM b),
d AS (SELECT *, lag(c) {OVER} AS cl, lag(s5 / nullif(vol20, 0)) {OVER} AS rl, lag(s5 / nullif(s60, 0) - 1) {OVER} AS tl FROM c)"""
    + select("d", vol_cluster_autocorr=filled(bound("cl", -1, 1), 0), vol_ratio_5_20=filled(bound("rl", 0.2, 5), 1), vol_term_slope=filled(bound("tl", -3, 3), 0)),
    "vol_cluster_autocorr", "vol_ratio_5_20", "vol_term_slope",
)(lambda df: prices.volatility_shape(prices.returns(df)))
TYPES = PANEL.format(name="p_type") + f""",
r AS (SELECT *, ln(close / lag(close) {OVER}) AS r1, ln(close / lag(close, 5) {OVER}) AS r5, ln(close / lag(close, 20) {OVER}) AS r20, close / lag(close, 20) {OVER} - 1 AS m20 FROM p),
v AS (SELECT *, {dev("r1", 20, 5)} AS vol20, CASE WHEN m20 IS NOT NULL AND count(m20) OVER (PARTITION BY date) >= 3 THEN
      (rank() OVER (PARTITION BY date ORDER BY m20 NULLS LAST) + (count(*) OVER (PARTITION BY date, m20) - 1) / 2.0) / count(m20) OVER (PARTITION BY date) END AS pr FROM r)"""
QUERIES["sector_momentum_rank"] = lambda spark, sf_dir: shown(prices.group_momentum(bars(spark, sf_dir, "p_type")), "sector_etf_return_1d", "sector_etf_return_5d", "sector_etf_return_20d", "sector_etf_vol_20d", "sector_momentum_rank")
ORACLES["sector_momentum_rank"] = TYPES + select("v", **{f"sector_etf_{n}": f"coalesce(lag({x}) {OVER}, 0)" for n, x in (("return_1d", "r1"), ("return_5d", "r5"), ("return_20d", "r20"), ("vol_20d", "vol20"))}, sector_momentum_rank=f"coalesce(lag(pr) {OVER}, 0.5)")


def _with_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands with the return of the market as their group's."""
    b = bars(spark, sf_dir)
    w = W.orderBy("date")
    group = market(b).select("date", F.coalesce(F.ln(ratio("market_close", F.lag("market_close", 5).over(w))), F.lit(0.0)).alias("sector_etf_return_5d"))
    return prices.excess_momentum(prices.trend(b).join(group, "date", "left"))


QUERIES["excess_momentum"] = lambda spark, sf_dir: shown(_with_group(spark, sf_dir), "excess_momentum_5d", "dual_momentum_flag", "momentum_reversal")
ORACLES["excess_momentum"] = (
    BRANDS
    + f""", k AS (SELECT date, avg(close) AS mc FROM p GROUP BY date), g AS (SELECT date, coalesce(ln(mc / lag(mc, 5) OVER (ORDER BY date)), 0) AS s FROM k),
m AS (SELECT *, coalesce({over("close", f"lag(close, 5) {OVER}")} - 1, 0) AS m5 FROM p),
n AS (SELECT m.*, s, lag(m5) {OVER} AS m1, lag(m5, 6) {OVER} AS m6 FROM m LEFT JOIN g USING (date))"""
    + select("n", excess_momentum_5d="coalesce(m1 - s, 0)", _dual_momentum_flag="CASE WHEN m1 > 0 AND s > 0 THEN 1 ELSE 0 END", _momentum_reversal="CASE WHEN sign(m1) <> sign(m6) THEN 1 ELSE 0 END")
)


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-section of each day by five-row momentum: rank, shared percentile, quintile, signal."""
    df = prices.trend(bars(spark, sf_dir)).where(F.col("momentum_5d") != 0)
    n = F.count("*").over(W.partitionBy("date"))
    df = df.withColumns({"n": n, "rank": F.row_number().over(W.partitionBy("date").orderBy(F.desc("momentum_5d"), "ticker")), "percent": percent_rank_shared("momentum_5d", "date")})
    df = df.where("n >= 5").withColumn("quintile", quintile(F.col("rank"), F.col("n")))
    top = F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("n") * 0.2))
    return df.withColumn("signal", F.when(top, "top").when(F.col("quintile") == 5, "bottom").otherwise("middle"))


QUERIES["xs_rank_quintile"] = lambda spark, sf_dir: ranked(spark, sf_dir).select("ticker", day(), F.round("momentum_5d", 6).alias("momentum_5d"), F.col("rank").cast("long").alias("rank"), F.round("percent", 6).alias("percent"), F.col("quintile").cast("long").alias("quintile"), "signal")
RANKED = BRANDS + f""", m AS (SELECT ticker, date, coalesce({over("close", f"lag(close, 5) {OVER}")} - 1, 0) AS m5 FROM p), q AS (SELECT *, count(*) OVER (PARTITION BY date) AS n,
row_number() OVER (PARTITION BY date ORDER BY m5 DESC, ticker) AS rk, (rank() OVER (PARTITION BY date ORDER BY m5) + (count(*) OVER (PARTITION BY date, m5) - 1) / 2.0) / count(*) OVER (PARTITION BY date) AS pc FROM m WHERE m5 <> 0),
s AS (SELECT *, CAST(least(5, 1 + floor((rk - 1) / greatest(1.0::DOUBLE, n / 5.0::DOUBLE))) AS BIGINT) AS qu FROM q WHERE n >= 5)"""
ORACLES["xs_rank_quintile"] = RANKED + " SELECT ticker, CAST(date AS VARCHAR) AS date, round(m5, 6) AS momentum_5d, CAST(rk AS BIGINT) AS rank, round(pc, 6) AS percent, qu AS quintile, CASE WHEN rk <= greatest(1, floor(n * 0.2)) THEN 'top' WHEN qu = 5 THEN 'bottom' ELSE 'middle' END AS signal FROM s"


def top_of_last_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best fifth of the last day that has five names or more."""
    df = ranked(spark, sf_dir)
    last = df.agg(F.max("date").alias("date"))
    return df.join(last, "date").where("signal = 'top'").select("ticker", day(), F.round("momentum_5d", 6).alias("momentum_5d"), F.col("rank").cast("long").alias("rank"))


QUERIES["top_quintile_pick"] = top_of_last_day
ORACLES["top_quintile_pick"] = RANKED + " SELECT ticker, CAST(date AS VARCHAR) AS date, round(m5, 6) AS momentum_5d, CAST(rk AS BIGINT) AS rank FROM s WHERE rk <= greatest(1, floor(n * 0.2)) AND date = (SELECT max(date) FROM s)"
