"""Queries of fitted trees, rules with a memory, keywords, candidate paths and forms on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.valence import valence, valence_label
from barloom.operators import adapters, evaluation, forms, modelling, news, prices, trees
from barloom.plans import adapters as blocks
from barloom.plans import market as market_plans
from barloom.plans import more
from barloom.plans.adapters import as_text, monthly, r6, reports
from barloom.plans.market import BRANDS
from barloom.sources import paths
from barloom.sources.tables import bars, market, table
from barloom.streaming import rules

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


NAMES = ["volatility_20d", "rsi", "price_vs_sma20", "momentum_5d", "volume_ratio", "clv", "log_return_1d"]


def labelled(spark, sf_dir) -> DataFrame:
    """Features of the price block with the return over the next five rows. The walk forward reads them several times, sales once."""
    df = prices.candle(prices.rsi(prices.trend(prices.volume(prices.returns(bars(spark, sf_dir))))))
    return evaluation.realised(df, 5).select("ticker", "date", *NAMES, "realised").persist()


def fitted(spark, sf_dir, folds: int):
    """Measures, gains of the first fold, and the last model of a walk forward."""
    return trees.fit_folds(modelling.walk_forward(labelled(spark, sf_dir), 5), NAMES, "realised", folds)


@query("fold_training")
def fold_training(spark, sf_dir):
    """Each fold of the walk forward: errors, hits and quantiles on its held-out rows, and how many rounds these asked for."""
    found, _, _ = fitted(spark, sf_dir, modelling.FOLDS)
    return spark.createDataFrame(found, "fold int, n long, rmse double, mae double, hit double, corr double, q90 double, q95 double, rounds int")


@query("fold_gains")
def fold_gains(spark, sf_dir):
    """Gains of features in the fold that has seen no later row, with their share."""
    return trees.with_share(spark.createDataFrame(fitted(spark, sf_dir, 1)[1], "feature string, gain double, splits int"))


@query("tree_explanations")
def tree_explanations(spark, sf_dir):
    """What moves the prediction of each row of the held-out part: base, sum, the two strongest features to either side."""
    folds = modelling.walk_forward(labelled(spark, sf_dir), 5).where("fold = 0")
    _, _, model = trees.fit_folds(folds, NAMES, "realised", 1)
    if model is None:
        return spark.createDataFrame([], "ticker string, date string, prediction double, base_value double, shap_prediction double, sanity_ok boolean, up string, down string")
    held = model.transform(folds.where("role = 'validation' AND realised IS NOT NULL"))
    out = trees.explain(held, model.stages[-1], NAMES, [f"{n}_filled" for n in NAMES], top=2)
    names = lambda side: F.array_join(F.transform(f"top_{side}_contrib", lambda c: c["feature"]), ",")
    return out.select("ticker", as_text(), "prediction", "base_value", "shap_prediction", "sanity_ok", names("positive").alias("up"), names("negative").alias("down"))


def timed(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("rate_verdicts")
def rate_verdicts(spark, sf_dir):
    """Events as calls of their users: five in three days, two a day. A refused call doesn't count; tests hold it to a plain loop."""
    return rules.on_table(rules.RateLimit(5, 3 * 86_400, daily=2), timed(spark, sf_dir), "user_id", "ts", "event_id")


@query("quote_reads", """WITH q AS (SELECT user_id, event_id, ts, event_type = 'view' AS reads, last_value(CASE WHEN event_type <> 'view' THEN struct_pack(p := value, t := ts) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS l FROM events)
SELECT user_id, event_id, CASE WHEN epoch_us(ts) - epoch_us(l.t) < 43200000000 THEN l.p END AS price, CASE WHEN epoch_us(ts) - epoch_us(l.t) < 43200000000 THEN round((epoch_us(ts) - epoch_us(l.t)) / 1e6, 3) END AS age_seconds FROM q WHERE reads""")
def quote_reads(spark, sf_dir):
    """Views read the user's last value, which lives for half a day."""
    e = timed(spark, sf_dir).withColumn("quote", F.when(F.col("event_type") != "view", F.col("value")))
    return rules.quotes_on_table(e, "user_id", "ts", "event_id", "quote", 43_200).select("user_id", "event_id", "price", F.round("age_seconds", 3).alias("age_seconds"))


@query("mood_notices")
def mood_notices(spark, sf_dir):
    """Values of a kind of events as an index, each against the one before, told once in six hours."""
    before = F.lag("value").over(W.partitionBy("event_type").orderBy("ts", "event_id"))
    return rules.on_table(rules.Mood(throttle=21_600), timed(spark, sf_dir).withColumn("previous", before), "event_type", "ts", "event_id").drop("ts")


@query("price_notices")
def price_notices(spark, sf_dir):
    """A user's value against the one before, told once in a day."""
    before = F.lag("value").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return rules.on_table(rules.PriceNotice(throttle=86_400), timed(spark, sf_dir).withColumns({"previous": before, "price": F.col("value")}), "user_id", "ts", "event_id").drop("ts")


@query("session_notices", """WITH n AS (SELECT ts - INTERVAL 5 HOUR AS t, ts FROM events), m AS (SELECT CAST(t AS DATE) AS d, hour(t) * 60 + minute(t) AS m, ts FROM n WHERE isodow(t) < 6),
k AS (SELECT *, CASE WHEN m BETWEEN 240 AND 244 THEN 'Pre-Market Open' WHEN m BETWEEN 570 AND 574 THEN 'Market Open' WHEN m BETWEEN 960 AND 964 THEN 'Market Closed' WHEN m BETWEEN 1200 AND 1204 THEN 'After-Hours Closed' END AS title FROM m)
SELECT CAST(d AS VARCHAR) AS date, CASE WHEN title LIKE 'Market%' THEN 'alert' ELSE 'market' END AS type, title, epoch_us(min(ts)) AS first FROM k WHERE title IS NOT NULL GROUP BY 1, 2, 3""")
def session_notices(spark, sf_dir):
    """Events as ticks of a clock. They lie in January, when New York is five hours behind."""
    return rules.session_notices(timed(spark, sf_dir), "ts").select(as_text(), "type", "title", F.unix_micros("first").alias("first"))


#: Valences of a few words of the tables' invented languages.
WORDS = {"the": 1.0, "of": -1.0, "and": 0.5, "die": 1.5, "der": -1.5, "le": 1.2, "de": -1.1, "que": 0.7}


@query("valence_scores")
def valence_scores(spark, sf_dir):
    """Valence of each turn of the conversations; tests hold it to a plain loop."""
    df = table(spark, sf_dir, "conversations").withColumn("score", valence(F.col("text"), WORDS))
    return df.select("conv_id", "turn", "score", valence_label(F.col("score")).alias("label"))


@query("keyword_events", """WITH k AS (SELECT lower(string_split(p_name, ' ')[2]) AS keyword, list(DISTINCT p_brand) FILTER (p_size <= 3) AS tickers FROM part WHERE string_split(p_name, ' ')[2] < 's' GROUP BY 1),
u AS (SELECT DISTINCT p_brand AS ticker FROM part WHERE p_size < 40 UNION SELECT unnest(['SPY', 'DIA'])), n AS (SELECT DISTINCT lower(p_name) AS name FROM part),
m AS (SELECT name, unnest(tickers) AS ticker FROM n JOIN k ON contains(name, keyword)), f AS (SELECT name, string_agg(DISTINCT ticker, ',' ORDER BY ticker) FILTER (ticker IN (SELECT ticker FROM u)) AS found, count(*) AS hits FROM m GROUP BY 1)
SELECT p_partkey, CASE WHEN hits > 0 THEN coalesce(found, '') WHEN p_size >= 25 THEN 'DIA,SPY' ELSE '' END AS tickers FROM part LEFT JOIN f ON lower(p_name) = name""")
def keyword_events(spark, sf_dir):
    """Parts as events by name; the second words of names as keywords, with brands as what they touch."""
    p = table(spark, sf_dir, "part")
    second = F.try_element_at(F.split("p_name", " "), F.lit(2))
    words = p.where(second < "s").groupBy(F.lower(second).alias("keyword")).agg(F.collect_set(F.when(F.col("p_size") <= 3, F.col("p_brand"))).alias("tickers"))
    # The two names of the broad market are known whatever the table holds.
    universe = p.where("p_size < 40").select(F.col("p_brand").alias("ticker")).union(p.limit(1).select(F.explode(F.array(F.lit("SPY"), F.lit("DIA")))))
    events = p.select("p_partkey", F.col("p_name").alias("event"), F.when(F.col("p_size") >= 25, "high").alias("importance"))
    return news.matched_events(events, words, universe).select("p_partkey", F.array_join("tickers", ",").alias("tickers"))


@query("short_interest_records", """WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place, CAST(ts AS DATE) AS d, event_id, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY d DESC, place) AS n FROM e)
SELECT user_id, CASE WHEN user_id % 2 = 0 THEN strftime(d, '%m/%d/%Y') ELSE CAST(d AS VARCHAR) END AS settlement_date, event_id AS short_interest, CASE WHEN user_id % 3 = 2 THEN 0 ELSE k * 1000 END AS avg_daily_volume, round(value, 6) AS days_to_cover FROM r WHERE n <= 20""")
def short_interest_records(spark, sf_dir):
    """Events of a user as the records of a document, in one of three shapes and with either name of its fields."""
    k = F.get_json_object("props", "$.k").cast("int")
    day = F.when(F.col("user_id") % 2 == 0, F.date_format("ts", "MM/dd/yyyy")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    new = F.struct(day.alias("settlementDate"), F.format_number("event_id", 0).alias("interest"), F.concat(F.lit("$"), F.format_number(k * 1000, 0)).alias("avgDailyShareVolume"), F.col("value").alias("daysToCover"))
    old = F.struct(day.alias("date"), F.col("event_id").alias("shortInterest"), F.col("value").alias("daysToCoVerShortInterest"))
    rows = lambda r: F.transform(F.array_sort(F.collect_list(F.struct("event_id", r.alias("r")))), lambda x: x["r"])
    of = table(spark, sf_dir, "events").groupBy("user_id").agg(rows(new).alias("new"), rows(old).alias("old"))
    shape = F.col("user_id") % 3
    nested = F.to_json(F.struct(F.struct(F.struct(F.col("new").alias("rows")).alias("shortInterestTable")).alias("data")))
    json = F.when(shape == 0, nested).when(shape == 1, F.to_json(F.struct(F.array().cast("array<int>").alias("data"), F.col("new").alias("results")))).otherwise(F.to_json(F.struct(F.struct(F.col("old").alias("rows")).alias("data"))))
    return paths.short_interest(of.select("user_id", json.alias("json")), "user_id", "json").select("user_id", "settlement_date", "short_interest", "avg_daily_volume", *r6("days_to_cover"))


@query("page_narratives")
def page_narratives(spark, sf_dir):
    """Sections and text of each page; tests hold it to hand-made forms."""
    return forms.narrative(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id").select("page_id", F.size("sections").alias("sections"), "text")


#: Queries of blocks, whose SQL makes the SQL of the matrix, with their columns there.
BLOCKS = {
    "ohlcv_panel": "open high low close volume", "log_returns": "log_return_1d log_return_5d log_return_21d", "rolling_stats": "volatility_20d intraday_range overnight_gap", "volume_zscore": "volume_ratio volume_z60",
    "volume_divergence": "volume_vol_ratio price_vol_divergence", "trend_momentum": "price_vs_sma20 price_vs_sma50 trend_20d momentum_5d volume_momentum_5d momentum_accel", "bollinger": "bb_position bb_width", "macd": "macd_norm macd_signal_norm macd_hist_norm",
    "atr": "atr_norm", "dist_52w": "dist_52w_high dist_52w_low", "rsi": "rsi", "rsi_divergence": "rsi_divergence", "candle_shape": "clv candle_body_ratio upper_wick_ratio lower_wick_ratio", "ret_zscore": "ret_zscore_5d ret_zscore_10d",
    "gap_fill_rate": "gap_filled gap_fill_rate_10d", "volume_spike": "volume_spike_z volume_return_interaction", "obv_slope": "obv_slope_10d", "calendar_flags": "is_monday is_friday", "consecutive_days": "consecutive_days", "range_expansion": "range_expansion",
    "rel_strength": "rel_strength_spy spy_vol_20d spy_vol_regime", "vol_regime": "vol_regime", "regime_score": "regime_bull_low_vol regime_bear_high_vol regime_score", "vol_autocorr": "vol_cluster_autocorr vol_ratio_5_20 vol_term_slope",
    "vix_features": "vix_return_1d vix_vol_20d vix_level", "own_sector": "sector_etf_return_1d sector_etf_return_5d sector_etf_return_20d sector_etf_return_60d sector_etf_vol_20d excess_vs_sector_5d excess_vs_sector_20d",
    "earnings_surprise": "earnings_surprise earnings_beat earnings_recency earnings_surprise_pct", "days_since_event": "days_since_earnings", "asof_short_interest": "si_short_float_pct si_days_to_cover si_available", "fundamentals_asof": "fund_pe",
    "macro_ffill_lag": "macro_spread macro_short macro_spread_chg macro_short_chg",
}
SCORES = ("urgent", "low")
#: Without the z-scores over 360 days, which take as long as all else; ``insider_rolling_z`` has such a one.
INSIDER = adapters.INSIDER[:8]
SENT_COLUMNS = [*adapters.SENTIMENT, *[f"sent_{c}_mean_7d" for c in SCORES]]


def _sentiment_sql() -> str:
    least = lambda fn, x, n, k: f"CASE WHEN count({x}) OVER (PARTITION BY ticker ORDER BY date ROWS {n - 1} PRECEDING) >= {k} THEN {fn}({x}) OVER (PARTITION BY ticker ORDER BY date ROWS {n - 1} PRECEDING) END"
    return BRANDS + f""", d AS (SELECT 'Brand#' || CAST(o_custkey % 25 + 1 AS VARCHAR) AS ticker, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice / 250000 - 1) AS s, count(*)::DOUBLE AS n, count(DISTINCT o_orderpriority)::DOUBLE AS k,
 avg(o_totalprice / 250000 - 1) FILTER (o_orderpriority = '1-URGENT') AS urgent, avg(o_totalprice / 250000 - 1) FILTER (o_orderpriority = '5-LOW') AS low FROM orders GROUP BY ALL),
w AS (SELECT *, {least('avg', 's', 7, 3)} AS m7, {least('avg', 's', 30, 10)} AS m30, {least('stddev_samp', 's', 7, 3)} AS s7, {least('sum', 'n', 7, 1)} AS n7, {least('avg', 'n', 30, 10)} AS n30, {least('avg', 'urgent', 7, 3)} AS u7, {least('avg', 'low', 7, 3)} AS l7 FROM d),
j AS (SELECT p.ticker, p.date, s, m7, m30, m7 - m30 AS mo, s7, n, coalesce(n7, 0) AS n7, coalesce(n / (n30 + 1e-6::DOUBLE), 0) AS sp, w.ticker IS NOT NULL AS a, k, u7, l7 FROM p LEFT JOIN w ON w.ticker = p.ticker AND w.date = p.date)
SELECT ticker, CAST(date AS VARCHAR) AS date, """ + ", ".join(f"round(lag({x}) OVER t, 6) + 0.0::DOUBLE AS {c}" for c, x in zip(SENT_COLUMNS, ("s", "m7", "m30", "mo", "s7", "n", "CASE WHEN a THEN n7 END", "CASE WHEN a THEN sp END", "CASE WHEN a THEN 1 END", "k", "u7", "l7"), strict=True)) + " FROM j WINDOW t AS (PARTITION BY ticker ORDER BY date)"


def _insider_sql() -> str:
    w = lambda x, n: f"sum({x}) OVER (PARTITION BY ticker ORDER BY date ROWS {n - 1} PRECEDING)"
    return BRANDS + f""", d AS (SELECT 'Brand#' || CAST(o_custkey % 25 + 1 AS VARCHAR) AS ticker, CAST(o_orderdate AS DATE) AS date, sum(CASE o_orderstatus WHEN 'F' THEN v WHEN 'O' THEN -v ELSE 0 END) AS net, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS b, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS s,
 sum(CASE WHEN o_orderstatus = 'F' THEN v ELSE 0 END) AS bv, sum(CASE WHEN o_orderstatus = 'O' THEN v ELSE 0 END) AS sv, count(*) AS n FROM (SELECT *, o_totalprice / 1000 AS v FROM orders) GROUP BY ALL),
c AS (SELECT ticker, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS date FROM d GROUP BY ticker), e AS (SELECT c.ticker, c.date, coalesce(net, 0) AS net, coalesce(b, 0) AS b, coalesce(s, 0) AS s, coalesce(bv, 0) AS bv, coalesce(sv, 0) AS sv, coalesce(n, 0) AS n FROM c LEFT JOIN d ON d.ticker = c.ticker AND d.date = c.date),
f AS (SELECT *, {w('net', 30)} AS n30, {w('net', 90)} AS n90, {w('bv', 30)} AS b30, {w('sv', 30)} AS s30, {w('b', 30)} AS bb, {w('s', 30)} AS ss, {w('n', 90)}::DOUBLE AS t90 FROM e),
j AS (SELECT p.ticker, p.date, n30, n90, b30, s30, bb / (bb + ss + 1e-6::DOUBLE) AS r, CASE WHEN bb IS NULL THEN NULL WHEN bb >= 3 AND ss = 0 THEN 1 ELSE 0 END AS cl, CASE WHEN t90 IS NULL THEN NULL WHEN t90 > 0 THEN 1 ELSE 0 END AS av FROM p LEFT JOIN f ON f.ticker = p.ticker AND f.date = p.date)
SELECT ticker, CAST(date AS VARCHAR) AS date, """ + ", ".join(f"round(lag({x}) OVER t, 5) + 0.0::DOUBLE AS {c}" for c, x in zip(INSIDER, ("n30", "n90", "b30", "s30", "n30", "r", "cl", "av"), strict=True)) + " FROM j WINDOW t AS (PARTITION BY ticker ORDER BY date)"


INTERACTIONS = """coalesce(greatest(-5.0::DOUBLE, least(5.0::DOUBLE, momentum_5d * volume_ratio)), 0) AS momentum_x_volume, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, coalesce(sent_mean_7d, 0) * momentum_5d)) AS sentiment_x_momentum, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, volatility_20d * (rsi - 50) / 50)) AS vol_x_rsi,
greatest(-5.0::DOUBLE, least(5.0::DOUBLE, vix_level * coalesce(sent_mean_7d, 0))) AS vix_x_sentiment, greatest(-5.0::DOUBLE, least(5.0::DOUBLE, coalesce(insider_net_value_30d, 0) * sign(momentum_5d))) AS insider_x_momentum"""
CROSSED = ("momentum_x_volume", "sentiment_x_momentum", "vol_x_rsi", "vix_x_sentiment", "insider_x_momentum")


def _matrix_sql() -> str:
    every = market_plans.ORACLES | blocks.ORACLES | more.ORACLES | {"_sentiment": _sentiment_sql(), "_insider": _insider_sql()}
    parts = BLOCKS | {"_sentiment": " ".join(SENT_COLUMNS), "_insider": " ".join(INSIDER)}
    ctes = ",\n".join(f"b{i} AS ({every[n]})" for i, n in enumerate(parts))
    columns = ", ".join(f"CAST(b{i}.{c} AS DOUBLE) AS {c}" for i, n in enumerate(parts) for c in parts[n].split())
    joins = " ".join(f"JOIN b{i} USING (ticker, date)" for i in range(1, len(parts)))
    core = " AND ".join(f"{c} IS NOT NULL" for c in prices.CORE)
    crossed = ", ".join(f"round({c}, 6) + 0.0::DOUBLE AS {c}" for c in CROSSED)
    return f"WITH {ctes}, m AS (SELECT ticker, date, {columns} FROM b0 {joins}), x AS (SELECT *, {INTERACTIONS} FROM m WHERE {core}) SELECT * EXCLUDE ({', '.join(CROSSED)}), {crossed} FROM x"


@query("feature_matrix", _matrix_sql())
def feature_matrix(spark, sf_dir):
    """All blocks of features in one plan; interactions are of values as shown. Orders stand in for documents, insiders' trades and reports of a brand."""
    b = bars(spark, sf_dir)
    index = b.groupBy("date").agg(F.stddev_pop("close").alias("vix"), F.count("*").alias("n")).where("n > 1").select("date", "vix")
    with_sector = b.withColumn("sector", F.substring("ticker", 7, 1))
    df = prices.price_block(with_sector, market(b))
    df = prices.own_sector(prices.volatility_index(df, index), with_sector.groupBy("sector", "date").agg(F.avg("close").alias("close")))
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("Brand#"), (F.col("o_custkey") % 25 + 1).cast("string")).alias("ticker"), F.to_date("o_orderdate").alias("date"), (F.col("o_totalprice") / 250000 - 1).alias("s"), "o_totalprice", "o_orderpriority", "o_orderstatus")
    of = lambda p: F.avg(F.when(F.col("o_orderpriority") == p, F.col("s")))
    documents = o.groupBy("ticker", "date").agg(F.avg("s").alias("sentiment"), F.count("*").alias("news_count"), F.count_distinct("o_orderpriority").alias("source_count"), of("1-URGENT").alias("urgent"), of("5-LOW").alias("low"))
    side = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", -1).otherwise(0)
    trades = o.select("ticker", "date", F.lit("X").alias("code"), (side * F.col("o_totalprice") / 1000).alias("shares"), F.lit(None).cast("double").alias("price"))
    told = reports(spark, sf_dir)
    shorts = told.select("ticker", "date", (F.col("eps") * 40).alias("short_pct"), (F.col("eps_estimated") * 10).alias("days_to_cover"))
    known = told.select("ticker", "date", (F.col("eps") * 30).alias("pe"), *[F.lit(None).cast("double").alias(c) for c in ("pb", "dividend_yield", "roe", "beta")])
    df = adapters.feature_matrix(df, documents, trades, told, shorts, known, monthly(spark, sf_dir, "1-URGENT"), monthly(spark, sf_dir, "5-LOW"), SCORES, INSIDER)
    columns = [c for names in BLOCKS.values() for c in names.split()]
    # As many digits as the SQL of each block has.
    shown = [F.round(F.col(c).cast("double"), 4 if c == "volume_vol_ratio" else 6) + 0.0 for c in (*columns, *SENT_COLUMNS)] + [F.round(F.col(c).cast("double"), 5) + 0.0 for c in INSIDER]
    df = df.select("ticker", "date", *[x.alias(c) for x, c in zip(shown, [*columns, *SENT_COLUMNS, *INSIDER], strict=True)])
    df = prices.core_rows(prices.interactions(df))
    return df.select("ticker", as_text(), *[c for c in df.columns if c not in ("ticker", "date", *CROSSED)], *r6(*CROSSED))
