"""Queries of adapters, blends, joins and aggregates on the driver's tables, and their SQL.

Events stand for transactions, trades and scored items: the user is the symbol, the type the code or the source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import adapters, blends
from barloom.operators.asof import asof_join, densify
from barloom.plans.market import BRANDS
from barloom.sources import tables
from barloom.sources.tables import bars, table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def r6(*names: str) -> list:
    """Rounded, without a negative zero."""
    return [(F.round(n, 6) + F.lit(0.0)).alias(n) for n in names]


def as_text(c: str = "date"):
    return F.date_format(c, "yyyy-MM-dd").alias(c)


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases and signups buy, errors sell."""
    e = table(spark, sf_dir, "events")
    code = F.when(F.col("event_type").isin("purchase", "signup"), "P").when(F.col("event_type") == "error", "S").otherwise("X")
    return e.select(F.col("user_id").alias("ticker"), F.to_date("ts").alias("date"), code.alias("code"), F.when(code == "S", -F.col("value")).when(code == "P", F.col("value")).otherwise(0.0).alias("shares"), F.lit(None).cast("double").alias("price"))


TX = """WITH t AS (SELECT user_id AS ticker, CAST(ts AS DATE) AS date, value AS v, event_type IN ('purchase', 'signup') AS buy, event_type = 'error' AS sell FROM events),
d AS (SELECT ticker, date, sum(CASE WHEN buy THEN v WHEN sell THEN -v ELSE 0 END) AS net_shares, sum(CASE WHEN buy THEN 1 ELSE 0 END) AS buys, sum(CASE WHEN sell THEN 1 ELSE 0 END) AS sells,
  sum(CASE WHEN buy THEN v ELSE 0 END) AS buy_value, sum(CASE WHEN sell THEN v ELSE 0 END) AS sell_value, sum(CASE WHEN buy THEN v WHEN sell THEN -v ELSE 0 END) AS net_value, count(*) AS transactions FROM t GROUP BY ticker, date)"""


@query("insider_daily", TX + " SELECT ticker, CAST(date AS VARCHAR) AS date, round(net_shares, 6) AS net_shares, CAST(buys AS BIGINT) AS buys, CAST(sells AS BIGINT) AS sells, round(buy_value, 6) AS buy_value, round(sell_value, 6) AS sell_value, round(net_value, 6) AS net_value, transactions FROM d")
def insider_daily(spark, sf_dir):
    return adapters.insider_daily(transactions(spark, sf_dir)).select("ticker", as_text(), *r6("net_shares", "buy_value", "sell_value", "net_value"), "buys", "sells", "transactions")


DENSE = TX + """, s AS (SELECT ticker, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS date FROM d GROUP BY ticker),
x AS (SELECT s.ticker, s.date, coalesce(net_shares, 0) AS net_shares, coalesce(buys, 0) AS buys, coalesce(sells, 0) AS sells, coalesce(net_value, 0) AS net_value, coalesce(transactions, 0) AS n FROM s LEFT JOIN d ON s.ticker = d.ticker AND s.date = d.date)"""


@query("calendar_densify", DENSE + " SELECT ticker, CAST(date AS VARCHAR) AS date, round(net_shares, 6) AS net_shares, n AS transactions FROM x")
def calendar_densify(spark, sf_dir):
    daily = adapters.insider_daily(transactions(spark, sf_dir))
    return densify(daily, ["ticker"], "date").na.fill(0).select("ticker", as_text(), *r6("net_shares"), "transactions")


@query("insider_rolling", DENSE + """, w AS (SELECT *, sum(net_shares) OVER a AS n30, sum(net_shares) OVER b AS n90, sum(buys) OVER a AS b, sum(sells) OVER a AS s, sum(n) OVER b AS t90 FROM x
  WINDOW a AS (PARTITION BY ticker ORDER BY date ROWS 29 PRECEDING), b AS (PARTITION BY ticker ORDER BY date ROWS 89 PRECEDING))
SELECT ticker, CAST(date AS VARCHAR) AS date, round(n30, 6) AS insider_net_shares_30d, round(n90, 6) AS insider_net_shares_90d, round(b / (b + s + 1e-6::DOUBLE), 6) AS insider_buy_ratio_30d,
  CAST(CASE WHEN b >= 3 AND s = 0 THEN 1 ELSE 0 END AS INT) AS insider_cluster, CAST(CASE WHEN t90 > 0 THEN 1 ELSE 0 END AS INT) AS insider_available FROM w""")
def insider_rolling(spark, sf_dir):
    df = adapters.insider_features(adapters.insider_daily(transactions(spark, sf_dir)))
    return df.select("ticker", as_text(), *r6("insider_net_shares_30d", "insider_net_shares_90d", "insider_buy_ratio_30d"), "insider_cluster", "insider_available")


@query("insider_rolling_z", BRANDS + """, q AS (SELECT ticker, date, sum(volume) OVER (PARTITION BY ticker ORDER BY date ROWS 89 PRECEDING) AS v90 FROM p),
w AS (SELECT *, CASE WHEN count(v90) OVER f >= 90 THEN avg(v90) OVER f END AS m, CASE WHEN count(v90) OVER f >= 90 THEN stddev_samp(v90) OVER f END AS s FROM q WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS 359 PRECEDING))
SELECT ticker, CAST(date AS VARCHAR) AS date, round(CASE WHEN (v90 - m) / nullif(s, 0) IS NOT NULL THEN greatest(-5.0::DOUBLE, least(5.0::DOUBLE, (v90 - m) / nullif(s, 0))) END, 6) AS z FROM w""")
def insider_rolling_z(spark, sf_dir):
    """A z-score of a rolling sum against its own past, over volumes."""
    from barloom.functions.columns import clip, ratio
    from barloom.functions.windows import rolling

    df = bars(spark, sf_dir).withColumn("v90", rolling(F.sum, "volume", 90, 1))
    z = clip(ratio(F.col("v90") - rolling(F.avg, "v90", 360, 90), rolling(F.stddev_samp, "v90", 360, 90)), -5, 5)
    return df.select("ticker", as_text(), F.round(z, 6).alias("z"))


def scored_days(spark, sf_dir) -> DataFrame:
    """Days of symbols with a mean score in -1 to 1 and a number of items."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("ticker"), F.to_date("ts").alias("date")).agg(F.avg(F.col("value") / 250 - 1).alias("sentiment"), F.count("*").alias("news_count"))


DAYS = "WITH e AS (SELECT user_id AS ticker, CAST(ts AS DATE) AS date, avg(value / 250 - 1) AS sentiment, count(*) AS news_count FROM events GROUP BY ALL)"


@query("sentiment_rolling", DAYS + """, w AS (SELECT *, CASE WHEN count(sentiment) OVER a >= 3 THEN avg(sentiment) OVER a END AS m7, CASE WHEN count(sentiment) OVER a >= 3 THEN stddev_samp(sentiment) OVER a END AS s7, CASE WHEN count(sentiment) OVER b >= 10 THEN avg(sentiment) OVER b END AS m30,
  sum(news_count) OVER a AS n7, CASE WHEN count(news_count) OVER b >= 10 THEN avg(news_count) OVER b END AS n30 FROM e WINDOW a AS (PARTITION BY ticker ORDER BY date ROWS 6 PRECEDING), b AS (PARTITION BY ticker ORDER BY date ROWS 29 PRECEDING))
SELECT ticker, CAST(date AS VARCHAR) AS date, round(m7 + 1e-9::DOUBLE, 6) AS sent_mean_7d, round(m30 + 1e-9::DOUBLE, 6) AS sent_mean_30d, round(s7 + 1e-9::DOUBLE, 6) AS sent_std_7d, round(m7 - m30 + 1e-9::DOUBLE, 6) AS sent_momentum, round(n7::DOUBLE, 6) AS news_count_7d, round(coalesce(news_count / (n30 + 1e-6::DOUBLE), 0), 6) AS news_spike FROM w""")
def sentiment_rolling(spark, sf_dir):
    # Means of short decimals end in halves; the shift keeps both sides from rounding them apart.
    df = adapters.sentiment_features(scored_days(spark, sf_dir))
    return df.select("ticker", as_text(), *[(F.round(F.col(c) + 1e-9, 6) + F.lit(0.0)).alias(c) for c in ("sent_mean_7d", "sent_mean_30d", "sent_std_7d", "sent_momentum")], *r6("news_count_7d", "news_spike"))


def reports(spark, sf_dir) -> DataFrame:
    """Orders of a day as the reports of a ticker, dealt to tickers by customer."""
    o = table(spark, sf_dir, "orders")
    brand = F.concat(F.lit("Brand#"), (F.col("o_custkey") % 25 + 1).cast("string"))
    return o.groupBy(brand.alias("ticker"), F.to_date("o_orderdate").alias("date")).agg((F.avg("o_totalprice") / 99991).alias("eps"), (F.max("o_totalprice") / 150001).alias("eps_estimated"))


REPORTS = ", o AS (SELECT 'Brand#' || CAST(o_custkey % 25 + 1 AS VARCHAR) AS ticker, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) / 99991 AS eps, max(o_totalprice) / 150001 AS est FROM orders GROUP BY ALL), a AS (SELECT p.ticker, p.date, o.date AS day, eps, est FROM p ASOF LEFT JOIN o ON p.ticker = o.ticker AND p.date >= o.date)"


@query("asof_earnings", BRANDS + REPORTS + " SELECT ticker, CAST(date AS VARCHAR) AS date, round(eps, 6) AS eps, round(est, 6) AS eps_estimated FROM a")
def asof_earnings(spark, sf_dir):
    return asof_join(bars(spark, sf_dir).select("ticker", "date"), reports(spark, sf_dir), "date", ["ticker"]).select("ticker", as_text(), *r6("eps", "eps_estimated"))


@query("days_since_event", BRANDS + REPORTS + " SELECT ticker, CAST(date AS VARCHAR) AS date, CAST(coalesce(least(90, date - day), 90) AS INT) AS days_since_earnings FROM a")
def days_since_event(spark, sf_dir):
    return adapters.earnings_features(bars(spark, sf_dir).select("ticker", "date"), reports(spark, sf_dir)).select("ticker", as_text(), "days_since_earnings")


@query("earnings_surprise", BRANDS + REPORTS + """, s AS (SELECT *, eps - est AS gap FROM a), b AS (SELECT *, CASE WHEN gap > 0.001 THEN 1 WHEN gap < -0.001 THEN -1 WHEN gap IS NOT NULL THEN 0 END AS beat,
 CASE WHEN abs(est) > 0.01 THEN greatest(-5.0::DOUBLE, least(5.0::DOUBLE, gap / abs(est))) WHEN gap IS NOT NULL THEN 0 END AS pct, 1 / (date - day + 1.0::DOUBLE) AS rec FROM s)
SELECT ticker, CAST(date AS VARCHAR) AS date, round(lag(gap) OVER w, 6) AS earnings_surprise, CAST(lag(beat) OVER w AS INT) AS earnings_beat, round(lag(pct) OVER w, 6) AS earnings_surprise_pct, round(lag(rec) OVER w, 6) AS earnings_recency FROM b WINDOW w AS (PARTITION BY ticker ORDER BY date)""")
def earnings_surprise(spark, sf_dir):
    df = adapters.earnings_features(bars(spark, sf_dir).select("ticker", "date"), reports(spark, sf_dir))
    return df.select("ticker", as_text(), *r6("earnings_surprise", "earnings_surprise_pct", "earnings_recency"), "earnings_beat")


@query("asof_short_interest", BRANDS + REPORTS + """, s AS (SELECT *, CASE WHEN eps IS NOT NULL THEN greatest(0.0::DOUBLE, least(100.0::DOUBLE, eps * 40)) END AS sf, CASE WHEN est IS NOT NULL THEN greatest(0.0::DOUBLE, least(60.0::DOUBLE, est * 10)) END AS dc FROM a)
SELECT ticker, CAST(date AS VARCHAR) AS date, round(lag(sf) OVER w, 6) AS si_short_float_pct, round(lag(dc) OVER w, 6) AS si_days_to_cover, CAST(coalesce(lag(CASE WHEN eps IS NOT NULL THEN 1 ELSE 0 END) OVER w, 0) AS INT) AS si_available FROM s WINDOW w AS (PARTITION BY ticker ORDER BY date)""")
def asof_short_interest(spark, sf_dir):
    shorts = reports(spark, sf_dir).select("ticker", "date", (F.col("eps") * 40).alias("short_pct"), (F.col("eps_estimated") * 10).alias("days_to_cover"))
    return adapters.short_interest_features(bars(spark, sf_dir).select("ticker", "date"), shorts).select("ticker", as_text(), *r6("si_short_float_pct", "si_days_to_cover"), "si_available")


@query("fundamentals_asof", BRANDS + REPORTS + ", s AS (SELECT *, greatest(-50.0::DOUBLE, least(200.0::DOUBLE, CASE WHEN eps IS NOT NULL THEN eps * 30 END)) AS pe, eps FROM a) SELECT ticker, CAST(date AS VARCHAR) AS date, round(lag(CASE WHEN eps IS NOT NULL THEN pe END) OVER (PARTITION BY ticker ORDER BY date), 6) AS fund_pe FROM s")
def fundamentals_asof(spark, sf_dir):
    docs = reports(spark, sf_dir).select("ticker", "date", (F.col("eps") * 30).alias("pe"), *[F.lit(None).cast("double").alias(c) for c in ("pb", "dividend_yield", "roe", "beta")])
    return adapters.fundamental_features(bars(spark, sf_dir).select("ticker", "date"), docs).select("ticker", as_text(), *r6("fund_pe"))


def monthly(spark, sf_dir, priority: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == priority)
    return o.groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("date")).agg(F.round(F.avg("o_totalprice") / 1000, 6).alias("value"))


def _monthly(name: str, priority: str) -> str:
    return f"{name} AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, round(avg(o_totalprice) / 1000, 6) AS value FROM orders WHERE o_orderpriority = '{priority}' GROUP BY 1)"


@query("macro_ffill_lag", BRANDS + f", {_monthly('a', '1-URGENT')}, {_monthly('b', '5-LOW')}," + """
j AS (SELECT p.ticker, p.date, x.value AS l, y.value AS s FROM p ASOF LEFT JOIN a x ON p.date >= x.date ASOF LEFT JOIN b y ON p.date >= y.date),
c AS (SELECT *, CASE WHEN date <= (SELECT max(date) FROM a) THEN l END AS l0, CASE WHEN date <= (SELECT max(date) FROM b) THEN s END AS s0 FROM j),
f AS (SELECT *, last_value(l0 IGNORE NULLS) OVER w AS lf, last_value(s0 IGNORE NULLS) OVER w AS sf FROM c WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)),
g AS (SELECT ticker, date, lag(lf - sf) OVER w AS sp, lag(sf) OVER w AS sh FROM f WINDOW w AS (PARTITION BY ticker ORDER BY date))
SELECT ticker, CAST(date AS VARCHAR) AS date, round(coalesce(sp, 0), 6) AS macro_spread, round(coalesce(sh, 0), 6) AS macro_short, round(coalesce(sp - lag(sp) OVER w, 0), 6) AS macro_spread_chg, round(coalesce(sh - lag(sh) OVER w, 0), 6) AS macro_short_chg FROM g WINDOW w AS (PARTITION BY ticker ORDER BY date)""")
def macro_ffill_lag(spark, sf_dir):
    df = adapters.macro_features(bars(spark, sf_dir).select("ticker", "date"), monthly(spark, sf_dir, "1-URGENT"), monthly(spark, sf_dir, "5-LOW"))
    return df.select("ticker", as_text(), *r6("macro_spread", "macro_short", "macro_spread_chg", "macro_short_chg"))


def long_scores(spark, sf_dir) -> DataFrame:
    """Sources of a symbol: the types of its events, with score, volume and confidence."""
    e = table(spark, sf_dir, "events")
    source = F.element_at(F.create_map(*[F.lit(x) for x in ("view", "rss_news", "click", "marketaux", "purchase", "finnhub", "signup", "reddit", "error", "economic_event")]), F.col("event_type"))
    return e.groupBy(F.col("user_id").alias("ticker"), source.alias("source")).agg(F.avg(F.col("value") / 50 - 1).alias("score"), F.count("*").cast("double").alias("volume"), F.least(F.count("*") / 20, F.lit(1.0)).alias("confidence"))


LONG = """WITH l AS (SELECT user_id AS ticker, CASE event_type WHEN 'view' THEN 0.22 WHEN 'click' THEN 0.18 WHEN 'purchase' THEN 0.10 WHEN 'signup' THEN 0.12 ELSE 0 END::DOUBLE AS w, event_type, avg(value / 50 - 1) AS score, count(*)::DOUBLE AS volume, least(count(*) / 20, 1.0)::DOUBLE AS confidence FROM events GROUP BY ALL)"""


@query("sentiment_blend", LONG + ", m AS (SELECT *, w * greatest(confidence, 0.01) * ln(1 + volume) AS we, greatest(-1, least(1, score)) AS x FROM l WHERE score <> 0 OR confidence <> 0) SELECT ticker, round(coalesce(sum(x * we) / nullif(sum(we), 0), 0), 6) AS blended FROM m GROUP BY ticker")
def sentiment_blend(spark, sf_dir):
    return blends.blended_score(long_scores(spark, sf_dir), ["ticker"]).select("ticker", *r6("blended"))


@query("confidence_blend", LONG + ", m AS (SELECT *, CASE event_type WHEN 'view' THEN 0.22 WHEN 'click' THEN 0.15 WHEN 'purchase' THEN 0.10 WHEN 'signup' THEN 0.10 ELSE 0.03 END::DOUBLE AS u FROM l) SELECT ticker, round(sum(confidence * u) / sum(u), 6) AS confidence, count(*) FILTER (confidence > 0 AND event_type <> 'error') AS sources, sum(volume) AS volume, coalesce(sum(volume) FILTER (event_type IN ('view', 'click')), 0) AS articles FROM m GROUP BY ticker")
def confidence_blend(spark, sf_dir):
    return blends.blended_confidence(long_scores(spark, sf_dir), ["ticker"]).select("ticker", *r6("confidence"), "sources", "volume", "articles")


@query("engagement_mean", "SELECT user_id AS ticker, round(avg((value / 50 - 1) * least(CAST(json_extract_string(props, '$.k') AS INT) / 100.0::DOUBLE, 1.0)), 6) AS score, count(*) AS volume FROM events GROUP BY 1")
def engagement_mean(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("ticker"), (F.col("value") / 50 - 1).alias("score"), F.get_json_object("props", "$.k").cast("int").alias("votes"))
    return blends.engagement_mean(e, ["ticker"]).select("ticker", *r6("score"), "volume")


@query("insider_ratio", TX + ", s AS (SELECT ticker, sum(CASE WHEN buy THEN v ELSE -v END) / nullif(sum(v), 0) AS x, count(*) AS n FROM t WHERE buy OR sell GROUP BY ticker) SELECT ticker, round(coalesce(greatest(-1, least(1, x)), 0), 6) AS score, least(n / 5, 1.0)::DOUBLE AS confidence FROM s")
def insider_ratio(spark, sf_dir):
    return blends.insider_sentiment(transactions(spark, sf_dir), ["ticker"], ("P",), ("S",)).select("ticker", *r6("score"), "confidence")


@query("recommendation_score", """WITH v AS (SELECT user_id AS ticker, CAST(date_trunc('week', ts) AS DATE) AS date, count(*) FILTER (event_type = 'signup') AS sb, count(*) FILTER (event_type = 'purchase') AS b, count(*) FILTER (event_type = 'view') AS h, count(*) FILTER (event_type = 'click') AS s, count(*) FILTER (event_type = 'error') AS ss FROM events GROUP BY ALL),
r AS (SELECT *, sb + b + h + s + ss AS n, (2 * sb + b - s - 2 * ss) / (sb + b + h + s + ss)::DOUBLE / 2 AS raw FROM v), t AS (SELECT *, CASE WHEN lag(raw) OVER w IS NULL THEN 0 ELSE greatest(-0.2, least(0.2, 0.5 * (raw - lag(raw) OVER w))) END AS tr FROM r WINDOW w AS (PARTITION BY ticker ORDER BY date))
SELECT ticker, CAST(date AS VARCHAR) AS date, round(greatest(-1, least(1, raw + tr)), 6) AS score, round((least(n / 20.0::DOUBLE, 1.0) + greatest(sb + b, s + ss) / n::DOUBLE) / 2, 6) AS confidence FROM t""")
def recommendation_score(spark, sf_dir):
    from barloom.functions.windows import lag

    e = table(spark, sf_dir, "events")
    n = lambda kind, name: F.count_if(F.col("event_type") == kind).cast("double").alias(name)
    v = e.groupBy(F.col("user_id").alias("ticker"), F.to_date(F.date_trunc("week", "ts")).alias("date")).agg(n("signup", "sb"), n("purchase", "b"), n("view", "h"), n("click", "s"), n("error", "ss"))
    votes = [F.col(c) for c in ("sb", "b", "h", "s", "ss")]
    v = v.withColumn("raw", blends.recommendation_score(*votes)[0]).withColumn("before", lag("raw"))
    score, confidence = blends.recommendation_score(*votes, F.col("before"))
    return v.select("ticker", as_text(), F.round(score, 6).alias("score"), F.round(confidence, 6).alias("confidence"))


@query("filing_confidence", """WITH f AS (SELECT source, CASE WHEN doc_id % 6 > 0 THEN ((doc_id * 37) % 201 - 100) / 100.0::DOUBLE END AS score, n_chars, CASE doc_id % 8 WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 WHEN 2 THEN 0.7 WHEN 3 THEN 0.6 WHEN 4 THEN 0.4 WHEN 5 THEN 0.3 WHEN 6 THEN 0.2 ELSE 0.5 END::DOUBLE AS q FROM documents)
SELECT source, round(least(1, greatest(0, 0.25 * least(count(score) / 8.0::DOUBLE, 1.0) + 0.2 * count(score) / count(*)::DOUBLE + 0.25 * greatest(0.0, 1 - coalesce(stddev_samp(score), 0) / 0.5) + 0.2 * coalesce(avg((q + least(n_chars / 1000.0::DOUBLE, 1.0)) / 2) FILTER (score IS NOT NULL), 0.5) + 0.1 * least(abs(coalesce(avg(score), 0)) / 0.3, 1.0))), 6) AS confidence, round(coalesce(avg(score), 0), 6) + 0.0::DOUBLE AS score FROM f GROUP BY source""")
def filing_confidence(spark, sf_dir):
    """Documents as filings of their source, each sixth without a score, of seven forms and an unknown one."""
    i, forms = F.col("doc_id"), F.array(*[F.lit(x) for x in (*blends.FORM_QUALITY, "S-8")])
    f = table(spark, sf_dir, "documents").select("source", F.element_at(forms, (i % 8 + 1).cast("int")).alias("form"), F.col("n_chars").alias("length"), F.when(i % 6 > 0, ((i * 37) % 201 - 100) / 100).alias("score"))
    return blends.filing_confidence(f, ["source"]).select("source", *r6("confidence", "score"))


@query("time_decay_mean", """WITH c AS (SELECT user_id AS ticker, value / 250 - 1 AS score, greatest(0.1, 1 - (DATE '2024-01-31' - CAST(ts AS DATE)) / 7.0::DOUBLE) AS w FROM events)
SELECT ticker, round(sum(score * w) / sum(w), 6) AS score, round(stddev_pop(score), 6) AS deviation, round(least(1.0, count(*) / 10.0::DOUBLE * (1 - least(1.0, stddev_pop(score)))), 6) AS confidence, count(*) AS n FROM c GROUP BY ticker""")
def time_decay_mean(spark, sf_dir):
    c = table(spark, sf_dir, "events").select(F.col("user_id").alias("ticker"), (F.col("value") / 250 - 1).alias("score"), F.datediff(F.lit("2024-01-31").cast("date"), F.to_date("ts")).alias("age"))
    return blends.decayed_mean(c, ["ticker"], F.col("age")).select("ticker", *r6("score", "deviation", "confidence"), "n")


@query("source_health", """SELECT event_type AS source, count(*) FILTER (value IS NULL) AS missing, count(*) FILTER (value = 0) AS zero, count(*) FILTER (value <> 0) AS nonzero, round(median(value), 6) AS median, list_sort(list(value))[CAST(floor(count(value) * 0.9) AS INT) + 1] AS p90, count(DISTINCT user_id) AS symbols FROM events GROUP BY 1""")
def source_health(spark, sf_dir):
    return blends.health(table(spark, sf_dir, "events"), "value", "event_type", "user_id").withColumnRenamed("event_type", "source").withColumn("median", F.round("median", 6))


@query("event_distances", """WITH c AS (SELECT DISTINCT CAST(ts AS DATE) AS date, CASE WHEN event_type = 'purchase' THEN 'high' WHEN event_type = 'signup' THEN 'medium' ELSE 'low' END AS importance FROM events),
d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), j AS (SELECT day, date - day AS d, importance FROM d LEFT JOIN c ON date BETWEEN day - 90 AND day + 90)
SELECT CAST(day AS VARCHAR) AS day, CAST(max(CASE WHEN d = 0 THEN 1 ELSE 0 END) AS INT) AS has_today, CAST(coalesce(min(CASE WHEN d >= 0 THEN d END), 30) AS INT) AS days_to_next, CAST(coalesce(min(CASE WHEN d <= 0 THEN -d END), 30) AS INT) AS days_since_last,
 CAST(sum(CASE WHEN d BETWEEN 0 AND 6 THEN 1 ELSE 0 END) AS BIGINT) AS week_density, CAST(sum(CASE WHEN d BETWEEN 0 AND 6 THEN CASE importance WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END ELSE 0 END) AS BIGINT) AS week_importance FROM j GROUP BY day""")
def event_distances(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    importance = F.when(F.col("event_type") == "purchase", "high").when(F.col("event_type") == "signup", "medium").otherwise("low")
    events = e.select(F.to_date("ts").alias("date"), importance.alias("importance")).distinct()
    return adapters.event_distances(events, e.select(F.to_date("ts").alias("day")).distinct()).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("latest_per_key", "SELECT user_id, arg_max(event_id, ts) AS event_id, arg_max(event_type, ts) AS event_type FROM events GROUP BY user_id")
def latest_per_key(spark, sf_dir):
    return tables.latest(table(spark, sf_dir, "events"), "user_id", F.col("ts").desc()).select("user_id", "event_id", "event_type")


@query("asof_document", "SELECT user_id, arg_max(event_id, ts) AS event_id, arg_max(event_type, ts) AS event_type FROM events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00' GROUP BY user_id")
def asof_document(spark, sf_dir):
    return tables.as_of(table(spark, sf_dir, "events"), "user_id", "ts", F.lit("2024-01-15 00:00:00").cast("timestamp")).select("user_id", "event_id", "event_type")


@query("upsert_merge", "WITH b AS (SELECT c_custkey, c_acctbal, 0 AS v FROM customer), d AS (SELECT c_custkey + 100 AS c_custkey, c_acctbal * 2 AS c_acctbal, 1 AS v FROM customer WHERE c_custkey % 2 = 0) SELECT c_custkey, arg_max(c_acctbal, v) AS c_acctbal FROM (SELECT * FROM b UNION ALL SELECT * FROM d) GROUP BY 1")
def upsert_merge(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.lit(0).alias("v"))
    d = c.where("c_custkey % 2 = 0").select((F.col("c_custkey") + 100).alias("c_custkey"), (F.col("c_acctbal") * 2).alias("c_acctbal"), F.lit(1).alias("v"))
    return tables.upsert(c, d, ["c_custkey"], "v").select("c_custkey", "c_acctbal")


@query("incremental_load", "WITH m AS (SELECT user_id, max(ts) AS mark FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1) SELECT e.user_id, e.event_id FROM events e LEFT JOIN m USING (user_id) WHERE mark IS NULL OR e.ts > mark")
def incremental_load(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return tables.increments(e, e.where("ts < timestamp '2024-01-20'"), "user_id", "ts").select("user_id", "event_id")


@query("retention_counts", "SELECT event_type, count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS kept, count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS gone FROM events GROUP BY 1")
def retention_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("string"))
    kept = tables.retained(e, "ts", F.lit("2024-01-16").cast("timestamp")).groupBy("event_type").agg(F.count("*").alias("kept"))
    return e.groupBy("event_type").agg(F.count("*").alias("n")).join(kept, "event_type", "left").select("event_type", F.coalesce("kept", F.lit(0)).alias("kept"), (F.col("n") - F.coalesce("kept", F.lit(0))).alias("gone"))


@query("trading_day_gate", BRANDS + " SELECT CAST(date AS VARCHAR) AS date FROM (SELECT DISTINCT date FROM p) WHERE date NOT IN (SELECT date FROM p WHERE ticker IN ('Brand#1', 'Brand#2'))")
def trading_day_gate(spark, sf_dir):
    b = bars(spark, sf_dir)
    return tables.missing_days(b.select("date").distinct(), b, ["Brand#1", "Brand#2"]).select(as_text())


@query("price_range_scan", BRANDS + " SELECT ticker, CAST(date AS VARCHAR) AS date, close FROM p WHERE ticker = 'Brand#3' AND date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")
def price_range_scan(spark, sf_dir):
    return tables.price_range(bars(spark, sf_dir), "Brand#3", "1996-01-01", "1996-12-31").select("ticker", as_text(), "close")


@query("preferred_source", "SELECT date, value FROM (SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, o_orderkey AS value, row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderpriority = '3-MEDIUM' DESC, o_orderpriority, o_orderkey) AS n FROM orders) WHERE n = 1")
def preferred_source(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("source")).agg(F.min("o_orderkey").alias("value"))
    return tables.preferred(o, ["date"], "source", "3-MEDIUM").select(as_text(), "value")


@query("nearest_lookup", BRANDS + " SELECT ticker, CAST(arg_min(date, struct_pack(a := abs(date - DATE '1998-06-01'), b := date)) AS VARCHAR) AS date, arg_min(close, struct_pack(a := abs(date - DATE '1998-06-01'), b := date)) AS close FROM p GROUP BY ticker")
def nearest_lookup(spark, sf_dir):
    from barloom.operators.asof import nearest_row

    return nearest_row(bars(spark, sf_dir).select("ticker", "date", "close"), ["ticker"], "date", F.lit("1998-06-01").cast("date")).select("ticker", as_text(), "close")
