"""Queries of further columns, feeds, gates and market features on the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions import text
from barloom.functions.windows import next_known
from barloom.operators import adapters, blends, evaluation, fundamentals, modelling, news, prices, reports
from barloom.plans import market
from barloom.plans.adapters import as_text, r6
from barloom.plans.market import BRANDS, OVER, RETURNS, dev, mean, over
from barloom.plans.reports import articles, event_trades
from barloom.sources import tables
from barloom.sources.tables import bars, table
from barloom.streaming import trades as live

QUERIES, ORACLES = {}, {}
ORACLES_OF_MARKET = market.ORACLES


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


@query("features_one_row_later", BRANDS + f" SELECT ticker, CAST(date AS VARCHAR) AS date, round(lag(high - low) {OVER}, 6) AS span FROM p")
def features_one_row_later(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    return adapters.one_row_later(b.select("ticker", "date"), b.withColumn("span", F.col("high") - F.col("low")), ["span"]).select("ticker", as_text(), *r6("span"))


@query("volume_divergence", RETURNS + f""", d AS (SELECT *, {over("volume", mean("volume", 20, 5))} AS vr, sign(r1) * sign(volume - lag(volume) {OVER}) AS sg FROM v)
SELECT ticker, CAST(date AS VARCHAR) AS date, round(coalesce(vr / (vol20 + 1e-6::DOUBLE), 0), 4) + 0.0::DOUBLE AS volume_vol_ratio, coalesce(-sg, 0)::DOUBLE + 0.0::DOUBLE AS price_vol_divergence FROM d""")
def volume_divergence(spark, sf_dir):
    df = prices.volume_volatility(prices.volume(prices.returns(bars(spark, sf_dir))))
    return df.select("ticker", as_text(), (F.round("volume_vol_ratio", 4) + F.lit(0.0)).alias("volume_vol_ratio"), "price_vol_divergence")


@query("vix_features", BRANDS + """, i AS (SELECT date, stddev_pop(close) AS vix FROM p GROUP BY date HAVING count(*) > 1), r AS (SELECT *, ln(vix / nullif(lag(vix) OVER (ORDER BY date), 0)) AS r FROM i),
s AS (SELECT *, CASE WHEN count(r) OVER w >= 5 THEN stddev_samp(r) OVER w END AS s FROM r WINDOW w AS (ORDER BY date ROWS 19 PRECEDING)),
j AS (SELECT ticker, p.date, lag(r) OVER k AS r, lag(s) OVER k AS s, lag(vix) OVER k AS l FROM p LEFT JOIN s ON p.date = s.date WINDOW k AS (PARTITION BY ticker ORDER BY p.date))
SELECT ticker, CAST(date AS VARCHAR) AS date, round(coalesce(r, 0), 6) + 0.0::DOUBLE AS vix_return_1d, round(coalesce(last_value(s IGNORE NULLS) OVER u, 0), 6) AS vix_vol_20d, round(coalesce(last_value(l IGNORE NULLS) OVER u, 20), 6) AS vix_level FROM j
WINDOW u AS (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)""")
def vix_features(spark, sf_dir):
    b = bars(spark, sf_dir)
    index = b.groupBy("date").agg(F.stddev_pop("close").alias("vix"), F.count("*").alias("n")).where("n > 1").select("date", "vix")
    return prices.volatility_index(b, index).select("ticker", as_text(), *r6("vix_return_1d", "vix_vol_20d", "vix_level"))


@query("own_sector", RETURNS + f""", g AS (SELECT *, substr(ticker, 7, 1) AS sector FROM v), f AS (SELECT sector, date, avg(close) AS c FROM g GROUP BY 1, 2),
h AS (SELECT *, ln(c / lag(c) OVER w) AS a1, ln(c / lag(c, 5) OVER w) AS a5, ln(c / lag(c, 20) OVER w) AS a20, ln(c / lag(c, 60) OVER w) AS a60 FROM f WINDOW w AS (PARTITION BY sector ORDER BY date)),
s AS (SELECT *, CASE WHEN count(a1) OVER w >= 5 THEN stddev_samp(a1) OVER w END AS sd FROM h WINDOW w AS (PARTITION BY sector ORDER BY date ROWS 19 PRECEDING)),
j AS (SELECT ticker, g.date, coalesce(lag(a1) OVER k, 0) AS b1, coalesce(lag(a5) OVER k, 0) AS b5, coalesce(lag(a20) OVER k, 0) AS b20, coalesce(lag(a60) OVER k, 0) AS b60, lag(sd) OVER k AS sd, coalesce(lag(r5) OVER k, 0) AS q5, coalesce(lag(r21) OVER k, 0) AS q21
      FROM g LEFT JOIN s ON g.sector = s.sector AND g.date = s.date WINDOW k AS (PARTITION BY ticker ORDER BY g.date))
SELECT ticker, CAST(date AS VARCHAR) AS date, round(b1, 6) + 0.0::DOUBLE AS sector_etf_return_1d, round(b5, 6) + 0.0::DOUBLE AS sector_etf_return_5d, round(b20, 6) + 0.0::DOUBLE AS sector_etf_return_20d, round(b60, 6) + 0.0::DOUBLE AS sector_etf_return_60d,
 round(coalesce(last_value(sd IGNORE NULLS) OVER u, 0), 6) AS sector_etf_vol_20d, round(q5 - b5, 6) + 0.0::DOUBLE AS excess_vs_sector_5d, round(q21 - b20, 6) + 0.0::DOUBLE AS excess_vs_sector_20d FROM j WINDOW u AS (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)""")
def own_sector(spark, sf_dir):
    """The first digit of a brand is its sector, whose fund is the mean of its names."""
    b = prices.returns(bars(spark, sf_dir)).withColumn("sector", F.substring("ticker", 7, 1))
    df = prices.own_sector(b, b.groupBy("sector", "date").agg(F.avg("close").alias("close")))
    return df.select("ticker", as_text(), *r6("sector_etf_return_1d", "sector_etf_return_5d", "sector_etf_return_20d", "sector_etf_return_60d", "sector_etf_vol_20d", "excess_vs_sector_5d", "excess_vs_sector_20d"))


def scored(spark, sf_dir) -> DataFrame:
    """Events as scored items: score from the value, confidence and votes from props."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select("event_id", "user_id", F.col("event_type").alias("source"), (F.col("value") / 50 - 1).alias("score"), (k / 100).alias("confidence"), k.alias("k"))


SCORED = "WITH s AS (SELECT event_id, user_id, event_type AS source, value / 50 - 1 AS score, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS confidence, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)"


@query("impact_top3", SCORED + " SELECT event_id, round(abs(score) * confidence, 6) AS impact FROM s WHERE abs(score) * confidence > 0.3 ORDER BY abs(score) * confidence DESC, event_id LIMIT 3")
def impact_top3(spark, sf_dir):
    return reports.impact(scored(spark, sf_dir), "event_id").select("event_id", *r6("impact"))


@query("source_means", SCORED + " SELECT user_id, round(avg(score), 6) + 0.0::DOUBLE AS score, count(*) AS volume, round(least(count(*) / 20.0::DOUBLE, 1), 6) AS confidence FROM s GROUP BY 1")
def source_means(spark, sf_dir):
    return blends.source_means(scored(spark, sf_dir), ["user_id"]).select("user_id", *r6("score"), "volume", *r6("confidence"))


@query("composite_score", SCORED + " SELECT event_id, round(coalesce(CASE WHEN source = 'purchase' THEN score END, CASE WHEN source = 'click' THEN confidence END, CASE WHEN source = 'view' THEN (score + confidence) / 2 WHEN source = 'signup' THEN score END, 0), 6) + 0.0::DOUBLE AS composite FROM s")
def composite_score(spark, sf_dir):
    only = lambda kinds, x: F.when(F.col("source").isin(*kinds), F.col(x))
    df = scored(spark, sf_dir).withColumns({"composite": only(["purchase"], "score"), "blended": only(["click"], "confidence"), "a": only(["view", "signup"], "score"), "b": only(["view"], "confidence")})
    return df.withColumn("composite", blends.composite(["a", "b"])).select("event_id", *r6("composite"))


@query("present_mean", SCORED + " SELECT event_id, round((CASE WHEN source <> 'view' THEN score * 0.5 ELSE 0 END + confidence * 0.3 + CASE WHEN source = 'click' THEN 0.2 ELSE 0 END) / (CASE WHEN source <> 'view' THEN 0.5 ELSE 0 END + 0.3 + CASE WHEN source = 'click' THEN 0.2 ELSE 0 END), 6) + 0.0::DOUBLE AS score, round(CASE WHEN source <> 'view' THEN 0.5 ELSE 0 END + 0.3 + CASE WHEN source = 'click' THEN 0.2 ELSE 0 END, 6) AS coverage FROM s")
def present_mean(spark, sf_dir):
    s = scored(spark, sf_dir)
    score, coverage = blends.present_mean([(F.when(F.col("source") != "view", F.col("score")), 0.5), (F.col("confidence"), 0.3), (F.when(F.col("source") == "click", F.lit(1.0)), 0.2)])
    return s.select("event_id", (F.round(score, 6) + F.lit(0.0)).alias("score"), F.round(coverage, 6).alias("coverage"))


@query("short_interest_tier", SCORED + " SELECT event_id, CASE WHEN k / 4 >= 20 THEN -0.8 WHEN k / 4 >= 10 THEN -0.5 WHEN k / 4 >= 5 THEN -0.2 WHEN k / 4 >= 2 THEN 0.2 WHEN k IS NOT NULL THEN 0.5 END::DOUBLE AS score FROM s")
def short_interest_tier(spark, sf_dir):
    return scored(spark, sf_dir).select("event_id", blends.short_interest_tier(F.col("k") / 4).cast("double").alias("score"))


@query("outlook", BRANDS + f""", c AS (SELECT *, close - lag(close) {OVER} AS a, close - lag(close, 7) {OVER} AS b, close - lag(close, 21) {OVER} AS c FROM p), d AS (SELECT *, CASE WHEN coalesce(c, b, a, 0) <> 0 AND close <> 0 THEN 100 * coalesce(c, b, a) / close ELSE 0 END AS x, CASE WHEN a IS NOT NULL THEN least(1, volume / 50) END AS ca, CASE WHEN b IS NOT NULL THEN 0.4::DOUBLE END AS cb, CASE WHEN c IS NOT NULL THEN least(1, volume / 200) END AS cc FROM c)
SELECT ticker, CAST(date AS VARCHAR) AS date, CASE WHEN x > 2 THEN 'Bullish' WHEN x > 0.5 THEN 'Slightly Bullish' WHEN x < -2 THEN 'Bearish' WHEN x < -0.5 THEN 'Slightly Bearish' ELSE 'Neutral' END AS outlook, CAST(coalesce(trunc(100 * list_avg([v FOR v IN [ca, cb, cc] IF v <> 0])), 50) AS INT) AS confidence FROM d""")
def outlook(spark, sf_dir):
    """Moves over 21, 7 and one rows stand in for predicted changes."""
    before = lambda n: F.lag("close", n).over(W.partitionBy("ticker").orderBy("date"))
    a, b, c = (F.col("close") - before(n) for n in (1, 7, 21))
    df = bars(spark, sf_dir).withColumns({"a": a, "b": b, "c": c})
    sure = [F.when(F.col("a").isNotNull(), F.least(F.lit(1.0), F.col("volume") / 50)), F.when(F.col("b").isNotNull(), 0.4), F.when(F.col("c").isNotNull(), F.least(F.lit(1.0), F.col("volume") / 200))]
    return df.select("ticker", as_text(), reports.outlook(F.col("close"), [F.col("c"), F.col("b"), F.col("a")]).alias("outlook"), reports.mean_confidence(sure).alias("confidence"))


@query("risk_labels", """WITH r AS (SELECT p_partkey, CAST(p_size > 10 AS INT) + CAST(p_size > 25 AS INT) + CAST(p_size > 40 AS INT) - CAST(p_retailprice > 950 AS INT) - CAST(p_retailprice > 1000 AS INT) - CAST(p_retailprice > 1050 AS INT) AS s FROM part)
SELECT p_partkey, CASE WHEN s > 2 THEN 'high' WHEN s > 0 THEN 'moderate' WHEN s < -2 THEN 'low' ELSE 'balanced' END AS risk FROM r""")
def risk_labels(spark, sf_dir):
    over_ = lambda c, xs: [F.col(c) > x for x in xs]
    return table(spark, sf_dir, "part").select("p_partkey", reports.risk_label(over_("p_size", (10, 25, 40)), over_("p_retailprice", (950, 1000, 1050))).alias("risk"))


@query("moods", "SELECT DISTINCT p_size * 2 AS score, CASE WHEN p_size * 2 <= 20 THEN 'Extreme Fear' WHEN p_size * 2 <= 40 THEN 'Fear' WHEN p_size * 2 <= 60 THEN 'Neutral' WHEN p_size * 2 <= 80 THEN 'Greed' ELSE 'Extreme Greed' END AS mood, round((p_size * 2 - 50) / 100.0::DOUBLE, 6) AS sentiment FROM part")
def moods(spark, sf_dir):
    s = table(spark, sf_dir, "part").select((F.col("p_size") * 2).alias("score")).distinct()
    return s.select("score", reports.mood(F.col("score")).alias("mood"), (F.round(reports.mood_sentiment(F.col("score")), 6) + F.lit(0.0)).alias("sentiment"))


@query("feed_newest6", "WITH r AS (SELECT doc_id, row_number() OVER (PARTITION BY lower(concat_ws('|', string_split(text, chr(10))[1], sha256(text))) ORDER BY doc_id DESC) AS n FROM documents) SELECT doc_id FROM r WHERE n = 1 ORDER BY doc_id DESC LIMIT 6")
def feed_newest6(spark, sf_dir):
    return news.newest_distinct(articles(spark, sf_dir)).select("doc_id")


@query("feed_first_filled", """WITH a AS (SELECT doc_id, lang, source, string_split(text, chr(10))[1] AS title, dense_rank() OVER (ORDER BY source) AS r FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL), b AS (SELECT *, min(r) OVER (PARTITION BY lang) AS best FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY lang, title ORDER BY doc_id DESC) AS n FROM b WHERE r = best) SELECT doc_id, lang, source FROM c WHERE n = 1""")
def feed_first_filled(spark, sf_dir):
    a = articles(spark, sf_dir).withColumnRenamed("provider", "lang").where("lang IS NOT NULL AND source IS NOT NULL")
    ranks = a.select("source").distinct().withColumn("rank", F.row_number().over(W.orderBy("source")))  # one row a source
    return news.first_filled(a.join(ranks, "source"), ["lang"], "rank").select("doc_id", "lang", "source")


@query("news_filter", "SELECT doc_id FROM documents WHERE lang = 'en' AND to_timestamp(1700000000 + doc_id * 60) >= TIMESTAMPTZ '2023-11-15 00:00:00+00' AND contains(lower(string_split(text, chr(10))[1]), 'the')")
def news_filter(spark, sf_dir):
    a = articles(spark, sf_dir).withColumns({"sentiment": F.upper("provider"), "snippet": F.lit(None).cast("string")})
    return news.filtered(a, sentiment="en", start="2023-11-15", search="THE").select("doc_id")


@query("post_labels", """WITH d AS (SELECT source, lower(text) AS t FROM documents), h AS (SELECT source, len(list_filter(['buy', 'moon', 'rocket', 'bull', 'calls', 'up', 'green', 'gains', 'hodl'], lambda x: contains(t, x))) AS u, len(list_filter(['sell', 'crash', 'bear', 'puts', 'down', 'red', 'loss', 'dump', 'short'], lambda x: contains(t, x))) AS d FROM d),
l AS (SELECT source, CASE WHEN u > d THEN 'bullish' WHEN d > u THEN 'bearish' ELSE 'neutral' END AS label FROM h) SELECT source, label, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY source), 6) AS percent FROM l GROUP BY 1, 2""")
def post_labels(spark, sf_dir):
    g = table(spark, sf_dir, "documents").groupBy("source", text.post_label(F.coalesce("text", F.lit(""))).alias("label")).agg(F.count("*").alias("n"))
    return g.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy("source")), 6))


@query("long_paragraphs", "SELECT doc_id, sha256(CASE WHEN length(text) > 10000 THEN array_to_string(list_filter(regexp_split_to_array(text, '\\n\\s*\\n'), lambda p: contains(lower(p), 'risk') OR contains(lower(p), 'the')), chr(10) || chr(10)) ELSE text END) AS digest FROM documents")
def long_paragraphs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.paragraphs_with(F.col("text"), ("risk", "the")), 256).alias("digest"))


@query("flow_node_kinds", """WITH l AS (SELECT DISTINCT p_brand AS symbol, p_type AS source, 'Revenue' AS target FROM part UNION SELECT DISTINCT p_brand, 'Revenue', CAST(p_size AS VARCHAR) FROM part), n AS (SELECT symbol, source AS node FROM l UNION SELECT symbol, target FROM l)
SELECT n.symbol, node, CASE WHEN EXISTS (SELECT 1 FROM l WHERE l.symbol = n.symbol AND l.source = node AND target = 'Revenue') THEN 'segment' WHEN node = 'Revenue' THEN 'total' ELSE 'item' END AS kind FROM n""")
def flow_node_kinds(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    links = p.select(F.col("p_brand").alias("symbol"), F.col("p_type").alias("source"), F.lit("Revenue").alias("target")).union(p.select("p_brand", F.lit("Revenue"), F.col("p_size").cast("string"))).distinct()
    return fundamentals.node_kinds(links)


FORM_OF = {"view": "10-K", "click": "8-K", "purchase": "10-Q", "signup": "S-1", "error": "4"}


@query("recent_filings", """WITH f AS (SELECT user_id AS symbol, CAST(ts AS DATE) AS d, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS i, CASE event_type WHEN 'view' THEN '10-K' WHEN 'click' THEN '8-K' WHEN 'purchase' THEN '10-Q' WHEN 'signup' THEN 'S-1' ELSE '4' END AS form FROM events),
g AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY i) AS n FROM f WHERE form IN ('10-K', '10-Q')) SELECT symbol, form, CAST(d AS VARCHAR) AS date FROM g WHERE n <= 10""")
def recent_filings(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("form", F.element_at(F.create_map(*[F.lit(x) for kv in FORM_OF.items() for x in kv]), F.col("event_type")))
    row = F.struct((-F.unix_micros(F.col("ts").cast("timestamp"))).alias("t"), "event_id", "form", F.date_format("ts", "yyyy-MM-dd").alias("d"))
    f = e.groupBy(F.col("user_id").alias("symbol")).agg(F.array_sort(F.collect_list(row)).alias("r"))
    return fundamentals.recent_filings(f.select("symbol", F.col("r.form").alias("forms"), F.col("r.d").alias("dates")), ("10-K", "10-Q")).select("symbol", "form", "date")


@query("trade_gate", BRANDS + f""", r AS (SELECT ticker, date, ln(close / lag(close) {OVER}) AS r FROM p), m AS (SELECT ticker, date, r, {mean("r", 20, 5)} AS m, {dev("r", 20, 5)} AS s FROM r)
SELECT ticker, CAST(date AS VARCHAR) AS date, coalesce(r >= greatest(m, 1e-4::DOUBLE) AND r > -9 AND abs(r) >= 0.001 AND s >= 0.3, false) AS trade FROM m""")
def trade_gate(spark, sf_dir):
    df = prices.returns(bars(spark, sf_dir))
    m = F.when(F.count("log_return_1d").over(_last20()) >= 5, F.avg("log_return_1d").over(_last20()))
    ok = modelling.trade_filter(F.col("log_return_1d"), F.col("_m"), F.lit(0.6), F.col("volatility_20d"), 0.3)
    return df.withColumn("_m", m).select("ticker", as_text(), F.coalesce(ok, F.lit(False)).alias("trade"))


def _last20():
    return W.partitionBy("ticker").orderBy("date").rowsBetween(-19, 0)


@query("price_bands", RETURNS + " SELECT ticker, CAST(date AS VARCHAR) AS date, round(close * exp(r1 - CASE WHEN r5 > 0 THEN r5 ELSE 2 * vol20 END), 4) AS low, round(close * exp(r1 + CASE WHEN r5 > 0 THEN r5 ELSE 2 * vol20 END), 4) AS high FROM v")
def price_bands(spark, sf_dir):
    """The five-row return stands in for the quantile, so that it is missing, negative and positive."""
    low, high = modelling.price_band(F.col("close"), F.col("log_return_1d"), F.col("log_return_5d"), F.col("volatility_20d"))
    return prices.returns(bars(spark, sf_dir)).select("ticker", as_text(), F.round(low, 4).alias("low"), F.round(high, 4).alias("high"))


def hit_counts(spark, sf_dir) -> DataFrame:
    """How often a name's rise follows a rise, of how many days."""
    df = prices.returns(bars(spark, sf_dir)).withColumn("_next", F.lead("log_return_1d").over(W.partitionBy("ticker").orderBy("date")))
    df = df.where("log_return_1d <> 0 AND _next <> 0")
    return df.groupBy("ticker").agg(F.count("*").alias("n"), F.count_if(F.signum("log_return_1d") == F.signum("_next")).alias("hits"))


HITS = RETURNS + f", x AS (SELECT *, lead(r1) {OVER} AS nx FROM v), h AS (SELECT ticker, count(*) AS n, count(*) FILTER (sign(r1) = sign(nx)) AS hits FROM x WHERE r1 <> 0 AND nx <> 0 GROUP BY 1)"
TAIL = "list_sum(list_transform(range(hits, n + 1), lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2))))"


@query("hit_significance", HITS + f" SELECT ticker, n, hits, round(CASE WHEN n >= 10 THEN {TAIL} END, 6) AS p, n >= 10 AND {TAIL} < 0.05 AS significant FROM h")
def hit_significance(spark, sf_dir):
    p = evaluation.accuracy_test(F.col("hits"), F.col("n"))
    return hit_counts(spark, sf_dir).withColumn("p", p).select("ticker", "n", "hits", F.round("p", 6).alias("p"), F.coalesce(F.col("p") < 0.05, F.lit(False)).alias("significant"))


@query("accuracy_interval")
def accuracy_interval(spark, sf_dir):
    """Exact bounds of the chance behind a name's hits, one-sided and two-sided; tests hold them to sums of binomial terms."""
    low, _ = evaluation.exact_interval(F.col("hits"), F.col("n"))
    two = evaluation.exact_interval(F.col("hits"), F.col("n"), one_sided=False)
    return hit_counts(spark, sf_dir).select("ticker", "n", "hits", F.round(low, 6).alias("low"), F.round(two[0], 6).alias("low_two_sided"), F.round(two[1], 6).alias("high_two_sided"))


def judged(spark, sf_dir) -> DataFrame:
    """Every tenth of the history of each name as a model's held-out rows: errors, hits, correlation of a move with the next."""
    df = prices.returns(bars(spark, sf_dir)).withColumn("y", F.lead("log_return_1d").over(W.partitionBy("ticker").orderBy("date"))).where("log_return_1d <> 0 AND y <> 0")
    df = df.withColumn("p", F.col("log_return_1d") / -2).withColumn("window", F.ntile(10).over(W.partitionBy("ticker").orderBy("date")))
    return df.groupBy("ticker", "window").agg(F.count("*").alias("n"), F.count_if(F.signum("p") == F.signum("y")).alias("hits"), F.sqrt(F.avg((F.col("p") - F.col("y")) ** 2)).alias("rmse"), F.sqrt(F.avg(F.col("y") ** 2)).alias("naive"), F.corr("p", "y").alias("c"))


JUDGED = RETURNS + f", x AS (SELECT *, lead(r1) {OVER} AS y FROM v), w AS (SELECT *, r1 / -2 AS q, ntile(10) {OVER} AS win FROM x WHERE r1 <> 0 AND y <> 0), h AS (SELECT ticker, win, count(*) AS n, count(*) FILTER (sign(q) = sign(y)) AS hits, sqrt(avg((q - y) ** 2)) AS rmse, sqrt(avg(y * y)) AS naive, corr(q, y) AS c FROM w GROUP BY ALL)"


@query("production_gate", JUDGED + f" SELECT ticker, CAST(win AS INT) AS window, n, round(CASE WHEN n >= 20 THEN {TAIL} ELSE 1 END, 6) AS p, rmse < naive AND hits / n::DOUBLE >= 0.5 AND CASE WHEN n >= 20 THEN {TAIL} ELSE 1 END < 0.30 AND n >= 15 AND coalesce(c, 0) >= 0.03 AS ready FROM h")
def production_gate(spark, sf_dir):
    h = judged(spark, sf_dir).withColumn("p", evaluation.gate_p(F.col("hits"), F.col("n")))
    ready = modelling.production_ready(F.col("rmse"), F.col("naive"), F.col("hits") / F.col("n"), F.col("p"), F.col("n"), F.coalesce("c", F.lit(0.0)))
    return h.select("ticker", F.col("window").cast("int").alias("window"), "n", F.round("p", 6).alias("p"), ready.alias("ready"))


@query("full_confidence", JUDGED + f""", s AS ({ORACLES_OF_MARKET['regime_score']}), t AS ({ORACLES_OF_MARKET['vol_autocorr']}),
d AS (SELECT ticker, CAST(date AS VARCHAR) AS date, r1, vol20, r5, ntile(10) OVER (PARTITION BY ticker ORDER BY date) AS win FROM v), k AS (SELECT d.*, hits / n::DOUBLE AS hit, n, c, regime_score, vol_ratio_5_20 FROM d JOIN h USING (ticker, win) JOIN s USING (ticker, date) JOIN t USING (ticker, date))
SELECT ticker, date, round(greatest(0.05::DOUBLE, least(0.65::DOUBLE, (0.05 + 0.6 * (0.4 * greatest(0, least(1, (hit - 0.5) / 0.1)) + 0.6 * greatest(0, least(1, c / 0.2)))) * (0.85 + 0.4 * least(1, abs(hit - 0.5) / 0.15)) + 0.05 * CASE WHEN vol20 > 1e-8 THEN least(1, abs(r1) / (1.5 * vol20)) ELSE 0 END + CASE WHEN sign(r1) = sign(r5) THEN 0.08 ELSE 0 END))
 * CASE WHEN n < 200 THEN 0.9 ELSE 1 END * CASE WHEN r5 IS NULL THEN 0.85 ELSE 1 END * CASE WHEN regime_score < 0 THEN greatest(0.9, 1 + 0.1 * regime_score) ELSE 1 END * CASE WHEN vol_ratio_5_20 > 1.5 THEN 1 - least(0.1, (vol_ratio_5_20 - 1.5) * 0.05) ELSE 1 END, 5) AS confidence FROM k WHERE r1 IS NOT NULL AND c IS NOT NULL""")
def full_confidence(spark, sf_dir):
    """Held-out figures of a tenth of a name's history, and each row's own size, agreement, regime and volatility."""
    df = prices.volatility_shape(prices.regimes(prices.returns(bars(spark, sf_dir)))).withColumn("window", F.ntile(10).over(W.partitionBy("ticker").orderBy("date")))
    df = df.join(judged(spark, sf_dir), ["ticker", "window"]).where("log_return_1d IS NOT NULL AND c IS NOT NULL").withColumn("hit", F.col("hits") / F.col("n"))
    agree = F.coalesce(F.signum("log_return_1d") == F.signum("log_return_5d"), F.lit(False))
    x = modelling.full_confidence(F.col("hit"), F.col("c"), F.col("hit"), F.col("log_return_1d"), F.col("volatility_20d"), agree, F.when(F.col("n") < 200, 0.9).otherwise(1.0), F.col("log_return_5d").isNull(), F.round("regime_score", 6), F.round("vol_ratio_5_20", 6))
    return df.select("ticker", as_text(), F.round(x, 5).alias("confidence"))


@query("next_known_value", "SELECT event_id, first_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_purchase FROM events")
def next_known_value(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", next_known(F.when(F.col("event_type") == "purchase", F.col("value")), W.partitionBy("user_id").orderBy("ts", "event_id")).alias("next_purchase"))


@query("trade_change", "WITH s AS (SELECT event_type AS symbol, arg_max(value, ts) AS last, arg_max(value, ts) FILTER (ts < TIMESTAMP '2024-01-20') AS previous_close FROM events GROUP BY 1) SELECT symbol, round(last - previous_close, 6) AS change, round(100 * (last - previous_close) / previous_close, 6) AS change_pct FROM s")
def trade_change(spark, sf_dir):
    t = event_trades(spark, sf_dir)
    before = live.running_state(t.where("ts < timestamp '2024-01-20'")).select("symbol", F.col("last").alias("previous_close"))
    return live.with_change(live.running_state(t), before).select("symbol", *r6("change", "change_pct"))


@query("ttl_read", "SELECT user_id, max(ts) >= TIMESTAMP '2024-01-30' - INTERVAL 1 DAY AS fresh FROM events WHERE ts <= TIMESTAMP '2024-01-30' GROUP BY 1")
def ttl_read(spark, sf_dir):
    return tables.fresh(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", F.lit("2024-01-30").cast("timestamp"), 86400).select("user_id", "fresh")


@query("change_threshold", """WITH e AS (SELECT user_id, event_id, ts, value / 1000 AS a, CASE WHEN event_type <> 'error' THEN CAST(json_extract_string(props, '$.k') AS INT) % 10 / 200.0::DOUBLE END AS b FROM events), l AS (SELECT *, lag(ts) OVER w AS t0, lag(a) OVER w AS a0, coalesce(lag(b) OVER w, 0) AS b0 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT user_id, event_id FROM l WHERE t0 IS NULL OR t0 < ts - INTERVAL 1 HOUR OR abs(a - a0) > 0.05 OR abs(coalesce(b, 0) - b0) > 0.05""")
def change_threshold(spark, sf_dir):
    """Each event as a new row against the user's events before it."""
    b = F.when(F.col("event_type") != "error", F.get_json_object("props", "$.k").cast("int") % 10 / 200)
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("value") / 1000).alias("a_sentiment"), b.alias("b_sentiment"))
    stored = e.withColumn("ts", F.col("ts") + F.make_dt_interval(secs=F.lit(0.000001)))  # known a moment later, so that no event meets itself
    return tables.changed(stored, e, ["user_id"], "ts").select("user_id", "event_id")


@query("ticker_splits", BRANDS + """, r AS (SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n FROM p), c AS (SELECT *, greatest(30, floor(n * 0.7::DOUBLE)) AS a FROM r WHERE n >= 50), d AS (SELECT *, least(n, greatest(a + 20, floor(n * 0.85::DOUBLE))) AS b FROM c)
SELECT ticker, CAST(date AS VARCHAR) AS date, CASE WHEN i < a THEN 'train' WHEN i >= a + 10 AND i < b THEN 'validation' WHEN i >= b + 10 THEN 'test' END AS part FROM d WHERE a + 10 < b""")
def ticker_splits(spark, sf_dir):
    return modelling.split_in_time(bars(spark, sf_dir), 5).select("ticker", as_text(), "part")
