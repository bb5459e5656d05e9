"""Queries of provider scores, model gates and small figures on the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import ratio
from barloom.operators import gauges, modelling, prices, reports
from barloom.plans.adapters import _monthly, as_text, monthly, r6
from barloom.plans.market import BRANDS, OVER, RETURNS
from barloom.plans.more import HITS, SCORED, hit_counts, scored
from barloom.sources.tables import bars, table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


KINDS = {"sb": "purchase", "b": "click", "h": "view", "s": "error", "ss": "signup"}
VOTES = "WITH g AS (SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{kind}')::DOUBLE AS {name}" for name, kind in KINDS.items()) + ", count(*)::DOUBLE AS n, avg(value) AS mean, max(value) AS top FROM events GROUP BY 1)"


def votes(spark, sf_dir) -> DataFrame:
    """The kinds of a user's events as votes of analysts."""
    counts = [F.count_if(F.col("event_type") == kind).cast("double").alias(name) for name, kind in KINDS.items()]
    return table(spark, sf_dir, "events").groupBy("user_id").agg(*counts, F.count("*").cast("double").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("top"))


def five() -> list:
    return [F.col(c) for c in KINDS]


@query("vote_summary", VOTES + " SELECT user_id, round((sb + b / 2 - s / 2 - ss) / n, 6) + 0.0::DOUBLE AS score, round(least(n / 10, 1), 6) AS confidence, round((sb + b) / n, 6) AS positive, round((sb + b) / n - 0.4, 6) + 0.0::DOUBLE AS trend, CASE WHEN (sb + 0.5 * b - 0.5 * s - ss) / n > 0.2 THEN 'BUY' WHEN (sb + 0.5 * b - 0.5 * s - ss) / n < -0.2 THEN 'SELL' ELSE 'HOLD' END AS consensus FROM g")
def vote_summary(spark, sf_dir):
    v = gauges.vote_summary(*five(), F.lit(0.4))
    return votes(spark, sf_dir).withColumns(v).select("user_id", *r6("score", "confidence", "positive", "trend"), "consensus")


@query("vote_shares", VOTES + " SELECT user_id, round(100 * (sb + b) / n, 6) AS bullish, round(100 * (s + ss) / n, 6) AS bearish FROM g")
def vote_shares(spark, sf_dir):
    bullish, bearish = gauges.vote_shares(*five())
    return votes(spark, sf_dir).withColumns({"bullish": bullish, "bearish": bearish}).select("user_id", *r6("bullish", "bearish"))


@query("estimate_composite", VOTES + """, x AS (SELECT user_id, greatest(-1, least(1, (sb - 5) / 5)) AS a, CASE WHEN b <> 0 THEN greatest(-1, least(1, (b - 3) / 2)) END AS r, CASE WHEN mean > 0 AND top > 0 THEN greatest(-1, least(1, (top / mean - 1) * 2)) ELSE 0 END AS t, CASE WHEN s <> 0 THEN CASE WHEN mean > 0 THEN greatest(-1, least(1, (s * 20 / mean - 1) * 2)) ELSE 0 END END AS c FROM g),
y AS (SELECT *, 0.3::DOUBLE + CASE WHEN r IS NULL THEN 0 ELSE 0.3 END::DOUBLE + 0.25::DOUBLE + CASE WHEN c IS NULL THEN 0 ELSE 0.15 END::DOUBLE AS w FROM x) SELECT user_id, round((0.3 * a + coalesce(0.3 * r, 0) + 0.25 * t + coalesce(0.15 * c, 0)) / w, 6) + 0.0::DOUBLE AS score, round(w / 4, 6) AS confidence FROM y""")
def estimate_composite(spark, sf_dir):
    score, confidence = gauges.estimate_composite(F.col("sb"), F.col("b"), F.col("top"), F.col("s") * 20, F.col("mean"))
    return votes(spark, sf_dir).withColumns({"score": score, "confidence": confidence}).select("user_id", *r6("score", "confidence"))


@query("two_feed_composite", VOTES + ", x AS (SELECT user_id, nullif((sb - s) / n, 0) AS i, nullif((sb + b - ss) / n, 0) AS v FROM g), y AS (SELECT *, CASE WHEN i IS NULL THEN 0 ELSE 0.4 END::DOUBLE + CASE WHEN v IS NULL THEN 0 ELSE 0.6 END::DOUBLE AS w FROM x) SELECT user_id, round(coalesce((coalesce(i * 0.4, 0) + coalesce(v * 0.6, 0)) / nullif(w, 0), 0), 6) + 0.0::DOUBLE AS score, round(w / 2, 6) AS confidence FROM y")
def two_feed_composite(spark, sf_dir):
    score, confidence = gauges.two_feed_composite((F.col("sb") - F.col("s")) / F.col("n"), (F.col("sb") + F.col("b") - F.col("ss")) / F.col("n"))
    return votes(spark, sf_dir).withColumns({"score": score, "confidence": confidence}).select("user_id", *r6("score", "confidence"))


@query("short_interest_trend", VOTES + " SELECT user_id, round(CASE WHEN h > 0 THEN greatest(-0.5, least(0.5, (h - sb) / h)) ELSE 0 END, 6) + 0.0::DOUBLE AS score, round(least(n / 5, 1), 6) AS confidence FROM g")
def short_interest_trend(spark, sf_dir):
    score, confidence = gauges.short_interest_trend(F.col("sb"), F.col("h"), F.col("n"))
    return votes(spark, sf_dir).withColumns({"score": score, "confidence": confidence}).select("user_id", *r6("score", "confidence"))


@query("short_interest_change", "WITH d AS (SELECT user_id, CAST(ts AS DATE) AS date, count(*) AS x FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER w AS p, lead(x) OVER w AS b FROM d WINDOW w AS (PARTITION BY user_id ORDER BY date DESC)) SELECT user_id, round(100.0::DOUBLE * (x - b) / b, 6) + 0.0::DOUBLE AS change, CASE WHEN x > 1.1 * b THEN 'bearish' WHEN x < 0.9 * b THEN 'bullish' END AS alert FROM r WHERE p = 1 AND b IS NOT NULL")
def short_interest_change(spark, sf_dir):
    d = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("date")).agg(F.count("*").alias("x"))
    return gauges.short_interest_change(d, "user_id", "date", "x").select("user_id", *r6("change"), "alert")


@query("event_volatility", VOTES + """, v AS (SELECT *, least(2, CASE WHEN top > 90 THEN 1 ELSE 0 END + CASE WHEN sb = 0 THEN 1.2 WHEN sb <= 2 THEN 0.6 WHEN sb <= 5 THEN 0.3 ELSE 0 END + CASE WHEN s = 0 THEN 0.4 WHEN s <= 2 THEN 0.2 ELSE 0 END + CASE WHEN b > 5 THEN 0.4 WHEN b > 3 THEN 0.2 ELSE 0 END)::DOUBLE AS v FROM g)
SELECT user_id, round(v, 6) AS volatility, round((0 - CASE WHEN top > 90 THEN 0.2 ELSE 0 END - CASE WHEN b > 5 THEN 0.1 ELSE 0 END - CASE WHEN h <= 2 THEN 0.05 ELSE 0 END + CASE WHEN v > 1.5 THEN 0.1 ELSE 0 END)::DOUBLE, 6) + 0.0::DOUBLE AS sentiment FROM v""")
def event_volatility(spark, sf_dir):
    today = F.col("top") > 90
    df = votes(spark, sf_dir).withColumn("volatility", F.round(gauges.event_volatility(today, F.col("sb"), F.col("s"), F.col("b")), 6))
    return df.withColumn("sentiment", gauges.event_sentiment(today, F.col("b"), F.col("h"), F.col("volatility"))).select("user_id", "volatility", *r6("sentiment"))


@query("quality_gate", VOTES + " SELECT user_id, CASE WHEN sb + b + h = 0 THEN s + ss = 0 ELSE (sb + b) / (sb + b + h) >= 0.8 END AND CASE WHEN s + ss = 0 THEN true ELSE s / (s + ss) <= 0.2 END AS passed FROM g")
def quality_gate(spark, sf_dir):
    passed = gauges.quality_gate(F.col("sb") + F.col("b"), F.col("sb") + F.col("b") + F.col("h"), F.col("s"), F.col("s") + F.col("ss"))
    return votes(spark, sf_dir).select("user_id", passed.alias("passed"))


@query("ensemble_weight", HITS + ", c AS (SELECT ticker, n, greatest(0, hits / n::DOUBLE - 0.5) AS own FROM h), w AS (SELECT *, greatest(0.2, least(0.9, own / (own + 0.02 + 1e-6))) AS w FROM c) SELECT ticker, round(CASE WHEN n >= 50 THEN least(0.9, w + 0.15) ELSE w END::DOUBLE, 6) AS weight FROM w")
def ensemble_weight(spark, sf_dir):
    return hit_counts(spark, sf_dir).select("ticker", F.round(gauges.ensemble_weight(F.lit(0.02), F.col("hits") / F.col("n") - 0.5, F.col("n") >= 50), 6).alias("weight"))


@query("kill_switch", HITS + " SELECT ticker, hits / n::DOUBLE - 0.5 >= -0.08::DOUBLE AS usable FROM h")
def kill_switch(spark, sf_dir):
    return hit_counts(spark, sf_dir).select("ticker", gauges.pooled_usable(F.col("hits") / F.col("n") - 0.5).alias("usable"))


@query("baselines", RETURNS + f", y AS (SELECT ticker, date, ln(lead(close, 5) {OVER} / close) AS y, coalesce(r1, 0) AS m FROM v), z AS (SELECT *, coalesce(lag(y, 5) {OVER}, 0) AS l FROM y) SELECT ticker, round(sqrt(avg(y * y)), 6) AS rmse_zero, round(sqrt(avg((y - m) ** 2)), 6) AS rmse_momentum, round(sqrt(avg((y - l) ** 2)), 6) AS rmse_last FROM z WHERE y IS NOT NULL GROUP BY 1")
def baselines(spark, sf_dir):
    df = gauges.series_target(prices.returns(bars(spark, sf_dir)), 5)
    return gauges.baselines(df, ["ticker"], "y", "log_return_1d", 5).select("ticker", *r6("rmse_zero", "rmse_momentum", "rmse_last"))


@query("out_of_sample_start", BRANDS + ", r AS (SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n FROM p), f AS (SELECT ticker, min(date) AS d FROM r WHERE n >= 50 AND i >= least(n, greatest(greatest(30, floor(n * 0.7::DOUBLE)) + 20, floor(n * 0.85::DOUBLE))) + 10 GROUP BY 1) SELECT CAST(max(d) + 1 AS VARCHAR) AS start FROM f")
def out_of_sample_start(spark, sf_dir):
    b = bars(spark, sf_dir)
    return gauges.out_of_sample_start(modelling.split_in_time(b, 5), b).select(F.date_format("start", "yyyy-MM-dd").alias("start"))


@query("platt_calibration")
def platt_calibration(spark, sf_dir):
    """Raw score: a row's move; outcome: whether the next one rises. Fitted on the validation rows, shown on the test's."""
    df = modelling.split_in_time(gauges.series_target(prices.returns(bars(spark, sf_dir)), 1).where("log_return_1d IS NOT NULL AND y IS NOT NULL"), 1)
    df = df.withColumn("up", (F.col("y") > 0).cast("double")).persist()  # the fit and the result read sales once
    slope, intercept = gauges.platt(df.where("part = 'validation'"), "log_return_1d", "up")
    return df.where("part = 'test'").select("ticker", as_text(), gauges.sigmoid(F.col("log_return_1d"), slope, intercept).alias("probability"))


@query("recent_confidence", SCORED + ", r AS (SELECT source, confidence, row_number() OVER (ORDER BY event_id DESC) AS i FROM s) SELECT source, round(avg(confidence), 6) AS confidence, count(*) AS n FROM r WHERE i <= 100 GROUP BY 1")
def recent_confidence(spark, sf_dir):
    return gauges.recent_confidence(scored(spark, sf_dir), [F.desc("event_id")], "source").select("source", *r6("confidence"), "n")


FEATURES = "WITH c AS (SELECT user_id, event_type || '_' || CAST(hour(ts) % 4 AS VARCHAR) AS feature, value - 50 AS x FROM events), f AS (SELECT user_id, feature, arg_max(x, struct_pack(a := abs(x), b := x)) AS x FROM c GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY abs(x) DESC, feature) AS place FROM f)"


def strongest(spark, sf_dir) -> DataFrame:
    """Kinds of a user's events by time of day as features, with contributions."""
    e = table(spark, sf_dir, "events").select("user_id", F.concat_ws("_", "event_type", (F.hour(F.col("ts").cast("timestamp")) % 4).cast("string")).alias("feature"), (F.col("value") - 50).alias("contribution"))
    return gauges.strongest_contributions(e, ["user_id"])


@query("strongest_contributions", FEATURES + " SELECT user_id, feature, round(x, 6) + 0.0::DOUBLE AS contribution, place FROM r WHERE place <= 8")
def strongest_contributions(spark, sf_dir):
    return strongest(spark, sf_dir).select("user_id", "feature", *r6("contribution"), "place")


@query("kept_features", FEATURES + ", t AS (SELECT user_id, list(feature ORDER BY feature) AS f FROM r WHERE place <= 3 GROUP BY 1) SELECT user_id, array_to_string(list_concat(['view_0', 'click_1'], list_filter(f, lambda x: x NOT IN ('view_0', 'click_1'))), ',') AS features FROM t")
def kept_features(spark, sf_dir):
    return gauges.kept_features(strongest(spark, sf_dir), ["user_id"], ["view_0", "click_1"], 3).select("user_id", F.array_join("features", ",").alias("features"))


@query("training_summary", "SELECT event_type, round(median(value), 6) AS median, count(*) FILTER (value > 50) AS wins, count(*) AS n FROM events GROUP BY 1")
def training_summary(spark, sf_dir):
    return gauges.training_summary(table(spark, sf_dir, "events"), "event_type", "value", F.col("value") > 50).select("event_type", *r6("median"), "wins", "n")


@query("news_gauge", SCORED + " SELECT user_id, round(50 * (1 + (count(*) FILTER (score > 0.1) - count(*) FILTER (score < -0.1)) / count(*)::DOUBLE), 6) AS gauge FROM s GROUP BY 1")
def news_gauge(spark, sf_dir):
    return gauges.gauge(scored(spark, sf_dir), ["user_id"], "score", 0.1).select("user_id", *r6("gauge"))


@query("recent_sides", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS i FROM events) SELECT user_id, count(*) FILTER (event_type = 'purchase') AS buys, count(*) FILTER (event_type = 'error') AS sells, count(*) AS n FROM r WHERE i <= 10 GROUP BY 1")
def recent_sides(spark, sf_dir):
    return gauges.recent_sides(table(spark, sf_dir, "events"), "user_id", [F.desc("event_id")], "event_type", "purchase", "error")


@query("price_summary", BRANDS + f", r AS (SELECT *, 100 * (close / lag(close) {OVER} - 1) AS a, 100 * (close / lag(close, 5) {OVER} - 1) AS b, 100 * (close / lag(close, 21) {OVER} - 1) AS c FROM p), s AS (SELECT *, CASE WHEN count(a) OVER w = 30 THEN stddev_samp(a) OVER w END AS sd, CASE WHEN count(volume) OVER w = 30 THEN avg(volume) OVER w END AS v, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS i FROM r WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 29 PRECEDING))" + """
SELECT ticker, close, round(a, 4) + 0.0::DOUBLE AS change_1d, round(b, 4) + 0.0::DOUBLE AS change_1w, round(c, 4) + 0.0::DOUBLE AS change_1m, round(v, 4) AS volume_30d, round(sd, 4) AS volatility_30d FROM s WHERE i = 1""")
def price_summary(spark, sf_dir):
    df = gauges.price_summary(bars(spark, sf_dir))
    return df.select("ticker", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in df.columns[2:]], "close")


@query("relevant_news", SCORED + ", r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k DESC, event_id) AS place FROM s WHERE k > 70) SELECT user_id, event_id, place FROM r WHERE place <= 3")
def relevant_news(spark, sf_dir):
    return gauges.relevant(scored(spark, sf_dir), ["user_id"], "k", "event_id").select("user_id", "event_id", "place")


@query("forum_stats", SCORED + " SELECT source, count(*) AS posts, round(avg(score), 6) + 0.0::DOUBLE AS score, round(avg(k), 6) AS up, round(avg(event_id), 6) AS comments, round((sum(k) - sum(floor(confidence * 10))) / greatest(1, sum(k) + sum(floor(confidence * 10))), 6) + 0.0::DOUBLE AS engagement FROM s GROUP BY 1")
def forum_stats(spark, sf_dir):
    posts = scored(spark, sf_dir).withColumns({"up": F.col("k"), "down": F.floor(F.col("confidence") * 10).cast("double"), "comments": F.col("event_id")})
    return gauges.forum_stats(posts, "source").select("source", "posts", *r6("score", "up", "comments", "engagement"))


@query("curve_inversion", f"WITH {_monthly('a', '1-URGENT')}, {_monthly('b', '5-LOW')}, x AS (SELECT (SELECT value FROM a ORDER BY date DESC LIMIT 1) AS long, (SELECT value FROM b ORDER BY date DESC LIMIT 1) AS short) SELECT round(long, 4) AS long, round(short, 4) AS short, round(long - short, 4) AS spread, long < short AS inverted FROM x")
def curve_inversion(spark, sf_dir):
    df = gauges.curve(monthly(spark, sf_dir, "1-URGENT"), monthly(spark, sf_dir, "5-LOW"))
    return df.select(*[F.round(c, 4).alias(c) for c in ("long", "short", "spread")], "inverted")


@query("flow_header", """WITH s AS (SELECT p_brand, sum(p_size) FILTER (p_size > 25)::DOUBLE AS t, sum(p_size) FILTER (p_size > 40)::DOUBLE AS g, max(p_retailprice)::DOUBLE AS k FROM part GROUP BY 1), f AS (SELECT p_brand, coalesce(nullif(t, 0), k, 0) AS t, coalesce(nullif(g, 0), k, 0) AS g FROM s) SELECT p_brand, t AS total, g AS part, round(g / t, 6) AS margin FROM f""")
def flow_header(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", F.col("p_size").alias("value"), F.col("p_retailprice").alias("known"))
    into = p.where("value > 25").select("*", F.lit("Sales").alias("source"), F.lit("Revenue").alias("target"))
    out = p.where("value > 40").select("*", F.lit("Revenue").alias("source"), F.lit("Profit").alias("target"))
    rest = p.select("*", F.lit("Revenue").alias("source"), F.lit("Cost").alias("target"))
    df = gauges.flow_header(into.union(out).union(rest), ["p_brand"], "Revenue", "Profit", "known", "known")
    return df.select("p_brand", "total", "part", *r6("margin"))


@query("session_position", """WITH m AS (SELECT event_id, hour(n) * 60 + minute(n) AS m FROM (SELECT event_id, ts - INTERVAL 5 HOUR AS n FROM events)) SELECT event_id, CASE WHEN m < 240 OR m >= 1200 THEN 'overnight' WHEN m < 570 THEN 'pre' WHEN m < 960 THEN 'regular' ELSE 'after' END AS session,
round(CASE WHEN m < 240 THEN (m + 240) / 480.0::DOUBLE WHEN m < 570 THEN (m - 240) / 330.0::DOUBLE WHEN m < 960 THEN (m - 570) / 390.0::DOUBLE WHEN m < 1200 THEN (m - 960) / 240.0::DOUBLE ELSE (m - 1200) / 480.0::DOUBLE END, 6) AS share FROM m""")
def session_position(spark, sf_dir):
    """Minutes of New York; the events lie in January, when its clocks are five hours behind."""
    ts = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "America/New_York")
    name, share = gauges.session_position(F.hour(ts) * 60 + F.minute(ts))
    return table(spark, sf_dir, "events").select("event_id", name.alias("session"), F.round(share, 6).alias("share"))


@query("as_of_or_last", "WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY (ts <= TIMESTAMP '2024-01-02') DESC, ts DESC, event_id DESC) AS i FROM events) SELECT user_id, event_id FROM r WHERE i = 1")
def as_of_or_last(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.struct(F.col("ts").cast("timestamp").alias("ts"), "event_id").alias("at"))
    return gauges.as_of_or_last(e, "user_id", "at", F.struct(F.lit("2024-01-02").cast("timestamp").alias("ts"), F.lit(0).cast("long").alias("event_id"))).select("user_id", "event_id")


@query("sliding_windows", BRANDS + ", r AS (SELECT ticker, date, list(close) OVER w AS l FROM p WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 29 PRECEDING)) SELECT ticker, CAST(date AS VARCHAR) AS date, l[1] AS first, l[30] AS last, round(list_avg(l), 4) AS mean FROM r WHERE len(l) = 30")
def sliding_windows(spark, sf_dir):
    mean = ratio(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), F.lit(30))
    return gauges.sliding(bars(spark, sf_dir), "close", 30).select("ticker", as_text(), F.get("values", 0).alias("first"), F.get("values", 29).alias("last"), F.round(mean, 4).alias("mean"))


@query("blob_range", BRANDS + " SELECT ticker, CAST(date AS VARCHAR) AS date, close AS value FROM p WHERE date BETWEEN DATE '1996-01-01' AND DATE '1997-06-30'")
def blob_range(spark, sf_dir):
    """One document a ticker, as a store would hold it, opened again."""
    entry = F.struct(F.date_format("date", "yyyy-MM-dd"), "close")
    blobs = bars(spark, sf_dir).groupBy("ticker").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("blob"))
    return gauges.blob_range(blobs, "blob", "1996-01-01", "1997-06-30").select("ticker", "date", "value")


@query("holiday_sessions", """WITH l AS (SELECT event_id, ((ts + INTERVAL 366 DAY) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS t FROM events), m AS (SELECT event_id, t, hour(t) * 60 + minute(t) AS m FROM l)
SELECT event_id, CASE WHEN isodow(t) >= 6 OR CAST(t AS DATE) IN (DATE '2025-01-01', DATE '2025-01-20', DATE '2025-02-17') THEN 'closed' WHEN m >= 240 AND m < 570 THEN 'pre' WHEN m >= 570 AND m < 960 THEN 'regular' WHEN m >= 960 AND m < 1200 THEN 'after' ELSE 'closed' END AS session FROM m""")
def holiday_sessions(spark, sf_dir):
    """The events of January 2024 as if they were of January 2025, which has two holidays."""
    later = F.col("ts").cast("timestamp") + F.expr("interval 366 days")
    return table(spark, sf_dir, "events").select("event_id", reports.session_of(later).alias("session"))
