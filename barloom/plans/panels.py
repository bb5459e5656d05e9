"""Queries of filled panels, facts of companies, sessions, requests and figures of reports on the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.columns import SECTOR_IDS, sector_id
from barloom.functions.windows import exponential_mean
from barloom.operators import adapters, blends, evaluation, fundamentals, modelling, news, panels, prices, reports
from barloom.operators.asof import densify
from barloom.plans.adapters import as_text, r6
from barloom.plans.adapters import reports as reports_of
from barloom.plans.market import BRANDS, OVER
from barloom.plans.reports import PROB, WATCH, articles, probabilities, watched
from barloom.sources.tables import bars, market, table, unexpired

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


DENSE = BRANDS + ", s AS (SELECT ticker, min(date) AS a, max(date) AS b FROM p GROUP BY 1), g AS (SELECT ticker, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM s)"
FILLED = "coalesce(last_value({0} IGNORE NULLS) OVER u, first_value({0} IGNORE NULLS) OVER v)"
BOTH = "WINDOW u AS (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@query("clean_bars", DENSE + f""", f AS (SELECT ticker, date, {FILLED.format("close")} AS close, {FILLED.format("volume")} AS volume FROM g LEFT JOIN p USING (ticker, date) {BOTH}), r AS (SELECT *, close / nullif(lag(close) {OVER}, 0) - 1 AS r FROM f)
SELECT ticker, CAST(date AS VARCHAR) AS date, close, volume, round(ln(1 + r), 6) + 0.0::DOUBLE AS log_returns, round(CASE WHEN count(r) OVER w >= 20 THEN stddev_samp(r) OVER w END, 6) AS volatility,
 CAST(isodow(date) - 1 AS INT) AS day_of_week, CAST(month(date) AS INT) AS month, CAST(quarter(date) AS INT) AS quarter FROM r WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING)""")
def clean_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of every calendar day, days without trades filled."""
    df = panels.cleaned(densify(bars(spark, sf_dir), ["ticker"], "date"))
    return df.select("ticker", as_text(), "close", "volume", *r6("log_returns", "volatility"), "day_of_week", "month", "quarter")


CODES = (*panels.INDICATORS.values(), "DGS5", "VIXCLS")
OBSERVED = f"WITH o AS (SELECT [{', '.join(repr(c) for c in CODES)}][c_nationkey % {len(CODES)} + 1] AS code, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, CASE WHEN count(*) > 1 THEN sum(o_totalprice) END AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), i AS (SELECT k.name AS indicator, date, value FROM o JOIN (SELECT unnest([{', '.join(repr(c) for c in panels.INDICATORS.values())}]) AS code, unnest([{', '.join(repr(c) for c in panels.INDICATORS)}]) AS name) k USING (code) WHERE value IS NOT NULL)"


def observations(spark, sf_dir) -> DataFrame:
    """Monthly sums of orders of nations as series by code, two of them unlisted; months with one order have no value."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    code = F.element_at(F.array(*[F.lit(x) for x in CODES]), F.col("c_nationkey") % len(CODES) + 1)
    met = o.join(c.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    return met.groupBy(code.alias("code"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("date")).agg(F.when(F.count("*") > 1, F.sum("o_totalprice")).alias("value"))


@query("indicator_series", OBSERVED + " SELECT indicator, CAST(date AS VARCHAR) AS date, round(value, 2) AS value FROM i")
def indicator_series(spark, sf_dir):
    return panels.indicator_series(observations(spark, sf_dir)).select("indicator", as_text(), F.round("value", 2).alias("value"))


@query("latest_indicators", OBSERVED + ", r AS (SELECT *, row_number() OVER (PARTITION BY indicator ORDER BY date DESC) AS n FROM i) SELECT indicator, CAST(max(date) FILTER (n = 1) AS VARCHAR) AS date, round(max(value) FILTER (n = 1), 2) AS value, round(max(value) FILTER (n = 1) - max(value) FILTER (n = 2), 2) AS change FROM r GROUP BY 1")
def latest_indicators(spark, sf_dir):
    return panels.latest_indicators(panels.indicator_series(observations(spark, sf_dir))).select("indicator", as_text(), F.round("value", 2).alias("value"), F.round("change", 2).alias("change"))


@query("filled_panel", BRANDS + f""", m AS (SELECT date, avg(close) AS index_close FROM p WHERE day(date) % 3 = 0 GROUP BY 1), s AS (SELECT date, avg(close) AS sector_close FROM p WHERE substr(ticker, 7, 1) = '1' AND day(date) % 2 = 0 GROUP BY 1)
SELECT ticker, CAST(date AS VARCHAR) AS date, close, round({FILLED.format("index_close")}, 6) AS index_close, round({FILLED.format("sector_close")}, 6) AS sector_close FROM p LEFT JOIN m USING (date) LEFT JOIN s USING (date) {BOTH}""")
def filled_panel(spark, sf_dir):
    """An index known on every third day of the month and a sector known on even days."""
    b = bars(spark, sf_dir)
    daily = lambda df, c: df.groupBy("date").agg(F.avg("close").alias(c))
    df = panels.filled_panel(b, daily(b.where("day(date) % 3 = 0"), "index_close"), daily(b.where("substr(ticker, 7, 1) = '1' AND day(date) % 2 = 0"), "sector_close"))
    return df.select("ticker", as_text(), "close", *r6("index_close", "sector_close"))


@query("asof_held_returns", BRANDS + """, m AS (SELECT date, avg(close) AS close FROM p GROUP BY 1), t AS (SELECT o_orderkey, 'Brand#' || (1 + o_custkey % 5) || (1 + o_orderkey % 5) AS ticker, CAST(o_orderdate AS DATE) AS entry, CAST(o_orderdate AS DATE) + CAST(1 + o_custkey % 40 AS INT) AS exit FROM orders)
SELECT o_orderkey, a.close AS entry_close, b.close AS exit_close, round(ln(b.close / a.close), 6) + 0.0::DOUBLE AS held_return, round(ln(d.close / c.close), 6) + 0.0::DOUBLE AS market_return, round(ln(b.close / a.close) - ln(d.close / c.close), 6) + 0.0::DOUBLE AS excess_return
FROM t ASOF LEFT JOIN p a ON t.ticker = a.ticker AND t.entry >= a.date ASOF LEFT JOIN p b ON t.ticker = b.ticker AND t.exit >= b.date ASOF LEFT JOIN m c ON t.entry >= c.date ASOF LEFT JOIN m d ON t.exit >= d.date""")
def asof_held_returns(spark, sf_dir):
    """Orders as trades of a brand, held for up to forty days."""
    b = bars(spark, sf_dir)
    key, cust, day = F.col("o_orderkey"), F.col("o_custkey"), F.to_date("o_orderdate")
    trades = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("Brand#"), 1 + cust % 5, 1 + key % 5).alias("ticker"), day.alias("entry"), F.date_add(day, (1 + cust % 40).cast("int")).alias("exit"))
    return panels.held_returns(trades, b, market(b)).select("o_orderkey", "entry_close", "exit_close", *r6("held_return", "market_return", "excess_return"))


NOW = 1_700_000_000


@query("mentions", f"""WITH a AS (SELECT source AS feed, CASE WHEN doc_id % 11 > 0 THEN lang || ' ' || (doc_id % 50) END AS title, make_timestamp(({NOW}::BIGINT - doc_id % 1009 * 1000) * 1000000) AS told, CASE doc_id % 3 WHEN 0 THEN [lang, upper(lang), source] WHEN 1 THEN [lang] ELSE [source] END AS names FROM documents),
e AS (SELECT DISTINCT ON (r, t) t AS ticker, feed, title, told FROM (SELECT *, row_number() OVER () AS r, unnest(list_distinct(list_transform(names, lambda x: upper(x)))) AS t FROM a WHERE told >= make_timestamp({NOW}::BIGINT * 1000000) - INTERVAL 7 DAY) WHERE t IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY ticker, feed ORDER BY told DESC, title NULLS FIRST) AS n FROM e), o AS (SELECT *, row_number() OVER (PARTITION BY ticker, title ORDER BY told DESC, feed NULLS FIRST) AS m FROM k WHERE n <= 8 AND coalesce(title, '') <> '')
SELECT ticker, feed, title, epoch(told)::BIGINT AS "at" FROM o WHERE m = 1""")
def mentions(spark, sf_dir):
    """Documents as articles of feeds: languages and sources as names, under one of three keys."""
    i = F.col("doc_id")
    articles = table(spark, sf_dir, "documents").select(
        F.col("source").alias("feed"), F.when(i % 11 > 0, F.concat_ws(" ", "lang", (i % 50).cast("string"))).alias("title"), F.timestamp_seconds(NOW - i % 1009 * 1000).alias("published_at"),
        F.when(i % 3 == 0, F.array("lang", F.upper("lang"), "source")).alias("tickers"), F.when(i % 3 == 1, F.array("lang")).alias("symbols"), F.when(i % 3 == 2, F.col("source")).alias("ticker"),
    )
    return panels.mentions(articles, F.timestamp_seconds(F.lit(NOW))).select("ticker", "feed", "title", F.unix_timestamp("published_at").alias("at"))


WINDOWS = {"next_day": 1, "7_day": 5, "30_day": 21}


def predicted(spark, sf_dir) -> DataFrame:
    """The last move over each window as its prediction for the coming one; brands ending in 3 have no thirty-day prediction."""
    b = bars(spark, sf_dir)
    part = lambda n: b.select("ticker", "date", (F.col("close") - F.lag("close", n).over(panels.series())).alias("price_change"), F.col("close").alias("current_price"))
    kept = lambda w, df: df.where("ticker NOT LIKE '%3'") if w == "30_day" else df
    return panels.windows_long({w: kept(w, part(n)) for w, n in WINDOWS.items()})


PREDICTED = BRANDS + ", l AS (" + " UNION ALL ".join(f"SELECT ticker, date, close - lag(close, {n}) {OVER} AS c, close AS x, '{w}' AS w FROM p" + (" WHERE ticker NOT LIKE '%3'" if w == "30_day" else "") for w, n in WINDOWS.items()) + ")"


@query("prediction_windows", PREDICTED + " SELECT ticker, CAST(date AS VARCHAR) AS date, w AS \"window\", c + 0.0::DOUBLE AS price_change, x AS current_price FROM l")
def prediction_windows(spark, sf_dir):
    return predicted(spark, sf_dir).select("ticker", as_text(), "window", (F.col("price_change") + F.lit(0.0)).alias("price_change"), "current_price")


@query("mean_predicted_change", PREDICTED + " SELECT ticker, CAST(date AS VARCHAR) AS date, round(avg(coalesce(CASE WHEN x > 0 THEN c / x * 100 END, 0)), 6) + 0.0::DOUBLE AS mean_change, count(*) AS windows FROM l GROUP BY ALL")
def mean_predicted_change(spark, sf_dir):
    return panels.mean_predicted_change(predicted(spark, sf_dir), ["ticker", "date"]).select("ticker", as_text(), *r6("mean_change"), "windows")


@query("top_mover", PREDICTED + ", m AS (SELECT *, CASE WHEN x > 0 THEN c / x * 100 END AS ch FROM l), r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY abs(ch) DESC, ticker, ch DESC, w DESC) AS n FROM m WHERE ch <> 0) SELECT CAST(date AS VARCHAR) AS date, ticker, w AS \"window\", round(ch, 6) AS change FROM r WHERE n = 1")
def top_mover(spark, sf_dir):
    return panels.top_mover(predicted(spark, sf_dir), ["date"]).select(as_text(), "ticker", "window", *r6("change"))


REPORTED = "WITH o AS (SELECT c_mktsegment AS s, CAST(o_orderdate AS DATE) AS date, o_totalprice AS v, o_orderstatus = 'P' AS pending FROM orders JOIN customer ON o_custkey = c_custkey), r AS (SELECT * FROM o WHERE pending)"


def reported(spark, sf_dir) -> DataFrame:
    """Orders of segments; pending ones are taken as dated reports."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    met = o.join(c.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("ticker")), "o_custkey")
    return met.select("ticker", F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("value"), (F.col("o_orderstatus") == "P").alias("pending"))


@query("report_distances", REPORTED + """, e AS (SELECT DISTINCT s AS ticker, date FROM r WHERE day(date) <= 3), d AS (SELECT DISTINCT s AS ticker, date AS day FROM o),
n AS (SELECT d.ticker, d.day, a.date AS prev, b.date AS next FROM d ASOF LEFT JOIN e a ON d.ticker = a.ticker AND d.day > a.date ASOF LEFT JOIN e b ON d.ticker = b.ticker AND d.day < b.date)
SELECT n.ticker, CAST(day AS VARCHAR) AS day, CAST(e.date IS NOT NULL AS INT) AS has_today, CAST(coalesce(least(next - day, 90), 90) AS INT) AS days_to_next, CAST(coalesce(least(day - prev, 90), 90) AS INT) AS days_since_last FROM n LEFT JOIN e ON n.ticker = e.ticker AND n.day = e.date""")
def report_distances(spark, sf_dir):
    """A segment's days with orders against the first days of months on which it has pending ones."""
    r = reported(spark, sf_dir)
    days = r.select("ticker", F.col("date").alias("day"))
    return panels.report_distances(days, r.where("pending AND day(date) <= 3").select("ticker", "date")).select("ticker", as_text("day"), "has_today", "days_to_next", "days_since_last")


@query("all_reports", REPORTED + ", y AS (SELECT s AS ticker, year(date) AS y, list(v ORDER BY v) FILTER (month(date) > 9) AS u, list(v ORDER BY v) FILTER (month(date) < 3) AS p FROM r GROUP BY 1, 2) SELECT ticker, CAST(y AS INT) AS year, len(list_concat(coalesce(u, []), coalesce(p, []))) AS n, round(list_concat(coalesce(u, []), coalesce(p, []))[1], 4) AS first FROM y")
def all_reports(spark, sf_dir):
    some = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("value"))))
    y = reported(spark, sf_dir).where("pending").groupBy("ticker", F.year("date").alias("year")).agg(F.nullif(some(F.month("date") > 9), F.array().cast("array<double>")).alias("u"), some(F.month("date") < 3).alias("p"))
    return y.withColumn("a", panels.all_reports(y, "u", "p")).select("ticker", "year", F.size("a").cast("long").alias("n"), F.round(F.try_element_at("a", F.lit(1)), 4).alias("first"))


@query("sentiment_series", """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS date, event_id, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events),
s AS (SELECT *, coalesce(CASE WHEN event_id % 5 = 0 THEN value / 100 END, CASE WHEN event_id % 5 = 1 THEN k / 100 END, CASE WHEN event_id % 5 = 2 THEN (value / 50 - 1 + k / 50 - 1) / 2 END, CASE WHEN event_id % 5 = 3 THEN (k / 100 + value / 200) / 2 END, 0) AS c,
 coalesce(CASE WHEN event_id % 4 = 0 THEN floor(k) END, CASE WHEN event_id % 4 = 1 THEN floor(k + value) WHEN event_id % 4 = 2 THEN floor(k) END, 1)::BIGINT AS n FROM d)
SELECT user_id, CAST(date AS VARCHAR) AS date, round(arg_max(c, event_id), 6) + 0.0::DOUBLE AS composite_sentiment, arg_max(n, event_id) AS news_count FROM s GROUP BY ALL""")
def sentiment_series(spark, sf_dir):
    """Events as documents of users with a composite, a blend, scores by source, nested ones, or none."""
    k, i, v = F.get_json_object("props", "$.k").cast("double"), F.col("event_id"), F.col("value")
    docs = table(spark, sf_dir, "events").select(
        "user_id", F.to_date("ts").alias("date"), "event_id", F.when(i % 5 == 0, v / 100).alias("composite_sentiment"), F.when(i % 5 == 1, k / 100).alias("blended_sentiment"),
        F.when(i % 5 == 2, v / 50 - 1).alias("rss_sentiment"), F.when(i % 5 == 2, k / 50 - 1).alias("reddit_sentiment"), F.when(i % 5 == 3, F.create_map(F.lit("a"), k / 100, F.lit("b"), v / 200)).alias("sources"),
        F.when(i % 4 == 0, F.floor(k)).alias("news_count"), F.when((i % 4).isin(1, 2), k).alias("rss_news_volume"), F.when(i % 4 == 1, v).alias("finviz_volume"), v.alias("reddit_volume"),
    )
    return blends.sentiment_series(docs, ["user_id", "date"], "event_id").select("user_id", as_text(), *r6("composite_sentiment"), "news_count")


FACTS = ("Revenues", "SalesRevenueNet", "NetIncomeLoss", "ProfitLoss", "Assets")
_FACT = f"[{', '.join(repr(x) for x in FACTS)}][CAST(o_orderpriority[1] AS INT)]"
REPORTS = f"""WITH o AS (SELECT c_nationkey::VARCHAR AS symbol, c_nationkey AS k, {_FACT} AS fact, CAST(o_orderdate AS DATE) AS d, o_totalprice AS v FROM orders JOIN customer ON o_custkey = c_custkey),
q AS (SELECT symbol, k, fact, CAST(date_trunc('quarter', d) AS DATE) AS s, sum(v) AS val, max(d) + 30 AS filed FROM o GROUP BY ALL), y AS (SELECT symbol, k, fact, CAST(date_trunc('year', d) AS DATE) AS s, sum(v) AS val, max(d) + 60 AS filed FROM o GROUP BY ALL),
f AS (SELECT symbol, fact, val, s AS "start", CAST(s + INTERVAL 3 MONTH AS DATE) - 1 AS "end", filed, CASE WHEN quarter(s) = 4 THEN '10-K' WHEN k % 3 = 0 THEN '8-K' ELSE '10-Q' END AS form, CASE WHEN k % 2 = 0 THEN 'CY' || year(s) || 'Q' || quarter(s) END AS frame, CASE WHEN k % 7 > 0 THEN year(s) END AS fy,
 CASE WHEN k % 5 > 0 AND quarter(s) < 4 THEN 'Q' || quarter(s) WHEN k % 5 = 1 THEN 'FY' END AS fp FROM q UNION ALL SELECT symbol, fact, val, s, CAST(s + INTERVAL 1 YEAR AS DATE) - 1, filed, '10-K', NULL, year(s), 'FY' FROM y)"""


def reported_facts(spark, sf_dir) -> DataFrame:
    """Sums of nations' orders by quarter and year as companies' facts, with forms, frames and periods that some of them lack."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    fact = F.element_at(F.array(*[F.lit(x) for x in FACTS]), F.substring("o_orderpriority", 1, 1).cast("int"))
    met = o.join(c.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("k")), "o_custkey").select("k", fact.alias("fact"), F.to_date("o_orderdate").alias("d"), F.col("o_totalprice").alias("v"))

    def part(unit: str, months: int, late: int) -> DataFrame:
        s = met.groupBy("k", "fact", F.to_date(F.date_trunc(unit, "d")).alias("s")).agg(F.sum("v").alias("val"), F.date_add(F.max("d"), late).alias("filed"))
        return s.withColumns({"e": F.date_sub(F.add_months("s", months), 1), "y": F.year("s"), "q": F.quarter("s")})

    k, q = F.col("k"), F.col("q")
    columns = lambda form, frame, fy, fp: [k.cast("string").alias("symbol"), "fact", F.lit("USD").alias("unit"), "val", F.col("s").cast("string").alias("start"), F.col("e").cast("string").alias("end"), F.col("filed").cast("string").alias("filed"), form.alias("form"), frame.alias("frame"), fy.alias("fy"), fp.alias("fp")]
    text = lambda x: F.lit(x).cast("string")
    quarters = part("quarter", 3, 30).select(*columns(
        F.when(q == 4, "10-K").when(k % 3 == 0, "8-K").otherwise("10-Q"), F.when(k % 2 == 0, F.concat(F.lit("CY"), "y", F.lit("Q"), "q")),
        F.when(k % 7 > 0, F.col("y")), F.when((k % 5 > 0) & (q < 4), F.concat(F.lit("Q"), "q")).when(k % 5 == 1, "FY")))
    years = part("year", 12, 60).select(*columns(text("10-K"), text(None), F.col("y"), text("FY")))
    return fundamentals.normalise(quarters.union(years))


NORMAL = REPORTS + """, z AS (SELECT *, "end" - "start" AS days, coalesce(fy, CASE WHEN frame IS NOT NULL THEN year("start") END) AS y, coalesce(CASE WHEN fp LIKE 'Q_' THEN fp[2]::INT END, CASE WHEN frame IS NOT NULL THEN quarter("start") END, CASE WHEN form = '10-K' AND fp = 'FY' AND "end" - "start" BETWEEN 55 AND 125 THEN 4 END) AS q FROM f)"""


@query("normalised_facts", NORMAL + """ SELECT symbol, fact, CAST("start" AS VARCHAR) AS "start", CAST(days AS INT) AS days, form, CAST(y AS INT) AS year, CAST(q AS INT) AS quarter, round(val, 2) AS val FROM z""")
def normalised_facts(spark, sf_dir):
    return reported_facts(spark, sf_dir).select("symbol", "fact", as_text("start"), "days", "form", "year", "quarter", F.round("val", 2).alias("val"))


@query("best_quarters", NORMAL + """, c AS (SELECT *, CASE fact WHEN 'Revenues' THEN 0 ELSE 1 END AS place, coalesce(y || '-Q' || q, CAST("end" AS VARCHAR)) AS period FROM z WHERE fact IN ('Revenues', 'SalesRevenueNet') AND coalesce(fp, '') <> 'FY' AND days BETWEEN 55 AND 125),
s AS (SELECT *, 50 + CASE WHEN frame IS NOT NULL THEN 20 ELSE 0 END + CASE WHEN fp LIKE 'Q_' THEN 15 ELSE 0 END + CASE form WHEN '10-Q' THEN 10 WHEN '10-K' THEN 6 ELSE 0 END + 2 + 2 - place AS score FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY symbol, period ORDER BY score DESC, "end" DESC, filed DESC, place, val DESC) AS n FROM s)
SELECT symbol, period, fact, CAST(score AS INT) AS score, round(val, 2) AS val FROM r WHERE n = 1""")
def best_quarters(spark, sf_dir):
    return fundamentals.best_quarters(reported_facts(spark, sf_dir), {"Revenues": 0, "SalesRevenueNet": 1}).select("symbol", "period", "fact", "score", F.round("val", 2).alias("val"))


@query("annual_metrics", NORMAL + """, m AS (SELECT *, CASE WHEN fact IN ('Revenues', 'SalesRevenueNet') THEN 'revenue' WHEN fact = 'Assets' THEN 'assets' ELSE 'netIncome' END AS metric, CASE fact WHEN 'Revenues' THEN 1 WHEN 'SalesRevenueNet' THEN 3 WHEN 'ProfitLoss' THEN 1 ELSE 0 END AS place FROM z WHERE (form = '10-K' OR coalesce(fp, '') = 'FY') AND days BETWEEN 250 AND 400),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol, metric ORDER BY "end" DESC, filed DESC, place, val DESC) AS n FROM m) SELECT symbol, metric, fact, CAST("end" AS VARCHAR) AS "end", CAST(y AS INT) AS year, round(val, 2) AS val FROM r WHERE n = 1""")
def annual_metrics(spark, sf_dir):
    return fundamentals.annual_metrics(reported_facts(spark, sf_dir)).select("symbol", "metric", "fact", as_text("end"), "year", F.round("val", 2).alias("val"))


@query("holdout_summary", PROB + """, m AS (SELECT source, doc_id % 5 > 0 AND source <> (SELECT min(source) FROM documents) AS h, p AS e, 0.45::DOUBLE AS b, CASE WHEN doc_id % 3 > 0 THEN y END AS hit, p - y AS c FROM e)
SELECT source, count(*) AS models, count(*) FILTER (h) AS held, round(coalesce(median(e) FILTER (h), median(e)), 6) AS rmse, round(median(b) FILTER (h), 6) AS baseline, round(median(coalesce(hit, 0.5)) FILTER (h), 6) AS hits, round(median(c) FILTER (h), 6) + 0.0::DOUBLE AS correlation,
 round(avg(CASE WHEN e < b THEN 1.0::DOUBLE ELSE 0 END) FILTER (h), 6) AS win_rate, count(*) FILTER (h AND e < b) AS wins_last, round(avg(CASE WHEN c > 0.1 THEN 1.0::DOUBLE ELSE 0 END) FILTER (h), 6) AS ready_rate FROM m GROUP BY 1""")
def holdout_summary(spark, sf_dir):
    """Labelled documents as models of their source; the first source has none with held-out rows."""
    first = table(spark, sf_dir, "documents").agg(F.min("source")).scalar()
    i, e = F.col("doc_id"), F.col("p")
    models = probabilities(spark, sf_dir).select(
        "source", ((i % 5 > 0) & (F.col("source") != first)).alias("has_holdout"), e.alias("eval_rmse"), F.lit(0.45).alias("baseline_rmse"), F.when(i % 3 > 0, F.col("y")).alias("hit_rate"),
        (e - F.col("y")).alias("correlation"), (e < 0.45).alias("beats_baseline"), F.lit(None).cast("boolean").alias("beats_last_baseline"), (e - F.col("y") > 0.1).alias("production_ready"),
    )
    out = reports.holdout_summary(models, "source")
    return out.select("source", "models", "held", *r6("rmse", "baseline", "hits", "correlation", "win_rate"), "wins_last", *r6("ready_rate"))


@query("report_quality", """WITH e AS (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events),
c AS (SELECT event_id, CASE WHEN event_id % 3 > 0 THEN ((event_id % 2 = 0)::INT + (value > 20)::INT + (value > 50)::INT + (k > 50)::INT) / 4.0::DOUBLE END AS a, CASE WHEN event_id % 13 > 0 THEN least(event_id % 13 / 10.0::DOUBLE, 1) END AS b, CASE WHEN floor(k / 7) > 0 THEN least(floor(k / 7) / 10.0::DOUBLE, 1) END AS d,
 list_filter([CASE WHEN event_id % 7 > 0 THEN k / 200 END, CASE WHEN event_id % 7 > 1 THEN value / 500 END], lambda x: x IS NOT NULL) AS q FROM e), s AS (SELECT *, list_filter([a, b, d], lambda x: x IS NOT NULL) AS l FROM c)
SELECT event_id, round(coalesce(list_avg(l), 0), 6) AS completeness, CASE WHEN list_avg(q) IS NULL THEN 'UNKNOWN' WHEN list_avg(q) >= 0.35 THEN 'HIGH' WHEN list_avg(q) >= 0.2 THEN 'GOOD' WHEN list_avg(q) >= 0.1 THEN 'MODERATE' ELSE 'LOW' END AS quality FROM s""")
def report_quality(spark, sf_dir):
    """Events as reports with or without feeds, technicals, factors and confidences."""
    i, v, k = F.col("event_id"), F.col("value"), F.get_json_object("props", "$.k").cast("double")
    some = lambda c: F.when(i % 3 > 0, c)
    done = reports.report_completeness([some(i % 2 == 0), some(v > 20), some(v > 50), some(k > 50)], i % 13, F.floor(k / 7))
    quality = reports.model_quality([F.when(i % 7 > 0, k / 200), F.when(i % 7 > 1, v / 500)])
    return table(spark, sf_dir, "events").select("event_id", F.round(done, 6).alias("completeness"), quality.alias("quality"))


@query("watchlist_top3", WATCH + ", r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY CASE WHEN volume > 10 THEN volume ELSE 0 END DESC, ticker) AS n FROM w) SELECT CAST(date AS VARCHAR) AS date, ticker, CASE WHEN volume > 10 THEN volume END AS volume, CAST(n AS INT) AS place FROM r WHERE n <= 3")
def watchlist_top3(spark, sf_dir):
    """The three names of a day with the greatest volume; small volumes are unknown and count 0."""
    df = watched(spark, sf_dir).withColumn("volume", F.when(F.col("volume") > 10, F.col("volume")))
    return reports.top_with_default(df, ["date"], "volume", 3, "ticker").select(as_text(), "ticker", "volume", "place")


@query("article_page", "SELECT doc_id, n_chars, (SELECT count(*) FROM documents) AS total, (SELECT count(*) FROM documents) > 60 AS has_more FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 40")
def article_page(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return reports.page(d, [F.desc("n_chars"), F.col("doc_id")], 3, 20)


def _span(x: str, n: int) -> str:
    return f"CASE WHEN count(close) OVER (PARTITION BY ticker ORDER BY date ROWS {n - 1} PRECEDING) >= {n} THEN {x} OVER (PARTITION BY ticker ORDER BY date ROWS {n - 1} PRECEDING) END"


@query("technical_levels", BRANDS + f""", m AS (SELECT *, {_span("avg(close)", 20)} AS m20, {_span("stddev_samp(close)", 20)} AS d, {_span("avg(close)", 50)} AS m50, {_span("avg(close)", 200)} AS m200, {_span("avg(volume)", 20)} AS mv,
 max(high) OVER y AS hi, min(low) OVER y AS lo FROM p WINDOW y AS (PARTITION BY ticker ORDER BY date ROWS 251 PRECEDING))
SELECT ticker, CAST(date AS VARCHAR) AS date, round((close / m20 - 1) * 100, 5) + 0.0::DOUBLE AS from_sma20, round((close / m50 - 1) * 100, 5) + 0.0::DOUBLE AS from_sma50, round((close / m200 - 1) * 100, 5) + 0.0::DOUBLE AS from_sma200, round((close / hi - 1) * 100, 5) + 0.0::DOUBLE AS from_high, round((close / lo - 1) * 100, 5) + 0.0::DOUBLE AS from_low,
 round(4 * d / close * 100, 5) AS band_width, CASE WHEN d IS NULL THEN NULL WHEN close > m20 + 1.2 * d THEN 'upper' WHEN close < m20 - 1.2 * d THEN 'lower' ELSE 'middle' END AS band_place, CASE WHEN volume / mv > 1.2 THEN 'above average' WHEN volume / mv < 0.8 THEN 'below average' WHEN mv IS NOT NULL THEN 'normal' END AS volume_label FROM m""")
def technical_levels(spark, sf_dir):
    r5 = lambda *names: [(F.round(n, 5) + F.lit(0.0)).alias(n) for n in names]
    return reports.technical_levels(bars(spark, sf_dir)).select("ticker", as_text(), *r5("from_sma20", "from_sma50", "from_sma200", "from_high", "from_low", "band_width"), "band_place", "volume_label")


_SHUT = f"isodow(d) >= 6 OR strftime(d, '%Y-%m-%d') IN ({', '.join(repr(h) for h in reports.HOLIDAYS)})"


@query("next_session", f"""WITH l AS (SELECT event_id, ((ts + INTERVAL 350 DAY) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS t FROM events),
d AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2027-01-01', INTERVAL 1 DAY)) AS DATE) AS d), o AS (SELECT d, s.name, d + s.a * INTERVAL 1 MINUTE AS time, d + s.b * INTERVAL 1 MINUTE AS stop FROM d, (VALUES ('pre', 240, 570), ('regular', 570, 960), ('after', 960, 1200)) s(name, a, b) WHERE NOT ({_SHUT}))
SELECT event_id, n.name AS session, strftime(n.time, '%Y-%m-%d %H:%M') AS opens, strftime(c.stop, '%Y-%m-%d %H:%M') AS closes FROM l ASOF LEFT JOIN o n ON l.t < n.time LEFT JOIN o c ON l.t >= c.time AND l.t < c.stop""")
def next_session(spark, sf_dir):
    """Events, moved to the turn of a year with known holidays."""
    ts = F.col("ts") + F.make_dt_interval(days=F.lit(350))
    name, opens, closes = reports.next_session(ts)
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    return table(spark, sf_dir, "events").select("event_id", name.alias("session"), text(opens).alias("opens"), text(closes).alias("closes"))


@query("request_verdicts", """WITH r AS (SELECT l_orderkey, list(' ' || lower(l_shipmode) ORDER BY l_linenumber, lower(l_shipmode)) AS t, CASE WHEN l_orderkey % 17 > 0 THEN l_orderkey % 2600 END AS d FROM (SELECT l_orderkey, l_linenumber, CASE l_suppkey % 4 WHEN 0 THEN 'BRK.B' WHEN 1 THEN 'x-' || l_linenumber ELSE l_returnflag || l_suppkey END AS l_shipmode FROM lineitem) GROUP BY 1),
p AS (SELECT *, list_transform(t, lambda x: upper(trim(x))) AS u FROM r), v AS (SELECT *, CASE WHEN len(t) > 10 THEN 'many' WHEN len(list_filter(u, lambda x: NOT regexp_full_match(x, '[A-Z0-9.\\-]{1,6}'))) > 0 THEN 'invalid' WHEN len(list_distinct(u)) < len(u) THEN 'duplicate' WHEN d IS NULL OR d < 1 OR d > 2520 THEN 'days' ELSE 'ok' END AS verdict FROM p)
SELECT l_orderkey, verdict, CASE WHEN verdict = 'ok' THEN array_to_string(u, ',') END AS tickers FROM v""")
def request_verdicts(spark, sf_dir):
    """Orders as requests: their lines' suppliers as symbols, in small letters and with blanks."""
    n, i = F.col("l_suppkey"), F.col("l_orderkey")
    name = F.when(n % 4 == 0, "BRK.B").when(n % 4 == 1, F.concat(F.lit("x-"), "l_linenumber")).otherwise(F.concat("l_returnflag", "l_suppkey"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", F.concat(F.lit(" "), F.lower(name)).alias("t")).alias("x"))
    r = lines.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]).alias("t"))
    tickers, verdict = reports.request_verdict(F.col("t"), F.when(i % 17 > 0, i % 2600))
    return r.select("l_orderkey", verdict.alias("verdict"), F.array_join(tickers, ",").alias("tickers"))


@query("news_filters", """SELECT doc_id FROM documents WHERE lang = 'en' AND 1700000000 + doc_id * 60 BETWEEN epoch(TIMESTAMP '2023-11-14 22:30:00') AND epoch(TIMESTAMP '2023-11-18') AND doc_id % 3 < 2 AND upper(lang || doc_id % 4) IN ('EN0', 'EN3') AND contains(lower(text), 'a')""")
def news_filters(spark, sf_dir):
    """All filters at once: label, moments, tag and sectors, first ticker, and whole texts as snippets."""
    i = F.col("doc_id")
    a = articles(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("snippet")), "doc_id").withColumns({
        "sentiment": F.upper("provider"), "industry": F.element_at(F.array(F.lit("Health Care"), F.lit("health"), F.lit("tech")), (i % 3 + 1).cast("int")), "tickers": F.array(F.concat("provider", (i % 4).cast("string")), F.lit("EN0")),
    })
    return news.filtered(a, sentiment="EN", start="2023-11-14 22:30:00", end="2023-11-18", sector="energy, HEALTHCARE", search="A", tickers=["en0", " EN3 "], tag="HEALTH").select("doc_id")


@query("top_posts", """WITH d AS (SELECT doc_id, source, n_chars, lower(text) AS t FROM documents WHERE trim(text) <> ''), h AS (SELECT doc_id, source, n_chars, len(list_filter(['buy', 'moon', 'rocket', 'bull', 'calls', 'up', 'green', 'gains', 'hodl'], lambda x: contains(t, x))) AS u, len(list_filter(['sell', 'crash', 'bear', 'puts', 'down', 'red', 'loss', 'dump', 'short'], lambda x: contains(t, x))) AS d FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY source, u > d ORDER BY n_chars DESC, doc_id) AS n FROM h WHERE u <> d) SELECT source, CASE WHEN u > d THEN 'bullish' ELSE 'bearish' END AS label, CAST(n AS INT) AS place, doc_id, CAST(u AS INT) AS bullish, CAST(d AS INT) AS bearish FROM r WHERE n <= 2""")
def top_posts(spark, sf_dir):
    """Documents as posts of their source, by length."""
    posts = table(spark, sf_dir, "documents").select("doc_id", "source", F.lit("").alias("title"), F.col("text").alias("body"), F.col("n_chars").alias("score"))
    return news.top_posts(posts, ["source"], "doc_id").select("source", "label", "place", "doc_id", "bullish", "bearish")


@query("unexpired_reads", """WITH r AS (SELECT user_id, event_id, ts, CASE WHEN event_id % 3 > 0 THEN ts + INTERVAL 6 HOUR END AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type LIKE 'c%k' OR event_type LIKE 'p%') SELECT user_id, event_id FROM r WHERE n = 1 AND (x IS NULL OR x >= TIMESTAMP '2024-01-30')""")
def unexpired_reads(spark, sf_dir):
    """Events as stored documents of users, two in three with an expiry."""
    ts = F.col("ts").cast("timestamp")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", ts.alias("ts"), F.concat(F.lit("fmp_"), "event_type").alias("endpoint"), F.when(F.col("event_id") % 3 > 0, ts + F.make_dt_interval(hours=F.lit(6))).alias("expires_at"))
    return unexpired(e, "user_id", "ts", F.lit("2024-01-30").cast("timestamp"), "fmp_(c.*k$|p)").select("user_id", "event_id")


@query("sector_ids", f"SELECT DISTINCT p_brand AS ticker, CAST(coalesce(map {{{', '.join(f'{k!r}: {v}' for k, v in SECTOR_IDS.items())}}}[['XLK', 'XLE', 'xlre', 'NONE', NULL][CAST(p_brand[7] AS INT)].upper()], 1) AS INT) AS sector_id FROM part")
def sector_ids(spark, sf_dir):
    """Brands by the fund of their first digit, one unknown; digits behind it have none."""
    fund = F.try_element_at(F.array(F.lit("XLK"), F.lit("XLE"), F.lit("xlre"), F.lit("NONE"), F.lit(None).cast("string")), F.substring("p_brand", 7, 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("ticker"), sector_id(fund).alias("sector_id")).distinct()


SPAN = 12
_Q = repr(1 - 2 / (SPAN + 1))
_UP = "OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)"


@query("exponential_means", BRANDS + f""", i AS (SELECT ticker, date, close, (row_number() {OVER})::DOUBLE AS i FROM p), h AS (SELECT *, avg(close) FILTER (i <= {SPAN}) OVER (PARTITION BY ticker) AS head FROM i)
SELECT ticker, CAST(date AS VARCHAR) AS date, round(sum(close * pow({_Q}, -i)) {_UP} / sum(pow({_Q}, -i)) {_UP}, 5) AS adjusted, round(CASE WHEN i >= {SPAN} THEN pow({_Q}, i - {SPAN}) * head + coalesce((1 - {_Q}) * pow({_Q}, i) * sum(CASE WHEN i > {SPAN} THEN close * pow({_Q}, -i) END) {_UP}, 0) END, 5) AS seeded FROM h""")
def exponential_means(spark, sf_dir):
    """Means with weights that add up to one, and those that start from a plain mean."""
    df = exponential_mean(bars(spark, sf_dir).select("ticker", "date", "close"), "ticker", "date", {"adjusted": ("close", SPAN, 1)}, adjust=True)
    df = exponential_mean(df, "ticker", "date", {"seeded": ("close", SPAN, 1)}, seeded=True)
    return df.select("ticker", as_text(), F.round("adjusted", 5).alias("adjusted"), F.round("seeded", 5).alias("seeded"))


FUNDS = {"pe": (30.0, 0.0), "pb": (8.0, -4.0), "dividend_yield": (12.0, -6.0), "roe": (100.0, -150.0), "beta": (3.0, -4.0)}


@query("fundamentals_block", BRANDS + ", o AS (SELECT 'Brand#' || CAST(o_custkey % 25 + 1 AS VARCHAR) AS ticker, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) / 99991 AS eps FROM orders GROUP BY ALL), a AS (SELECT p.ticker, p.date, eps FROM p ASOF LEFT JOIN o ON p.ticker = o.ticker AND p.date >= o.date) SELECT ticker, CAST(date AS VARCHAR) AS date, "
       + ", ".join(f"round(lag(CASE WHEN eps IS NOT NULL THEN greatest({adapters.BOUNDS[c][0]}::DOUBLE, least({adapters.BOUNDS[c][1]}::DOUBLE, eps * {k} + {d})) END) {OVER}, 6) + 0.0::DOUBLE AS fund_{c}" for c, (k, d) in FUNDS.items()) + " FROM a")
def fundamentals_block(spark, sf_dir):
    """Days of orders as documents of fundamentals, some beyond their bounds."""
    docs = reports_of(spark, sf_dir).select("ticker", "date", *[(F.col("eps") * k + d).alias(c) for c, (k, d) in FUNDS.items()])
    df = adapters.fundamental_features(bars(spark, sf_dir).select("ticker", "date"), docs)
    return df.select("ticker", as_text(), *r6(*[f"fund_{c}" for c in FUNDS]))


@query("triggered_alerts", WATCH + """, a AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, 'Brand#' || (1 + o_custkey % 5) || (1 + o_orderkey % 6) AS ticker, o_orderkey % 5 AS t, o_custkey % 5 - 2 AS n FROM orders), m AS (SELECT *, avg(volume) OVER (PARTITION BY date) AS mean FROM w)
SELECT o_orderkey, CASE WHEN m.ticker IS NULL THEN o_orderkey % 2 = 0 ELSE coalesce(CASE t WHEN 0 THEN close > 1500 WHEN 1 THEN close < 1200 WHEN 2 THEN volume > 1.5 * mean WHEN 3 THEN n - 0.5 > -1 AND n - 0.5 <= 1 END, false) END AS triggered FROM a LEFT JOIN m ON a.date = m.date AND a.ticker = m.ticker""")
def triggered_alerts(spark, sf_dir):
    """Orders as alerts on a brand that may not be listed on the day; reports come twelve hours before or after a midnight."""
    i, c, day = F.col("o_orderkey"), F.col("o_custkey"), F.to_date("o_orderdate")
    moment = F.date_format(F.date_add(day, (c % 5 - 2).cast("int")).cast("timestamp") - F.make_dt_interval(hours=F.lit(12)), "yyyy-MM-dd HH:mm:ss")
    types = F.element_at(F.array(*[F.lit(x) for x in ("price_above", "price_below", "volume_spike", "earnings", "other")]), (i % 5 + 1).cast("int"))
    alerts = table(spark, sf_dir, "orders").select("o_orderkey", day.alias("date"), F.concat(F.lit("Brand#"), 1 + c % 5, 1 + i % 6).alias("symbol"), types.alias("type"),
                                                    F.when(i % 5 == 0, "1500").when(i % 5 == 1, "1200").when(i % 5 == 3, moment).alias("value"), (i % 2 == 0).alias("triggered"))
    stocks = watched(spark, sf_dir).select("date", F.col("ticker").alias("symbol"), F.col("close").alias("price"), "volume")
    return reports.triggered(alerts, stocks, ["date"], F.col("date").cast("timestamp")).select("o_orderkey", "triggered")


@query("variant_errors")
def variant_errors(spark, sf_dir):
    """The price block with and without the market's part, each a model of two horizons, on the same held-out rows."""
    b = bars(spark, sf_dir).persist()  # a row a name and day; sales are read once
    df = prices.against_market(prices.candle(prices.rsi(prices.trend(prices.volume(prices.returns(b))))), market(b))
    df = modelling.split_in_time(df, 5)
    for w, n in (("next_day", 1), ("7_day", 5)):
        df = evaluation.realised(df, n).withColumnRenamed("realised", w)
    df = df.persist()
    own = ["volatility_20d", "rsi", "price_vs_sma20", "momentum_5d", "volume_ratio", "clv"]
    out = modelling.compare_variants(df.where("log_return_1d IS NOT NULL"), {"next_day": "next_day", "7_day": "7_day"}, {"with_market": [*own, "rel_strength_spy", "spy_vol_20d"], "without_market": own})
    return out.select("window", "variant", "n", *r6("accuracy", "mae", "rmse"))
