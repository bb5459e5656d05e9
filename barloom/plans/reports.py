"""Queries of evaluation, ranking, news, reports, fundamentals and streams on the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions import columns, text
from barloom.functions.columns import clip, gaussian_cdf, ratio, ticker_id
from barloom.functions.windows import rolling
from barloom.operators import evaluation, fundamentals, modelling, news, portfolio, prices, reports
from barloom.plans.adapters import as_text, r6
from barloom.plans.market import BRANDS, OVER, RSI, over, rolled
from barloom.sources.tables import bars, market, table
from barloom.streaming import trades as live

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def predictions(spark, sf_dir) -> DataFrame:
    """Five-row momentum as the prediction of the return over the next five rows, by ticker and day."""
    df = evaluation.realised(prices.trend(bars(spark, sf_dir)), 5).where(F.col("realised").isNotNull() & (F.col("momentum_5d") != 0))
    return df.select("ticker", "date", (F.col("momentum_5d") / 10).alias("prediction"), "realised")


PRED = BRANDS + f", m AS (SELECT ticker, date, ({over('close', f'lag(close, 5) {OVER}')} - 1) / 10 AS prediction, ln(lead(close, 5) {OVER} / close) AS realised FROM p), e AS (SELECT * FROM m WHERE realised IS NOT NULL AND coalesce(prediction, 0) <> 0)"


@query("targets_market_neutral", BRANDS + f", i AS (SELECT date, avg(close) AS mc FROM p GROUP BY date), j AS (SELECT p.*, mc FROM p LEFT JOIN i USING (date)) SELECT ticker, CAST(date AS VARCHAR) AS date, round(ln(lead(close, 5) {OVER} / close) - ln(lead(mc, 5) {OVER} / mc), 6) AS target_5 FROM j")
def targets(spark, sf_dir):
    b = bars(spark, sf_dir)
    return evaluation.neutral_targets(b, market(b), 5).select("ticker", as_text(), *r6("target_5"))


@query("directional_accuracy", PRED + " SELECT ticker, count(*) AS n, round(avg(CASE WHEN sign(prediction) = sign(realised) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(abs(prediction - realised)), 6) AS mae, round(sqrt(avg((prediction - realised) * (prediction - realised))), 6) AS rmse FROM e GROUP BY ticker")
def directional_accuracy(spark, sf_dir):
    return evaluation.errors(predictions(spark, sf_dir), ["ticker"]).select("ticker", "n", *r6("accuracy", "mae", "rmse"))


@query("spearman", PRED + ", r AS (SELECT ticker, rank() OVER (PARTITION BY ticker ORDER BY prediction) + (count(*) OVER (PARTITION BY ticker, prediction) - 1) / 2.0 AS a, rank() OVER (PARTITION BY ticker ORDER BY realised) + (count(*) OVER (PARTITION BY ticker, realised) - 1) / 2.0 AS b FROM e) SELECT ticker, CASE WHEN count(*) >= 5 THEN round(corr(a, b), 6) END AS spearman FROM r GROUP BY ticker")
def spearman(spark, sf_dir):
    return evaluation.spearman(predictions(spark, sf_dir), ["ticker"]).select("ticker", *r6("spearman"))


@query("top_decile_return", PRED + ", r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY prediction DESC, date) AS r, count(*) OVER (PARTITION BY ticker) AS n FROM e) SELECT ticker, round(avg(realised), 6) AS top_mean, count(*) AS n FROM r WHERE r <= greatest(1, floor(n * 0.1)) GROUP BY ticker")
def top_decile(spark, sf_dir):
    return evaluation.top_share_mean(predictions(spark, sf_dir), ["ticker"], "prediction", "realised", "date").select("ticker", *r6("top_mean"), "n")


def probabilities(spark, sf_dir) -> DataFrame:
    """Labelled documents with a probability from their length."""
    d, y = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), table(spark, sf_dir, "labels")
    return d.join(y, "doc_id").select("doc_id", "source", ((F.col("n_chars") % 997) / 997).alias("p"), F.col("quality").cast("double").alias("y"))


PROB = "WITH e AS (SELECT d.doc_id, d.source, (d.n_chars % 997) / 997.0::DOUBLE AS p, quality::DOUBLE AS y FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


@query("brier", PROB + " SELECT source, round(avg((p - y) * (p - y)), 6) AS brier, count(*) AS n FROM e GROUP BY source")
def brier(spark, sf_dir):
    return evaluation.brier(probabilities(spark, sf_dir), ["source"], "p", "y").select("source", *r6("brier"), "n")


@query("calibration_buckets", PROB + " SELECT CAST(least(floor(p * 5), 4) AS INT) AS bin, count(*) AS n, round(avg(p), 6) AS predicted, round(avg(y), 6) AS observed FROM e GROUP BY 1")
def calibration(spark, sf_dir):
    return evaluation.calibration(probabilities(spark, sf_dir), "p", "y").select("bin", "n", *r6("predicted", "observed"))


@query("psi", """WITH b AS (SELECT value AS x FROM events WHERE event_id % 3 <> 0), r AS (SELECT value AS x FROM events WHERE event_id % 3 = 0), q AS (SELECT quantile_cont(x, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]) AS e FROM b),
u AS (SELECT x, 1 AS isb FROM b UNION ALL SELECT x, 0 FROM r), c AS (SELECT len(list_filter(list_slice(e, 2, 10), lambda v: v <= x)) AS bin, isb FROM u, q WHERE x >= e[1] AND x <= e[11]),
n AS (SELECT g.bin, count(*) FILTER (isb = 1) AS b, count(*) FILTER (isb = 0) AS r FROM (SELECT unnest(range(10)) AS bin) g LEFT JOIN c ON g.bin = c.bin GROUP BY g.bin),
s AS (SELECT (b + 1e-6::DOUBLE) / (sum(b) OVER () + 1e-5::DOUBLE) AS pb, (r + 1e-6::DOUBLE) / (sum(r) OVER () + 1e-5::DOUBLE) AS pr FROM n) SELECT round(sum((pr - pb) * ln(pr / pb)), 6) AS psi FROM s""")
def psi(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("x"))
    return evaluation.stability(e.where("event_id % 3 <> 0"), e.where("event_id % 3 = 0"), "x").select(*r6("psi"))


@query("drift_split", PRED + """, z AS (SELECT max(date) AS e FROM e), s AS (SELECT e.*, least(0.99, greatest(0.01, 0.5 + prediction)) AS pr, date < z.e - 720 + 480 AS base, CASE WHEN sign(prediction) = sign(realised) THEN 1.0::DOUBLE ELSE 0 END AS hit FROM e, z WHERE date >= z.e - 750),
q AS (SELECT ticker, quantile_cont(prediction, [.1, .2, .3, .4, .5, .6, .7, .8, .9]) FILTER (base) AS edges, count(*) FILTER (base) AS nb, count(*) FILTER (NOT base) AS nr FROM s GROUP BY 1),
c AS (SELECT ticker, len(list_filter(edges, lambda v: v <= prediction)) AS bin, count(*) FILTER (base) AS b, count(*) FILTER (NOT base) AS r FROM s JOIN q USING (ticker) GROUP BY 1, 2),
n AS (SELECT q.ticker, nb, nr, g.bin, coalesce(b, 0) + 1e-6::DOUBLE AS b, coalesce(r, 0) + 1e-6::DOUBLE AS r FROM q, (SELECT unnest(range(10)) AS bin) g LEFT JOIN c ON c.ticker = q.ticker AND c.bin = g.bin),
i AS (SELECT ticker, CASE WHEN nb >= 10 AND nr >= 10 THEN sum((r / tr - b / tb) * ln(r / tr / (b / tb))) END AS psi FROM (SELECT *, sum(r) OVER (PARTITION BY ticker) AS tr, sum(b) OVER (PARTITION BY ticker) AS tb FROM n) GROUP BY ticker, nb, nr),
g AS (SELECT ticker, count(*) AS n, avg(hit) AS acc, CASE WHEN count(*) FILTER (base) > 5 THEN avg(hit) FILTER (base) END AS ba, CASE WHEN count(*) FILTER (NOT base) > 5 THEN avg(hit) FILTER (NOT base) END AS ra, avg(abs(prediction)) FILTER (base) AS bs, avg(abs(prediction)) FILTER (NOT base) AS rs,
 avg((pr - (realised > 0)::INT) ** 2) AS brier, CASE WHEN count(*) FILTER (base) > 5 THEN avg((pr - (realised > 0)::INT) ** 2) FILTER (base) END AS bb, CASE WHEN count(*) FILTER (NOT base) > 5 THEN avg((pr - (realised > 0)::INT) ** 2) FILTER (NOT base) END AS rb FROM s GROUP BY ticker)
SELECT ticker, n, round(psi, 6) AS psi, round(acc, 6) AS accuracy, round(ba, 6) AS base_accuracy, round(ra, 6) AS recent_accuracy, round(brier, 6) AS brier, round(bb, 6) AS base_brier, round(rb, 6) AS recent_brier, round(bs, 6) AS base_size, round(rs, 6) AS recent_size,
 CASE WHEN n < 10 THEN 'insufficient_data' WHEN psi > 0.25 OR ra < 0.48 OR rb > 1.3 * bb THEN 'WARNING' ELSE 'OK' END AS status,
 concat_ws(',', CASE WHEN psi > 0.25 THEN 'high psi' WHEN psi > 0.1 THEN 'moderate psi' END, CASE WHEN ra < 0.48 THEN 'accuracy' END, CASE WHEN rb > 1.3 * bb THEN 'brier' END) AS alerts FROM g LEFT JOIN i USING (ticker)""")
def drift(spark, sf_dir):
    df = predictions(spark, sf_dir).withColumn("p", clip(0.5 + F.col("prediction"), 0.01, 0.99))
    out = evaluation.drift(df, ["ticker"], "date", 720).withColumn("alerts", F.array_join("alerts", ","))
    return out.select("ticker", "n", *r6("psi", "accuracy", "base_accuracy", "recent_accuracy", "brier", "base_brier", "recent_brier", "base_size", "recent_size"), "status", "alerts")


@query("rolling_accuracy", PRED + f", h AS (SELECT *, CASE WHEN sign(prediction) = sign(realised) THEN 1.0 ELSE 0.0 END AS hit FROM e) SELECT ticker, CAST(date AS VARCHAR) AS date, round({rolled('avg({})', 'hit', 14, 5)}, 6) AS rolling_accuracy FROM h")
def rolling_accuracy(spark, sf_dir):
    return evaluation.rolling_accuracy(predictions(spark, sf_dir)).select("ticker", as_text(), *r6("rolling_accuracy"))


@query("drawdown_sharpe", BRANDS + f""", r AS (SELECT ticker, date, coalesce(ln(close / lag(close) {OVER}), 0) / 100 AS r FROM p), c AS (SELECT *, exp(sum(r) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)) AS c FROM r),
d AS (SELECT *, c / max(c) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS d FROM c) SELECT ticker, round(exp(sum(r)) - 1, 6) AS total_return, round(avg(r) / nullif(stddev_pop(r), 0) * sqrt(252), 6) AS sharpe, round(min(d), 6) AS max_drawdown, count(*) AS days FROM d GROUP BY ticker""")
def drawdown_sharpe(spark, sf_dir):
    df = prices.returns(bars(spark, sf_dir)).select("ticker", "date", (F.coalesce("log_return_1d", F.lit(0.0)) / 100).alias("r"))
    return evaluation.portfolio_measures(df, ["ticker"]).select("ticker", *r6("total_return", "sharpe", "max_drawdown"), "days")


@query("conformal_quantiles", PRED + " SELECT ticker, round(quantile_cont(abs(prediction - realised), 0.9), 6) AS q90, round(quantile_cont(abs(prediction - realised), 0.95), 6) AS q95 FROM e GROUP BY ticker")
def conformal(spark, sf_dir):
    return evaluation.residual_bands(predictions(spark, sf_dir), ["ticker"], "prediction", "realised").select("ticker", *r6("q90", "q95"))


@query("signal_threshold", PRED + " SELECT ticker, round(greatest(0.0005, least(0.02, avg(prediction) + 0.05 * stddev_pop(prediction))), 6) AS threshold FROM e GROUP BY ticker")
def signal_threshold(spark, sf_dir):
    return evaluation.signal_threshold(predictions(spark, sf_dir), ["ticker"], "prediction", 0.0005, 0.02).select("ticker", *r6("threshold"))


@query("gaussian_cdf", "WITH e AS (SELECT event_id, (value - 50) / 50 AS m FROM events), a AS (SELECT event_id, m, abs(m / sqrt(2.0)) AS z FROM e), t AS (SELECT *, 1 / (1 + 0.3275911::DOUBLE * z) AS t FROM a) SELECT event_id, round(greatest(0.15, least(0.85, 0.5 * (1 + sign(m) * (1 - t * (0.254829592::DOUBLE + t * (-0.284496736::DOUBLE + t * (1.421413741::DOUBLE + t * (-1.453152027::DOUBLE + t * 1.061405429::DOUBLE)))) * exp(-z * z))))), 6) AS p FROM t")
def cdf(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(gaussian_cdf((F.col("value") - 50) / 50, F.lit(1.0)), 6).alias("p"))


@query("ticker_ids", "SELECT DISTINCT p_brand AS ticker, CAST(('0x' || substr(sha256(p_brand), 1, 6)) AS BIGINT) AS ticker_id FROM part")
def ids(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("ticker")).distinct().select("ticker", ticker_id("ticker").alias("ticker_id"))


@query("walk_forward_labels", BRANDS + """, x AS (SELECT ticker, date, row_number() OVER (ORDER BY date, ticker) - 1 AS i, count(*) OVER () AS n FROM p), f AS (SELECT *, floor(n * (0.5::DOUBLE + 0.1::DOUBLE * fold)) AS e FROM x, (SELECT unnest(range(4)) AS fold)),
r AS (SELECT *, CASE WHEN i < e THEN 'train' WHEN i >= e + 10 AND i < e + 10 + floor(n * 0.1::DOUBLE) THEN 'validation' END AS role FROM f), v AS (SELECT fold, min(date) AS d FROM r WHERE role = 'validation' GROUP BY fold)
SELECT r.fold, role, count(*) AS n, CAST(min(date) AS VARCHAR) AS first, CAST(max(date) AS VARCHAR) AS last FROM r LEFT JOIN v USING (fold) WHERE role = 'validation' OR (role = 'train' AND date <= d - 10) GROUP BY r.fold, role""")
def walk_forward(spark, sf_dir):
    labelled = modelling.walk_forward(bars(spark, sf_dir).select("ticker", "date"), 5)
    return labelled.groupBy(F.col("fold").cast("long").alias("fold"), "role").agg(F.count("*").alias("n"), F.date_format(F.min("date"), "yyyy-MM-dd").alias("first"), F.date_format(F.max("date"), "yyyy-MM-dd").alias("last"))


@query("cross_section_signals", PRED + """, q AS (SELECT *, count(*) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY prediction DESC, ticker) AS rk FROM e), s AS (SELECT *, CAST(least(5, 1 + floor((rk - 1) / greatest(1.0::DOUBLE, n / 5.0::DOUBLE))) AS INT) AS qu, rk <= greatest(1, floor(n * 0.2)) AS top FROM q WHERE n >= 5)
SELECT ticker, CAST(date AS VARCHAR) AS date, CAST(rk AS INT) AS cross_sectional_rank, qu AS rank_quintile, CASE WHEN top THEN 'top' WHEN qu = 5 THEN 'bottom' ELSE 'middle' END AS rank_signal, CASE WHEN top THEN 0.6 ELSE 0.5 END::DOUBLE AS confidence, (top OR qu <> 5) AS trade FROM s""")
def cross_section(spark, sf_dir):
    df = predictions(spark, sf_dir).select("ticker", "date", F.col("prediction").alias("alpha"), F.lit(0.5).alias("confidence"), F.lit(True).alias("trade"))
    return modelling.cross_section(df).select("ticker", as_text(), "cross_sectional_rank", "rank_quintile", "rank_signal", *r6("confidence"), "trade")


@query("recency_weights", PRED + " SELECT ticker, CAST(date AS VARCHAR) AS date, round(exp(-0.4::DOUBLE * (1 - coalesce((row_number() OVER w - 1) / nullif(count(*) OVER (PARTITION BY ticker) - 1, 0)::DOUBLE, 1))), 6) AS weight FROM e WINDOW w AS (PARTITION BY ticker ORDER BY date)")
def recency(spark, sf_dir):
    w = W.partitionBy("ticker")
    return predictions(spark, sf_dir).select("ticker", as_text(), F.round(modelling.recency_weight(F.row_number().over(w.orderBy("date")), F.count("*").over(w)), 6).alias("weight"))


@query("batch_confidence", PRED + """, g AS (SELECT ticker, avg(CASE WHEN sign(prediction) = sign(realised) THEN 1.0::DOUBLE ELSE 0 END) AS hit, corr(prediction, realised) AS c FROM e GROUP BY ticker),
h AS (SELECT *, greatest(0, least(1, (hit - 0.5) / 0.1)) AS h, CASE WHEN c IS NOT NULL THEN greatest(0, least(1, c / 0.2)) END AS c2, CASE WHEN c IS NOT NULL THEN greatest(0, least(1, c / 0.1)) END AS c1 FROM g)
SELECT ticker, round(least((0.05 + 0.6 * (0.4 * h + 0.6 * c2)) * (0.85 + 0.4 * least(1.0, abs(hit - 0.5) / 0.15)), 0.65), 6) AS confidence, round(greatest(0.15, 0.6 * greatest(h, c1) + 0.4 * least(h, c1)), 6) AS shrinkage FROM h WHERE c IS NOT NULL""")
def batch_confidence(spark, sf_dir):
    g = predictions(spark, sf_dir).groupBy("ticker").agg(F.avg(F.when(F.signum("prediction") == F.signum("realised"), 1.0).otherwise(0.0)).alias("hit"), F.corr("prediction", "realised").alias("c")).where(F.col("c").isNotNull())
    return g.select("ticker", F.round(modelling.batch_confidence(F.col("hit"), F.col("c"), F.col("hit")), 6).alias("confidence"), F.round(modelling.shrinkage(F.col("hit"), F.col("c")), 6).alias("shrinkage"))


@query("best_window", """SELECT user_id, arg_max(w, struct_pack(a := trade, b := r, c := w)) AS best_window FROM (SELECT user_id, event_type AS w, avg(value) > 50 AS trade, max(value) AS r FROM events GROUP BY 1, 2) GROUP BY 1""")
def best_window(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("window")).agg(columns.mean_above("value", 50).alias("trade"), F.max("value").alias("normalized_return"))
    return modelling.best_window(e, ["user_id"])


def momentum_signals(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Closes, and the signals of momentum."""
    signals = predictions(spark, sf_dir).select(F.lit("momentum").alias("strategy"), "ticker", "date", "prediction")
    return bars(spark, sf_dir).select("ticker", "date", "close"), signals


HOLD, SLOTS = 5, 10
#: Days of the simulation, numbered; the last close up to each of them; picks and where they would be closed.
SIMULATED = PRED + """, n AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS r, count(*) OVER () AS c FROM (SELECT DISTINCT date FROM p)), days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM n WHERE r >= floor(c * 0.8)),
mk AS (SELECT t.ticker, t.i, q.close FROM (SELECT ticker, i, date FROM (SELECT DISTINCT ticker FROM p), days) t ASOF JOIN (SELECT ticker, date, close FROM p WHERE close > 0) q ON q.ticker = t.ticker AND q.date <= t.date),
k AS (SELECT *, count(*) OVER d AS n, row_number() OVER (PARTITION BY date ORDER BY prediction DESC, ticker) AS place FROM e WINDOW d AS (PARTITION BY date)),
c AS (SELECT k.ticker, days.i, place, p.close AS entry FROM k JOIN days USING (date) JOIN p ON p.ticker = k.ticker AND p.date = k.date WHERE place <= 20 AND prediction > 0),
x AS (SELECT c.ticker, c.i, place, entry, min(mk.i - c.i) FILTER (ln(mk.close / entry) <= -0.05 OR mk.i - c.i >= 5) AS k FROM c LEFT JOIN mk ON mk.ticker = c.ticker AND mk.i BETWEEN c.i + 1 AND c.i + 5 GROUP BY ALL)"""


@query("portfolio_exits", SIMULATED + """ SELECT x.ticker, CAST(a.date AS VARCHAR) AS entry_date, CAST(b.date AS VARCHAR) AS exit_date, CAST(k AS INT) AS bars, k IS NOT NULL AS closed, round(ln(mk.close / entry), 6) + 0.0::DOUBLE AS return
FROM x JOIN days a ON a.i = x.i LEFT JOIN days b ON b.i = x.i + k LEFT JOIN mk ON mk.ticker = x.ticker AND mk.i = x.i + k""")
def portfolio_exits(spark, sf_dir):
    """Where each pick would be closed: the part of the simulation that needs no order of days."""
    closes, signals = momentum_signals(spark, sf_dir)
    days = portfolio.trading_days(closes)
    day = lambda name: days.select(F.date_format("date", "yyyy-MM-dd").alias(name), F.col("i").alias(f"_{name}"))
    found = portfolio.exits(closes, signals, HOLD, SLOTS).withColumn("_exit_date", F.col("i") + F.col("k")).withColumn("_entry_date", F.col("i"))
    found = found.join(day("entry_date"), "_entry_date").join(day("exit_date"), "_exit_date", "left")
    return found.select("ticker", "entry_date", "exit_date", F.col("k").alias("bars"), "closed", F.round(F.ln(F.col("exit_price") / F.col("entry_price")), 6).alias("return"))


def simulated(spark, sf_dir) -> DataFrame:
    closes, signals = momentum_signals(spark, sf_dir)
    return portfolio.trades(closes, portfolio.positions(closes, signals, HOLD, SLOTS), market(bars(spark, sf_dir)))


@query("portfolio_simulation")
def simulation(spark, sf_dir):
    return simulated(spark, sf_dir).withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("entry_date", "exit_date")})


@query("trade_stats")
def trade_stats(spark, sf_dir):
    return evaluation.trade_stats(simulated(spark, sf_dir), ["strategy"])


@query("portfolio_returns")
def portfolio_returns(spark, sf_dir):
    closes, signals = momentum_signals(spark, sf_dir)
    daily = portfolio.daily_returns(closes, portfolio.positions(closes, signals, HOLD, SLOTS), market(bars(spark, sf_dir)))
    return evaluation.portfolio_measures(daily, ["strategy"])


@query("gbt_importance")
def gbt(spark, sf_dir):
    """Share of gain of each feature of boosted trees on the price block."""
    b = bars(spark, sf_dir)
    names = ["volatility_20d", "rsi", "price_vs_sma20", "momentum_5d", "volume_ratio", "clv"]
    df = evaluation.realised(prices.candle(prices.rsi(prices.trend(prices.volume(prices.returns(b))))), 5).where("realised is not null and log_return_1d is not null").select(*names, "realised")
    model = modelling.boosted_trees(df, names, "realised", rounds=5, depth=3)
    return spark.createDataFrame(modelling.importances(model, names), "feature string, gain double")


def articles(spark, sf_dir) -> DataFrame:
    """Documents as articles: a digest of the whole text as URL, so that copies repeat, and the first line as title."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2("text", 256).alias("url"), F.element_at(F.split("text", "\n"), 1).alias("title"), F.timestamp_seconds(F.lit(1700000000) + F.col("doc_id") * 60).alias("published_at"), "source", F.col("lang").alias("provider"), F.col("n_chars"))


@query("news_union_dedupe_page", """WITH a AS (SELECT doc_id, sha256(text) AS url, string_split(text, chr(10))[1] AS title, CASE lang WHEN 'en' THEN 0 ELSE 1 END AS pr FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY pr, doc_id DESC, title) AS n FROM a WHERE url IS NOT NULL)
SELECT doc_id, title FROM r WHERE n = 1 ORDER BY doc_id DESC LIMIT 20 OFFSET 20""")
def news_page(spark, sf_dir):
    a = articles(spark, sf_dir)
    union = news.union_articles([a.where("provider = 'en'"), a.where("provider IS DISTINCT FROM 'en'")])
    return news.page(union, [F.desc("published_at"), F.desc("doc_id")], 2, 20).select("doc_id", "title")


@query("category_map", """WITH t AS (SELECT unnest(['technology', 'tech', 'business', 'finance', 'healthcare', 'health', 'energy', 'automotive', 'auto', 'consumer', 'industrials', 'materials', 'realestate', 'utilities', 'communication', 'communications']) AS k,
 unnest(['Technology', 'Technology', 'Finance', 'Finance', 'Healthcare', 'Healthcare', 'Energy', 'Automotive', 'Automotive', 'Consumer', 'Industrials', 'Materials', 'Real Estate', 'Utilities', 'Communication', 'Communication']) AS v),
c AS (SELECT ['Technology', 'tech', 'Business', 'finance', 'HEALTHCARE', 'health', 'energy', 'automotive', 'Auto', 'consumer', 'industrials', 'materials', 'Real Estate', 'utilities', 'communication', 'Communications', 'other news'][p_partkey % 17 + 1] AS category FROM part)
SELECT category, coalesce(v, category) AS sector, count(*) AS n FROM c LEFT JOIN t ON lower(replace(category, ' ', '')) = k GROUP BY 1, 2""")
def category_map(spark, sf_dir):
    names = ("Technology", "tech", "Business", "finance", "HEALTHCARE", "health", "energy", "automotive", "Auto", "consumer", "industrials", "materials", "Real Estate", "utilities", "communication", "Communications", "other news")
    category = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("p_partkey") % len(names) + 1).cast("int"))
    return table(spark, sf_dir, "part").select(category.alias("category")).groupBy("category", news.sector_of(F.col("category")).alias("sector")).agg(F.count("*").alias("n"))


@query("search_symbols", "SELECT p_partkey, p_brand, p_name FROM part WHERE contains(upper(p_brand), 'RAND#12') OR contains(upper(p_name), 'RAND#12')")
def search(spark, sf_dir):
    return news.search_symbols(table(spark, sf_dir, "part"), "rand#12", "p_brand", "p_name").select("p_partkey", "p_brand", "p_name")


@query("page_append_dedupe", "WITH a AS (SELECT doc_id, sha256(text) AS url, string_split(text, chr(10))[1] AS title FROM documents WHERE text IS NOT NULL) SELECT doc_id FROM a WHERE doc_id % 2 = 1 AND url NOT IN (SELECT url FROM a WHERE doc_id % 2 = 0) AND title NOT IN (SELECT title FROM a WHERE doc_id % 2 = 0)")
def page_append(spark, sf_dir):
    a = articles(spark, sf_dir).where("url IS NOT NULL")
    return news.appended(a.where("doc_id % 2 = 0"), a.where("doc_id % 2 = 1")).select("doc_id")


@query("anti_join_missing", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def missing(spark, sf_dir):
    return news.without(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query("keyword_sentiment", r"""WITH h AS (SELECT doc_id, lower(text) AS t, len(regexp_split_to_array(trim(text, ' '), '\s+')) AS w FROM documents)
SELECT doc_id, round(greatest(-1, least(1, (len(list_filter(['growth', 'increase', 'profit', 'revenue', 'strong', 'positive', 'successful', 'improvement', 'gain', 'benefit', 'opportunity', 'optimistic', 'expansion', 'exceeded', 'outperform', 'robust'], lambda x: contains(t, x)))
 - len(list_filter(['loss', 'decline', 'decrease', 'risk', 'challenge', 'uncertainty', 'negative', 'concern', 'problem', 'difficult', 'weak', 'poor', 'disappointing', 'below', 'underperform', 'volatility'], lambda x: contains(t, x)))) / greatest(w / 100.0::DOUBLE, 1))), 6) AS score FROM h""")
def keyword_sentiment(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(text.keyword_score(F.col("text")), 6).alias("score"))


@query("html_text")
def html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.html_text(F.col("html")).alias("text"))


def items(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", F.col("event_type").alias("source"), (F.col("value") / 50 - 1).alias("score"), F.get_json_object("props", "$.k").cast("double").alias("volume"))


ITEMS = "WITH i AS (SELECT event_id, user_id, event_type AS source, value / 50 - 1 AS score, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume FROM events)"


@query("sentiment_distribution", ITEMS + ", g AS (SELECT source, CASE WHEN score > 0.1 THEN 'positive' WHEN score < -0.1 THEN 'negative' ELSE 'neutral' END AS class, sum(volume) AS volume FROM i GROUP BY 1, 2) SELECT source, class, volume, round(volume / sum(volume) OVER (PARTITION BY source) * 100, 6) AS percent FROM g")
def distribution(spark, sf_dir):
    return reports.sentiment_distribution(items(spark, sf_dir), ["source"]).select("source", "class", "volume", *r6("percent"))


@query("headline_extremes", ITEMS + ", s AS (SELECT *, CASE WHEN score > 0.3 THEN 'bullish' WHEN score < -0.3 THEN 'bearish' END AS side FROM i), r AS (SELECT *, row_number() OVER (PARTITION BY source, side ORDER BY abs(score) DESC, event_id) AS place FROM s WHERE side IS NOT NULL) SELECT source, side, CAST(place AS INT) AS place, event_id FROM r WHERE place <= 3")
def extremes(spark, sf_dir):
    return reports.extremes(items(spark, sf_dir), ["source"], "event_id").select("source", "side", "place", "event_id")


@query("source_breakdown", "SELECT source, count(*) AS n, round(avg(n_chars), 6) AS score FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 5")
def breakdown(spark, sf_dir):
    return reports.source_breakdown(table(spark, sf_dir, "documents").withColumn("score", F.col("n_chars")), "source").select("source", "n", *r6("score"))


@query("engagement_topk", ITEMS + " SELECT event_id, round(score + volume + 2 * (event_id % 7), 6) AS engagement FROM i WHERE score > 5 OR volume > 10 OR event_id % 7 > 5 ORDER BY score + volume + 2 * (event_id % 7) DESC, event_id LIMIT 5")
def engagement(spark, sf_dir):
    return reports.engagement(items(spark, sf_dir).withColumnsRenamed({"volume": "votes"}).withColumn("comments", F.col("event_id") % 7), "event_id").select("event_id", *r6("engagement"))


def quarterly(spark, sf_dir) -> DataFrame:
    """Quarters of customers' orders as reports of segments."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    met = o.join(c.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return met.groupBy(F.col("c_mktsegment").alias("segment"), F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("date")).agg(F.avg("o_totalprice").alias("actual"), F.percentile("o_totalprice", 0.5).alias("estimate"), F.count("*").alias("n"))


QUARTERS = "WITH q AS (SELECT c_mktsegment AS segment, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS date, avg(o_totalprice) AS actual, quantile_cont(o_totalprice, 0.5) AS estimate, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"


@query("surprise_pct", QUARTERS + " SELECT segment, CAST(date AS VARCHAR) AS date, round((actual - estimate) / abs(estimate) * 100, 6) AS surprise FROM q")
def surprise(spark, sf_dir):
    return quarterly(spark, sf_dir).select("segment", as_text(), F.round(reports.surprise_pct(F.col("actual"), F.col("estimate")), 6).alias("surprise"))


@query("growth_qoq", QUARTERS + ", r AS (SELECT *, row_number() OVER w AS p, lead(actual) OVER w AS b, count(*) OVER (PARTITION BY segment) AS k FROM q WINDOW w AS (PARTITION BY segment ORDER BY date DESC)) SELECT segment, round(avg((actual - b) / abs(b) * 100), 6) AS growth FROM r WHERE k >= 4 AND p <= 3 AND b <> 0 GROUP BY segment")
def growth(spark, sf_dir):
    return reports.mean_growth(quarterly(spark, sf_dir), "segment", "actual").select("segment", *r6("growth"))


@query("beat_rate", QUARTERS + ", r AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY date DESC) AS p FROM q) SELECT segment, round(count(*) FILTER (actual > estimate) / count(*)::DOUBLE * 100, 6) AS beat, round(count(*) FILTER (actual < estimate) / count(*)::DOUBLE * 100, 6) AS miss, round(count(*) FILTER (actual = estimate) / count(*)::DOUBLE * 100, 6) AS meet, count(*) AS n FROM r WHERE p <= 8 GROUP BY segment")
def beat(spark, sf_dir):
    return reports.beat_rates(quarterly(spark, sf_dir), "segment").select("segment", *r6("beat", "miss", "meet"), "n")


@query("dividend_growth", QUARTERS + ", r AS (SELECT *, row_number() OVER w AS p, lead(actual) OVER w AS b FROM q WINDOW w AS (PARTITION BY segment ORDER BY date DESC)) SELECT segment, round((sum(actual) FILTER (p <= 4) - sum(actual) FILTER (p > 4)) / sum(actual) FILTER (p > 4) * 100, 6) AS growth, round(avg(CASE WHEN p <= 3 AND b IS NOT NULL THEN CASE WHEN actual >= b THEN 1.0::DOUBLE ELSE 0 END END), 6) AS consistency FROM r WHERE p <= 8 GROUP BY segment HAVING count(*) = 8")
def payout(spark, sf_dir):
    return reports.payout_growth(quarterly(spark, sf_dir), "segment", "actual").select("segment", *r6("growth", "consistency"))


@query("dispersion", "WITH g AS (SELECT p_brand, min(p_retailprice) AS lo, max(p_retailprice) AS hi, avg(p_retailprice) AS m FROM part GROUP BY 1), s AS (SELECT p_brand, (hi - lo) / m * 100 AS s FROM g) SELECT p_brand, round(s, 6) AS spread, CASE WHEN s > 30 THEN 'wide' WHEN s < 15 THEN 'narrow' ELSE 'moderate' END AS band FROM s")
def dispersion(spark, sf_dir):
    g = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"), F.avg("p_retailprice").alias("m"))
    spread, band = reports.dispersion(F.col("lo"), F.col("hi"), F.col("m"))
    return g.select("p_brand", F.round(spread, 6).alias("spread"), band.alias("band"))


@query("completeness", "SELECT d.doc_id, round(CASE WHEN lang IS NOT NULL THEN 0.4 ELSE 0 END + CASE WHEN quality IS NOT NULL THEN 0.35 ELSE 0 END + CASE WHEN url IS NOT NULL THEN 0.25 ELSE 0 END, 6)::DOUBLE AS completeness FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN pages p ON d.doc_id = p.page_id")
def completeness(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left").join(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url"), "doc_id", "left")
    return d.select("doc_id", F.round(reports.completeness({"lang": 0.4, "quality": 0.35, "url": 0.25}), 6).alias("completeness"))


@query("coverage_status", "WITH g AS (SELECT event_type, count(*) AS rows, avg(CASE WHEN value > 60 THEN 1.0 ELSE 0.0 END) AS s FROM events GROUP BY 1) SELECT event_type, rows, round(s, 6) AS share, CASE WHEN s > 0.3 THEN 'OK' WHEN s > 0 THEN 'LOW' ELSE 'EMPTY' END AS status FROM g")
def coverage(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("x", F.when(F.col("value") > 60, F.col("value")))
    return evaluation.coverage(e, ["event_type"], "x").select("event_type", "rows", *r6("share"), "status")


@query("group_coverage", BRANDS + f", v AS (SELECT coalesce(open - lag(close) {OVER}, 0) AS gap, high - low AS span FROM p) SELECT round(avg(CASE WHEN gap <> 0 THEN 1.0 ELSE 0.0 END), 6) AS gap, round(avg(CASE WHEN gap <> 0 OR span <> 0 THEN 1.0 ELSE 0.0 END), 6) AS moves FROM v")
def group_coverage(spark, sf_dir):
    df = bars(spark, sf_dir).select((F.col("open") - F.lag("close").over(W.partitionBy("ticker").orderBy("date"))).alias("gap"), (F.col("high") - F.col("low")).alias("span"))
    return evaluation.group_coverage(df, {"gap": ["gap"], "moves": ["gap", "span"]}).select(*r6("gap", "moves"))


@query("fear_greed_score", BRANDS + """, i AS (SELECT date, avg(close) AS close, stddev_pop(close) AS vix FROM p GROUP BY date HAVING count(*) > 1), s AS (SELECT date, row_number() OVER (ORDER BY date DESC) - 1 AS k, CASE WHEN row_number() OVER (ORDER BY date) > 20 THEN greatest(0, least(100, 50 + 4 * (close / avg(close) OVER a * 100 - 100))) END AS m, CASE WHEN row_number() OVER (ORDER BY date) > 10 THEN greatest(0, least(100, 50 - 5 * (vix / avg(vix) OVER b * 100 - 100))) END AS v FROM i
WINDOW a AS (ORDER BY date ROWS 124 PRECEDING), b AS (ORDER BY date ROWS 49 PRECEDING)), t AS (SELECT CAST(k AS INT) AS k, date, CAST(floor(coalesce(0.65::DOUBLE * m + 0.35::DOUBLE * v, m, v) + 0.5) AS BIGINT) AS score FROM s WHERE k IN (0, 1, 5, 21, 252))
SELECT k AS "offset", CAST(date AS VARCHAR) AS date, score, CASE WHEN score <= 20 THEN 'Extreme Fear' WHEN score <= 40 THEN 'Fear' WHEN score <= 60 THEN 'Neutral' WHEN score <= 80 THEN 'Greed' WHEN score > 80 THEN 'Extreme Greed' END AS mood FROM t""")
def fear_greed(spark, sf_dir):
    days = bars(spark, sf_dir).groupBy("date").agg(F.avg("close").alias("close"), F.stddev_pop("close").alias("vix"), F.count("*").alias("n")).where("n > 1")
    return reports.fear_greed(days.select("date", "close"), days.select("date", "vix")).select("offset", as_text(), "score", "mood")


@query("technical_summary", RSI + f", t1 AS (SELECT ticker, date, rsi, close - open AS t, {rolled('avg({})', 'close', 20, 20)} AS a, {rolled('avg({})', 'close', 50, 50)} AS b FROM i), t2 AS (SELECT ticker, date, CASE WHEN rsi < 30 THEN 2 WHEN rsi < 40 THEN 1 ELSE 0 END + CASE WHEN t > 0 THEN 2 ELSE 0 END + CASE WHEN a > b THEN 1 ELSE 0 END AS up, CASE WHEN rsi > 70 THEN 2 WHEN rsi > 60 THEN 1 ELSE 0 END + CASE WHEN t < 0 THEN 2 ELSE 0 END + CASE WHEN a <= b THEN 1 ELSE 0 END AS down FROM t1), t3 AS (SELECT ticker, date, coalesce(100.0::DOUBLE * up / nullif(up + down, 0), 50) AS x FROM t2) SELECT ticker, CAST(date AS VARCHAR) AS date, CASE WHEN x >= 70 THEN 'Strong Buy' WHEN x >= 55 THEN 'Buy' WHEN x >= 45 THEN 'Neutral' WHEN x >= 30 THEN 'Sell' ELSE 'Strong Sell' END AS summary FROM t3")
def technical_summary(spark, sf_dir):
    df = prices.rsi(bars(spark, sf_dir)).withColumns({"_a": rolling(F.avg, "close", 20, 20), "_b": rolling(F.avg, "close", 50, 50)})
    return df.select("ticker", as_text(), reports.technical_summary(F.col("rsi"), F.col("close") - F.col("open"), F.col("_a"), F.col("_b")).alias("summary"))


@query("trading_sessions", """WITH l AS (SELECT event_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS t FROM events), m AS (SELECT event_id, t, hour(t) * 60 + minute(t) AS m FROM l) SELECT event_id, CASE WHEN isodow(t) >= 6 THEN 'closed' WHEN m >= 240 AND m < 570 THEN 'pre' WHEN m >= 570 AND m < 960 THEN 'regular' WHEN m >= 960 AND m < 1200 THEN 'after' ELSE 'closed' END AS session FROM m""")
def trading_sessions(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", reports.session_of(F.col("ts").cast("timestamp")).alias("session"))


WATCH = BRANDS + f", w AS (SELECT ticker, date, close, volume, coalesce(close - lag(close) {OVER}, 0) AS change FROM p)"


def watched(spark, sf_dir) -> DataFrame:
    change = F.col("close") - F.lag("close").over(W.partitionBy("ticker").orderBy("date"))
    return bars(spark, sf_dir).withColumn("change", F.coalesce(change, F.lit(0.0)))


@query("watchlist_summary", WATCH + " SELECT CAST(date AS VARCHAR) AS date, arg_max(ticker, struct_pack(a := change, b := ticker)) AS best, arg_min(ticker, struct_pack(a := change, b := ticker)) AS worst, sum(volume) AS volume, count(*) FILTER (volume > 0) AS active, count(*) FILTER (change > 0) AS up, count(*) FILTER (change < 0) AS down FROM w GROUP BY date")
def watch_summary(spark, sf_dir):
    return reports.watch_summary(watched(spark, sf_dir), ["date"]).select(as_text(), "best", "worst", "volume", "active", "up", "down")


@query("watchlist_alerts", WATCH + " SELECT ticker, CAST(date AS VARCHAR) AS date, CASE WHEN close >= 1800 THEN 'above' WHEN close <= 950 THEN 'below' END AS price_alert, volume > 1.5 * avg(volume) OVER (PARTITION BY date) AS volume_alert FROM w")
def watch_alerts(spark, sf_dir):
    return reports.watch_alerts(watched(spark, sf_dir), ["date"], 1800, 950).select("ticker", as_text(), "price_alert", "volume_alert")


def statements(spark, sf_dir) -> DataFrame:
    """Nations as companies: sums of their orders as lines of an income statement, by priority as segments of three in four."""
    o, c, n = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    met = o.join(c.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey")), "o_custkey").join(n.select("n_nationkey", F.col("n_name").alias("symbol")), "n_nationkey")
    part = lambda k: F.sum(F.when(F.col("o_orderkey") % 10 < k, F.col("o_totalprice")))
    key = F.col("n_nationkey")
    lines = met.groupBy("symbol", "n_nationkey").agg(F.sum("o_totalprice").alias("revenue"), part(6).alias("costOfRevenue"), part(2).alias("operatingExpenses"), part(1).alias("researchAndDevelopmentExpenses"), (part(1) / 2).alias("sellingGeneralAndAdministrativeExpenses"), part(3).alias("operatingIncome"), (part(1) / 3).alias("incomeTaxExpense"), (part(1) / 4).alias("netIncome"))
    lines = lines.withColumns({"totalOtherIncomeExpensesNet": (key % 3 - 1) * F.col("netIncome"), "incomeBeforeTax": F.when(key % 2 == 0, F.col("operatingExpenses") / 3), "grossProfit": F.lit(None).cast("double")})
    each = met.where((key % 4 != 0) & (F.col("o_orderpriority") < "5")).groupBy("symbol", F.concat("o_orderpriority", F.lit(" Segment")).alias("k")).agg(F.sum("o_totalprice").alias("v"))
    return lines.join(each.groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("segments")), "symbol", "left").drop("n_nationkey")


FLOWS = """WITH j AS (SELECT n_name AS symbol, n_nationkey AS k, o_orderkey % 10 AS d, o_totalprice AS v, o_orderpriority AS pr FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
s AS (SELECT symbol, k, sum(v) AS rev, coalesce(sum(v) FILTER (d < 6), 0) AS c6, coalesce(sum(v) FILTER (d < 2), 0) AS opex, coalesce(sum(v) FILTER (d < 1), 0) AS c1, coalesce(sum(v) FILTER (d < 3), 0) AS c3 FROM j GROUP BY ALL),
g AS (SELECT *, CASE WHEN c6 > 0 THEN greatest(0, rev - c6) ELSE 0 END AS gp, (k % 3 - 1) * c1 / 4 AS other, CASE WHEN k % 2 = 0 THEN opex / 3 ELSE 0 END AS ibt FROM s),
h AS (SELECT *, least(c3, greatest(0, gp - opex)) AS op FROM g), r AS (SELECT *, greatest(0, op - greatest(0, -other)) AS remaining FROM h),
seg AS (SELECT symbol, pr AS source, sum(v) AS value FROM j WHERE k % 4 <> 0 AND pr < '5' GROUP BY ALL),
l AS (SELECT symbol, source, 'Total Revenue' AS target, value FROM seg
 UNION ALL SELECT symbol, 'Other Revenue', 'Total Revenue', rev - t FROM s JOIN (SELECT symbol, sum(value) AS t FROM seg GROUP BY 1) USING (symbol) WHERE rev - t > rev * 0.05
 UNION ALL SELECT symbol, 'Sales/Operations', 'Total Revenue', rev FROM s WHERE symbol NOT IN (SELECT symbol FROM seg)
 UNION ALL SELECT symbol, 'Total Revenue', 'Cost of Revenue', c6 FROM r UNION ALL SELECT symbol, 'Total Revenue', 'Gross Profit', gp FROM r
 UNION ALL SELECT symbol, 'Gross Profit', 'Operating Expenses', opex FROM r UNION ALL SELECT symbol, 'Operating Expenses', 'R&D', c1 FROM r
 UNION ALL SELECT symbol, 'Operating Expenses', 'SG&A', c1 / 2 FROM r UNION ALL SELECT symbol, 'Operating Expenses', 'Other OpEx', opex - c1 * 1.5 FROM r
 UNION ALL SELECT symbol, 'Gross Profit', 'Operating Income', op FROM r UNION ALL SELECT symbol, 'Operating Income', 'Other/Interest Expense', -other FROM r
 UNION ALL SELECT symbol, 'Other/Interest Income', 'Income Before Tax', other FROM r
 UNION ALL SELECT symbol, 'Operating Income', 'Income Before Tax', CASE WHEN ibt > 0 THEN least(remaining, ibt) ELSE remaining END FROM r
 UNION ALL SELECT symbol, 'Income Before Tax', 'Taxes', c1 / 3 FROM r UNION ALL SELECT symbol, 'Income Before Tax', 'Net Income', CASE WHEN ibt > 0 THEN least(c1 / 4, ibt) ELSE c1 / 4 END FROM r),
f AS (SELECT * FROM l WHERE value > 0)"""


@query("sankey_links", FLOWS + " SELECT symbol, source, target, round(value, 4) AS value FROM f")
def sankey_links(spark, sf_dir):
    return fundamentals.flow_links(statements(spark, sf_dir)).withColumn("value", F.round("value", 4))


@query("sankey_nodes", FLOWS + """, a AS (SELECT symbol, target AS node, sum(value) AS v FROM f GROUP BY 1, 2), b AS (SELECT symbol, source AS node, sum(value) AS v FROM f GROUP BY 1, 2),
t AS (SELECT symbol, unnest(['Total Revenue', 'Cost of Revenue', 'Gross Profit', 'Operating Expenses', 'Operating Income', 'Income Before Tax', 'Net Income']) AS node, unnest([rev, NULL, gp, NULL, NULL, NULL, NULL]) AS told FROM r),
n AS (SELECT symbol, node FROM a UNION SELECT symbol, node FROM b UNION SELECT symbol, node FROM t)
SELECT symbol, node, CASE WHEN node IN ('Total Revenue', 'Other Revenue', 'Other/Interest Income') THEN 'revenue' WHEN node IN ('Gross Profit', 'Operating Income', 'Income Before Tax', 'Net Income') THEN 'profit' WHEN node = 'Taxes' THEN 'tax'
 WHEN node IN ('Cost of Revenue', 'Operating Expenses', 'R&D', 'SG&A', 'Other OpEx', 'Other/Interest Expense') THEN 'expense' ELSE 'segment' END AS kind, round(coalesce(told, a.v, b.v, 0), 4) AS value FROM n LEFT JOIN t USING (symbol, node) LEFT JOIN a USING (symbol, node) LEFT JOIN b USING (symbol, node)""")
def sankey_nodes(spark, sf_dir):
    return fundamentals.flow_nodes(statements(spark, sf_dir)).withColumn("value", F.round("value", 4))


def quarter_values(spark, sf_dir) -> DataFrame:
    q = quarterly(spark, sf_dir)
    return q.select("segment", F.year("date").alias("year"), F.quarter("date").alias("quarter"), F.col("n").cast("double").alias("val"))


@query("derived_q4", QUARTERS + ", v AS (SELECT segment, year(date) AS y, quarter(date) AS q, n::DOUBLE AS val FROM q), s AS (SELECT segment, y, sum(val) AS fy, sum(val) FILTER (q <= 3) AS s3, count(*) FILTER (q <= 3) AS k FROM v GROUP BY 1, 2) SELECT segment, CAST(y AS INT) AS year, 4 AS quarter, fy - s3 AS val FROM s WHERE k = 3 AND abs(fy - s3) <= 1.5 * abs(fy)")
def derived_q4(spark, sf_dir):
    v = quarter_values(spark, sf_dir)
    annual = v.groupBy("segment", "year").agg(F.sum("val").alias("val"))
    return fundamentals.derived_q4(v.where("quarter < 4"), annual, ["segment"])


@query("full_outer_quarters", QUARTERS + ", v AS (SELECT segment, year(date) AS y, quarter(date) AS q, n::DOUBLE AS val FROM q), a AS (SELECT * FROM v WHERE q <> 2), b AS (SELECT segment, y, q, val * 2 AS val FROM v WHERE q <> 3), j AS (SELECT coalesce(a.segment, b.segment) AS segment, coalesce(a.y, b.y) AS y, coalesce(a.q, b.q) AS q, a.val AS a, b.val AS b FROM a FULL JOIN b ON a.segment = b.segment AND a.y = b.y AND a.q = b.q), r AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY y DESC, q DESC) AS n FROM j) SELECT segment, CAST(y AS INT) AS year, CAST(q AS INT) AS quarter, a, b FROM r WHERE n <= 8")
def full_outer(spark, sf_dir):
    v = quarter_values(spark, sf_dir)
    return fundamentals.two_series(v.where("quarter <> 2"), v.where("quarter <> 3").withColumn("val", F.col("val") * 2), ["segment"]).select("segment", "year", "quarter", "a", "b")


@query("kv_json_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def kv(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


def event_trades(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("double").alias("volume"), "event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))


@query("event_tumbling", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type AS symbol, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling(spark, sf_dir):
    return live.tumbling(event_trades(spark, sf_dir), "1 hour").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "symbol", "n", F.round("total", 4).alias("total"))


@query("event_sliding", "WITH b AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE * k AS s, event_type, value FROM events, (SELECT unnest([0, 1]) AS k)) SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, event_type AS symbol, count(*) AS n, max(value) AS high FROM b GROUP BY 1, 2")
def sliding(spark, sf_dir):
    return live.sliding(event_trades(spark, sf_dir), "1 hour", "30 minutes").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "symbol", "n", "high")


@query("event_sessions", "WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, CAST(user_id AS VARCHAR) AS symbol, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, s")
def sessions(spark, sf_dir):
    t = event_trades(spark, sf_dir).withColumn("symbol", F.col("user_id").cast("string"))
    return live.sessions(t, "2 hours").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "symbol", "n", F.round("total", 4).alias("total"))


@query("running_trade_state", "SELECT event_type AS symbol, sum(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS volume, count(*) AS trades, arg_max(value, ts) AS last, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low FROM events GROUP BY 1")
def running(spark, sf_dir):
    return live.running_state(event_trades(spark, sf_dir)).drop("updated")


@query("rate_window", "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS recent FROM events")
def rate(spark, sf_dir):
    return live.recent_rate(event_trades(spark, sf_dir), 3600).select("event_id", "recent")


@query("price_alerts")
def price_alerts(spark, sf_dir):
    t = event_trades(spark, sf_dir).withColumn("symbol", F.col("user_id").cast("string"))
    return live.alerts(t)


@query("unread_count", "SELECT count(*) AS unread FROM events WHERE ts > TIMESTAMP '2024-01-20' - INTERVAL 1 HOUR AND ts <= TIMESTAMP '2024-01-20'")
def unread(spark, sf_dir):
    now = F.lit("2024-01-20").cast("timestamp")
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").where((ts > now - F.expr("interval 1 hour")) & (ts <= now)).agg(F.count("*").alias("unread"))


@query("number_formats", "SELECT o_orderkey, '$' || CASE WHEN o_totalprice * 1003 >= 1e9 THEN printf('%.2fB', o_totalprice * 1003 / 1e9) WHEN o_totalprice * 1003 >= 1e6 THEN printf('%.2fM', o_totalprice * 1003 / 1e6) ELSE printf('%.2f', o_totalprice * 1003) END AS shown FROM orders")
def formats(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", columns.human_money(F.col("o_totalprice") * 1003).alias("shown"))


@query("gross_margin", "WITH s AS (SELECT p_brand, sum(p_retailprice) AS r, sum(p_size) AS g FROM part GROUP BY 1) SELECT p_brand, round(g / r::DOUBLE * 100, 6) AS gross_margin FROM s")
def margin(spark, sf_dir):
    s = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sum("p_retailprice").alias("revenue"), F.sum("p_size").alias("grossProfit"))
    return fundamentals.gross_margin(s).select("p_brand", *r6("gross_margin"))


@query("insider_buy_sell", "WITH s AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS b, count(*) FILTER (event_type = 'error') AS s FROM events GROUP BY 1) SELECT user_id, round(b / nullif(s, 0)::DOUBLE, 6) AS ratio, CASE WHEN (s = 0 AND b > 0) OR b / nullif(s, 0) > 1.5 THEN 'buying' WHEN b / nullif(s, 0) < 0.67 THEN 'selling' ELSE 'balanced' END AS band FROM s")
def buy_sell(spark, sf_dir):
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("b"), F.count_if(F.col("event_type") == "error").alias("s"))
    x, band = reports.buy_sell(F.col("b"), F.col("s"))
    return s.select("user_id", F.round(x, 6).alias("ratio"), band.alias("band"))


@query("share_of_total", "SELECT p_brand, round(sum(p_retailprice) / sum(sum(p_retailprice)) OVER (), 9) AS share FROM part GROUP BY 1")
def share_of_total(spark, sf_dir):
    g = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sum("p_retailprice").alias("x"))
    return g.select("p_brand", F.round(ratio("x", F.sum("x").over(W.partitionBy())), 9).alias("share"))
