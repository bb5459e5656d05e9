"""Weighted blends and scores of several sources.

Sources come in long form, a row each (ticker, date, source, score, volume, confidence), so that a new source is data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.columns import clip, fill, ratio

#: Weights of sources in the blended score, and in the blended confidence.
SCORE_WEIGHTS = {"rss_news": 0.22, "marketaux": 0.18, "reddit": 0.12, "finnhub": 0.10, "finnhub_insider": 0.10, "sec": 0.10, "fmp": 0.10, "finviz": 0.08}
CONFIDENCE_WEIGHTS = {"rss_news": 0.22, "marketaux": 0.15, "reddit": 0.10, "finnhub": 0.10, "sec": 0.10, "fmp": 0.08, "finviz": 0.05}
UNKNOWN_WEIGHT = 0.03
#: Sources whose volume counts articles, and those that don't count as sources.
ARTICLES = ("rss_news", "marketaux", "finviz")
NO_SOURCES = ("economic_event", "short_interest")


def weight_of(source: Column, weights: dict[str, float], unknown: float = 0.0) -> Column:
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return F.coalesce(F.element_at(table, source), F.lit(unknown))


def blended_score(long: DataFrame, keys: list[str], weights: dict[str, float] = SCORE_WEIGHTS) -> DataFrame:
    """Mean of bounded scores, weighted by source, confidence (0.01 at least) and ln(1 + volume).

    A missing confidence counts as 1 and a missing volume as 1; a source with neither score nor confidence is left out.
    No weight gives 0.
    """
    score, conf, volume = fill("score", 0.0), fill("confidence", 1.0), fill("volume", 1.0)
    w = weight_of(F.col("source"), weights) * F.greatest(conf, F.lit(0.01)) * F.log1p(F.greatest(volume, F.lit(0.0)))
    used = long.where((score != 0) | (conf != 0)).withColumns({"_w": w, "_x": clip(score, -1, 1)})
    return used.groupBy(*keys).agg(fill(ratio(F.sum(F.col("_x") * F.col("_w")), F.sum("_w")), 0.0).alias("blended"))


def blended_confidence(long: DataFrame, keys: list[str], weights: dict[str, float] = CONFIDENCE_WEIGHTS) -> DataFrame:
    """Mean confidence of the sources that have one, by weight; how many have one above zero; the volume of all and of articles."""
    w = weight_of(F.col("source"), weights, UNKNOWN_WEIGHT)
    volume = fill("volume", 0.0)
    told = F.col("confidence").isNotNull()
    sources = F.count_if((F.col("confidence") > 0) & ~F.col("source").isin(*NO_SOURCES))
    articles = F.sum(F.when(F.col("source").isin(*ARTICLES), volume).otherwise(0.0))
    mean = ratio(F.sum(F.when(told, F.col("confidence") * w)), F.sum(F.when(told, w)))
    return long.groupBy(*keys).agg(fill(mean, 0.0).alias("confidence"), sources.alias("sources"), F.sum(volume).alias("volume"), articles.alias("articles"))


def source_means(items: DataFrame, keys: list[str], full: float = 20) -> DataFrame:
    """Items with scores -> mean, number, and confidence that grows to 1 at ``full`` items."""
    return items.groupBy(*keys).agg(F.avg("score").alias("score"), F.count("*").alias("volume"), F.least(F.count("*") / full, F.lit(1.0)).alias("confidence"))


def engagement_mean(items: DataFrame, keys: list[str], full: float = 100) -> DataFrame:
    """Plain mean of scores that are scaled by votes up to ``full``."""
    return items.groupBy(*keys).agg(F.avg(F.col("score") * F.least(F.col("votes") / full, F.lit(1.0))).alias("score"), F.count("*").alias("volume"))


def composite(columns: list[str], composite: str = "composite", blended: str = "blended") -> Column:
    """The first that is there: composite, blended, the mean of the others, 0."""
    others = F.filter(F.array(*[F.col(c) for c in columns]), lambda x: x.isNotNull())
    mean = F.aggregate(others, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(others), F.lit(0))
    return F.coalesce(F.col(composite), F.col(blended), mean, F.lit(0.0))


#: Aggregates that are no sources of their own.
AGGREGATES = ("blended_sentiment", "composite_sentiment", "sentiment_confidence")


def sentiment_series(documents: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Documents of a name and day -> one a day, the last by ``order``: composite score and number of news.

    The score is ``composite_sentiment``, else ``blended_sentiment``, else the mean of the other columns that end in ``_sentiment``, else that of
    the map ``sources``, else 0. The number is ``news_count``, else the sum of the volumes of ``ARTICLES`` as far as they are there, else 1.
    Columns that a table lacks count as missing.
    """
    have = documents.columns
    number = lambda c: F.col(c).cast("double") if c in have else F.lit(None).cast("double")
    known = lambda a: F.filter(a, lambda x: x.isNotNull())
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / F.nullif(F.size(a), F.lit(0))
    array = lambda names: known(F.array(*[number(c) for c in names])) if names else F.array().cast("array<double>")
    own = array([c for c in have if c.endswith("_sentiment") and c not in AGGREGATES])
    nested = known(F.map_values("sources")) if "sources" in have else F.array().cast("array<double>")
    score = F.coalesce(number("composite_sentiment"), number("blended_sentiment"), mean(own), mean(nested), F.lit(0.0))
    volumes = array([f"{s}_volume" for s in ARTICLES])
    news = F.coalesce(number("news_count").cast("long"), F.when(F.size(volumes) > 0, F.aggregate(volumes, F.lit(0.0), lambda x, y: x + y)).cast("long"), F.lit(1))
    each = documents.select(*keys, F.col(order).alias("_order"), score.alias("composite_sentiment"), news.alias("news_count"))
    last = F.max_by(F.struct("composite_sentiment", "news_count"), F.struct("_order", "composite_sentiment", "news_count"))
    return each.groupBy(*keys).agg(last.alias("r")).select(*keys, "r.*")


def insider_sentiment(transactions: DataFrame, keys: list[str], buys: tuple[str, ...], sells: tuple[str, ...]) -> DataFrame:
    """Net over gross value, a purchase before a sale; confidence from five transactions."""
    value = F.abs("shares") * F.when(fill("price", 0.0) > 0, F.col("price")).otherwise(1.0)
    side = F.when(F.col("code").isin(*buys), 1).when(F.col("code").isin(*sells), -1).otherwise(0)
    known = transactions.withColumns({"_v": value, "_d": side}).where("_d <> 0")
    return known.groupBy(*keys).agg(fill(clip(ratio(F.sum(F.col("_v") * F.col("_d")), F.sum("_v")), -1, 1), 0.0).alias("score"), F.least(F.count("*") / 5, F.lit(1.0)).alias("confidence"))


def recommendation_score(sb: Column, b: Column, h: Column, s: Column, ss: Column, before: Column | None = None) -> tuple[Column, Column]:
    """Score of analyst votes, with half of its change against ``before`` within 0.2, and its confidence."""
    n = sb + b + h + s + ss
    raw = fill(ratio(2 * sb + b - s - 2 * ss, n), 0.0) / 2
    trend = F.lit(0.0) if before is None else fill(clip(0.5 * (raw - before), -0.2, 0.2), 0.0)
    agree = fill(ratio(F.greatest(sb + b, s + ss), n), 0.0)
    return clip(raw + trend, -1, 1), (F.least(n / 20, F.lit(1.0)) + agree) / 2


def present_mean(parts: list[tuple[Column, float]]) -> tuple[Column, Column]:
    """Weighted mean of the parts that are there, and the share of weight that is."""
    total = sum((F.when(x.isNotNull(), w).otherwise(0.0) for x, w in parts[1:]), F.when(parts[0][0].isNotNull(), parts[0][1]).otherwise(0.0))
    top = sum((fill(x * w, 0.0) for x, w in parts[1:]), fill(parts[0][0] * parts[0][1], 0.0))
    return fill(ratio(top, total), 0.0), total / sum(w for _, w in parts)


def short_interest_tier(pct: Column) -> Column:
    return F.when(pct >= 20, -0.8).when(pct >= 10, -0.5).when(pct >= 5, -0.2).when(pct >= 2, 0.2).when(pct.isNotNull(), 0.5)


#: Quality of forms.
FORM_QUALITY = {"10-K": 1.0, "10-Q": 0.9, "8-K": 0.7, "DEF 14A": 0.6, "SD": 0.4, "4": 0.3, "144": 0.2}
OTHER_FORM = 0.5


def filing_confidence(filings: DataFrame, keys: list[str], quality: dict[str, float] = FORM_QUALITY) -> DataFrame:
    """Filings (score, form, length) -> confidence from the number of those with a score, their share of all, agreement, form and length, and signal.

    Eight scores count fully, as do 1,000 characters and a mean of 0.3. Without a score the mean and the confidence's part of it are 0,
    and form and length are as good as half.
    """
    told = F.col("score").isNotNull()
    n, dev, mean = F.count("score"), fill(F.stddev_samp("score"), 0.0), fill(F.avg("score"), 0.0)
    of_form = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in quality.items() for x in kv]), F.col("form")), F.lit(OTHER_FORM))
    good = fill(F.avg(F.when(told, (of_form + F.least(fill("length", 0) / 1000, F.lit(1.0))) / 2)), OTHER_FORM)
    parts = 0.25 * F.least(n / 8, F.lit(1.0)) + 0.2 * n / F.count("*") + 0.25 * F.greatest(F.lit(0.0), 1 - dev / 0.5) + 0.2 * good + 0.1 * F.least(F.abs(mean) / 0.3, F.lit(1.0))
    return filings.groupBy(*keys).agg(clip(parts, 0, 1).alias("confidence"), mean.alias("score"))


def decayed_mean(comments: DataFrame, keys: list[str], days: Column) -> DataFrame:
    """Mean of scores weighted max(0.1, 1 - age / 7), population spread, and confidence from number and agreement."""
    w = F.greatest(F.lit(0.1), 1 - days / 7)
    dev = fill(F.stddev_pop("score"), 0.0)
    conf = F.least(F.lit(1.0), F.count("*") / 10 * (1 - F.least(F.lit(1.0), dev)))
    return comments.withColumn("_w", w).groupBy(*keys).agg(ratio(F.sum(F.col("score") * F.col("_w")), F.sum("_w")).alias("score"), dev.alias("deviation"), conf.alias("confidence"), F.count("*").alias("n"))


def health(df: DataFrame, score: str, key: str, symbol: str) -> DataFrame:
    """Missing, zero and other scores of each key, median, the 90 % value by rank, symbols. A key is one sort; without values it has no quantiles."""
    x = F.col(score)
    w = W.partitionBy(key)
    df = df.withColumns({"_place": F.row_number().over(w.orderBy(x.asc_nulls_last())), "_n": F.count(x).over(w)})
    return df.groupBy(key).agg(
        F.count_if(x.isNull()).alias("missing"), F.count_if(x == 0).alias("zero"), F.count_if(x != 0).alias("nonzero"), F.median(score).alias("median"),
        F.min(F.when(F.col("_place") == F.floor(F.col("_n") * 0.9) + 1, x)).alias("p90"), F.count_distinct(symbol).alias("symbols"),
    )
