"""Scores of single providers, gates of models, and small figures of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.columns import clip, fill, flag, ratio
from barloom.functions.windows import rolling, series
from barloom.operators.blends import present_mean
from barloom.sources.tables import latest


def vote_summary(sb: Column, b: Column, h: Column, s: Column, ss: Column, before: Column) -> dict[str, Column]:
    """Analyst votes -> score, confidence from ten votes, share of buyers, its change against ``before``, and the consensus; NULL without votes."""
    n = sb + b + h + s + ss
    score, share = ratio(sb + 0.5 * b - 0.5 * s - ss, n), ratio(sb + b, n)
    consensus = F.when(score > 0.2, "BUY").when(score < -0.2, "SELL").when(score.isNotNull(), "HOLD")
    return {"score": score, "confidence": F.when(n > 0, F.least(n / 10, F.lit(1.0))), "positive": share, "trend": F.when(n > 0, fill(share - before, 0.0)), "consensus": consensus}


def vote_shares(sb: Column, b: Column, h: Column, s: Column, ss: Column) -> tuple[Column, Column]:
    """Percentages of buyers and sellers."""
    n = sb + b + h + s + ss
    return ratio(sb + b, n) * 100, ratio(s + ss, n) * 100


def estimate_composite(eps: Column, rating: Column, target: Column, consensus: Column, price: Column) -> tuple[Column, Column]:
    """Score of estimates, a rating from 1 to 5, a mean and a consensus price target, each within 1, and the confidence.

    A rating or consensus of 0 is none. Without a price a target is there and says nothing.
    """
    upside = lambda x: F.when((price > 0) & (x > 0), clip(2 * (ratio(x, price) - 1), -1, 1)).otherwise(0.0)
    parts = [
        (clip((eps - 5) / 5, -1, 1), 0.3), (F.when(rating != 0, clip((rating - 3) / 2, -1, 1)), 0.3),
        (F.when(target.isNotNull(), upside(target)), 0.25), (F.when(consensus != 0, upside(consensus)), 0.15),
    ]
    score, present = present_mean(parts)
    return score, present / 4


def two_feed_composite(insider: Column, votes: Column) -> tuple[Column, Column]:
    """Insiders .4 and votes .6; a score of 0 is none."""
    score, present = present_mean([(F.when(insider != 0, insider), 0.4), (F.when(votes != 0, votes), 0.6)])
    return score, present / 2


def short_interest_trend(latest_: Column, previous: Column, n: Column) -> tuple[Column, Column]:
    """The relative change of short interest with its sign turned, within .5, and confidence from five reports."""
    return F.when(previous > 0, fill(clip(-ratio(latest_ - previous, previous), -0.5, 0.5), 0.0)).otherwise(0.0), F.least(n / 5, F.lit(1.0))


def short_interest_change(df: DataFrame, key: str, date: str, x: str) -> DataFrame:
    """Percentage between the two newest reports of each key, 0 from nothing, and an alert beyond 10."""
    w = W.partitionBy(key).orderBy(F.desc(date))
    two = df.withColumns({"_p": F.row_number().over(w), "_b": F.lead(x).over(w)}).where("_p = 1 AND _b IS NOT NULL")
    change = F.when(F.col("_b") > 0, ratio(F.col(x) - F.col("_b"), "_b") * 100).otherwise(0.0)
    return two.select(key, change.alias("change")).withColumn("alert", F.when(F.col("change") > 10, "bearish").when(F.col("change") < -10, "bullish"))


def event_volatility(high_today: Column, earnings_in: Column, dividend_in: Column, density: Column) -> Column:
    """Expected volatility from events of today, days to the next earnings and dividend (0: today), and events of the week; 2 at most."""
    earnings = F.when(earnings_in == 0, 1.2).when(earnings_in <= 2, 0.6).when(earnings_in <= 5, 0.3).otherwise(0.0)
    dividend = F.when(dividend_in == 0, 0.4).when(dividend_in <= 2, 0.2).otherwise(0.0)
    many = F.when(density > 5, 0.4).when(density > 3, 0.2).otherwise(0.0)
    return F.least(flag(high_today) * 1.0 + earnings + dividend + many, F.lit(2.0))


def event_sentiment(high_today: Column, density: Column, days_since_high: Column, volatility: Column) -> Column:
    down = F.when(high_today, 0.2).otherwise(0.0) + F.when(density > 5, 0.1).otherwise(0.0) + F.when(days_since_high <= 2, 0.05).otherwise(0.0)
    return F.when(volatility > 1.5, 0.1).otherwise(0.0) - down


def quality_gate(stored: Column, attempted: Column, failed: Column, fetched: Column, least: float = 0.8, most: float = 0.2) -> Column:
    """Enough predictions stored and few fetches failed; none attempted fails if anything was fetched, and nothing at all passes."""
    predicted = F.when(attempted > 0, ratio(stored, attempted) >= least).otherwise(fetched == 0)
    return predicted & F.when(fetched > 0, ratio(failed, fetched) <= most).otherwise(True)


def ensemble_weight(pooled: Column, own: Column, ready: Column) -> Column:
    """Weight of a ticker's own model against the pooled one, by their correlations on held-out rows: .2 to .9."""
    own, pooled = F.greatest(fill(own, 0.0), F.lit(0.0)), F.greatest(fill(pooled, 0.0), F.lit(0.0))
    weight = clip(own / (own + pooled + 1e-6), 0.2, 0.9)
    return F.when(ready, F.least(weight + 0.15, F.lit(0.9))).otherwise(weight)


def pooled_usable(correlation: Column) -> Column:
    """The kill switch: a pooled model that is anti-correlated on held-out rows isn't used."""
    return fill(correlation, 0.0) >= -0.08


def series_target(bars: DataFrame, horizon: int) -> DataFrame:
    """``y``: log return to ``horizon`` rows later."""
    return bars.withColumn("y", F.ln(ratio(F.lead("close", horizon).over(series()), "close")))


def baselines(df: DataFrame, keys: list[str], y: str, momentum: str, horizon: int) -> DataFrame:
    """Root mean square errors of no change, the last return, and the last target that doesn't overlap, ``horizon`` rows before (0 where none is)."""
    w = W.partitionBy(*keys).orderBy("date")
    df = df.withColumn("_last", fill(F.lag(y, max(1, horizon)).over(w), 0.0)).where(F.col(y).isNotNull())
    rms = lambda x: F.sqrt(F.avg(x * x))
    return df.groupBy(*keys).agg(rms(F.col(y)).alias("rmse_zero"), rms(F.col(y) - fill(momentum, 0.0)).alias("rmse_momentum"), rms(F.col(y) - F.col("_last")).alias("rmse_last"))


def out_of_sample_start(split: DataFrame, dates: DataFrame) -> DataFrame:
    """Rows with ``part`` -> the day after the last ticker's test begins, so that no model has seen what follows. Without any test, the last fifth of the dates."""
    firsts = split.where("part = 'test'").groupBy("ticker").agg(F.min("date").alias("first"))
    days = dates.select("date").distinct()
    placed = days.select("date", F.row_number().over(W.orderBy("date")).alias("_k"), F.count("*").over(W.partitionBy()).alias("_n"))
    fallback = placed.where(F.col("_k") - 1 == F.floor(F.col("_n") * F.lit(0.8))).agg(F.min("date").alias("_late"))
    return firsts.agg(F.date_add(F.max("first"), 1).alias("_start")).crossJoin(F.broadcast(fallback)).select(F.coalesce("_start", "_late").alias("start"))


def platt(df: DataFrame, score: str, label: str):
    """Sigmoid calibration of a raw score: a logistic regression of one column, without penalty."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    fit = LogisticRegression(featuresCol="raw", labelCol=label, regParam=0.0, tol=1e-10, maxIter=200, standardization=True)
    model = Pipeline(stages=[VectorAssembler(inputCols=[score], outputCol="raw"), fit]).fit(df).stages[-1]
    return float(model.coefficients[0]), float(model.intercept)


def sigmoid(x: Column, slope: float, intercept: float) -> Column:
    return 1 / (1 + F.exp(-(slope * x + intercept)))


def recent_confidence(df: DataFrame, order: list[Column], window: str, k: int = 100) -> DataFrame:
    """Mean confidence of each window over the newest k rows of all."""
    return df.orderBy(*order).limit(k).groupBy(window).agg(F.avg("confidence").alias("confidence"), F.count("*").alias("n"))


def strongest_contributions(df: DataFrame, keys: list[str], k: int = 8) -> DataFrame:
    """(keys, feature, contribution), several a feature -> the largest by size of each feature, and of these the k largest."""
    each = df.groupBy(*keys, "feature").agg(F.max_by("contribution", F.struct(F.abs("contribution"), F.col("contribution"))).alias("contribution"))
    return each.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(F.abs("contribution").desc(), "feature"))).where(F.col("place") <= k)


def kept_features(ranked: DataFrame, keys: list[str], protected: list[str], k: int) -> DataFrame:
    """Features with their place -> the protected ones and the first k, once each."""
    first = ranked.where(F.col("place") <= k).groupBy(*keys).agg(F.array_sort(F.collect_list("feature")).alias("_f"))
    return first.select(*keys, F.array_union(F.array(*[F.lit(p) for p in protected]), "_f").alias("features"))


def training_summary(df: DataFrame, window: str, value: str, win: Column) -> DataFrame:
    return df.groupBy(window).agg(F.median(value).alias("median"), F.count_if(win).alias("wins"), F.count("*").alias("n"))


def gauge(df: DataFrame, keys: list[str], score: str, band: float) -> DataFrame:
    """Positive less negative news as a share, from 0 (all negative) to 100."""
    balance = F.count_if(F.col(score) > band) - F.count_if(F.col(score) < -band)
    return df.groupBy(*keys).agg(((balance / F.count("*") + 1) * 50).alias("gauge"))


def recent_sides(df: DataFrame, key: str, order: list[Column], side: str, buy: str, sell: str, k: int = 10) -> DataFrame:
    """Purchases and sales among the k newest rows of each key."""
    newest = df.withColumn("_p", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("_p") <= k)
    return newest.groupBy(key).agg(F.count_if(F.col(side) == buy).alias("buys"), F.count_if(F.col(side) == sell).alias("sells"), F.count("*").alias("n"))


def price_summary(bars: DataFrame) -> DataFrame:
    """Of each ticker's last row: changes over 1, 5 and 21 rows and spread of 30 changes in percent, mean volume of 30 rows."""
    w = series()
    change = lambda n: (ratio("close", F.lag("close", n).over(w)) - 1) * 100
    df = bars.withColumns({"change_1d": change(1), "change_1w": change(5), "change_1m": change(21)})
    df = df.withColumns({"volume_30d": rolling(F.avg, "volume", 30, 30), "volatility_30d": rolling(F.stddev_samp, "change_1d", 30, 30)})
    return latest(df, "ticker", F.desc("date")).select("ticker", "close", "change_1d", "change_1w", "change_1m", "volume_30d", "volatility_30d")


def relevant(df: DataFrame, keys: list[str], match: str, tie: str, least: float = 70, k: int = 3) -> DataFrame:
    """The k best matches of each key above a limit."""
    w = W.partitionBy(*keys).orderBy(F.desc(match), tie)
    return df.where(F.col(match) > least).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def forum_stats(posts: DataFrame, by: str) -> DataFrame:
    """(score, up, down, comments) of posts by forum: number, means, and net votes as a share of all."""
    net = F.sum("up") - F.sum("down")
    return posts.groupBy(by).agg(F.count("*").alias("posts"), F.avg("score").alias("score"), F.avg("up").alias("up"), F.avg("comments").alias("comments"), (net / F.greatest(F.sum("up") + F.sum("down"), F.lit(1.0))).alias("engagement"))


def curve(long: DataFrame, short: DataFrame) -> DataFrame:
    """The newest value of two series (date, value), their difference, and whether the curve is inverted; one row each, so the join is of single rows."""
    newest = lambda df, name: df.where("value IS NOT NULL").agg(F.max_by("value", "date").alias(name)).withColumn("_k", F.lit(1))
    return newest(long, "long").join(newest(short, "short"), "_k").select("long", "short", (F.col("long") - F.col("short")).alias("spread"), (F.col("long") < F.col("short")).alias("inverted"))


def flow_header(links: DataFrame, keys: list[str], total: str, part: str, known_total: str, known_part: str) -> DataFrame:
    """Flows into ``total`` and from it into ``part``, each else as reported, and the margin."""
    value = F.col("value")
    sums = links.groupBy(*keys).agg(F.sum(F.when(F.col("target") == total, value)).alias("_t"), F.sum(F.when((F.col("source") == total) & (F.col("target") == part), value)).alias("_p"), F.max(known_total).alias("_kt"), F.max(known_part).alias("_kp"))
    filled = lambda a, b: F.coalesce(F.nullif(F.col(a).cast("double"), F.lit(0.0)), F.col(b).cast("double"), F.lit(0.0))
    out = sums.select(*keys, filled("_t", "_kt").alias("total"), filled("_p", "_kp").alias("part"))
    return out.withColumn("margin", F.when(F.col("total") > 0, ratio("part", "total")).otherwise(0.0))


#: Sessions of a trading day in minutes since midnight in New York; the last wraps around.
SEGMENTS = (("pre", 240, 570), ("regular", 570, 960), ("after", 960, 1200), ("overnight", 1200, 240))


def session_position(minute: Column) -> tuple[Column, Column]:
    """The session that a minute of the day is in, and how far into it, from 0 to 1."""
    name, share = F.lit(None).cast("string"), F.lit(None).cast("double")
    for label, start, end in SEGMENTS:
        inside = (minute >= start) & (minute < end) if start < end else (minute >= start) | (minute < end)
        name, share = F.when(inside, label).otherwise(name), F.when(inside, F.pmod(minute - start, F.lit(1440)) / ((end - start) % 1440)).otherwise(share)
    return name, share


def as_of_or_last(df: DataFrame, key: str, date: str, moment: Column) -> DataFrame:
    """The newest row of each key up to a moment, else its very last row."""
    return latest(df, key, [(F.col(date) <= moment).desc(), F.desc(date)])


def sliding(df: DataFrame, x: str, n: int) -> DataFrame:
    """The last n values of each row that has as many, in order: an input of sequence models."""
    return df.withColumn("values", F.collect_list(x).over(series().rowsBetween(-(n - 1), 0))).where(F.size("values") == n)


def blob_range(df: DataFrame, blob: str, start: str, end: str) -> DataFrame:
    """A JSON object of dates and values -> a row for each date between two, compared as text."""
    kept = F.map_filter(F.from_json(blob, "map<string,double>"), lambda k, v: k.between(start, end))
    return df.select(*[c for c in df.columns if c != blob], F.explode(kept).alias("date", "value"))
