"""Labels of walk-forward folds, sample weights, confidence, ranking, and boosted trees with Spark's own library."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.columns import clip, fill, gaussian_cdf, ratio
from barloom.functions.windows import quintile

FOLDS = 4


def walk_forward(df: DataFrame, horizon: int, folds: int = FOLDS) -> DataFrame:
    """A row for each row and fold it belongs to: train, or validation after a gap; rows in order of date, then ticker.

    Fold f trains on the first 50 + 10 f percent and validates on the next tenth after max(7, horizon) + 3 rows.
    Training rows less than that many days before the first validation date go. The position of a row comes from
    counts by date, so that only dates are sorted in one task.
    """
    gap = max(7, horizon) + 3
    days = df.groupBy("date").agg(F.count("*").alias("_k")).withColumn("_before", fill(F.sum("_k").over(W.orderBy("date").rowsBetween(W.unboundedPreceding, -1)), 0)).drop("_k")
    placed = df.join(days, "date").withColumn("_i", F.col("_before") + F.row_number().over(W.partitionBy("date").orderBy("ticker")) - 1)
    total = df.agg(F.count("*").alias("_n"))
    fold = F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold")
    each = placed.crossJoin(F.broadcast(total)).select("*", fold).withColumn("_end", F.floor(F.col("_n") * (0.5 + 0.1 * F.col("fold"))))
    start = F.col("_end") + gap
    role = F.when(F.col("_i") < F.col("_end"), "train").when((F.col("_i") >= start) & (F.col("_i") < start + F.floor(F.col("_n") * 0.1)), "validation")
    each = each.withColumn("role", role).where("role is not null")
    first = each.where("role = 'validation'").groupBy("fold").agg(F.min("date").alias("_first"))
    kept = each.join(F.broadcast(first), "fold", "left").where((F.col("role") == "validation") | F.col("_first").isNull() | (F.col("date") <= F.date_sub("_first", gap)))
    return kept.drop("_before", "_i", "_n", "_end", "_first")


def recency_weight(rank: Column, n: Column) -> Column:
    """exp of an even scale from -0.4 for the oldest row to 0."""
    return F.exp(-0.4 * (1 - fill(ratio(rank - 1, n - 1), 1.0)))


def shrinkage(hit: Column, correlation: Column) -> Column:
    h, c = clip((hit - 0.5) / 0.1, 0, 1), clip(correlation / 0.1, 0, 1)
    return F.greatest(F.lit(0.15), 0.6 * F.greatest(h, c) + 0.4 * F.least(h, c))


def batch_confidence(hit: Column, correlation: Column, p: Column, cap: float = 0.65) -> Column:
    """The formula of batch predictions, without terms of size and agreement."""
    h, c = clip((hit - 0.5) / 0.1, 0, 1), clip(correlation / 0.2, 0, 1)
    base = 0.05 + 0.6 * (0.4 * h + 0.6 * c)
    return F.least(base * (0.85 + 0.4 * F.least(F.lit(1.0), F.abs(p - 0.5) / 0.15)), F.lit(cap))


def full_confidence(hit: Column, correlation: Column, p: Column, mean: Column, deviation: Column, agree: Column, coverage: Column, stale: Column, regime: Column | None = None, vol_ratio: Column | None = None, cap: float = 0.65) -> Column:
    """With terms for size against spread and agreement, bounded by .05 and ``cap``, then factors for coverage, staleness, a falling regime and growing volatility."""
    h, c = clip((hit - 0.5) / 0.1, 0, 1), clip(correlation / 0.2, 0, 1)
    base = (0.05 + 0.6 * (0.4 * h + 0.6 * c)) * (0.85 + 0.4 * F.least(F.lit(1.0), F.abs(p - 0.5) / 0.15))
    size = F.when(deviation > 1e-8, F.least(F.lit(1.0), F.abs(mean) / (1.5 * deviation))).otherwise(0.0)
    base = clip(base + 0.05 * size + F.when(agree, 0.08).otherwise(0.0), 0.05, cap)
    regime, vol_ratio = F.lit(0.0) if regime is None else fill(regime, 0.0), F.lit(1.0) if vol_ratio is None else fill(vol_ratio, 1.0)
    falling = F.when(regime < 0, F.greatest(F.lit(0.9), 1 + 0.1 * regime)).otherwise(1.0)
    growing = F.when(vol_ratio > 1.5, 1 - F.least(F.lit(0.1), (vol_ratio - 1.5) * 0.05)).otherwise(1.0)
    return base * fill(coverage, 1.0) * F.when(stale, 0.85).otherwise(1.0) * falling * growing


def price_band(price: Column, mean: Column, q90: Column, deviation: Column) -> tuple[Column, Column]:
    """Prices at the ends of the calibrated interval; without a positive quantile it is two deviations to either side."""
    width = F.when(q90 > 0, q90).otherwise(2 * deviation)
    return price * F.exp(mean - width), price * F.exp(mean + width)


def trade_filter(alpha: Column, threshold: Column, p_up: Column, confidence: Column, least: float) -> Column:
    return (alpha >= F.greatest(threshold, F.lit(1e-4))) & (p_up >= 0.5) & (F.abs(alpha) >= 0.001) & (confidence >= least)


def production_ready(rmse: Column, naive: Column, hit: Column, p: Column, n: Column, correlation: Column, least_hit: float = 0.48) -> Column:
    """Better than the naive forecast and than chance on enough held-out rows, and of the least correlation and hit rate."""
    return (rmse < naive) & (hit >= 0.5) & (p < 0.30) & (n >= 15) & (correlation >= 0.03) & (hit >= least_hit)


#: Rows that a ticker needs, and for long horizons; least rows of training and validation; days between rows that share no target.
LEAST_ROWS, LEAST_LONG, LONG = 50, 300, 21
LEAST_TRAIN, LEAST_HELD = 30, 10


def gap_of(horizon: int, purge: int = 7, embargo: int = 3) -> int:
    return max(purge, horizon) + embargo


def split_in_time(df: DataFrame, horizon: int, train: float = 0.7, held: float = 0.85) -> DataFrame:
    """Rows of each ticker in order of date -> ``part``: train, validation or test; NULL in the gaps between them.

    Training takes its share of the rows; validation starts a gap later and ends at its own share, but not before ``LEAST_HELD``
    rows; the test starts another gap later. Tickers with too few rows are left out, and those without validation rows.
    """
    w, gap = W.partitionBy("ticker"), gap_of(horizon)
    least = LEAST_LONG if horizon >= LONG else LEAST_ROWS
    df = df.withColumns({"_i": F.row_number().over(w.orderBy("date")) - 1, "_n": F.count("*").over(w)}).where(F.col("_n") >= least)
    df = df.withColumn("_a", F.greatest(F.lit(LEAST_TRAIN), F.floor(F.col("_n") * F.lit(train)))).withColumn("_s", F.col("_a") + gap)
    df = df.withColumn("_b", F.least(F.greatest(F.col("_s") + LEAST_HELD, F.floor(F.col("_n") * F.lit(held))), "_n")).where(F.col("_s") < F.col("_b"))
    part = F.when(F.col("_i") < F.col("_a"), "train").when((F.col("_i") >= F.col("_s")) & (F.col("_i") < F.col("_b")), "validation").when(F.col("_i") >= F.col("_b") + gap, "test")
    return df.withColumn("part", part).drop("_i", "_n", "_a", "_s", "_b")


def up_probability(mean: Column, deviation: Column) -> Column:
    return gaussian_cdf(mean, deviation)


def cross_section(df: DataFrame, alpha: str = "alpha", least: int = 5) -> DataFrame:
    """Rank of each day's names, quintile and signal; the top fifth gains confidence, the bottom fifth is not traded."""
    w = W.partitionBy("date")
    df = df.where(F.col(alpha).isNotNull()).withColumn("_n", F.count("*").over(w)).where(F.col("_n") >= least)
    df = df.withColumn("cross_sectional_rank", F.row_number().over(w.orderBy(F.desc(alpha), "ticker")))
    df = df.withColumn("rank_quintile", quintile(F.col("cross_sectional_rank"), F.col("_n")))
    top = F.col("cross_sectional_rank") <= F.greatest(F.lit(1), F.floor(F.col("_n") * 0.2))
    df = df.withColumn("rank_signal", F.when(top, "top").when(F.col("rank_quintile") == 5, "bottom").otherwise("middle"))
    return df.withColumns({"confidence": F.when(top, F.least(F.col("confidence") + 0.1, F.lit(0.95))).otherwise(F.col("confidence")), "trade": F.col("trade") & (F.col("rank_signal") != "bottom")}).drop("_n")


def best_window(df: DataFrame, keys: list[str]) -> DataFrame:
    """The window with the highest normalised return among those to trade, else among all."""
    return df.groupBy(*keys).agg(F.max_by("window", F.struct("trade", "normalized_return", F.col("window"))).alias("best_window"))


def told_apart(features: list[str]) -> list:
    """Stages before trees: flags tell missing values apart (NULL or NaN), which are set to the median; the vector has all values, then their flags."""
    from pyspark.ml.feature import Imputer, SQLTransformer, VectorAssembler

    filled, flags = [f"{c}_filled" for c in features], [f"{c}_missing" for c in features]
    told = ", ".join(f"CAST(`{c}` IS NULL OR isnan(`{c}`) AS DOUBLE) AS `{f}`" for c, f in zip(features, flags, strict=True))
    return [SQLTransformer(statement=f"SELECT *, {told} FROM __THIS__"), Imputer(inputCols=features, outputCols=filled, strategy="median"), VectorAssembler(inputCols=[*filled, *flags], outputCol="vector")]


def boosted_trees(train: DataFrame, features: list[str], label: str, weight: str | None = None, classify: bool = False, rounds: int = 20, depth: int = 5):
    """A fitted pipeline: missing values are told apart by flags and set to the median, then gradient-boosted trees."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.regression import GBTRegressor

    trees = (GBTClassifier if classify else GBTRegressor)(featuresCol="vector", labelCol=label, maxIter=rounds, maxDepth=depth, seed=7)
    if weight:
        trees = trees.setWeightCol(weight)
    return Pipeline(stages=[*told_apart(features), trees]).fit(train)


def importances(model, features: list[str]) -> list[tuple[str, float]]:
    """Features by share of gain, best first. What the flag of its missing values gains is a feature's own."""
    gains = model.stages[-1].featureImportances.toArray().reshape(-1, len(features)).sum(axis=0)
    return sorted(((c, float(g)) for c, g in zip(features, gains, strict=True)), key=lambda x: (-x[1], x[0]))


def compare_variants(df: DataFrame, labels: dict[str, str], variants: dict[str, list[str]], **options) -> DataFrame:
    """(window, variant, n, accuracy, mae, rmse): models of each window with the features of each variant, on the same held-out rows.

    df has ``part`` (see ``split_in_time``) and a label of each window. Rows without the label are left out of that window. A window without
    training or test rows has no result. Boosting ends where a window's validation rows ask for it; a window without them takes the rounds of
    ``boosted_trees``. Models are fitted side by side.
    """
    from functools import reduce

    from barloom.operators import trees
    from barloom.operators.evaluation import errors

    known = {window: df.where(F.col(label).isNotNull()) for window, label in labels.items()}
    used, held = list(dict.fromkeys(c for features in variants.values() for c in features)), F.col("part") == "validation"
    rows = {window: known[window].where("part IN ('train', 'validation')").select(held.alias("_held"), label, *used).persist() for window, label in labels.items()}
    counts = {window: {r["_held"]: r["count"] for r in r.groupBy("_held").count().collect()} for window, r in rows.items()}

    def fit(job: tuple[str, str]):
        window, name = job
        seen = rows[window].coalesce(1 + sum(counts[window].values()) // trees.TASK_ROWS)
        if True in counts[window]:
            return trees.fit_with_stop(seen, variants[name], labels[window], "_held", **options)
        return boosted_trees(seen, variants[name], labels[window], **options)

    jobs = [(window, name) for window in labels if False in counts[window] for name in variants]
    with ThreadPool(max(1, len(jobs))) as pool:
        models = pool.map(inheritable_thread_target(df.sparkSession)(fit), jobs)
    for r in rows.values():
        r.unpersist()
    out = []
    for (window, name), model in zip(jobs, models, strict=True):
        scored = model.transform(known[window].where("part = 'test'"))
        out.append(scored.select(F.lit(window).alias("window"), F.lit(name).alias("variant"), "prediction", F.col(labels[window]).alias("realised")))
    if not out:
        empty = df.limit(0).select(F.lit("").alias("window"), F.lit("").alias("variant"), F.lit(0.0).alias("prediction"), F.lit(0.0).alias("realised"))
        return errors(empty, ["window", "variant"])
    return errors(reduce(DataFrame.union, out), ["window", "variant"])
