"""Boosted trees: fits by fold that stop early, gains of features, and explanations of single predictions.

Explanations are path-dependent Shapley values of trees. A leaf gives its value to a row that follows all splits of its
path; a feature outside of a coalition follows a split by the share of training rows that did. So a leaf's game is a product
over the features of its path, and a feature's value in it is a sum over the sizes of coalitions, whose weights are the
coefficients of a polynomial. It depends on the row only by which of the path's features agree with it, so that each leaf has
a table of 2^m patterns, made once for a batch; rows look their pattern up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import takewhile
from math import factorial
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import SparkContext, inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.columns import ratio
from barloom.operators.modelling import recency_weight, told_apart

#: Features of a path up to which a leaf has a table of all patterns.
TABLE = 10
TOP = 15
#: How far the sum of contributions may be from the prediction.
TOLERANCE = 1e-4
#: Rounds without a lower error of the held-out rows that end the boosting.
PATIENCE = 50
#: Rows of a fold that one task takes.
TASK_ROWS = 50_000


@dataclass
class Tree:
    """Nodes of a tree by number, the root first. ``left`` is -1 at a leaf; rows go left where the value is at most the threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray
    weight: float


def exported(model) -> list[Tree]:
    """The trees of a fitted gradient-boosted or forest model of Spark, numeric splits only. Values are those of the margin."""
    out = []
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        nodes: list[list] = []
        stack = [(tree._call_java("rootNode"), -1, 0)]
        while stack:
            node, parent, side = stack.pop()
            if parent >= 0:
                nodes[parent][2 + side] = len(nodes)
            row = [-1, 0.0, -1, -1, node.prediction(), node.impurityStats().count(), 0.0]
            nodes.append(row)
            if node.subtreeDepth() > 0:
                split, at = node.split(), len(nodes) - 1
                row[0], row[1], row[6] = split.featureIndex(), split.threshold(), node.gain()
                stack += [(node.rightChild(), at, 1), (node.leftChild(), at, 0)]
        columns = list(zip(*nodes, strict=True))
        kinds = (np.int64, float, np.int64, np.int64, float, float, float)
        out.append(Tree(*[np.array(c, t) for c, t in zip(columns, kinds, strict=True)], float(weight)))
    return out


def bias(trees: list[Tree]) -> float:
    """Mean of the training rows' margins: what no feature explains."""
    return float(sum(t.weight * (t.value * t.cover)[t.left < 0].sum() / t.cover[0] for t in trees))


@dataclass
class Leaf:
    """A leaf's path: the features on it, the interval of each that leads here, the share of rows that go along at its splits, value times weight."""

    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: float


def leaves(trees: list[Tree]) -> list[Leaf]:
    out = []
    for t in trees:
        stack: list[tuple[int, dict[int, tuple[float, float, float]]]] = [(0, {})]
        while stack:
            n, path = stack.pop()
            if t.left[n] < 0:
                if path and t.value[n]:
                    low, high, share = np.array(list(path.values())).T
                    out.append(Leaf(np.array(list(path)), low, high, share, float(t.value[n] * t.weight)))
                continue
            f, x = int(t.feature[n]), float(t.threshold[n])
            low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
            for child, bounds in ((int(t.left[n]), (low, min(high, x))), (int(t.right[n]), (max(low, x), high))):
                stack.append((child, path | {f: (*bounds, share * t.cover[child] / t.cover[n])}))
    return out


def path_values(follows: np.ndarray, share: np.ndarray) -> np.ndarray:
    """(rows x features of a path) of whether a row agrees -> Shapley values of a leaf of value 1."""
    rows, m = follows.shape
    sizes = np.array([factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)])
    out = np.empty((rows, m))
    for i in range(m):
        terms = np.zeros((rows, m))  # coefficients, by size of coalition, of the product over the other features
        terms[:, 0] = 1.0
        for j in range(m):
            if j != i:
                terms[:, 1:] = terms[:, 1:] * share[j] + terms[:, :-1] * follows[:, [j]]
                terms[:, 0] *= share[j]
        out[:, i] = (follows[:, i] - share[i]) * (terms @ sizes)
    return out


def contributions(found: list[Leaf], x: np.ndarray) -> np.ndarray:
    """Rows of features -> contribution of each feature to the margin."""
    out = np.zeros(x.shape)
    for leaf in found:
        mine = x[:, leaf.features]
        agrees = (mine > leaf.low) & (mine <= leaf.high)
        m = len(leaf.features)
        if m <= TABLE:
            patterns = (np.arange(1 << m)[:, None] >> np.arange(m)) & 1
            values = path_values(patterns.astype(float), leaf.share)[agrees @ (1 << np.arange(m))]
        else:
            values = path_values(agrees.astype(float), leaf.share)
        out[:, leaf.features] += leaf.value * values
    return out


def explain(df: DataFrame, model, features: list[str], columns: list[str] | None = None, top: int = TOP) -> DataFrame:
    """Predicted rows -> with base_value, shap_prediction, sanity_ok, shap (map of the ``top`` by size), and the ``top`` to either side
    as arrays of (feature, value, contrib).

    ``columns`` are what the model saw (``features`` by default, which name them in the result) and are free of NULL and NaN, as the
    pipeline's imputer leaves them. Where ``df`` has flags of missing values, as ``told_apart`` adds them, a flag's contribution is its feature's.
    ``df`` has the model's ``prediction``; for a classifier give the margin by that name. Trees are a model's, some kilobytes; rows stay where they are.
    """
    trees = exported(model)
    found, base = leaves(trees), bias(trees)
    shared = df.sparkSession.sparkContext.broadcast(found)
    flags = [f"{f}_missing" for f in features]
    flags = flags if set(flags) <= set(df.columns) else []

    @F.pandas_udf("array<double>")
    def shap(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            x = np.stack(series.to_numpy()) if len(series) else np.zeros((0, len(features) + len(flags)))
            parts = np.split(contributions(shared.value, x), 1 + len(flags) // len(features), axis=1)
            yield pd.Series(list(sum(parts)))

    seen = F.array(*[F.col(f"`{c}`").cast("double") for c in columns or features])
    out = df.withColumn("_shap", shap(F.concat(seen, F.array(*[F.col(f"`{f}`") for f in flags])) if flags else seen))
    parts = F.arrays_zip(F.array(*[F.lit(f) for f in features]).alias("feature"), seen.alias("value"), F.col("_shap").alias("contrib"))
    # Largest size first; equal ones by name.
    order = lambda a, b: F.when(F.abs(a["contrib"]) > F.abs(b["contrib"]), -1).when(F.abs(a["contrib"]) < F.abs(b["contrib"]), 1).when(a["feature"] < b["feature"], -1).otherwise(1)
    out = out.withColumn("_parts", F.array_sort(parts, order))
    total = F.lit(base) + F.aggregate("_shap", F.lit(0.0), lambda s, v: s + v)
    of = lambda keep: F.slice(F.filter("_parts", keep), 1, top)
    return out.withColumns({
        "base_value": F.lit(base), "shap_prediction": total, "sanity_ok": F.abs(total - F.col("prediction")) < TOLERANCE,
        "shap": F.map_from_entries(F.transform(F.slice("_parts", 1, top), lambda p: F.struct(p["feature"], p["contrib"]))),
        "top_positive_contrib": of(lambda p: p["contrib"] > 0), "top_negative_contrib": of(lambda p: p["contrib"] < 0),
    }).drop("_shap", "_parts")


def gains(model, features: list[str]) -> list[tuple[str, float, int]]:
    """(feature, gain, splits): impurity that a feature's splits take away from all rows they see, best first, ties by name; unused features have zeros.

    Splits by the flags of missing values, which follow the features in the vector, are their features' own.
    """
    total, splits = np.zeros(len(features)), np.zeros(len(features), int)
    for t in exported(model):
        inner = t.left >= 0
        np.add.at(total, t.feature[inner] % len(features), (t.gain * t.cover)[inner])
        np.add.at(splits, t.feature[inner] % len(features), 1)
    return sorted(zip(features, total.tolist(), splits.tolist(), strict=True), key=lambda g: (-g[1], g[0]))


def best_round(errors: list[float], patience: int) -> tuple[int, bool]:
    """Errors of held-out rows by round -> the number of rounds to keep, and whether ``patience`` rounds without a lower error ended the boosting."""
    best = 0
    for i, error in enumerate(errors):
        if error < errors[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def first_rounds(model, rounds: int):
    """A fitted model of boosted regression trees without the rounds after the first ``rounds``."""
    from pyspark.ml.regression import GBTRegressionModel
    from pyspark.ml.wrapper import JavaWrapper

    jvm, array = SparkContext._active_spark_context._jvm, JavaWrapper._new_java_array
    kept = array([t._java_obj for t in model.trees[:rounds]], jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel)
    java = JavaWrapper._new_java_obj("org.apache.spark.ml.regression.GBTRegressionModel", model.uid, kept, array(model.treeWeights[:rounds], jvm.double))
    return model._copyValues(GBTRegressionModel(java))


def fit_with_stop(rows: DataFrame, features: list[str], label: str, held: str, weight: str | None = None, rounds: int = 200, depth: int = 5, step: float = 0.1, patience: int = PATIENCE):
    """A fitted pipeline (flags of missing values, imputer, vector, trees) whose boosting ends when the rows flagged by ``held`` haven't had a lower error for ``patience`` rounds.

    Rounds after the best one are cut, so that ``model.stages[-1].getNumTrees`` is what the held rows asked for. Spark's own stop has no patience: it
    takes the first round that gains less than its tolerance, or none. So rounds are fitted and judged in one job for all of them; where the
    stop isn't among them, half as many more are, up to ``rounds``, from the first one on, as Spark can't continue a fit.
    """
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.regression import GBTRegressor

    # Medians are of the training rows alone.
    ready = Pipeline(stages=told_apart(features)).fit(rows.where(~F.col(held)))
    seen = ready.transform(rows)
    train, judge = seen.where(~F.col(held)), seen.where(held)
    fitted, stopped = 0, False
    while fitted < rounds and not stopped:
        fitted = min(rounds, max(fitted + fitted // 2, 2 * patience))
        trees = GBTRegressor(featuresCol="vector", labelCol=label, maxIter=fitted, maxDepth=depth, stepSize=step, seed=7)
        if weight:
            trees = trees.setWeightCol(weight)
        model = trees.fit(train)
        best, stopped = best_round(model.evaluateEachIteration(judge, "squared"), patience)
    return PipelineModel([*ready.stages, first_rounds(model, best)])


def fold_rows(folds: DataFrame, label: str) -> DataFrame:
    """Rows of ``walk_forward`` with a label -> with ``held`` and recency weights by fold: from exp(-0.4) for the oldest training row to 1."""
    known = folds.where(F.col(label).isNotNull())
    days = known.where("role = 'train'").groupBy("fold", "date").agg(F.count("*").alias("_k"))
    w = W.partitionBy("fold")  # days of a fold, not rows
    days = days.select("fold", "date", F.coalesce(F.sum("_k").over(w.orderBy("date").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_k").over(w).alias("_n"))
    placed = known.join(days, ["fold", "date"], "left").withColumn("_rank", F.col("_before") + F.row_number().over(W.partitionBy("fold", "date", "role").orderBy("ticker")))
    return placed.withColumns({"held": F.col("role") == "validation", "recency": F.when(F.col("role") == "train", recency_weight(F.col("_rank"), F.col("_n"))).otherwise(1.0)}).drop("_before", "_n", "_rank")


def measures(predicted: DataFrame, label: str) -> Column:
    """What a fold is judged by, as one struct to aggregate: rmse, mae, hit (same side of zero), corr (0 where undefined), q90, q95 of absolute residuals."""
    p, y = F.col("prediction"), F.col(label)
    size = F.abs(y - p)
    spread = (F.stddev_pop(p) > 1e-12) & (F.stddev_pop(y) > 1e-12)
    quantiles = F.percentile(size, F.array(F.lit(0.9), F.lit(0.95)))
    return F.struct(
        F.count("*").alias("n"), F.sqrt(F.avg(size * size)).alias("rmse"), F.avg(size).alias("mae"), F.avg(((y > 0) == (p > 0)).cast("double")).alias("hit"),
        F.coalesce(F.when(spread, F.corr(p, y)), F.lit(0.0)).alias("corr"), quantiles[0].alias("q90"), quantiles[1].alias("q95"),
    )


def fit_folds(folds: DataFrame, features: list[str], label: str, fold_count: int, least_train: int = 200, least_held: int = 20, **options) -> tuple[list[dict], list[tuple[str, float, int]], object]:
    """Folds in order -> (measures of each, gains of the first fold's features, the last model).

    A fold below the least numbers ends the walk. Fold 0 has seen no later row, so its gains choose features without leaks.
    Folds don't wait for each other: a round of boosting is a chain of short jobs, which leaves most cores idle.
    """
    rows = fold_rows(folds, label).select("ticker", "date", "fold", "held", "recency", label, *features).persist()
    counts = {r.fold: r for r in rows.groupBy("fold").agg(F.count_if(~F.col("held")).alias("train"), F.count_if("held").alias("held")).collect()}
    walked = list(takewhile(lambda f: f in counts and counts[f].train >= least_train and counts[f].held >= least_held, range(fold_count)))

    def fit(fold: int) -> tuple[dict, object]:
        mine = rows.where(F.col("fold") == fold).coalesce(1 + (counts[fold].train + counts[fold].held) // TASK_ROWS)
        model = fit_with_stop(mine, features, label, "held", "recency", **options)
        judged = model.transform(mine.where("held"))
        m = judged.agg(measures(judged, label).alias("m")).select("m.*").first()
        return {"fold": fold, **m.asDict(), "rounds": model.stages[-1].getNumTrees}, model

    with ThreadPool(max(1, len(walked))) as pool:
        done = pool.map(inheritable_thread_target(rows.sparkSession)(fit), walked)
    rows.unpersist()
    first = gains(done[0][1].stages[-1], features) if done else []
    return [found for found, _ in done], first, done[-1][1] if done else None


def fold_medians(spark_rows: DataFrame) -> DataFrame:
    """Measures of folds -> the median of each over all folds, a few rows."""
    return spark_rows.agg(*[F.median(c).alias(c) for c in ("rmse", "mae", "hit", "corr", "q90", "q95")], F.count("*").alias("folds"))


def with_share(rows: DataFrame) -> DataFrame:
    """(feature, gain, splits) -> with each feature's share of the whole gain, and that in percent."""
    share = ratio("gain", F.sum("gain").over(W.partitionBy()))  # features of one model
    return rows.withColumns({"gain_normalized": F.round(share, 6), "gain_pct": F.round(100 * share, 2)})
