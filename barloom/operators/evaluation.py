"""Evaluation of predictions: accuracy, rank correlation, calibration, stability, trade and portfolio measures."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.columns import clip, fill, ratio
from barloom.functions.windows import percent_rank_shared, rolling


def realised(prices: DataFrame, horizon: int) -> DataFrame:
    """Log return to ``horizon`` rows later, by row and not by day."""
    w = W.partitionBy("ticker").orderBy("date")
    return prices.withColumn("realised", F.ln(ratio(F.lead("close", horizon).over(w), "close")))


def neutral_targets(prices: DataFrame, index: DataFrame, horizon: int) -> DataFrame:
    """Return less the index's over the same rows; the return alone for a ticker that ever lacks a positive index."""
    w = W.partitionBy("ticker").orderBy("date")
    df = prices.join(index, "date", "left").withColumn("_ok", F.min(fill(F.when(F.col("market_close") > 0, 1), 0)).over(W.partitionBy("ticker")))
    own = F.ln(ratio(F.lead("close", horizon).over(w), "close"))
    other = F.ln(ratio(F.lead("market_close", horizon).over(w), "market_close"))
    return df.withColumn(f"target_{horizon}", F.when(F.col("_ok") == 1, own - other).otherwise(own)).drop("_ok")


def errors(df: DataFrame, keys: list[str], p: str = "prediction", y: str = "realised") -> DataFrame:
    """Share of right signs, mean absolute and root mean square error, per key."""
    d = F.col(p) - F.col(y)
    return df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(F.when(F.signum(p) == F.signum(y), 1.0).otherwise(0.0)).alias("accuracy"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"))


def spearman(df: DataFrame, keys: list[str], p: str = "prediction", y: str = "realised", least: int = 5) -> DataFrame:
    """Correlation of ranks, ties share theirs; NULL below ``least`` rows."""
    both = df.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    ranked = both.withColumns({"_p": percent_rank_shared(p, keys), "_y": percent_rank_shared(y, keys)})
    return ranked.groupBy(*keys).agg(F.when(F.count("*") >= least, F.corr("_p", "_y")).alias("spearman"))


def top_share_mean(df: DataFrame, keys: list[str], p: str, y: str, tie: str, share: float = 0.1) -> DataFrame:
    """Mean outcome of the highest predictions."""
    ranked = df.withColumns({"_r": F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(p), tie)), "_n": F.count("*").over(W.partitionBy(*keys))})
    return ranked.where(F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") * share))).groupBy(*keys).agg(F.avg(y).alias("top_mean"), F.count("*").alias("n"))


def brier(df: DataFrame, keys: list[str], p: str, y: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg((F.col(p) - F.col(y)) ** 2).alias("brier"), F.count("*").alias("n"))


def calibration(df: DataFrame, p: str, y: str, bins: int = 5) -> DataFrame:
    """Equal bins of probability, the last one closed; empty ones are absent."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("predicted"), F.avg(y).alias("observed"))


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function of x > 0: Stirling's series at x + 8."""
    z = x + 8
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    below = F.ln(x)
    for i in range(1, 8):
        below = below + F.ln(x + i)
    return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + series - below


#: Terms of the continued fraction; it needs about the root of the number of trials.
TERMS = 400
_TINY = 1e-300


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    solid = lambda v: F.when(F.abs(v) < _TINY, _TINY).otherwise(v)
    first = 1 / solid(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))

    def half(s: Column, term: Column) -> Column:
        d, c = 1 / solid(1 + term * s["d"]), solid(1 + term / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    def step(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.aggregate(F.array(even, odd), s, half)

    terms = F.transform(F.sequence(F.lit(1), F.lit(TERMS)), lambda m: m.cast("double"))
    return F.aggregate(terms, start, step, lambda s: s["h"])


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function of a, b > 0 and x between 0 and 1."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.log1p(-x))
    inner = F.when(x < (a + 1) / (a + b + 2), front * _fraction(a, b, x) / a).otherwise(1 - front * _fraction(b, a, 1 - x) / b)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inner)


def binomial_tail(hits: Column, n: Column, p: float = 0.5) -> Column:
    """Chance of as many hits or more of n, each with chance p."""
    k, n = hits.cast("double"), n.cast("double")
    return F.when(k <= 0, 1.0).when(k > n, 0.0).otherwise(incomplete_beta(k, n - k + 1, F.lit(float(p))))


def accuracy_test(hits: Column, n: Column, least: int = 10) -> Column:
    """One-sided p against even chance; NULL below ``least`` trials."""
    return F.when(n >= least, binomial_tail(hits, n))


def gate_p(hits: Column, n: Column, least: int = 20) -> Column:
    """The same for the gate of models, where few trials prove nothing: 1 below ``least``."""
    return F.when(n >= least, binomial_tail(hits, n)).otherwise(1.0)


def exact_interval(hits: Column, n: Column, level: float = 0.95, one_sided: bool = True) -> tuple[Column, Column]:
    """Exact (Clopper and Pearson's) bounds of the chance behind hits of n. One-sided ones reach up to 1.

    Each bound is bisected on the incomplete beta function, in the JVM.
    """
    k, n = hits.cast("double"), n.cast("double")
    tail = (1 - level) if one_sided else (1 - level) / 2

    def bisect(a: Column, b: Column, target: float) -> Column:
        def step(s: Column, _: Column) -> Column:
            middle = (s["low"] + s["high"]) / 2
            under = incomplete_beta(a, b, middle) < target
            return F.struct(F.when(under, middle).otherwise(s["low"]).alias("low"), F.when(under, s["high"]).otherwise(middle).alias("high"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(45)), F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high")), step, lambda s: (s["low"] + s["high"]) / 2)

    low = F.when(k <= 0, 0.0).otherwise(bisect(k, n - k + 1, tail))
    high = F.lit(1.0) if one_sided else F.when(k >= n, 1.0).otherwise(bisect(k + 1, n - k, 1 - tail))
    return F.when(n > 0, low), F.when(n > 0, high)


def stability(base: DataFrame, recent: DataFrame, x: str, least: int = 10) -> DataFrame:
    """Population stability index over deciles of the base: sum of (r - b) ln(r / b) over shares with 1e-6 added to counts; NULL if either has few rows."""
    edges = base.agg(F.percentile(x, F.array(*[F.lit(i / 10) for i in range(11)])).alias("e"))
    inner = F.slice("e", 2, 9)
    place = F.size(F.filter(inner, lambda e: e <= F.col(x)))
    both = base.select(x, F.lit("b").alias("_k")).unionByName(recent.select(x, F.lit("r").alias("_k"))).where(F.col(x).isNotNull()).crossJoin(F.broadcast(edges))
    inside = both.where((F.col(x) >= F.element_at("e", 1)) & (F.col(x) <= F.element_at("e", 11))).withColumn("bin", place)
    counts = inside.groupBy("bin").agg(F.count_if(F.col("_k") == "b").alias("b"), F.count_if(F.col("_k") == "r").alias("r"))
    bins = base.sparkSession.range(10).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").na.fill(0)
    shares = bins.withColumns({"_b": (F.col("b") + 1e-6) / (F.sum("b").over(W.partitionBy()) + 1e-5), "_r": (F.col("r") + 1e-6) / (F.sum("r").over(W.partitionBy()) + 1e-5)})
    value = F.sum((F.col("_r") - F.col("_b")) * F.ln(F.col("_r") / F.col("_b")))
    return shares.agg(F.when((F.sum("b") >= least) & (F.sum("r") >= least), value).alias("psi"))


def stability_by(df: DataFrame, keys: list[str], x: str, base: str, least: int = 10) -> DataFrame:
    """Stability index of each key between rows flagged by ``base`` and the others, over open-ended deciles of the former."""
    known = df.where(F.col(x).isNotNull()).select(*keys, F.col(x).alias("_x"), F.col(base).alias("_base"))
    edges = known.groupBy(*keys).agg(F.percentile(F.when(F.col("_base"), F.col("_x")), F.array(*[F.lit(i / 10) for i in range(1, 10)])).alias("_e"))
    place = F.size(F.filter("_e", lambda e: e <= F.col("_x")))
    counts = known.join(edges.where("_e IS NOT NULL"), keys).withColumn("_bin", place)
    both = counts.groupBy(*keys).agg(*[F.count_if((F.col("_bin") == i) & (F.col("_base") == side)).alias(f"_{'b' if side else 'r'}{i}") for i in range(10) for side in (True, False)])
    shares = lambda side: [(F.col(f"_{side}{i}") + 1e-6) / (sum((F.col(f"_{side}{j}") for j in range(1, 10)), F.col(f"_{side}0")) + 1e-5) for i in range(10)]
    terms = [(r - b) * F.ln(r / b) for b, r in zip(shares("b"), shares("r"), strict=True)]
    many = lambda side: sum((F.col(f"_{side}{j}") for j in range(1, 10)), F.col(f"_{side}0")) >= least
    return both.select(*keys, F.when(many("b") & many("r"), sum(terms[1:], terms[0])).alias("psi"))


def drift(df: DataFrame, keys: list[str], date: str, days: int = 60, p: str = "prediction", y: str = "realised", up: str = "p") -> DataFrame:
    """Rows of the last ``days`` and 30 before them: those up to two thirds of the way are the base, the rest is recent.

    Stability of predictions, accuracies and Brier scores of the probability ``up`` (NULL up to five rows), mean size of predictions, and a status
    with its alerts: a stability index above .25 (above .10 without a warning), recent accuracy below .48, a recent Brier score
    above 1.3 of the base's. Fewer than ten rows are too few for a status.
    """
    last = F.broadcast(df.agg(F.max(date).alias("_last")))
    split = df.crossJoin(last).where(F.col(date) >= F.date_sub("_last", days + 30))
    split = split.withColumns({
        "_base": F.col(date) < F.date_add(F.date_sub("_last", days), days * 2 // 3), "_hit": F.when(F.signum(p) == F.signum(y), 1.0).otherwise(0.0),
        "_off": (F.col(up) - F.when(F.col(y) > 0, 1.0).otherwise(0.0)) ** 2,
    }).drop("_last")
    on = lambda c, base: F.avg(F.when(F.col("_base") == base, c))
    enough = lambda c, base: F.when(F.count_if(F.col("_base") == base) > 5, on(F.col(c), base))
    out = split.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("_hit").alias("accuracy"), enough("_hit", True).alias("base_accuracy"), enough("_hit", False).alias("recent_accuracy"),
        F.avg("_off").alias("brier"), enough("_off", True).alias("base_brier"), enough("_off", False).alias("recent_brier"), on(F.abs(p), True).alias("base_size"), on(F.abs(p), False).alias("recent_size"),
    )
    out = out.join(stability_by(split, keys, p, "_base"), keys, "left")
    worse, blurred = F.col("recent_accuracy") < 0.48, F.col("recent_brier") > 1.3 * F.col("base_brier")
    alerts = [F.when(F.col("psi") > 0.25, "high psi").when(F.col("psi") > 0.10, "moderate psi"), F.when(worse, "accuracy"), F.when(blurred, "brier")]
    warned = fill((F.col("psi") > 0.25), False) | fill(worse, False) | fill(blurred, False)
    return out.withColumns({"status": F.when(F.col("n") < 10, "insufficient_data").when(warned, "WARNING").otherwise("OK"), "alerts": F.array_compact(F.array(*alerts))})


def rolling_accuracy(df: DataFrame, n: int = 14, least: int = 5) -> DataFrame:
    return df.withColumn("rolling_accuracy", rolling(F.avg, F.when(F.signum("prediction") == F.signum("realised"), 1.0).otherwise(0.0), n, least))


def portfolio_measures(daily: DataFrame, keys: list[str], r: str = "r") -> DataFrame:
    """Daily log returns -> total return, Sharpe ratio with population spread, largest fall from a top."""
    w = W.partitionBy(*keys).orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    df = daily.withColumn("_c", F.exp(F.sum(r).over(w)))
    df = df.withColumn("_d", ratio(F.col("_c") - F.max("_c").over(w), F.max("_c").over(w)))
    return df.groupBy(*keys).agg((F.exp(F.sum(r)) - 1).alias("total_return"), (ratio(F.avg(r), F.stddev_pop(r)) * math.sqrt(252)).alias("sharpe"), F.min("_d").alias("max_drawdown"), F.count("*").alias("days"))


def trade_stats(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Number, returns, share of gains, rows held, and trades a year between the first entry and the last exit, of a year at least."""
    years = F.greatest(F.lit(1.0), F.datediff(F.max("exit_date"), F.min("entry_date")) / 365.25)
    return trades.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("return").alias("mean"), F.median("return").alias("median"), F.avg(F.when(F.col("return") > 0, 1.0).otherwise(0.0)).alias("win_rate"),
        F.avg("bars_held").alias("bars"), (F.count("*") / years).alias("per_year"))


def residual_bands(df: DataFrame, keys: list[str], p: str, y: str) -> DataFrame:
    """90 and 95 % quantiles of absolute residuals."""
    return df.groupBy(*keys).agg(F.percentile(F.abs(F.col(p) - F.col(y)), F.array(F.lit(0.9), F.lit(0.95))).alias("_q")).select(*keys, F.element_at("_q", 1).alias("q90"), F.element_at("_q", 2).alias("q95"))


def signal_threshold(df: DataFrame, keys: list[str], p: str, low: float, high: float) -> DataFrame:
    """Mean plus a twentieth of the population spread, bounded."""
    return df.groupBy(*keys).agg(clip(F.avg(p) + 0.05 * F.stddev_pop(p), low, high).alias("threshold"))


def coverage(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Share of rows with a value other than zero and what it amounts to."""
    share = F.avg(F.when(F.col(x).isNotNull() & (F.col(x) != 0), 1.0).otherwise(0.0))
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), share.alias("share")).withColumn("status", F.when(F.col("share") > 0.3, "OK").when(F.col("share") > 0, "LOW").otherwise("EMPTY"))


def group_coverage(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Share of rows in which any column of a group is other than zero, a column a group."""
    return df.agg(*[F.avg(F.when(F.exists(F.array(*[fill(F.col(c).cast("double"), 0.0) for c in cs]), lambda x: x != 0), 1.0).otherwise(0.0)).alias(g) for g, cs in groups.items()])
