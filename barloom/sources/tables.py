"""Table scans, shaping on read, and the panels that the market operators work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.columns import clean


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def price_range(prices: DataFrame, ticker: str, start: str, end: str) -> DataFrame:
    """Rows of one ticker between two dates, both included, in order of date."""
    return prices.where((F.col("ticker") == ticker) & F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).orderBy("date")


def price_panel(lineitem: DataFrame, part: DataFrame, name: str = "p_brand") -> DataFrame:
    """(ticker, date, open, high, low, close, volume) from sales: one bar for each name and day, trades in order of their keys."""
    trades = lineitem.select("l_partkey", F.to_date("l_shipdate").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), "l_quantity", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("at"))
    named = trades.join(part.select(F.col("p_partkey").alias("l_partkey"), F.col(name).alias("ticker")), "l_partkey")
    return named.groupBy("ticker", "date").agg(
        F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "at").alias("close"), F.sum("l_quantity").alias("volume"),
    )


def bars(spark: SparkSession, sf_dir: str, name: str = "p_brand") -> DataFrame:
    return price_panel(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part"), name)


def market(panel: DataFrame) -> DataFrame:
    """(date, market_close): the mean close of all names, as an index."""
    return panel.groupBy("date").agg(F.avg("close").alias("market_close"))


def normalise_bars(raw: DataFrame, ticker: str | None = None) -> DataFrame:
    """Column names such as ``Close_AAPL`` or ``Adj Close`` to lower-case plain ones, the epoch's date dropped, NaN to NULL, date first."""
    plain = {}
    for c in raw.columns:
        base = c[: -len(ticker) - 1] if ticker and c.endswith(f"_{ticker}") else c
        plain[c] = base.strip().lower().replace(" ", "_")
    df = raw.withColumnsRenamed(plain)
    numbers = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    df = df.withColumns({c: clean(c) for c in numbers}).withColumn("date", F.to_date("date"))
    return df.where(F.col("date") != F.lit("1970-01-01").cast("date")).select("date", *[c for c in df.columns if c != "date"])


def increments(batch: DataFrame, stored: DataFrame, key: str = "ticker", date: str = "date") -> DataFrame:
    """Rows of a batch that are newer than what is stored of their key; all rows of new keys."""
    marks = stored.groupBy(key).agg(F.max(date).alias("_mark"))
    return batch.join(marks, key, "left").where(F.col("_mark").isNull() | (F.col(date) > F.col("_mark"))).drop("_mark")


def missing_days(calendar: DataFrame, stored: DataFrame, canaries: list[str]) -> DataFrame:
    """Trading days of the calendar for which no canary has a row."""
    return calendar.join(stored.where(F.col("ticker").isin(canaries)).select("date").distinct(), "date", "left_anti")


def latest(df: DataFrame, key: str | list[str], order: list[Column] | Column) -> DataFrame:
    """The newest row of each key."""
    keys, order = [key] if isinstance(key, str) else key, order if isinstance(order, list) else [order]
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def as_of(df: DataFrame, key: str, ts: str, moment: Column) -> DataFrame:
    """The newest row of each key at a moment."""
    rest = [c for c in df.columns if c != key]
    return df.where(F.col(ts) <= moment).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*[c for c in (ts, *[r for r in rest if r != ts])])).alias("r")).select(key, "r.*")


def preferred(df: DataFrame, key: list[str], source: str, best: str) -> DataFrame:
    """One row a key, from the preferred source where it has one, else the first source in order."""
    return latest(df, key, [(F.col(source) == best).desc(), F.col(source)])


def upsert(base: DataFrame, delta: DataFrame, keys: list[str], order: str) -> DataFrame:
    """base with the rows of delta: for each key the row with the greatest ``order``; at equal ones delta's."""
    both = base.withColumn("_new", F.lit(0)).unionByName(delta.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, [F.col(order).desc(), F.col("_new").desc()]).drop("_new")


def retained(df: DataFrame, ts: str, cutoff: Column) -> DataFrame:
    """Rows that are kept: not older than the cutoff. Times may be text; those that can't be read stay."""
    when = F.coalesce(F.col(ts).try_cast("timestamp"), F.try_to_timestamp(F.col(ts).cast("string")))
    return df.where(when.isNull() | (when >= cutoff))


def align(df: DataFrame, columns: list[str]) -> DataFrame:
    """These columns in this order; absent ones are NULL, others go."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in columns])


LEAKS = ("target", "label", "future", "forward")


def feature_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    """Numeric columns that are not excluded and whose names don't look like targets."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude and not any(x in f.name.lower() for x in LEAKS) and not f.name.lower().startswith("y_")]


def fresh(df: DataFrame, key: str, ts: str, now: Column, seconds: int) -> DataFrame:
    """Keys with a row up to ``now``, and whether their newest one is at most so many seconds old."""
    return df.where(F.col(ts) <= now).groupBy(key).agg((F.max(ts) >= now - F.make_dt_interval(secs=F.lit(seconds))).alias("fresh"))


def unexpired(df: DataFrame, key: str, ts: str, now: Column, pattern: str | None = None, endpoint: str = "endpoint", expires: str = "expires_at") -> DataFrame:
    """The newest row of each key whose endpoint matches, where it hasn't expired: an expired one hides older rows. Without an expiry it doesn't expire, without a time it is the oldest."""
    found = df.where(F.rlike(endpoint, F.lit(pattern))) if pattern else df
    rest = [c for c in df.columns if c != key]
    newest = latest(found.select(key, *rest), key, [F.desc_nulls_last(ts), *[F.desc_nulls_last(c) for c in rest if c != ts]])
    return newest.where(F.col(expires).isNull() | (F.col(expires) >= now)) if expires in df.columns else newest


#: The change of a score that is worth storing, how far back it is compared, how long rows are kept.
LEAST_CHANGE, COMPARED_SECONDS, KEPT_DAYS = 0.05, 3600, 30


def changed(stored: DataFrame, new: DataFrame, keys: list[str], ts: str, suffix: str = "_sentiment") -> DataFrame:
    """Rows of ``new`` worth storing: those of a key without a stored row in the hour before, and those of which any column that
    ends in ``suffix`` differs by more than ``LEAST_CHANGE`` from the newest stored row of that hour. An absent score is 0."""
    from barloom.operators.asof import asof_join

    scores = [c for c in new.columns if c.endswith(suffix)]
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    old = stored.select(*keys, ts, *[(zero(c) if c in stored.columns else F.lit(0.0)).alias(f"_old_{c}") for c in scores], F.col(ts).alias("_seen"))
    met = asof_join(new, old, ts, keys)
    recent = F.col("_seen") >= F.col(ts) - F.make_dt_interval(secs=F.lit(COMPARED_SECONDS))
    moved = F.lit(False)
    for c in scores:
        moved = moved | (F.abs(zero(c) - F.col(f"_old_{c}")) > LEAST_CHANGE)
    return met.where(~F.coalesce(recent, F.lit(False)) | moved).select(*new.columns)


def store_changed(stored: DataFrame, new: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """The sink's rows behind a write: stored ones and what is worth storing, without rows older than ``KEPT_DAYS`` before the write of any key that wrote."""
    kept = changed(stored, new, keys, ts)
    cutoff = kept.groupBy(*keys).agg((F.max(ts) - F.make_dt_interval(days=F.lit(KEPT_DAYS))).alias("_cutoff"))
    both = stored.unionByName(kept, allowMissingColumns=True).join(cutoff, keys, "left")
    return both.where(F.col("_cutoff").isNull() | (F.col(ts) >= F.col("_cutoff"))).drop("_cutoff")
