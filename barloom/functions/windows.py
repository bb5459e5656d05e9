"""Window primitives: guarded frames, exponential means, ranks with shared places, runs, fills."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from barloom.functions.columns import col


def series(key: str | list[str] = "ticker", order: str = "date") -> WindowSpec:
    return W.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(order)


def rolling(fn: Callable[[Column], Column], x: str | Column, n: int, least: int, over: WindowSpec | None = None) -> Column:
    """fn over the last n rows, NULL while fewer than ``least`` of them have a value."""
    frame = (over or series()).rowsBetween(-(n - 1), 0)
    x = col(x)
    return F.when(F.count(x).over(frame) >= least, fn(x).over(frame))


def rolling_quantile(x: str | Column, q: float, n: int, least: int, over: WindowSpec | None = None) -> Column:
    """Exact quantile with linear interpolation over the last n rows."""
    return rolling(lambda c: F.percentile(c, F.lit(q)), x, n, least, over)


def rolling_corr(a: Column, b: Column, n: int, least: int, over: WindowSpec | None = None) -> Column:
    frame = (over or series()).rowsBetween(-(n - 1), 0)
    both = F.when(a.isNotNull() & b.isNotNull(), 1)
    return F.when(F.count(both).over(frame) >= least, F.corr(a, b).over(frame))


def rolling_slope(y: str | Column, n: int, least: int, over: WindowSpec | None = None, index: str = "_row") -> Column:
    """Least-squares slope over the last n rows against the row number in column ``index``."""
    frame = (over or series()).rowsBetween(-(n - 1), 0)
    y = col(y)
    return F.when(F.count(y).over(frame) >= least, F.regr_slope(y, F.col(index)).over(frame))


def numbered(df: DataFrame, over: WindowSpec | None = None) -> DataFrame:
    return df.withColumn("_row", F.row_number().over(over or series()))


def lag(x: str | Column, k: int = 1, over: WindowSpec | None = None) -> Column:
    return F.lag(col(x), k).over(over or series())


def change(x: str | Column, k: int, over: WindowSpec | None = None) -> Column:
    """Relative change against k rows before."""
    x = col(x)
    return F.try_divide(x, F.lag(x, k).over(over or series())) - 1


def last_known(x: str | Column, over: WindowSpec | None = None) -> Column:
    return F.last(col(x), ignorenulls=True).over((over or series()).rowsBetween(W.unboundedPreceding, 0))


def next_known(x: str | Column, over: WindowSpec | None = None) -> Column:
    return F.first(col(x), ignorenulls=True).over((over or series()).rowsBetween(0, W.unboundedFollowing))


def percent_rank_shared(x: str | Column, by: str | list[str]) -> Column:
    """Rank divided by the number of values, ties share the mean rank, NULL has none."""
    x, by = col(x), [by] if isinstance(by, str) else by
    rank = F.rank().over(W.partitionBy(*by).orderBy(x.asc_nulls_last()))
    same = F.count("*").over(W.partitionBy(*by, x))
    return F.when(x.isNotNull(), (rank + (same - 1) / 2) / F.count(x).over(W.partitionBy(*by)))


def quintile(rank: Column, n: Column) -> Column:
    """1 for the best fifth to 5, by a step of n / 5 that need not be whole."""
    return F.least(F.lit(5), (1 + F.floor((rank - 1) / F.greatest(F.lit(1.0), n / 5))).cast("int"))


def drawdown(x: str | Column, over: WindowSpec | None = None) -> Column:
    x = col(x)
    top = F.max(x).over((over or series()).rowsBetween(W.unboundedPreceding, 0))
    return F.try_divide(x - top, top)


def run_length(df: DataFrame, x: Column, name: str, over: WindowSpec | None = None) -> DataFrame:
    """Signed length of the run of equal signs that a row is in: 3 for the third rise, -2 for the second fall, 0 for none."""
    over = over or series()
    s = F.coalesce(F.signum(x), F.lit(0.0))
    keys = [c for c in ("ticker",) if c in df.columns]
    df = df.withColumn("_s", s)
    df = df.withColumn("_new", F.when(F.col("_s") == F.lag("_s").over(over), 0).otherwise(1))
    df = df.withColumn("_run", F.sum("_new").over(over.rowsBetween(W.unboundedPreceding, 0)))
    inside = W.partitionBy(*keys, "_run").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(name, F.sum("_s").over(inside)).drop("_s", "_new", "_run")


def exponential_mean(df: DataFrame, key: str, order: str, columns: dict[str, tuple], adjust: bool = False, seeded: bool = False) -> DataFrame:
    """df with exponential means by span, one pass over each key: name -> (column, span, least values).

    A column may also be a pair of earlier names whose difference is taken. ``adjust`` divides by the sum of the weights;
    otherwise the first value starts the recursion, or with ``seeded`` the plain mean of the first ``span`` values, before
    which there is no result. NULLs before the first value don't start it; after later ones the last mean counts for less.
    """
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.DoubleType()) for n in columns)])

    def run(pdf):
        pdf = pdf.sort_values(order, kind="stable")
        for name, (source, span, least) in columns.items():
            x = (pdf[source[0]] - pdf[source[1]] if isinstance(source, tuple) else pdf[source]).astype(float)
            if seeded:
                seen = x.notna().cumsum()
                head = x.where(seen <= span).mean() if seen.max() >= span else None
                x = x.where(seen > span).mask((seen == span) & x.notna(), head)
                least = 1
            pdf[name] = x.ewm(span=span, min_periods=least, adjust=adjust).mean()
        return pdf

    return df.groupBy(key).applyInPandas(run, schema)
