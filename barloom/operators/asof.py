"""As-of joins and calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], direction: str = "backward", inclusive: bool = True, tolerance: int | None = None) -> DataFrame:
    """left with the columns of the row of ``right`` with the same ``by`` that is nearest in ``on`` in a direction.

    Both sides are united and sorted once by key and time, and the last known row of the right is carried along: one
    shuffle, no range join. ``inclusive`` admits equal times. Of several rows at one time the greatest wins. Rows
    further away than ``tolerance`` (days, for dates) give NULL. ``nearest`` takes the earlier of two equally near.
    """
    if direction == "nearest":
        back = asof_join(left.withColumn("_id", F.monotonically_increasing_id()), right.withColumn("_on", F.col(on)), on, by, "backward", inclusive, tolerance)
        rest = [c for c in right.columns if c not in (on, *by)] + ["_on"]
        both = asof_join(back.withColumnsRenamed({c: f"_b_{c}" for c in rest}), right.withColumn("_on", F.col(on)), on, by, "forward", inclusive, tolerance)
        distance = lambda c: F.abs(F.datediff(F.col(on), F.col(c)))
        first = F.col("_b__on").isNotNull() & (F.col("_on").isNull() | (distance("_b__on") <= distance("_on")))
        return both.select(*left.columns, *[F.when(first, F.col(f"_b_{c}")).otherwise(F.col(c)).alias(c) for c in rest if c != "_on"])
    rest = [c for c in right.columns if c not in (on, *by)]
    backward = direction == "backward"
    # At equal times the right comes first if it counts, and last if it doesn't.
    side_left, side_right = (1, 0) if inclusive else (0, 1)
    a = left.select(*left.columns, F.lit(side_left).alias("_side"), F.lit(None).cast(right.select(F.struct(F.col(on).alias("_at"), *rest)).schema[0].dataType).alias("_row"))
    b = right.select(*[F.col(c) if c in (on, *by) else F.lit(None).cast(t).alias(c) for c, t in ((f.name, f.dataType) for f in left.schema)], F.lit(side_right).alias("_side"), F.struct(F.col(on).alias("_at"), *rest).alias("_row"))
    time = F.col(on).asc() if backward else F.col(on).desc()
    w = W.partitionBy(*by).orderBy(time, "_side", F.col("_row").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    met = a.unionByName(b).withColumn("_row", F.last("_row", ignorenulls=True).over(w)).where(F.col("_side") == side_left)
    near = F.lit(True) if tolerance is None else F.abs(F.datediff(F.col(on), F.col("_row._at"))) <= tolerance
    return met.select(*left.columns, *[F.when(near, F.col(f"_row.{c}")).alias(c) for c in rest])


def densify(df: DataFrame, keys: list[str], date: str, end: DataFrame | None = None) -> DataFrame:
    """A row for each key and calendar day from its first to its last date (or to ``end``'s ``_end``); new rows have NULLs."""
    spans = df.groupBy(*keys).agg(F.min(date).alias("_start"), F.max(date).alias("_stop"))
    if end is not None:
        spans = spans.join(end, keys, "left").withColumn("_stop", F.coalesce("_end", "_stop")).drop("_end")
    days = spans.where(F.col("_start") <= F.col("_stop")).select(*keys, F.explode(F.sequence("_start", "_stop", F.expr("interval 1 day"))).alias(date))
    return days.join(df, [*keys, date], "left")


def nearest_row(df: DataFrame, key: list[str], date: str, target) -> DataFrame:
    """The row of each key whose date is nearest to a target, the earlier of two."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(F.abs(F.datediff(date, target)), F.col(date))).alias("r")).select(*key, "r.*")
