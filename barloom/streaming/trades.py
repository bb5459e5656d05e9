"""Live trades with Structured Streaming: running state of symbols, windows by event time, price alerts with throttling."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.columns import ratio

TRADE = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("price", T.DoubleType()), T.StructField("volume", T.DoubleType()), T.StructField("ts", T.TimestampType())])
MESSAGE = "struct<type:string,data:array<struct<s:string,p:double,v:double,t:bigint,c:array<string>>>>"


def from_messages(raw: DataFrame, column: str = "value") -> DataFrame:
    """JSON messages of several trades -> (symbol, price, volume, ts, conditions)."""
    m = raw.select(F.from_json(F.col(column).cast("string"), MESSAGE).alias("m")).where("m.type = 'trade'").select(F.explode("m.data").alias("d"))
    return m.select(F.col("d.s").alias("symbol"), F.col("d.p").alias("price"), F.col("d.v").alias("volume"), F.timestamp_millis("d.t").alias("ts"), F.col("d.c").alias("conditions"))


def running_state(trades: DataFrame) -> DataFrame:
    """Totals of each symbol since the start, the last, first, highest and lowest price. The same on a table and on a stream in update mode."""
    return trades.groupBy("symbol").agg(
        F.sum("volume").alias("volume"), F.count("*").alias("trades"), F.max("ts").alias("updated"), F.max_by("price", "ts").alias("last"),
        F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"))


def with_change(state: DataFrame, previous: DataFrame) -> DataFrame:
    """Change against the close of the day before, where one is known."""
    met = state.join(previous, "symbol", "left")
    return met.withColumns({"change": F.col("last") - F.col("previous_close"), "change_pct": ratio(F.col("last") - F.col("previous_close"), "previous_close") * 100})


def tumbling(trades: DataFrame, size: str, late: str | None = None) -> DataFrame:
    df = trades.withWatermark("ts", late) if late else trades
    return df.groupBy(F.window("ts", size), "symbol").agg(F.count("*").alias("n"), F.sum("price").alias("total")).select(F.col("window.start").alias("start"), "symbol", "n", "total")


def sliding(trades: DataFrame, size: str, step: str, late: str | None = None) -> DataFrame:
    df = trades.withWatermark("ts", late) if late else trades
    return df.groupBy(F.window("ts", size, step), "symbol").agg(F.count("*").alias("n"), F.max("price").alias("high")).select(F.col("window.start").alias("start"), "symbol", "n", "high")


def sessions(trades: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    df = trades.withWatermark("ts", late) if late else trades
    return df.groupBy(F.session_window("ts", gap), "symbol").agg(F.count("*").alias("n"), F.sum("price").alias("total")).select(F.col("session_window.start").alias("start"), "symbol", "n", "total")


def recent_rate(trades: DataFrame, seconds: int) -> DataFrame:
    """How many rows a symbol had within so many seconds, each row included: what a sliding rate limit looks at."""
    w = W.partitionBy("symbol").orderBy(F.unix_micros("ts")).rangeBetween(-seconds * 1_000_000, 0)
    return trades.withColumn("recent", F.count("*").over(w))


ALERT = "symbol string, price double, baseline double, change_pct double, ts timestamp"
STATE = "baseline double, checked double, alerted bigint"


def _alerts(rows, state: tuple | None, percent: float, least: float, throttle: int):
    """Alerts of rows in order of time, and the state after them.

    The first price is the baseline. A price that moved less than ``least`` since the last look is passed over. A move
    of ``percent`` or more against the baseline alerts and becomes the baseline, unless an alert came within
    ``throttle`` seconds: then the baseline stays.
    """
    baseline, checked, alerted = state or (None, None, None)
    out = []
    for r in rows:
        if baseline is None:
            baseline = checked = r.price
            continue
        if abs(r.price - checked) < least or not baseline:
            continue
        checked = r.price
        change = (r.price - baseline) / baseline * 100
        now = int(r.ts.timestamp() * 1_000_000)
        if abs(change) >= percent and (alerted is None or now - alerted >= throttle * 1_000_000):
            out.append((r.symbol, r.price, baseline, change, r.ts))
            baseline, alerted = r.price, now
    return out, (baseline, checked, alerted)


def alerts(trades: DataFrame, percent: float = 3.0, least: float = 0.01, throttle: int = 1800) -> DataFrame:
    """Alerts of a table: one pass over each symbol in order of time."""

    def run(pdf):
        import pandas as pd

        out, _ = _alerts(pdf.sort_values("ts", kind="stable").itertuples(), None, percent, least, throttle)
        return pd.DataFrame(out, columns=["symbol", "price", "baseline", "change_pct", "ts"])

    return trades.select("symbol", "price", "ts").groupBy("symbol").applyInPandas(run, ALERT)


def alert_stream(trades: DataFrame, percent: float = 3.0, least: float = 0.01, throttle: int = 1800, late: str = "1 hour", idle: int = 172_800) -> DataFrame:
    """The same on a stream: baseline, last look and last alert are kept for each symbol between batches.

    Trades later than ``late`` are left out. A symbol without trades for ``idle`` seconds of event time is forgotten, so
    that state holds what is traded and not all that ever was; its next price is a baseline anew.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        old = state.get if state.exists else None
        old = old and tuple(None if x is None or x != x else x for x in old)
        out, new = _alerts(rows.itertuples(), old, percent, least, throttle)
        state.update(tuple(new))
        state.setTimeoutTimestamp(max(int(rows["ms"].max()), state.getCurrentWatermarkMs()) + idle * 1000)
        yield pd.DataFrame(out, columns=["symbol", "price", "baseline", "change_pct", "ts"])

    known = trades.where("ts IS NOT NULL").withWatermark("ts", late).select("symbol", "price", "ts", F.unix_millis("ts").alias("ms"))
    return known.groupBy("symbol").applyInPandasWithState(run, ALERT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
