"""Rules with a memory: rate limits, quotes that expire, notices that are throttled.

A rule is a step from the state of a key and a row to the next state and what the row yields. Refused requests and throttled
notices leave no trace in the state, so that these are recursions and no window over all rows. The same step runs on a
table, where rows of a key pass in order of time, and on a stream, where the state is kept between batches by
``transformWithState`` and goes by a timer of event time once it can't matter any more. State is bounded for each key; a task
keeps one key's state at a time. A single key is one sequence and is not divided.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

SECOND = 1_000_000
DAY = 86_400 * SECOND
#: Streams with state of their own need this provider.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class RateLimit:
    """At most ``limit`` accepted calls within ``seconds``, ``burst`` within one second and ``daily`` a day of UTC; refused calls don't count.

    Yields for each call whether it is accepted, what refused it (window, burst or daily), how many calls the window has left, and when its oldest one leaves.
    """

    limit: int = 100
    seconds: int = 3600
    burst: int | None = None
    daily: int | None = None
    inputs = ()
    output = "allowed boolean, refused_by string, remaining int, reset long"
    state = "stamps array<bigint>, day bigint, used bigint"

    def step(self, state: tuple | None, ts: int, row: tuple) -> tuple[tuple | None, tuple | None]:
        stamps, day, used = state or ([], -1, 0)
        stamps = [t for t in stamps if t > ts - self.seconds * SECOND]
        if ts // DAY != day:
            day, used = ts // DAY, 0
        refused = "window" if len(stamps) >= self.limit else "burst" if self.burst is not None and sum(t > ts - SECOND for t in stamps) >= self.burst else "daily" if self.daily is not None and used >= self.daily else None
        before = len(stamps)
        if refused is None:
            stamps, used = [*stamps, ts], used + 1
        reset = ((stamps[0] if stamps else ts) + self.seconds * SECOND) // SECOND
        return (stamps, day, used), (refused is None, refused, max(0, self.limit - before - (refused is None)), reset)

    def until(self, ts: int) -> int:
        """When the state of a key that isn't seen again is void."""
        return max(ts + self.seconds * SECOND, ts + SECOND, (ts // DAY + 1) * DAY if self.daily is not None else 0)


@dataclass(frozen=True)
class Quote:
    """Rows with a price are quotes, rows without are reads: a read yields the newest quote that is younger than ``seconds``, else NULL."""

    seconds: int = 60
    inputs = ("price",)
    output = "price double, age_seconds double"
    state = "price double, quoted bigint"

    def step(self, state: tuple | None, ts: int, row: tuple) -> tuple[tuple | None, tuple | None]:
        (price,) = row
        if price is not None:
            return (price, ts), None
        fresh = state is not None and ts - state[1] < self.seconds * SECOND
        return state, (state[0], (ts - state[1]) / SECOND) if fresh else (None, None)

    def until(self, ts: int) -> int:
        return ts + self.seconds * SECOND


@dataclass(frozen=True)
class Mood:
    """An index of 0 to 100 and its last close: a notice at extremes and at moves of ``least`` points, once in ``throttle`` seconds."""

    least: float = 5.0
    low: float = 20.0
    high: float = 80.0
    throttle: int = 3600
    inputs = ("value", "previous")
    output = "type string, title string, value double, previous double"
    state = "told bigint"

    def step(self, state: tuple | None, ts: int, row: tuple) -> tuple[tuple | None, tuple | None]:
        value, previous = row
        if value is None or (state is not None and ts - state[0] < self.throttle * SECOND):
            return state, None
        if value <= self.low:
            notice = ("alert", "Extreme Fear in Market")
        elif value >= self.high:
            notice = ("alert", "Extreme Greed in Market")
        elif previous and abs(value - previous) >= self.least:
            notice = ("info", "Market Sentiment Rising" if value > previous else "Market Sentiment Falling")
        else:
            return state, None
        return (ts,), (*notice, value, previous)

    def until(self, ts: int) -> int:
        return ts + self.throttle * SECOND


@dataclass(frozen=True)
class PriceNotice:
    """A symbol's price against a former one: a notice at moves of ``percent`` or more, once in ``throttle`` seconds."""

    percent: float = 3.0
    throttle: int = 1800
    inputs = ("price", "previous")
    output = "type string, change_pct double, price double, previous double"
    state = "told bigint"

    def step(self, state: tuple | None, ts: int, row: tuple) -> tuple[tuple | None, tuple | None]:
        price, previous = row
        if not price or not previous or (state is not None and ts - state[0] < self.throttle * SECOND):
            return state, None
        change = (price - previous) / previous * 100
        if abs(change) < self.percent:
            return state, None
        return (ts,), ("gain" if change > 0 else "loss", change, price, previous)

    def until(self, ts: int) -> int:
        return ts + self.throttle * SECOND


Rule = RateLimit | Quote | Mood | PriceNotice


def _prepared(df: DataFrame, rule: Rule, key: str, ts: str, tie: str) -> DataFrame:
    return df.where(F.col(ts).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"), F.col(tie).alias("_tie"), *[F.col(c).cast("double").alias(c) for c in rule.inputs], F.col(ts).cast("timestamp").alias("_ts"))


def _schema(df: DataFrame, rule: Rule, key: str, ts: str, tie: str) -> str:
    kinds = dict(df.dtypes)
    return f"`{key}` {kinds[key]}, `{ts}` timestamp, `{tie}` {kinds[tie]}, {rule.output}"


class _Row:
    """A row by names, underscores and all."""

    __slots__ = ("__dict__",)

    def __init__(self, values: dict):
        self.__dict__ = values


def _rows(pdf: pd.DataFrame) -> Iterator[_Row]:
    names = list(pdf.columns)
    for values in zip(*[pdf[c].tolist() if pdf[c].dtype.kind != "M" else list(pdf[c]) for c in names], strict=True):
        yield _Row(dict(zip(names, values, strict=True)))


def _stepped(rule: Rule, state: tuple | None, r: _Row) -> tuple[tuple | None, tuple | None]:
    """A rule's step for a row, missing numbers as None."""
    return rule.step(state, r._us, tuple(None if getattr(r, c) != getattr(r, c) else getattr(r, c) for c in rule.inputs))


def on_table(rule: Rule, df: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """Key, time, ``tie`` and what the rule yields, for each row that yields. Rows at one time pass in order of ``tie``; those without key or time are left out."""
    schema = _schema(df, rule, key, ts, tie)
    columns = [key, ts, tie, *[c.split()[0] for c in rule.output.split(", ")]]
    ordered = _prepared(df, rule, key, ts, tie).repartition("_key").sortWithinPartitions("_key", "_us", "_tie")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for pdf in batches:
            out = []
            for r in _rows(pdf):
                if r._key != now:
                    now, state = r._key, None
                state, yielded = _stepped(rule, state, r)
                if yielded is not None:
                    out.append((now, r._ts, r._tie, *yielded))
            yield pd.DataFrame(out, columns=columns)

    return ordered.mapInPandas(run, schema)


class _Processor(StatefulProcessor):
    def __init__(self, rule: Rule, columns: list[str]):
        self.rule, self.columns = rule, columns

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("state", self.rule.state)
        self.due = handle.getValueState("due", "due bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # Columns come numbered, in the order of the input.
        pdf = pd.concat(list(rows)).set_axis(["_key", "_us", "_tie", *self.rule.inputs, "_ts"], axis=1).sort_values(["_us", "_tie"], kind="stable")
        state = tuple(self.kept.get()) if self.kept.exists() else None
        out = []
        for r in _rows(pdf):
            state, yielded = _stepped(self.rule, state, r)
            if yielded is not None:
                out.append((key[0], r._ts, r._tie, *yielded))
        if state is not None:
            self.kept.update(tuple(state))
            if self.due.exists():
                self.handle.deleteTimer(self.due.get()[0])
            # Only event time counts: the state goes once no row can come that it matters to.
            due = max(self.rule.until(int(pdf["_us"].max())) // 1000, timerValues.getCurrentWatermarkInMs()) + 1
            self.handle.registerTimer(due)
            self.due.update((due,))
        yield pd.DataFrame(out, columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        self.due.clear()
        yield pd.DataFrame([], columns=self.columns)

    def close(self) -> None:
        pass


def on_stream(rule: Rule, df: DataFrame, key: str, ts: str, tie: str, late: str = "1 hour") -> DataFrame:
    """The same on a stream. Rows later than ``late`` are left out; rows of a batch are put in order, those of later batches pass behind them."""
    spark = df.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != PROVIDER:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    columns = [key, ts, tie, *[c.split()[0] for c in rule.output.split(", ")]]
    known = _prepared(df, rule, key, ts, tie).withWatermark("_ts", late)
    return known.groupBy("_key").transformWithStateInPandas(_Processor(rule, columns), _schema(df, rule, key, ts, tie), "append", "EventTime")


def quotes_on_table(df: DataFrame, key: str, ts: str, tie: str, price: str, seconds: int = 60) -> DataFrame:
    """The quote rule without a recursion, for tables: the last price before a read is a window's."""
    w = W.partitionBy(key).orderBy(ts, tie)
    last = F.last(F.when(F.col(price).isNotNull(), F.struct(F.col(price).alias("p"), F.unix_micros(ts).alias("t"))), ignorenulls=True).over(w)
    met = df.withColumn("_last", last).where(F.col(price).isNull())
    age = (F.unix_micros(ts) - F.col("_last.t")) / SECOND
    return met.select(key, ts, tie, F.when(age < seconds, F.col("_last.p")).alias("price"), F.when(age < seconds, age).alias("age_seconds"))


#: Minutes of New York at which a session starts or ends, and what is told then.
SESSION_NOTICES = ((240, "market", "Pre-Market Open"), (570, "alert", "Market Open"), (960, "alert", "Market Closed"), (1200, "market", "After-Hours Closed"))
#: Minutes after such a moment in which it is still told.
TOLD_WITHIN = 5


def session_notices(ticks: DataFrame, ts: str) -> DataFrame:
    """Ticks of a clock -> (date, type, title, first): the notices of New York's weekdays, once a day each, at the first tick within five minutes."""
    local = F.from_utc_timestamp(F.col(ts).cast("timestamp"), "America/New_York")
    minute = F.hour(local) * 60 + F.minute(local)
    notice = F.lit(None).cast("struct<type:string,title:string>")
    for start, kind, title in SESSION_NOTICES:
        notice = F.when((minute >= start) & (minute < start + TOLD_WITHIN), F.struct(F.lit(kind).alias("type"), F.lit(title).alias("title"))).otherwise(notice)
    told = ticks.select(F.to_date(local).alias("date"), F.col(ts).cast("timestamp").alias("_ts"), notice.alias("_n"), F.weekday(local).alias("_day")).where("_n IS NOT NULL AND _day < 5")
    return told.groupBy("date", "_n.type", "_n.title").agg(F.min("_ts").alias("first"))
