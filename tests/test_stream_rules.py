"""Rules with a memory, on tables and on streams, against plain loops; state goes by event time."""

import datetime as dt
import random

import pytest

from barloom.streaming import rules

BEGIN = dt.datetime(2024, 1, 1, 23, 50)
REQUESTS = "client string, ts timestamp, id int"


def requests(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    at, out = BEGIN, []
    for i in range(400):
        at += dt.timedelta(milliseconds=rng.choice([0, 100, 300, 2000, 9000]))
        out.append((rng.choice("aaab"), at, i))
    return out


def plain_limits(rows, limit, seconds, burst, daily):
    accepted, out = {}, {}
    for client, ts, i in sorted(rows, key=lambda r: (r[1], r[2])):
        mine = accepted.setdefault(client, [])
        young = [t for t in mine if t > ts - dt.timedelta(seconds=seconds)]
        if len(young) >= limit:
            out[i] = (False, "window")
        elif burst is not None and sum(t > ts - dt.timedelta(seconds=1) for t in mine) >= burst:
            out[i] = (False, "burst")
        elif daily is not None and sum(t.date() == ts.date() for t in mine) >= daily:
            out[i] = (False, "daily")
        else:
            mine.append(ts)
            out[i] = (True, None)
        young = [t for t in mine if t > ts - dt.timedelta(seconds=seconds)]
        out[i] += (limit - len(young), int((min(young) if young else ts).replace(tzinfo=dt.UTC).timestamp() + seconds) if young else None)
    return out


LIMITS = [(10, 60, None, None), (10, 60, 2, None), (30, 20, 3, 70), (1000, 60, None, 5)]


@pytest.mark.parametrize("limits", LIMITS)
def test_limits_on_a_table(spark, limits):
    rows = requests(1)
    got = rules.on_table(rules.RateLimit(*limits), spark.createDataFrame(rows, REQUESTS).repartition(3), "client", "ts", "id").collect()
    want = plain_limits(rows, *limits)
    assert {r.id: (r.allowed, r.refused_by, r.remaining) for r in got} == {i: w[:3] for i, w in want.items()}
    assert all(w[3] is None or r.reset == w[3] for r in got for w in [want[r.id]])
    assert len({w[1] for w in want.values()}) > 1


def streamed(spark, folder, name, rule, batches, schema, key, tie, late="1 minute"):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}-in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{name}-in")
    q = rules.on_stream(rule, stream, key, "ts", tie, late).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/{name}").start()
    q.processAllAvailable()
    kept = q.lastProgress.stateOperators[0].numRowsTotal
    q.stop()
    return spark.table(name).collect(), kept


def test_limits_on_a_stream(spark, tmp_path):
    rows = requests(2)
    batches = [rows[i : i + 100] for i in range(0, 400, 100)]
    got, _ = streamed(spark, tmp_path, "limits", rules.RateLimit(10, 60, 2, 70), batches, REQUESTS, "client", "id")
    want = plain_limits(rows, 10, 60, 2, 70)
    assert {r.id: (r.allowed, r.refused_by, r.remaining) for r in got} == {i: w[:3] for i, w in want.items()}


QUOTES = "symbol string, ts timestamp, price double, id int"


def test_quotes_expire(spark, tmp_path):
    at = lambda s: BEGIN + dt.timedelta(seconds=s)
    rows = [("A", at(0), 10.0, 0), ("A", at(59), None, 1), ("A", at(60), None, 2), ("A", at(61), 11.0, 3), ("A", at(61), None, 4), ("B", at(61), None, 5), (None, at(61), 1.0, 6), ("B", None, 1.0, 7)]
    want = {1: 10.0, 2: None, 4: 11.0, 5: None}
    df = spark.createDataFrame(rows, QUOTES)
    assert {r.id: r.price for r in rules.on_table(rules.Quote(60), df, "symbol", "ts", "id").collect()} == want
    plain = df.where("symbol IS NOT NULL AND ts IS NOT NULL")
    assert {r.id: r.price for r in rules.quotes_on_table(plain, "symbol", "ts", "id", "price").collect()} == want
    # By event time: the state of A is gone once the watermark has passed its last quote by a minute.
    later = [[("C", at(600), 5.0, 8)], [("C", at(601), None, 9), ("A", at(602), None, 10)]]
    got, kept = streamed(spark, tmp_path, "quotes", rules.Quote(60), [rows[:3], rows[3:6], *later], QUOTES, "symbol", "id", "10 seconds")
    assert {r.id: r.price for r in got} == want | {9: 5.0, 10: None}
    _, many = streamed(spark, tmp_path, "many", rules.Quote(60), [[(f"S{i}", at(0), 1.0, i) for i in range(50)], [("X", at(5000), 1.0, 99)], [("Y", at(5001), 1.0, 100)], [("Y", at(5002), 1.0, 101)]], QUOTES, "symbol", "id", "10 seconds")
    assert many <= 12  # state and timers of X and Y; those of fifty symbols are gone


MOODS = "k string, ts timestamp, value double, previous double, id int"


def test_moods_are_throttled(spark, tmp_path):
    at = lambda m: BEGIN + dt.timedelta(minutes=m)
    rows = [("m", at(0), 50.0, 48.0, 0), ("m", at(1), 50.0, 45.0, 1), ("m", at(2), 10.0, 50.0, 2), ("m", at(60), 15.0, 50.0, 3), ("m", at(61), 20.0, 20.0, 4), ("m", at(121), 44.0, 50.0, 5), ("m", at(200), 80.0, None, 6), ("m", at(300), None, 5.0, 7), ("m", at(301), 50.0, 0.0, 8)]
    want = {1: "Market Sentiment Rising", 4: "Extreme Fear in Market", 5: "Market Sentiment Falling", 6: "Extreme Greed in Market"}
    assert {r.id: r.title for r in rules.on_table(rules.Mood(), spark.createDataFrame(rows, MOODS), "k", "ts", "id").collect()} == want
    got, _ = streamed(spark, tmp_path, "moods", rules.Mood(), [rows[:3], rows[3:5], rows[5:]], MOODS, "k", "id")
    assert {r.id: r.title for r in got} == want


def test_price_notices(spark):
    at = lambda m: BEGIN + dt.timedelta(minutes=m)
    rows = [("A", at(0), 102.99, 100.0, 0), ("A", at(1), 103.0, 100.0, 1), ("A", at(30), 90.0, 100.0, 2), ("A", at(31), 97.0, 100.0, 3), ("A", at(90), 1.0, 0.0, 4), ("A", at(91), 0.0, 5.0, 5), ("B", at(0), 50.0, 100.0, 6)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, price double, previous double, id int")
    assert {r.id: r.type for r in rules.on_table(rules.PriceNotice(), df, "symbol", "ts", "id").collect()} == {1: "gain", 3: "loss", 6: "loss"}
    assert rules.on_table(rules.PriceNotice(), df.limit(0), "symbol", "ts", "id").count() == 0


def test_session_notices(spark):
    utc = lambda *a: dt.datetime(*a)
    rows = [utc(2024, 1, 5, 14, 29), utc(2024, 1, 5, 14, 31), utc(2024, 1, 5, 14, 30), utc(2024, 1, 5, 14, 35), utc(2024, 1, 6, 14, 30), utc(2024, 7, 5, 13, 30), utc(2024, 7, 5, 20, 4), utc(2024, 7, 6, 0, 2), utc(2024, 7, 5, 8, 0)]
    got = {(str(r.date), r.title): str(r.first)[11:16] for r in rules.session_notices(spark.createDataFrame([(r,) for r in rows], "ts timestamp"), "ts").collect()}
    assert got == {("2024-01-05", "Market Open"): "14:30", ("2024-07-05", "Market Open"): "13:30", ("2024-07-05", "Market Closed"): "20:04", ("2024-07-05", "After-Hours Closed"): "00:02", ("2024-07-05", "Pre-Market Open"): "08:00"}
