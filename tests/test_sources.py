"""Candidate paths, the generator, merged tables with manifests, keywords in events."""

import datetime as dt
import json
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import news
from barloom.sources import paths, sinks, smoke


def test_records_at_candidate_paths(spark):
    new = {"settlementDate": "01/31/2024", "interest": "1,234", "avgDailyShareVolume": "$5,000", "daysToCover": 1.5}
    old = {"date": "2024-02-15", "shortInterest": 99, "avgDailyShareVolumeInThousands": 7, "daysToCoVerShortInterest": "2.25"}
    documents = [
        ("new", {"data": {"shortInterestTable": {"rows": [new, old, "odd", {"interest": "many"}, {}]}}, "rows": [old]}), ("list", {"data": [old]}), ("nested", {"data": {"rows": [new]}}), ("empty", {"data": [], "results": [old]}),
        ("late", {"table": {"rows": [old]}}), ("none", {"data": None}), ("long", {"rows": [{"date": f"2024-01-{d:02}", "interest": d} for d in range(1, 26)]}),
    ]
    rows = [(k, json.dumps(d)) for k, d in documents] + [("bad", "{"), ("null", None)]
    got = {}
    for r in paths.short_interest(spark.createDataFrame(rows, "k string, j string"), "k", "j").orderBy("k", "place").collect():
        got.setdefault(r.k, []).append((r.settlement_date, r.short_interest, r.avg_daily_volume, r.days_to_cover))
    a, b = ("01/31/2024", 1234, 5000, 1.5), ("2024-02-15", 99, 7, 2.25)
    assert got["new"] == [a, b, (None, 0, 0, 0.0)] and got["list"] == [b] and got["nested"] == [a] and got["empty"] == [b] and got["late"] == [b]
    assert len(got["long"]) == 20 and got["long"][0][1] == 6 and set(got) == {"new", "list", "nested", "empty", "late", "long"}


def test_probed_fields(spark):
    df = spark.createDataFrame([('{"a": {"b": 2}}',), ('{"b": "x", "c": 3}',), ("no",), (None,)], "j string")
    assert [r.v for r in paths.probed(df, "j", {"v": (("a.b", "b", "c"), "int")}).collect()] == [2, 3, None, None]


def test_generator_is_the_same_in_any_partitioning(spark):
    smoke.register(spark)
    read = lambda **o: spark.read.format("smoke_bars").options(**o).load()
    one, many = (sorted(map(tuple, read(tickers="7", partitions=str(n), end="2014-03-01").collect())) for n in (1, 5))
    assert one == many and len(one) == 7 * 42
    a, b = (read(tickers=t, seed="1", end="2014-02-01").where("ticker = 'MSFT'").orderBy("date").collect() for t in ("MSFT", "AAPL, MSFT"))
    assert a == b and a[0].open == 100.0 and a[0].close == 100.0
    assert all(r.low <= min(r.open, r.close) <= max(r.open, r.close) <= r.high and r.volume > 0 and r.date.weekday() < 5 for r in a)
    assert all(x.close == y.open for x, y in zip(a, a[1:], strict=False))
    assert read(tickers="MSFT", seed="2", end="2014-02-01").where("ticker = 'MSFT'").orderBy("date").collect() != a
    assert read(tickers="0").count() == 0


KIND = "k string, date date, v int, at int"


def rows(spark, *r):
    return spark.createDataFrame([(k, dt.date(2024, 1, d) if d else None, v, at) for k, d, v, at in r], KIND)


def state(spark, root, version=None):
    return sorted((r.k, r.date.day if r.date else 0, r.v) for r in sinks.read_table(spark, root, version).collect())


def test_merges_are_whole_or_absent(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "table")
    assert sinks.read_table(spark, root) is None and sinks.versions(spark, root) == []
    assert sinks.merge_into(root, rows(spark, ("a", 1, 1, 1), ("b", 1, 2, 1), ("c", 2, 3, 1), ("n", None, 9, 1)), ["k", "date"], "at") == 1
    first = [("a", 1, 1), ("b", 1, 2), ("c", 2, 3), ("n", 0, 9)]
    assert state(spark, root) == first
    kept = sinks.manifest(spark, root)["partitions"]["2024-01-02"]
    # b is newer, a older than what is there, d new; the second day isn't touched.
    assert sinks.merge_into(root, rows(spark, ("a", 1, 50, 0), ("b", 1, 20, 1), ("d", 1, 4, 0)), ["k", "date"], "at") == 2
    assert state(spark, root) == [("a", 1, 1), ("b", 1, 20), ("c", 2, 3), ("d", 1, 4), ("n", 0, 9)] and state(spark, root, 1) == first
    assert sinks.manifest(spark, root)["partitions"]["2024-01-02"] == kept
    sinks.verify(spark, root)
    sinks.verify(spark, root, 1)
    # A write that dies before its manifest leaves the version before readable, and goes with the next clean-up.
    with monkeypatch.context() as m:
        m.setattr(sinks, "hashes", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            sinks.merge_into(root, rows(spark, ("a", 1, 99, 9)), ["k", "date"], "at")
    assert sinks.versions(spark, root) == [1, 2] and ("a", 1, 1) in state(spark, root)
    # Two writers of one version: the second one fails and changes nothing.
    with monkeypatch.context() as m:
        m.setattr(sinks, "versions", lambda s, r: [1])
        with pytest.raises(sinks.Conflict):
            sinks.merge_into(root, rows(spark, ("a", 1, 99, 9)), ["k", "date"], "at")
    assert ("a", 1, 1) in state(spark, root)
    gone = sinks.vacuum(spark, root, kept=1)
    assert "1.json" in gone and sum(g.startswith("data-") for g in gone) == 2 and state(spark, root)[0] == ("a", 1, 1)
    sinks.verify(spark, root)
    file = next(p for p in pathlib.Path(root).rglob("*.parquet"))
    file.write_bytes(file.read_bytes() + b"x")
    (file.parent / f".{file.name}.crc").unlink()
    with pytest.raises(sinks.Damaged):
        sinks.verify(spark, root)
    assert sinks.merge_into(root, rows(spark).limit(0), ["k", "date"], "at") == 3  # nothing to merge


def test_models_are_checked(spark, tmp_path):
    from pyspark.ml.feature import VectorAssembler

    root = str(tmp_path / "model")
    assert sinks.save_model(spark, VectorAssembler(inputCols=["a"], outputCol="v"), root) == 1
    assert sinks.save_model(spark, VectorAssembler(inputCols=["b"], outputCol="v"), root) == 2
    assert sinks.load_model(spark, VectorAssembler, root).getInputCols() == ["b"] and sinks.load_model(spark, VectorAssembler, root, 1).getInputCols() == ["a"]
    for part in list(pathlib.Path(root).rglob("part-*")):
        part.write_text("{}")
        (part.parent / f".{part.name}.crc").unlink()
    with pytest.raises(sinks.Damaged):
        sinks.load_model(spark, VectorAssembler, root)
    with pytest.raises(sinks.Damaged):
        sinks.load_model(spark, VectorAssembler, str(tmp_path / "none"))


def test_events_meet_keywords(spark):
    rng = random.Random(6)
    words = ["cpi", "core", "ai", "gdp", "fed", "rate", "sales", "retail", "oil", "é", "x"]
    names = [" ".join(rng.choice([w, w.upper()]) for w in rng.choices(words, k=rng.randrange(0, 5))) for _ in range(200)] + [None, "", "Main", "cp", "aI"]
    events = [(i, n, rng.choice(["high", "low", None])) for i, n in enumerate(names)]
    keywords = [("CPI", ["A", "B"]), ("core cpi", ["C"]), ("ai", ["D", "Z"]), ("retail sales", ["A", "E"]), ("x", ["X"]), ("é", ["F"]), ("nowhere at all", ["A"]), ("", ["A"]), ("rate", [])]
    universe = ["A", "B", "C", "D", "E", "F", "SPY", "DIA"]
    df = spark.createDataFrame(events, "id int, event string, importance string").repartition(3)
    got = news.matched_events(df, spark.createDataFrame(keywords, "keyword string, tickers array<string>"), spark.createDataFrame([(u,) for u in universe], "ticker string"))
    assert got.columns == ["id", "event", "importance", "tickers"]
    for r in got.collect():
        name, importance = events[r.id][1:]
        found = {t for k, ts in keywords if k and name and k.lower() in name.lower() for t in ts}
        if not found and importance == "high":
            found = {"SPY", "QQQ", "IWM", "DIA"}
        assert r.tickers == sorted(found & set(universe)), r
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("BroadcastNestedLoopJoin") <= 1 and "CartesianProduct" not in plan  # the one row of the broad market
    one = news.events_of(got, spark.createDataFrame([("A",)], "ticker string")).select("id").distinct()
    assert one.count() == got.where(F.array_contains("tickers", "A")).count() > 0
    assert news.matched_events(df, spark.createDataFrame([], "keyword string, tickers array<string>"), spark.createDataFrame([("SPY",)], "ticker string")).where("importance = 'high' AND size(tickers) = 1").count() > 0
