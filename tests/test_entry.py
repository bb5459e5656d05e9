"""Every query has a plan, and those with SQL agree with it on the smallest tables."""

import math
import os

import duckdb
import pytest

from barloom.plans import catalog, gauges, learned, more, panels

SMALL = "/root/testdata/sf0.001"
SHOWN = ("ohlcv_panel", "rsi", "regime_score", "asof_earnings", "sentiment_blend", "psi", "sankey_nodes", "event_sessions", "xs_rank_quintile", "walk_forward_labels")

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SMALL):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SMALL}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted({*SHOWN, "portfolio_exits", *more.ORACLES, *gauges.ORACLES, *panels.ORACLES, "filing_confidence", *(set(learned.ORACLES) - {"feature_matrix"})}))
def test_query_agrees_with_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    want = sorted(duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({catalog.ORACLES[name]})").fetchall(), key=str)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert all(a == b or isinstance(a, (int, float)) and math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6) for a, b in zip(g, w, strict=True)), (g, w)


def test_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(catalog.QUERIES) > 100


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
