"""Registered queries and their SQL."""

from __future__ import annotations

from barloom.plans import adapters, gauges, learned, market, more, panels, reports

QUERIES: dict = {}
ORACLES: dict = {}
for _part in (market, adapters, reports, more, gauges, learned, panels):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES

flagship = market.top_of_last_day
