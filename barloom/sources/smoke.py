"""Synthetic daily bars as a data source: ``spark.read.format("smoke_bars").option(...).load()``.

A ticker's series comes from a seed of its own, so that it is the same however many partitions the source has. Options: tickers
(comma-separated, or a number of names), start, end, seed, partitions. Rows are made where they are read; nothing passes the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "ticker string, date date, open double, high double, low double, close double, volume bigint"
#: First and last day, first price, spread of daily log returns and of the day's range, mean and spread of the logarithm of volume.
START, END, PRICE, RETURN, RANGE, VOLUME = "2014-01-02", "2024-06-01", 100.0, 0.01, 0.005, (14.0, 1.0)


class Tickers(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class SmokeReader(DataSourceReader):
    def __init__(self, options: dict):
        names = options.get("tickers", "AAPL")
        self.names = None if names.isdigit() else [n.strip() for n in names.split(",") if n.strip()]
        self.count = int(names) if self.names is None else len(self.names)
        self.start, self.end = options.get("start", START), options.get("end", END)
        self.seed, self.many = int(options.get("seed", "42")), max(1, int(options.get("partitions", "8")))

    def partitions(self) -> list[Tickers]:
        edges = [self.count * i // self.many for i in range(self.many + 1)]
        return [Tickers(a, b) for a, b in zip(edges, edges[1:], strict=False) if a < b] or [Tickers(0, 0)]

    def read(self, partition: Tickers) -> Iterator:
        import numpy as np
        import pandas as pd
        import pyarrow as pa

        days = pd.bdate_range(self.start, self.end)
        n = len(days)
        for i in range(partition.first, partition.last):
            name = f"T{i:06}" if self.names is None else self.names[i]
            rng = np.random.default_rng([self.seed, zlib.crc32(name.encode())])
            move = rng.standard_normal(n) * RETURN
            move[:1] = 0
            close = PRICE * np.exp(np.cumsum(move))
            opened = np.concatenate([[PRICE], close[:-1]])[:n]
            high = np.maximum(opened, close) * (1 + np.abs(rng.standard_normal(n)) * RANGE)
            low = np.minimum(opened, close) * (1 - np.abs(rng.standard_normal(n)) * RANGE)
            volume = rng.lognormal(*VOLUME, n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(days.date, pa.date32()), *map(pa.array, (opened, high, low, close, volume))], ["ticker", "date", "open", "high", "low", "close", "volume"])


class SmokeBars(DataSource):
    @classmethod
    def name(cls) -> str:
        return "smoke_bars"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SmokeReader:
        return SmokeReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SmokeBars)
