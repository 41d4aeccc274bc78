"""A data source for services that hand out rows in pages.

The page function is given by the caller, so the source works offline and in tests: ``fetch(symbol, cursor, limit)`` returns rows
as tuples of the schema. A symbol is one partition; paging stops at a short page, failures are retried over several bases.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Fetch = Callable[[str, int, int], list[tuple]]


def with_retry(bases: list[Fetch], tries: int = 3, wait: float = 0.0) -> Fetch:
    """A page function that asks each base in turn, several times, before it gives up."""

    def fetch(symbol: str, cursor: int, limit: int) -> list[tuple]:
        last: Exception | None = None
        for k in range(tries):
            for base in bases:
                try:
                    return base(symbol, cursor, limit)
                except OSError as e:
                    last = e
            time.sleep(wait * 2**k)
        raise last or OSError("no base")

    return fetch


def pages(fetch: Fetch, symbol: str, start: int, limit: int, key: int = 0, backward: bool = False) -> Iterator[tuple]:
    """Rows of one symbol from ``start`` on: forward from the last key + 1, or backward from the oldest key."""
    cursor = start
    while True:
        rows = fetch(symbol, cursor, limit)
        yield from rows
        if len(rows) < limit:
            return
        cursor = min(r[key] for r in rows) if backward else max(r[key] for r in rows) + 1


def paged_source(name: str, fetch: Fetch, symbols: list[str], schema: str, start: int = 0, limit: int = 1000, backward: bool = False) -> type[DataSource]:
    """A data source class for ``spark.dataSource.register``."""

    class Reader(DataSourceReader):
        def partitions(self):
            return [InputPartition(s) for s in symbols]

        def read(self, partition):
            for row in pages(fetch, partition.value, start, limit, backward=backward):
                yield (partition.value, *row)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "asset STRING, " + schema

        def reader(self, schema) -> DataSourceReader:
            return Reader()

    return Source


def read_paged(spark: SparkSession, *args, **kwargs) -> DataFrame:
    source = paged_source(*args, **kwargs)
    spark.dataSource.register(source)
    return spark.read.format(source.name()).load()
