"""A search index that answers at most so many hits as a Spark source: windows are halved until they fit."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LIMIT = 10_000
RETRIED = (429, 502, 503, 504)


class Refused(Exception):
    """An answer with an HTTP status."""

    def __init__(self, status: int) -> None:
        super().__init__(f"status {status}")
        self.status = status


def with_retries(call: Callable, tries: int = 6, first_wait: float = 1.0, sleep: Callable[[float], None] = time.sleep):
    """The call's result; a passing refusal is tried again, each time after twice the wait."""
    for attempt in range(tries):
        try:
            return call()
        except Refused as e:
            if e.status not in RETRIED or attempt == tries - 1:
                raise
            sleep(first_wait * 2**attempt)


def bisected(search: Callable[[int, int, int], list], low: int, high: int, limit: int = LIMIT) -> Iterator[tuple]:
    """All hits in [low, high): a window whose answer is full is halved; a window of one unit is taken as it is."""
    hits = with_retries(lambda: search(low, high, limit))
    if len(hits) >= limit and high - low > 1:
        middle = (low + high) // 2
        yield from bisected(search, low, middle, limit)
        yield from bisected(search, middle, high, limit)
    else:
        yield from hits


class Window(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, options: dict, client: Callable) -> None:
        self.low, self.high = int(options["low"]), int(options["high"])
        self.step, self.limit, self.client = int(options.get("step", 86_400)), int(options.get("limit", LIMIT)), client

    def partitions(self):
        return [Window(a, min(a + self.step, self.high)) for a in range(self.low, self.high, self.step)]

    def read(self, partition):
        yield from bisected(self.client, partition.low, partition.high, self.limit)


def source(name: str, schema: str, client: Callable[[int, int, int], list]) -> type[DataSource]:
    """A data source class for ``spark.dataSource.register``: one partition per ``step`` of time units.

    ``client(low, high, limit)`` gives the hits of a window as tuples in the order of ``schema``.
    """

    class SearchIndex(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema):  # noqa: ARG002
            return _Reader(self.options, client)

    return SearchIndex
