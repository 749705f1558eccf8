"""A paged API as a source that Spark reads: ``spark.read.format(name)``, or ``spark.readStream``.

A reader asks the API how many items there are and makes a partition of each page, which the executors ask for; equality with a value of one of the
API's own parameters is asked of the API, and other filters stay with Spark (``spark.sql.python.filterPushdown.enabled``). Spark keeps what was pushed down with what load() gave, so a plan that
filters the source in one place and not, or otherwise, in another needs a load() for each. The option
``limit`` takes the first items only, as when a source is tried out. A stream's offset is the number of items that it has seen, so an API
whose new items come last is read on where the stream stopped.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: page(offset, size, parameters) -> (how many items there are in all, the page's items as JSON objects)
Page = Callable[[int, int, dict], tuple[int, list[str]]]


class Slice(InputPartition):
    def __init__(self, offset: int, size: int):
        super().__init__(offset)
        self.offset, self.size = offset, size


def slices(start: int, end: int, size: int) -> list[Slice]:
    return [Slice(k, min(size, end - k)) for k in range(start, end, size)]


def rows(page: Page, schema: T.StructType, part: Slice, asked: dict) -> Iterator[tuple]:
    """The items of a page as rows; what an item lacks is null, and what the API was asked for is as asked."""
    for item in page(part.offset, part.size, asked)[1]:
        found = json.loads(item) | asked
        yield tuple(found.get(f) for f in schema.names)


class PageReader(DataSourceReader):
    def __init__(self, page: Page, schema: T.StructType, keys: tuple[str, ...], size: int, limit: int | None):
        self.page, self.schema, self.keys, self.size, self.limit, self.asked = page, schema, keys, size, limit, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in self.keys and f.attribute[0] not in self.asked:
                self.asked[f.attribute[0]] = f.value
            else:
                yield f

    def partitions(self) -> list[Slice]:
        total, _ = self.page(0, 1, self.asked)
        return slices(0, total if self.limit is None else min(total, self.limit), self.size) or [Slice(0, 0)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        return rows(self.page, self.schema, partition, self.asked) if partition.size else iter(())


class PageStream(DataSourceStreamReader):
    def __init__(self, page: Page, schema: T.StructType, size: int):
        self.page, self.schema, self.size = page, schema, size

    def initialOffset(self) -> dict:
        return {"seen": 0}

    def latestOffset(self) -> dict:
        return {"seen": self.page(0, 1, {})[0]}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        return slices(start["seen"], end["seen"], self.size)

    def read(self, partition: Slice) -> Iterator[tuple]:
        return rows(self.page, self.schema, partition, {})

    def commit(self, end: dict) -> None:
        pass


def register(spark: SparkSession, name: str, page: Page, schema: str, keys: tuple[str, ...] = (), size: int = 100) -> None:
    """Makes an API readable under a name. keys: columns whose values the API itself can be asked for; size: items a page, the option ``size`` of a read."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema: T.StructType) -> DataSourceReader:
            limit = self.options.get("limit")
            return PageReader(page, schema, keys, int(self.options.get("size", size)), None if limit is None else int(limit))

        def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
            return PageStream(page, schema, int(self.options.get("size", size)))

    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(Source)
