"""A search-console table as a data source with pages of rows, read from an archive of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "query string, page string, clicks bigint, impressions bigint, ctr double, position double"


class Offset(InputPartition):
    def __init__(self, start: int, count: int):
        self.start, self.count = start, count


class ConsoleReader(DataSourceReader):
    """Rows `total`, in requests of `page_size` (25,000, what the service gives at once); a request is a task."""

    def __init__(self, options):
        self.total, self.size = int(options.get("total", 0)), int(options.get("page_size", 25_000))
        self.client = options.get("client")

    def partitions(self):
        return [Offset(i, min(self.size, self.total - i)) for i in range(0, self.total, self.size)]

    def read(self, partition):
        import importlib

        module, _, name = self.client.rpartition(":")
        for r in getattr(importlib.import_module(module), name)(partition.start, partition.count):
            yield (r["query"], r["page"], int(r["clicks"]), int(r["impressions"]), float(r["ctr"]), float(r["position"]))


class SearchConsole(DataSource):
    @classmethod
    def name(cls):
        return "search_console"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ConsoleReader(self.options)


def read_console(spark: SparkSession, client: str, total: int, page_size: int = 25_000) -> DataFrame:
    """client is module:function(start, count) that yields rows."""
    spark.dataSource.register(SearchConsole)
    return spark.read.format("search_console").option("client", client).option("total", total).option("page_size", page_size).load()


def sample_rows(start: int, count: int):
    """An archive of made-up rows, for tests."""
    for i in range(start, start + count):
        yield {"query": f"q{i % 7}", "page": f"https://a.example/{i % 5}", "clicks": i % 3, "impressions": 10 + i % 11, "ctr": (i % 3) / (10 + i % 11), "position": 1.0 + i % 9}
