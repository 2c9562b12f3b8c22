"""A stream of numbered ticks, as a Python data source: what drives everything that must be looked at again and again."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "quillscan_ticks"


class Part(InputPartition):
    """One bucket of the ticks after `start` up to `end`."""

    def __init__(self, start: int, end: int, bucket: int) -> None:
        super().__init__((start, end, bucket))


class Ticks(DataSource):
    """tick, bucket. The offset is the tick's number, so that a restart goes on where the last batch ended.

    With `last`, the ticks 1 to last are all due at once (a replay of polls that have landed). Without it, each trigger of the query has
    one tick, numbered by the milliseconds since the epoch, so that numbers go on growing over restarts. Each tick has a row for each of
    `buckets` partitions, by which its work is dealt out."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "tick long, bucket int"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Reader(dict(self.options))


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.last, self.buckets = options.get("last"), int(options.get("buckets", 1))

    def _now(self) -> int:
        return int(self.last) if self.last is not None else time.time_ns() // 1_000_000

    def initialOffset(self) -> dict:  # noqa: N802
        return {"tick": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"tick": self._now()}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        a, b = int(start["tick"]), int(end["tick"])
        return [Part(a if self.last is not None else max(a, b - 1), b, k) for k in range(self.buckets)] if b > a else []

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        a, b, bucket = part.value
        yield pa.RecordBatch.from_pydict({"tick": list(range(a + 1, b + 1)), "bucket": [bucket] * (b - a)}, pa.schema([("tick", pa.int64()), ("bucket", pa.int32())]))


def ticks(spark: SparkSession, last: int | None = None, buckets: int = 1) -> DataFrame:
    """The stream tick, bucket."""
    spark.dataSource.register(Ticks)
    reader = spark.readStream.format(NAME).option("buckets", str(buckets))
    return (reader if last is None else reader.option("last", str(last))).load()
