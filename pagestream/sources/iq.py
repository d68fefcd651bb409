"""Raw I/Q captures (headerless pairs of little-endian float32) as a data source named iq, batch and stream.

Options: path (a file), rate (samples a second), chunk (samples to a row), split (bytes to a partition). Rows:
carrier, start (its first sample), rate, n, iq (the bytes of n samples). A trailing partial sample is left out.
The path is read where executors run, so it must be on storage that all of them mount.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SAMPLE = 8
SCHEMA = "carrier long, start long, rate double, n int, iq binary"


@dataclass
class Span(InputPartition):
    """Samples from start up to end."""

    start: int
    end: int


def _spans(start: int, end: int, step: int) -> list[Span]:
    return [Span(s, min(s + step, end)) for s in range(start, end, step)] or [Span(end, end)]


class _Reading:
    def __init__(self, options):
        self.path, self.carrier = options["path"], int(options.get("carrier", 0))
        self.rate = float(options.get("rate", 2_500_000))
        self.chunk = int(options.get("chunk", 65_536))
        self.step = max(1, int(options.get("split", 64 << 20)) // SAMPLE // self.chunk) * self.chunk

    def end(self) -> int:
        return os.path.getsize(self.path) // SAMPLE

    def read(self, span: Span) -> Iterator[tuple]:
        with open(self.path, "rb") as f:
            f.seek(span.start * SAMPLE)
            for start in range(span.start, span.end, self.chunk):
                n = min(self.chunk, span.end - start)
                yield self.carrier, start, self.rate, n, f.read(n * SAMPLE)


class IQReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Span]:
        return _spans(0, self.end(), self.step)


class IQStream(_Reading, DataSourceStreamReader):
    """Each batch takes what was appended since; bytes already there are the first batch."""

    def initialOffset(self) -> dict:
        return {"sample": 0}

    def latestOffset(self) -> dict:
        return {"sample": self.end()}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return _spans(start["sample"], end["sample"], self.step)


class IQSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "iq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> IQReader:
        return IQReader(self.options)

    def streamReader(self, schema) -> IQStream:
        return IQStream(self.options)


def read_iq(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(IQSource)
    return spark.read.format("iq").options(path=path, **options).load()


def stream_iq(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(IQSource)
    return spark.readStream.format("iq").options(path=path, **options).load()
