"""Growing log files as a stream named log_tail: whole lines appended since the last batch.

Options: path (a glob), seed (bytes of each file taken at the start, 0 for none, -1 for all; a first line cut by
it is left out). A file shorter than its offset was truncated and is read anew. An unfinished last line waits.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes read at a time while the last line end is looked for.
STEP = 1 << 16


@dataclass
class Tail(InputPartition):
    path: str
    start: int
    end: int


def _line_end(path: str, size: int, floor: int) -> int:
    """Offset after the last line end between floor and size; floor if there is none."""
    with open(path, "rb") as f:
        end = size
        while end > floor:
            begin = max(floor, end - STEP)
            f.seek(begin)
            at = f.read(end - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return floor


class LogTail(DataSourceStreamReader):
    def __init__(self, options):
        self.pattern, self.seed = options["path"], int(options.get("seed", -1))
        self.last: dict[str, int] = {}

    def _first(self, path: str, size: int) -> int:
        if self.seed < 0 or size <= self.seed:
            return 0
        with open(path, "rb") as f:
            f.seek(size - self.seed - 1)
            while (byte := f.read(1)) and byte != b"\n":
                pass
            return f.tell()

    def initialOffset(self) -> dict:
        return {p: self._first(p, os.path.getsize(p)) for p in sorted(glob.glob(self.pattern))}

    def latestOffset(self) -> dict:
        now = {}
        for path in sorted(glob.glob(self.pattern)):
            size, before = os.path.getsize(path), self.last.get(path, 0)
            now[path] = _line_end(path, size, 0 if size < before else before)
        self.last = now
        return now

    def partitions(self, start: dict, end: dict) -> list[Tail]:
        return [Tail(p, s if (s := start.get(p, 0)) <= e else 0, e) for p, e in end.items() if e != start.get(p, 0)]

    def read(self, tail: Tail) -> Iterator[tuple]:
        with open(tail.path, "rb") as f:
            f.seek(tail.start)
            while f.tell() < tail.end:
                yield tail.path, f.readline().rstrip(b"\r\n").decode("utf-8", "replace")


class LogTailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "path string, value string"

    def streamReader(self, schema) -> LogTail:
        return LogTail(self.options)


def tail_logs(spark: SparkSession, pattern: str, seed: int = -1) -> DataFrame:
    spark.dataSource.register(LogTailSource)
    return spark.readStream.format("log_tail").options(path=pattern, seed=seed).load()
