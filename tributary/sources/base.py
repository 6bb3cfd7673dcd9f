"""What a source offers; sources are found by name in a registry."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.catalog import Stream
from tributary.operators.chunks import Chunk, scan
from tributary.operators.cursors import maxima, newer

REGISTRY: dict[str, type] = {}


def register(name: str):
    def add(cls):
        REGISTRY[name] = cls
        cls.kind = name
        return cls

    return add


class Source(ABC):
    """discover names streams; scan reads a chunk of one; changes reads a bounded range of its change log."""

    kind = ""
    #: Configuration keys with their JSON types, for ``spec``.
    options: dict[str, str] = {}

    def __init__(self, spark: SparkSession, config: dict):
        self.spark, self.config = spark, config
        missing = [k for k, t in self.options.items() if t.endswith("!") and k not in config]
        if missing:
            raise ValueError(f"{self.kind} needs {missing}")

    @classmethod
    def spec(cls) -> dict:
        return {"type": "object", "title": cls.kind, "required": [k for k, t in cls.options.items() if t.endswith("!")], "properties": {k: {"type": t.rstrip("!")} for k, t in cls.options.items()}}

    def check(self) -> None:
        self.discover()

    @abstractmethod
    def discover(self) -> list[Stream]: ...

    @abstractmethod
    def table(self, stream: Stream) -> DataFrame:
        """All rows, unread; Catalyst pushes columns and filters into it."""

    def chunks(self, stream: Stream) -> list[Chunk]:
        return [Chunk()]

    def scan(self, stream: Stream, chunk: Chunk) -> DataFrame:
        return scan(self.table(stream), stream.primary_key or [self.table(stream).columns[0]], chunk)

    def scan_many(self, stream: Stream, chunks: list[Chunk]) -> DataFrame:
        """Consecutive chunks as one scan: from where the first begins to where the last ends."""
        return self.scan(stream, Chunk(chunks[0].low, chunks[-1].high))

    def max_cursor(self, stream: Stream, cursors: list[str]) -> dict:
        return maxima(self.table(stream), cursors).head().asDict()

    def incremental(self, stream: Stream, last: dict) -> DataFrame:
        names = stream.cursor.split(":")
        return self.table(stream).where(newer(names[0], last[names[0]], *(x for n in names[1:] for x in (n, last[n]))))

    def changes(self, stream: Stream, after: object, until: object) -> DataFrame:
        raise NotImplementedError(f"{self.kind} has no change log")

    def end_position(self, stream: Stream) -> object:
        raise NotImplementedError(f"{self.kind} has no change log")


def cast_literal(value: object, kind: str):
    return F.lit(value).cast(kind)
