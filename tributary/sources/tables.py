"""Parquet tables with a change log beside them: the offline stand-in for a database with change capture.

``<path>/<table>.parquet`` is a table, ``<path>/<table>.changes.parquet`` its changes: the table's columns with
``__kind`` (insert, update, delete), ``__position`` (ascending) and ``__at`` (time of the transaction).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tributary import types as S
from tributary.catalog import CDC, FULL_REFRESH, INCREMENTAL, STRICT_CDC, Stream
from tributary.operators.chunks import Chunk, even_int
from tributary.sources.base import Source, register
from tributary.streaming.changes import between, pinned_end


@register("tables")
class TableSource(Source):
    options = {"path": "string!", "tables": "array!", "keys": "object", "chunk_rows": "integer"}

    def discover(self) -> list[Stream]:
        out = []
        for name in self.config["tables"]:
            s = Stream(name, "", {}, [FULL_REFRESH, INCREMENTAL, CDC, STRICT_CDC], self.config.get("keys", {}).get(name, []))
            s.schema = {f.name: S.from_spark(f.dataType) for f in self.table(s).schema}
            s.cursor_candidates = sorted(s.schema)
            out.append(s)
        return out

    def table(self, stream: Stream) -> DataFrame:
        return self.spark.read.parquet(f"{self.config['path']}/{stream.name}.parquet")

    def chunks(self, stream: Stream) -> list[Chunk]:
        rows = self.config.get("chunk_rows")
        if not rows or len(stream.primary_key) != 1:
            return [Chunk()]
        low, high, n = self.table(stream).selectExpr(f"min({stream.primary_key[0]})", f"max({stream.primary_key[0]})", "count(*)").head()
        return even_int(low, high, n, rows) if n and isinstance(low, int) else [Chunk()]

    def _log(self, stream: Stream) -> DataFrame:
        return self.spark.read.parquet(f"{self.config['path']}/{stream.name}.changes.parquet")

    def end_position(self, stream: Stream):
        return pinned_end(self._log(stream), "__position")

    def changes(self, stream: Stream, after, until) -> DataFrame:
        return between(self._log(stream), "__position", after, until)
