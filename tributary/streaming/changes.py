"""Bounded change streams: operation mapping, ranges of positions, and Structured Streaming runs that end by themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions.rowid import OP_TYPE, change_op, envelope


def between(changes: DataFrame, position: str, after: object, until: object) -> DataFrame:
    """Changes after a position up to another one, both pinned before reading."""
    test = F.col(position) <= F.lit(until)
    return changes.where(test if after is None else test & (F.col(position) > F.lit(after)))


def stamp(changes: DataFrame, keys: list[str], kind: str, changed_at: Column, overlap: bool, ingested_at=None) -> DataFrame:
    """Changes with their envelope: insert, update and delete as operations."""
    return envelope(changes, keys, change_op(F.col(kind), overlap), ingested_at, changed_at).where(F.col(OP_TYPE).isNotNull())


def pinned_end(changes: DataFrame, position: str) -> object:
    return changes.agg(F.max(position)).head()[0]


def run_available(stream: DataFrame, each_batch: Callable[[DataFrame, str], None], checkpoint: str, name: str) -> None:
    """Process what a streaming source has now, each micro-batch under an id that a repeated run gives again, then stop."""
    query = stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, i: each_batch(df, f"{name}_{i}")).start()
    query.awaitTermination()
