"""Append and upsert by row id, with tombstones.

The last event of a key in a batch wins, whatever its operation; earlier rows of the key go, and a delete stays as a
row of its own. Keys are global, so a row whose partition changes leaves no copy behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.functions.rowid import DELETE, OP_TYPE, ROW_ID, stored_op


def latest(batch: DataFrame, order: list[str], key: str = ROW_ID) -> DataFrame:
    """The last event of each key by position: an aggregate with map-side combine, so a hot key is one row in the shuffle."""
    rest = [c for c in batch.columns if c != key]
    top = batch.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__last"))
    return top.select(*[F.col(key) if c == key else F.col("__last")[c].alias(c) for c in batch.columns])


def upsert(target: DataFrame, batch: DataFrame, order: list[str], key: str = ROW_ID, unique: bool = False) -> DataFrame:
    """target without the batch's keys, and the batch's last events."""
    last = batch if unique else latest(batch, order, key)
    last = last.withColumn(OP_TYPE, stored_op(F.col(OP_TYPE)))
    return target.join(last.select(key), key, "left_anti").unionByName(last.select(*target.columns) if set(target.columns) <= set(last.columns) else last, allowMissingColumns=True)


def append(target: DataFrame, batch: DataFrame) -> DataFrame:
    return target.unionByName(batch.withColumn(OP_TYPE, stored_op(F.col(OP_TYPE))), allowMissingColumns=True)


def current(table: DataFrame) -> DataFrame:
    """Rows that are not tombstones."""
    return table.where(F.col(OP_TYPE) != DELETE)


def write_mode(backfill: bool, append_mode: bool, has_identifier: bool) -> str:
    return "append" if backfill or append_mode or not has_identifier else "upsert"


def duplicates(table: DataFrame, key: str = ROW_ID) -> DataFrame:
    """One row: rows and different keys."""
    return table.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(key).alias("n_keys"))
