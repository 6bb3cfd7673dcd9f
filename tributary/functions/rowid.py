"""Row ids and the envelope of system columns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW_ID, OP_TYPE, INGESTED_AT, CDC_TIMESTAMP = "_row_id", "_op_type", "_ingested_at", "_cdc_timestamp"
SYSTEM_COLUMNS = (ROW_ID, OP_TYPE, INGESTED_AT, CDC_TIMESTAMP)
SNAPSHOT, OVERLAP_INSERT, CREATE, UPDATE, DELETE = "r", "i", "c", "u", "d"
_NULL_TEXT = "<nil>"


def canonical_text(df: DataFrame, name: str) -> Column:
    """A value's text in ids: whole floats without fraction, timestamps ISO in UTC with microseconds, nested values JSON, nulls marked."""
    from tributary.functions.coerce import to_string

    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    text = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") if isinstance(kind, T.TimestampType | T.TimestampNTZType) else to_string(c, kind)
    return F.coalesce(text, F.lit(_NULL_TEXT))


def row_id(df: DataFrame, keys: list[str]) -> Column:
    """One key: its text. Several: md5 over their values in order of name, each followed by a bar. None: md5 over all columns."""
    present = sorted(k for k in keys if k in df.columns)
    if len(present) == 1:
        return canonical_text(df, present[0])
    parts = [p for k in (present or sorted(c for c in df.columns if c not in SYSTEM_COLUMNS)) for p in (canonical_text(df, k), F.lit("|"))]
    return F.md5(F.concat(*parts))


def envelope(df: DataFrame, keys: list[str], op: str | Column = SNAPSHOT, ingested_at: dt.datetime | Column | None = None, changed_at: Column | None = None) -> DataFrame:
    """df with its row id, operation, time of ingestion and time of change (the epoch for snapshots)."""
    now = F.current_timestamp() if ingested_at is None else ingested_at if isinstance(ingested_at, Column) else F.lit(ingested_at)
    return df.withColumns({ROW_ID: row_id(df, keys), OP_TYPE: F.lit(op) if isinstance(op, str) else op, INGESTED_AT: now, CDC_TIMESTAMP: F.timestamp_seconds(F.lit(0)) if changed_at is None else changed_at})


def stored_op(c: Column) -> Column:
    """Inserts that overlap a snapshot are stored as plain creations."""
    return F.when(c == OVERLAP_INSERT, CREATE).otherwise(c)


def change_op(kind: Column, overlap: bool) -> Column:
    """Operation of an insert, update or delete; inserts are marked while they may repeat a snapshot's rows."""
    return F.when(kind == "insert", OVERLAP_INSERT if overlap else CREATE).when(kind.isin("update", "replace"), UPDATE).when(kind == "delete", DELETE)
