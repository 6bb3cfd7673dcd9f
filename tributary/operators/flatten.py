"""Layouts of landed rows: normalized columns, nested values as JSON; or one JSON column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions.rowid import SYSTEM_COLUMNS


def flatten(df: DataFrame, native: bool = False) -> DataFrame:
    """One level: structs, maps and arrays become compact JSON, bytes text, decimals doubles, dates timestamps."""
    if native:
        return df
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StructType | T.MapType | T.ArrayType):
            c = F.to_json(c)
        elif isinstance(f.dataType, T.BinaryType):
            c = F.coalesce(F.try_validate_utf8(c.cast("string")), F.base64(c))
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("timestamp")
        out.append(c.alias(f.name))
    return df.select(*out)


def raw_json(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One column ``data`` with all values as JSON, names sorted and nulls kept, beside system and partition columns."""
    system = [c for c in df.columns if c in SYSTEM_COLUMNS or c in keep]
    values = sorted(c for c in df.columns if c not in SYSTEM_COLUMNS)
    return df.select(F.to_json(F.struct(*values), {"ignoreNullFields": "false"}).alias("data"), *system)
