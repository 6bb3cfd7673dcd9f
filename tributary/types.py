"""The type lattice of streams: names, Spark types, the least common ancestor of two types, and identifiers."""

from __future__ import annotations

import re

from pyspark.sql import types as T

# The names that catalogs carry.
NULL, BOOL, INT32, INT64 = "null", "boolean", "integer_small", "integer"
FLOAT32, FLOAT64, STRING = "number_small", "number", "string"
TIMESTAMP, TIMESTAMP_MILLI, TIMESTAMP_MICRO, TIMESTAMP_NANO = "timestamp", "timestamp_milli", "timestamp_micro", "timestamp_nano"
OBJECT, ARRAY, UNKNOWN = "object", "array", "unknown"

#: Each type's next wider one; string is the root.
PARENT = {
    BOOL: INT32, INT32: INT64, INT64: FLOAT64, FLOAT32: FLOAT64, FLOAT64: STRING,
    TIMESTAMP: TIMESTAMP_MILLI, TIMESTAMP_MILLI: TIMESTAMP_MICRO, TIMESTAMP_MICRO: TIMESTAMP_NANO, TIMESTAMP_NANO: STRING, STRING: None,
}
ALL_TYPES = (BOOL, INT32, INT64, FLOAT32, FLOAT64, STRING, TIMESTAMP, TIMESTAMP_MILLI, TIMESTAMP_MICRO, TIMESTAMP_NANO, OBJECT, ARRAY, NULL, UNKNOWN)
_SPARK = {
    BOOL: T.BooleanType(), INT32: T.IntegerType(), INT64: T.LongType(), FLOAT32: T.FloatType(), FLOAT64: T.DoubleType(),
    TIMESTAMP: T.TimestampType(), TIMESTAMP_MILLI: T.TimestampType(), TIMESTAMP_MICRO: T.TimestampType(), TIMESTAMP_NANO: T.TimestampType(),
}


def _ancestors(name: str) -> list[str]:
    out = []
    while name is not None:
        out.append(name)
        name = PARENT[name]
    return out


def common_type(a: str, b: str) -> str:
    """The narrowest type that holds values of both; string where either has no place in the lattice."""
    if a not in PARENT or b not in PARENT:
        return STRING
    others = set(_ancestors(b))
    return next(x for x in _ancestors(a) if x in others)


def property_type(observed: set[str]) -> str:
    """The type of a column in which these types were seen. Nulls don't widen; nothing but nulls is null."""
    seen = sorted(set(observed) - {NULL})
    if not seen:
        return NULL
    out = seen[0]
    for x in seen[1:]:
        out = common_type(out, x)
    return out


def to_spark(name: str) -> T.DataType:
    return _SPARK.get(name, T.StringType())


def from_spark(kind: T.DataType) -> str:
    """The stream type that a Spark column lands as: decimals are numbers, dates timestamps, nested values text."""
    if isinstance(kind, T.BooleanType):
        return BOOL
    if isinstance(kind, T.ByteType | T.ShortType | T.IntegerType):
        return INT32
    if isinstance(kind, T.LongType):
        return INT64
    if isinstance(kind, T.FloatType):
        return FLOAT32
    if isinstance(kind, T.DoubleType | T.DecimalType):
        return FLOAT64
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return TIMESTAMP_MICRO
    if isinstance(kind, T.DateType):
        return TIMESTAMP
    if isinstance(kind, T.StructType | T.MapType):
        return OBJECT
    if isinstance(kind, T.ArrayType):
        return ARRAY
    return NULL if isinstance(kind, T.NullType) else STRING


def reformat(name: str) -> str:
    """Destination identifier: lower case, everything but a-z and 0-9 an underscore."""
    return re.sub(r"[^a-z0-9]", "_", name.lower())


def destination_names(names: list[str], keep_source_names: bool = False) -> dict[str, str]:
    """Source to destination column names. Two sources with one destination are an error, not a silent overwrite."""
    out = {n: n if keep_source_names else reformat(n) for n in names}
    clash = [n for n in names if list(out.values()).count(out[n]) > 1]
    if clash:
        raise ValueError(f"columns {clash} have the same destination name")
    return out
