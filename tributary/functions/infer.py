"""Types of columns from their values, by one aggregate over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary import types as S
from tributary.functions.coerce import FALSE_WORDS, TRUE_WORDS, parse_timestamp


def timestamp_precision(text: Column) -> Column:
    """The timestamp type that a text's fraction of a second needs."""
    digits = F.length(F.regexp_extract(text, r"\.(\d+)", 1))
    return F.when(digits == 0, S.TIMESTAMP).when(digits <= 3, S.TIMESTAMP_MILLI).when(digits <= 6, S.TIMESTAMP_MICRO).otherwise(S.TIMESTAMP_NANO)


def text_type(text: Column) -> Column:
    """The type of a text value: a timestamp if it parses as one, else string."""
    return F.when(text.isNull(), S.NULL).when(parse_timestamp(text).isNotNull(), timestamp_precision(text)).otherwise(S.STRING)


def csv_type(c: Column, prefer_long: bool = False) -> Column:
    """An aggregate: the type of a text column by the rule boolean, number, timestamp, string; empty and "null" cells don't count."""
    cell = F.when((c != "") & (F.lower(c) != "null"), c)
    every = lambda test: F.coalesce(F.bool_and(F.when(cell.isNotNull(), F.coalesce(test, F.lit(False)))), F.lit(False))
    words = cell.isin(*[w for w in (*TRUE_WORDS, *FALSE_WORDS) if w not in ("0", "1")])
    rule = F.when(F.count(cell) == 0, S.STRING).when(every(words), S.BOOL)
    if prefer_long:
        rule = rule.when(every(cell.try_cast("bigint").isNotNull() & cell.rlike(r"^[+-]?\d+$")), S.INT64)
    return rule.when(every(cell.try_cast("double").isNotNull()), S.FLOAT64).when(every(parse_timestamp(cell).isNotNull()), S.TIMESTAMP).otherwise(S.STRING)


def csv_types(df: DataFrame, prefer_long: bool = False) -> DataFrame:
    """One row: the inferred type of each text column."""
    return df.agg(*[csv_type(F.col(f"`{c}`"), prefer_long).alias(c) for c in df.columns])


def observed_types(df: DataFrame) -> dict[str, str]:
    """Stream types of the columns of a DataFrame, texts looked at value by value."""
    texts = [f.name for f in df.schema if S.from_spark(f.dataType) == S.STRING]
    seen = df.agg(*[F.collect_set(text_type(F.col(f"`{c}`"))).alias(c) for c in texts]).head() if texts else {}
    return {f.name: S.property_type(set(seen[f.name])) if f.name in texts else S.from_spark(f.dataType) for f in df.schema}
