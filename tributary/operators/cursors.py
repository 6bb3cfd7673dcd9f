"""Cursor columns: their maxima, the read of what is new, and the bound of a backfill that an incremental read follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def maxima(df: DataFrame, cursors: list[str]) -> DataFrame:
    """One row: the greatest value of each cursor. Parquet answers it from footers."""
    return df.agg(*[F.max(c).alias(c) for c in cursors])


def extremes(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: the least and the greatest key, in lexicographic order."""
    both = df.agg(F.min(F.struct(*keys)).alias("a"), F.max(F.struct(*keys)).alias("b"))
    return both.select(*[F.col(f"a.{k}").alias(f"min_{k}") for k in keys], *[F.col(f"b.{k}").alias(f"max_{k}") for k in keys])


def newer(primary: str, last: object, secondary: str | None = None, last_secondary: object = None, inclusive: bool = False) -> Column:
    """Rows past the cursor; the secondary cursor counts only where the primary is null."""
    past = lambda c, v: (F.col(c) >= F.lit(v)) if inclusive else (F.col(c) > F.lit(v))
    test = past(primary, last)
    return test if secondary is None else test | (F.col(primary).isNull() & past(secondary, last_secondary))


def threshold(bounds: dict[str, object]) -> Column:
    """Rows that a backfill takes: each cursor null or at most its maximum, which was read before."""
    test = F.lit(True)
    for c, v in bounds.items():
        test = test & (F.col(c).isNull() | (F.col(c) <= F.lit(v)))
    return test


def observed(df: DataFrame, cursors: list[str], name: str = "cursors") -> tuple[DataFrame, Observation]:
    """df with its cursors' maxima and row count observed as it is written, so that no second pass is needed."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.max(c).alias(c) for c in cursors]), seen
