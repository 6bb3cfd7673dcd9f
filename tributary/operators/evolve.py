"""Schema evolution: which type changes a table takes, and rows brought to a schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary import types as S
from tributary.functions.coerce import coerce

OK, COERCE, PROMOTE, FAIL = "ok", "coerce", "promote", "fail"
_TAKES = {  # existing -> incoming types that it takes without a change, by coercion, and by promotion
    S.BOOL: ({S.BOOL}, set(), set()),
    S.INT32: ({S.INT32}, {S.BOOL}, {S.INT64}),
    S.INT64: ({S.INT32, S.INT64}, {S.BOOL}, set()),
    S.FLOAT32: ({S.FLOAT32}, set(), {S.FLOAT64}),
    S.FLOAT64: ({S.FLOAT32, S.FLOAT64}, {S.BOOL, S.INT32, S.INT64}, set()),
    S.TIMESTAMP: ({S.TIMESTAMP}, set(), set()),
}


def decision(existing: str, incoming: str) -> str:
    """What a table with promotions from int to long and float to double alone does with an incoming type."""
    a, b = (S.TIMESTAMP if x.startswith("timestamp") else x for x in (existing, incoming))
    if a not in _TAKES:
        return OK if b not in _TAKES else COERCE
    fine, coerced, promoted = _TAKES[a]
    return OK if b in fine else COERCE if b in coerced else PROMOTE if b in promoted else FAIL


def evolve_strict(existing: dict[str, str], incoming: dict[str, str]) -> dict[str, str]:
    """The schema after a batch, or ValueError for a change the table can't take. New columns are added."""
    out = dict(existing)
    for name, kind in incoming.items():
        if kind == S.NULL:
            continue
        if name not in out:
            out[name] = kind
            continue
        what = decision(out[name], kind)
        if what == FAIL:
            raise ValueError(f"column {name} can't change from {out[name]} to {kind}")
        if what == PROMOTE:
            out[name] = kind
    return out


def evolve_widening(existing: dict[str, str], incoming: dict[str, str]) -> dict[str, str]:
    """The schema of a table whose older files stay as they are: each column as wide as all its values need."""
    out = dict(existing)
    for name, kind in incoming.items():
        out[name] = S.property_type({kind, out.get(name, S.NULL)})
    return out


def schema_of(df: DataFrame) -> dict[str, str]:
    return {f.name: S.from_spark(f.dataType) for f in df.schema}


def conform(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """The columns of a schema, cast to its types; those that df lacks are null."""
    kinds = {f.name: f.dataType for f in df.schema}
    return df.select(*[(coerce(F.col(f"`{n}`"), kinds[n], t) if n in kinds and not isinstance(kinds[n], T.NullType) else F.lit(None)).cast(S.to_spark(t)).alias(n) for n, t in schema.items()])


def union_by_name(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of both under their common schema."""
    schema = evolve_widening(schema_of(a), schema_of(b))
    return conform(a, schema).unionByName(conform(b, schema))
