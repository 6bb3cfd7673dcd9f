"""The filter language: a one-line text form and a structured form, one evaluator for all modes, and SQL text of it.

Nulls: ``=`` holds of two nulls, ``!=`` of exactly one; other comparisons with a null don't hold. No condition and AND
holds, no condition and OR doesn't. SQL for sources says the same, so push-down never changes a result.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPERATORS = ("=", "!=", "<", ">", "<=", ">=")
_COLUMN = r'(?:"([^"]+)"|(\w+))'
_VALUE = r'("[^"]*"|-?\d+\.\d+|-?\d+|\.\d+|\w+)'
_CONDITION = rf"{_COLUMN}\s*(<=|>=|!=|=|<|>)\s*{_VALUE}"
_LINE = re.compile(rf"^\s*{_CONDITION}\s*(?:\s(and|or)\s+{_CONDITION}\s*)?$", re.IGNORECASE)


@dataclass
class Condition:
    column: str
    operator: str
    value: object


@dataclass
class Filter:
    logical_operator: str = "and"
    conditions: list[Condition] = field(default_factory=list)


def parse_line(text: str) -> Filter:
    """One or two conditions joined by and / or."""
    m = _LINE.match(text)
    if not m:
        raise ValueError(f"{text!r} is not a filter")
    g = m.groups()
    found = [Condition(g[0] or g[1], g[2], _literal(g[3]))]
    if g[4]:
        found.append(Condition(g[5] or g[6], g[7], _literal(g[8])))
    return Filter((g[4] or "and").lower(), found)


def _literal(text: str) -> object:
    if text.startswith('"'):
        return text[1:-1]
    if text.lower() == "null":
        return None
    if re.fullmatch(r"-?\d+", text):
        return int(text)
    if re.fullmatch(r"-?\d*\.\d+", text):
        return float(text)
    return text


def parse_structured(config: dict) -> Filter:
    """``{logical_operator, conditions: [{column, operator, value}]}``."""
    found = [Condition(c["column"], c["operator"], c.get("value")) for c in config.get("conditions", [])]
    return Filter(config.get("logical_operator", "and").lower(), found)


def parse(config: dict | str | None) -> Filter | None:
    if not config:
        return None
    return parse_line(config) if isinstance(config, str) else parse_structured(config)


def validate(f: Filter, schema: T.StructType, most: int = 2) -> None:
    """Errors at plan time: operator, column, number of conditions and value."""
    if f.logical_operator not in ("and", "or"):
        raise ValueError(f"an unknown logical operator: {f.logical_operator}")
    if len(f.conditions) > most:
        raise ValueError(f"a filter has {most} conditions at most")
    for c in f.conditions:
        if c.operator not in OPERATORS:
            raise ValueError(f"an unknown operator: {c.operator}")
        if c.column not in schema.fieldNames():
            raise ValueError(f"no column {c.column}")
        typed(c.value, schema[c.column].dataType)


def typed(value: object, kind: T.DataType) -> object:
    """A value as the column's type, or ValueError."""
    if value is None:
        return None
    if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType):
        moment = value if isinstance(value, dt.datetime) else dt.datetime.fromisoformat(str(value).strip().replace("Z", "+00:00"))
        return moment.astimezone(dt.timezone.utc).replace(tzinfo=None) if moment.tzinfo else moment
    if isinstance(kind, T.BooleanType):
        from tributary.functions.coerce import FALSE_WORDS, TRUE_WORDS

        if str(value) in TRUE_WORDS or value is True:
            return True
        if str(value) in FALSE_WORDS or value is False:
            return False
        raise ValueError(f"{value!r} is not a boolean")
    if isinstance(kind, T.IntegralType):
        number = float(value)
        return int(value) if not isinstance(value, float) and re.fullmatch(r"[+-]?\d+", str(value)) else int(number) if number == int(number) else number
    if isinstance(kind, T.NumericType):
        return float(value)
    return str(value)


def condition(c: Condition, schema: T.StructType) -> Column:
    left, kind = F.col(f"`{c.column}`"), schema[c.column].dataType
    value = typed(c.value, kind)
    right = F.lit(value)
    if value is not None and isinstance(kind, T.TimestampType | T.DateType):
        right = F.lit(value.isoformat(sep=" ")).cast(kind)
    if c.operator == "=":
        return left.eqNullSafe(right) if value is None else F.coalesce(left == right, F.lit(False))
    if c.operator == "!=":
        return ~left.eqNullSafe(right)
    if value is None:
        return F.lit(False)
    return F.coalesce({"<": left < right, ">": left > right, "<=": left <= right, ">=": left >= right}[c.operator], F.lit(False))


def apply(df: DataFrame, config: dict | str | Filter | None) -> DataFrame:
    """The rows of df that a filter holds of. A comparison that isn't null-safe goes on its own, so that the scan gets it."""
    f = config if isinstance(config, Filter) else parse(config)
    if f is None:
        return df
    validate(f, df.schema)
    if f.logical_operator == "and":
        for c in f.conditions:
            test = condition(c, df.schema)
            if c.operator != "!=" and c.value is not None:
                test = _bare(c, df.schema)  # in WHERE, null and false are the same
            df = df.where(test)
        return df
    if not f.conditions:
        return df.where(F.lit(False))
    out = F.lit(False)
    for c in f.conditions:
        out = out | condition(c, df.schema)
    return df.where(out)


def _bare(c: Condition, schema: T.StructType) -> Column:
    left, kind, value = F.col(f"`{c.column}`"), schema[c.column].dataType, typed(c.value, schema[c.column].dataType)
    right = F.lit(value.isoformat(sep=" ")).cast(kind) if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType) else F.lit(value)
    return {"=": left == right, "<": left < right, ">": left > right, "<=": left <= right, ">=": left >= right}[c.operator]


def to_sql(f: Filter, schema: T.StructType, dialect: str = "ansi") -> str:
    """A WHERE clause for a source database."""
    quote = {"mysql": "`{}`", "mssql": "[{}]"}.get(dialect, '"{}"')

    def text(value: object, kind: T.DataType) -> str:
        if isinstance(value, bool):
            return str(int(value)) if dialect == "mssql" else str(value).lower()
        if isinstance(value, int | float):
            return repr(value)
        if isinstance(value, dt.datetime):
            iso = value.isoformat(sep=" ")
            return {"oracle": f"TO_TIMESTAMP('{iso}', 'YYYY-MM-DD HH24:MI:SS.FF')", "db2": f"TIMESTAMP('{iso}')"}.get(dialect, f"'{iso}'")
        return "'" + str(value).replace("'", "''") + "'"

    parts = []
    for c in f.conditions:
        name, kind = quote.format(c.column), schema[c.column].dataType
        value = typed(c.value, kind)
        if value is None:
            if c.operator not in ("=", "!="):
                raise ValueError(f"null can't be compared by {c.operator}")
            parts.append(f"{name} IS {'NOT ' * (c.operator == '!=')}NULL")
        elif c.operator == "!=":
            parts.append(f"({name} <> {text(value, kind)} OR {name} IS NULL)")
        else:
            parts.append(f"{name} {c.operator} {text(value, kind)}")
    return f" {f.logical_operator.upper()} ".join(parts)
