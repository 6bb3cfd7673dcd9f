"""Partition transforms and path templates, as Catalyst expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions.rowid import INGESTED_AT

#: Seed under which Spark's hash of a following long is murmur3 with seed 0: a fixed value, since hash(lit(this)) is 0.
_SEED = -1693959553
_SPEC = re.compile(r"/\{([^,{}]+),\s*([a-z]+(?:\[\d+\])?)\}")
_PLACE = re.compile(r"\{([^{}]*)\}")


def years(ts: Column) -> Column:
    return F.year(ts) - 1970


def months(ts: Column) -> Column:
    return (F.year(ts) - 1970) * 12 + F.month(ts) - 1


def days(ts: Column) -> Column:
    return F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date"))


def hours(ts: Column) -> Column:
    """Whole hours since 1970, floored, so that times before it count down."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(3_600_000_000)).cast("int")


def murmur3_long(c: Column) -> Column:
    return F.hash(F.lit(_SEED), c.cast("bigint"))


def _let(value: Column, use) -> Column:
    """use(value), value being computed and written into the plan once, however often use refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _rotl(x: Column, r: int) -> Column:
    """Of a variable of 32 bits in a long."""
    return F.shiftleft(x, r).bitwiseOR(F.shiftrightunsigned(x, 32 - r)).bitwiseAND(F.lit(0xFFFFFFFF))


def _times(x: Column, k: int) -> Column:
    """Product of a variable of 32 bits and a number modulo 2^32 in longs, by halves, so that nothing overflows."""
    low, high = k & 0xFFFF, k >> 16
    return (x * low + F.shiftleft((x * high).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(0xFFFFFFFF))


def _mixed(word: Column) -> Column:
    return _let(word, lambda w: _let(_times(w, 0xCC9E2D51), lambda x: _let(_rotl(x, 15), lambda y: _times(y, 0x1B873593))))


def murmur3_text(c: Column) -> Column:
    """murmur3 with seed 0 of a text's bytes, folded over them natively, since Spark's own hash treats the tail otherwise."""

    def of_bytes(raw: Column) -> Column:  # the text's bytes as hexadecimal digits
        n = F.length(raw) / 2
        byte = lambda i: F.conv(F.substring(raw, (2 * i + 1).cast("int"), F.lit(2)), 16, 10).cast("bigint")
        word = lambda i: F.conv(F.concat(*[F.substring(raw, (2 * (i + k) + 1).cast("int"), F.lit(2)) for k in (3, 2, 1, 0)]), 16, 10).cast("bigint")
        blocks = F.floor(n / 4).cast("int")
        body = F.when(blocks > 0, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array().cast("array<int>"))
        step = lambda a, i: _let(a.bitwiseXOR(_mixed(word(i * 4))), lambda x: _let(_rotl(x, 13), lambda y: (_times(y, 5) + 0xE6546B64).bitwiseAND(F.lit(0xFFFFFFFF))))
        state = F.aggregate(body, F.lit(0).cast("bigint"), step)
        left = F.pmod(n, F.lit(4)).cast("int")
        at = (n - left).cast("int")
        tail = F.when(left >= 1, byte(at)).otherwise(0) + F.when(left >= 2, F.shiftleft(byte(at + 1), 8)).otherwise(0) + F.when(left >= 3, F.shiftleft(byte(at + 2), 16)).otherwise(0)
        return _last(state.bitwiseXOR(_mixed(tail)).bitwiseXOR(n.cast("bigint")))

    return _let(F.hex(c), of_bytes)


def _last(x: Column) -> Column:
    """The end of murmur3: two rounds of shifts and products, and a sign."""
    fold = lambda v, shift: v.bitwiseXOR(F.shiftrightunsigned(v, shift))
    first = _let(x, lambda v: _let(fold(v, 16), lambda w: _times(w, 0x85EBCA6B)))
    second = _let(first, lambda v: _let(fold(v, 13), lambda w: _times(w, 0xC2B2AE35)))
    return _let(second, lambda v: _let(fold(v, 16), lambda w: F.when(w >= 1 << 31, w - (1 << 32)).otherwise(w).cast("int")))


def bucket(c: Column, kind: T.DataType, n: int) -> Column:
    if isinstance(kind, T.StringType):
        h = murmur3_text(c)
    else:
        h = murmur3_long(F.unix_micros(c.cast("timestamp")) if isinstance(kind, T.TimestampType | T.TimestampNTZType) else c)
    return F.when(c.isNotNull(), h.bitwiseAND(F.lit(0x7FFFFFFF)) % n)


def truncate(c: Column, kind: T.DataType, width: int) -> Column:
    if width <= 0:
        raise ValueError("the width of a truncation is positive")
    return F.substring(c, 1, width) if isinstance(kind, T.StringType) else c - F.pmod(c, F.lit(width).cast(kind))


def parse_spec(spec: str) -> list[tuple[str, str, int]]:
    """(column, transform, argument) of ``/{col, transform}/...``; now() is the time of ingestion."""
    found = _SPEC.findall(spec)
    if not found or "".join(f"/{{{c},{t}}}" for c, t in found) != re.sub(r",\s+", ",", spec):
        raise ValueError(f"{spec!r} is not a partition specification")
    out = []
    for column, text in found:
        name, _, arg = text.partition("[")
        if name not in ("identity", "year", "month", "day", "hour", "bucket", "truncate") or (name in ("bucket", "truncate")) != bool(arg):
            raise ValueError(f"an unknown transform: {text}")
        out.append((INGESTED_AT if column.strip() == "now()" else column.strip(), name, int(arg[:-1]) if arg else 0))
    return out


def transform(df: DataFrame, column: str, name: str, arg: int = 0) -> Column:
    c, kind = F.col(f"`{column}`"), df.schema[column].dataType
    by_time = {"year": years, "month": months, "day": days, "hour": hours}
    if name in by_time:
        if not isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType):
            raise ValueError(f"{name} needs a time; {column} is {kind.simpleString()}")
        return by_time[name](c)
    return c if name == "identity" else bucket(c, kind, arg) if name == "bucket" else truncate(c, kind, arg)


def partition_name(column: str, name: str) -> str:
    """The name of a partition field: the column, with what its transform adds."""
    return column + {"identity": "", "bucket": "_bucket", "truncate": "_trunc"}.get(name, f"_{name}")


def partition_path(df: DataFrame, spec: str) -> Column:
    """field=value/... with values escaped as in URLs, null for nulls."""
    return F.concat_ws("/", *[F.concat(F.lit(f"{partition_name(c, t)}="), F.coalesce(F.url_encode(transform(df, c, t, a).cast("string")), F.lit("null"))) for c, t, a in parse_spec(spec)])


def path_template(df: DataFrame, template: str) -> Column:
    """Free text with ``{column, default, granularity}`` places; a granularity of HH, DD, WW, MM or YYYY takes that part of a time."""
    parts, at = [], 0
    for m in _PLACE.finditer(template):
        parts.append(F.lit(template[at : m.start()]))
        at = m.end()
        fields = [x.strip() for x in m[1].split(",")]
        if len(fields) < 3:
            continue
        column, default, grain = fields[0], fields[1].strip("'\""), fields[2].strip("'\"")
        column = INGESTED_AT if column == "now()" else column
        missing = F.lit(default or f"default_{column}")
        if column not in df.columns:
            parts.append(missing)
            continue
        c = F.col(f"`{column}`")
        pads = {"HH": (F.hour, 2), "DD": (F.dayofmonth, 2), "WW": (F.weekofyear, 2), "MM": (F.month, 2), "YYYY": (F.year, 4)}
        value = F.lpad(pads[grain][0](c).cast("string"), pads[grain][1], "0") if grain in pads else c.cast("string")
        parts.append(F.coalesce(value, missing))
    return F.concat(*parts, F.lit(template[at:]))
