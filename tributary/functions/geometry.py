"""Well-known text of geometries that come as four bytes of SRID and well-known binary."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_NAMES = {1: "POINT", 2: "LINESTRING", 3: "POLYGON", 4: "MULTIPOINT", 5: "MULTILINESTRING", 6: "MULTIPOLYGON", 7: "GEOMETRYCOLLECTION"}


def _number(x: float) -> str:
    return str(int(x)) if x == int(x) else repr(x)


def _read(data: bytes, at: int) -> tuple[str, str, int]:
    order = "<" if data[at] else ">"
    (kind,) = struct.unpack_from(f"{order}I", data, at + 1)
    at += 5

    def count() -> int:
        nonlocal at
        (n,) = struct.unpack_from(f"{order}I", data, at)
        at += 4
        return n

    def points(n: int) -> str:
        nonlocal at
        xy = struct.unpack_from(f"{order}{2 * n}d", data, at)
        at += 16 * n
        return ",".join(f"{_number(xy[i])} {_number(xy[i + 1])}" for i in range(0, 2 * n, 2))

    if kind == 1:
        body = f"({points(1)})"
    elif kind == 2:
        body = f"({points(count())})"
    elif kind == 3:
        body = "(" + ",".join(f"({points(count())})" for _ in range(count())) + ")"
    elif kind in _NAMES:
        parts = []
        for _ in range(count()):
            name, inner, at = _read(data, at)
            parts.append(name + inner if kind == 7 else inner.strip("()") if kind == 4 else inner)
        body = "(" + ",".join(parts) + ")"
    else:
        raise ValueError("an unknown geometry")
    return _NAMES[kind], body, at


def wkt(data: bytes | None) -> str | None:
    """Text of a geometry; hexadecimal text of bytes that aren't one."""
    if data is None:
        return None
    try:
        name, body, _ = _read(bytes(data), 4)
        return name + body
    except (ValueError, IndexError, struct.error):
        return bytes(data).hex()


def geometry_text(c):
    """A column of geometries as text."""

    def text(x: pd.Series) -> pd.Series:
        return x.map(wkt)

    return F.pandas_udf(text, StringType())(c)
