"""Coercion of values between types, as Catalyst expressions. Nothing throws: what can't be converted is null, or the
epoch where lenient timestamps are asked for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words read as booleans.
TRUE_WORDS = ("1", "t", "T", "true", "TRUE", "True", "YES", "Yes", "yes")
FALSE_WORDS = ("0", "f", "F", "false", "FALSE", "False", "NO", "No", "no")
# The accepted layouts of timestamps, in the notation of Java's formatters.
TIMESTAMP_PATTERNS = (
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS]",
    "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS] XXX",
    "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS]XXX",
    "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS] xx z",
    "yyyy-MM-dd-HH.mm.ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS]",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS]XXX",
    "yyyy-MM-dd'T'HH:mm:ssxx",
    "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS]x",
)
# The same as two expressions: what Spark's cast reads as it stands, and what has to be brought into that form first.
_DAY, _TIME = r"\d{4}-\d{2}-\d{2}", r"\d{2}:\d{2}:\d{2}"
_ISO = rf"^{_DAY}([ T]{_TIME}(\.\d{{1,9}})?(Z|[+-]\d{{2}}:\d{{2}})?)?$"
_SPACED = rf"^({_DAY} {_TIME}(?:\.\d{{1,9}})?) (Z|[+-]\d{{2}}:\d{{2}})$"
_NAMED = rf"^({_DAY} {_TIME}(?:\.\d{{1,9}})?) ([+-]\d{{2}})(\d{{2}}) [A-Za-z]+$"
_SHORT = rf"^({_DAY}T{_TIME})([+-]\d{{2}})(\d{{2}})$"
_HOURS = rf"^({_DAY} {_TIME}(?:\.\d{{1,9}})?)([+-]\d{{2}})$"
_DOTTED = rf"^({_DAY})-(\d{{2}})\.(\d{{2}})\.(\d{{2}})\.(\d{{6}})$"
_LAST_YEAR = 9999


def to_bool(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        return c
    if isinstance(kind, T.IntegralType):
        return F.when(c == 0, False).when(c == 1, True)
    if isinstance(kind, T.StringType):
        return F.when(c.isin(*TRUE_WORDS), True).when(c.isin(*FALSE_WORDS), False)
    return F.lit(None).cast("boolean")


def to_int(c: Column, kind: T.DataType, bits: int = 64) -> Column:
    """Fractions are cut towards zero; texts are decimal integers only."""
    target = "bigint" if bits == 64 else "int"
    if isinstance(kind, T.BooleanType):
        return c.cast(target)
    if isinstance(kind, T.StringType | T.BinaryType):
        text = c.cast("string")
        return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast(target))
    return c.try_cast(target)


def to_float(c: Column, kind: T.DataType, bits: int = 64) -> Column:
    target = "double" if bits == 64 else "float"
    return c.cast("string").try_cast(target) if isinstance(kind, T.BinaryType) else c.try_cast(target)


def to_string(c: Column, kind: T.DataType) -> Column:
    """Whole floating values have no fraction; nested values are compact JSON."""
    if isinstance(kind, T.FloatType | T.DoubleType):
        return F.regexp_replace(c.cast("string"), r"\.0$", "")
    if isinstance(kind, T.StructType | T.MapType | T.ArrayType):
        return F.to_json(c)
    return c.cast("string")


def parse_timestamp(text: Column, lenient: bool = False) -> Column:
    """A timestamp, years clamped: before 1 the epoch, after 9999 the year 9999. Texts of no known layout are null, or the epoch if lenient.

    One test tells the layouts apart that a cast reads; the rest are rewritten. No formatter runs, and the parsed value
    stands in the expression a few times only: a year out of range can but begin with 0000 or be an end of 9999."""
    epoch = F.timestamp_seconds(F.lit(0))
    plain = F.when(text.rlike(_ISO), text)
    for pattern, form in ((_SPACED, "$1$2"), (_NAMED, "$1$2:$3"), (_SHORT, "$1$2:$3"), (_HOURS, "$1$2:00"), (_DOTTED, "$1 $2:$3:$4.$5")):
        plain = plain.when(text.rlike(pattern), F.regexp_replace(text, pattern, form))
    at = plain.try_cast("timestamp")
    parsed = F.when(text.startswith("0000-"), F.when(at.isNotNull(), epoch))
    parsed = parsed.when(text.startswith("9999-12-31"), F.when(F.year(at) > _LAST_YEAR, at - F.expr("interval 1 year")).otherwise(at)).otherwise(at)
    return F.when(text.isNotNull(), F.coalesce(parsed, epoch)) if lenient else parsed


def clamp_year(ts: Column) -> Column:
    late = F.make_timestamp(F.lit(_LAST_YEAR), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.minute(ts), F.second(ts).cast("decimal(8,6)"))
    return F.when(F.year(ts) < 1, F.timestamp_seconds(F.lit(0))).when(F.year(ts) > _LAST_YEAR, late).otherwise(ts)


def to_timestamp(c: Column, kind: T.DataType, lenient: bool = False) -> Column:
    """Integers are seconds since 1970."""
    if isinstance(kind, T.StringType):
        return parse_timestamp(c, lenient)
    if isinstance(kind, T.IntegralType):
        return clamp_year(F.timestamp_seconds(c))
    return clamp_year(c.cast("timestamp")) if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType) else F.lit(None).cast("timestamp")


def to_array(c: Column, kind: T.DataType) -> Column:
    return c if isinstance(kind, T.ArrayType) else F.array(c)


def coerce(c: Column, kind: T.DataType, target: str, lenient: bool = False) -> Column:
    """A column of a Spark type as a stream type."""
    from tributary import types as S

    if target == S.BOOL:
        return to_bool(c, kind)
    if target in (S.INT32, S.INT64):
        return to_int(c, kind, 32 if target == S.INT32 else 64)
    if target in (S.FLOAT32, S.FLOAT64):
        return to_float(c, kind, 32 if target == S.FLOAT32 else 64)
    if target.startswith("timestamp"):
        return to_timestamp(c, kind, lenient)
    return to_string(c, kind)


# Values of particular systems


def unsigned(c: Column, bits: int) -> Column:
    """A signed value read as unsigned. 64 bits have no wider home and stay as they are."""
    return c.cast("bigint") if bits >= 64 else c.cast("bigint").bitwiseAND(F.lit((1 << bits) - 1))


def enum_label(index: Column, labels: list[str]) -> Column:
    """An ENUM's label; index 0 is the empty text."""
    return F.when(index == 0, "").otherwise(F.get(F.array(*map(F.lit, labels)), index.cast("int") - 1))


def set_labels(mask: Column, labels: list[str]) -> Column:
    """A SET's labels by its bits, joined by commas."""
    return F.concat_ws(",", *[F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.lit(x)) for i, x in enumerate(labels)])


def uuid_text(binary: Column, mixed_endian: bool = False) -> Column:
    """Canonical text of 16 bytes; mixed-endian ones have the first three groups reversed."""
    h = F.lower(F.hex(binary))
    byte = lambda i: F.substring(h, 2 * i + 1, 2)
    order = (3, 2, 1, 0, 5, 4, 7, 6) if mixed_endian else range(8)
    parts = [byte(i) for i in (*order, *range(8, 16))]
    return F.concat(*parts[:4], F.lit("-"), *parts[4:6], F.lit("-"), *parts[6:8], F.lit("-"), *parts[8:10], F.lit("-"), *parts[10:])


def time_of_day(c: Column) -> Column:
    return F.date_format(c, "HH:mm:ss")


def without_zone(text: Column) -> Column:
    """A timestamp text's wall clock as UTC, whatever offset it has."""
    return F.try_to_timestamp(F.regexp_replace(F.regexp_replace(text, r"(Z|[+-]\d{2}:?\d{2})$", ""), "T", " "), F.lit("yyyy-MM-dd HH:mm:ss[.SSSSSSSSS]"))


def not_finite_to_null(c: Column) -> Column:
    return F.when(~(F.isnan(c) | c.isin(float("inf"), float("-inf"))), c)


def replaced_unchanged(new: Column, old: Column, sentinel: str = "__unchanged__") -> Column:
    """A large value that a change left out: taken from the old row, else a sentinel."""
    return F.coalesce(new, old, F.lit(sentinel))
