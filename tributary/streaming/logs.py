"""Change logs of particular systems, decoded from recorded events into rows with ``__kind``, ``__at`` and ``__position``.

Each decoder takes a DataFrame of events as the system's log delivers them and gives changes that ``changes.stamp`` and
a keyed merge take: the columns of one stream, by name and type, the kind (insert, update, delete), the time of the
transaction and a position that ascends. All are Catalyst expressions; an event with several rows is exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary import types as S
from tributary.functions.coerce import coerce

_WAL = "timestamp string, nextlsn string, change array<struct<kind: string, schema: string, table: string, columnnames: array<string>, columnvalues: array<string>, oldkeys: struct<keynames: array<string>, keyvalues: array<string>>>>"


def _typed(values: Column, schema: dict[str, str]) -> list[Column]:
    """Columns of a map from names to texts."""
    return [coerce(F.try_element_at(values, F.lit(n)), T.StringType(), t).cast(S.to_spark(t)).alias(n) for n, t in schema.items()]


def lsn(text: Column) -> Column:
    """A log sequence number, two hexadecimal halves, as one that can be compared."""
    half = lambda i: F.conv(F.split_part(text, F.lit("/"), F.lit(i)), 16, 10).cast("decimal(20,0)")
    return half(1) * F.lit(4294967296).cast("decimal(20,0)") + half(2)


def wal2json(events: DataFrame, table: str, schema: dict[str, str], text: str = "data") -> DataFrame:
    """Transactions as JSON texts. A delete has its old key's columns alone; the position is the log sequence number, then the place in the transaction."""
    one = events.select(F.from_json(text, _WAL).alias("t")).select(F.col("t.timestamp").alias("at"), F.col("t.nextlsn").alias("lsn"), F.posexplode("t.change").alias("i", "c"))
    own = one.where(F.concat_ws(".", "c.schema", "c.table") == table)
    values = F.when(F.col("c.kind") == "delete", F.map_from_arrays("c.oldkeys.keynames", "c.oldkeys.keyvalues")).otherwise(F.map_from_arrays("c.columnnames", "c.columnvalues"))
    at = coerce(F.col("at"), T.StringType(), S.TIMESTAMP)
    return own.withColumn("v", values).select(*_typed(F.col("v"), schema), F.col("c.kind").alias("__kind"), at.alias("__at"), F.struct(lsn(F.col("lsn")).alias("lsn"), "i").alias("__position"))


def binlog(events: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Row events: event (insert, update, delete), names, rows (texts; an update's are pairs of images), header_seconds, gtid_micros, file, pos.

    Of an update's pairs the images after it stay. The time is the transaction's in microseconds where the log has it, else the header's second."""
    after = F.filter("rows", lambda _, i: (F.col("event") != "update") | (i % 2 == 1))
    one = events.withColumn("after", after).select("*", F.posexplode("after").alias("i", "r"))
    at = F.coalesce(F.timestamp_micros("gtid_micros"), F.timestamp_seconds("header_seconds"))
    return one.withColumn("v", F.map_from_arrays("names", "r")).select(*_typed(F.col("v"), schema), F.col("event").alias("__kind"), at.alias("__at"), F.struct("file", "pos", "i").alias("__position"))


_EVENT = "operationType string, fullDocument string, fullDocumentBeforeChange string, documentKey string, clusterTime struct<`$timestamp`: struct<t: string, i: string>>"


def change_stream(events: DataFrame, schema: dict[str, str], text: str = "data") -> DataFrame:
    """Documents' change events as extended JSON texts. A replacement is an update; a deleted document has its image from before, if recorded, else its key.

    Each step is a projection of its own, so that an event, its document and a wrapped value are parsed once each. The
    event comes out of a generator, below which filters on its fields, which would parse it again, can't go."""
    parsed = events.select(F.inline(F.array(F.from_json(text, _EVENT))))
    kind, stamp = F.col("operationType"), F.col("clusterTime.$timestamp")
    document = F.when(kind == "delete", F.coalesce("fullDocumentBeforeChange", "documentKey")).otherwise(F.col("fullDocument"))
    known = parsed.where(kind.isin("insert", "update", "replace", "delete"))
    rows = known.select(kind.alias("kind"), stamp["t"].cast("bigint").alias("seconds"), stamp["i"].cast("bigint").alias("nth"), F.from_json(document, "map<string,string>").alias("v"))
    rest, places = ("kind", "seconds", "nth"), range(len(schema))
    rows = rows.select(*rest, *[F.try_element_at("v", F.lit(n)).alias(f"t{i}") for i, n in enumerate(schema)])
    rows = rows.select(*rest, *[x for i in places for x in (F.col(f"t{i}"), wrapper(F.col(f"t{i}")).alias(f"w{i}"))])
    rows = rows.select(*rest, *[unwrapped(F.col(f"t{i}"), F.col(f"w{i}")).alias(f"t{i}") for i in places])
    rows = rows.select(*rest, *[finite(F.col(f"t{i}")).alias(f"t{i}") for i in places])
    values = [coerce(F.col(f"t{i}"), T.StringType(), t).cast(S.to_spark(t)).alias(n) for i, (n, t) in enumerate(schema.items())]
    return rows.select(*values, F.when(F.col("kind") == "replace", "update").otherwise(F.col("kind")).alias("__kind"), F.timestamp_seconds("seconds").alias("__at"), (F.shiftleft("seconds", 32) + F.col("nth")).alias("__position"))


def wrapper(text: Column) -> Column:
    """The fields of an extended-JSON wrapper; null for other texts."""
    return F.when(text.startswith('{"$'), F.from_json(text, "map<string,string>"))


def unwrapped(text: Column, own: Column) -> Column:
    """The value in a wrapper with these fields (dates, object ids, numbers, timestamps in seconds) as text; other texts as they are."""
    get = lambda name: F.try_element_at(own, F.lit(name))
    kinds = ("$oid", "$numberLong", "$numberInt", "$numberDouble", "$numberDecimal", "$date", "$symbol")
    dated = F.when(get("$date").startswith("{"), F.get_json_object(get("$date"), "$['$numberLong']"))
    iso = F.date_format(F.timestamp_millis(dated.cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.when(own.isNotNull(), F.coalesce(iso, *[get(k) for k in kinds], F.get_json_object(get("$timestamp"), "$.t"), text)).otherwise(text)


def finite(text: Column) -> Column:
    return F.when(~text.isin("NaN", "Infinity", "-Infinity"), text)


def plain_value(text: Column) -> Column:
    """The value of one extended-JSON wrapper (object ids, numbers, dates, timestamps in seconds) as text; other texts as they are, values that aren't finite null."""
    return finite(unwrapped(text, wrapper(text)))


def change_table(changes: DataFrame, after: str | None, until: str) -> DataFrame:
    """A database's change table between two log sequence numbers (hexadecimal texts, the first left out): operation 1 deletes, 2 inserts, 4 is an update's image after it; images before updates go."""
    start, op = F.hex("__$start_lsn"), F.col("`__$operation`")
    test = (start <= F.lit(until)) & op.isin(1, 2, 4)
    rows = changes.where(test if after is None else test & (start > F.lit(after)))
    kind = F.when(op == 1, "delete").when(op == 2, "insert").otherwise("update")
    own = [F.col(f"`{n}`") for n in changes.columns if not n.startswith("__$")]
    return rows.select(*own, kind.alias("__kind"), F.struct(start.alias("lsn"), F.hex("__$seqval").alias("seqval")).alias("__position"))
