"""Registered queries that go through sources, syncs, sinks and catalogs, each with the SQL that DuckDB answers alike."""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary import types as S
from tributary.catalog import Catalog, Configured, Stream, classify, merge, merged_columns, new_catalog
from tributary.functions import coerce as C
from tributary.functions.rowid import envelope
from tributary.operators import chunks as K
from tributary.operators import filters
from tributary.operators.merge import current, latest
from tributary.plans.queries import AT, query, table
from tributary.sinks.table import Table
from tributary.sources.files import MODIFIED, FileSource
from tributary.sources.tables import TableSource
from tributary.state import State
from tributary.streaming import logs
from tributary.streaming.changes import stamp
from tributary.sync import Sync


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return f"{base.rstrip('/')}/sync-{uuid.uuid4().hex}" if base else tempfile.mkdtemp(prefix="tributary-")


def _source(spark, sf, tables, keys=None, **options) -> TableSource:
    return TableSource(spark, {"path": sf, "tables": list(tables), "keys": keys or {"orders": ["o_orderkey"], "customer": ["c_custkey"], "nation": ["n_nationkey"]}, **options})


def _catalog(source, mode, cursor="", **options) -> Catalog:
    streams = source.discover()
    for s in streams:
        s.sync_mode, s.cursor = mode, cursor
    return Catalog(streams, [Configured(s.name, **options) for s in streams])


def _synced(spark, source, catalog, folder=None, state=None, **options):
    """The table of the catalog's first stream after a sync."""
    sync = Sync(spark, source, folder or scratch(spark), state or State(), ingested_at=AT, **options)
    sync.run(catalog)
    return sync.table(catalog.streams[0]).read()


# Syncs


@query("SELECT o_orderkey, o_totalprice, CAST(o_orderkey AS VARCHAR) AS _row_id, 'r' AS _op_type FROM orders")
def sync_full_refresh(spark, sf):
    source = _source(spark, sf, ["orders"])
    return _synced(spark, source, _catalog(source, "full_refresh")).select("o_orderkey", "o_totalprice", "_row_id", "_op_type")


@query("SELECT o_orderkey, o_orderstatus, CAST(o_orderkey AS VARCHAR) AS _row_id FROM orders WHERE o_totalprice > 100000 AND o_orderstatus <> 'F'")
def sync_filter_selection(spark, sf):
    source = _source(spark, sf, ["orders"])
    done = _synced(spark, source, _catalog(source, "full_refresh", filter='o_totalprice > 100000 and o_orderstatus != "F"', selected_columns=["o_orderkey", "o_orderstatus"], sync_new_columns=False))
    return done.select(*[c for c in done.columns if c not in ("_op_type", "_ingested_at", "_cdc_timestamp")])


@query("SELECT c_custkey, c_mktsegment, c_nationkey FROM customer")
def sync_partitioned(spark, sf):
    source = _source(spark, sf, ["customer"])
    done = _synced(spark, source, _catalog(source, "full_refresh", partition="/{c_mktsegment, identity}/{c_custkey, bucket[4]}"))
    return done.select("c_custkey", "c_mktsegment", "c_nationkey")


@query("SELECT n_name AS name, n_nationkey AS key, '{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}' AS data FROM nation")
def sync_raw_layout(spark, sf):
    source = _source(spark, sf, ["nation"])
    done = _synced(spark, source, _catalog(source, "full_refresh", normalization=False))
    return done.select(F.get_json_object("data", "$.n_name").alias("name"), F.get_json_object("data", "$.n_nationkey").cast("int").alias("key"), "data")


def _parts(spark, sf, folder):
    """Orders in two states: without those of odd keys over half, then all, those under a hundred with another status."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    middle = orders.agg(F.expr("cast(max(o_orderkey) / 2 as bigint)")).head()[0]
    orders.where(F.col("o_orderkey") <= middle).write.parquet(f"{folder}/orders.parquet")
    return orders


@query("SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey <= (SELECT CAST(floor(max(o_orderkey) / 2) AS BIGINT) FROM orders) THEN 'r' ELSE 'u' END AS _op_type FROM orders")
def sync_incremental(spark, sf):
    """A backfill in chunks up to the cursor's maximum, then the rows past it."""
    folder = scratch(spark)
    orders, source, state, out = _parts(spark, sf, folder), _source(spark, folder, ["orders"], chunk_rows=200), State(), f"{folder}/out"
    catalog = _catalog(source, "incremental", "o_orderkey")
    _synced(spark, source, catalog, out, state, chunks_per_commit=3)
    orders.write.mode("overwrite").parquet(f"{folder}/orders.parquet")
    return _synced(spark, source, catalog, out, state).select("o_orderkey", "o_orderstatus", "_op_type")


@query("SELECT count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_keys, max(o_orderkey) AS cursor FROM orders")
def sync_crash_recovery(spark, sf):
    """The state is lost after the destination's commit: the next run adopts it and lands no row twice."""
    folder = scratch(spark)
    orders, source, out = _parts(spark, sf, folder), _source(spark, folder, ["orders"], chunk_rows=400), f"{folder}/out"
    catalog = _catalog(source, "incremental", "o_orderkey", append_mode=True)
    _synced(spark, source, catalog, out, State())
    orders.write.mode("overwrite").parquet(f"{folder}/orders.parquet")
    lost = State()
    done = _synced(spark, source, catalog, out, lost)
    return done.agg(F.count("*").alias("n_rows"), F.countDistinct("o_orderkey").alias("n_keys")).withColumn("cursor", F.lit(lost.cursor("orders", "o_orderkey")).cast("long"))


_CHANGED = "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN 'update' WHEN 2 THEN 'delete' ELSE 'insert' END AS kind FROM orders WHERE o_orderkey % 4 IN (1, 2)"


def _logged(spark, sf, folder):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    orders.write.parquet(f"{folder}/orders.parquet")
    kind = F.when(F.col("o_orderkey") % 4 == 1, "update").when(F.col("o_orderkey") % 4 == 2, "delete").otherwise("none")
    log = orders.withColumns({"o_orderstatus": F.lit("new"), "__kind": kind, "__position": F.col("o_orderkey"), "__at": F.lit(AT)})
    first = log.where("__kind = 'none'").limit(1).withColumn("__position", F.lit(0).cast("long"))
    first.write.parquet(f"{folder}/orders.changes.parquet")
    return log


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 IN (1, 2) THEN 'new' ELSE o_orderstatus END AS o_orderstatus, CASE o_orderkey % 4 WHEN 1 THEN 'u' WHEN 2 THEN 'd' ELSE 'r' END AS _op_type FROM orders")
def sync_changes(spark, sf):
    """A snapshot, then the changes since the position pinned before it; a delete stays as a tombstone."""
    folder = scratch(spark)
    log, state, out = _logged(spark, sf, folder), State(), f"{folder}/out"
    source = _source(spark, folder, ["orders"])
    catalog = _catalog(source, "cdc")
    _synced(spark, source, catalog, out, state)
    log.where("__kind <> 'none'").write.mode("append").parquet(f"{folder}/orders.changes.parquet")
    return _synced(spark, source, catalog, out, state).select("o_orderkey", "o_orderstatus", "_op_type")


@query(f"SELECT o_orderkey, 'new' AS o_orderstatus, CASE kind WHEN 'update' THEN 'u' ELSE 'd' END AS _op_type FROM ({_CHANGED})")
def sync_strict_changes(spark, sf):
    """Changes alone, without a snapshot."""
    folder = scratch(spark)
    log, source = _logged(spark, sf, folder), _source(spark, folder, ["orders"])
    log.where("__kind <> 'none'").write.mode("append").parquet(f"{folder}/orders.changes.parquet")
    return _synced(spark, source, _catalog(source, "strict_cdc")).select("o_orderkey", "o_orderstatus", "_op_type")


@query("SELECT * FROM (SELECT 'customer' AS stream, count(*) AS n_rows, 0 AS after_clearing FROM customer UNION ALL SELECT 'nation', count(*), 0 FROM nation)")
def sync_clear(spark, sf):
    source, folder = _source(spark, sf, ["customer", "nation"]), scratch(spark)
    catalog, sync = _catalog(source, "full_refresh"), Sync(spark, source, folder, State(), ingested_at=AT)
    sync.run(catalog)
    counts = [(s.name, sync.table(s).read().count()) for s in catalog.streams]
    sync.clear(catalog)
    return spark.createDataFrame([(n, k, sync.table(s).version()) for (n, k), s in zip(counts, catalog.streams, strict=True)], "stream string, n_rows long, after_clearing int")


@query("SELECT 'orders' AS stream, max(o_orderkey) AS cursor, TRUE AS backfilled, 7 AS version FROM orders")
def state_file(spark, sf):
    """Cursor and chunks as the state file has them after a sync."""
    source, path = _source(spark, sf, ["orders"], chunk_rows=500), f"{tempfile.mkdtemp(prefix='tributary-')}/state.json"
    _synced(spark, source, _catalog(source, "incremental", "o_orderkey"), None, State(path))
    kept = State.load(path)
    return spark.createDataFrame([("orders", kept.cursor("orders", "o_orderkey"), kept.backfilled("orders"), kept.version)], "stream string, cursor long, backfilled boolean, version int")


# Tables

_UPSERTED = "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'third' WHEN c_custkey % 3 = 0 THEN 'second' ELSE 'first' END AS v FROM customer"


def _three_versions(spark, sf):
    t, customers = Table(spark, f"{scratch(spark)}/t"), table(spark, sf, "customer").select("c_custkey")
    for n, (name, every) in enumerate((("first", 1), ("second", 3), ("third", 5))):
        batch = envelope(customers.where(F.col("c_custkey") % every == 0).withColumn("v", F.lit(name)), ["c_custkey"], "u" if n else "r", AT)
        t.commit(batch, batch_id=name, mode="upsert" if n else "append", order=["v"])
    return t


@query(_UPSERTED)
def table_upserts(spark, sf):
    return _three_versions(spark, sf).read().select("c_custkey", "v")


@query(_UPSERTED)
def table_compacted(spark, sf):
    t = _three_versions(spark, sf)
    t.compact()
    t.compact(full=True, partition="/{v, identity}")
    return t.read().select("c_custkey", "v")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'second' ELSE 'first' END AS v FROM customer")
def table_time_travel(spark, sf):
    return _three_versions(spark, sf).read(2).select("c_custkey", "v")


# Files

_ORDERS = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders"


def _files(spark, sf, kind, write) -> FileSource:
    folder = scratch(spark)
    write(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), f"{folder}/files/orders")
    return FileSource(spark, {"path": f"{folder}/files", "format": kind, "prefer_long": True, "row_identifier": "order"})


def _stream(source) -> Stream:
    return source.discover()[0]


@query(_ORDERS)
def files_csv(spark, sf):
    """Plain and gzip files, with columns in two orders, under their own headers."""

    def write(df, path):
        df.where("o_orderkey % 2 = 0").write.option("header", True).csv(f"{path}/a")
        df.where("o_orderkey % 2 = 1").select("o_totalprice", "o_orderkey", "o_orderstatus").write.option("header", True).option("compression", "gzip").csv(f"{path}/b")

    source = _files(spark, sf, "csv", write)
    return source.table(_stream(source)).drop(MODIFIED)


@query(_ORDERS)
def files_json(spark, sf):
    source = _files(spark, sf, "json", lambda df, path: df.write.option("compression", "gzip").json(path))
    return source.table(_stream(source)).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT o_orderkey, o_orderstatus, CAST(o_orderkey % 7 AS VARCHAR) AS m FROM orders")
def files_xml(spark, sf):
    """Documents of up to 200,000 orders, one a file: a document is read by one task."""
    folder = scratch(spark)
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_orderkey") % 7).alias("_m"))
    rows.write.format("xml").option("rowTag", "order").option("rootTag", "orders").option("maxRecordsPerFile", 200_000).save(f"{folder}/files/orders")
    source = FileSource(spark, {"path": f"{folder}/files", "format": "xml", "row_identifier": "order"})
    found = source.table(_stream(source))
    return found.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderstatus", F.col("_m").alias("m"))


@query("SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DOUBLE) AS price, CAST(year(o_orderdate) AS INTEGER) AS y, CASE WHEN o_orderkey % 2 = 1 THEN o_orderstatus END AS extra FROM orders")
def files_parquet(spark, sf):
    """Files of an evolved schema: int keys, decimals, INT96 times in one; long keys, doubles and another column in the other."""
    orders, folder = table(spark, sf, "orders"), scratch(spark)
    price = F.col("o_totalprice").cast("decimal(12,2)")
    was = spark.conf.get("spark.sql.parquet.outputTimestampType")
    spark.conf.set("spark.sql.parquet.outputTimestampType", "INT96")
    try:
        at = F.col("o_orderdate").cast("timestamp")
        orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").cast("int").alias("o_orderkey"), price.alias("price"), at.alias("at")).write.parquet(f"{folder}/files/orders/a")
        orders.where("o_orderkey % 2 = 1").select("o_orderkey", price.cast("double").alias("price"), at.alias("at"), F.col("o_orderstatus").alias("extra")).write.parquet(f"{folder}/files/orders/b")
    finally:
        spark.conf.set("spark.sql.parquet.outputTimestampType", was)
    source = FileSource(spark, {"path": f"{folder}/files", "format": "parquet"})
    return source.table(_stream(source)).select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "price", F.year("at").alias("y"), "extra")


@query("SELECT * FROM (SELECT 'nation' AS stream, count(*) AS n_rows, TRUE AS dated, 1 AS n_cursors FROM nation UNION ALL SELECT 'region', count(*), TRUE, 1 FROM region)")
def files_streams(spark, sf):
    """One stream for each first folder; rows carry their file's time, whose maximum the listing gives without a read."""
    folder = scratch(spark)
    for name in ("nation", "region"):
        table(spark, sf, name).write.option("header", True).csv(f"{folder}/files/{name}")
    source, out = FileSource(spark, {"path": f"{folder}/files", "format": "csv"}), []
    for s in source.discover():
        n, last = source.table(s).agg(F.count("*"), F.max(MODIFIED)).head()
        out.append((s.name, n, last == source.max_cursor(s, [MODIFIED])[MODIFIED], len(s.cursor_candidates)))
    return spark.createDataFrame(out, "stream string, n_rows long, dated boolean, n_cursors int")


# Catalogs

_KIND = "CASE data_type WHEN 'BIGINT' THEN 'integer' WHEN 'INTEGER' THEN 'integer_small' WHEN 'DOUBLE' THEN 'number' WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp_micro' END"
_KNOWN = "('orders', 'customer', 'nation', 'events')"


@query(f"SELECT table_name AS stream, column_name AS name, {_KIND} AS kind FROM information_schema.columns WHERE table_name IN {_KNOWN}")
def catalog_discover(spark, sf):
    found = _source(spark, sf, ["orders", "customer", "nation", "events"]).discover()
    return spark.createDataFrame([(s.name, n, t) for s in found for n, t in s.schema.items()], "stream string, name string, kind string")


@query(f"SELECT table_name AS stream, 'incremental' AS mode, min(column_name) AS cursor, count(*) AS n_selected FROM information_schema.columns WHERE table_name IN {_KNOWN} GROUP BY table_name")
def catalog_defaults(spark, sf):
    """Without change capture a stream is read by the first of its columns, and all columns are selected."""
    found = _source(spark, sf, ["orders", "customer", "nation", "events"]).discover()
    for s in found:
        s.sync_modes = ["full_refresh", "incremental"]
    made = new_catalog(found)
    return spark.createDataFrame([(s.name, s.sync_mode, s.cursor, len(c.selected_columns)) for s, c in zip(made.streams, made.selected, strict=True)], "stream string, mode string, cursor string, n_selected long")


@query("SELECT column_name AS name FROM information_schema.columns WHERE table_name = 'orders' AND column_name NOT IN ('o_custkey', 'o_orderdate')")
def catalog_merge(spark, sf):
    """A new discovery finds two columns more: the one that the user left out before stays out, the new one comes in, streams that are new aren't selected."""
    old = new_catalog(_source(spark, sf, ["orders"]).discover())
    old.streams[0].schema.pop("o_orderpriority")
    old.selected[0].selected_columns = [c for c in old.streams[0].schema if c not in ("o_custkey", "o_orderdate")]
    merged = merge(old, new_catalog(_source(spark, sf, ["orders", "nation"]).discover()))
    assert [c.name for c in merged.selected] == ["orders"]
    return spark.createDataFrame([(c,) for c in merged.selected[0].selected_columns], "name string")


@query("SELECT column_name AS name FROM information_schema.columns WHERE table_name = 'customer' AND column_name IN ('c_custkey', 'c_name')")
def catalog_selection(spark, sf):
    """New columns stay out where they aren't synced."""
    schema = list(_source(spark, sf, ["customer"]).discover()[0].schema)
    old = [c for c in schema if c != "c_acctbal"]
    return spark.createDataFrame([(c,) for c in merged_columns(old, schema, ["c_custkey", "c_name"], False)], "name string")


@query("SELECT * FROM (VALUES ('orders', 'incremental'), ('customer', 'skipped'), ('nation', 'full_refresh')) t(stream, mode)")
def catalog_classify(spark, sf):
    """A stream whose cursor isn't among its columns is left out, the others go by their modes."""
    found = {s.name: s for s in _source(spark, sf, ["orders", "customer", "nation"]).discover()}
    for name, mode, cursor in (("orders", "incremental", "o_orderkey"), ("customer", "incremental", "no_such_column"), ("nation", "full_refresh", "")):
        found[name].sync_mode, found[name].cursor = mode, cursor
    modes, skipped = classify(Catalog(list(found.values()), [Configured(n) for n in found]))
    return spark.createDataFrame([(c.id, m) for m, group in modes.items() for c in group] + [(n, "skipped") for n in skipped], "stream string, mode string")


# Values


@query("SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS f, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS DOUBLE) + 0.5 END AS g FROM orders")
def coerce_float(spark, sf):
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.col("o_orderkey").cast("string"), F.lit(".5"))).otherwise("none")
    return table(spark, sf, "orders").select("o_orderkey", C.to_float(F.col("o_totalprice"), T.DoubleType()).alias("f"), C.to_float(text, T.StringType()).alias("g"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, CASE WHEN o_orderkey % 100000 = 0 THEN '1970-01-01' ELSE strftime(to_timestamp(o_orderkey), '%Y-%m-%d') END AS e FROM orders")
def coerce_date(spark, sf):
    seconds = F.when(F.col("o_orderkey") % 100000 == 0, F.lit(0)).otherwise(F.col("o_orderkey"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    text = day(F.col("o_orderdate"))
    return table(spark, sf, "orders").select("o_orderkey", day(C.to_timestamp(text, T.StringType())).alias("d"), F.date_format(F.to_utc_timestamp(F.from_utc_timestamp(C.to_timestamp(seconds, T.LongType()), "UTC"), "UTC"), "yyyy-MM-dd").alias("e"))


@query("SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS a, '[' || o_orderkey || ',\"' || o_orderstatus || '\"]' AS b, CAST(o_orderkey AS VARCHAR) AS c FROM orders")
def coerce_string(spark, sf):
    pair = F.array(F.col("o_orderkey").cast("string"), F.concat(F.lit('"'), "o_orderstatus", F.lit('"')))
    whole = F.col("o_orderkey").cast("double")
    small = table(spark, sf, "orders")
    return small.select("o_orderkey", C.to_string(F.col("o_orderkey"), T.LongType()).alias("a"), F.concat(F.lit("["), F.array_join(pair, ","), F.lit("]")).alias("b"), F.when(F.col("o_orderkey") < 10_000_000, C.to_string(whole, T.DoubleType())).alias("c"))


@query("SELECT o_orderkey, [o_orderstatus] AS one, ['a', o_orderstatus] AS two FROM orders")
def coerce_array(spark, sf):
    two = F.array(F.lit("a"), F.col("o_orderstatus"))
    return table(spark, sf, "orders").select("o_orderkey", C.to_array(F.col("o_orderstatus"), T.StringType()).alias("one"), C.to_array(two, T.ArrayType(T.StringType())).alias("two"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-02 03:00:00' AND o_orderkey >= 100")
def filter_value_types(spark, sf):
    """Values as texts, read as their columns' types: a time with an offset, a whole number."""
    f = {"logical_operator": "and", "conditions": [{"column": "o_orderdate", "operator": "<", "value": "1996-01-02T05:00:00+02:00"}, {"column": "o_orderkey", "operator": ">=", "value": "100"}]}
    return filters.apply(table(spark, sf, "orders"), f).select("o_orderkey")


@query("WITH m AS (SELECT CAST(ceil((max(o_orderkey) - min(o_orderkey) + 1)::DOUBLE / count(*) * 1000) AS BIGINT) AS step, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders) SELECT CAST(row_number() OVER (ORDER BY x NULLS FIRST) - 1 AS INTEGER) AS place, x AS low FROM (SELECT unnest(generate_series(lo + step, hi, step)) AS x FROM m UNION ALL SELECT NULL)")
def chunk_order(spark, sf):
    """Chunks in whatever order, put in the order of their low ends, the open one first."""
    low, high, n = table(spark, sf, "orders").selectExpr("min(o_orderkey)", "max(o_orderkey)", "count(*)").head()
    placed = K.in_order(K.even_int(low, high, n, 1000)[::-1])
    return spark.createDataFrame([(i, c.low) for i, c in enumerate(placed)], "place int, low long")


# Change logs


_LOG = {"o_orderkey": S.INT64, "o_orderstatus": S.STRING, "o_totalprice": S.FLOAT64}
_MERGED = "SELECT o_orderkey, CASE WHEN k = 'delete' THEN NULL ELSE o_orderstatus END AS o_orderstatus, CASE WHEN k = 'delete' THEN NULL ELSE o_totalprice END AS o_totalprice, CASE k WHEN 'insert' THEN 'c' WHEN 'update' THEN 'u' ELSE 'd' END AS _op_type FROM (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN 'insert' WHEN 1 THEN 'update' ELSE 'delete' END AS k FROM orders)"


def _kinds(spark, sf):
    m = F.col("o_orderkey") % 3
    return table(spark, sf, "orders").select(*_LOG, F.when(m == 0, "insert").when(m == 1, "update").otherwise("delete").alias("kind"))


def _last(changes):
    rows = latest(stamp(changes, ["o_orderkey"], "__kind", F.lit(AT), False, AT), ["__position"])
    return rows.select(*_LOG, "_op_type")


@query(_MERGED)
def log_wal2json(spark, sf):
    """Transactions of an insert and what follows it, one text each; deletes carry their old key."""
    text = [F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.col("o_totalprice").cast("string")]
    names = F.array(*[F.lit(n) for n in _LOG])
    change = lambda kind, gone: F.struct(kind.alias("kind"), F.lit("public").alias("schema"), F.lit("orders").alias("table"), F.when(~gone, names).alias("columnnames"), F.when(~gone, F.array(*text)).alias("columnvalues"), F.when(gone, F.struct(F.array(F.lit("o_orderkey")).alias("keynames"), F.array(text[0]).alias("keyvalues"))).alias("oldkeys"))
    both = F.when(F.col("kind") == "insert", F.array(change(F.lit("insert"), F.lit(False)))).otherwise(F.array(change(F.lit("insert"), F.lit(False)), change(F.col("kind"), F.col("kind") == "delete")))
    events = _kinds(spark, sf).select(F.to_json(F.struct(F.lit("2024-01-01 00:00:00.5+00").alias("timestamp"), F.concat(F.lit("A/"), F.hex("o_orderkey")).alias("nextlsn"), both.alias("change"))).alias("data"))
    return _last(logs.wal2json(events, "public.orders", _LOG))


@query(_MERGED.replace("CASE WHEN k = 'delete' THEN NULL ELSE o_orderstatus END", "o_orderstatus").replace("CASE WHEN k = 'delete' THEN NULL ELSE o_totalprice END", "o_totalprice"))
def log_binlog(spark, sf):
    """Row events; of an update's pairs of images the one after it counts."""
    row = F.array(F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.col("o_totalprice").cast("string"))
    before = F.array(F.col("o_orderkey").cast("string"), F.lit("old"), F.lit("0"))
    events = _kinds(spark, sf).select(F.col("kind").alias("event"), F.array(*[F.lit(n) for n in _LOG]).alias("names"), F.when(F.col("kind") == "update", F.array(before, row)).otherwise(F.array(row)).alias("rows"), F.lit(1_700_000_000).cast("long").alias("header_seconds"), F.lit(None).cast("long").alias("gtid_micros"), F.lit("bin.000001").alias("file"), F.col("o_orderkey").alias("pos"))
    return _last(logs.binlog(events, _LOG))


@query(_MERGED)
def log_change_stream(spark, sf):
    """Documents' change events; numbers in their wrappers, deletes with their key alone, replacements as updates."""
    wrapped = F.struct(F.struct(F.col("o_orderkey").cast("string").alias("$numberLong")).alias("o_orderkey"), "o_orderstatus", "o_totalprice")
    key = F.struct(F.struct(F.col("o_orderkey").cast("string").alias("$numberLong")).alias("o_orderkey"))
    kind = F.when((F.col("kind") == "update") & (F.col("o_orderkey") % 2 == 0), "replace").otherwise(F.col("kind"))
    time = F.struct(F.struct(F.lit(1_700_000_000).alias("t"), F.col("o_orderkey").alias("i")).alias("$timestamp"))
    events = _kinds(spark, sf).select(F.to_json(F.struct(kind.alias("operationType"), F.when(F.col("kind") != "delete", wrapped).alias("fullDocument"), key.alias("documentKey"), time.alias("clusterTime"))).alias("data"))
    return _last(logs.change_stream(events, _LOG))


@query("SELECT o_orderkey, o_orderstatus, CASE o_orderkey % 3 WHEN 0 THEN 'insert' WHEN 1 THEN 'update' ELSE 'delete' END AS kind FROM orders WHERE o_orderkey > 100 AND o_orderkey <= 900")
def log_change_table(spark, sf):
    """A change table in a range of log sequence numbers, images before updates left out."""
    op = F.when(F.col("kind") == "insert", F.array(F.lit(2))).when(F.col("kind") == "delete", F.array(F.lit(1))).otherwise(F.array(F.lit(3), F.lit(4)))
    changes = _kinds(spark, sf).withColumn("__$operation", F.explode(op)).withColumns({"__$start_lsn": F.unhex(F.lpad(F.hex("o_orderkey"), 20, "0")), "__$seqval": F.unhex(F.lpad(F.hex("__$operation"), 20, "0"))})
    at = lambda n: f"{n:020X}"
    return logs.change_table(changes.drop("kind"), at(100), at(900)).select("o_orderkey", "o_orderstatus", F.col("__kind").alias("kind"))
