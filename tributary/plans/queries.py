"""Registered queries of the engine's operators, each with the SQL that DuckDB answers alike."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary import types as S
from tributary.catalog import Catalog, Configured, Stream, difference
from tributary.functions import coerce as C
from tributary.functions import infer, rowid
from tributary.functions import transforms as P
from tributary.operators import chunks as K
from tributary.operators import cursors, evolve, filters, flatten, merge, project

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
AT = dt.datetime(2024, 1, 1)
PIVOT = 15_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def fixed_time():
    return F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Projection and filters


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def select_columns(spark, sf):
    return project.project(table(spark, sf, "orders"), ["o_orderkey", "o_totalprice", "o_orderstatus"], sync_new=False)


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders")
def drop_unselected(spark, sf):
    df = table(spark, sf, "orders")
    known = [c for c in df.columns if c != "o_orderdate"]
    return project.project(df, ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"], known, sync_new=True)


@query('SELECT c_custkey AS customer_no_, c_name AS full_name, c_nationkey AS nation FROM customer')
def rename_destination(spark, sf):
    df = table(spark, sf, "customer").select(F.col("c_custkey").alias("Customer No."), F.col("c_name").alias("Full-Name"), F.col("c_nationkey").alias("NATION"))
    return project.project(df, None, keep_source_names=False)


def _conditions(op, *conditions):
    return {"logical_operator": op, "conditions": [dict(zip(("column", "operator", "value"), c, strict=True)) for c in conditions]}


@query("SELECT * FROM orders WHERE o_totalprice > 100000.5 AND o_orderstatus = 'O'")
def filter_and(spark, sf):
    return filters.apply(table(spark, sf, "orders"), _conditions("and", ("o_totalprice", ">", 100000.5), ("o_orderstatus", "=", "O")))


@query("SELECT * FROM orders WHERE o_totalprice <= 20000 OR o_orderstatus = 'P'")
def filter_or(spark, sf):
    return filters.apply(table(spark, sf, "orders"), _conditions("or", ("o_totalprice", "<=", 20000), ("o_orderstatus", "=", "P")))


_NULLED = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS status FROM orders"


def _nulled(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("status"))


@query(f"SELECT * FROM ({_NULLED}) WHERE status IS DISTINCT FROM 'O'")
def filter_ne_nullsafe(spark, sf):
    return filters.apply(_nulled(spark, sf), _conditions("and", ("status", "!=", "O")))


@query(f"SELECT * FROM ({_NULLED}) WHERE status IS NULL")
def filter_is_null(spark, sf):
    return filters.apply(_nulled(spark, sf), _conditions("and", ("status", "=", None)))


@query("SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1996-07-01 15:30:00'")
def filter_timestamp(spark, sf):
    return filters.apply(table(spark, sf, "orders"), _conditions("and", ("o_orderdate", ">=", "1996-07-01T15:30:00Z")))


@query("SELECT * FROM lineitem WHERE l_quantity >= 45 OR l_returnflag = 'R'")
def filter_legacy_line(spark, sf):
    return filters.apply(table(spark, sf, "lineitem"), 'l_quantity >= 45 or "l_returnflag" = "R"')


@query("SELECT * FROM orders WHERE (o_totalprice >= 150000.0 AND (o_orderstatus <> 'F' OR o_orderstatus IS NULL))")
def filter_pushdown_sql(spark, sf):
    df = table(spark, sf, "orders")
    f = filters.parse_structured(_conditions("and", ("o_totalprice", ">=", 150000), ("o_orderstatus", "!=", "F")))
    return df.where(filters.to_sql(f, df.schema, "mysql"))


# Chunks


def _ranges(spark, chunks):
    return spark.createDataFrame([(i, c.low, c.high) for i, c in enumerate(chunks)], "chunk int, low long, high long")


def _order_chunks(spark, sf):
    low, high, n = table(spark, sf, "orders").selectExpr("min(o_orderkey)", "max(o_orderkey)", "count(*)").head()
    return K.even_int(low, high, n, 1000)


_EVEN = """
WITH m AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi, count(*) AS n FROM orders),
s AS (SELECT lo, hi, CAST(ceil(greatest((hi - lo + 1)::DOUBLE / n * 1000, 1)) AS BIGINT) AS step FROM m),
b AS (SELECT unnest(generate_series(lo + step, hi, step)) AS x FROM s),
r AS (SELECT x, row_number() OVER (ORDER BY x) AS i FROM b),
c AS (SELECT CAST(i AS INTEGER) AS chunk, x AS low, lead(x) OVER (ORDER BY x) AS high FROM r UNION ALL SELECT 0, NULL, min(x) FROM r)
"""


@query(_EVEN + "SELECT chunk, low, high FROM c")
def chunk_bounds_even_int(spark, sf):
    return _ranges(spark, _order_chunks(spark, sf))


@query(_EVEN + "SELECT chunk, count(o_orderkey) AS n_rows FROM c LEFT JOIN orders ON (low IS NULL OR o_orderkey >= low) AND (high IS NULL OR o_orderkey < high) GROUP BY chunk")
def chunk_scan_coverage(spark, sf):
    df, chunks = table(spark, sf, "orders"), _order_chunks(spark, sf)
    counted = K.locate(df.select("o_orderkey"), "o_orderkey", chunks).groupBy("chunk").agg(F.count("o_orderkey").alias("n_rows"))
    return _ranges(spark, chunks).select("chunk").join(counted, "chunk", "left").select("chunk", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_orderkey > 1000 OR (l_orderkey = 1000 AND l_linenumber >= 3)) AND (l_orderkey < 9000 OR (l_orderkey = 9000 AND l_linenumber < 2))")
def chunk_lexicographic(spark, sf):
    df = table(spark, sf, "lineitem")
    return K.scan(df, ["l_orderkey", "l_linenumber"], K.Chunk((1000, 3), (9000, 2))).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT rn, l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS rn FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) WHERE rn % 500 = 0")
def chunk_pk_walk(spark, sf):
    return K.every_nth_key(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct(), ["l_orderkey", "l_linenumber"], 500)


@query("SELECT CAST(sum(CASE WHEN abs(n - total / 8.0) <= 0.02 * total THEN 1 ELSE 0 END) AS BIGINT) AS even_chunks, count(*) AS n_chunks FROM (SELECT t, count(*) AS n, (SELECT count(*) FROM orders) AS total FROM (SELECT ntile(8) OVER (ORDER BY o_orderkey) AS t FROM orders) GROUP BY t)")
def chunk_equi_count(spark, sf):
    df = table(spark, sf, "orders")
    bounds = K.chunks_of(K.quantile_bounds(df, "o_orderkey", 8))
    counts = K.locate(df.select("o_orderkey"), "o_orderkey", bounds).groupBy("chunk").count()
    total = F.sum("count").over(Window.partitionBy())
    even = F.abs(F.col("count") - total / len(bounds)) <= 0.02 * total
    return counts.select("chunk", even.alias("even")).agg(F.count_if("even").alias("even_chunks"), F.lit(len(bounds)).cast("long").alias("n_chunks"))


@query("SELECT n AS n_rows, CAST(ceil(n / 2000.0) AS BIGINT) AS n_chunks, TRUE AS near_the_size FROM (SELECT count(*) AS n FROM orders)")
def chunk_sampled_coverage(spark, sf):
    """Each row in one chunk, and no chunk of twice the rows that were asked for."""
    df = table(spark, sf, "orders").select("o_orderkey")
    bounds = K.chunks_of(K.sampled_bounds(df, "o_orderkey", df.count(), 2000))
    counts = K.locate(df, "o_orderkey", bounds).groupBy("chunk").agg(F.count("o_orderkey").alias("n"))
    return counts.where("chunk is not null").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_chunks"), (F.max("n") < 4000).alias("near_the_size"))


@query("SELECT count(*) AS n_rows, count(DISTINCT c_name) AS n_names FROM customer")
def chunk_string_coverage(spark, sf):
    df = table(spark, sf, "customer")
    low, high = df.agg(F.min("c_name"), F.max("c_name")).head()
    bounds = K.chunks_of(K.aligned(df, "c_name", K.even_string(low, high, 6)))
    marked = df.withColumn("hits", sum(K.predicate(["c_name"], c, df).cast("int") for c in bounds))
    return marked.agg(F.sum("hits").alias("n_rows"), F.countDistinct(F.when(F.col("hits") == 1, F.col("c_name"))).alias("n_names"))


@query("SELECT * FROM (VALUES (0, 3), (1, 1), (2, 2)) t(chunk, files)")
def file_bin_pack(spark, sf):
    packed = K.pack_files([("a", 10), ("b", 30), ("c", 40), ("d", 200), ("e", 60), ("f", 40)], 100)
    return spark.createDataFrame([(i, len(g)) for i, g in enumerate(packed)], "chunk int, files int")


# Cursors


@query("SELECT max(o_orderdate) AS o_orderdate FROM orders")
def cursor_max(spark, sf):
    return cursors.maxima(table(spark, sf, "orders"), ["o_orderdate"])


@query("SELECT max(ts) AS ts, max(event_id) AS event_id FROM events")
def cursor_max_pair(spark, sf):
    return cursors.maxima(table(spark, sf, "events"), ["ts", "event_id"])


@query("SELECT (SELECT l_orderkey FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 1) AS min_l_orderkey, (SELECT l_linenumber FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 1) AS min_l_linenumber, (SELECT l_orderkey FROM lineitem ORDER BY l_orderkey DESC, l_linenumber DESC LIMIT 1) AS max_l_orderkey, (SELECT l_linenumber FROM lineitem ORDER BY l_orderkey DESC, l_linenumber DESC LIMIT 1) AS max_l_linenumber")
def table_extremes(spark, sf):
    return cursors.extremes(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT * FROM orders WHERE o_orderdate > TIMESTAMP '1997-06-01'")
def incremental_scan(spark, sf):
    return table(spark, sf, "orders").where(cursors.newer("o_orderdate", dt.datetime(1997, 6, 1)))


_EVENTS = "SELECT event_id, user_id, CASE WHEN event_id % 5 <> 0 THEN event_id END AS c1, user_id AS c2 FROM events"


def _two_cursors(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", F.when(F.col("event_id") % 5 != 0, F.col("event_id")).alias("c1"), F.col("user_id").alias("c2"))


@query(f"SELECT * FROM ({_EVENTS}) WHERE c1 > 300 OR (c1 IS NULL AND c2 > 20)")
def incremental_secondary_null(spark, sf):
    return _two_cursors(spark, sf).where(cursors.newer("c1", 300, "c2", 20))


@query(f"SELECT * FROM ({_EVENTS}) WHERE (c1 IS NULL OR c1 <= 300) AND (c2 IS NULL OR c2 <= 50)")
def backfill_threshold(spark, sf):
    return _two_cursors(spark, sf).where(cursors.threshold({"c1": 300, "c2": 50}))


# Row ids and envelopes


@query("SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS row_id FROM orders")
def row_id_single(spark, sf):
    df = table(spark, sf, "orders")
    return df.select("o_orderkey", rowid.row_id(df, ["o_orderkey"]).alias("row_id"))


@query("SELECT l_orderkey, l_linenumber, l_suppkey, md5(CAST(l_linenumber AS VARCHAR) || '|' || CAST(l_orderkey AS VARCHAR) || '|') AS row_id FROM lineitem")
def row_id_composite(spark, sf):
    df = table(spark, sf, "lineitem")
    return df.select("l_orderkey", "l_linenumber", "l_suppkey", rowid.row_id(df, ["l_orderkey", "l_linenumber"]).alias("row_id"))


@query(f"SELECT o_orderkey, md5(CAST(o_orderkey AS VARCHAR) || '|' || coalesce(status, '<nil>') || '|') AS row_id FROM ({_NULLED})")
def row_id_full(spark, sf):
    df = _nulled(spark, sf)
    return df.select("o_orderkey", rowid.row_id(df, []).alias("row_id"))


@query("SELECT o_orderkey, o_orderstatus, CAST(o_orderkey AS VARCHAR) AS _row_id, 'r' AS _op_type, TIMESTAMP '2024-01-01' AS _ingested_at, TIMESTAMP '1970-01-01' AS _cdc_timestamp FROM orders")
def envelope_snapshot(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return rowid.envelope(df, ["o_orderkey"], ingested_at=fixed_time(), changed_at=F.timestamp_seconds(F.lit(0)).cast("timestamp_ntz"))


# Change capture and merge


_KIND = "CASE event_id % 4 WHEN 0 THEN 'insert' WHEN 1 THEN 'update' WHEN 2 THEN 'delete' ELSE 'replace' END"


def _changes(spark, sf):
    m = F.col("event_id") % 4
    kind = F.when(m == 0, "insert").when(m == 1, "update").when(m == 2, "delete").otherwise("replace")
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts", kind.alias("kind"))


@query(f"SELECT event_id, CASE {_KIND} WHEN 'insert' THEN 'i' WHEN 'delete' THEN 'd' ELSE 'u' END AS op_overlap, CASE {_KIND} WHEN 'insert' THEN 'c' WHEN 'delete' THEN 'd' ELSE 'u' END AS op_steady FROM events")
def cdc_op_mapping(spark, sf):
    return _changes(spark, sf).select("event_id", rowid.change_op(F.col("kind"), True).alias("op_overlap"), rowid.change_op(F.col("kind"), False).alias("op_steady"))


@query("SELECT event_id, user_id FROM events WHERE event_id > 100 AND event_id <= 900")
def cdc_bounded_range(spark, sf):
    from tributary.streaming.changes import between

    return between(_changes(spark, sf), "event_id", 100, 900).select("event_id", "user_id")


def _stamped(spark, sf, overlap=True):
    from tributary.streaming.changes import stamp

    return stamp(_changes(spark, sf), ["user_id"], "kind", F.col("ts"), overlap, fixed_time()).drop("kind", "ts")


_BATCH = f"SELECT event_id, user_id, event_type, CAST(user_id AS VARCHAR) AS _row_id, CASE {_KIND} WHEN 'insert' THEN 'c' WHEN 'delete' THEN 'd' ELSE 'u' END AS _op_type, ts AS _cdc_timestamp FROM events"
_LAST = f"SELECT event_id, user_id, event_type, _row_id, _op_type, _cdc_timestamp FROM (SELECT *, row_number() OVER (PARTITION BY _row_id ORDER BY event_id DESC) AS r FROM ({_BATCH})) WHERE r = 1"
_SNAPSHOT = "SELECT CAST(NULL AS BIGINT) AS event_id, c_custkey AS user_id, 'snapshot' AS event_type, CAST(c_custkey AS VARCHAR) AS _row_id, 'r' AS _op_type, TIMESTAMP '1970-01-01' AS _cdc_timestamp FROM customer"
_UPSERT = f"SELECT * FROM ({_SNAPSHOT}) s WHERE NOT EXISTS (SELECT 1 FROM ({_LAST}) b WHERE b._row_id = s._row_id) UNION ALL SELECT * FROM ({_LAST})"


def _snapshot(spark, sf):
    df = table(spark, sf, "customer").select(F.lit(None).cast("long").alias("event_id"), F.col("c_custkey").alias("user_id"), F.lit("snapshot").alias("event_type"))
    return rowid.envelope(df, ["user_id"], ingested_at=fixed_time(), changed_at=F.timestamp_seconds(F.lit(0)).cast("timestamp_ntz"))


@query(_LAST)
def upsert_latest(spark, sf):
    df = merge.latest(_stamped(spark, sf, False), ["event_id"])
    return df.drop("_ingested_at")


@query(_UPSERT)
def upsert_with_tombstones(spark, sf):
    return merge.upsert(_snapshot(spark, sf), _stamped(spark, sf), ["event_id"]).drop("_ingested_at")


@query(f"SELECT * FROM ({_UPSERT}) WHERE _op_type <> 'd'")
def current_rows(spark, sf):
    return merge.current(merge.upsert(_snapshot(spark, sf), _stamped(spark, sf), ["event_id"])).drop("_ingested_at")


@query(f"SELECT * FROM ({_SNAPSHOT}) UNION ALL SELECT * FROM ({_BATCH})")
def append_log(spark, sf):
    return merge.append(_snapshot(spark, sf), _stamped(spark, sf)).drop("_ingested_at")


@query("SELECT count(*) AS n_rows, count(DISTINCT k) AS n_keys FROM (SELECT c_custkey AS k FROM customer UNION SELECT user_id FROM events)")
def dedup_overlap(spark, sf):
    """A snapshot and the inserts that repeat its rows give each key once."""
    return merge.duplicates(merge.upsert(_snapshot(spark, sf), _stamped(spark, sf), ["event_id"]))


@query("SELECT count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_keys FROM lineitem")
def duplicate_check(spark, sf):
    return merge.duplicates(table(spark, sf, "lineitem"), "l_orderkey")


@query(
    f"SELECT o_orderkey, o_custkey, CASE WHEN o_orderdate > TIMESTAMP '1997-01-01' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CAST(o_orderkey AS VARCHAR) AS _row_id, CASE WHEN o_orderdate > TIMESTAMP '1997-01-01' THEN 'u' ELSE 'r' END AS _op_type FROM orders WHERE o_totalprice > {PIVOT}"
)
def upsert_current_orders(spark, sf):
    """Flagship: a filtered snapshot of orders, an incremental read past a cursor, merged into current state."""
    orders = filters.apply(table(spark, sf, "orders"), _conditions("and", ("o_totalprice", ">", PIVOT))).select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    snapshot = rowid.envelope(orders, ["o_orderkey"], ingested_at=AT)
    new = orders.where(cursors.newer("o_orderdate", dt.datetime(1997, 1, 1))).withColumn("o_orderstatus", F.lit("X"))
    batch = rowid.envelope(new, ["o_orderkey"], rowid.UPDATE, AT)
    return merge.current(merge.upsert(snapshot, batch, ["o_orderdate"], unique=True)).select("o_orderkey", "o_custkey", "o_orderstatus", "_row_id", "_op_type")


# Partitioning


@query("SELECT o_orderkey, CAST(year(o_orderdate) - 1970 AS INTEGER) AS p FROM orders")
def partition_year(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", P.years(F.col("o_orderdate")).alias("p"))


@query("SELECT o_orderkey, CAST((year(o_orderdate) - 1970) * 12 + month(o_orderdate) - 1 AS INTEGER) AS p FROM orders")
def partition_month(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", P.months(F.col("o_orderdate")).alias("p"))


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS INTEGER) AS p FROM orders")
def partition_day(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", P.days(F.col("o_orderdate")).alias("p"))


@query("SELECT event_id, CAST(floor(epoch_us(ts) / 3600000000.0) AS INTEGER) AS p FROM events")
def partition_hour(spark, sf):
    return table(spark, sf, "events").select("event_id", P.hours(F.col("ts")).alias("p"))


@query("SELECT o_orderkey, o_custkey - ((o_custkey % 10) + 10) % 10 AS p FROM orders")
def partition_truncate_int(spark, sf):
    df = table(spark, sf, "orders")
    return df.select("o_orderkey", P.truncate(F.col("o_custkey"), df.schema["o_custkey"].dataType, 10).alias("p"))


@query("SELECT c_custkey, substr(c_name, 1, 4) AS p FROM customer")
def partition_truncate_text(spark, sf):
    df = table(spark, sf, "customer")
    return df.select("c_custkey", P.truncate(F.col("c_name"), df.schema["c_name"].dataType, 4).alias("p"))


def _murmur_sql(select: str, words: list[str], length: int, n: int, tail: str | None = None) -> str:
    """murmur3 of words of 32 bits and a shorter tail, given as SQL, in HUGEINT arithmetic; the bucket is p."""
    mask = "4294967295::HUGEINT"
    rot = lambda x, r: f"((({x}) * {1 << r}::HUGEINT) & {mask}) | (({x}) // {1 << (32 - r)}::HUGEINT)"
    every = [*words, *([tail] if tail else [])]
    steps = [f"{select.replace(' FROM ', ', ' + ', '.join(f'({w})::HUGEINT AS w{i}' for i, w in enumerate(every)) + ', 0::HUGEINT AS h FROM ', 1)}"]
    for i in range(len(every)):
        steps.append(f"SELECT *, (w{i} * 3432918353::HUGEINT) & {mask} AS a{i} FROM ({steps[-1]})")
        steps.append(f"SELECT *, (({rot(f'a{i}', 15)}) * 461845907::HUGEINT) & {mask} AS b{i} FROM ({steps[-1]})")
        steps.append(f"SELECT * REPLACE (xor(h, b{i}) AS h) FROM ({steps[-1]})")
        if i < len(words):
            steps.append(f"SELECT * REPLACE (((({rot('h', 13)}) * 5) + 3864292196::HUGEINT) & {mask} AS h) FROM ({steps[-1]})")
    steps.append(f"SELECT * REPLACE (xor(h, {length}::HUGEINT) AS h) FROM ({steps[-1]})")
    for shift, k in ((16, 2246822507), (13, 3266489909), (16, 1)):
        steps.append(f"SELECT * REPLACE (((xor(h, h // {1 << shift}::HUGEINT)) * {k}::HUGEINT) & {mask} AS h) FROM ({steps[-1]})")
    own = select.split(" FROM ")[0].removeprefix("SELECT ")
    return f"SELECT {own}, CAST((h & 2147483647::HUGEINT) % {n} AS INTEGER) AS p FROM ({steps[-1]})"


def _long_words(column: str) -> list[str]:
    return [f"(({column}::HUGEINT + CASE WHEN {column} < 0 THEN 18446744073709551616::HUGEINT ELSE 0 END) // {1 << 32 * i}::HUGEINT) % 4294967296::HUGEINT" for i in range(2)]


def _text_words(column: str, length: int) -> list[str]:
    """Words of a text of so many ASCII characters, the last one the shorter tail."""
    return [" + ".join(f"ascii(substr({column}, {i + k + 1}, 1))::HUGEINT * {1 << 8 * k}" for k in range(min(4, length - i))) for i in range(0, length, 4)]


@query(_murmur_sql("SELECT o_orderkey FROM orders", _long_words("o_orderkey"), 8, 16))
def partition_bucket_long(spark, sf):
    df = table(spark, sf, "orders")
    return df.select("o_orderkey", P.bucket(F.col("o_orderkey"), df.schema["o_orderkey"].dataType, 16).alias("p"))


@query(_murmur_sql("SELECT c_custkey FROM customer", _text_words("substr(c_name, 1, 18)", 18)[:-1], 18, 16, _text_words("substr(c_name, 1, 18)", 18)[-1]))
def partition_bucket_text(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", F.substring("c_name", 1, 18).alias("c_name"))
    return df.select("c_custkey", P.bucket(F.col("c_name"), df.schema["c_name"].dataType, 16).alias("p"))


@query("SELECT event_id, 'data/' || strftime(ts, '%Y') || '/w' || strftime(ts, '%V') || '/' || strftime(ts, '%m-%d') || '/' || coalesce(event_type, 'none') AS path FROM events")
def partition_path_template(spark, sf):
    df = table(spark, sf, "events")
    return df.select("event_id", P.path_template(df, "data/{ts,,YYYY}/w{ts,,WW}/{ts,,MM}-{ts,,DD}/{event_type,none,}").alias("path"))


@query("SELECT o_orderkey, 'o_orderstatus=' || o_orderstatus || '/o_orderdate_year=' || CAST(year(o_orderdate) - 1970 AS VARCHAR) AS path FROM orders")
def partition_spec_path(spark, sf):
    df = table(spark, sf, "orders")
    return df.select("o_orderkey", P.partition_path(df, "/{o_orderstatus, identity}/{o_orderdate, year}").alias("path"))


# Layout, types, evolution


@query("SELECT o_custkey, '[' || string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) || ']' AS orders FROM orders GROUP BY o_custkey")
def flatten_json(spark, sf):
    nested = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("orders"))
    return flatten.flatten(nested)


@query(f"""SELECT '{{"o_orderkey":' || CAST(o_orderkey AS VARCHAR) || ',"status":' || coalesce('"' || status || '"', 'null') || '}}' AS data, CAST(o_orderkey AS VARCHAR) AS _row_id FROM ({_NULLED})""")
def raw_json_layout(spark, sf):
    df = _nulled(spark, sf)
    return flatten.raw_json(df.withColumn("_row_id", rowid.row_id(df, ["o_orderkey"])))


def _lca_sql() -> str:
    values = ", ".join(f"('{a}', '{b}', '{_lca(a, b)}')" for a in S.ALL_TYPES for b in S.ALL_TYPES)
    return f"SELECT * FROM (VALUES {values}) t(a, b, common)"


def _lca(a: str, b: str) -> str:
    """By hand: numbers widen to the next that holds both, times to the finer, all else to text."""
    numbers = ["boolean", "integer_small", "integer", "number"]
    times = ["timestamp", "timestamp_milli", "timestamp_micro", "timestamp_nano"]
    if a == b and a in (*numbers, *times, "number_small", "string"):
        return a
    if a in times and b in times:
        return times[max(times.index(a), times.index(b))]
    if a in numbers and b in numbers:
        return numbers[max(numbers.index(a), numbers.index(b))]
    return "number" if {a, b} <= {*numbers, "number_small"} else "string"


@query(_lca_sql())
def type_lca_matrix(spark, sf):
    return spark.createDataFrame([(a, b, S.common_type(a, b)) for a in S.ALL_TYPES for b in S.ALL_TYPES], "a string, b string, common string")


@query("SELECT o_orderkey, CASE WHEN t IN ('1', 'yes') THEN TRUE WHEN t IN ('0', 'no') THEN FALSE END AS b FROM (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '1' WHEN 1 THEN '0' WHEN 2 THEN 'yes' WHEN 3 THEN 'no' ELSE 'maybe' END AS t FROM orders)")
def coerce_bool(spark, sf):
    m = F.col("o_orderkey") % 5
    t = F.when(m == 0, "1").when(m == 1, "0").when(m == 2, "yes").when(m == 3, "no").otherwise("maybe")
    return table(spark, sf, "orders").select("o_orderkey", C.to_bool(t, T.StringType()).alias("b"))


@query("SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS i, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END AS j FROM orders")
def coerce_int(spark, sf):
    text = F.concat(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, "").otherwise("e3"))
    return table(spark, sf, "orders").select("o_orderkey", C.to_int(F.col("o_totalprice"), T.DoubleType()).alias("i"), C.to_int(text, T.StringType()).alias("j"))


@query("SELECT event_id, ts AS parsed, CASE WHEN event_id % 2 = 0 THEN date_trunc('second', ts) ELSE TIMESTAMP '1970-01-01' END AS lenient FROM events")
def coerce_timestamp(spark, sf):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    other = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise("2023-13-45")
    return table(spark, sf, "events").select("event_id", C.parse_timestamp(text).cast("timestamp_ntz").alias("parsed"), C.parse_timestamp(other, lenient=True).cast("timestamp_ntz").alias("lenient"))


@query("SELECT 'number' AS k, 'string' AS s, 'timestamp' AS d, 'boolean' AS b, 'string' AS n")
def infer_csv_types(spark, sf):
    df = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("k"), F.col("o_orderstatus").alias("s"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), F.when(F.col("o_orderkey") % 2 == 0, "true").otherwise("false").alias("b"), F.lit("").alias("n")
    )
    return infer.csv_types(df)


@query("SELECT CAST(o_orderkey AS DOUBLE) AS k, o_orderstatus AS status, CAST(NULL AS VARCHAR) AS name FROM orders UNION ALL SELECT c_acctbal, NULL, c_name FROM customer")
def schema_evolution_union(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"))
    b = table(spark, sf, "customer").select(F.col("c_acctbal").alias("k"), F.col("c_name").alias("name"))
    return evolve.union_by_name(a, b)


_DECISIONS = (
    ("boolean", "ok fail fail fail fail fail fail"), ("integer_small", "coerce ok promote fail fail fail fail"), ("integer", "coerce ok ok fail fail fail fail"),
    ("number_small", "fail fail fail ok promote fail fail"), ("number", "coerce coerce coerce ok ok fail fail"), ("timestamp", "fail fail fail fail fail ok fail"), ("string", "coerce coerce coerce coerce coerce coerce ok"),
)
_KINDS = [k for k, _ in _DECISIONS]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{x}')" for a, row in _DECISIONS for b, x in zip(_KINDS, row.split(), strict=True)) + ") t(existing, incoming, decision)")
def evolution_decisions(spark, sf):
    return spark.createDataFrame([(a, b, evolve.decision(a, b)) for a in _KINDS for b in _KINDS], "existing string, incoming string, decision string")


@query("SELECT n_name AS column_name, 'both' AS part FROM nation WHERE n_nationkey BETWEEN 5 AND 14 UNION ALL SELECT n_name, 'left' FROM nation WHERE n_nationkey < 5 UNION ALL SELECT n_name, 'right' FROM nation WHERE n_nationkey BETWEEN 15 AND 20")
def stream_set_ops(spark, sf):
    n = table(spark, sf, "nation")
    a, b = n.where("n_nationkey < 15").select("n_name"), n.where("n_nationkey between 5 and 20").select("n_name")
    parts = (("both", a.intersect(b)), ("left", a.exceptAll(b)), ("right", b.exceptAll(a)))
    out = None
    for name, df in parts:
        df = df.select(F.col("n_name").alias("column_name"), F.lit(name).alias("part"))
        out = df if out is None else out.unionByName(df)
    return out


@query("SELECT * FROM (VALUES ('s.changed', 'old_t'), ('s.new', 'new_t')) t(stream, destination_table)")
def catalog_delta(spark, sf):
    def one(name, mode, target):
        return Stream(name, "s", {"k": S.INT64}, ["cdc", "full_refresh"], ["k"], sync_mode=mode, destination_table=target)

    old = Catalog([one("same", "cdc", "t"), one("changed", "cdc", "old_t")], [Configured("same", "s"), Configured("changed", "s")])
    new = Catalog([one("same", "cdc", "t"), one("changed", "full_refresh", "old_t"), one("new", "cdc", "new_t")], [Configured("same", "s"), Configured("changed", "s"), Configured("new", "s")])
    return spark.createDataFrame([(s.id, s.destination_table) for s in difference(old, new).streams], "stream string, destination_table string")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' WHEN o_orderkey % 3 = 1 THEN o_orderpriority ELSE '__unchanged__' END AS v FROM orders")
def toast_recovery(spark, sf):
    m = F.col("o_orderkey") % 3
    return table(spark, sf, "orders").select("o_orderkey", C.replaced_unchanged(F.when(m == 0, "new"), F.when(m == 1, F.col("o_orderpriority"))).alias("v"))


@query("SELECT o_orderkey, CASE WHEN k < 0 THEN k + 256 ELSE k END AS u8, k AS u64 FROM (SELECT o_orderkey, o_orderkey % 256 - 128 AS k FROM orders)")
def unsigned_mask(spark, sf):
    k = F.col("o_orderkey") % 256 - 128
    return table(spark, sf, "orders").select("o_orderkey", C.unsigned(k, 8).alias("u8"), C.unsigned(k, 64).alias("u64"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'red' WHEN 2 THEN 'green' ELSE 'blue' END AS e, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'a' WHEN 2 THEN 'b' ELSE 'a,b' END AS s FROM orders")
def enum_set_decode(spark, sf):
    m = F.col("o_orderkey") % 4
    return table(spark, sf, "orders").select("o_orderkey", C.enum_label(m, ["red", "green", "blue"]).alias("e"), C.set_labels(m, ["a", "b"]).alias("s"))


@query("SELECT o_orderkey, lower(substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) || '-' || substr(md5(CAST(o_orderkey AS VARCHAR)), 9, 4) || '-' || substr(md5(CAST(o_orderkey AS VARCHAR)), 13, 4) || '-' || substr(md5(CAST(o_orderkey AS VARCHAR)), 17, 4) || '-' || substr(md5(CAST(o_orderkey AS VARCHAR)), 21, 12)) AS u FROM orders")
def uuid_decode(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", C.uuid_text(F.unhex(F.md5(F.col("o_orderkey").cast("string")))).alias("u"))


@query("SELECT * FROM (VALUES (1, 10, 50), (3, 0, 7)) t(partition, \"begin\", \"end\")")
def message_partition_plan(spark, sf):
    from tributary.sources.messages import plan_partitions

    rows = spark.createDataFrame([(0, 5, 0, 5), (1, 10, 0, 50), (2, None, 0, 0), (3, None, 0, 7)], "partition int, committed int, first int, end int")
    return plan_partitions(rows)


@query("SELECT event_id AS id, event_type AS kind, user_id % 4 AS _kafka_partition, event_id AS _kafka_offset FROM events WHERE event_id % 7 <> 0 AND event_id % 5 <> 0")
def message_decode(spark, sf):
    from tributary.sources.messages import decode_json

    body = F.when(F.col("event_id") % 7 == 0, F.lit(None)).when(F.col("event_id") % 5 == 0, F.lit("not json")).otherwise(F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))))
    messages = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("key"), body.alias("value"), (F.col("user_id") % 4).alias("partition"), F.col("event_id").alias("offset"), F.col("ts").alias("timestamp"))
    return decode_json(messages, "id bigint, kind string")[0].select("id", "kind", "_kafka_partition", "_kafka_offset")


from tributary.plans import sync_queries  # noqa: E402, F401  registers its queries
