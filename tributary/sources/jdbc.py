"""Relational sources through Spark's JDBC reader: one predicate for each chunk, pushed down with filters and columns.

Needs the database's driver on the class path; ``check`` says so when it is missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tributary import types as S
from tributary.catalog import FULL_REFRESH, INCREMENTAL, Stream
from tributary.operators import chunks as K
from tributary.sources.base import Source, register

DRIVERS = {"postgres": "org.postgresql.Driver", "mysql": "com.mysql.cj.jdbc.Driver", "mssql": "com.microsoft.sqlserver.jdbc.SQLServerDriver", "oracle": "oracle.jdbc.OracleDriver", "db2": "com.ibm.db2.jcc.DB2Driver"}
# Names of the systems' own row addresses, by which tables without a key are cut.
ROW_ADDRESS = {"postgres": "ctid", "oracle": "ROWID", "mssql": "%%physloc%%", "db2": "RID()"}
#: Queries for the tables and columns that a user may read.
TABLES = {
    "postgres": "SELECT table_schema AS s, table_name AS t FROM information_schema.tables WHERE table_schema NOT IN ('pg_catalog', 'information_schema')",
    "mysql": "SELECT table_schema AS s, table_name AS t FROM information_schema.tables WHERE table_type = 'BASE TABLE' AND table_schema = DATABASE()",
    "mssql": "SELECT table_schema AS s, table_name AS t FROM information_schema.tables WHERE table_type = 'BASE TABLE'",
    "oracle": "SELECT owner AS s, table_name AS t FROM all_tables WHERE owner = USER",
    "db2": "SELECT tabschema AS s, tabname AS t FROM syscat.tables WHERE type = 'T' AND tabschema NOT LIKE 'SYS%'",
}
KEYS = {
    "postgres": "SELECT kc.table_schema AS s, kc.table_name AS t, kc.column_name AS c FROM information_schema.table_constraints tc JOIN information_schema.key_column_usage kc ON kc.constraint_name = tc.constraint_name AND kc.table_schema = tc.table_schema WHERE tc.constraint_type = 'PRIMARY KEY' ORDER BY kc.ordinal_position",
    "oracle": "SELECT cc.owner AS s, cc.table_name AS t, cc.column_name AS c FROM all_constraints k JOIN all_cons_columns cc ON cc.constraint_name = k.constraint_name AND cc.owner = k.owner WHERE k.constraint_type = 'P' ORDER BY cc.position",
    "db2": "SELECT tabschema AS s, tabname AS t, colname AS c FROM syscat.keycoluse ORDER BY colseq",
}
KEYS["mysql"] = KEYS["mssql"] = KEYS["postgres"]


@register("jdbc")
class JdbcSource(Source):
    options = {"dialect": "string!", "url": "string!", "user": "string", "password": "string", "chunk_rows": "integer", "chunk_column": "string", "fetch_size": "integer"}

    def _reader(self):
        c = self.config
        return self.spark.read.format("jdbc").options(url=c["url"], user=c.get("user", ""), password=c.get("password", ""), driver=DRIVERS[c["dialect"]], fetchsize=c.get("fetch_size", 10_000))

    def check(self) -> None:
        jvm = self.spark.sparkContext._jvm
        try:
            jvm.java.lang.Class.forName(DRIVERS[self.config["dialect"]])
        except Exception as e:
            raise RuntimeError(f"no driver {DRIVERS[self.config['dialect']]} on the class path") from e
        self._reader().option("query", "SELECT 1 AS one").load().head()

    def discover(self) -> list[Stream]:
        keys: dict[tuple, list] = {}
        for r in self._reader().option("query", KEYS[self.config["dialect"]]).load().collect():
            keys.setdefault((r[0], r[1]), []).append(r[2])
        out = []
        for space, name in (tuple(r) for r in self._reader().option("query", TABLES[self.config["dialect"]]).load().collect()):
            s = Stream(name, space, {}, [FULL_REFRESH, INCREMENTAL], keys.get((space, name), []))  # logs are read from recorded events (streaming.logs)
            s.schema = {f.name: S.from_spark(f.dataType) for f in self.table(s).schema}
            s.cursor_candidates = sorted(s.schema)
            out.append(s)
        return out

    def table(self, stream: Stream) -> DataFrame:
        return self._reader().option("dbtable", stream.id).load()

    def _chunk_keys(self, stream: Stream) -> list[str]:
        """What the table is cut by: the chosen column, else the key, else the system's own row address where it has an order."""
        if c := self.config.get("chunk_column"):
            return [c]
        return stream.primary_key or ([ROW_ADDRESS["postgres"]] if self.config["dialect"] == "postgres" else [])

    def chunks(self, stream: Stream) -> list[K.Chunk]:
        key, rows = self._chunk_keys(stream), self.config.get("chunk_rows", 1_000_000)
        if not key:
            return [K.Chunk()]
        if key == [ROW_ADDRESS["postgres"]]:
            return self._page_chunks(stream)
        df = self.table(stream)
        low, high, n = df.selectExpr(f"min({key[0]})", f"max({key[0]})", "count(*)").head()
        if n and len(key) == 1 and isinstance(low, int):
            try:
                return K.even_int(low, high, n, rows)
            except ValueError:
                pass
        return K.chunks_of([tuple(r[1:]) for r in K.every_nth_key(df, key, rows).collect()]) if n else [K.Chunk()]

    def _page_chunks(self, stream: Stream) -> list[K.Chunk]:
        """Ranges of the pages of a table without a key; the last one is open, so pages that come later are in it."""
        size = f"SELECT current_setting('block_size')::int AS size, (pg_relation_size('{stream.id}') / current_setting('block_size')::int)::bigint AS pages"
        block, pages = self._reader().option("query", size).load().head()
        at = lambda page: None if page is None else f"({page},0)"
        return [K.Chunk(at(c.low), at(c.high)) for c in K.pages(int(block), int(pages))]

    def predicates(self, stream: Stream, chunks: list[K.Chunk]) -> list[str]:
        return [K.sql_predicate(self._chunk_keys(stream), c) for c in chunks]

    def scan(self, stream: Stream, chunk: K.Chunk) -> DataFrame:
        return self.scan_many(stream, [chunk])

    def scan_many(self, stream: Stream, chunks: list[K.Chunk]) -> DataFrame:
        """Chunks as the partitions of one scan, each read by a query of its own."""
        c = self.config
        if not self._chunk_keys(stream):
            return self.table(stream)
        properties = {"user": c.get("user", ""), "password": c.get("password", ""), "driver": DRIVERS[c["dialect"]], "fetchsize": str(c.get("fetch_size", 10_000))}
        return self.spark.read.jdbc(c["url"], stream.id, predicates=self.predicates(stream, chunks), properties=properties)
