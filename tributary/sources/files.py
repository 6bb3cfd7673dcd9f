"""Files in folders: CSV, JSON, XML and Parquet; one stream for each first folder, plain and gzip files alike."""

from __future__ import annotations

import csv
import datetime as dt
import re
from collections import Counter

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary import types as S
from tributary.catalog import FULL_REFRESH, INCREMENTAL, Stream
from tributary.functions.coerce import coerce
from tributary.functions.infer import csv_types, observed_types
from tributary.operators.chunks import Chunk, pack_files
from tributary.sources.base import Source, register

MODIFIED = "_last_modified_time"
_SUFFIX = {"csv": (".csv", ".csv.gz"), "json": (".json", ".jsonl", ".json.gz", ".jsonl.gz"), "xml": (".xml", ".xml.gz"), "parquet": (".parquet",)}


def modified_column() -> Column:
    return F.date_format(F.col("_metadata.file_modification_time"), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _second(ms: int) -> str:
    return dt.datetime.fromtimestamp(ms // 1000, dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


@register("files")
class FileSource(Source):
    options = {"path": "string!", "format": "string!", "file_pattern": "string", "delimiter": "string", "has_header": "boolean", "skip_rows": "integer", "multi_line": "boolean", "row_identifier": "string", "prefer_long": "boolean", "compression": "string"}

    def __init__(self, spark, config):
        super().__init__(spark, config)
        if config["format"] not in _SUFFIX:
            raise ValueError(f"an unknown format: {config['format']}")
        if config.get("compression", "gzip") not in ("gzip", "none", ""):
            raise ValueError("only gzip compression is read")
        self._known: dict[tuple[str, str], tuple[list, object]] = {}

    def files(self) -> list[tuple[str, str, int, int]]:
        """(stream, path, size, time of modification) of all matching files; contents aren't read."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.config["path"])
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        base = fs.makeQualified(root).toString().rstrip("/") + "/"
        pattern, found, it = re.compile(self.config.get("file_pattern", "")), [], fs.listFiles(root, True)
        while it.hasNext():
            f = it.next()
            path = f.getPath().toString()
            rest = path.removeprefix(base)
            if path.endswith(_SUFFIX[self.config["format"]]) and pattern.search(rest) and not re.search(r"(^|/)[_.]", rest):
                found.append((rest.split("/")[0] if "/" in rest else "root", path, f.getLen(), f.getModificationTime()))
        return sorted(found)

    def discover(self) -> list[Stream]:
        out = []
        for name in sorted({f[0] for f in self.files()}):
            s = Stream(name, "", {}, [FULL_REFRESH, INCREMENTAL], [], [MODIFIED])
            s.schema = {f.name: S.from_spark(f.dataType) for f in self.table(s).schema} | {MODIFIED: S.STRING}
            out.append(s)
        return out

    def _learned(self, stream: Stream, what: str, learn):
        """learn(all paths of the stream), kept until its files change: what holds for a stream rests on all of its rows."""
        now = [f for f in self.files() if f[0] == stream.name]
        if self._known.get((stream.name, what), ((), None))[0] != now:
            self._known[stream.name, what] = now, learn([f[1] for f in now])
        return self._known[stream.name, what][1]

    def _paths(self, stream: Stream) -> list[str]:
        return [f[1] for f in self.files() if f[0] == stream.name]

    def chunks(self, stream: Stream) -> list[Chunk]:
        """Files packed to about 2 GiB; a chunk's low end is its list of files."""
        return [Chunk(tuple(group)) for group in pack_files([(f[1], f[2]) for f in self.files() if f[0] == stream.name])]

    def scan(self, stream: Stream, chunk: Chunk) -> DataFrame:
        return self.read(stream, list(chunk.low)) if chunk.low else self.table(stream)

    def scan_many(self, stream: Stream, chunks: list[Chunk]) -> DataFrame:
        return self.scan(stream, Chunk(tuple(path for c in chunks for path in c.low or ())))

    def table(self, stream: Stream) -> DataFrame:
        return self.read(stream, self._paths(stream))

    def max_cursor(self, stream: Stream, cursors: list[str]) -> dict:
        """The latest time of modification, from the listing alone."""
        if cursors != [MODIFIED]:
            return super().max_cursor(stream, cursors)
        return {MODIFIED: max((_second(f[3]) for f in self.files() if f[0] == stream.name), default=None)}

    def incremental(self, stream: Stream, last: dict, seen: tuple[str, ...] | None = None) -> DataFrame:
        """Files modified after the cursor; with ``seen``, also files of its very second that aren't in it."""
        at = last[MODIFIED]
        new = [f[1] for f in self.files() if f[0] == stream.name and (_second(f[3]) > at or (seen is not None and _second(f[3]) == at and f[1] not in seen))]
        return self.read(stream, new) if new else self.table(stream).limit(0)

    def read(self, stream: Stream, paths: list[str]) -> DataFrame:
        raw = getattr(self, f"_{self.config['format']}")(stream, paths)
        return raw.select("*", modified_column().alias(MODIFIED)) if MODIFIED not in raw.columns else raw

    def _typed(self, raw: DataFrame, kinds: dict[str, str]) -> DataFrame:
        cell = lambda n: F.when((F.col(f"`{n}`") != "") & (F.lower(F.col(f"`{n}`")) != "null"), F.col(f"`{n}`")) if n in raw.columns else F.lit(None).cast("string")
        return raw.select(*[coerce(cell(n), T.StringType(), t).alias(n) for n, t in kinds.items()], F.col(MODIFIED))

    def _first_lines(self, path: str, n: int) -> list[str]:
        """The first n lines of a plain or gzip file."""
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        stream = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).open(where)
        try:
            lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(jvm.java.util.zip.GZIPInputStream(stream) if path.endswith(".gz") else stream, "UTF-8"))
            found = []
            while len(found) < n and (line := lines.readLine()) is not None:
                found.append(line)
            return found
        finally:
            stream.close()

    def _after_skipped(self, paths: list[str]) -> DataFrame:
        """The lines of files as one column, without the rows to skip and the header of each.

        Of lines that are equal to a skipped one of their file, as many go as were skipped: it makes no difference which."""
        n = self.config["skip_rows"] + int(self.config.get("has_header", True))
        gone = Counter((path, line) for path in paths for line in self._first_lines(path, n))
        table = self.spark.createDataFrame([(p, line, k) for (p, line), k in gone.items()], "__file string, __line string, __n int")
        lines = self.spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("__path"), modified_column().alias(MODIFIED))
        marked = lines.join(F.broadcast(table), (F.col("__path") == F.col("__file")) & (F.col("value") == F.col("__line")), "left")  # n lines of each file
        nth = F.row_number().over(Window.partitionBy("__path", "value").orderBy(F.lit(1)))
        kept = marked.where("__n is not null").withColumn("nth", nth).where("nth > __n").drop("nth")
        return marked.where("__n is null").unionByName(kept).where("value <> ''").select("value", MODIFIED)

    def _first_line(self, path: str) -> str:
        """The first line of a plain or gzip file that isn't blank."""
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        stream = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).open(where)
        try:
            lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(jvm.java.util.zip.GZIPInputStream(stream) if path.endswith(".gz") else stream, "UTF-8"))
            while (line := lines.readLine()) is not None and not line.strip():
                pass
            return line or ""
        finally:
            stream.close()

    def _csv(self, stream: Stream, paths: list[str]) -> DataFrame:
        """Each file by its own header (or its number of columns, if it has none); files come together by name."""
        c = self.config
        header = c.get("has_header", True)

        def reader():
            out = self.spark.read.option("sep", c.get("delimiter", ",")).option("header", header).option("mode", "PERMISSIVE").option("quote", '"').option("escape", '"')
            return out.option("multiLine", True) if c.get("multi_line") else out

        if c.get("skip_rows") and c.get("multi_line"):
            raise ValueError("rows can't be skipped in files whose cells have line breaks")
        options = {"sep": c.get("delimiter", ","), "quote": '"', "escape": '"'}

        def columns_after(path: str) -> tuple[str, ...]:
            """The columns of a file below the rows to skip."""
            line = (self._first_lines(path, c["skip_rows"] + 1)[c["skip_rows"] :] or [""])[0]
            cells = next(csv.reader([line], delimiter=options["sep"]), [])
            return tuple(n if header else f"column_{i}" for i, n in enumerate(cells))

        def columns(every: list[str]) -> dict[str, tuple[str, ...]]:
            """The columns of each file; files with the same first line are looked at once, unless a header can go on in the next line."""
            if c.get("skip_rows"):
                return {path: columns_after(path) for path in every}
            alike: dict[str, list[str]] = {}
            for path in every:
                alike.setdefault(path if c.get("multi_line") else self._first_line(path), []).append(path)
            out = {}
            for group in alike.values():
                first = reader().csv(group[0]).columns
                out |= dict.fromkeys(group, tuple(n if header else f"column_{i}" for i, n in enumerate(first)))
            return out

        own = self._learned(stream, "columns", columns)

        def together(some: list[str]) -> DataFrame:
            groups: dict[tuple[str, ...], list[str]] = {}
            for path in some:
                groups.setdefault(own[path], []).append(path)
            out = None
            for names, group in groups.items():
                schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
                if c.get("skip_rows"):
                    part = self._after_skipped(group).select(F.from_csv("value", ", ".join(f"`{n}` string" for n in names), options).alias("r"), MODIFIED).select("r.*", MODIFIED)
                else:
                    part = reader().schema(schema).csv(group).select("*", modified_column().alias(MODIFIED))
                out = part if out is None else out.unionByName(part, allowMissingColumns=True)
            return out

        kinds = self._learned(stream, "types", lambda every: csv_types(together(every).drop(MODIFIED), c.get("prefer_long", False)).head().asDict())
        return self._typed(together(paths), kinds)

    def _json(self, stream: Stream, paths: list[str]) -> DataFrame:
        reader = self.spark.read.option("multiLine", self.config.get("multi_line", False)).option("mode", "PERMISSIVE")

        def columns(every: list[str]) -> T.StructType:
            found = reader.option("primitivesAsString", False).json(every).schema
            number = lambda k: T.DoubleType() if isinstance(k, T.LongType) and not self.config.get("prefer_long") else k
            return T.StructType([T.StructField(f.name, number(f.dataType)) for f in found if f.name != "_corrupt_record"])

        schema = self._learned(stream, "columns", columns)
        kinds = self._learned(stream, "types", lambda every: observed_types(reader.schema(schema).json(every)))
        raw = reader.schema(schema).json(paths)
        out = []
        for f in raw.schema:
            c, kind = F.col(f"`{f.name}`"), kinds[f.name]
            out.append((coerce(c, f.dataType, kind) if kind.startswith("timestamp") else c).alias(f.name))
        return raw.select(*out, modified_column().alias(MODIFIED))

    def _xml(self, stream: Stream, paths: list[str]) -> DataFrame:
        """Elements of the row's tag; attributes have an underscore before their name, a repeated child's last value counts.

        A file is read by one task, whatever its size; columns are those of all files, looked for in one pass."""
        reader = self.spark.read.format("xml").option("rowTag", self.config.get("row_identifier", "row")).option("attributePrefix", "_").option("inferSchema", False)
        schema = self._learned(stream, "columns", lambda every: reader.load(every).schema)
        raw = reader.schema(schema).load(paths)
        out = []
        for f in raw.schema:
            c, kind = F.col(f"`{f.name}`"), f.dataType
            if isinstance(kind, T.ArrayType):
                c, kind = F.try_element_at(c, F.lit(-1)), kind.elementType
            if isinstance(kind, T.StructType):
                c = F.to_json(c)
            elif not f.name.startswith("_"):
                c = F.when(F.trim(c) != "", c)
            out.append(c.alias(f.name))
        return raw.select(*out)

    def _parquet(self, stream: Stream, paths: list[str]) -> DataFrame:
        """Decimals land as doubles, dates as timestamps; bytes that aren't text as base64. Columns are those of all files."""
        from tributary.operators.evolve import union_by_name
        from tributary.operators.flatten import flatten

        def columns(every: list[str]) -> list[tuple[T.StructType, set[str]]]:
            """One schema for all files; where their types can't be merged, the files of each schema."""
            try:
                return [(self.spark.read.option("mergeSchema", True).parquet(*every).schema, set(every))]
            except (PySparkException, Py4JJavaError) as e:
                if "CANNOT_MERGE" not in str(e):
                    raise
            alike: dict[str, tuple[T.StructType, set[str]]] = {}
            for path in every:
                schema = self.spark.read.parquet(path).schema
                alike.setdefault(schema.json(), (schema, set()))[1].add(path)
            return list(alike.values())

        out = None
        for schema, own in self._learned(stream, "columns", columns):
            group = [p for p in paths if p in own]
            if group:
                part = flatten(self.spark.read.schema(schema).parquet(*group).select("*", modified_column().alias(MODIFIED)))
                out = part if out is None else union_by_name(out, part)
        return out
