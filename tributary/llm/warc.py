"""WARC archives: a native writer and a Python data source that reads them.

Writing: each page becomes one record, built from SQL expressions, and Spark's text sink writes the records with the
record terminator (two CRLF) as its line separator, gzip-compressed. So archives go through Spark's commit protocol to
any file system, and a lost executor's tasks are simply run again. Pages with equal payloads of at least
``min_payload_bytes`` bytes are stored once: the one with the largest page_id is a ``response``, the others are
``revisit`` records that name it and hold no payload.

Reading: ``spark.read.format("warc")`` plans one partition for each group of archive files of about
``partition_bytes``; equality and IN predicates on record_type and the other header columns are pushed down; of each
record the header is parsed first, and the block of a record that no predicate wants, or any block under the option
``payload = none``, is passed over without being decoded. ``verify = true`` compares payloads with their digests.

Cases: a null html is an empty payload; a null page_id is always a response and is never referred to; rows that repeat
the largest page_id are all responses; a null url leaves out the target, white space and control characters in a url
become %20; other columns are not looked at; an empty table gives an archive without records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from tributary.llm.common import drop_stage, stage, stage_path

SCHEMA = "record_type string, record_id string, page_id long, target_uri string, payload_digest string, refers_to long, content_type string, payload_bytes long, payload binary, file string"
_EOL = "\r\n"


def base32_sha1(payload) -> F.Column:
    """Upper-case base32 of a payload's SHA-1: four groups of 40 bits, eight characters each."""
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
    hexed = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), digits, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, min_payload_bytes: int = 0) -> tuple[DataFrame, str]:
    """The text of one WARC record for each page, and the stage table of repeated payloads that it reads."""
    body = F.coalesce(F.col("html"), F.lit(""))
    known = pages.select("page_id", "url", body.alias("body")).withColumn("size", F.octet_length("body")).withColumn("digest", base32_sha1(F.col("body")))
    copies = known.where(F.col("size") >= min_payload_bytes).groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1").select("digest", "kept")
    copies, path = stage(copies, "warc-copies")
    rows = known.join(copies, "digest", "left").withColumn("refers_to", F.when((F.col("size") >= min_payload_bytes) & (F.col("kept") > F.col("page_id")), F.col("kept")))
    kind = F.when(F.col("refers_to").isNull(), F.lit("response")).otherwise(F.lit("revisit"))
    uuid = lambda c: F.regexp_replace(F.md5(F.concat(F.lit("page:"), c.cast("string"))), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(_EOL)), F.lit(""))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_EOL}Content-Type: text/html; charset=utf-8{_EOL}Content-Length: "), F.col("size").cast("string"), F.lit(_EOL + _EOL))
    block = F.when(F.col("refers_to").isNull(), F.concat(http, F.col("body"))).otherwise(http)
    return rows.withColumn("block", block).select(
        F.concat(
            F.lit(f"WARC/1.1{_EOL}"),
            line("WARC-Type", kind),
            line("WARC-Record-ID", F.coalesce(uuid(F.col("page_id")), uuid(F.col("digest")))),
            line("WARC-Date", F.lit("2000-01-01T00:00:00Z")),
            line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            line("WARC-Profile", F.when(F.col("refers_to").isNotNull(), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
            line("WARC-Refers-To", uuid(F.col("refers_to"))),
            line("X-Page-Id", F.col("page_id").cast("string")),
            line("X-Refers-To-Page-Id", F.col("refers_to").cast("string")),
            line("Content-Type", F.lit("application/http; msgtype=response")),
            line("Content-Length", F.octet_length("block").cast("string")),
            F.lit(_EOL),
            F.col("block"),
        ).alias("value")
    ), path


def write(pages: DataFrame, path: str | None = None, *, min_payload_bytes: int = 0) -> str:
    """Write the archives of pages into a folder and return it."""
    spark = pages.sparkSession
    path = path or stage_path(spark, "warc")
    rows, copies = records(pages, min_payload_bytes)
    rows.write.option("lineSep", _EOL + _EOL).option("compression", "gzip").text(path)
    drop_stage(spark, copies)
    return path


class ArchiveFiles(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace(":", "://", 1))


def parse(stream: io.BufferedIOBase, wanted, with_payload: bool, verify: bool, name: str) -> Iterator[dict]:
    """Records of one archive. wanted(headers as columns) decides before the block is read."""
    while True:
        line = stream.readline()
        if not line:
            return
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{name}: no WARC record where one should begin")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n"):
            if not line:
                raise ValueError(f"{name}: a header ends early")
            key, _, value = line.decode("utf-8", "replace").partition(":")
            head[key.strip().lower()] = value.strip()
        left = int(head["content-length"])
        number = lambda k: int(head[k]) if k in head else None  # noqa: B023, E731
        row = {
            "record_type": head.get("warc-type"), "record_id": head.get("warc-record-id"), "page_id": number("x-page-id"), "target_uri": head.get("warc-target-uri"),
            "payload_digest": (head.get("warc-payload-digest") or "").removeprefix("sha1:") or None, "refers_to": number("x-refers-to-page-id"), "content_type": head.get("content-type"), "file": name,
        }
        if not wanted(row):
            _skip(stream, left, name)
            continue
        size = left
        if (row["content_type"] or "").startswith("application/http"):
            while (line := stream.readline()) not in (b"\r\n", b"\n"):
                left -= len(line)
                if not line or left < 0:
                    raise ValueError(f"{name}: an HTTP header ends early")
                if line.lower().startswith(b"content-length:"):
                    size = int(line.split(b":")[1])
            left -= len(line)
        row["payload_bytes"], row["payload"] = size, None
        if row["record_type"] == "revisit" or not (with_payload or verify):
            _skip(stream, left, name)
        else:
            payload = stream.read(left)
            if len(payload) < left:
                raise ValueError(f"{name}: a payload ends early")
            if verify and row["payload_digest"] != base64.b32encode(hashlib.sha1(payload).digest()).decode():
                raise ValueError(f"{name}: a payload doesn't have its digest")
            row["payload"] = payload if with_payload else None
        yield row


def _skip(stream, size: int, name: str) -> None:
    while size:
        got = len(stream.read(min(size, 1 << 20)))
        if not got:
            raise ValueError(f"{name}: a block ends early")
        size -= got


class WarcReader(DataSourceReader):
    def __init__(self, schema, options: dict):
        self.schema, self.path = schema, options["path"]
        self.with_payload = options.get("payload", "bytes") != "none"
        self.verify = str(options.get("verify", "false")).lower() == "true"
        self.partition_bytes = int(options.get("partition_bytes", 64 << 20))
        self.equal: list[tuple[str, tuple]] = []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] not in ("payload", "payload_bytes"):
                self.equal.append((f.attribute[0], (f.value,)))
            elif isinstance(f, In) and len(f.attribute) == 1 and f.attribute[0] not in ("payload", "payload_bytes"):
                self.equal.append((f.attribute[0], tuple(f.value)))
            else:
                yield f

    def partitions(self):
        fs, root = _open(self.path)
        found = sorted((x.path, x.size) for x in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if x.is_file and not x.base_name.startswith(("_", ".")) and x.size)
        groups, total = [[]], 0
        for name, size in found:
            if groups[-1] and total + size > self.partition_bytes:
                groups.append([])
                total = 0
            groups[-1].append(name)
            total += size
        return [ArchiveFiles(g) for g in groups]

    def read(self, partition: ArchiveFiles):
        fs, _ = _open(self.path)
        equal, fields = self.equal, self.schema.fieldNames()
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(self.schema)
        wanted = lambda row: all(row[k] in values for k, values in equal)
        rows: list[dict] = []
        size = 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], target.field(n).type) for n in fields], schema=target)

        for name in partition.files:
            with fs.open_input_stream(name, compression=None) as raw:
                plain = io.BufferedReader(gzip.GzipFile(fileobj=raw) if name.endswith(".gz") else raw, 1 << 20)
                for row in parse(plain, wanted, self.with_payload, self.verify, name):
                    rows.append(row)
                    size += len(row["payload"] or b"") + 200
                    if size > 8 << 20 or len(rows) >= 10_000:
                        yield batch()
                        rows.clear()
                        size = 0
        if rows:
            yield batch()


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(schema, dict(self.options))


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The records of all archives in a folder."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").options(**options).load(path)
