"""Tables as Parquet files with a log of commits; upserts are merged when the table is read.

``data/<id>/`` holds the files of one commit, ``log/<n>.json`` what the commit added, and each ``CHECKPOINT`` commits a
``log/<n>.checkpoint.json`` the whole: schema, folders, position and the last batch ids. A commit is the atomic creation
of its log file; two writers of one version conflict, and a batch whose id is in the log is not applied twice.

Each row carries the version that wrote it. An upsert writes the last event of each of its keys and no more: a row is
superseded if an upsert of a later version has its key. So an upsert costs what its batch costs, whatever the table's
size, and reading joins rows with the keys of the upserts alone. ``compact`` merges the upserts into one folder (done
by itself after ``DELTAS`` of them), or the whole table.

Partitions: directories hold the values of transforms of columns (see functions.transforms), made for pruning and
layout; the columns themselves stay in the files, so their values and types are what was written. Folders that were
written under the same schema are one scan, whatever their number.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary import types as S
from tributary.functions import transforms
from tributary.functions.rowid import OP_TYPE, ROW_ID, stored_op
from tributary.operators import evolve, merge

VERSION = "__version"
#: Commits between checkpoints of the log, batch ids it keeps, and upserts after which they are merged.
CHECKPOINT, BATCHES, DELTAS = 20, 1000, 16


class Conflict(RuntimeError):
    """Another writer committed this version first."""


class Table:
    def __init__(self, spark: SparkSession, path: str, *, strict: bool = True):
        self.spark, self.path, self.strict = spark, path.rstrip("/"), strict
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # The log

    def _read_text(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _log(self) -> tuple[list[int], list[int]]:
        """Versions, and versions with a checkpoint."""
        log = self._path(f"{self.path}/log")
        names = [s.getPath().getName() for s in self._fs.listStatus(log)] if self._fs.exists(log) else []
        numbered = lambda end: sorted(int(n.removesuffix(end)) for n in names if n.endswith(end) and n.removesuffix(end).isdigit())
        return numbered(".json"), numbered(".checkpoint.json")

    def version(self) -> int:
        return max(self._log()[0], default=0)

    def meta(self, version: int | None = None) -> dict:
        """Schema, folders, position and batch ids at a version: a checkpoint and the commits since."""
        versions, checkpoints = self._log()
        n = max(versions, default=0) if version is None else version
        base = max((c for c in checkpoints if c <= n), default=0)
        meta = json.loads(self._read_text(f"{self.path}/log/{base:010d}.checkpoint.json")) if base else {"version": 0, "schema": {}, "folders": [], "position": None, "batches": [], "dedup_inserts": False}
        for v in range(base + 1, n + 1):
            meta = self._after(meta, json.loads(self._read_text(f"{self.path}/log/{v:010d}.json")))
        return meta

    @staticmethod
    def _after(meta: dict, change: dict) -> dict:
        gone = set(change["removed"])
        folders = [f for f in meta["folders"] if not change["replace"] and f["id"] not in gone] + change["added"]
        batches = ([] if change["replace"] else meta["batches"]) + ([change["batch"]] if change["batch"] else [])
        return {"version": change["version"], "schema": change["schema"], "folders": folders, "position": change["position"], "batches": batches[-BATCHES:], "dedup_inserts": change["dedup_inserts"]}

    def _publish(self, meta: dict, **change) -> int:
        done = {"version": meta["version"] + 1, "replace": False, "added": [], "removed": [], "batch": None, **{k: meta[k] for k in ("schema", "position", "dedup_inserts")}, **change}
        name = f"{self.path}/log/{done['version']:010d}"
        if not self._create(f"{name}.json", done):
            raise Conflict(f"version {done['version']} of {self.path} was committed by another writer")
        if done["version"] % CHECKPOINT == 0:
            self._create(f"{name}.checkpoint.json", self._after(meta, done))
        return done["version"]

    def _create(self, path: str, content: dict) -> bool:
        self._fs.mkdirs(self._path(f"{self.path}/log"))
        new, target = self._path(f"{self.path}/log/.{uuid.uuid4().hex}.new"), self._path(path)
        stream = self._fs.create(new, False)
        try:
            stream.write(bytearray(json.dumps(content).encode()))
        finally:
            stream.close()
        if not self._fs.exists(target) and self._fs.rename(new, target):
            return True
        self._fs.delete(new, False)
        return False

    # Rows

    def _folders(self, folders: list[dict], schema: dict[str, str]) -> DataFrame | None:
        """Rows of some folders under a schema, with their versions; one scan for folders that were written alike."""
        alike: dict[str, list[dict]] = {}
        for f in folders:
            alike.setdefault(json.dumps(f["schema"]), []).append(f)
        out = None
        for same in alike.values():
            kinds = T.StructType([T.StructField(n, S.to_spark(t)) for n, t in same[0]["schema"].items()] + [T.StructField(VERSION, T.LongType())])
            rows = self.spark.read.schema(kinds).option("recursiveFileLookup", True).parquet(*[f"{self.path}/data/{f['id']}" for f in same])
            part = evolve.conform(rows, {**schema, VERSION: S.INT64})
            out = part if out is None else out.unionByName(part)
        return out

    def _live(self, meta: dict) -> DataFrame | None:
        rows = self._folders(meta["folders"], meta["schema"])
        deltas = [f for f in meta["folders"] if f["upsert"]]
        if not deltas or len(meta["folders"]) == 1:
            return rows
        last = self._folders(deltas, meta["schema"]).groupBy(ROW_ID).agg(F.max(VERSION).alias("__last"))
        joined = rows.join(last, ROW_ID, "left").where(F.col("__last").isNull() | (F.col(VERSION) >= F.col("__last")))
        return joined.select(*[F.col(f"`{n}`") for n in rows.columns])

    def read(self, version: int | None = None) -> DataFrame | None:
        """The table at a version, under its schema; None before the first rows."""
        rows = self._live(self.meta(version))
        return None if rows is None else rows.drop(VERSION)

    def _write(self, rows: DataFrame, partition: str | None, max_records_per_file: int) -> str:
        """A new folder of rows. Tasks of a partition are split or joined by size, so that a hot partition is many files and not one task."""
        name, dirs = uuid.uuid4().hex, []
        if partition:
            for i, (column, how, arg) in enumerate(transforms.parse_spec(partition)):
                dirs.append(f"__p{i}_{transforms.partition_name(column, how)}")
                rows = rows.withColumn(dirs[-1], transforms.transform(rows, column, how, arg))
            rows = rows.hint("rebalance", *dirs)
        writer = rows.write.option("compression", "snappy")
        if max_records_per_file:
            writer = writer.option("maxRecordsPerFile", max_records_per_file)
        (writer.partitionBy(*dirs) if dirs else writer).parquet(f"{self.path}/data/{name}")
        return name

    def commit(self, batch: DataFrame | None, *, batch_id: str, mode: str = "append", order: list[str] | None = None, position: dict | None = None, replace: bool = False, dedup_inserts: bool | None = None, partition: str | None = None, max_records_per_file: int = 0) -> int:
        """Write a batch and commit it with its position; returns the version. An empty batch still moves the position."""
        meta = self.meta()
        if batch_id in meta["batches"] and not replace:
            return meta["version"]
        schema, added = {} if replace else meta["schema"], []
        if batch is not None:
            change = evolve.evolve_strict if self.strict and schema else evolve.evolve_widening
            schema = change(schema, evolve.schema_of(batch))
            rows = evolve.conform(batch.withColumn(OP_TYPE, stored_op(F.col(OP_TYPE))) if OP_TYPE in batch.columns else batch, schema)
            if mode == "upsert":
                rows = merge.latest(rows, order or [ROW_ID])
            rows = rows.withColumn(VERSION, F.lit(meta["version"] + 1).cast("long"))
            added.append({"id": self._write(rows, partition, max_records_per_file), "schema": schema, "upsert": mode == "upsert", **({"partition": partition} if partition else {})})
        change = {"schema": schema, "added": added, "batch": batch_id, "replace": replace}
        if position is not None:
            change["position"] = position
        if dedup_inserts is not None:
            change["dedup_inserts"] = dedup_inserts
        version = self._publish(meta, **change)
        if mode == "upsert" and sum(f["upsert"] for f in meta["folders"]) + 1 >= DELTAS:
            return self.compact()
        return version

    def compact(self, full: bool = False, partition: str | None = None) -> int:
        """Merge the upserts into one folder, or all folders into one without superseded rows. Rows keep their versions."""
        meta = self.meta()
        own = [f for f in meta["folders"] if full or f["upsert"]]
        if len(own) < 2:
            return meta["version"]
        rows = self._live({**meta, "folders": own})
        folder = {"id": self._write(rows, partition, 0), "schema": meta["schema"], "upsert": any(f["upsert"] for f in own) and not full, **({"partition": partition} if partition else {})}
        return self._publish(meta, added=[folder], removed=[f["id"] for f in own])

    def clear(self) -> None:
        self._fs.delete(self._path(self.path), True)


def probe(spark: SparkSession, destination: str) -> None:
    """Commit a row to a table of its own in the destination, read it back and drop it; whatever fails is raised."""
    t = Table(spark, f"{destination.rstrip('/')}/.check-{uuid.uuid4().hex}")
    try:
        t.commit(spark.range(1).selectExpr("id", "'text' as v"), batch_id="check")
        if [tuple(r) for r in t.read().collect()] != [(0, "text")]:
            raise RuntimeError("what was written isn't what is read")
    finally:
        t.clear()
