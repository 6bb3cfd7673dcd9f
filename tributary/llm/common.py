"""Helpers that the corpus operators share: stage tables, Arrow maps and text access."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of an Arrow batch that Spark sends to a worker, and of a slice of one that is taken apart at once (a larger row is alone).
BATCH_BYTES = 4 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_DEFAULT_BYTES = 64 << 20
#: Tables that were staged and not dropped yet, in order.
_STAGED: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset, a temporary one in local mode only."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tributary-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    _STAGED.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _STAGED[-1]


def stage(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df to the shared folder and reread it: lineage ends at files that outlive any executor."""
    path = stage_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_stage(spark: SparkSession, *paths: str) -> None:
    """Delete stage tables that nothing reads any more, and let Spark drop the shuffle files of finished jobs."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        if path in _STAGED:
            _STAGED.remove(path)
    jvm.System.gc()


def staged() -> int:
    """A mark for drop_since."""
    return len(_STAGED)


def since(mark: int) -> list[str]:
    """What was staged since a mark."""
    return _STAGED[mark:]


def drop_since(spark: SparkSession, mark: int = 0, *keep: str) -> None:
    """Delete what was staged since a mark, but for some. Results that were made lazily from it can't be read any more."""
    drop_stage(spark, *[p for p in _STAGED[mark:] if p not in keep])


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores before it until no column has it (Spark's names don't tell cases apart)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, unless the session has a bound of its own. Plans read the setting when they run."""
    if int(spark.conf.get(_BYTES, str(_DEFAULT_BYTES)).rstrip("b")) == _DEFAULT_BYTES:
        spark.conf.set(_BYTES, str(BATCH_BYTES))


def sliced(batches: Iterator[pa.RecordBatch], most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut into slices of about ``most`` bytes, none of them empty."""
    for batch in batches:
        if batch.num_rows:
            step = max(1, int(batch.num_rows * min(1.0, most / max(1, batch.nbytes))))
            for a in range(0, batch.num_rows, step):
                yield batch.slice(a, step)


def arrow_map(df: DataFrame, each: Callable[[dict[str, list]], dict[str, list] | pa.RecordBatch], schema: str | T.StructType) -> DataFrame:
    """Apply each(columns as Python lists) -> columns to slices of every Arrow batch of df."""
    bounded_batches(df.sparkSession)
    names = list(df.columns)
    target = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = each({n: batch.column(i).to_pylist() for i, n in enumerate(names)})
            yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def with_columns(df: DataFrame, source: str, each: Callable[[list], dict[str, list]], added: str) -> DataFrame:
    """df with the columns that each(values of ``source``) -> columns gives, in place of columns of those names.

    The other columns pass through as Arrow arrays, whatever their types; only ``source`` is made into Python values."""
    bounded_batches(df.sparkSession)
    new = T.StructType.fromDDL(added)
    rest = [f.name for f in df.schema if f.name.lower() not in {n.lower() for n in new.fieldNames()}]
    rows = df.select(F.col(f"`{source}`").alias("source"), *[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(rest)])
    inner = T.StructType([T.StructField(f"c{i}", df.schema[n].dataType) for i, n in enumerate(rest)] + [T.StructField(f"n{i}", f.dataType) for i, f in enumerate(new)])
    target = _arrow_schema(df.sparkSession, inner)
    names = new.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = each(batch.column(0).to_pylist())
            columns = [batch.column(i).cast(target.field(i - 1).type) for i in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(out[n], target.field(len(rest) + i).type) for i, n in enumerate(names)], schema=target)

    done = rows.mapInArrow(run, inner)
    return done.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(rest)], *[F.col(f"n{i}").alias(n) for i, n in enumerate(names)])


def _arrow_schema(spark: SparkSession, schema: str | T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def crc_mod(column: str, n: int):
    """crc32 of the id's text modulo n: null for a null id."""
    return F.crc32(F.col(column).cast("string")) % n


def row_key(columns: tuple[str, ...] = ("doc_id", "text")):
    """A row's key: doc_id with the text's hash. Rows that repeat both are one document and get one result."""
    return F.xxhash64(*[F.col(c) for c in columns])


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Cut consecutive items into slices whose sizes sum to at most ``most`` (one larger item stays alone)."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def starts(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths), np.int64)
    np.cumsum(lengths[:-1], out=out[1:])
    return out
