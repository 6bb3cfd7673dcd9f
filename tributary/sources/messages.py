"""Message topics, read from committed to captured end offsets; and their decoding.

With Spark's Kafka package on the class path the broker is read; offline, a folder of files with the same columns
(topic, partition, offset, timestamp, key, value) stands for it.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary import types as S
from tributary.catalog import STRICT_CDC, Stream
from tributary.sources.base import Source, register


def plan_partitions(offsets: DataFrame) -> DataFrame:
    """Of (partition, committed, first, end): those with something to read, from where to where."""
    begin = F.greatest(F.coalesce("committed", "first"), F.col("first"))
    return offsets.select("partition", begin.alias("begin"), "end").where((F.col("end") > F.col("begin")) & (F.col("end") > F.lit(0)))


def strip_envelope(value: Column) -> Column:
    """Payload after a schema registry's magic byte and id; the whole value if it has none."""
    return F.when(F.substring(value, 1, 1) == F.lit(b"\x00"), F.substring(value, 6, 2**31 - 1)).otherwise(value)


def decode_json(messages: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows, and messages that can't be parsed. A null value is a tombstone and neither."""
    text = strip_envelope(F.col("value").cast("binary")).cast("string")
    rows = messages.where(F.col("value").isNotNull()).withColumn("__row", F.from_json(text, f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("__row").isNull() | F.col("__row._corrupt_record").isNotNull()
    names = [n for n in rows.schema["__row"].dataType.fieldNames() if n != "_corrupt_record"]
    good = rows.where(~bad).select(*[F.col(f"__row.{n}").alias(n) for n in names], F.col("key").cast("string").alias("_kafka_key"), F.col("offset").alias("_kafka_offset"), F.col("partition").alias("_kafka_partition"), F.col("timestamp").alias("_kafka_timestamp"))
    return good, rows.where(bad).drop("__row")


def range_options(topic: str, after: dict[str, int] | None, until: dict[str, int]) -> dict[str, str]:
    """Options by which the broker's reader takes just the messages after some offsets up to others, of the partitions known at the end.

    A partition without an offset to start from is read from its beginning (-2); the reader's ends are exclusive."""
    begin = {p: (after or {}).get(p, -3) + 1 for p in until}
    return {
        "assign": json.dumps({topic: sorted(int(p) for p in until)}),
        "startingOffsets": json.dumps({topic: begin}),
        "endingOffsets": json.dumps({topic: {p: end + 1 for p, end in until.items()}}),
    }


@register("messages")
class MessageSource(Source):
    options = {"servers": "string", "path": "string", "schema": "string!", "topic": "string!"}

    def _messages(self, after: dict | None = None, until: dict | None = None) -> DataFrame:
        """Messages of the topic; of a range of offsets where its end is given."""
        if "path" in self.config:
            rows = self.spark.read.parquet(self.config["path"]).where(F.col("topic") == self.config["topic"])
            if until is None:
                return rows
            test = F.lit(False)
            for p, end in until.items():  # as many conditions as partitions; they reach the scan
                test = test | ((F.col("partition") == int(p)) & (F.col("offset") <= end) & (F.col("offset") > (after or {}).get(p, -1)))
            return rows.where(test)
        range_ = {"subscribe": self.config["topic"]} if until is None else range_options(self.config["topic"], after, until)
        return self.spark.read.format("kafka").options(**{"kafka.bootstrap.servers": self.config["servers"], **range_}).load()

    def discover(self) -> list[Stream]:
        s = Stream(self.config["topic"], "", {}, [STRICT_CDC], ["_kafka_offset", "_kafka_partition"])
        s.schema = {f.name: S.from_spark(f.dataType) for f in self.table(s).schema}
        return [s]

    def table(self, stream: Stream) -> DataFrame:
        return self._rows(self._messages())

    def _rows(self, messages: DataFrame) -> DataFrame:
        """Rows, and messages that can't be parsed: those have their text in ``_corrupt_record`` and no other value."""
        good, bad = decode_json(messages, self.config["schema"])
        own = {f"_kafka_{n}": F.col(n) for n in ("offset", "partition", "timestamp")} | {"_kafka_key": F.col("key").cast("string"), "_corrupt_record": F.col("value").cast("binary")}
        bad = bad.select(*[c.alias(n) for n, c in own.items()]).withColumn("_corrupt_record", F.coalesce(F.try_validate_utf8(F.col("_corrupt_record").cast("string")), F.base64("_corrupt_record")))
        return good.unionByName(bad, allowMissingColumns=True)

    def end_position(self, stream: Stream) -> dict:
        return {str(r[0]): r[1] for r in self._messages().groupBy("partition").agg(F.max("offset")).collect()}

    def changes(self, stream: Stream, after: dict | None, until: dict) -> DataFrame:
        rows = self._rows(self._messages(after, until))
        return rows.withColumns({"__kind": F.lit("insert"), "__at": F.col("_kafka_timestamp"), "__position": F.col("_kafka_offset")})
