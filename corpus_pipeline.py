"""A corpus pipeline of five stages over ``documents``; each stage's rows are written as Parquet and read by the next one.

1. toxicity: documents whose score reaches 0.3 go; the model is trained on the labelled documents of the input.
2. line dedup: later copies of repeated runs of lines go; a document of which nothing is left goes as a whole.
3. n-gram Jaccard join: of each class of near copies, the document with the smallest doc_id stays.
4. benchmark decontamination: documents that overlap a benchmark item go.
5. byte-level BPE: each document gets its number of tokens and digests of its ids and of the text decoded from them.

Documents without text are kept by the filters that find nothing in them; the second stage drops only those that had
lines and lost all. A repeated row (equal doc_id and text) stays once in the third stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import bpe, decontaminate, jaccard, line_dedup, toxicity
from tributary.llm.common import drop_since, stage, staged, unused

#: The decisions of a trained model and of a tokenizer are not expressible in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = unused(docs.columns, "score", "predicted")
    return toxicity.score(docs, _table(spark, sf_dir, "labels"), keep=True, names=names).where(F.col(names[1]) == 0).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = unused(docs.columns, *line_dedup.NAMES)
    lines, removed = F.col(names[0]), F.col(names[1])
    done = line_dedup.deduplicate(docs, names=names).where((removed == 0) | (removed < lines))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(removed > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, keep=True).select("doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, mark = _table(spark, sf_dir, "documents"), staged()
    for name, each in STAGES:
        docs, path = stage(each(spark, docs, sf_dir), name.replace(" ", "-"))
        drop_since(spark, mark, path)  # what the stage staged, and the one before it
    return docs
