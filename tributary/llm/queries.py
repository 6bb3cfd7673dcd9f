"""Queries of this subpackage, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import bpe, decontaminate, jaccard, language_id, line_dedup, pii, substring_dedup, toxicity, warc, webp


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(_table(spark, sf_dir, "pages"))
    found = warc.read(spark, archives, payload="none", verify="true")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.read_media(webp.to_media(_table(spark, sf_dir, "documents")))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(_table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(_table(spark, sf_dir, "documents"), "the key of a public example")  # these tables hold invented data


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicate(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_language_id, op2_warc, op3_webp, op4_jaccard_join, op5_byte_bpe, op6_decontamination, op7_pii_pseudonyms, op8_line_dedup, op9_substring_dedup, op10_toxicity)} | {"pipeline": _pipeline}

_OP2 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS x FROM p),
b AS (SELECT x, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(x, 10 * (i // 8) + 1, 10) AS UBIGINT) >> (35 - 5 * (i % 8))) & 31 AS INTEGER), 1), '' ORDER BY i) AS payload_digest
      FROM (SELECT DISTINCT x FROM h), range(32) t(i) GROUP BY x),
k AS (SELECT x, max(page_id) AS kept FROM h GROUP BY x)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN kept > page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN kept > page_id THEN kept END AS refers_to
FROM h JOIN b USING (x) JOIN k USING (x)
"""


_OP8 = """
WITH a AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
u AS (SELECT doc_id, unnest(range(len(parts))) AS line, unnest(parts) AS raw FROM a),
l AS (SELECT doc_id, line, trim(raw, ' ') AS t, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS p FROM u WHERE trim(raw, ' ') <> ''),
-- each line with each earlier place of an equal one; equal lines that follow each other at a fixed distance are a run
e AS (SELECT y.doc_id, y.p, y.line, length(y.t) AS size, x.doc_id AS of, y.p - x.p AS apart FROM l x JOIN l y ON x.t = y.t AND (x.doc_id < y.doc_id OR (x.doc_id = y.doc_id AND x.p < y.p))),
i AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, of, apart ORDER BY p) AS run FROM e),
r AS (SELECT *, count(*) OVER (PARTITION BY doc_id, of, apart, run) AS n FROM i),
g AS (SELECT DISTINCT doc_id, line FROM r WHERE n >= 2 OR size >= 40),
m AS (SELECT doc_id, max(n) AS longest FROM r GROUP BY doc_id),
k AS (SELECT u.doc_id, string_agg(u.raw, chr(10) ORDER BY u.line) FILTER (WHERE g.line IS NULL) AS text, count(g.line) AS n_removed, count(*) FILTER (WHERE trim(u.raw, ' ') <> '') AS n_lines
      FROM u LEFT JOIN g ON g.doc_id = u.doc_id AND g.line = u.line GROUP BY u.doc_id)
SELECT a.doc_id, CASE WHEN a.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, CAST(coalesce(k.n_lines, 0) AS INTEGER) AS n_lines,
       CAST(coalesce(k.n_removed, 0) AS INTEGER) AS n_removed, CAST(coalesce(m.longest, 0) AS INTEGER) AS longest_run
FROM a LEFT JOIN k ON k.doc_id = a.doc_id LEFT JOIN m ON m.doc_id = a.doc_id
"""


ORACLES = {"op2_warc": _OP2, "op8_line_dedup": _OP8}
