"""The pipeline's stages over a small table, each against what it should keep."""

import corpus_pipeline
from tributary.llm import decontaminate

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    for name, each in corpus_pipeline.STAGES[:-1]:
        docs = each(spark, docs, SF).cache()
        assert docs.columns == columns, name
        left = {r[0] for r in docs.select("doc_id").collect()}
        assert left <= ids and len(left) == docs.count(), name
        ids = left
    assert decontaminate.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r[0] for r in last.select("doc_id").collect()} == ids
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == ids


def test_stages_on_odd_rows(spark, tmp_path):
    """An empty table; nulls in every column, repeated rows and columns with names that stages use themselves."""
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int").withColumnRenamed("quality", "toxic")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long, predicted string, n_removed string, d string, `n` string"
    rows = [(i, f"document {i} has text of its own\nand a second line {i}", "en", "s", 40, "p", "r", "d", "n") for i in range(12)]
    rows += [rows[0], rows[0], (None,) * 9, (None,) * 9, (13, None, None, None, None, None, None, None, None), (14, "", "en", "s", 0, "p", "r", "d", "n")]
    rows += [(15, "x one two three four five six seven eight nine ten eleven twelve thirteen fourteen y", "en", "s", 1, "p", "r", "d", "n")]
    docs = spark.createDataFrame(rows, schema)
    for name, each in corpus_pipeline.STAGES[:-1]:
        assert each(spark, docs.where("false"), str(tmp_path)).count() == 0, name
    keys = ["doc_id", "lang", "source", "predicted", "n_removed", "d", "n"]
    plain = lambda df: {tuple(r[k] for k in keys) for r in df.collect()}
    for name, each in corpus_pipeline.STAGES[1:-1]:
        docs = each(spark, docs, str(tmp_path)).cache()
        assert docs.columns == [c.split()[0].strip("`") for c in schema.split(", ")] and plain(docs) <= {tuple(r[i] for i in (0, 2, 3, 5, 6, 7, 8)) for r in rows}, name
    ids = [r.doc_id for r in docs.collect()]
    assert len(ids) == len(set(ids)) and 15 not in ids and {0, 13, 14, None} <= set(ids)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(ids)
