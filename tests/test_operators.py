import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from tributary.catalog import Catalog, Configured, Stream, classify, default_mode, merge, merged_columns
from tributary.operators import chunks as K
from tributary.operators import filters
from tributary.operators.project import selected
from tributary.state import State


@pytest.mark.parametrize(
    ("text", "want"),
    [("a > 5", [("a", ">", 5)]), ("a>b", [("a", ">", "b")]), ('"my col" = "x y"', [("my col", "=", "x y")]), ("a >= .5 AND b != -10", [("a", ">=", 0.5), ("b", "!=", -10)]), ('a = "" or b<=1.5', [("a", "=", ""), ("b", "<=", 1.5)])],
)
def test_filter_line(text, want):
    assert [(c.column, c.operator, c.value) for c in filters.parse_line(text).conditions] == want


@pytest.mark.parametrize("text", ["a > 1 and b > 2 and c > 3", "a = 5.", "a >>>= 1", '"a = 1', "", "a"])
def test_filter_line_errors(text):
    with pytest.raises(ValueError):
        filters.parse_line(text)


@pytest.fixture
def people(spark):
    return spark.createDataFrame([("a", 10), ("b", 30), (None, 40), ("d", None), (None, None)], "name string, age int")


@pytest.mark.parametrize(
    ("op", "conditions", "rows"),
    [("and", [("name", "=", None)], 2), ("and", [("name", "!=", None)], 3), ("and", [("name", "!=", "a")], 4), ("and", [("age", ">", 20)], 2), ("or", [("age", ">", 20), ("name", "=", "d")], 3), ("and", [], 5), ("or", [], 0), ("and", [("age", "<", None)], 0)],
)
def test_filter_nulls(people, op, conditions, rows):
    f = filters.Filter(op, [filters.Condition(*c) for c in conditions])
    assert filters.apply(people, f).count() == rows
    if conditions and all(c[1] in ("=", "!=") or c[2] is not None for c in conditions):
        assert people.where(filters.to_sql(f, people.schema, "mysql")).count() == rows


def test_filter_errors(people):
    for c in (("x", "=", 1), ("age", "like", 1), ("age", ">", "abc")):
        with pytest.raises(ValueError):
            filters.apply(people, filters.Filter("and", [filters.Condition(*c)]))


def test_filter_reaches_the_scan(spark, capsys):
    df = filters.apply(spark.read.parquet("/root/testdata/sf0.001/orders.parquet"), "o_totalprice > 100000").select("o_orderkey")
    df.explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThan(o_totalprice,100000.0)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_even_int():
    assert [(c.low, c.high) for c in K.even_int(0, 100, 101, 25)][:2] == [(None, 25), (25, 50)]
    assert K.even_int(0, 10, 11, 1000) == [K.Chunk()]
    with pytest.raises(ValueError):
        K.even_int(0, 10**9, 10, 5)


def test_chunks_cover_once(spark):
    df = spark.range(-50, 150).select("id", F.pmod("id", F.lit(7)).alias("b"))
    for keys, bounds in ((["id"], K.even_int(-50, 149, 200, 30)), (["b", "id"], K.chunks_of([(2, 10), (2, 80), (5, 0)]))):
        hits = df.select(*[K.predicate(keys, c, df).cast("int").alias(str(i)) for i, c in enumerate(bounds)])
        assert hits.select(sum(F.col(f"`{c}`") for c in hits.columns).alias("n")).where("n <> 1").isEmpty()
        assert sum(df.where(K.sql_predicate(keys, c)).count() for c in bounds) == 200


def test_every_nth_key(spark):
    got = [tuple(r) for r in K.every_nth_key(spark.range(1000).repartition(7), ["id"], 100).orderBy("rn").collect()]
    assert got == [(100 * i, 100 * i - 1) for i in range(1, 11)]


def test_pack_pages_windows():
    assert K.pack_files([("a", 10), ("big", 500), ("b", 20)], 100) == [["a"], ["big"], ["b"]]
    assert K.pages(8192, 600_000)[0] == K.Chunk(None, 262144)
    w = K.time_windows(1_000_000, 1_100_000)
    assert w[0].low is None and w[-1].high is None and all(a.high == b.low for a, b in zip(w, w[1:], strict=False))
    assert K.even_string("a", "c", 2) == ["b"]


def test_selection():
    assert selected(["a", "b", "new"], ["a"], ["a", "b"], True) == ["a", "new"]
    assert selected(["a", "b", "_row_id"], ["a"], sync_new=False) == ["a", "_row_id"]
    assert selected(["a", "b"], None) == ["a", "b"]
    assert merged_columns(["a", "b"], ["a", "b", "c"], ["a"], True) == ["a", "c"]


def test_catalog():
    s = default_mode(Stream("t", "n", {"a": "integer"}, ["full_refresh", "incremental"], ["a"], ["z", "b"]))
    assert (s.sync_mode, s.cursor) == ("incremental", "b")
    old = Catalog([s], [Configured("t", "n", selected_columns=["a"])])
    assert Catalog.from_json(old.to_json()) == old
    new = merge(old, Catalog([Stream("t", "n", {"a": "integer", "c": "string"}, ["full_refresh", "incremental"], ["a"], ["b"]), Stream("u", "n")]))
    assert [c.id for c in new.selected] == ["n.t"] and new.selected[0].selected_columns == ["a", "c"]
    by_mode, skipped = classify(Catalog([s], [Configured("t", "n"), Configured("gone", "n")]), None)
    assert [c.name for c in by_mode["incremental"]] == ["t"] and "n.gone" in skipped
    with pytest.raises(ValueError):
        classify(Catalog([], [Configured("gone")]), None)


def test_state(tmp_path):
    path = str(tmp_path / "state.json")
    s = State.load(path)
    s.set_chunks("t", [(None, 1), (1, None)])
    s.remove_chunk("t", (None, 1))
    assert State.load(path).chunks("t") == [[1, None]] and not s.backfilled("t")
    s.remove_chunk("t", [1, None])
    assert State.load(path).backfilled("t")
    s.set_cursor("t", a=str(dt.date(2024, 1, 1)))
    s.reset("t")
    assert State.load(path).streams == {}


def test_state_drops_many_chunks_at_once(tmp_path):
    """Done chunks are looked up, not searched for; ends of chunks of files are lists."""
    s = State.load(str(tmp_path / "state.json"))
    plan = [[["f", str(i)], None] for i in range(40_000)]
    s.set_chunks("t", plan)
    began = time.monotonic()
    s.remove_chunks("t", [(("f", str(i)), None) for i in range(20_000)])
    assert s.chunks("t") == plan[20_000:] and time.monotonic() - began < 10


def test_sampled_bounds_are_even(spark):
    """No chunk of twice the rows, however many there are; rows beyond an estimate get chunks too, equal keys stay together."""
    df = spark.range(40_000).selectExpr("(id * 7919) % 40000 as k").unionByName(spark.createDataFrame([(None,)] * 9, "k long"))
    for rows in (40_000, 20_000):
        counts = K.locate(df, "k", K.chunks_of(K.sampled_bounds(df, "k", rows, 20))).where("k is not null").groupBy("chunk").count().collect()
        assert len(counts) == 2000 and {r["count"] for r in counts} == {20}
    texts = spark.createDataFrame([("b",)] * 50 + [("a",), ("c",)], "k string")
    assert K.sampled_bounds(texts, "k", 52, 10) == ["b"]
    assert K.sampled_bounds(df, "k", 0, 20) == K.sampled_bounds(df, "k", 20, 20) == []
