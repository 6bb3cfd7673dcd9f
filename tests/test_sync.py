import datetime as dt
import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from tributary import cli
from tributary.catalog import Catalog, Configured
from tributary.sinks.table import Conflict, Table
from tributary.sources.files import FileSource
from tributary.sources.messages import MessageSource
from tributary.sources.tables import TableSource
from tributary.state import State
from tributary.sync import Sync

AT = dt.datetime(2024, 5, 1)


def rows(spark, data, schema="k long, v string"):
    return spark.createDataFrame(data, schema)


@pytest.fixture
def source(spark, tmp_path):
    rows(spark, [(1, "a"), (2, "b"), (3, "c")]).write.parquet(str(tmp_path / "t.parquet"))
    return TableSource(spark, {"path": str(tmp_path), "tables": ["t"], "keys": {"t": ["k"]}, "chunk_rows": 2})


def catalog(source, mode, cursor="", **options):
    s = source.discover()[0]
    s.sync_mode, s.cursor = mode, cursor
    return Catalog([s], [Configured("t", **options)])


def landed(table):
    return sorted((r.k, r.v, r._op_type) for r in table.read().collect())


def log(spark, path, data):
    df = rows(spark, data, "k long, v string, __kind string, __position long").withColumn("__at", F.lit(AT))
    df.write.mode("overwrite").parquet(f"{path}/t.changes.parquet")


def test_full_refresh_replaces(spark, source, tmp_path):
    sync = Sync(spark, source, str(tmp_path / "out"), State(), ingested_at=AT)
    for _ in range(2):
        sync.run(catalog(source, "full_refresh", filter="k > 1", selected_columns=["k", "v"]))
    assert landed(Table(spark, str(tmp_path / "out/t"))) == [(2, "b", "r"), (3, "c", "r")]


def test_incremental(spark, source, tmp_path):
    state = State(str(tmp_path / "state.json"))
    sync = Sync(spark, source, str(tmp_path / "out"), state, ingested_at=AT)
    cat = catalog(source, "incremental", "k")
    sync.run(cat)
    assert state.cursor("t", "k") == 3
    rows(spark, [(1, "a"), (3, "cc"), (4, "d")]).write.mode("overwrite").parquet(str(tmp_path / "t.parquet"))
    sync.run(cat)
    want = [(1, "a", "r"), (2, "b", "r"), (3, "c", "r"), (4, "d", "u")]
    assert landed(sync.table(cat.streams[0])) == want
    # a crash after the commit and before the state was written: the commit is adopted, not repeated
    state.set_cursor("t", k=3)
    sync.run(cat)
    assert landed(sync.table(cat.streams[0])) == want and state.cursor("t", "k") == 4


def test_changes_example(spark, source, tmp_path):
    """Snapshot of 1, 2, 3; then an insert that repeats 3, two updates of 1, a delete of 2, an insert of 4."""
    log(spark, tmp_path, [(0, "", "none", 0)])
    state = State(str(tmp_path / "state.json"))
    sync = Sync(spark, source, str(tmp_path / "out"), state, ingested_at=AT)
    cat = catalog(source, "cdc")
    sync.run(cat)
    table = sync.table(cat.streams[0])
    assert landed(table) == [(1, "a", "r"), (2, "b", "r"), (3, "c", "r")] and table.meta()["dedup_inserts"]
    log(spark, tmp_path, [(3, "c", "insert", 1), (1, "a2", "update", 2), (1, "a3", "update", 3), (2, "b", "delete", 4), (4, "d", "insert", 5)])
    sync.run(cat)
    want = [(1, "a3", "u"), (2, "b", "d"), (3, "c", "c"), (4, "d", "c")]
    assert landed(table) == want and not table.meta()["dedup_inserts"]
    n = table.version()
    state.position = {"t": 0}  # lost state
    sync.run(cat)
    assert landed(table) == want and table.version() == n


def test_backfill_resumes(spark, source, tmp_path, monkeypatch):
    state = State(str(tmp_path / "state.json"))
    sync = Sync(spark, source, str(tmp_path / "out"), state, ingested_at=AT, chunks_per_commit=1)
    cat = catalog(source, "incremental", "k")
    scan, calls = source.scan, []

    def broken(stream, chunk):
        calls.append(chunk)
        if len(calls) == 2:
            raise RuntimeError("killed")
        return scan(stream, chunk)

    monkeypatch.setattr(source, "scan", broken)
    with pytest.raises(RuntimeError):
        sync.run(cat)
    assert len(state.chunks("t")) == 1
    sync.run(cat)
    assert landed(sync.table(cat.streams[0])) == [(1, "a", "r"), (2, "b", "r"), (3, "c", "r")]


def test_snapshot_restarts_from_its_first_position(spark, source, tmp_path, monkeypatch):
    """Changes between a killed snapshot and its restart are applied, not skipped."""
    log(spark, tmp_path, [(0, "", "none", 0)])
    state = State(str(tmp_path / "state.json"))
    sync = Sync(spark, source, str(tmp_path / "out"), state, ingested_at=AT, chunks_per_commit=1)
    cat = catalog(source, "cdc")
    scan, calls = source.scan, []

    def broken(stream, chunk):
        calls.append(chunk)
        if len(calls) == 2:
            raise RuntimeError("killed")
        return scan(stream, chunk)

    monkeypatch.setattr(source, "scan", broken)
    with pytest.raises(RuntimeError):
        sync.run(cat)
    log(spark, tmp_path, [(1, "a2", "update", 1), (4, "d", "insert", 2)])
    sync.state = State.load(state.path)
    sync.run(cat)
    assert landed(sync.table(cat.streams[0])) == [(1, "a2", "u"), (2, "b", "r"), (3, "c", "r"), (4, "d", "c")]
    assert sync.state.position == {"t": 2}


def test_incremental_append_has_each_row_once(spark, source, tmp_path, monkeypatch):
    """A row that arrives between the read of the maximum and the read of the rows is left to the next run."""
    sync = Sync(spark, source, str(tmp_path / "out"), State(), ingested_at=AT)
    cat = catalog(source, "incremental", "k", append_mode=True)
    sync.run(cat)
    top = source.max_cursor
    monkeypatch.setattr(source, "max_cursor", lambda s, c: {"k": 4})
    rows(spark, [(3, "c"), (4, "d"), (5, "e")]).write.mode("overwrite").parquet(str(tmp_path / "t.parquet"))
    sync.run(cat)
    monkeypatch.setattr(source, "max_cursor", top)
    for _ in range(2):
        sync.run(cat)
    assert landed(sync.table(cat.streams[0])) == [(1, "a", "r"), (2, "b", "r"), (3, "c", "r"), (4, "d", "u"), (5, "e", "u")]


def test_files_incremental(spark, tmp_path):
    base = tmp_path / "in/s"
    base.mkdir(parents=True)
    (base / "a.jsonl").write_text('{"k": 1}\n')
    os.utime(base / "a.jsonl", (1_700_000_000, 1_700_000_000))
    src = FileSource(spark, {"path": str(tmp_path / "in"), "format": "json"})
    s = src.discover()[0]
    s.sync_mode, s.cursor = "incremental", "_last_modified_time"
    sync, cat = Sync(spark, src, str(tmp_path / "out"), State(), ingested_at=AT), Catalog([s], [Configured(s.id, append_mode=True)])
    assert src.max_cursor(s, ["_last_modified_time"]) == {"_last_modified_time": "2023-11-14T22:13:20Z"}
    sync.run(cat)
    (base / "b.jsonl").write_text('{"k": 2}\n')
    os.utime(base / "b.jsonl", (1_700_000_100, 1_700_000_100))
    for _ in range(2):
        sync.run(cat)
    got = sorted((r.k, r._op_type) for r in sync.table(s).read().collect())
    assert got == [(1.0, "r"), (2.0, "u")]


def test_commits(spark, tmp_path):
    t = Table(spark, str(tmp_path / "x"))
    t.commit(rows(spark, [(1, "a")]), batch_id="1")
    t.commit(rows(spark, [(1, "a")]), batch_id="1")
    assert t.read().count() == 1
    t.commit(spark.createDataFrame([(2, 5)], "k int, w int"), batch_id="2")
    assert sorted(map(tuple, t.read().collect())) == [(1, "a", None), (2, None, 5)]
    assert t.read(1).count() == 1
    with pytest.raises(ValueError):
        t.commit(spark.createDataFrame([("x",)], "k string"), batch_id="3")
    meta = t.meta()
    with pytest.raises(Conflict):
        t._publish({**meta, "version": meta["version"] - 1})
    t.clear()
    assert t.version() == 0


def test_files(spark, tmp_path):
    base = tmp_path / "in"
    for name, body in (("csv/a.csv", "id,f,d,n\n1,x,2024-01-01,\n2,null,2024-01-02,\n"), ("csv/b.csv.gz", "id,f,d,n\n3,y,2024-01-03,\n")):
        path = base / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(gzip.compress(body.encode()) if name.endswith("gz") else body.encode())
    src = FileSource(spark, {"path": str(base), "format": "csv"})
    s = src.discover()[0]
    assert s.name == "csv" and s.schema["id"] == "number" and s.schema["d"] == "timestamp_micro" and s.schema["n"] == "string"
    got = sorted((r.id, r.f, r.n) for r in src.table(s).collect())
    assert got == [(1.0, "x", None), (2.0, None, None), (3.0, "y", None)]
    (base / "j").mkdir()
    (base / "j/a.jsonl").write_text('{"id": 1, "o": {"k": 1}, "t": "2024-01-01T00:00:00Z"}\n{"id": 2}\n')
    src = FileSource(spark, {"path": str(base), "format": "json"})
    r = src.table(src.discover()[0]).orderBy("id").collect()
    assert r[0].id == 1.0 and r[0].o.k == 1.0 and r[0].t == dt.datetime(2024, 1, 1) and r[1].o is None
    (base / "x").mkdir()
    (base / "x/a.xml").write_text("<root><order id='7'><n>1</n><n>2</n><e> </e></order><order id=''><n>3</n></order></root>")
    src = FileSource(spark, {"path": str(base), "format": "xml", "row_identifier": "order"})
    r = src.table(src.discover()[0]).orderBy("n").collect()
    assert [(x["_id"], x.n) for x in r] == [("7", "2"), ("", "3")] and r[0].e is None
    assert "_last_modified_time" in r[0].asDict()


def test_files_types_rest_on_all_rows(spark, tmp_path):
    (tmp_path / "s").mkdir()
    late = 10_500
    (tmp_path / "s/a.csv").write_text("n,d\n" + "".join(f"{i},2024-01-01\n" for i in range(late)) + "text,never\n")
    (tmp_path / "s/b.csv").write_text("n,d\nmore,2024-01-02\n")
    src = FileSource(spark, {"path": str(tmp_path), "format": "csv"})
    s = src.discover()[0]
    assert (s.schema["n"], s.schema["d"]) == ("string", "string")
    assert src.table(s).where("n in ('text', 'more') and d is not null").count() == 2 and src.table(s).where("n is null or d is null").count() == 0
    # one file's types would be others; those of the stream hold for each chunk, and a file that comes later is looked at
    (tmp_path / "u").mkdir()
    (tmp_path / "u/a.csv").write_text("n\n1\n")
    src = FileSource(spark, {"path": str(tmp_path), "format": "csv"})
    u = next(x for x in src.discover() if x.name == "u")
    assert u.schema["n"] == "number"
    (tmp_path / "u/b.csv").write_text("n\ntrue\n")
    assert [sorted(r.n for r in src.read(u, [p]).collect()) for p in src._paths(u)] == [["1"], ["true"]]
    (tmp_path / "j").mkdir()
    (tmp_path / "j/a.jsonl").write_text('{"t": "2024-01-01T00:00:00Z"}\n' * late + '{"t": "soon"}\n')
    src = FileSource(spark, {"path": str(tmp_path), "format": "json"})
    assert src.table(src.discover()[0]).where("t = 'soon'").count() == 1


def test_files_have_their_own_columns(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c/a.csv").write_text("id,v\n1,x\n")
    (tmp_path / "c/b.csv.gz").write_bytes(gzip.compress(b"v,id\ny,2\n"))
    (tmp_path / "c/c.csv").write_text("id,v,new_col\n3,z,n\n")
    src = FileSource(spark, {"path": str(tmp_path), "format": "csv"})
    s = src.discover()[0]
    assert set(s.schema) == {"id", "v", "new_col", "_last_modified_time"} and s.schema["id"] == "number"
    assert sorted((r.id, r.v, r.new_col) for r in src.table(s).collect()) == [(1, "x", None), (2, "y", None), (3, "z", "n")]
    assert src.read(s, src._paths(s)[:1]).where("new_col is null").count() == 1
    for name, columns in (("a", "1L AS id"), ("b", "2L AS id, 'n' AS new_col")):
        spark.sql(f"SELECT {columns}").coalesce(1).write.parquet(str(tmp_path / f"p/{name}"))
    src = FileSource(spark, {"path": str(tmp_path), "format": "parquet"})
    s = src.discover()[0]
    assert sorted((r.id, r.new_col) for r in src.table(s).collect()) == [(1, None), (2, "n")] and s.schema["new_col"] == "string"
    spark.sql("SELECT 'three' AS id, 3 AS other").coalesce(1).write.parquet(str(tmp_path / "p/c"))
    assert sorted((r.id, r.new_col, r.other) for r in src.table(s).collect()) == [("1", None, None), ("2", "n", None), ("three", None, 3)]


def test_messages_that_cannot_be_parsed_land(spark, tmp_path):
    data = [("t", 0, i, AT, b"k", v) for i, v in enumerate((b'{"id": 1}', b"not json", b"\xff\xfe", None, b'{"id": 2}'))]
    spark.createDataFrame(data, "topic string, partition int, offset long, timestamp timestamp, key binary, value binary").write.parquet(str(tmp_path / "m"))
    src = MessageSource(spark, {"path": str(tmp_path / "m"), "topic": "t", "schema": "id bigint"})
    s = src.discover()[0]
    s.sync_mode = "strict_cdc"
    Sync(spark, src, str(tmp_path / "out"), State(str(tmp_path / "state.json"))).run(Catalog([s], [Configured("t")]))
    got = sorted(Table(spark, str(tmp_path / "out/t")).read().select("_kafka_offset", "id", "_corrupt_record").collect())
    assert [tuple(r) for r in got] == [(0, 1, None), (1, None, "not json"), (2, None, "//4="), (4, 2, None)]


def test_commands(spark, tmp_path, capsys):
    rows(spark, [(1, "a")]).write.parquet(str(tmp_path / "t.parquet"))
    (tmp_path / "c.json").write_text(json.dumps({"kind": "tables", "path": str(tmp_path), "tables": ["t"], "keys": {"t": ["k"]}}))
    common = ["--config", str(tmp_path / "c.json"), "--catalog", str(tmp_path / "cat.json"), "--state", str(tmp_path / "s.json"), "--destination", str(tmp_path / "out")]
    assert cli.main(["spec", "--source", "tables"]) == 0
    assert cli.main(["check", *common], spark) == 0
    assert cli.main(["discover", *common], spark) == 0
    text = (tmp_path / "cat.json").read_text().replace('"sync_mode": "cdc"', '"sync_mode": "full_refresh"')
    (tmp_path / "cat.json").write_text(text)
    assert cli.main(["sync", *common], spark) == 0
    assert Table(spark, str(tmp_path / "out/t")).read().count() == 1
    assert cli.main(["clear-destination", *common], spark) == 0
    assert Table(spark, str(tmp_path / "out/t")).version() == 0
    assert cli.main(["check", *common], spark) == 0 and "the destination can be written" in capsys.readouterr().out
    (tmp_path / "plain").write_text("no folder")
    assert cli.main(["check", *common[:-1], str(tmp_path / "plain/out")], spark) == 1
    (tmp_path / "bad.json").write_text('{"kind": "tables"}')
    assert cli.main(["check", "--config", str(tmp_path / "bad.json")], spark) == 1


def test_available_stream(spark, tmp_path):
    from tributary.streaming.changes import run_available

    rows(spark, [(1, "a"), (2, "b")]).write.parquet(str(tmp_path / "in"))
    t = Table(spark, str(tmp_path / "out"))
    for _ in range(2):
        stream = spark.readStream.schema("k long, v string").parquet(str(tmp_path / "in"))
        run_available(stream, lambda df, batch: t.commit(df, batch_id=batch), str(tmp_path / "cp"), "s")
    assert t.read().count() == 2


def test_upserts_are_merged_when_read(spark, tmp_path, monkeypatch):
    """An upsert writes its own keys alone; reads see the last event of each, across appends, compactions and checkpoints of the log."""
    from tributary.functions.rowid import envelope
    from tributary.sinks import table as sink

    monkeypatch.setattr(sink, "CHECKPOINT", 3)
    monkeypatch.setattr(sink, "DELTAS", 4)
    t, want = Table(spark, str(tmp_path / "u")), {}
    put = lambda data, op="u": envelope(rows(spark, data, "k string, v string"), ["k"], op, AT)
    t.commit(put([(f"{i:03d}", "old") for i in range(20)], "r"), batch_id="0", partition="/{k, identity}")
    want |= {f"{i:03d}": "old" for i in range(20)}
    for n in range(1, 10):
        some = [(f"{i:03d}", f"v{n}") for i in range(n, 20, n + 1)] + [(f"new{n}", "x")]
        t.commit(put(some), batch_id=str(n), mode="upsert", order=["v"], partition="/{k, bucket[2]}")
        want |= dict(some)
        assert {r.k: r.v for r in t.read().collect()} == want and t.read().count() == len(want)
    assert sum(f["upsert"] for f in t.meta()["folders"]) < 4 and t.meta()["folders"][0].get("partition") == "/{k, identity}"
    assert {r.k: r.v for r in t.read(1).collect()} == {f"{i:03d}": "old" for i in range(20)}
    assert t.commit(put([("000", "again")]), batch_id="3", mode="upsert") == t.version()  # known: not applied twice
    before = t.version()
    t.compact(full=True)
    assert {r.k: r.v for r in t.read().collect()} == want and len(t.meta()["folders"]) == 1 and t.version() == before + 1


def test_partitioned_sync(spark, source, tmp_path):
    """Partition values that look like numbers come back as they were; directories follow the specification."""
    rows(spark, [(1, "007"), (2, ""), (3, None), (4, "a/b")]).write.mode("overwrite").parquet(str(tmp_path / "t.parquet"))
    sync = Sync(spark, source, str(tmp_path / "out"), State(), ingested_at=AT)
    sync.run(catalog(source, "full_refresh", partition="/{v, identity}/{k, bucket[4]}/{now(), day}"))
    assert {(r.k, r.v) for r in sync.table(source.discover()[0]).read().collect()} == {(1, "007"), (2, ""), (3, None), (4, "a/b")}
    dirs = {d.split("=")[0] for _, names, _ in os.walk(tmp_path / "out/t/data") for d in names if "=" in d}
    assert dirs == {"__p0_v", "__p1_k_bucket", "__p2__ingested_at_day"}


def test_files_skip_rows(spark, tmp_path):
    """Lines before the header go, once for each file, though a line like one of them comes again among the rows."""
    (tmp_path / "f/s").mkdir(parents=True)
    (tmp_path / "f/s/a.csv").write_text("made by hand\n1,x\nid,v\n1,x\n1,x\n2,\"y,z\"\n")
    with gzip.open(tmp_path / "f/s/b.csv.gz", "wt") as f:
        f.write("another line\nsecond\nv,id\nw,3\n")
    source = FileSource(spark, {"path": str(tmp_path / "f"), "format": "csv", "skip_rows": 2, "prefer_long": True})
    (s,) = source.discover()
    assert s.schema["id"] == "integer" and sorted((r.id, r.v) for r in source.table(s).collect()) == [(1, "x"), (1, "x"), (2, "y,z"), (3, "w")]


def test_jdbc_plans(spark, monkeypatch):
    """Chunks and predicates of a relational source, with a table in place of its connection."""
    from tributary.catalog import Stream, default_mode
    from tributary.operators.chunks import Chunk
    from tributary.sources.jdbc import JdbcSource

    keyed, keyless = Stream("t", "s", {}, ["full_refresh", "incremental"], ["k"], ["k"]), Stream("t", "s", {}, ["full_refresh"])
    source = JdbcSource(spark, {"dialect": "postgres", "url": "jdbc:postgresql://none", "chunk_rows": 40})
    monkeypatch.setattr(source, "table", lambda s: spark.range(100).selectExpr("id as k", "id * 3 as c"))
    assert source.predicates(keyed, source.chunks(keyed)) == ["NOT ((k >= 40))", "((k >= 40)) AND NOT ((k >= 80))", "((k >= 80))"]
    source.config["chunk_column"] = "c"
    assert source.predicates(keyed, source.chunks(keyed))[0] == "NOT ((c >= 120))"
    del source.config["chunk_column"]
    monkeypatch.setattr(source, "_page_chunks", lambda s: [Chunk(None, "(262144,0)"), Chunk("(262144,0)", None)])
    assert source.predicates(keyless, source.chunks(keyless)) == ["NOT ((ctid >= '(262144,0)'))", "((ctid >= '(262144,0)'))"]
    assert default_mode(keyed).sync_mode == "incremental"


def test_message_ranges():
    """Only what lies between two positions is asked of the broker; a partition that is new begins at its beginning."""
    from tributary.sources.messages import range_options

    got = range_options("t", {"0": 4}, {"0": 9, "1": 2})
    assert {k: json.loads(v) for k, v in got.items()} == {"assign": {"t": [0, 1]}, "startingOffsets": {"t": {"0": 5, "1": -2}}, "endingOffsets": {"t": {"0": 10, "1": 3}}}


def test_backfill_of_many_chunks_has_few_commits(spark, tmp_path, monkeypatch):
    """The number of commits doesn't grow with the chunks, and a restart whose destination is ahead lands no row twice."""
    spark.range(120).selectExpr("id as k", "'a' as v").write.parquet(str(tmp_path / "t.parquet"))
    source = TableSource(spark, {"path": str(tmp_path), "tables": ["t"], "keys": {"t": ["k"]}, "chunk_rows": 1})
    state, path = State(str(tmp_path / "state.json")), str(tmp_path / "out")
    cat = catalog(source, "incremental", "k")
    remove, calls = state.remove_chunks, []

    def broken(stream, chunks):
        calls.append(chunks)
        if len(calls) == 3:
            raise RuntimeError("killed")
        remove(stream, chunks)

    monkeypatch.setattr(state, "remove_chunks", broken)
    with pytest.raises(RuntimeError):
        Sync(spark, source, path, state, ingested_at=AT, chunks_per_commit=2).run(cat)
    assert len(state.chunks("t")) == 120 - 2 * 8
    sync = Sync(spark, source, path, State.load(str(tmp_path / "state.json")), ingested_at=AT, chunks_per_commit=2)
    sync.run(cat)
    assert sync.table(cat.streams[0]).version() == 15 + 1
    assert landed(sync.table(cat.streams[0])) == [(k, "a", "r") for k in range(120)]


def test_lost_state_of_many_chunks(spark, tmp_path, monkeypatch):
    """Without the state the same groups are planned again, and those that the destination has are adopted, few as they are."""
    spark.range(120).selectExpr("id as k", "'a' as v").write.parquet(str(tmp_path / "t.parquet"))
    source = TableSource(spark, {"path": str(tmp_path), "tables": ["t"], "keys": {"t": ["k"]}, "chunk_rows": 1})
    state, path = State(), str(tmp_path / "out")
    cat = catalog(source, "incremental", "k", append_mode=True)

    def broken(stream, chunks):
        if chunks[0][0] is not None:
            raise RuntimeError("killed")
        State.remove_chunks(state, stream, chunks)

    monkeypatch.setattr(state, "remove_chunks", broken)
    with pytest.raises(RuntimeError):
        Sync(spark, source, path, state, ingested_at=AT, chunks_per_commit=2).run(cat)
    lost = State()
    sync = Sync(spark, source, path, lost, ingested_at=AT, chunks_per_commit=2)
    assert sync.table(cat.streams[0]).read().count() == 2 * 8
    sync.run(cat)
    assert sync.table(cat.streams[0]).version() == 15 + 1 and lost.cursor("t", "k") == 119
    assert landed(sync.table(cat.streams[0])) == [(k, "a", "r") for k in range(120)]


def test_xml_files_are_many_and_alike(spark, tmp_path):
    """Columns are those of all files, also for some of them; the registered query's documents are of bounded size."""
    from tributary.plans.sync_queries import files_xml

    base = tmp_path / "files"
    (base / "x").mkdir(parents=True)
    (base / "x/a.xml").write_text("<root><order id='7'><n>1</n></order></root>")
    (base / "x/b.xml").write_text("<root><order><n>2</n><n>3</n><m>4</m></order></root>")
    src = FileSource(spark, {"path": str(base), "format": "xml", "row_identifier": "order"})
    stream = src.discover()[0]
    for path, want in (("a", ("7", None, "1")), ("b", (None, "4", "3"))):
        assert [tuple(r) for r in src.read(stream, [f"file:{base}/x/{path}.xml"]).select("_id", "m", "n").collect()] == [want]
    spark.range(450_000).selectExpr("id as o_orderkey", "'O' as o_orderstatus", "1.0d as o_totalprice").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    found = files_xml(spark, str(tmp_path))
    assert len(found.inputFiles()) >= 3 and found.distinct().count() == 450_000
