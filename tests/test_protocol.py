import json

import pytest
from pyspark.sql import functions as F

from driftline import pipeline
from driftline.functions import decode
from driftline.operators import apply, ddl, protocol, schema
from driftline.operators.sinks import BucketedTable
from driftline.operators.state import MemoryStore, ParquetStore, Slots
from driftline.pipeline import LakeDestination, Table
from driftline.plans import maintenance
from driftline.sources import catalog
from driftline.streaming.apply_stream import StreamingApply

OLD = (schema.Column("id", "int8", 1, 0, False), schema.Column("name", "text", 2, default="a'b"), schema.Column("note", "text", 3))
NEW = (schema.Column("id", "int8", 1, 0, False), schema.Column("label", "text", 2), schema.Column("name", "text", 4))


def test_state_survives_a_restart(spark, tmp_path):
    root = str(tmp_path / "state")
    one = ParquetStore(spark, root)
    for s in ("init", "data_sync", "errored"):
        one.set_state(1, s)
    assert one.rollback(1) == "data_sync" and one.advance(1, 50) == 50 and one.advance(1, 40) == 50
    one.set_state(2, "ready")
    one.store(schema.TableSchema(1, "public", "t", OLD, 10))
    one.store(schema.TableSchema(1, "public", "t", NEW, 20))
    one.store(schema.TableSchema(1, "public", "t", NEW, 30))
    one.set_metadata(1, {"status": "applying", "snapshot": 20, "before": [], "columns": []})
    assert one.prune({1: 25}) == 1
    with pytest.raises(ValueError):
        one.set_state(1, "nonsense")
    two = ParquetStore(spark, root)
    assert (two.state(1), two.state(2), two.state(3), two.progress(1)) == ("data_sync", "ready", None, 50)
    assert two.schema_at(1, 19) is None and two.schema_at(1, 25).columns == NEW and two.metadata[1]["status"] == "applying"
    assert two.rollback(1) == "init"
    two.delete_table(2)
    three = ParquetStore(spark, root)
    assert three.state(1) == "init" and three.state(2) is None and three.tables_to_purge([1, 5]) == ({5}, set())
    assert {k: v.count() for k, v in three.tables().items()} == {"replication_state": 1, "replication_progress": 1, "table_schemas": 2, "table_columns": 6, "destination_metadata": 1}


def test_slots(spark, tmp_path):
    slots = Slots(MemoryStore())
    slots.create("a", 100)
    with pytest.raises(ValueError):
        slots.create("a", 1)
    slots.create("b", 5)
    assert slots.confirm("a", 90) == 100 and slots.confirm("a", 110) == 110 and slots.get("a") == 110 and slots.get("c") is None
    assert (slots.state("a", 50), slots.state("b", 50), slots.state("c", 50)) == ("reserved", "lost", "missing")
    assert slots.delete("b") and not slots.delete("b") and slots.state("b", 0) == "missing"


def test_retries():
    store, waits, left = MemoryStore(), [], [3]
    store.set_state(1, "init")
    store.set_state(1, "data_sync")

    def work():
        left[0] -= 1
        if left[0]:
            raise ConnectionError

    assert protocol.with_retries(work, store, 1, sleep=waits.append) == 3 and waits == [10, 10] and store.state(1) == "data_sync"
    left[0] = 99
    with pytest.raises(ConnectionError):
        protocol.with_retries(work, store, 1, 2, sleep=waits.append)
    assert store.state(1) == "errored" and len(waits) == 3
    with pytest.raises(ConnectionError):
        protocol.with_retries(work, store, 1, timed=lambda e: False, sleep=waits.append)
    assert len(waits) == 3


def test_protocol_cache():
    cache = protocol.TableCache()
    with pytest.raises(ValueError, match="before its relation"):
        cache.schema(1)
    one, two = (schema.TableSchema(1, "s", "t", OLD, v) for v in (10, 20))
    cache.ready(1, one)
    assert cache.schema(1) is one
    cache.waiting(1, 20)
    with pytest.raises(ValueError, match="before its relation"):
        cache.schema(1)
    with pytest.raises(ValueError, match="where 20 was announced"):
        cache.ready(1, one)
    cache.ready(1, two)
    assert cache.schema(1) is two
    cache.remove(1)
    with pytest.raises(ValueError):
        cache.schema(1)


def test_rules_that_raise(spark):
    rows = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    with pytest.raises(Exception, match="NULL in NOT NULL columns: b"):
        protocol.require_values(rows, ["a", "b"]).collect()
    with pytest.raises(ValueError, match="cycle"):
        catalog.roots(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "parent_id int, child_id int"))
    deep = spark.createDataFrame([(i, i + 1) for i in range(100)], "parent_id int, child_id int")
    assert {tuple(r) for r in catalog.roots(deep).collect()} == {(i + 1, 0) for i in range(100)}


def test_statements():
    assert ddl.statements('"s"."t"', OLD, NEW, "upsert") == [
        'alter table "s"."t" add column "name" text', 'alter table "s"."t" rename column "name" to "label"', 'alter table "s"."t" alter column "label" drop default', 'alter table "s"."t" drop column "note"',
    ]
    assert ddl.statement("t", ("set_aside", "a", "b")) == 'alter table t rename column "a" to "b"'
    assert ddl.statement("t", ("default", "a", "it's")) == "alter table t alter column \"a\" set default 'it''s'"
    assert [ddl.statement("t", ("nullable", "a", x)) for x in ("true", "false")] == ['alter table t alter column "a" drop not null', 'alter table t alter column "a" set not null']


def test_catalog(spark):
    c = ddl.Catalog(spark)
    c.create_namespace("lake_a")
    c.create_namespace("lake_a")
    assert "lake_a" in c.namespaces()
    assert c.create_table("lake_a", "t", "id long, name string") and not c.create_table("lake_a", "t", "id long")
    c.stage_and_insert(spark.createDataFrame([("a", 1), (None, 2)], "name string, id long"), "lake_a", "t")
    c.stage_and_insert(spark.createDataFrame([("b", 3)], "name string, id long"), "lake_a", "t")
    assert {tuple(r) for r in spark.table("lake_a.t").collect()} == {(1, "a"), (2, None), (3, "b")} and c.tables("lake_a") == ["t"]
    c.drop_table("lake_a", "t")
    c.drop_table("lake_a", "t")
    c.drop_namespace("lake_a")
    assert "lake_a" not in c.namespaces()


def test_publications(spark):
    names, members = spark.createDataFrame([("p",)], "publication string"), spark.createDataFrame([("p", 1)], "publication string, table_id long")
    names, members = ddl.create_publication(names, members, "q", [1, 2])
    tables = spark.createDataFrame([(1, "a"), (2, "b")], "table_id long, table_name string")
    assert {tuple(r) for r in ddl.list_publications(names, members, tables).collect()} == {("p", 1, "a"), ("q", 2, "a,b")}
    assert {tuple(r) for r in ddl.drop_tables(members, "q").collect()} == {("p", 1)}
    with pytest.raises(Exception, match="publication q exists"):
        ddl.create_publication(names, members, "q", [])[0].collect()


def test_a_run_of_maintenance(spark):
    plan = spark.createDataFrame([(2, "merge", 1), (0, "flush", 2), (2, "merge", 0)], "step int, operation string, table_id long")
    seen = []
    assert maintenance.run_once(plan, {"merge": lambda t: seen.append(t), "flush": lambda t: seen.append(-t)}) == [("flush", 2), ("merge", 0), ("merge", 1)] and seen == [-2, 0, 1]


def test_bounded_numerics(spark):
    texts = ["1.00", "-1.5", "12345678.90", "NaN", "nan", "+.5", "1e2", "12_3.4", "1.230", None, "0"]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select(decode.decode(F.col("t"), "numeric(10,2)").alias("v")).collect()
    assert [None if r.v is None else str(r.v) for r in out] == ["1.00", "-1.50", "12345678.90", None, None, "0.50", "100.00", "123.40", "1.23", None, "0.00"]
    for bad in ("1.005", "123456789.0", "x", "1.5.5", "Infinity", "1e-3"):
        with pytest.raises(Exception, match="numeric"):
            spark.createDataFrame([(bad,)], "t string").select(decode.decode(F.col("t"), "numeric(10,2)")).collect()


def test_long_tables_are_sorted_in_stretches(spark, monkeypatch):
    rows = [(t, i, (i * 7919) % 13 if i % 3 else None) for t in (1, None) for i in range(150)]
    log = spark.createDataFrame(rows, "t int, i int, v int").repartition(5)
    want = {}
    for largest in (False, True):
        for most in (1_000_000, 10):
            monkeypatch.setattr(apply, "SORT_ROWS", most)
            for offsets in (100_000, 0):
                monkeypatch.setattr(apply, "OFFSETS", offsets)
                out = {(r.t, r.i): r.x for r in apply.last_known(log, "t", ["i"], F.col("v"), "x", F.col("i"), 8, largest).collect()}
                assert want.setdefault(largest, out) == out and len(out) == 300
    seen, best = None, None
    for i in range(150):
        v = rows[i][2]
        seen, best = (seen if v is None else v), (best if v is None else max(v, best if best is not None else v))
        assert (want[False][1, i], want[True][1, i]) == (seen, best)


EVENTS = "table_id long, op string, commit_lsn decimal(20,0), tx_ordinal long, new string, old string"


def events(spark, *rows):
    return spark.createDataFrame([(1, op, lsn, 1, new and json.dumps(new), old and json.dumps(old)) for op, lsn, new, old in rows], "table_id long, op string, lsn long, tx_ordinal long, new string, old string").selectExpr("table_id", "op", "cast(lsn as decimal(20,0)) commit_lsn", "tx_ordinal", "new", "old")


def test_lake_folds_partial_images_and_keeps_its_generation(spark, tmp_path):
    table = Table(1, "id int, name string, note string", ("id",), lambda: None)
    make = lambda: LakeDestination(spark, str(tmp_path / "lake"), [table], buckets=2, partial=True)
    lake = make()
    lake.write_table_rows(1, spark.createDataFrame([(1, "a", "long")], "id int, name string, note string"))
    lake.write_events(events(spark, ("U", 10, {"id": 1, "name": "b"}, None), ("I", 11, {"id": 2, "name": "x", "note": None}, None), ("U", 12, {"id": 2, "note": "n"}, None), ("U", 13, {"id": 3, "name": "no row"}, None)), 1)
    assert {tuple(r) for r in lake.current(1).collect()} == {(1, "b", "long"), (2, "x", "n")}
    lake.write_events(events(spark, ("U", 20, {"id": 1, "name": None}, None), ("D", 21, None, {"id": 2}), ("U", 22, {"id": 2, "name": "late"}, None)), 2)
    assert {tuple(r) for r in lake.current(1).collect()} == {(1, None, "long")}
    with pytest.raises(Exception, match="moves its row and lacks values"):
        lake.write_events(events(spark, ("U", 30, {"id": 9, "name": "m"}, {"id": 1})), 3)
    lake.drop_table_for_copy(1)
    lake.write_table_rows(1, spark.createDataFrame([(9, "new", "")], "id int, name string, note string"))
    assert {tuple(r) for r in make().current(1).collect()} == {(9, "new", "")}


def test_ready_is_noted_once(spark, tmp_path):
    table = Table(1, "id int, v int", ("id",), lambda: spark.createDataFrame([(1, 0)], "id int, v int"))
    store = MemoryStore()
    run = pipeline.Pipeline(spark, [table], LakeDestination(spark, str(tmp_path / "lake"), [table], buckets=2), store, str(tmp_path / "check"))
    run.prepare()
    run.copy(1)
    for k in range(3):
        run.apply(events(spark, ("U", 100 + k, {"id": 1, "v": k}, None)), k)
    assert store._history[1].count("ready") == 1 and store.rollback(1) == "sync_done"


def test_deleted_keys_are_forgotten(spark, tmp_path):
    target = BucketedTable(spark, str(tmp_path / "t"), ["k"], "k long, seq string, sub int, deleted boolean, v int", 4)
    sink = StreamingApply(target, ["v"], lambda b: b)
    rows = [(1, "a", 0, False, 1), (2, "b", 0, True, None), (3, "d", 0, True, None)]
    sink(spark.createDataFrame(rows, "k long, seq string, sub int, deleted boolean, v int"), 0)
    assert target.read().count() == 3 and sink.purge("c") == 1
    assert {r.k for r in target.read().collect()} == {1, 3} and {tuple(r) for r in sink.current().collect()} == {(1, 1)}
    assert target.head().batch_id == 0 and sink.purge("c") == 0
