"""Schemas, state, planning, maintenance and streaming."""

import random

import pytest
from pyspark.sql import functions as F

from driftline.operators import schema, state, validate
from driftline.operators.schema import Column, TableSchema
from driftline.plans import copy_plan, maintenance
from driftline.sources import catalog, copy_text

ID, NAME, MAIL = Column("id", "int8", 1, 2, False), Column("name", "text", 2, 1), Column("mail", "text", 3)
USERS = TableSchema(7, "public", "users", (MAIL, ID, NAME))


def test_masks_and_identity():
    assert [c.name for c in USERS.replicated()] == ["id", "name", "mail"] and USERS.mask(["mail", "id"]) == (True, False, True)
    assert [c.name for c in USERS.primary_key()] == ["name", "id"]
    with pytest.raises(ValueError):
        USERS.replicated(["nope"])
    for mode, kind in (("d", "primary_key"), ("f", "full"), ("n", "missing"), ("i", "alternative_key")):
        found = schema.identity_columns(USERS, USERS.replicated(), mode, ["mail"])
        assert schema.identity_type(USERS, USERS.replicated(), found) == kind
    assert [c.name for c in schema.identity_columns(USERS, USERS.replicated(), "d")] == ["id", "name"]


def test_diff_by_ordinal():
    new = (ID, Column("full_name", "text", 2, 1), Column("mail", "int4", 4))
    d = schema.diff(USERS.replicated(), new)
    assert [c.ordinal for c in d["added"]] == [4] and [c.ordinal for c in d["removed"]] == [3] and [(a.name, b.name) for a, b in d["changed"]] == [("name", "full_name")]
    assert schema.diff((MAIL,), (Column("mail", "int4", 3),)) == {"added": [], "removed": [], "changed": []}
    assert [s[:2] for s in schema.plan_steps(USERS.replicated(), new, "lake")] == [("set_aside", "mail"), ("rename", "name"), ("add", "mail")]
    assert [s[0] for s in schema.plan_steps(USERS.replicated(), new, "upsert")] == ["add", "rename", "drop"]
    with pytest.raises(ValueError):
        schema.reject_key_changes(USERS, USERS.replicated(), new)
    assert schema.check_relation("skip", 5, 4) == "skip" and schema.check_relation("apply", 5, 4) == "apply" and schema.check_relation("error", 4, 5) == "apply"
    with pytest.raises(ValueError):
        schema.check_relation("error", 5, 4)


def test_random_diffs_lead_from_old_to_new():
    r = random.Random(0)
    for _ in range(100):
        old = [Column(f"c{r.randrange(5)}_{o}", "text", o, nullable=r.random() < 0.5) for o in range(6) if r.random() < 0.7]
        new = [Column(f"c{r.randrange(5)}_{o}", "text", o, nullable=r.random() < 0.5) for o in range(6) if r.random() < 0.7]
        d, by = schema.diff(old, new), {c.ordinal: c for c in old}
        for c in d["removed"]:
            del by[c.ordinal]
        by |= {c.ordinal: c for c in d["added"]} | {b.ordinal: b for _, b in d["changed"]}
        assert {o: c.name for o, c in by.items()} == {c.ordinal: c.name for c in new}


def test_name_used_again_is_another_column(spark):
    v1, v2 = (Column("id", "int8", 1), Column("status", "text", 2)), (Column("id", "int8", 1), Column("status", "int4", 3))
    types = {"int8": "bigint", "text": "string", "int4": "int"}
    a = schema.stored(spark.createDataFrame([(1, "x")], "id long, status string"), v1)
    b = schema.stored(spark.createDataFrame([(2, 5)], "id long, status int"), v2)
    both = schema.as_version(a, v2, types).unionByName(schema.as_version(b, v2, types))
    assert sorted(tuple(r) for r in both.collect()) == [(1, None), (2, 5)]


def test_as_of_forms_agree(spark):
    r = random.Random(2)
    versions = spark.createDataFrame([(t, r.randrange(100)) for t in range(3) for _ in range(4)], "table_id int, snapshot_id int").distinct()
    events = spark.createDataFrame([(i, r.randrange(4), r.randrange(120)) for i in range(200)], "id int, table_id int, commit_lsn int")
    plain = events.alias("e").join(versions.alias("v"), (F.col("e.table_id") == F.col("v.table_id")) & (F.col("v.snapshot_id") <= F.col("e.commit_lsn")), "left").groupBy("e.id").agg(F.max("v.snapshot_id").alias("s"))
    want = {r.id: r.s for r in plain.collect()}
    assert {r.id: r.snapshot_id for r in schema.as_of(events, versions).collect()} == want
    assert {r.id: r.snapshot_id for r in schema.as_of_broadcast(events, versions).collect()} == want
    exact = {r.id for r in schema.as_of(events, versions, exact=True).collect()}
    assert exact == {r.id for r in events.join(versions, (events.table_id == versions.table_id) & (events.commit_lsn == versions.snapshot_id), "left_semi").collect()}


def test_memory_store():
    s = state.MemoryStore()
    s.set_state(1, "init")
    s.set_state(1, "data_sync")
    assert s.rollback(1) == "init" and s.state(1) == "init" and s.state(2) is None
    with pytest.raises(ValueError):
        s.rollback(1)
    assert s.advance(1, 50) == 50 and s.advance(1, 20) == 50 and s.progress(1) == 50
    for v in (0, 10, 20):
        s.store(TableSchema(1, "public", "t", (ID,), v))
    assert s.schema_at(1, 15).snapshot == 10 and s.schema_at(9, 15) is None
    assert s.prune({1: 15}) == 1 and s.schema_at(1, 5) is None and s.schema_at(1, 12).snapshot == 10
    assert s.tables_to_purge([1, 3]) == ({3}, set())
    s.delete_table(1)
    assert s.state(1) is None


def test_hand_off():
    steps, now = [], ("finished_copy", None)
    for current in (10, 30, 25, 30, 40):
        now = state.next_state(*now, current=current, snapshot=20)
        steps.append(now)
    assert steps == [("sync_wait", 20), ("catchup", 30), ("catchup", 30), ("sync_done", 30), ("ready", None)]
    assert state.backpressure([0.8, 0.86, 0.8, 0.74, 0.84, 0.85]) == [False, True, True, False, False, True]


def test_copy_planning(spark):
    assert copy_plan.target_ranges(1, 10**9) == 1 and copy_plan.target_ranges(2, 0) == 8 and copy_plan.target_ranges(2, 10**7) == 40 and copy_plan.target_ranges(2, 10**12) == 1024
    for blocks in (0, 1, 5, 100):
        for n in (1, 3, 7):
            ranges = copy_plan.block_ranges(blocks, n)
            assert ranges[0][0] is None and ranges[-1][1] is None and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    assert copy_text.range_predicates([(None, 5), (5, None)], "k") == ["k < 5", "k >= 5"]
    assert copy_text.copy_query("t", ["a", "b"], "a > 1") == "select a, b from t where (a > 1)"
    assert [copy_text.should_copy(m, 1, [1]) for m in ("all", "none", "include", "skip")] == [True, False, True, False]
    assert copy_plan.batch_budget(100, 1000, 0.2, 4) == 50


def test_maintenance(spark, tmp_path):
    files = spark.createDataFrame([(1, 100, 10), (1, 6 * 1024 * 1024, 5), (2, 10, 0)], "table_id int, file_bytes long, rows long")
    m = {r.table_id: r for r in maintenance.storage_metrics(files, spark.createDataFrame([(1, 3)], "table_id int, rows long")).collect()}
    assert m[1].small_files == 1 and m[1].deleted_row_ratio == 0.2 and m[2].deleted_row_ratio == 0
    spark.range(100).repartition(20).write.parquet(f"{tmp_path}/a")
    maintenance.compact(spark, f"{tmp_path}/a", f"{tmp_path}/b", 10, 25)
    assert spark.read.parquet(f"{tmp_path}/b").count() == 100 and len(list((tmp_path / "b").glob("*.parquet"))) <= 3
    now = F.timestamp_seconds(F.lit(10_000_000))
    v = spark.createDataFrame([(1, 1, 0), (1, 2, 0), (2, 1, 0), (3, 1, 9_999_999), (3, 2, 9_999_999)], "table_id int, version int, s long").withColumn("created", F.timestamp_seconds("s"))
    assert [(r.table_id, r.version) for r in maintenance.expired(v, now).collect()] == [(1, 1)]
    f = spark.createDataFrame([("a", 0), ("b", 0), ("c", 9_999_999)], "path string, s long").withColumn("created", F.timestamp_seconds("s"))
    assert [r.path for r in maintenance.unreferenced(f, f.where("path = 'a'"), now).collect()] == ["b"]


def test_catalog(spark):
    tables = spark.createDataFrame([(1, "public", "a"), (2, "pg_catalog", "b"), (3, "pg_toast_1", "c"), (4, "internal", "d")], "table_id int, schema_name string, table_name string")
    assert [r.table_id for r in catalog.replicable_tables(tables, ("internal",)).collect()] == [1]
    inherits = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (5, 6)], "parent_id int, child_id int")
    assert {(r.table_id, r.root_id) for r in catalog.roots(inherits).collect()} == {(i, 1) for i in range(2, 7)}
    assert [r.table_id for r in catalog.publication_tables(spark.createDataFrame([(6,), (1,)], "table_id int"), inherits).collect()] == [1]
    assert validate.tables_present(["a", "x"], tables).first().present is False and validate.tables_present(["a"], tables).first().present is True


def test_stream_survives_restart_and_repeats(spark, tmp_path):
    from driftline.operators.sinks import BucketedTable
    from driftline.streaming import apply_stream

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    whole = {tuple(r) for r in apply_stream.apply.last_writer_wins(apply_stream.events_to_legs(events), ["k"], ["seq", "sub"], ["event_type", "value"]).select("k", "event_type", "value").collect()}
    source, check = tmp_path / "in", str(tmp_path / "check")
    for part in (1, 0, 2):  # out of order
        events.where(f"event_id % 3 = {part}").coalesce(1).write.mode("append").parquet(str(source))
        target = apply_stream.StreamingApply(BucketedTable(spark, str(tmp_path / "t"), ["k"], apply_stream.EVENT_STATE, 5), ["event_type", "value"], apply_stream.events_to_legs)
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        apply_stream.start(stream, target, check, availableNow=True).awaitTermination()
    assert {tuple(r) for r in target.current().collect()} == whole
    before = target.target.head()
    target(events.limit(5), before.batch_id)  # a batch that comes again
    assert target.target.head().version == before.version and {tuple(r) for r in target.current().collect()} == whole


def test_bucketed_table_rewrites_what_is_touched(spark, tmp_path):
    from driftline.operators.sinks import BucketedTable

    t = BucketedTable(spark, str(tmp_path / "t"), ["k"], "k long, v string", 8)
    assert t.head() is None and t.read().count() == 0
    rows = spark.range(100).select(F.col("id").alias("k"), F.lit("a").alias("v"))
    t.publish(rows, t.touched(rows), 0)
    one = rows.where("k = 7").withColumn("v", F.lit("b"))
    touched = t.touched(one)
    assert len(touched) == 1
    kept = t.read(touched).where("k <> 7")
    assert 0 < kept.count() < 50
    t.publish(kept.unionByName(one), touched, 1)
    assert {(r.k, r.v) for r in t.read().collect()} == {(i, "b" if i == 7 else "a") for i in range(100)}
    assert sorted(set(t.head().buckets.values())) == [1, 2]
    gone = t.read(touched).limit(0)
    t.publish(gone, touched, 2)
    assert t.read().count() == 100 - kept.count() - 1 and t.drop_unreferenced(1) == [2]
