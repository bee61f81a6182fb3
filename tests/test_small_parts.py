"""Parts that no registered query shows."""

from pyspark.sql import functions as F

from driftline.functions import names, values
from driftline.operators import log, schema, sinks, state, validate
from driftline.plans import copy_plan, maintenance
from driftline.sources import catalog, changelog


def test_flagged_names(spark):
    df = spark.createDataFrame([([("id", 1), ("a", 0), ("b", 3)],)], "c array<struct<name:string,flags:int>>")
    assert df.select(schema.flagged_names(F.col("c")).alias("n")).first().n == ["id", "b"]


def test_supported_events(spark):
    df = spark.createDataFrame([("I", None), ("X", None), ("M", "ddl"), ("M", "other")], "op string, prefix string")
    assert [tuple(r) for r in log.keep_supported(df, ["ddl"]).collect()] == [("I", None), ("M", "ddl")]
    assert [tuple(r) for r in log.keep_supported(df).collect()] == [("I", None)]


def test_updates_without_old_image(spark):
    df = spark.createDataFrame([("U", None), ("U", "full"), ("I", None)], "op string, old_kind string")
    assert log.without_old_image_needs_primary_key(df, "full").count() == 1
    assert log.without_old_image_needs_primary_key(df, "primary_key").count() == 0


def test_schema_json_keeps_order(spark):
    df = spark.createDataFrame([(1, 0, 2, "b", "text", True), (1, 0, 1, "a", "int8", False)], "table_id int, snapshot_id int, ordinal int, name string, type string, nullable boolean")
    text = catalog.schema_json(df).first()["columns"]
    assert text.index('"a"') < text.index('"b"') and text.startswith('[{"ordinal":1')


def test_quoting():
    assert names.quote_identifier('a"b') == '"a""b"' and names.quote_identifier("a`b", "`") == "`a``b`" and names.quote_literal("it's") == "'it''s'"


def test_allowed_identities(spark):
    both = validate.allowed_identities(["primary_key", "full"], ["full", "missing"])
    assert spark.range(1).select(both.alias("x")).first().x == ["full"]


def test_status_and_rollback_selection(spark):
    states = spark.createDataFrame([(1, "ready"), (2, "errored"), (3, "errored")], "table_id int, state string")
    known = spark.createDataFrame([(1, "a")], "table_id int, name string")
    lag = spark.createDataFrame([(1, 5)], "table_id int, lag int")
    status = {r.table_id: (r.state, r.name, r.lag) for r in validate.replication_status(states, known, lag).collect()}
    assert status == {1: ("ready", "a", 5), 2: ("errored", None, None), 3: ("errored", None, None)}
    assert {r.table_id for r in validate.to_roll_back(states, all_errored=True).collect()} == {2, 3}
    assert {r.table_id for r in validate.to_roll_back(states, [1, 2]).collect()} == {1, 2}


def test_chunked_files_and_discard(spark, tmp_path):
    sinks.write_chunked(spark.range(100).coalesce(1), f"{tmp_path}/t", rows_per_file=30)
    files = list((tmp_path / "t").glob("*.parquet"))
    assert len(files) == 4 and all("zstd" in f.name for f in files) and spark.read.parquet(f"{tmp_path}/t").count() == 100
    sinks.discard(spark.range(3))


def test_log_files_from_a_position(spark, tmp_path):
    rows = spark.createDataFrame([("1",), ("18446744073709551615",)], "n string").select(F.col("n").cast("decimal(20,0)").alias("commit_lsn"))
    rows.write.parquet(f"{tmp_path}/log")
    assert changelog.read_log(spark, f"{tmp_path}/log").count() == 2
    assert changelog.read_log(spark, f"{tmp_path}/log", after="9223372036854775808").count() == 1


def test_rates_and_epochs(spark):
    one = spark.range(1)
    assert one.select(values.rate(F.lit(6), F.lit(2)).alias("x"), values.rate(F.lit(6), F.lit(0)).alias("y"), values.mib(F.lit(1 << 20)).alias("z")).first() == (3.0, 0.0, 1.0)
    assert str(one.select(values.from_postgres_epoch(F.lit(0)).cast("string").alias("x")).first().x) == "2000-01-01 00:00:00"
    assert one.select(values.epoch_age_seconds(F.lit(5), F.lit(None).cast("long")).alias("x")).first().x == 0
    assert copy_plan.ceil_div(7, 2) == 4


def test_table_selection_is_bounded(spark):
    m = spark.createDataFrame([(3, 50), (1, 60), (2, 5), (4, 41)], "table_id int, files long")
    assert [r.table_id for r in maintenance.select_tables(m, maintenance.should_rewrite(), 2).collect()] == [1, 3]
    assert spark.range(1).select(maintenance.should_flush(F.lit(10_000_000)).alias("x")).first().x


def test_destination_contract():
    class Sink(state.Destination):
        def drop_table_for_copy(self, table_id): ...

        def write_table_rows(self, table_id, rows): ...

        def write_events(self, events, batch_id): ...

    Sink().startup()
    Sink().shutdown()
