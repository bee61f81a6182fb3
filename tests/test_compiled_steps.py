"""Steps of the apply path and of zoned times that once fell out of compiled
code, or ran again wherever an expression named them."""

from pyspark.sql import functions as F

from driftline.functions import lsn
from driftline.operators import apply, log, sinks
from driftline.operators.state import Destination, MemoryStore
from driftline.pipeline import LOG_SCHEMA, LakeDestination, Pipeline, Table


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def events(spark, *rows):
    return spark.createDataFrame([(1, op, at, 1, new, old) for op, at, new, old in rows], LOG_SCHEMA.replace("decimal(20,0)", "long")).withColumn("commit_lsn", F.col("commit_lsn").cast(lsn.LSN))


def test_legs_are_exploded_without_lambdas(spark):
    df = spark.createDataFrame([("U", 1, 2, "b", 1), ("D", 3, 3, None, 2), ("U", None, 4, "c", 3), (None, 5, 5, "d", 4)], "op string, o int, n int, v string, seq int")
    out = log.split_key_changes(df, ["o"], ["n"], ["v"], ["seq"], ["k"])
    assert "lambda" not in plan(out)
    assert out.columns == ["k", "seq", "sub", "deleted", "v"]
    assert [tuple(r) for r in out.orderBy("seq", "sub").collect()] == [(1, 1, 0, True, None), (2, 1, 1, False, "b"), (3, 2, 0, True, None), (4, 3, 0, False, "c"), (5, 4, 0, None, "d")]


def test_positions_need_no_conversion_of_bases(spark):
    n = [0, 1, 2**63 - 1, 2**63, 2**64 - 1]
    df = spark.createDataFrame([(str(x),) for x in n], "s string").select(F.col("s").cast(lsn.LSN).alias("n"))
    assert [r.h for r in df.select("n", lsn.hex16(F.col("n")).alias("h")).orderBy("n").collect()] == [f"{x:016x}" for x in n]
    assert "hex(" in plan(df.select(lsn.hex16(F.col("n"))))


def test_stored_rows_fill_one_buffer_of_a_fold(spark):
    full = ~F.col("partial")
    df = spark.createDataFrame([(1, "a", "x", 1, False, False), (1, "b", None, 2, False, True), (2, "a", "x", 1, True, False), (2, "b", "y", 2, False, True), (3, "a", "x", 1, False, True), (4, "a", "x", 3, False, False), (4, "b", "y", 2, False, True), (5, "a", "x", 1, False, False), (5, "b", None, 2, False, None)], "k int, last string, opened string, seq int, deleted boolean, partial boolean")
    out = apply.fold(df, ["k"], ["seq"], ["last", "opened"], {"opened": F.lit(False)}, full, tombstones=True)
    assert {tuple(r) for r in out.select("k", "seq", "deleted", F.col("last"), "opened").collect()} == {(1, 2, False, "b", "x"), (2, 2, True, None, None), (4, 3, False, "a", "x"), (5, 2, False, "b", "x")}


def test_doubled_events_of_a_lake_need_no_search(spark, tmp_path):
    table = Table(1, "id int, a string, b string", ("id",), lambda: spark.createDataFrame([(1, "old", "old")], "id int, a string, b string"))
    lake = LakeDestination(spark, str(tmp_path / "lake"), [table], buckets=2, partial=True)
    run = Pipeline(spark, [table], lake, MemoryStore(), str(tmp_path / "check"))
    run.prepare()
    run.copy(1)
    batch = events(spark, ("U", 1, '{"id": 1, "a": "x"}', None), ("I", 2, '{"id": 2, "a": null, "b": "y"}', None), ("U", 3, '{"id": 3, "a": "z", "b": null}', '{"id": 2}'), ("I", 4, '{"id": 4, "a": "q", "b": "q"}', None), ("D", 5, None, '{"id": 4}'))
    assert "Aggregate" not in plan(run.owned(batch.unionByName(batch)))
    run.apply(batch.unionByName(batch), 0)
    assert {tuple(r) for r in lake.current(1).collect()} == {(1, "x", "old"), (3, "z", None)}

    class Audit(Destination):
        drop_table_for_copy = write_table_rows = write_events = lambda self, *_: None

    assert Pipeline(spark, [table], Audit(), run.store, "").owned(batch.unionByName(batch)).count() == 5


def test_parsed_images_are_read_for_names_beside_a_null_only(spark):
    df = events(spark, ("U", 1, '{"id": 1, "a": null}', None), ("I", 2, '{"id": 2, "a": "x"}', None), ("D", 3, None, '{"id": 3}')).select("op", "new", "old", F.from_json("new", "id int, a string").alias("n"), F.from_json("old", "id int, a string").alias("o"))
    assert [r.op for r in df.select(sinks.strict_parsed_op(["id", "a"], ["id"], "n", "o").alias("op")).collect()] == ["U", "I", "D"]
