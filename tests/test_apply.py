"""Set-based apply against a sequential fold over random logs."""

import random

import pytest
from pyspark.sql import functions as F

from driftline.functions.lsn import sequence_key
from driftline.operators import apply, log, sinks

DDL = "old_k int, new_k int, commit_lsn long, tx_ordinal long, op string, is_partial boolean, a string, b int"


def random_log(seed, n=300, keys=12):
    r, out = random.Random(seed), []
    for i in range(n):
        k = r.randrange(keys)
        op = r.choice("IUUUUD")
        partial = op == "U" and r.random() < 0.4
        moved = r.randrange(keys) if op == "U" and not partial and r.random() < 0.2 else k
        out.append((k, moved, i // 3 * 16 + 16, i % 3 + 1, op, partial, r.choice([None, "x", "y", "z"]), None if partial else r.choice([None, 1, 2, 3])))
    return out


def sequential(rows):
    """The mutations one after another: what a row store would hold."""
    state = {}
    for old, new, lsn, o, op, partial, a, b in rows:
        if op == "D":
            state.pop(old, None)
        elif partial:
            if new in state:
                state[new] = (a, state[new][1])
        else:
            if old != new:
                state.pop(old, None)
            state[new] = (a, b)
    return {(k, *v) for k, v in state.items()}


def legs(spark, rows, values=("a", "b", "is_partial")):
    df = spark.createDataFrame(rows, DDL).repartition(4).withColumn("seq", sequence_key(F.col("commit_lsn"), F.col("tx_ordinal")))
    return log.split_key_changes(df, ["old_k"], ["new_k"], list(values), ["seq"], ["k"])


@pytest.mark.parametrize("seed", range(6))
def test_fold_equals_sequential(spark, seed):
    rows = random_log(seed)
    full = F.coalesce(~F.col("is_partial"), F.lit(True))
    out = apply.fold(legs(spark, rows), ["k"], ["seq", "sub"], ["a", "b"], {"b": full}, full)
    assert {(r.k, r.a, r.b) for r in out.collect()} == sequential(rows)


@pytest.mark.parametrize("seed", range(3))
def test_last_writer_wins_and_replay(spark, seed):
    rows = [r for r in random_log(seed) if not r[5]]
    want = sequential(rows)
    once = legs(spark, rows)
    twice = once.unionByName(legs(spark, rows[len(rows) // 2 :]))
    for x in (once, twice):
        assert {(r.k, r.a, r.b) for r in apply.last_writer_wins(x, ["k"], ["seq", "sub"], ["a", "b"]).collect()} == want


def test_merge_in_batches_equals_whole(spark):
    rows = [r for r in random_log(11) if not r[5]]
    base = spark.createDataFrame([], "k int, a string, b int")
    for part in (rows[:90], rows[90:150], rows[150:]):
        state = apply.last_writer_wins(legs(spark, part), ["k"], ["seq", "sub"], ["a", "b"], tombstones=True)
        base = spark.createDataFrame(apply.merge_into(base, state, ["k"]).collect(), base.schema)
    assert {tuple(r) for r in base.collect()} == sequential(rows)


def test_history_ends_at_the_folded_state(spark):
    rows = random_log(3)
    full = F.coalesce(~F.col("is_partial"), F.lit(True))
    x = legs(spark, rows)
    history = apply.carry_forward(x, ["k"], ["seq", "sub"], ["a", "b"], {"b": full}, full)
    last = history.groupBy("k").agg(F.max_by(F.struct("a", "b"), F.struct("seq", "sub")).alias("r")).select("k", "r.*")
    state = apply.fold(x, ["k"], ["seq", "sub"], ["a", "b"], {"b": full}, full)
    assert {tuple(r) for r in state.select("k", "a", "b").collect()} <= {tuple(r) for r in last.collect()}


def test_truncates_and_watermarks(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "c"), (2, "a"), (3, "a")], "table_id int, seq string")
    cut = spark.createDataFrame([(1, "a"), (1, "b"), (2, "z")], "table_id int, seq string")
    assert {tuple(r) for r in apply.after_truncates(rows, cut).collect()} == {(1, "c"), (3, "a")}
    marks = cut.withColumnRenamed("seq", "applied")
    assert {tuple(r) for r in apply.after_watermark(rows, marks).collect()} == {(1, "c"), (3, "a")}


def test_no_identity_deletes_every_equal_row(spark):
    base = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    gone = spark.createDataFrame([(1, None)], "a int, b string")
    assert [tuple(r) for r in apply.delete_by_identity(base, gone, ["a", "b"]).collect()] == [(2, "x")]


def test_segments_and_batches(spark):
    rows = [(1, i, v) for i, v in enumerate([0, 0, 1, 1, 0])]
    df = spark.createDataFrame(rows, "table_id int, seq int, v int")
    assert [r.segment for r in apply.segments(df, "table_id", ["seq"], "v").orderBy("seq").collect()] == [1, 1, 2, 2, 3]
    sized = df.withColumn("size", F.lit(4))
    assert [r.batch for r in apply.byte_batches(sized, "table_id", ["seq"], "size", 8).orderBy("seq").collect()] == [0, 0, 1, 1, 2]


def test_key_only_deletes_get_zeros(spark):
    df = spark.createDataFrame([(1, None, None, "D", 5), (2, "x", 3, "I", 6)], "k int, name string, n int, op string, commit_lsn int")
    out = sinks.audit_log(df, [("k", "int", False), ("name", "string", False), ("n", "int", True)], ["k"]).collect()
    assert [tuple(r) for r in out] == [(1, "", None, "DELETE", 5), (2, "x", 3, "INSERT", 6)]


def test_versioned_table(spark, tmp_path):
    t = sinks.VersionedTable(spark, str(tmp_path / "t"), "t_view")
    assert t.head() is None
    assert t.publish(spark.range(3), 0, "a") == 1
    assert spark.table("t_view").count() == 3
    assert t.truncate(1, "b") == 2 and spark.table("t_view").count() == 0
    assert t.publish(spark.range(2), 2, "c") == 3 and t.head().batch_id == 2
    t.drop_versions_before(3)
    assert not (tmp_path / "t" / "v1").exists() and t.read().count() == 2


def test_resolve_unchanged(spark):
    image = "struct<id:int,big:string>"
    rows = [((1, None), (1, "old"), "full", ["big"]), ((2, None), (2, None), "key", ["big"]), ((3, "new"), None, None, []), ((4, None), None, None, ["big"])]
    df = spark.createDataFrame(rows, f"new {image}, old {image}, old_kind string, unchanged array<string>")
    out = log.resolve_unchanged(df, ["id", "big"], ["id"]).orderBy("new.id").collect()
    assert [(r.new.big, r.new_kind, r.missing) for r in out] == [("old", "full", []), (None, "partial", ["big"]), ("new", "full", []), (None, "partial", ["big"])]


@pytest.mark.parametrize("parts", [2, 7, 40])
def test_spread_forms_equal_plain_ones(spark, parts, monkeypatch):
    monkeypatch.setattr(apply, "SORT_ROWS", 1)
    """One table holds most of the log; some rows have no table."""
    r = random.Random(parts)
    rows = [(r.choice([1, 1, 1, 1, 2, None]), i, r.choice([0, 0, 1, None]), r.randrange(1, 9), r.choice("IIUDRT")) for i in range(200)]
    df = spark.createDataFrame(rows, "t int, i int, v int, size int, op string").repartition(5)
    forms = [
        (lambda **k: apply.segments(df, "t", ["i"], "v", **k), "segment"), (lambda **k: apply.barriers(df, "t", ["i"], **k), "run"),
        (lambda **k: apply.mutation_batches(df, "t", ["i"], 16, **k), "batch"), (lambda **k: apply.byte_batches(df, "t", ["i"], "size", 20, **k), "batch"),
    ]
    for form, name in forms:
        plain, spread = ({x.i: x[name] for x in form(**k).collect()} for k in ({}, {"spread": F.col("i"), "parts": parts}))
        assert plain == spread and len(plain) == 200
    want, last, n = {}, {}, {}
    for t, i, v, *_ in rows:
        n[t] = n.get(t, 0) + (t not in last or last[t] != v)
        last[t] = v
        want[i] = n[t]
    assert {x.i: x.segment for x in forms[0][0](spread=F.col("i"), parts=parts).collect()} == want
