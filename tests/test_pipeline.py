import json
import random

from driftline.operators.state import MemoryStore
from driftline.pipeline import LOG_SCHEMA, LakeDestination, Pipeline, Table


def random_log(seed, n=240):
    r, rows = random.Random(seed), []
    for i in range(n):
        table = r.choice([1, 2, 9])
        op = r.choice("IUUUDD" if i % 60 else "T")
        key = {"id": r.randrange(10)}
        new = None if op in "DT" else json.dumps({**key, ("name" if table == 1 else "n"): r.choice([None, "5", "6"]) if table == 1 else r.randrange(5)})
        old = json.dumps(key) if op == "D" else json.dumps({"id": r.randrange(10)}) if op == "U" and r.random() < 0.2 else None
        rows.append((table, op, i // 4 * 16 + 16, i % 4 + 1, new, old))
    return rows


def sequential(start, rows, table, after):
    state = dict(start)
    for t, op, lsn, _, new, old in rows:
        if t != table or lsn <= after:
            continue
        n, o = (json.loads(x) if x else None for x in (new, old))
        if op == "T":
            state.clear()
        elif op == "D":
            state.pop(o["id"], None)
        else:
            if o:
                state.pop(o["id"], None)
            state[n["id"]] = n.get("name", n.get("n"))
    return set(state.items())


def test_copy_then_stream_in_steps(spark, tmp_path):
    rows = random_log(4)
    first, second = {i: f"old{i}" for i in range(5)}, {i: i for i in range(3, 8)}
    tables = [
        Table(1, "id int, name string", ("id",), lambda: spark.createDataFrame(list(first.items()), "id int, name string"), 100),
        Table(2, "id int, n int", ("id",), lambda: spark.createDataFrame(list(second.items()), "id int, n int"), 0),
    ]
    store, source = MemoryStore(), tmp_path / "log"
    store.set_state(7, "ready")  # a table that is published no more
    for k in range(3):
        part = spark.createDataFrame([(*r[:2], str(r[2]), *r[3:]) for r in rows[k * 80 : (k + 1) * 80]], "table_id long, op string, lsn string, tx_ordinal long, new string, old string")
        part.selectExpr("table_id", "op", "cast(lsn as decimal(20,0)) commit_lsn", "tx_ordinal", "new", "old").coalesce(1).write.mode("append").parquet(str(source))
        lake = LakeDestination(spark, str(tmp_path / "lake"), tables, buckets=4)
        stream = spark.readStream.schema(LOG_SCHEMA).parquet(str(source))
        query = Pipeline(spark, tables, lake, store, str(tmp_path / "check")).start(stream, availableNow=True)
        query.awaitTermination()
        assert query.exception() is None
        so_far = rows[: (k + 1) * 80]
        assert {tuple(r) for r in lake.current(1).collect()} == sequential(first, so_far, 1, 100)
        assert {tuple(r) for r in lake.current(2).collect()} == sequential(second, so_far, 2, 0)
    assert store.state(1) == store.state(2) == "ready" and store.state(7) is None and store.progress(2) > store.progress(7)
