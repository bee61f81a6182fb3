"""Registered queries of the engine, each beside its SQL twin.

A query is ``(spark, sf_dir) -> DataFrame`` over the Parquet tables; its twin
is the same question in SQL for another engine. ``query`` registers both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import decode, lsn, names, values
from driftline.operators import apply, log, schema, sinks, state
from driftline.plans import copy_plan, maintenance
from driftline.sources import catalog, changelog, copy_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def change_log(spark: SparkSession, sf_dir: str, complete: bool = False) -> DataFrame:
    """The events as a log; ``complete`` fills partial images from old ones."""
    out = changelog.from_events(table(spark, sf_dir, "events"))
    out = changelog.complete(out) if complete else out
    return out.withColumn("seq", lsn.sequence_key(F.col("commit_lsn"), F.col("tx_ordinal")))


def legs_of(changes: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    return log.split_key_changes(changes, ["old_k"], ["new_k"], ["event_type", "value", *extra], ["seq"], ["k"])


def rows(spark: SparkSession, ddl: str, data: list[tuple]) -> DataFrame:
    """A small literal table."""
    return spark.createDataFrame(data, ddl)


LOG = """
log as (select *, concat(lpad(lower(hex(commit_lsn)), 16, '0'), '/', lpad(lower(hex(tx_ordinal)), 16, '0')) as seq from (
  select 1 as table_id, cast(user_id * 8 + event_id % 8 as bigint) as old_k,
    cast(user_id * 8 + event_id % 8 + case when event_type = 'click' and event_id % 10 = 0 then 8 else 0 end as bigint) as new_k,
    (cast(floor(event_id / 4.0) as bigint) + 1) * 256 as commit_lsn, cast(event_id % 4 + 1 as bigint) as tx_ordinal,
    case when event_type = 'error' then 'D' when event_type = 'signup' then 'I' else 'U' end as op,
    event_type = 'view' as is_partial, event_type, case when event_type = 'view' then null else value end as value, event_id, user_id, props
  from events) t)"""
LEGS = f"""{LOG},
legs as (
  select new_k as k, seq, case when op = 'U' and new_k <> old_k then 1 when new_k <> old_k then 1 else 0 end as sub, op = 'D' as deleted, event_type, value, is_partial from log
  union all select old_k, seq, 0, true, null, null, false from log where new_k <> old_k)"""

#: The same with full images: what a view doesn't send is in its old image.
FULL = LOG.replace("event_type = 'view' as is_partial", "false as is_partial").replace("case when event_type = 'view' then null else value end as value", "value")
FULL_LEGS = LEGS.replace(LOG, FULL)


# Applying

@query(f"with {FULL_LEGS} select k, seq, sub, event_type, value from (select *, row_number() over (partition by k order by seq desc, sub desc) as n from legs) t where n = 1 and not deleted")
def lww_current_state(spark, sf_dir):
    """Full images: those that came partial are completed from the old ones."""
    legs = legs_of(change_log(spark, sf_dir, True))
    return apply.last_writer_wins(legs, ["k"], ["seq", "sub"], ["event_type", "value"])


@query(f"with {FULL_LEGS} select k, event_type, value from (select *, row_number() over (partition by k order by seq desc, sub desc) as n from legs) t where n = 1 and not deleted")
def rmt_current_view(spark, sf_dir):
    changes = change_log(spark, sf_dir, True)
    legs = log.split_key_changes(changes, ["old_k"], ["new_k"], ["event_type", "value"], ["commit_lsn", "tx_ordinal"], ["k"])
    stored = sinks.versioned_rows(legs, ["k"], ["event_type", "value"], "commit_lsn", "tx_ordinal")
    return sinks.current_view(stored, ["k"], ["event_type", "value"])


@query(f"""with {LEGS},
runs as (select *, sum(case when is_partial then 0 else 1 end) over (partition by k order by seq, sub rows unbounded preceding) as gen from legs),
last as (select k, max(gen) as gen from runs group by k),
state as (select r.*, row_number() over (partition by r.k order by seq, sub) as first, row_number() over (partition by r.k order by seq desc, sub desc) as newest from runs r join last using (k, gen) where gen > 0)
select o.k, n.seq, n.sub, n.event_type, o.value from state o join state n on o.k = n.k and n.newest = 1 where o.first = 1 and not o.deleted""")
def fold_partial_updates(spark, sf_dir):
    legs = legs_of(change_log(spark, sf_dir), ("is_partial",))
    full = F.coalesce(~F.col("is_partial"), F.lit(True))
    return apply.fold(legs, ["k"], ["seq", "sub"], ["event_type", "value"], {"value": full}, full)


@query(f"""with {LEGS},
runs as (select *, sum(case when is_partial then 0 else 1 end) over (partition by k order by seq, sub rows unbounded preceding) as gen from legs)
select k, seq, event_type, case when is_partial then first_value(value) over (partition by k, gen order by seq, sub) else value end as value from runs""")
def carried_history(spark, sf_dir):
    """Every row as it stood after each event."""
    legs = legs_of(change_log(spark, sf_dir), ("is_partial",))
    full = F.coalesce(~F.col("is_partial"), F.lit(True))
    return apply.carry_forward(legs, ["k"], ["seq", "sub"], ["event_type", "value"], {"value": full}, full).select("k", "seq", "event_type", "value")


@query(f"with {LEGS} select k, seq, sub, deleted, event_type, value from legs")
def key_change_split(spark, sf_dir):
    return legs_of(change_log(spark, sf_dir))


@query(f"""with {FULL_LEGS}, cuts as (select max(seq) as cut from log where event_id % 97 = 0)
select k, event_type, value from (select *, row_number() over (partition by k order by seq desc, sub desc) as n from legs where seq > (select cut from cuts)) t where n = 1 and not deleted""")
def truncate_barrier(spark, sf_dir):
    """Some events stand for truncates: what came before them is gone."""
    changes = change_log(spark, sf_dir, True)
    truncates = changes.where("event_id % 97 = 0").select("table_id", "seq")
    left = apply.after_truncates(legs_of(changes).withColumn("table_id", F.lit(1).cast("long")), truncates)
    return apply.last_writer_wins(left, ["k"], ["seq", "sub"], ["event_type", "value"]).select("k", "event_type", "value")


@query(f"""with {LOG}, mark as (select max(seq) as applied from log where event_id < 300)
select event_id, seq from log where seq > (select applied from mark)""")
def replay_dedup(spark, sf_dir):
    """The log arrives twice; events at or before the watermark are dropped."""
    changes = change_log(spark, sf_dir)
    applied = changes.where("event_id < 300").groupBy("table_id").agg(F.max("seq").alias("applied"))
    twice = apply.distinct_events(changes.unionByName(changes.where("event_id % 3 = 0")))
    return apply.after_watermark(twice, applied).select("event_id", "seq")


@query(f"""with {LOG}, placed as (select seq, (row_number() over (order by seq) - 1) // 16 as batch from log), batches as (select batch, min(seq) as first_seq, max(seq) as last_seq, count(*) as events from placed group by batch),
mark as (select max(seq) as applied from log where event_id < 300)
select batch, first_seq, last_seq, events, case when applied < first_seq then 'apply' when applied >= last_seq then 'skip' else 'error' end as decision from batches, mark""")
def replay_decision(spark, sf_dir):
    changes = change_log(spark, sf_dir)
    batches = apply.mutation_batches(changes, "table_id", ["seq"], spread=apply.sequence_position(F.col("seq"))).groupBy("batch").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("events"))
    mark = changes.where("event_id < 300").agg(F.max("seq").alias("applied"))
    return batches.crossJoin(mark).select("batch", "first_seq", "last_seq", "events", apply.replay_decision(F.col("first_seq"), F.col("last_seq"), F.col("applied")).alias("decision"))


@query(f"with {LOG}, placed as (select *, (row_number() over (partition by user_id order by seq) - 1) // 16 as batch from log) select user_id, batch, min(seq) as first_seq, max(seq) as last_seq, count(*) as events from placed group by user_id, batch")
def mutation_batches(spark, sf_dir):
    """Atomic batches of 16, each user standing for a table."""
    placed = apply.mutation_batches(change_log(spark, sf_dir), "user_id", ["seq"], spread=apply.sequence_position(F.col("seq")))
    return placed.groupBy("user_id", "batch").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("events"))


@query(f"with {LOG}, sized as (select *, octet_length(encode(event_type)) + octet_length(encode(props)) as size from log), run as (select *, sum(size) over (partition by user_id order by seq rows unbounded preceding) - size as before from sized) select user_id, cast(before // 64 as bigint) as batch, count(*) as events, cast(sum(size) as bigint) as bytes from run group by 1, 2")
def byte_budget_batches(spark, sf_dir):
    sized = change_log(spark, sf_dir).withColumn("size", log.payload_bytes(["event_type", "props"]))
    placed = apply.byte_batches(sized, "user_id", ["seq"], "size", 64, spread=apply.sequence_position(F.col("seq")))
    return placed.groupBy("user_id", "batch").agg(F.count("*").alias("events"), F.sum("size").alias("bytes"))


@query(f"""with {LOG}, marked as (select *, case when lag(event_id // 7 % 3) over (partition by user_id order by seq) = event_id // 7 % 3 then 0 else 1 end as changed from log)
select event_id, cast(sum(changed) over (partition by user_id order by seq rows unbounded preceding) as bigint) as segment from marked""")
def segment_by_schema(spark, sf_dir):
    versions = change_log(spark, sf_dir).withColumn("version", F.expr("event_id div 7 % 3"))
    return apply.segments(versions, "user_id", ["seq"], "version", spread=apply.sequence_position(F.col("seq"))).select("event_id", F.col("segment").cast("long").alias("segment"))


@query(f"with {LOG} select event_id, cast(sum(case when event_id % 97 = 0 then 1 else 0 end) over (partition by user_id order by seq rows unbounded preceding) as bigint) as run from log")
def accumulation_runs(spark, sf_dir):
    marked = change_log(spark, sf_dir).withColumn("op", F.when(F.col("event_id") % 97 == 0, "T").otherwise(F.col("op")))
    return apply.barriers(marked, "user_id", ["seq"], spread=apply.sequence_position(F.col("seq"))).select("event_id", F.col("run").cast("long").alias("run"))


@query(f"""with {FULL_LEGS}, base as (select cast(o_orderkey as bigint) as k, '0000000000000000/0000000000000000' as seq, 0 as sub, false as deleted, o_orderstatus as event_type, o_totalprice as value from orders),
every as (select * from base union all select k, seq, sub, deleted, event_type, value from legs)
select k, event_type, value from (select *, row_number() over (partition by k order by seq desc, sub desc) as n from every) t where n = 1 and not deleted""")
def snapshot_plus_changes(spark, sf_dir):
    snapshot = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("event_type"), F.col("o_totalprice").alias("value"))
    every = apply.with_snapshot(snapshot, legs_of(change_log(spark, sf_dir, True)))
    return apply.last_writer_wins(every, ["k"], ["seq", "sub"], ["event_type", "value"]).select("k", "event_type", "value")


@query("select o_orderkey, o_orderstatus, o_totalprice from orders o where not exists (select 1 from (select distinct o_orderkey as k, o_orderstatus as s from orders where o_orderkey % 7 = 0) d where d.k = o.o_orderkey and d.s is not distinct from o.o_orderstatus)")
def delete_by_identity(spark, sf_dir):
    """A full identity: rows that equal a deleted image go, NULLs matching."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return apply.delete_by_identity(orders, orders.where("o_orderkey % 7 = 0"), ["o_orderkey", "o_orderstatus"])


@query(f"""with {FULL_LEGS}, base as (select cast(o_orderkey as bigint) as k, o_orderstatus as event_type, o_totalprice as value from orders),
state as (select * from (select *, row_number() over (partition by k order by seq desc, sub desc) as n from legs) t where n = 1)
select * from base where k not in (select k from state) union all select k, event_type, value from state where not deleted""")
def merge_into_base(spark, sf_dir):
    """Merge-on-write without MERGE: anti-join and union."""
    base = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("event_type"), F.col("o_totalprice").alias("value"))
    changed = apply.last_writer_wins(legs_of(change_log(spark, sf_dir, True)), ["k"], ["seq", "sub"], ["event_type", "value"], tombstones=True)
    return apply.merge_into(base, changed, ["k"])


@query(ORACLES["lww_current_state"].replace("k, seq, sub, event_type", "k, event_type"))
def streamed_current_state(spark, sf_dir):
    """The same state by a stream: files in micro-batches into a versioned
    table, which must equal the batch result."""
    from driftline.streaming.apply_stream import run_available

    return run_available(spark, sf_dir)


@query(f"""with {LEGS},
runs as (select *, sum(case when is_partial then 0 else 1 end) over (partition by k order by seq, sub rows unbounded preceding) as gen from legs),
last as (select k, max(gen) as gen from runs group by k),
state as (select r.*, row_number() over (partition by r.k order by seq, sub) as first, row_number() over (partition by r.k order by seq desc, sub desc) as newest from runs r join last using (k, gen) where gen > 0)
select o.k, n.event_type, o.value from state o join state n on o.k = n.k and n.newest = 1 where o.first = 1 and not o.deleted""")
def streamed_partial_fold(spark, sf_dir):
    """A stream whose images lack values, folded into the stored rows."""
    from driftline.streaming.apply_stream import run_available

    return run_available(spark, sf_dir, partial=True)


@query(f"""with {LEGS}, base as (select cast(o_orderkey as bigint) as k, '' as seq, 0 as sub, false as deleted, o_orderstatus as event_type, o_totalprice as value, false as is_partial from orders),
every as (select * from base union all select k, seq, sub, deleted, event_type, value, is_partial from legs),
runs as (select *, sum(case when is_partial then 0 else 1 end) over (partition by k order by seq, sub rows unbounded preceding) as gen from every),
last as (select k, max(gen) as gen from runs group by k),
state as (select r.*, row_number() over (partition by r.k order by seq, sub) as first, row_number() over (partition by r.k order by seq desc, sub desc) as newest from runs r join last using (k, gen) where gen > 0)
select o.k, n.event_type, o.value from state o join state n on o.k = n.k and n.newest = 1 where o.first = 1 and not o.deleted""")
def restart_recovery(spark, sf_dir):
    """A snapshot, half of the log, a restart with nothing but the shared
    folder, and the other half; partial images are folded."""
    from driftline import pipeline
    from driftline.operators.state import ParquetStore
    from driftline.streaming.apply_stream import shared_root

    root = shared_root(spark, "restart")
    snapshot = lambda: table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("k"), F.col("o_orderstatus").alias("event_type"), F.col("o_totalprice").alias("value"))
    tables = [pipeline.Table(1, "k long, event_type string, value double", ("k",), snapshot)]
    changes = changelog.from_events(table(spark, sf_dir, "events"))
    none = {"ignoreNullFields": "false"}
    whole, part, old = F.struct(F.col("new_k").alias("k"), "event_type", "value"), F.struct(F.col("new_k").alias("k"), "event_type"), F.struct(F.col("old_k").alias("k"))
    new = F.when(F.col("op") != "D", F.when(F.col("is_partial"), F.to_json(part, none)).otherwise(F.to_json(whole, none)))
    moved = (F.col("op") == "D") | (F.col("old_k") != F.col("new_k"))
    events = changes.select("table_id", "op", F.col("commit_lsn").cast(lsn.LSN).alias("commit_lsn"), "tx_ordinal", new.alias("new"), F.when(moved, F.to_json(old)).alias("old"), "event_id")
    middle = events.agg(F.expr("max(event_id) div 2")).first()[0] or 0
    for half in (events.where(F.col("event_id") < middle), events.where(F.col("event_id") >= middle)):
        half.drop("event_id").write.mode("append").parquet(f"{root}/log")
        lake = pipeline.LakeDestination(spark, f"{root}/lake", tables, 16, partial=True)
        run = pipeline.Pipeline(spark, tables, lake, ParquetStore(spark, f"{root}/state"), f"{root}/checkpoint")
        stream = run.start(spark.readStream.schema(pipeline.LOG_SCHEMA).parquet(f"{root}/log"), availableNow=True)
        stream.awaitTermination()
        if stream.exception():
            raise stream.exception()
    return lake.current(1)


# Sink forms

@query(f"with {FULL} select new_k as k, case when op = 'D' then '' else event_type end as event_type, case when op = 'D' then null else value end as value, case op when 'I' then 'INSERT' when 'U' then 'UPDATE' else 'DELETE' end as cdc_operation, commit_lsn as cdc_lsn  from log")
def merge_tree_changelog(spark, sf_dir):
    changes = change_log(spark, sf_dir, True).withColumnRenamed("new_k", "k")
    return sinks.audit_log(changes, [("k", "bigint", False), ("event_type", "string", False), ("value", "double", True)], ["k"])


@query(f"with {FULL} select new_k as k, event_type as cdc_operation, value, case op when 'I' then 'INSERT' when 'U' then 'UPDATE' else 'DELETE' end as cdc_operation_1, seq as sequence_number  from log")
def iceberg_changelog(spark, sf_dir):
    """A user column has the name of an added one, which steps aside."""
    changes = change_log(spark, sf_dir, True).withColumnRenamed("new_k", "k").withColumn("cdc_operation", F.col("event_type"))
    return sinks.changelog(changes, ["k", "cdc_operation", "value"])


@query(f"with {FULL} select seq as offset_token, new_k as k, case when op = 'D' then null else event_type end as event_type, case op when 'I' then 'insert' when 'U' then 'update' else 'delete' end as op  from log")
def snowflake_json_rows(spark, sf_dir):
    """Fields read back from the JSON rows."""
    changes = change_log(spark, sf_dir, True).withColumnRenamed("new_k", "k")
    out = sinks.json_rows(changes, ["k", "event_type", "value"], ["k"])
    return out.select("offset_token", F.get_json_object("row", "$.k").cast("long").alias("k"), F.get_json_object("row", "$.event_type").alias("event_type"), F.get_json_object("row", "$._cdc_operation").alias("op"))


@query(f"with {FULL_LEGS} select k, event_type, case when deleted then 'DELETE' else 'UPSERT' end as _change_type, concat(seq, '/', lpad(lower(hex(sub)), 16, '0')) as _change_sequence_number from legs")
def upsert_stream(spark, sf_dir):
    return sinks.upsert_rows(legs_of(change_log(spark, sf_dir, True)), ["k", "event_type"])


# Log metrics and decoding of events

@query("select event_id, cast(row_number() over (partition by event_id // 4 order by event_id) - 1 as bigint) as tx_ordinal from events")
def tx_ordinals(spark, sf_dir):
    messages = table(spark, sf_dir, "events").select("event_id", F.expr("event_id div 4").alias("tx"))
    return log.tx_ordinals(messages, "tx", "event_id").select("event_id", "tx_ordinal")


@query(f"with {LOG} select commit_lsn, count(*) as events, min(tx_ordinal) as first_ordinal, max(tx_ordinal) as last_ordinal from log group by commit_lsn")
def tx_metrics(spark, sf_dir):
    return log.transaction_metrics(change_log(spark, sf_dir))


@query(f"with {LOG} select count(*) filter (op = 'I') as inserts, count(*) filter (op = 'U') as updates, count(*) filter (op = 'D') as deletes, count(*) filter (op = 'T') as truncates, count(*) filter (op = 'R') as relations, count(*) as events from log")
def event_mix(spark, sf_dir):
    return log.event_mix(change_log(spark, sf_dir))


@query(f"with {LOG} select op, count(*) as events, cast(sum(octet_length(encode(event_type)) + coalesce(octet_length(encode(props)), 0)) as bigint) as bytes from log group by op")
def payload_by_op(spark, sf_dir):
    sized = change_log(spark, sf_dir).withColumn("size", log.payload_bytes(["event_type", "props"]))
    return sized.groupBy("op").agg(F.count("*").alias("events"), F.sum("size").alias("bytes"))


@query("select event_id // 4 as xid, max(event_id) as final_lsn, max(event_id) + 1 as commit_lsn from events group by 1 having max(event_id) % 5 = 0")
def commit_mismatches(spark, sf_dir):
    ends = table(spark, sf_dir, "events").groupBy(F.expr("event_id div 4").alias("xid")).agg(F.max("event_id").alias("last"))
    begins = ends.select("xid", F.col("last").alias("final_lsn"))
    commits = ends.select("xid", (F.col("last") + F.when(F.col("last") % 5 == 0, 1).otherwise(0)).alias("commit_lsn"))
    return log.commit_mismatches(begins, commits)


@query("""select event_id, case when event_type = 'click' or event_type = 'view' then user_id else user_id end as user_id,
case when event_type = 'view' then null else props end as props, case when event_type = 'view' then 'partial' else 'full' end as new_kind, case when event_type = 'view' then 'props' else '' end as missing from events""")
def unchanged_values(spark, sf_dir):
    """Views and clicks leave ``props`` unsent; clicks have a full old image,
    views a key image, which can't give it back."""
    e = table(spark, sf_dir, "events")
    unsent = F.col("event_type").isin("view", "click")
    image = F.struct("user_id", F.when(~unsent, F.col("props")).alias("props"))
    events = e.select("event_id", image.alias("new"), F.struct("user_id", "props").alias("old"), F.when(F.col("event_type") == "click", "full").when(F.col("event_type") == "view", "key").alias("old_kind"), F.when(unsent, F.array(F.lit("props"))).otherwise(F.array().cast("array<string>")).alias("unchanged"))
    out = log.resolve_unchanged(events, ["user_id", "props"], ["user_id"])
    return out.select("event_id", "new.user_id", "new.props", "new_kind", F.array_join("missing", ",").alias("missing"))


@query("select event_id, cast(event_id as varchar) as a, event_type as b from events")
def key_tuples(spark, sf_dir):
    """Identity tuples that came dense or full width give the same keys."""
    e = table(spark, sf_dir, "events")
    a, b, x = F.col("event_id").cast("string"), F.col("event_type"), F.lit("x")
    tuples = e.select("event_id", F.when(F.col("event_id") % 2 == 0, F.array(a, b)).otherwise(F.array(a, x, b)).alias("t"))
    keys = tuples.select("event_id", log.dense_keys(F.col("t"), [0, 2], 3).alias("k"))
    return keys.select("event_id", F.col("k")[0].alias("a"), F.col("k")[1].alias("b"))


# Snapshot copies

@query("select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity > 25 and l_returnflag = 'R'")
def row_filter_copy(spark, sf_dir):
    """A publication's column list and row filter, both pushed to the scan."""
    return table(spark, sf_dir, "lineitem").where(F.expr("l_quantity > 25 and l_returnflag = 'R'")).select("l_orderkey", "l_linenumber", "l_quantity")


_LEAVES = [(1, 11, 100, 500), (1, 12, 10, 20), (1, 13, 0, 0), (2, 21, 40, 900_000), (2, 22, 60, None), (3, 31, 7, 7)]
_LEAVES_SQL = "leaves(root_id, table_id, blocks, rows) as (values (1, 11, 100, 500), (1, 12, 10, 20), (1, 13, 0, 0), (2, 21, 40, 900000), (2, 22, 60, null), (3, 31, 7, 7))"


@query(f"""with {_LEAVES_SQL}, live as (select *, min(case when rows > 0 then 1 else 0 end) over (partition by root_id) = 1 as counted from leaves where blocks > 0),
weighed as (select *, case when counted then rows else blocks end as weight from live),
planned as (select *, greatest(1, least(blocks, ceil(weight * 16 / sum(weight) over (partition by root_id)))) as partitions from weighed)
select cast(root_id as bigint) as root_id, cast(table_id as bigint) as table_id, cast(weight as bigint) as weight, cast(partitions as bigint) as partitions, cast(ceil(blocks / partitions) as bigint) as planned_blocks from planned""")
def copy_partitions(spark, sf_dir):
    leaves = rows(spark, "root_id long, table_id long, blocks long, rows long", _LEAVES)
    return copy_plan.plan_copies(leaves, copy_plan.target_ranges(4, 920_000))


@query(f"""with {_LEAVES_SQL}, n as (select table_id, blocks, least(4, blocks) as parts from leaves where blocks > 0), r as (select table_id, blocks, parts, unnest(range(parts)) as range_no from n)
select cast(table_id as bigint) as table_id, cast(range_no as bigint) as range_no, cast(range_no * blocks // parts as bigint) as start_block, cast((range_no + 1) * blocks // parts as bigint) as end_block from r""")
def block_ranges(spark, sf_dir):
    leaves = rows(spark, "root_id long, table_id long, blocks long, rows long", _LEAVES)
    plan = leaves.where("blocks > 0").withColumn("partitions", F.least(F.lit(4).cast("long"), F.col("blocks")))
    return copy_plan.expand_ranges(plan.drop("blocks"), leaves)


@query("select cast(least(3, o_orderkey // 4000) as integer) as partition, count(*) as n, cast(sum(o_orderkey) as bigint) as keys from orders group by 1")
def ctid_range_union_equals_full(spark, sf_dir):
    """Open-ended ranges together read every row once."""
    bounds = [(None, 4000), (4000, 8000), (8000, 12000), (12000, None)]
    orders = copy_text.union_ranges(table(spark, sf_dir, "orders"), "o_orderkey", bounds)
    return orders.groupBy("partition").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query(f"""with {LOG}, states(table_id, state, lsn) as (values (0, 'ready', null), (1, 'sync_done', 20000), (2, 'data_sync', null), (3, 'sync_done', 90000000))
select event_id from (select *, event_id % 5 as t from log) l join states s on l.t = s.table_id where state = 'ready' or (state = 'sync_done' and lsn <= commit_lsn)""")
def ownership_gate(spark, sf_dir):
    states = rows(spark, "table_id long, state string, lsn long", [(0, "ready", None), (1, "sync_done", 20000), (2, "data_sync", None), (3, "sync_done", 90_000_000)])
    changes = change_log(spark, sf_dir).withColumn("table_id", F.col("event_id") % 5)
    return apply.owned(changes, F.broadcast(states)).select("event_id")


# Schemas

_VERSIONS = [(t, s) for t in range(5) for s in (0, 5000 * (t + 1), 60_000 + t)]
_VERSIONS_SQL = "versions(table_id, snapshot_id) as (values " + ", ".join(map(str, _VERSIONS)) + ")"


@query(f"with {LOG}, {_VERSIONS_SQL} select event_id, cast((select max(v.snapshot_id) from versions v where v.table_id = l.event_id % 5 and v.snapshot_id <= l.commit_lsn) as bigint) as snapshot_id from log l")
def schema_as_of(spark, sf_dir):
    versions = rows(spark, "table_id long, snapshot_id long", _VERSIONS)
    changes = change_log(spark, sf_dir).select("event_id", (F.col("event_id") % 5).alias("table_id"), "commit_lsn")
    return schema.as_of_broadcast(changes, versions).select("event_id", "snapshot_id")


@query(ORACLES["schema_as_of"])
def schema_as_of_sorted(spark, sf_dir):
    """The same by one sorted pass, for versions of any number."""
    versions = rows(spark, "table_id long, snapshot_id long", _VERSIONS)
    changes = change_log(spark, sf_dir).select("event_id", (F.col("event_id") % 5).alias("table_id"), "commit_lsn")
    return schema.as_of(changes, versions).select("event_id", "snapshot_id")


_OLD = [(1, "id", False, None), (2, "name", False, None), (3, "status", True, "'a'"), (5, "age", True, None)]
_NEW = [(1, "id", False, None), (2, "full_name", False, None), (4, "status", True, None), (5, "age", False, None), (6, "email", True, None)]


def _sql(data: list[tuple]) -> str:
    one = lambda x: "null" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return "(values " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in data) + ")"


@query(f"""with a(ordinal, name, nullable, d) as {_sql(_OLD)}, b(ordinal, name, nullable, d) as {_sql(_NEW)}
select coalesce(a.ordinal, b.ordinal) as ordinal, case when a.ordinal is null then 'added' when b.ordinal is null then 'removed' else 'changed' end as change, a.name as old_name, b.name as new_name
from a full join b on a.ordinal = b.ordinal where a.ordinal is null or b.ordinal is null or a.name <> b.name or a.nullable <> b.nullable or a.d is distinct from b.d""")
def schema_diff(spark, sf_dir):
    ddl = "ordinal int, name string, nullable boolean, default_expression string"
    return schema.diff_frames(rows(spark, ddl, _OLD), rows(spark, ddl, _NEW))


_BOUNDS = [(0, 5200), (1, 4), (2, 70_000)]


@query(f"with {_VERSIONS_SQL}, bounds(table_id, retain_lsn) as {_sql(_BOUNDS)}, base as (select table_id, max(snapshot_id) as base from versions join bounds using (table_id) where snapshot_id <= retain_lsn group by table_id) select cast(table_id as bigint) as table_id, cast(snapshot_id as bigint) as snapshot_id from versions left join base using (table_id) where base is null or snapshot_id >= base")
def schema_prune(spark, sf_dir):
    return schema.prune_versions(rows(spark, "table_id long, snapshot_id long", _VERSIONS), rows(spark, "table_id long, retain_lsn long", _BOUNDS))


@query("select o_orderkey, cast(null as varchar) as email, o_orderstatus as state from orders")
def schema_evolution(spark, sf_dir):
    """Rows of an old version seen through a new one: a rename, an added
    column, and a dropped one, by ordinal."""
    old = (schema.Column("o_orderkey", "int8", 1, 0, False), schema.Column("o_orderstatus", "text", 2), schema.Column("o_totalprice", "float8", 3))
    new = (schema.Column("o_orderkey", "int8", 1, 0, False), schema.Column("state", "text", 2), schema.Column("email", "text", 4))
    return schema.as_version(schema.stored(table(spark, sf_dir, "orders"), old), new, {"int8": "bigint", "text": "string", "float8": "double"})


# State

_HISTORY = [(1, 1, "init"), (2, 1, "data_sync"), (3, 2, "init"), (4, 1, "errored"), (5, 3, "init"), (6, 3, "ready")]


@query(f"with h(id, table_id, state) as {_sql(_HISTORY)} select table_id, state, id from (select *, row_number() over (partition by table_id order by id desc) as n from h) t where n = 2")
def state_rollback(spark, sf_dir):
    return state.rolled_back(rows(spark, "id int, table_id int, state string", _HISTORY))


@query(f"with h(id, table_id, state) as {_sql(_HISTORY)} select state, count(*) as tables from (select *, row_number() over (partition by table_id order by id desc) as n from h) t where n = 1 group by state")
def state_gauge(spark, sf_dir):
    return state.state_counts(state.current_states(rows(spark, "id int, table_id int, state string", _HISTORY)))


@query(f"with {LOG} select user_id, max(commit_lsn) as flush_lsn from log group by user_id")
def progress_upsert(spark, sf_dir):
    changes = change_log(spark, sf_dir).select("user_id", F.col("commit_lsn").alias("flush_lsn"))
    half = F.col("flush_lsn") % 512 == 0
    return state.advance_progress(changes.where(half), changes.where(~half), ["user_id"])


@query("with s(slot_name, pid, restart_lsn, confirmed) as (values ('a', 1, 100, 150), ('b', null, 900, 950)), w(pid, write_lag_ms, flush_lag_ms) as (values (1, 5, 7)) select slot_name, cast(greatest(800 - restart_lsn, 0) as decimal(21,0)) as restart_bytes, cast(greatest(800 - confirmed, 0) as decimal(21,0)) as flush_bytes, write_lag_ms, flush_lag_ms from s left join w using (pid)")
def slot_lag(spark, sf_dir):
    slots = rows(spark, "slot_name string, pid int, restart_lsn long, confirmed_flush_lsn long", [("a", 1, 100, 150), ("b", None, 900, 950)])
    for c in ("restart_lsn", "confirmed_flush_lsn"):
        slots = slots.withColumn(c, F.col(c).cast(lsn.LSN))
    wal = spark.range(1).select(F.lit(800).cast(lsn.LSN).alias("current_lsn"))
    return state.slot_lag(slots, rows(spark, "pid int, write_lag_ms int, flush_lag_ms int", [(1, 5, 7)]), wal)


@query(f"with {LOG}, g as (select commit_lsn as received, max(case when event_id % 16 = 0 then commit_lsn else 0 end) over (order by seq rows unbounded preceding) as flushed, event_id from log) select event_id, cast(greatest(received - flushed, 0) as decimal(21,0)) as flush_lag, cast(greatest(500000 - received, 0) as decimal(21,0)) as received_lag from g")
def lag_gauges(spark, sf_dir):
    """Running high-water mark of what is flushed against what has come in."""
    flushed = F.when(F.col("event_id") % 16 == 0, F.col("commit_lsn")).otherwise(0)
    changes = apply.last_known(change_log(spark, sf_dir), "table_id", ["seq"], flushed, "flushed", apply.sequence_position(F.col("seq")), largest=True)
    received, durable = F.col("commit_lsn").cast(lsn.LSN), F.col("flushed").cast(lsn.LSN)
    gauges = state.lag_gauges(received, durable, durable, F.lit(500000).cast(lsn.LSN))
    return changes.select("event_id", gauges["flush_lag"].alias("flush_lag"), gauges["received_lag"].alias("received_lag"))


@query("select range as attempt, cast(least(30000, 500 * power(2, range)) as bigint) as wait_ms from range(10)")
def retry_backoff(spark, sf_dir):
    return spark.range(10).select(F.col("id").alias("attempt"), state.backoff_ms(F.col("id"), 500, 30_000).alias("wait_ms"))


# Maintenance

@query("""with files as (select l_suppkey % 7 as table_id, l_orderkey // 1000 as file, count(*) as rows, count(*) * 9000 as file_bytes from lineitem group by 1, 2),
m as (select table_id, count(*) as files, cast(sum(file_bytes) as bigint) as bytes, cast(sum(case when file_bytes < 5242880 then 1 else 0 end) as bigint) as small_files, cast(sum(rows) as bigint) as rows from files group by 1)
select table_id, files, bytes, small_files, rows, cast(0 as bigint) as deleted_rows, bytes / files as average_file_bytes, small_files / files as small_file_ratio, cast(0 as double) as deleted_row_ratio, files > 1 and (small_files > 0 or bytes / files < 10000000) as merge, files > 40 as rewrite from m""")
def storage_metrics(spark, sf_dir):
    """Order ranges by supplier stand for files and tables."""
    files = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 7).alias("table_id"), F.expr("l_orderkey div 1000").alias("file")).agg(F.count("*").alias("rows"), (F.count("*") * 9000).alias("file_bytes"))
    return maintenance.storage_metrics(files).withColumns({"merge": maintenance.should_merge(10_000_000), "rewrite": maintenance.should_rewrite()})


@query(f"with {LOG}, p as (select cast(user_id % 20 as varchar) as table_name, event_id // 5000 as replay_epoch, commit_lsn, tx_ordinal from log) select table_name, replay_epoch, commit_lsn, tx_ordinal, seen from (select *, row_number() over (partition by table_name order by replay_epoch desc, commit_lsn desc, tx_ordinal desc) as n, count(*) over (partition by table_name) as seen from p) t where n = 1")
def progress_compaction(spark, sf_dir):
    progress = change_log(spark, sf_dir).select((F.col("user_id") % 20).cast("string").alias("table_name"), F.expr("event_id div 5000").alias("replay_epoch"), "commit_lsn", "tx_ordinal")
    return maintenance.compact_progress(progress)


# Decoding

@query("select o_orderkey, o_orderkey % 2 = 0 as v from orders")
def decode_bool(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", decode.bool_text(F.when(F.col("o_orderkey") % 2 == 0, "t").otherwise("f")).alias("v"))


@query("select o_orderkey, o_orderpriority as v, lower(hex(o_orderpriority)) as hex from orders")
def decode_bytea(spark, sf_dir):
    wire = F.concat(F.lit("\\x"), F.hex(F.encode("o_orderpriority", "UTF-8")))
    value = decode.bytea_hex(wire)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.decode(value, "UTF-8").alias("v"), values.hex_text(value).alias("hex"))


@query("select o_orderkey, cast(o_orderdate as date) as v, datediff('day', date '1970-01-01', cast(o_orderdate as date)) as days from orders")
def decode_date(spark, sf_dir):
    value = decode.date_text(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", value.alias("v"), values.date32_days(value).cast("long").alias("days"))


@query("select event_id, ts as v from events")
def decode_timestamp(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", decode.timestamp_text(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("v"))


@query("select event_id, epoch_us(ts - to_hours(5) - to_minutes(30)) as us from events")
def decode_timestamptz(spark, sf_dir):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+05:30"))
    return table(spark, sf_dir, "events").select("event_id", F.unix_micros(decode.timestamptz_text(text)).alias("us"))


@query("select event_id, cast(epoch_us(ts) % 86400000000 as bigint) as us, strftime(ts, '%H:%M:%S') || '-03:30' as zoned from events")
def decode_time(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", decode.time_micros(F.date_format("ts", "HH:mm:ss.SSSSSS")).alias("us"), decode.timetz_text(F.concat(F.date_format("ts", "HH:mm:ss"), F.lit("-0330"))).alias("zoned"))


@query("select c_custkey, cast(c_acctbal as decimal(12,2)) as v, cast(cast(c_acctbal as decimal(12,2)) as varchar) as shown from customer")
def decode_numeric(spark, sf_dir):
    text = F.col("c_acctbal").cast("decimal(12,2)").cast("string")
    return table(spark, sf_dir, "customer").select("c_custkey", decode.numeric_text(text, 12, 2).alias("v"), decode.numeric_canonical(text).alias("shown"))


@query("select vec_id, len(embedding) as n, embedding[1] as first, embedding[-1] as last from embeddings where embedding is not null")
def decode_arrays(spark, sf_dir):
    """Vectors written as array literals and read back in the JVM."""
    e = table(spark, sf_dir, "embeddings").where("embedding is not null")
    text = F.concat(F.lit("{"), F.array_join(F.transform("embedding", lambda x: x.cast("string")), ",", "NULL"), F.lit("}"))
    v = decode.array_text_simple(text, "float")
    return e.select("vec_id", F.size(v).cast("long").alias("n"), F.element_at(v, 1).alias("first"), F.element_at(v, -1).alias("last"))


@query("select event_id, event_type || ' \"q\" \\' as v, 3 as n from events")
def decode_quoted_arrays(spark, sf_dir):
    """Elements with quotes and backslashes, beside a NULL and "NULL"."""
    e = table(spark, sf_dir, "events")
    text = F.concat(F.lit('{"'), F.col("event_type"), F.lit(' \\"q\\" \\\\",NULL,"NULL"}'))
    v = decode.array_text(text)
    return e.select("event_id", v[0].alias("v"), F.size(v).alias("n"))


@query("select doc_id, text as v from documents")
def copy_unescape(spark, sf_dir):
    """Texts written as COPY fields and decoded again."""
    d = table(spark, sf_dir, "documents")
    wire = F.coalesce(decode.copy_escape(F.col("text")), F.lit("\\N"))
    return copy_text.decode_copy(d.select(F.concat_ws("\t", F.col("doc_id").cast("string"), wire).alias("value")), [("doc_id", "int8"), ("v", "text")])


@query("select event_id, user_id, event_type as kind, value from events")
def copy_rows(spark, sf_dir):
    """Whole COPY lines, typed by their columns."""
    e = table(spark, sf_dir, "events")
    line = F.concat_ws("\t", F.col("event_id").cast("string"), F.col("user_id").cast("string"), decode.copy_escape(F.col("event_type")), decode.copy_escape(F.col("value").cast("string")))
    return copy_text.decode_copy(e.select(line.alias("value")), [("event_id", "int8"), ("user_id", "int8"), ("kind", "text"), ("value", "float8")])


@query("select n_nationkey, replace('pub_' || lower(n_name) || '_x', '_', '__') || '_' || replace('t_' || lower(n_name) || 's', '_', '__') as name, case when starts_with(ns, 'aws') then 's_' || ns else ns end as namespace from (select *, regexp_replace(lower('AWS-' || n_name), '[^a-z0-9_]', '_', 'g') as ns from nation) t")
def name_encode(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    low = F.lower("n_name")
    return n.select("n_nationkey", names.destination_name(F.concat(F.lit("pub_"), low, F.lit("_x")), F.concat(F.lit("t_"), low, F.lit("s"))).alias("name"), names.namespace(F.concat(F.lit("AWS-"), F.col("n_name"))).alias("namespace"))


@query(f"with {LOG} select event_id, upper(printf('%x', commit_lsn // 4294967296)) || '/' || upper(printf('%x', commit_lsn % 4294967296)) as text, commit_lsn as back from log")
def lsn_text(spark, sf_dir):
    shown = lsn.lsn_text(F.col("commit_lsn"))
    return change_log(spark, sf_dir).select("event_id", shown.alias("text"), lsn.parse_lsn(shown).cast("long").alias("back"))


# Validation and benchmarks

@query("select c_nationkey, count(*) as n, cast(sum(case when c_acctbal < 0 then 1 else 0 end) as bigint) as negative, coalesce(bool_and(c_name is not null), false) as all_named from customer group by c_nationkey")
def rejects_by_group(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("negative"), F.coalesce(F.bool_and(F.col("c_name").isNotNull()), F.lit(False)).alias("all_named"))


@query("select l_returnflag, l_linestatus, median(l_quantity) as median, min(l_quantity) as least, max(l_quantity) as most from lineitem group by 1, 2")
def sample_summary(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.percentile("l_quantity", F.lit(0.5)).alias("median"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"))


from driftline import control_queries  # noqa: E402, F401  registers its own
