"""Maintenance of stored tables: metrics, eligibility, compaction, expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SMALL_FILE = 5 * 1024 * 1024
REWRITE_FILES = 40
FLUSH_BYTES = 10 * 1000 * 1000
COOLDOWN_SECONDS = 300
LONGEST_PAUSE_SECONDS = 2700
OPERATIONS = ("flush", "merge", "rewrite", "expire", "cleanup")


def ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 where b is: both negative noise and empty tables occur."""
    return F.when(b > 0, F.greatest(a, F.lit(0)) / b).otherwise(F.lit(0.0))


def storage_metrics(files: DataFrame, deletes: DataFrame | None = None) -> DataFrame:
    """Per table: files, bytes, small files, rows, deleted rows and ratios.
    ``files(table_id, file_bytes, rows)``, ``deletes(table_id, rows)``."""
    data = files.groupBy("table_id").agg(F.count("*").alias("files"), F.sum("file_bytes").alias("bytes"), F.sum((F.col("file_bytes") < SMALL_FILE).cast("long")).alias("small_files"), F.sum("rows").alias("rows"))
    gone = (deletes.groupBy("table_id").agg(F.sum("rows").alias("deleted_rows")) if deletes is not None else files.select("table_id", F.lit(0).cast("long").alias("deleted_rows")).distinct())
    out = data.join(gone, "table_id", "left").withColumn("deleted_rows", F.coalesce("deleted_rows", F.lit(0)))
    return out.withColumns({"average_file_bytes": ratio(F.col("bytes"), F.col("files")), "small_file_ratio": ratio(F.col("small_files"), F.col("files")), "deleted_row_ratio": ratio(F.col("deleted_rows"), F.col("rows"))})


def should_merge(target_bytes: int) -> Column:
    return (F.col("files") > 1) & ((F.col("small_files") > 0) | (F.col("average_file_bytes") < target_bytes))


def should_rewrite(limit: int = REWRITE_FILES) -> Column:
    return F.col("files") > limit


def should_flush(pending: Column, limit: int = FLUSH_BYTES) -> Column:
    return pending >= limit


def select_tables(metrics: DataFrame, eligible: Column, most: int) -> DataFrame:
    """At most so many eligible tables of one run, by id."""
    return metrics.where(eligible).orderBy("table_id").limit(most)


def expired(versions: DataFrame, now: Column, keep: str = "INTERVAL 7 DAYS") -> DataFrame:
    """Versions older than the interval but the newest of each table."""
    newest = F.max("version").over(Window.partitionBy("table_id"))
    return versions.withColumn("_newest", newest).where((F.col("created") < now - F.expr(keep)) & (F.col("version") < F.col("_newest"))).drop("_newest")


def unreferenced(files: DataFrame, manifests: DataFrame, now: Column, grace: str = "INTERVAL 1 HOUR") -> DataFrame:
    """Files that no manifest names and that are past the grace time."""
    return files.join(manifests.select("path").distinct(), "path", "left_anti").where(F.col("created") < now - F.expr(grace))


def catalog_metrics(snapshots: DataFrame, scheduled: DataFrame, now_ms: int) -> DataFrame:
    """Snapshots and scheduled deletions in one row, with the oldest's age."""
    from driftline.functions.values import epoch_age_seconds

    a = snapshots.agg(F.count("*").alias("snapshots"), F.min("created_ms").alias("_oldest"))
    b = scheduled.agg(F.count("*").alias("scheduled_files"), F.coalesce(F.sum("file_bytes"), F.lit(0)).alias("scheduled_bytes"))
    return a.crossJoin(b).select("snapshots", epoch_age_seconds(F.lit(now_ms), F.col("_oldest")).alias("oldest_snapshot_seconds"), "scheduled_files", "scheduled_bytes")


def compact_progress(progress: DataFrame) -> DataFrame:
    """One watermark of the current epoch for each table: the rows to keep."""
    best = F.max_by(F.struct("replay_epoch", "commit_lsn", "tx_ordinal"), F.struct("replay_epoch", "commit_lsn", "tx_ordinal")).alias("last")
    return progress.groupBy("table_name").agg(best, F.count("*").alias("seen")).select("table_name", "last.*", "seen")


def stale_markers(markers: DataFrame, states: DataFrame) -> DataFrame:
    """Applied-batch markers to delete: all once streaming has begun, all but
    the copy-complete one once the copy is, else those of older epochs."""
    s = states.select("table_name", "streaming", "copy_complete", F.col("replay_epoch").alias("_epoch"))
    gone = F.when(F.col("streaming"), True).when(F.col("copy_complete"), F.col("kind") != "copy_complete").otherwise(F.col("replay_epoch") < F.col("_epoch"))
    return markers.join(s, "table_name").where(gone).select(*markers.columns)


def covers(have: str, want: str) -> Column:
    """Whether one request's operations include another's (bit flags)."""
    return F.col(have).bitwiseAND(F.col(want)) == F.col(want)


def request_outcome(active: Column, cooling: Column, covered: Column, pending: Column) -> Column:
    """What a maintenance request comes to."""
    return F.when(active, "active_run").when(cooling, "cooldown").when(covered, "covered").when(pending, "merged").otherwise("created")


def compact(spark: SparkSession, path: str, out: str, target_bytes: int, total_bytes: int) -> None:
    """Rewrite a table's files at about the target size; rows stay."""
    n = max(1, -(-total_bytes // target_bytes))
    rows = spark.read.parquet(path)
    (rows.coalesce(n) if rows.rdd.getNumPartitions() > n else rows.repartition(n)).write.mode("overwrite").parquet(out)


def pause_until(requested: Column, now: Column, most: int = LONGEST_PAUSE_SECONDS) -> Column:
    """End of a pause that an external maintenance asks for: at most so many
    seconds from now, and none that has passed."""
    return F.greatest(now, F.least(requested, now + most))


#: Steps of a run, in order.
RUN_ORDER = ("replay_cleanup", "flush", "merge", "rewrite", "expire", "cleanup")


def plan_run(metrics: DataFrame, pending: DataFrame, markers: DataFrame, target_bytes: int, most: int = 100) -> DataFrame:
    """``step, operation, table_id`` of one maintenance run, in order: clean up
    replay helpers where there are stale ones, flush what has gathered, merge
    and rewrite eligible tables (at most so many of each), and expire versions
    and delete files of every table."""
    tables = metrics.select("table_id")
    eligible = {
        "replay_cleanup": markers.select("table_id").distinct(),
        "flush": pending.groupBy("table_id").agg(F.sum("bytes").alias("bytes")).where(should_flush(F.col("bytes"))).select("table_id"),
        "merge": select_tables(metrics, should_merge(target_bytes), most).select("table_id"),
        "rewrite": select_tables(metrics, should_rewrite(), most).select("table_id"),
        "expire": tables,
        "cleanup": tables,
    }
    out = None
    for i, name in enumerate(RUN_ORDER):
        step = eligible[name].select(F.lit(i).alias("step"), F.lit(name).alias("operation"), "table_id")
        out = step if out is None else out.unionByName(step)
    return out


def run_once(plan: DataFrame, work: dict) -> list[tuple[str, int]]:
    """Run a plan's steps in order, each through ``work[operation](table_id)``;
    gives what was done. A plan has a few rows for each table."""
    rows = plan.orderBy("step", "table_id").collect()
    for r in rows:
        work[r.operation](r.table_id)
    return [(r.operation, r.table_id) for r in rows]


def flush_deltas(base: DataFrame, deltas: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """A table with its small delta rows folded in: what an inline flush
    writes. Both have ``deleted`` and the order columns."""
    from driftline.operators.apply import last_writer_wins

    columns = [*keys, *order, "deleted", *values]
    return last_writer_wins(base.select(*columns).unionByName(deltas.select(*columns)), keys, order, values)
