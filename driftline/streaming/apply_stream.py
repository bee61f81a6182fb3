"""Continuous apply: a log stream into a bucketed current-state table.

Each micro-batch is combined with the buckets whose keys it has, and these are
published together with the batch number and watermark, so a batch that is
delivered again after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators import apply, log
from driftline.operators.sinks import BucketedTable


class StreamingApply:
    """``foreachBatch`` target. ``prepare`` turns a batch of the source into
    legs ``(keys, seq, sub, deleted, values)``, and with ``partial`` an array
    ``absent`` of the value names that a leg's image lacks: these keep what the
    stored row has. Partial images must come in order; a leg that is older than
    its key's row changes nothing."""

    def __init__(self, target: BucketedTable, values: Sequence[str], prepare: Callable[[DataFrame], DataFrame], partial: bool = False):
        self.target, self.keys, self.values, self.prepare, self.partial = target, target.keys, list(values), prepare, partial
        self.columns = [*self.keys, "seq", "sub", "deleted", *self.values]

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        live = self.target.head()
        if live is not None and live.batch_id is not None and live.batch_id >= batch_id:
            return  # delivered before
        legs = self.prepare(batch).select(*self.columns, *(["absent"] if self.partial else [])).persist()
        try:
            touched = self.target.touched(legs)
            #: Tombstones stay in the store, so that a late older event can't revive a key.
            every = self.target.read(touched).select(*self.columns).unionByName(legs, allowMissingColumns=True)
            if self.partial:
                full = F.col("deleted") | (F.coalesce(F.size("absent"), F.lit(0)) <= 0)
                rows = apply.fold(every, self.keys, ["seq", "sub"], self.values, {v: ~F.array_contains("absent", v) for v in self.values}, full, tombstones=True)
            else:
                rows = apply.last_writer_wins(every, self.keys, ["seq", "sub"], self.values, tombstones=True)
            last = legs.agg(F.max("seq")).first()[0]
            self.target.publish(rows.select(*self.columns), touched, batch_id, last)
        finally:
            legs.unpersist()
        self.target.drop_unreferenced()

    def purge(self, below: str) -> int:
        """Forget keys deleted before the sequence ``below``, once no event of
        before can come again. Gives the number of buckets rewritten."""
        gone = F.col("deleted") & (F.col("seq") < below)
        touched = self.target.touched(self.target.read().where(gone))
        if touched:
            live = self.target.head()
            self.target.publish(self.target.read(touched).where(~gone), touched, live.batch_id, live.applied)
        return len(touched)

    def current(self) -> DataFrame:
        return self.target.read().where(~F.col("deleted")).select(*self.keys, *self.values)


def start(stream: DataFrame, target: StreamingApply, checkpoint: str, **trigger):
    """Start the query; with ``availableNow=True`` it ends by itself."""
    return stream.writeStream.foreachBatch(target).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "10 seconds"})).start()


#: The stored state of :func:`events_to_legs`.
EVENT_STATE = "k long, seq string, sub int, deleted boolean, event_type string, value double"


def events_to_legs(batch: DataFrame) -> DataFrame:
    from driftline.functions.lsn import sequence_key
    from driftline.sources.changelog import complete, from_events

    changes = complete(from_events(batch)).withColumn("seq", sequence_key(F.col("commit_lsn"), F.col("tx_ordinal")))
    return log.split_key_changes(changes, ["old_k"], ["new_k"], ["event_type", "value"], ["seq"], ["k"])


def events_to_partial_legs(batch: DataFrame) -> DataFrame:
    """Views as they come, without their value."""
    from driftline.functions.lsn import sequence_key
    from driftline.sources.changelog import from_events

    absent = F.when(F.col("is_partial"), F.array(F.lit("value"))).otherwise(F.array().cast("array<string>"))
    changes = from_events(batch).withColumns({"seq": sequence_key(F.col("commit_lsn"), F.col("tx_ordinal")), "absent": absent})
    return log.split_key_changes(changes, ["old_k"], ["new_k"], ["event_type", "value", "absent"], ["seq"], ["k"])


def shared_root(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share; a temporary one only for
    local sessions that name none."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(base or tempfile.mkdtemp(prefix='driftline-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def run_available(spark: SparkSession, sf_dir: str, partial: bool = False) -> DataFrame:
    """All events there are, through a stream, as current state."""
    root = shared_root(spark, "stream")
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    stream = reader.parquet(path) if _is_folder(spark, path) else reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    target = StreamingApply(BucketedTable(spark, f"{root}/table", ["k"], EVENT_STATE, 8), ["event_type", "value"], events_to_partial_legs if partial else events_to_legs, partial)
    query = start(stream, target, f"{root}/checkpoint", availableNow=True)
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return target.current()


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
