"""A whole replication: first copies, hand-off, and continuous apply.

The log has one schema for all tables: ``table_id, op, commit_lsn, tx_ordinal,
new, old``, both images as JSON objects by column name. Each table is decoded
with its own columns when a batch is applied.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.lsn import sequence_key
from driftline.operators import apply, log
from driftline.operators.sinks import BucketedTable, strict_parsed_op
from driftline.operators.state import Destination, MemoryStore, next_state
from driftline.streaming.apply_stream import start

LOG_SCHEMA = "table_id long, op string, commit_lsn decimal(20,0), tx_ordinal long, new string, old string"


@dataclass(frozen=True)
class Table:
    """A published table: its columns as a DDL list, its key, and its snapshot,
    read at ``snapshot_lsn``."""

    table_id: int
    columns: str
    keys: tuple[str, ...]
    snapshot: Callable[[], DataFrame]
    snapshot_lsn: int = 0


class LakeDestination(Destination):
    """Current state of each table in hash buckets below one folder.

    Snapshot rows carry the lowest sequence, so any change wins. A truncate
    leaves what comes after it. Updates that move a row delete its old key.
    A partial image raises, or with ``partial`` keeps the stored values of the
    columns it lacks; one that moves its row raises in any case. A copy that
    starts anew opens a table's next generation, which is noted in the folder,
    so that a restart goes on with it. A key takes what is at its highest
    position, so an event that comes twice changes nothing.
    """

    idempotent = True

    def __init__(self, spark: SparkSession, root: str, tables: Sequence[Table], buckets: int = 64, parallel: int = 4, partial: bool = False):
        self.spark, self.root, self.buckets, self.parallel, self.partial = spark, root.rstrip("/"), buckets, parallel, partial
        self.tables = {t.table_id: t for t in tables}
        try:
            noted = spark.read.schema("table_id long, generation long").parquet(f"{self.root}/generations")
            self._generation: dict[int, int] = {r.table_id: r.g for r in noted.groupBy("table_id").agg(F.max("generation").alias("g")).collect()}
        except AnalysisException:
            self._generation = {}

    def _values(self, t: Table) -> list[str]:
        return [c for c in self._row(t).columns if c not in t.keys]

    def _row(self, t: Table) -> DataFrame:
        return self.spark.createDataFrame([], t.columns)

    def store(self, table_id: int) -> BucketedTable:
        t = self.tables[table_id]
        meta = "_seq string, _sub int, _deleted boolean"
        return BucketedTable(self.spark, f"{self.root}/t{table_id}-{self._generation.get(table_id, 0)}", list(t.keys), f"{t.columns}, {meta}", self.buckets)

    def drop_table_for_copy(self, table_id: int) -> None:
        """What was written before is no longer read; a copy starts anew."""
        if self.store(table_id).head() is not None:
            self._generation[table_id] = self._generation.get(table_id, 0) + 1
            note = self.spark.createDataFrame([(table_id, self._generation[table_id])], "table_id long, generation long")
            note.coalesce(1).write.mode("append").parquet(f"{self.root}/generations")

    def write_table_rows(self, table_id: int, rows: DataFrame) -> None:
        store = self.store(table_id)
        zero = sequence_key(F.lit(0), F.lit(0))
        legs = rows.select("*", zero.alias("_seq"), F.lit(0).alias("_sub"), F.lit(False).alias("_deleted"))
        store.publish(legs, range(self.buckets))

    def write_events(self, events: DataFrame, batch_id: int) -> None:
        found = [r.table_id for r in events.select("table_id").distinct().collect() if r.table_id in self.tables]  # as many as tables
        with ThreadPoolExecutor(self.parallel) as pool:
            list(pool.map(lambda t: self._apply(events.where(F.col("table_id") == t), t, batch_id), found))

    def _apply(self, events: DataFrame, table_id: int, batch_id: int) -> None:
        t, store = self.tables[table_id], self.store(table_id)
        live = store.head()
        if live is not None and live.batch_id is not None and live.batch_id >= batch_id:
            return
        keys, values = list(t.keys), self._values(t)
        position = sequence_key(F.col("commit_lsn"), F.col("tx_ordinal")).alias("_seq")
        images = events.where(F.col("op").isin(*log.ROW_OPS)).select("op", position, "new", "old", F.from_json("new", t.columns).alias("n"), F.from_json("old", t.columns).alias("o"))
        op = strict_parsed_op(keys if self.partial else self._row(t).columns, keys, "n", "o")
        #: Only an image with a null may lack a name.
        named, none = F.coalesce(F.json_object_keys("new"), F.array().cast("array<string>")), F.array().cast("array<string>")
        complete = F.least(*[F.col(f"n.{v}").isNotNull() for v in values], F.lit(True))
        absent = F.when(F.col("op") != "D", F.when(complete, none).otherwise(F.array_except(F.array(*map(F.lit, values)).cast("array<string>"), named)))
        flat = images.select(op.alias("op"), "_seq", absent.alias("_absent"), *[F.coalesce(F.col(f"o.{k}"), F.col(f"n.{k}")).alias(f"_old_{k}") for k in keys], *[F.coalesce(F.col(f"n.{k}"), F.col(f"o.{k}")).alias(k) for k in keys], *[F.col(f"n.{v}").alias(v) for v in values])
        legs = log.split_key_changes(flat, [f"_old_{k}" for k in keys], keys, [*values, "_absent"], ["_seq"]).withColumnsRenamed({"sub": "_sub", "deleted": "_deleted"})
        lost = (F.size("_absent") > 0) & (F.col("_sub") == 1)
        legs = legs.where(F.when(lost, F.raise_error(F.lit("partial image: it moves its row and lacks values"))).otherwise(F.lit(True)))
        legs = legs.persist()
        try:
            cut = events.where("op = 'T'").agg(F.max(sequence_key(F.col("commit_lsn"), F.col("tx_ordinal")))).first()[0]
            touched = list(range(self.buckets)) if cut else store.touched(legs)
            every = store.read(touched)
            every = every.unionByName(legs, allowMissingColumns=True)
            if cut:
                every = every.where(F.col("_seq") > cut)
            every = every.withColumnRenamed("_deleted", "deleted")
            if self.partial:
                full = F.col("deleted") | (F.coalesce(F.size("_absent"), F.lit(0)) <= 0)
                state = apply.fold(every, keys, ["_seq", "_sub"], values, {v: ~F.array_contains("_absent", v) for v in values}, full, tombstones=True)
            else:
                state = apply.last_writer_wins(every, keys, ["_seq", "_sub"], values, tombstones=True)
            state = state.withColumnRenamed("deleted", "_deleted")
            store.publish(state.select(*store.read([]).columns), touched, batch_id, cut)
        finally:
            legs.unpersist()
        store.drop_unreferenced()

    def current(self, table_id: int) -> DataFrame:
        return self.store(table_id).read().where("not _deleted").select(*self._row(self.tables[table_id]).columns)


class Pipeline:
    """Copies what hasn't been copied, then applies the log from each table's
    snapshot position on."""

    def __init__(self, spark: SparkSession, tables: Sequence[Table], destination: Destination, store: MemoryStore, checkpoint: str):
        self.spark, self.destination, self.store, self.checkpoint = spark, destination, store, checkpoint
        self.tables = {t.table_id: t for t in tables}

    def prepare(self) -> None:
        """New tables begin; tables no longer published are forgotten."""
        new, gone = self.store.tables_to_purge(list(self.tables))
        for t in sorted(gone):
            self.store.delete_table(t)
        for t in sorted(new):
            self.store.set_state(t, "init")

    def copy(self, table_id: int) -> None:
        """One table's first copy; one that broke off starts from scratch."""
        if self.store.state(table_id) in ("sync_done", "ready"):
            return
        t = self.tables[table_id]
        self.destination.drop_table_for_copy(table_id)
        self.store.set_state(table_id, "data_sync")
        self.destination.write_table_rows(table_id, t.snapshot())
        self.store.set_state(table_id, "finished_copy")
        now, lsn = "finished_copy", None
        while now not in ("sync_done", "ready"):
            now, lsn = next_state(now, lsn, t.snapshot_lsn, t.snapshot_lsn)
        self.store.set_state(table_id, now)
        self.store.advance(table_id, t.snapshot_lsn)

    def owned(self, events: DataFrame) -> DataFrame:
        """Events of copied tables after their snapshot."""
        gates = [(i, "sync_done", t.snapshot_lsn + 1) for i, t in self.tables.items() if self.store.state(i) in ("sync_done", "ready")]
        states = self.spark.createDataFrame(gates, "table_id long, state string, lsn long")
        #: Either way a batch of few files is spread over all cores.
        once = events.repartition("commit_lsn", "tx_ordinal") if self.destination.idempotent else apply.distinct_events(events)
        return apply.owned(once, F.broadcast(states))  # a row for each table

    def apply(self, events: DataFrame, batch_id: int) -> None:
        ours = self.owned(events).persist()
        try:
            self.destination.write_events(ours, batch_id)
            done = ours.groupBy("table_id").agg(F.max("commit_lsn").alias("lsn")).collect()
            for r in done:
                self.store.advance(r.table_id, int(r.lsn))
                if self.store.state(r.table_id) != "ready":
                    self.store.set_state(r.table_id, "ready")
        finally:
            ours.unpersist()

    def start(self, stream: DataFrame, **trigger):
        """Copy, then stream. Gives the streaming query."""
        self.prepare()
        for t in self.tables:
            self.copy(t)
        return start(stream, self.apply, self.checkpoint, **trigger)
