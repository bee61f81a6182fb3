"""State of replicated tables: lifecycle, progress, metadata, hand-off.

Histories are append-only tables; what is current is the last row of a key.
"""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STATES = ("init", "data_sync", "finished_copy", "sync_wait", "catchup", "sync_done", "ready", "errored")
MEMORY_ONLY = ("sync_wait", "catchup")


class Destination(ABC):
    """What a sink offers. One that is ``idempotent`` takes an event that comes
    twice in a batch as one, so that no one needs to look for those."""

    idempotent = False

    def startup(self) -> None: ...

    def shutdown(self) -> None: ...

    @abstractmethod
    def drop_table_for_copy(self, table_id: int) -> None: ...

    @abstractmethod
    def write_table_rows(self, table_id: int, rows: DataFrame) -> None: ...

    @abstractmethod
    def write_events(self, events: DataFrame, batch_id: int) -> None: ...


class StateStore(ABC):
    """Table states, progress and destination metadata."""

    @abstractmethod
    def state(self, table_id: int) -> str | None: ...

    @abstractmethod
    def set_state(self, table_id: int, state: str) -> None: ...

    @abstractmethod
    def rollback(self, table_id: int) -> str: ...

    @abstractmethod
    def progress(self, table_id: int) -> int: ...

    @abstractmethod
    def advance(self, table_id: int, lsn: int) -> int: ...


class SchemaStore(ABC):
    """Schema versions by table."""

    @abstractmethod
    def schema_at(self, table_id: int, lsn: int): ...

    @abstractmethod
    def store(self, schema) -> None: ...

    @abstractmethod
    def prune(self, retain: dict[int, int]) -> int: ...


class MemoryStore(StateStore, SchemaStore):
    """Both stores in the driver, for tests and short runs."""

    def __init__(self) -> None:
        self._history: dict[int, list[str]] = {}
        self._progress: dict[int, int] = {}
        self._schemas: dict[int, dict[int, object]] = {}
        self.metadata: dict[int, dict] = {}

    def state(self, table_id):
        return (self._history.get(table_id) or [None])[-1]

    def set_state(self, table_id, state):
        if state not in STATES:
            raise ValueError(state)
        self._history.setdefault(table_id, []).append(state)

    def rollback(self, table_id):
        past = self._history.get(table_id, [])
        if len(past) < 2:
            raise ValueError("nothing to roll back to")
        past.pop()
        return past[-1]

    def reset(self, table_id):
        self._history[table_id] = ["init"]
        self._progress.pop(table_id, None)

    def delete_table(self, table_id):
        for x in (self._history, self._progress, self._schemas, self.metadata):
            x.pop(table_id, None)

    def progress(self, table_id):
        return self._progress.get(table_id, 0)

    def advance(self, table_id, lsn):
        self._progress[table_id] = max(lsn, self._progress.get(table_id, 0))
        return self._progress[table_id]

    def schema_at(self, table_id, lsn):
        past = [v for v in self._schemas.get(table_id, {}) if v <= lsn]
        return self._schemas[table_id][max(past)] if past else None

    def store(self, schema):
        self._schemas.setdefault(schema.table_id, {})[schema.snapshot] = schema

    def prune(self, retain):
        gone = 0
        for table, bound in retain.items():
            versions = self._schemas.get(table, {})
            old = sorted(v for v in versions if v <= bound)[:-1]
            gone += len(old)
            for v in old:
                del versions[v]
        return gone

    def set_metadata(self, table_id: int, note: dict) -> None:
        self.metadata[table_id] = note

    def tables_to_purge(self, published: Sequence[int]) -> tuple[set[int], set[int]]:
        """Tables new to the publication, and those no longer in it."""
        have, want = set(self._history), set(published)
        return want - have, have - want


class ParquetStore(MemoryStore):
    """The stores as an append-only table of changes in a shared folder.

    Every change is written as it is made, and a new store on the same folder
    takes them in order, so a restart finds states with their history,
    progress, schemas and destination metadata as they were. One writer at a
    time. ``tables`` shows what is current as the five state tables."""

    SCHEMA = "id long, kind string, table_id long, payload string"

    def __init__(self, spark: SparkSession, root: str):
        super().__init__()
        self.spark, self.root, self._next = spark, root.rstrip("/"), 0
        for r in self.changes().orderBy("id").collect():  # as many as changes of state
            self._take(r.kind, r.table_id, json.loads(r.payload))
            self._next = r.id + 1

    def changes(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.SCHEMA).parquet(f"{self.root}/changes")
        except AnalysisException:
            return self.spark.createDataFrame([], self.SCHEMA)

    def _take(self, kind: str, table_id: int, value):
        if kind == "store":
            return super().store(schema_of(value))
        if kind == "prune":
            return super().prune({table_id: value[0]})
        return getattr(super(), kind)(table_id, *value)

    def _note(self, kind: str, table_id: int, value: list):
        out = self._take(kind, table_id, value)  # raises before anything is written
        row = [(self._next, kind, table_id, json.dumps(value))]
        self.spark.createDataFrame(row, self.SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.root}/changes")
        self._next += 1
        return out

    def set_state(self, table_id, state):
        return self._note("set_state", table_id, [state])

    def rollback(self, table_id):
        return self._note("rollback", table_id, [])

    def reset(self, table_id):
        return self._note("reset", table_id, [])

    def delete_table(self, table_id):
        return self._note("delete_table", table_id, [])

    def advance(self, table_id, lsn):
        if lsn <= self.progress(table_id):
            return self.progress(table_id)
        return self._note("advance", table_id, [lsn])

    def set_metadata(self, table_id, note):
        return self._note("set_metadata", table_id, [note])

    def store(self, schema):
        return self._note("store", schema.table_id, [schema.table_id, schema.schema, schema.name, schema.snapshot, [[c.name, c.type, c.ordinal, c.key_position, c.nullable, c.default, c.modifier] for c in schema.columns]])

    def prune(self, retain):
        return sum(self._note("prune", t, [bound]) for t, bound in sorted(retain.items()))

    def tables(self) -> dict[str, DataFrame]:
        make = self.spark.createDataFrame
        schemas = [(t, v, x.schema, x.name) for t, by in self._schemas.items() for v, x in by.items()]
        columns = [(t, v, c.ordinal, c.name, c.type, c.nullable, c.key_position, c.default) for t, by in self._schemas.items() for v, x in by.items() for c in x.columns]
        return {
            "replication_state": make([(t, i, x) for t, past in self._history.items() for i, x in enumerate(past)], "table_id long, id int, state string"),
            "replication_progress": make(list(self._progress.items()), "table_id long, flush_lsn long"),
            "table_schemas": make(schemas, "table_id long, snapshot_id long, schema_name string, table_name string"),
            "table_columns": make(columns, "table_id long, snapshot_id long, ordinal int, name string, type string, nullable boolean, key_position int, default_expression string"),
            "destination_metadata": make([(t, m["status"], m["snapshot"]) for t, m in self.metadata.items()], "table_id long, status string, snapshot_id long"),
        }


def schema_of(value: list):
    from driftline.operators.schema import Column as SchemaColumn
    from driftline.operators.schema import TableSchema

    table_id, schema, name, snapshot, columns = value
    return TableSchema(table_id, schema, name, tuple(SchemaColumn(*c) for c in columns), snapshot)


class Slots:
    """Replication slots of file sources: a position from which a stream goes
    on, kept in the store's metadata under negative ids."""

    def __init__(self, store: MemoryStore):
        self.store_ = store

    def _known(self) -> dict[str, tuple[int, dict]]:
        return {m["slot"]: (i, m) for i, m in self.store_.metadata.items() if "slot" in m}

    def create(self, name: str, lsn: int) -> None:
        if name in self._known():
            raise ValueError(f"slot {name} exists")
        number = min([0, *(i for i, _ in self._known().values())]) - 1
        self.store_.set_metadata(number, {"slot": name, "lsn": lsn, "status": "reserved", "snapshot": lsn})

    def get(self, name: str) -> int | None:
        return self._known()[name][1]["lsn"] if name in self._known() else None

    def confirm(self, name: str, lsn: int) -> int:
        """Move a slot on; it never goes back."""
        number, m = self._known()[name]
        self.store_.set_metadata(number, m | {"lsn": max(lsn, m["lsn"])})
        return max(lsn, m["lsn"])

    def state(self, name: str, oldest: int) -> str:
        """``missing``, ``lost`` if the log no longer goes back to it, else
        ``reserved``."""
        at = self.get(name)
        return "missing" if at is None else "lost" if at < oldest else "reserved"

    def delete(self, name: str) -> bool:
        if name not in self._known():
            return False
        self.store_.delete_table(self._known()[name][0])
        return True


def current_states(history: DataFrame) -> DataFrame:
    return history.groupBy("table_id").agg(F.max_by("state", "id").alias("state"), F.max("id").alias("id"))


def rolled_back(history: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """State of each table one step back; tables with one state aren't listed."""
    place = F.row_number().over(Window.partitionBy("table_id").orderBy(F.desc("id")))
    rows = history if chosen is None else history.join(chosen, "table_id", "left_semi")
    return rows.withColumn("_n", place).where("_n = 2").select("table_id", "state", "id")


def advance_progress(progress: DataFrame, updates: DataFrame, keys: Sequence[str], lsn: str = "flush_lsn") -> DataFrame:
    """Progress that never goes back, whatever the order of updates."""
    return progress.select(*keys, lsn).unionByName(updates.select(*keys, lsn)).groupBy(*keys).agg(F.max(lsn).alias(lsn))


def state_counts(states: DataFrame) -> DataFrame:
    return states.groupBy("state").agg(F.count("*").alias("tables"))


def publication_changes(published: DataFrame, known: DataFrame) -> DataFrame:
    """``table_id, action``: init what is new, purge what is gone."""
    new = published.join(known, "table_id", "left_anti").select("table_id", F.lit("init").alias("action"))
    gone = known.join(published, "table_id", "left_anti").select("table_id", F.lit("purge").alias("action"))
    return new.unionByName(gone)


def lag_gauges(received: Column, durable: Column, effective: Column, current: Column) -> dict[str, Column]:
    gap = lambda a, b: F.greatest(a - b, F.lit(0).cast("decimal(20,0)"))
    return {"received_lag": gap(current, received), "flush_lag": gap(received, durable), "effective_flush_lag": gap(received, effective), "end_to_end_lag": gap(current, effective)}


def slot_lag(slots: DataFrame, senders: DataFrame, wal: DataFrame) -> DataFrame:
    """Bytes by which slots hold back the log, and the sender's delays."""
    joined = slots.join(senders, "pid", "left").crossJoin(wal)
    gap = lambda c: F.greatest(F.col("current_lsn") - F.col(c), F.lit(0).cast("decimal(20,0)"))
    return joined.select("slot_name", gap("restart_lsn").alias("restart_bytes"), gap("confirmed_flush_lsn").alias("flush_bytes"), "write_lag_ms", "flush_lag_ms")


def next_state(state: str, lsn: int | None, current: int, snapshot: int) -> tuple[str, int | None]:
    """One step of a table's hand-off from its copy to the apply worker."""
    if state == "finished_copy":
        return "sync_wait", snapshot
    if state == "sync_wait":
        return "catchup", max(snapshot, current)
    if state == "catchup":
        return ("sync_done", lsn) if current >= lsn else (state, lsn)
    if state == "sync_done":
        return ("ready", None) if current >= lsn else (state, lsn)
    return state, lsn


def backoff_ms(attempt: Column, base_ms: int, most_ms: int) -> Column:
    """Wait before an attempt: doubling from the base, up to the most."""
    return F.least(F.lit(float(most_ms)), F.lit(float(base_ms)) * F.pow(F.lit(2.0), attempt)).cast("long")


def backpressure(used: list[float], on: float = 0.85, off: float = 0.75) -> list[bool]:
    """Whether intake pauses after each memory reading, with hysteresis."""
    out, paused = [], False
    for x in used:
        paused = x >= off if paused else x >= on
        out.append(paused)
    return out
