"""Rules of the replication protocol over a change log, as expressions."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Batches and bytes that may be accepted and not yet durable.
PENDING_BATCHES, PENDING_BYTES = 64, 256 << 20
#: Attempts of a timed retry and seconds between them.
RETRY_ATTEMPTS, RETRY_SECONDS = 5, 10


def of_table(log: DataFrame, table_id: int) -> DataFrame:
    """Events that concern a table: its own, and truncates that name it."""
    return log.where((F.col("table_id") == table_id) | F.coalesce(F.array_contains("truncated", F.lit(table_id).cast("long")), F.lit(False)))


def split_truncates(log: DataFrame, states: DataFrame, final_lsn: str = "commit_lsn") -> DataFrame:
    """A truncate names several tables: one event for each of them that the
    apply worker owns (ready, or synced before the truncate). Other events stay
    as they are."""
    named = log.where("op = 'T'").withColumn("table_id", F.explode("truncated"))
    gate = states.select("table_id", "state", F.col("lsn").alias("_lsn"))
    ours = named.join(gate, "table_id").where((F.col("state") == "ready") | ((F.col("state") == "sync_done") & (F.col("_lsn") <= F.col(final_lsn))))
    return log.where("op <> 'T'").unionByName(ours.select(log.columns))


def require_values(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows as they are; running it raises on a NULL in one of the columns,
    which the source declares NOT NULL."""
    absent = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in columns)))
    return rows.where(F.when(F.size(absent) > 0, F.raise_error(F.concat(F.lit("NULL in NOT NULL columns: "), F.array_join(absent, ", ")))).otherwise(F.lit(True)))


def null_violations(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows that :func:`require_values` would stop at, with the columns."""
    absent = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in columns)))
    return rows.withColumn("violated", F.array_join(absent, ",")).where("violated <> ''")


def retention_bounds(progress: DataFrame, needed: DataFrame) -> DataFrame:
    """``table_id, retain_lsn``: how far schema versions must be kept, the
    durable position or the earliest snapshot that a destination still needs,
    whichever comes first. A table without progress keeps everything."""
    durable = progress.groupBy("table_id").agg(F.max("flush_lsn").alias("_durable"))
    earliest = needed.groupBy("table_id").agg(F.min("snapshot_id").alias("_needed"))
    return durable.join(earliest, "table_id", "left").select("table_id", F.least("_durable", F.coalesce("_needed", "_durable")).alias("retain_lsn"))


def effective_flush(received: Column, flushed: Column, in_flight: Column) -> Column:
    """What may be reported as flushed: all that came where nothing is open."""
    return F.when(in_flight == 0, received).otherwise(F.least(flushed, received))


def pending_window(batches: DataFrame, table: str, order: str, size: str, durable: str, most: int = PENDING_BATCHES, most_bytes: int = PENDING_BYTES) -> DataFrame:
    """Each batch with the batches and bytes that are accepted and not durable
    once it is, and whether intake has to wait. ``durable`` is the number of
    the last batch made durable when this one is accepted."""
    first = F.col(order) - F.col(durable)
    so_far = Window.partitionBy(table).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = batches.withColumn("_total", F.sum(size).over(so_far)).withColumn("_open", F.greatest(first, F.lit(0)).cast("long"))
    past = totals.select(F.col(table).alias("_t"), F.col(order).alias("_o"), F.col("_total").alias("_done"))
    joined = totals.join(past, F.col(table).eqNullSafe(F.col("_t")) & (F.col(durable) == F.col("_o")), "left")
    open_bytes = (F.col("_total") - F.coalesce("_done", F.lit(0))).cast("long")
    wait = (F.col("_open") >= most) | (open_bytes >= most_bytes)
    return joined.select(*batches.columns, F.col("_open").alias("open_batches"), open_bytes.alias("open_bytes"), wait.alias("wait"))


def lost_slots(slots: DataFrame, tables: DataFrame, policy: str) -> DataFrame:
    """``table_id, action`` of the tables behind slots that the source no longer
    keeps: ``error`` or ``reset`` (every table of the slot is copied again)."""
    if policy not in ("error", "recreate"):
        raise ValueError(policy)
    lost = slots.where("wal_status = 'lost'").select("slot_name")
    return tables.join(lost, "slot_name", "left_semi").select("table_id", F.lit("reset" if policy == "recreate" else "error").alias("action"))


def retry_steps(failures: DataFrame, most: int = RETRY_ATTEMPTS, seconds: int = RETRY_SECONDS) -> DataFrame:
    """Each failure (``table_id, attempt, kind``, attempts from 1) with what
    follows: a timed one waits and rolls back, until the attempts are used up;
    others wait for an operator or aren't tried again."""
    timed = (F.col("kind") == "timed") & (F.col("attempt") < most)
    action = F.when(timed, "wait_and_roll_back").when(F.col("kind").isin("timed", "manual"), "manual").otherwise("no_retry")
    return failures.select("table_id", "attempt", action.alias("action"), F.when(timed, seconds * 1000).otherwise(0).cast("long").alias("wait_ms"))


def with_retries(work: Callable[[], None], store, table_id: int, most: int = RETRY_ATTEMPTS, seconds: float = RETRY_SECONDS, timed: Callable[[Exception], bool] = lambda e: True, sleep: Callable[[float], None] = time.sleep) -> int:
    """Run a table's work; after an error that time may mend, note it, wait,
    roll the state back by one and run it again. Gives the number of attempts;
    the last error is raised and leaves the table errored."""
    for attempt in range(1, most + 1):
        try:
            work()
            return attempt
        except Exception as e:
            store.set_state(table_id, "errored")
            if attempt == most or not timed(e):
                raise
            sleep(seconds)
            store.rollback(table_id)
    raise AssertionError


@dataclass
class TableCache:
    """Per table, what the protocol knows: a schema change was announced and
    its relation hasn't come yet, or the relation's schema."""

    def __init__(self) -> None:
        self._known: dict[int, tuple[str, object]] = {}

    def waiting(self, table_id: int, snapshot: int) -> None:
        self._known[table_id] = ("waiting", snapshot)

    def ready(self, table_id: int, schema) -> None:
        """A relation came. After an announced change it must be of that
        version."""
        kind, value = self._known.get(table_id, ("", None))
        if kind == "waiting" and schema.snapshot != value:
            raise ValueError(f"table {table_id}: a relation of version {schema.snapshot}, where {value} was announced")
        self._known[table_id] = ("ready", schema)

    def schema(self, table_id: int):
        """The schema that rows are decoded with; rows before it are an error."""
        kind, value = self._known.get(table_id, ("", None))
        if kind != "ready":
            raise ValueError(f"table {table_id}: a row came before its relation")
        return value

    def remove(self, table_id: int) -> None:
        self._known.pop(table_id, None)


def newest(versions: DataFrame, table: str, version: str, keep: int = 2) -> DataFrame:
    """The newest ``keep`` versions of each table. As many are kept by each
    task before anything is exchanged."""
    place = F.row_number().over(Window.partitionBy(table).orderBy(F.desc(version)))
    return versions.withColumn("_place", place).where(F.col("_place") <= keep).drop("_place")


def of_named_table(metrics: DataFrame, tables: DataFrame, name: str) -> DataFrame:
    """Metrics of the one table of that name, its id looked up by a scalar
    subquery; none where there is no such table."""
    one = tables.where(F.col("table_name") == name).select("table_id")
    return metrics.where(F.col("table_id") == one.scalar())


def any_of(tables: DataFrame, ids: Sequence[int], column: str = "partitioned") -> DataFrame:
    """One row: whether a table among ``ids`` has the property."""
    some = tables.where(F.col("table_id").isin(*ids) & F.col(column)).limit(1)
    return some.agg((F.count("*") > 0).alias("present"))


def fnv1a(text: Column) -> Column:
    """FNV-1a over the UTF-8 bytes, 64 bits as 16 hex digits, by halves of 32
    bits, so that nothing overflows. For identifiers: it is linear per byte."""
    hexed = F.hex(F.encode(text, "UTF-8"))
    half = F.lit((1 << 32) - 1)
    places = F.when(F.length(hexed) > 0, F.sequence(F.lit(1), F.length(hexed) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))

    def step(h: Column, at: Column) -> Column:
        low = h["low"].bitwiseXOR(F.conv(F.substring(hexed, at, F.lit(2)), 16, 10).cast("long"))
        product = low * 435
        high = h["high"] * 435 + F.shiftright(product, 32) + F.shiftleft(low, 8)
        return F.struct(high.bitwiseAND(half).alias("high"), product.bitwiseAND(half).alias("low"))

    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("high"), F.lit(0x84222325).cast("long").alias("low"))
    digits = lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")
    return F.aggregate(places, start, step, lambda h: F.concat(digits(h["high"]), digits(h["low"])))
