"""Applying a change log: current state from ordered legs.

State is found by aggregation with map-side partials rather than by a window,
so a key that holds a large share of the log is reduced to a row in each task
before the exchange, and no key's history meets in one place. Rows are structs,
so Spark aggregates them by an external sort within each task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.lsn import sequence_key


def last_writer_wins(legs: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], tombstones: bool = False) -> DataFrame:
    """The leg with the highest ``order`` of every key; keys whose last leg is
    a delete are left out unless ``tombstones`` asks for them."""
    last = F.max_by(F.struct(*order, "deleted", *values), F.struct(*order)).alias("last")
    out = legs.groupBy(*keys).agg(last).select(*keys, "last.*")
    return out if tombstones else out.where(~F.col("deleted")).drop("deleted")


def fold(legs: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], present: dict[str, Column], full: Column, tombstones: bool = False) -> DataFrame:
    """Ordered mutations with partial images.

    ``full`` says that a leg is a full image or a delete, ``present[c]`` that a
    partial one carries column c. A key's state opens with its last full image;
    each column then takes the last leg that carries it, so a carried NULL
    wins. A delete or a missing opener leaves no row. As a full image carries
    every column, one aggregation finds all of it: the last full leg whole, and
    for each column the last partial one, which counts if it is later. Stored
    rows are full, so they fill one buffer alone. ``tombstones`` keeps deleted
    keys, marked in ``deleted``.
    """
    at, full = F.struct(*order), F.coalesce(full, F.lit(False))
    opened = F.max_by(F.struct(at.alias("at"), F.col("deleted"), *(F.col(v).alias(f"v_{v}") for v in values)), F.when(full, at)).alias("_opened")
    carried = [F.max_by(F.struct(at.alias("at"), F.col(v).alias("v")), F.when(~full & present.get(v, F.lit(True)), at)).alias(v) for v in values]
    out = legs.groupBy(*keys).agg(opened, F.max(F.when(~full, at)).alias("_last"), *carried)
    last = F.greatest("_opened.at", "_last")
    newest = {v: F.when(F.col(f"{v}.at") > F.col("_opened.at"), F.col(f"{v}.v")).otherwise(F.col("_opened").getField(f"v_{v}")) for v in values}
    row = [*keys, *(last.getField(o).alias(o) for o in order)]
    if tombstones:
        return out.where("_opened.deleted is not null").select(*row, F.col("_opened.deleted").alias("deleted"), *(F.when(~F.col("_opened.deleted"), newest[v]).alias(v) for v in values))
    return out.where("_opened.deleted is not null and not _opened.deleted").select(*row, *(newest[v].alias(v) for v in values))


def after_truncates(rows: DataFrame, truncates: DataFrame, table: str = "table_id", key: str = "seq") -> DataFrame:
    """Rows later than the last truncate of their table; snapshot rows, with
    the lowest keys, go with it. The truncates shrink to one row a table."""
    last = truncates.groupBy(table).agg(F.max(key).alias("_truncated"))
    return rows.join(last, table, "left").where(F.col("_truncated").isNull() | (F.col(key) > F.col("_truncated"))).drop("_truncated")


def after_watermark(rows: DataFrame, progress: DataFrame, table: str = "table_id", key: str = "seq") -> DataFrame:
    """Rows past their table's applied position: replays are dropped."""
    marks = progress.groupBy(table).agg(F.max("applied").alias("_applied"))
    return rows.join(marks, table, "left").where(F.col("_applied").isNull() | (F.col(key) > F.col("_applied"))).drop("_applied")


def replay_decision(first: Column, last: Column, applied: Column) -> Column:
    """What to do with an atomic batch: a watermark inside it is an error."""
    return F.when(applied.isNull() | (applied < first), "apply").when(applied >= last, "skip").otherwise("error")


def owned(rows: DataFrame, states: DataFrame, final_lsn: str = "commit_lsn") -> DataFrame:
    """Rows of tables that the apply worker owns: ready, or synced up to a
    position not after the row's transaction."""
    gate = states.select("table_id", "state", F.col("lsn").alias("_lsn"))
    return rows.join(gate, "table_id").where((F.col("state") == "ready") | ((F.col("state") == "sync_done") & (F.col("_lsn") <= F.col(final_lsn)))).drop("state", "_lsn")


def with_snapshot(snapshot: DataFrame, legs: DataFrame) -> DataFrame:
    """Snapshot rows as legs of the lowest position, so any change wins."""
    zero = sequence_key(F.lit(0), F.lit(0))
    rows = snapshot.withColumns({"seq": zero, "sub": F.lit(0), "deleted": F.lit(False)})
    return rows.select(*legs.columns).unionByName(legs)


#: Rows of one table that one sort may take.
SORT_ROWS = 1_000_000
#: Offsets of spans that may be broadcast, after they were counted.
OFFSETS = 100_000


def _tree(x: Column, cuts: Sequence[float], first: int = 0) -> Column:
    """The number of ``cuts`` below x, by halving."""
    if not cuts:
        return F.lit(first)
    k = len(cuts) // 2
    return F.when(x > F.lit(cuts[k]), _tree(x, cuts[k + 1 :], first + k + 1)).otherwise(_tree(x, cuts[:k], first))


def _spans(log: DataFrame, table: str, spread: Column | None, parts: int) -> DataFrame | None:
    """The log with ``_span``, which of about ``parts`` equal stretches of
    ``spread`` a row is in; None if no table has more rows than a sort may take.
    Bounds are quantiles, so a table that holds most of the log is split too."""
    if spread is None or (log.groupBy(table).count().agg(F.max("count")).first()[0] or 0) <= SORT_ROWS:
        return None
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    placed = log.withColumn("_place", spread.cast("double"))
    bounds = placed.agg(F.percentile_approx("_place", shares, F.lit(1000)).alias("b")).first().b or []
    return placed.withColumn("_span", _tree(F.col("_place"), sorted(set(bounds)))).drop("_place")


def _with_offsets(rows: DataFrame, offsets: DataFrame, table: str) -> DataFrame:
    """Rows beside the one offset of their table and span (``_t``, ``_s``)."""
    offsets = F.broadcast(offsets) if offsets.count() <= OFFSETS else offsets
    return rows.join(offsets, F.col(table).eqNullSafe(F.col("_t")) & (F.col("_span") == F.col("_s"))).drop("_t", "_s")


def _running(log: DataFrame, table: str, order: Sequence[str], amount: Column, name: str, spread: Column | None = None, parts: int = 64) -> DataFrame:
    """Running total of ``amount`` in a table's order. Where a table is too
    long for a sort: what the earlier spans hold, plus the total within the
    row's own, so a sort sees one span of one table and no more."""
    rows = _spans(log, table, spread, parts)
    if rows is None:
        whole = Window.partitionBy(table).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return log.withColumn(name, F.sum(amount).over(whole).cast("long"))
    rows = rows.withColumn("_amount", amount)
    sums = rows.groupBy(table, "_span").agg(F.sum("_amount").alias("_sum"))
    earlier = Window.partitionBy(table).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(table).alias("_t"), F.col("_span").alias("_s"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy(table, "_span").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _with_offsets(rows, sums, table).withColumn(name, (F.col("_before") + F.sum("_amount").over(within)).cast("long")).drop("_amount", "_before", "_span")


def last_known(log: DataFrame, table: str, order: Sequence[str], value: Column, name: str, spread: Column | None = None, parts: int = 64, largest: bool = False) -> DataFrame:
    """``name``: the last non-null ``value`` of the table at or before each row,
    or the largest; in spans as :func:`_running` where a table is long."""
    pick = (lambda c, w: F.max(c).over(w)) if largest else (lambda c, w: F.last(c, ignorenulls=True).over(w))
    rows = _spans(log, table, spread, parts)
    if rows is None:
        return log.withColumn(name, pick(value, Window.partitionBy(table).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.withColumn("_value", value)
    ends = rows.groupBy(table, "_span").agg((F.max("_value") if largest else F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order)))).alias("_end"))
    earlier = Window.partitionBy(table).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col(table).alias("_t"), F.col("_span").alias("_s"), pick(F.col("_end"), earlier).alias("_before"))
    within = pick(F.col("_value"), Window.partitionBy(table, "_span").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = F.greatest(within, F.col("_before")) if largest else F.coalesce(within, F.col("_before"))
    return _with_offsets(rows, ends, table).withColumn(name, found).drop("_value", "_before", "_span")


def sequence_position(seq: Column) -> Column:
    """A number that grows with a sequence key, to spread a log by."""
    return F.conv(F.substring(seq, 1, 13), 16, 10).cast("double") * 4096 + F.conv(F.substring(seq, 14, 3), 16, 10).cast("double")


def segments(log: DataFrame, table: str, order: Sequence[str], version: str, spread: Column | None = None, parts: int = 64) -> DataFrame:
    """Numbers runs of one schema version in a table's log."""
    rows = _spans(log, table, spread, parts)
    now = F.struct(F.col(version).alias("v"))
    if rows is None:
        prior = F.lag(now).over(Window.partitionBy(table).orderBy(*order))
        rows = log.withColumn("_prior", prior)
    else:
        ends = rows.groupBy(table, "_span").agg(F.max_by(now, F.struct(*order)).alias("_end"))
        before = F.lag("_end").over(Window.partitionBy(table).orderBy("_span"))
        ends = ends.select(F.col(table).alias("_t"), F.col("_span").alias("_s"), before.alias("_before"))
        prior = F.coalesce(F.lag(now).over(Window.partitionBy(table, "_span").orderBy(*order)), F.col("_before"))
        rows = _with_offsets(rows, ends, table).withColumn("_prior", prior).drop("_before", "_span")
    changed = F.when(F.col("_prior").isNotNull() & F.col("_prior.v").eqNullSafe(F.col(version)), 0).otherwise(1)
    return _running(rows, table, order, changed, "segment", spread, parts).drop("_prior")


def barriers(log: DataFrame, table: str, order: Sequence[str], spread: Column | None = None, parts: int = 64) -> DataFrame:
    """Numbers accumulation runs: a relation or truncate ends the one before."""
    return _running(log, table, order, F.col("op").isin("R", "T").cast("int"), "run", spread, parts)


def mutation_batches(log: DataFrame, table: str, order: Sequence[str], size: int = 16, spread: Column | None = None, parts: int = 64) -> DataFrame:
    """Atomic batches of up to ``size`` mutations of a table, in order."""
    placed = _running(log, table, order, F.lit(1), "_place", spread, parts)
    return placed.withColumn("batch", F.floor((F.col("_place") - 1) / size).cast("long")).drop("_place")


def byte_batches(log: DataFrame, table: str, order: Sequence[str], size: str, budget: int, spread: Column | None = None, parts: int = 64) -> DataFrame:
    """Batches by decoded size: the running total before a row, in budgets."""
    placed = _running(log, table, order, F.col(size), "_total", spread, parts)
    return placed.withColumn("batch", F.floor((F.col("_total") - F.col(size)) / budget).cast("long")).drop("_total")


def distinct_events(log: DataFrame, identity: Sequence[str] = ("table_id", "commit_lsn", "tx_ordinal")) -> DataFrame:
    """At-least-once delivery made once: one row of each event."""
    return log.dropDuplicates(list(identity))


def delete_by_identity(base: DataFrame, gone: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Base rows that equal no deleted identity, NULL matching NULL. All rows
    that equal one go, as without a key a delete can't tell them apart."""
    picked = gone.select(*[F.col(c).alias(f"_{c}") for c in columns]).distinct()
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return base.join(picked, same, "left_anti")


def merge_into(base: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A base table after a batch: base rows without a newer state, and the
    state's live rows. ``state`` has tombstones (``deleted``)."""
    untouched = base.join(state.select(*keys), list(keys), "left_anti")
    return untouched.unionByName(state.where(~F.col("deleted")).select(*base.columns))


def carry_forward(log: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], present: dict[str, Column], full: Column) -> DataFrame:
    """Every event's row as it stood after the event, partial images completed
    from the events before since the last full one. For histories; the current
    state alone is :func:`fold`."""
    w = Window.partitionBy(*keys).orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = log.withColumn("_open", F.sum(full.cast("int")).over(so_far))
    within = Window.partitionBy(*keys, "_open").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = {v: F.last(F.when(full | present.get(v, F.lit(True)), F.struct(F.col(v))), ignorenulls=True).over(within) for v in values}
    out = opened.withColumns({f"_{v}": x for v, x in known.items()})
    return out.withColumns({v: F.col(f"_{v}.{v}") for v in values}).drop("_open", *(f"_{v}" for v in values))
