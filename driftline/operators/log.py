"""The change log as a DataFrame, and its first transformations.

A log row is one event: ``table_id, op, start_lsn, commit_lsn, tx_ordinal,
event_ts, snapshot_id``, a full or partial new image, an old image, and for
partial images the names or positions of the columns that are missing. ``op``
is B(egin), C(ommit), I(nsert), U(pdate), D(elete), T(runcate), R(elation) or
M(essage).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROW_OPS = ("I", "U", "D")
MARKED_OPS = ("B", "C", "I", "U", "D", "T", "R")


def keep_supported(log: DataFrame, prefixes: Sequence[str] = ()) -> DataFrame:
    """Event kinds the engine knows, and messages with a known prefix."""
    return log.where(F.col("op").isin(*MARKED_OPS) | ((F.col("op") == "M") & F.col("prefix").isin(*prefixes)) if prefixes else F.col("op").isin(*MARKED_OPS))


def tx_ordinals(messages: DataFrame, transaction: str, position: str) -> DataFrame:
    """Place of every message in its transaction, Begin being 0; messages that
    are skipped later count too. One transaction's messages are sorted
    together, as they are committed together."""
    order = Window.partitionBy(transaction).orderBy(position)
    return messages.withColumn("tx_ordinal", F.row_number().over(order).cast("long") - 1)


def split_key_changes(log: DataFrame, old_keys: Sequence[str], new_keys: Sequence[str], values: Sequence[str], order: Sequence[str], keys: Sequence[str] | None = None) -> DataFrame:
    """Legs of events: an update that moves a row gives a delete of the old key
    (sub 0) and an upsert of the new one (sub 1), any other event one leg (sub
    0). Columns: ``keys``, ``order``, ``sub``, ``deleted`` and ``values``.

    One pass without a join or an exchange; an old key that is null, as when no
    old image came, is the new one.
    """
    keys = list(keys or new_keys)
    old = [F.coalesce(F.col(o), F.col(n)) for o, n in zip(old_keys, new_keys, strict=True)]
    moved = F.lit(False)
    for o, n in zip(old, new_keys, strict=True):
        moved = moved | ~o.eqNullSafe(F.col(n))
    #: 0 the delete of a moved row, 1 its upsert, 2 the leg of a row that stays; numbers alone, as compiled code can explode these.
    numbers = lambda *n: F.array(*map(F.lit, n))
    legs = log.withColumn("_leg", F.explode(F.when(moved, numbers(0, 1)).otherwise(numbers(2))))
    gone = F.col("_leg") == 0
    named = [F.when(gone, o).otherwise(F.col(n)).alias(k) for o, n, k in zip(old, new_keys, keys, strict=True)]
    sub = F.when(F.col("_leg") == 1, 1).otherwise(0).alias("sub")
    deleted = F.when(gone, F.lit(True)).otherwise(F.col("op") == "D").alias("deleted")
    return legs.select(*named, *order, sub, deleted, *(F.when(~gone, F.col(v)).alias(v) for v in values))


def without_old_image_needs_primary_key(log: DataFrame, identity: str) -> DataFrame:
    """Rejects: updates without an old image where the table's identity isn't
    its primary key, so that a key change couldn't be seen."""
    return log.where((F.col("op") == "U") & F.col("old_kind").isNull()) if identity != "primary_key" else log.where(F.lit(False))


def event_mix(log: DataFrame) -> DataFrame:
    """Counts of event kinds over the log, in one row."""
    of = lambda op: F.count(F.when(F.col("op") == op, 1))
    return log.agg(of("I").alias("inserts"), of("U").alias("updates"), of("D").alias("deletes"), of("T").alias("truncates"), of("R").alias("relations"), F.count("*").alias("events"))


def payload_bytes(columns: Sequence[str]) -> Column:
    """Bytes of the text values of a row; NULL and unchanged values count none."""
    total = F.lit(0).cast("long")
    for c in columns:
        total = total + F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0))
    return total


def transaction_metrics(log: DataFrame) -> DataFrame:
    return log.groupBy("commit_lsn").agg(F.count("*").alias("events"), F.min("tx_ordinal").alias("first_ordinal"), F.max("tx_ordinal").alias("last_ordinal"))


def commit_mismatches(begins: DataFrame, commits: DataFrame) -> DataFrame:
    """Transactions whose Commit isn't at the position that Begin announced."""
    return begins.join(commits, "xid").where("final_lsn <> commit_lsn").select("xid", "final_lsn", "commit_lsn")


def dense_keys(tuple_col: Column, identity: Sequence[int], width: int) -> Column:
    """An identity tuple as its key values: dense as it came, or picked from a
    row of full width; any other length raises."""
    picked = F.array(*[F.element_at(tuple_col, i + 1) for i in identity])
    return F.when(F.size(tuple_col) == len(identity), tuple_col).when(F.size(tuple_col) == width, picked).otherwise(F.raise_error(F.lit("a key tuple of an unexpected length")))


def resolve_unchanged(log: DataFrame, columns: Sequence[str], identity: Sequence[str]) -> DataFrame:
    """New images in which unchanged out-of-line values are filled in.

    ``new.c`` is the value and ``unchanged`` the names whose value didn't come.
    A full old image fills any column, a key image identity columns alone; what
    stays open is listed in ``missing`` and the image is ``partial``.
    """
    held = lambda c: F.array_contains("unchanged", c)
    fills = lambda c: F.col("old_kind").eqNullSafe("full") | (F.col("old_kind").eqNullSafe("key") & F.lit(c in identity))
    values = [F.when(held(c), F.when(fills(c), F.col(f"old.{c}"))).otherwise(F.col(f"new.{c}")).alias(c) for c in columns]
    missing = F.filter(F.array(*[F.when(held(c) & ~fills(c), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    return log.withColumns({"new": F.struct(*values), "missing": missing}).withColumn("new_kind", F.when(F.size("missing") > 0, "partial").otherwise("full"))
