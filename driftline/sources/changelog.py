"""Batch and streaming readers of a change log in files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.lsn import LSN


def read_log(spark: SparkSession, path: str, fmt: str = "parquet", after: str | None = None) -> DataFrame:
    """A captured log, from a start position on; the filter reaches the scan."""
    log = spark.read.format(fmt).load(path)
    return log if after is None else log.where(F.col("commit_lsn") > F.lit(after).cast(LSN))


def stream_log(spark: SparkSession, path: str, schema, files: int = 8, max_bytes: str | None = None) -> DataFrame:
    """A log as a stream of files, admitted by number and size."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    if max_bytes:
        reader = spark.readStream.schema(schema).option("maxBytesPerTrigger", max_bytes)
    return reader.parquet(path)


def from_events(events: DataFrame) -> DataFrame:
    """A change log over a table of events, for demonstration and measuring.

    A user has eight keys, so their number grows with the users; clicks with a
    number divisible by 10 move their row to the next user's key, errors delete,
    signups insert, views carry no value (they are partial images; the old
    image has it), and four events make a transaction.
    """
    key = F.col("user_id") * 8 + F.col("event_id") % 8
    view = F.col("event_type") == "view"
    return events.select(
        F.lit(1).cast("long").alias("table_id"),
        key.cast("long").alias("old_k"),
        (key + F.when((F.col("event_type") == "click") & (F.col("event_id") % 10 == 0), 8).otherwise(0)).cast("long").alias("new_k"),
        ((F.floor(F.col("event_id") / 4.0).cast("long") + 1) * 256).alias("commit_lsn"),
        (F.col("event_id") % 4 + 1).cast("long").alias("tx_ordinal"),
        F.when(F.col("event_type") == "error", "D").when(F.col("event_type") == "signup", "I").otherwise("U").alias("op"),
        view.alias("is_partial"),
        "event_type",
        F.when(~view, F.col("value")).alias("value"),
        F.when(view, F.col("value")).alias("old_value"),
        "event_id",
        "user_id",
        F.col("props"),
    )


def complete(changes: DataFrame) -> DataFrame:
    """The same log with full images: values that didn't come are those of the
    full old image."""
    from driftline.operators.log import resolve_unchanged

    image = F.struct("event_type", "value")
    unsent = F.when(F.col("is_partial"), F.array(F.lit("value"))).otherwise(F.array().cast("array<string>"))
    events = changes.withColumns({"new": image, "old": F.struct("event_type", F.col("old_value").alias("value")), "old_kind": F.lit("full"), "unchanged": unsent})
    out = resolve_unchanged(events, ["event_type", "value"], [])
    return out.withColumns({"event_type": F.col("new.event_type"), "value": F.col("new.value"), "is_partial": F.col("new_kind") != "full"}).drop("new", "old", "old_kind", "unchanged", "missing", "new_kind")
