"""Checks of sources, publications and benchmark runs, as queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Loss of throughput, and gain of time, that fail a comparison, in per cent.
THROUGHPUT_LOSS, TIME_GAIN = 15.0, 20.0


def identity_class(key: Column, identity: Column, columns: Column) -> Column:
    """Class of a replica identity from ordinals; the key is tested first."""
    same = (F.size(key) == F.size(identity)) & (F.size(F.array_except(key, identity)) == 0)
    none = identity.isNull() | (F.size(identity) == 0)
    return F.when(none, "missing").when(F.coalesce(same, F.lit(False)), "primary_key").when(F.size(identity) == columns, "full").otherwise("alternative_key")


def allowed_identities(*by_operation: list[str]) -> Column:
    """Identity classes that every operation can take."""
    out = F.array(*map(F.lit, by_operation[0]))
    for more in by_operation[1:]:
        out = F.array_intersect(out, F.array(*map(F.lit, more)))
    return out


def primary_key_audit(tables: DataFrame) -> DataFrame:
    """Whether each table has a key and publishes all of it; no column list
    publishes every column."""
    lost = F.size(F.array_except("key", "published")) > 0
    return tables.select("table_id", F.when(F.col("key").isNull() | (F.size("key") == 0), "no_primary_key").when(F.col("published").isNotNull() & lost, "key_not_published").otherwise("ok").alias("result"))


def publication_audit(published: DataFrame, selected: DataFrame, columns: DataFrame) -> DataFrame:
    """Selected tables that aren't published, and published ones with generated
    columns, which don't replicate."""
    lost = selected.join(published, "table_id", "left_anti").select("table_id", F.lit("not_published").alias("problem"))
    made = columns.where("generated").join(published, "table_id", "left_semi").select("table_id").distinct()
    return lost.unionByName(made.select("table_id", F.lit("generated_column").alias("problem")))


def headroom(settings: DataFrame) -> DataFrame:
    """Whether what is allowed holds what is used and wanted."""
    return settings.select("setting", (F.col("allowed") - F.col("used") >= F.col("wanted")).alias("enough"))


def tables_present(wanted: list[str], catalog: DataFrame) -> DataFrame:
    """One row: whether every wanted table exists."""
    names = catalog.sparkSession.createDataFrame([(w,) for w in wanted], "table_name string")
    found = names.join(catalog.select("table_name", F.lit(True).alias("there")), "table_name", "left")
    return found.agg(F.coalesce(F.bool_and(F.col("there").isNotNull()), F.lit(False)).alias("present"))


def regression_gate(samples: DataFrame) -> DataFrame:
    """Medians of both runs of each metric and whether the new one fails: a
    ``_ms`` metric by taking longer, any other by a lower rate."""
    medians = samples.groupBy("metric").pivot("run", ["base", "new"]).agg(F.percentile("value", F.lit(0.5)))
    change = (F.col("new") - F.col("base")) * 100 / F.col("base")
    slow = F.when(F.col("metric").endswith("_ms"), change > TIME_GAIN).otherwise(-change > THROUGHPUT_LOSS)
    return medians.select("metric", "base", "new", F.when(F.col("base") > 0, slow).otherwise(False).alias("failed"))


def replication_status(states: DataFrame, names: DataFrame, lag: DataFrame) -> DataFrame:
    """Published tables with their state and what is known of their lag."""
    return states.join(names, "table_id", "left").join(lag, "table_id", "left")


def to_roll_back(states: DataFrame, table_ids: list[int] | None = None, all_errored: bool = False) -> DataFrame:
    """Tables that a rollback request names: some, all errored, or all."""
    rows = states.where("state = 'errored'") if all_errored else states
    return rows if table_ids is None else rows.where(F.col("table_id").isin(*table_ids))
