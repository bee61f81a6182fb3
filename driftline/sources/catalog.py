"""Source catalog queries over catalog tables as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Schemas that hold no user tables.
SYSTEM_SCHEMAS = ("pg_catalog", "information_schema")


def replicable_tables(tables: DataFrame, internal: tuple[str, ...] = ()) -> DataFrame:
    """User tables by name, without system and internal schemas."""
    return tables.where(~F.col("schema_name").isin(*SYSTEM_SCHEMAS, *internal) & ~F.col("schema_name").rlike("^pg_(toast|temp)")).select("table_id", "schema_name", "table_name")


def publication_tables(publication: DataFrame, inherits: DataFrame | None = None, via_root: bool = True) -> DataFrame:
    """Distinct ids of published tables; partitions count as their root where
    the publication goes through it."""
    rows = publication.select("table_id")
    if inherits is not None and via_root:
        rows = rows.join(roots(inherits), "table_id", "left").select(F.coalesce("root_id", "table_id").alias("table_id"))
    return rows.distinct()


def roots(inherits: DataFrame) -> DataFrame:
    """``table_id, root_id`` of every partition, however deep: each round maps
    a table to its target's target, which doubles the way, until none moves.
    Rounds are written to the shared folder, which cuts their lineage. A cycle
    raises."""
    from driftline.streaming.apply_stream import shared_root

    spark, folder = inherits.sparkSession, shared_root(inherits.sparkSession, "roots")
    now, rounds, moved = inherits.select(F.col("child_id").alias("table_id"), F.col("parent_id").alias("root_id")), None, 0
    while rounds is None or moved < rounds:
        now.write.parquet(f"{folder}/{moved}")
        now = spark.read.schema(now.schema).parquet(f"{folder}/{moved}")
        rounds = 2 + now.count().bit_length() if rounds is None else rounds
        onward = now.select(F.col("table_id").alias("_from"), F.col("root_id").alias("_to"))
        found = now.join(onward, F.col("root_id") == F.col("_from"), "left")
        if not found.where("_to is not null").limit(1).count():
            return now
        now, moved = found.select("table_id", F.coalesce("_to", "root_id").alias("root_id")), moved + 1
    raise ValueError("partitions inherit in a cycle")


def leaves(inherits: DataFrame) -> DataFrame:
    """``root_id, table_id`` of the leaf partitions of each root."""
    parents = inherits.select(F.col("parent_id").alias("table_id")).distinct()
    return roots(inherits).join(parents, "table_id", "left_anti").select("root_id", "table_id")


def columns_of(messages: DataFrame, payload: str = "content") -> DataFrame:
    """Columns of schema messages, ``{"columns": [{name, type, ordinal, ...}]}``,
    one row each, in order."""
    kind = "struct<table_id:bigint,columns:array<struct<name:string,type:string,ordinal:int,nullable:boolean,key_position:int,default:string>>>"
    parsed = messages.select(F.col("snapshot_id"), F.from_json(payload, kind).alias("m"))
    return parsed.select("snapshot_id", F.col("m.table_id").alias("table_id"), F.explode("m.columns").alias("c")).select("snapshot_id", "table_id", "c.*")


def schema_json(columns: DataFrame) -> DataFrame:
    """One JSON array per table version, columns by ordinal."""
    item = F.struct("ordinal", "name", "type", "nullable")
    return columns.groupBy("table_id", "snapshot_id").agg(F.to_json(F.sort_array(F.collect_list(item))).alias("columns"))


def effective_primary_key(keys: DataFrame, inherits: DataFrame) -> DataFrame:
    """Key columns of each table, a partition without its own taking its
    root's. ``keys``: (table_id, attnums array)."""
    own = keys.select("table_id", F.posexplode("attnums").alias("pos", "attnum"))
    bare = roots(inherits).join(keys, "table_id", "left_anti")
    lent = bare.join(own.withColumnRenamed("table_id", "root_id"), "root_id").select("table_id", "pos", "attnum")
    return own.unionByName(lent).select("table_id", (F.col("pos") + 1).alias("key_position"), "attnum")
