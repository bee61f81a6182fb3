"""Changing destination tables: statements, metadata brackets, catalogs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.names import quote_identifier, quote_literal
from driftline.operators import schema


def statement(table: str, step: tuple[str, str, str | None]) -> str:
    """The statement of one planned step, see :func:`schema.plan_steps`."""
    kind, column, value = step
    name, head = quote_identifier(column), f"alter table {table} "
    if kind == "add":
        return f"{head}add column {name} {value}"
    if kind in ("rename", "set_aside"):
        return f"{head}rename column {name} to {quote_identifier(value)}"
    if kind == "drop":
        return f"{head}drop column {name}"
    if kind == "default":
        return f"{head}alter column {name} " + ("drop default" if value is None else f"set default {quote_literal(value)}")
    if kind == "nullable":
        return f"{head}alter column {name} " + ("drop not null" if value == "true" else "set not null")
    raise ValueError(kind)


def statements(table: str, old: Sequence[schema.Column], new: Sequence[schema.Column], sink: str) -> list[str]:
    return [statement(table, s) for s in schema.plan_steps(old, new, sink)]


def apply_steps(rows: DataFrame, steps: Sequence[tuple[str, str, str | None]], types: dict[str, str]) -> DataFrame:
    """A stored table after the steps of a diff, in their order. An added
    column is NULL in the rows there are, and a step that was taken before an
    interruption changes nothing, so the whole list may be run again."""
    for kind, column, value in steps:
        have = set(rows.columns)
        if kind == "add" and column not in have:
            rows = rows.withColumn(column, F.lit(None).cast(types[value]))
        elif kind in ("rename", "set_aside") and column in have and value not in have:
            rows = rows.withColumnRenamed(column, value)
        elif kind == "drop" and column in have:
            rows = rows.drop(column)
    return rows


def in_bracket(store, table_id: int, target: schema.TableSchema, work: Callable[[Sequence[schema.Column], Sequence[schema.Column]], None]) -> bool:
    """Take a destination table to ``target`` between two notes in the store:
    applying, with the version before, and applied. A table found applying, as
    after a crash, is taken from that earlier version again, by steps that may
    have been taken. Gives whether anything was to do."""
    known = store.metadata.get(table_id)
    if known and known["status"] == "applied" and known["snapshot"] >= target.snapshot:
        return False
    before = known["before"] if known and known["status"] == "applying" else known["columns"] if known else []
    store.set_metadata(table_id, {"status": "applying", "snapshot": target.snapshot, "before": before, "columns": as_rows(target.columns)})
    work([schema.Column(*c) for c in before], target.columns)
    store.set_metadata(table_id, {"status": "applied", "snapshot": target.snapshot, "before": before, "columns": as_rows(target.columns)})
    return True


def as_rows(columns: Sequence[schema.Column]) -> list[list]:
    return [[c.name, c.type, c.ordinal, c.key_position, c.nullable, c.default, c.modifier] for c in columns]


def latest_metadata(history: DataFrame) -> DataFrame:
    """The last note of each table."""
    return history.groupBy("table_id").agg(F.max_by(F.struct("status", "snapshot_id"), "id").alias("m")).select("table_id", "m.*")


class Catalog:
    """Namespaces and tables of the session's catalog."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def create_namespace(self, name: str) -> None:
        self.spark.sql(f"create database if not exists `{name}`")

    def drop_namespace(self, name: str) -> None:
        self.spark.sql(f"drop database if exists `{name}`")

    def namespaces(self) -> list[str]:
        return sorted(d.name for d in self.spark.catalog.listDatabases())

    def create_table(self, namespace: str, name: str, columns: str) -> bool:
        """Whether it was missing."""
        missing = not self.spark.catalog.tableExists(f"`{namespace}`.`{name}`")
        if missing:
            self.spark.sql(f"create table `{namespace}`.`{name}` ({columns}) using parquet")
        return missing

    def drop_table(self, namespace: str, name: str) -> None:
        self.spark.sql(f"drop table if exists `{namespace}`.`{name}`")

    def tables(self, namespace: str) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(namespace) if not t.isTemporary)

    def stage_and_insert(self, rows: DataFrame, namespace: str, name: str) -> None:
        """Insert by position through a staging view, which goes again."""
        target = f"`{namespace}`.`{name}`"
        columns = [c.name for c in self.spark.catalog.listColumns(target)]
        rows.select(*columns).createOrReplaceTempView(view := f"staged_{namespace}_{name}")
        try:
            self.spark.sql(f"insert into {target} select * from {view}")
        finally:
            self.spark.catalog.dropTempView(view)


def create_publication(publications: DataFrame, members: DataFrame, name: str, table_ids: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """Both tables with a publication more; an existing name is an error when
    it runs."""
    spark = publications.sparkSession
    new = spark.createDataFrame([(name,)], "publication string")
    clash = publications.where(F.col("publication") == name).select(F.raise_error(F.lit(f"publication {name} exists")).cast("string").alias("publication"))
    return publications.unionByName(clash).unionByName(new), add_tables(members, name, table_ids)


def add_tables(members: DataFrame, name: str, table_ids: Sequence[int]) -> DataFrame:
    rows = members.sparkSession.createDataFrame([(name, i) for i in table_ids], "publication string, table_id long")
    return members.unionByName(rows).distinct()


def drop_tables(members: DataFrame, name: str, table_ids: Sequence[int] | None = None) -> DataFrame:
    """Without some of a publication's tables, or all of them."""
    gone = F.col("publication") == name
    return members.where(~(gone if table_ids is None else gone & F.col("table_id").isin(*table_ids)))


def list_publications(publications: DataFrame, members: DataFrame, tables: DataFrame) -> DataFrame:
    """Each publication with its tables, by name; those without any stay."""
    named = members.join(tables.select("table_id", "table_name"), "table_id", "left").withColumnRenamed("publication", "_p")
    return publications.join(named, F.col("publication") == F.col("_p"), "left").groupBy("publication").agg(F.count("table_id").alias("tables"), F.array_join(F.sort_array(F.collect_set("table_name")), ",").alias("names"))


def role_audit(roles: DataFrame) -> DataFrame:
    """``role, problem``: what a source role lacks to replicate; superusers
    lack nothing. ``roles``: role, superuser, replication, can_login,
    can_select (on every published table)."""
    lacks = F.array_compact(F.array(F.when(~F.col("can_login"), F.lit("login")), F.when(~F.col("replication"), F.lit("replication")), F.when(~F.col("can_select"), F.lit("select"))))
    return roles.where("not superuser").select("role", F.explode(lacks).alias("problem"))
