"""Versioned table schemas: columns are their ordinal, never their name."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.operators.apply import last_known


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    ordinal: int
    key_position: int | None = None
    nullable: bool = True
    default: str | None = None
    modifier: int = -1


@dataclass(frozen=True)
class TableSchema:
    table_id: int
    schema: str
    name: str
    columns: tuple[Column, ...]
    snapshot: int = 0

    def replicated(self, names: Iterable[str] | None = None) -> tuple[Column, ...]:
        """Columns of a publication's list, by ordinal; all without a list. A
        name that the table doesn't have is an error."""
        ordered = tuple(sorted(self.columns, key=lambda c: c.ordinal))
        if names is None:
            return ordered
        unknown = set(names) - {c.name for c in ordered}
        if unknown:
            raise ValueError(f"unknown columns: {sorted(unknown)}")
        return tuple(c for c in ordered if c.name in set(names))

    def mask(self, names: Iterable[str] | None = None) -> tuple[bool, ...]:
        kept = set(self.replicated(names))
        return tuple(c in kept for c in sorted(self.columns, key=lambda c: c.ordinal))

    def primary_key(self) -> tuple[Column, ...]:
        """Key columns in the order of the key, which may not be the table's."""
        return tuple(sorted((c for c in self.columns if c.key_position is not None), key=lambda c: c.key_position))


def identity_columns(table: TableSchema, replicated: Sequence[Column], mode: str, index: Iterable[str] = ()) -> tuple[Column, ...]:
    """Columns of old images by replica identity: ``d`` the primary key, ``f``
    every column, ``i`` an index's columns, ``n`` none."""
    named = {"d": {c.name for c in table.primary_key()}, "f": {c.name for c in table.columns}, "i": set(index), "n": set()}[mode]
    return tuple(c for c in replicated if c.name in named)


def identity_type(table: TableSchema, replicated: Sequence[Column], identity: Sequence[Column]) -> str:
    """``primary_key``, ``full``, ``alternative_key`` or ``missing``; a table
    whose key is all of its columns counts as the first."""
    if not identity:
        return "missing"
    key = set(table.primary_key())
    if key and set(identity) == key:
        return "primary_key"
    return "full" if set(identity) == set(replicated) else "alternative_key"


def diff(old: Sequence[Column], new: Sequence[Column]) -> dict[str, list]:
    """Columns added, removed and changed, matched and listed by ordinal.
    A change is a rename or another nullability or default; a change of type
    alone is part of the new version and not of the diff."""
    before, after = {c.ordinal: c for c in old}, {c.ordinal: c for c in new}
    both = sorted(before.keys() & after.keys())
    same = lambda a, b: replace(a, type="", modifier=0, key_position=None) == replace(b, type="", modifier=0, key_position=None)
    return {"added": [after[o] for o in sorted(after.keys() - before.keys())], "removed": [before[o] for o in sorted(before.keys() - after.keys())], "changed": [(before[o], after[o]) for o in both if not same(before[o], after[o])]}


#: Order in which each kind of sink takes the steps of a diff.
STEPS = {"upsert": ("add", "rename", "change", "drop"), "audit": ("add", "rename", "default", "drop"), "lake": ("drop", "rename", "default", "add"), "json": ("add", "rename", "drop")}


def plan_steps(old: Sequence[Column], new: Sequence[Column], sink: str) -> list[tuple[str, str, str | None]]:
    """(step, column, new name or value) in the sink's order. A lake sink sets
    a dropped column aside first where its name is used again."""
    d, out = diff(old, new), []
    for step in STEPS[sink]:
        if step == "add":
            out += [("add", c.name, c.type) for c in d["added"]]
        elif step == "drop":
            again = {c.name for c in new}
            out += [("set_aside", c.name, f"__dropped_{c.name}_{c.ordinal}") if sink == "lake" and c.name in again else ("drop", c.name, None) for c in d["removed"]]
        elif step == "rename":
            out += [("rename", a.name, b.name) for a, b in d["changed"] if a.name != b.name]
        else:
            out += [("default", b.name, b.default) for a, b in d["changed"] if a.default != b.default]
            if step == "change":
                out += [("nullable", b.name, str(b.nullable).lower()) for a, b in d["changed"] if a.nullable != b.nullable]
    return out


def reject_key_changes(table: TableSchema, old: Sequence[Column], new: Sequence[Column]) -> None:
    """A sink that orders by the primary key can't drop or rename its parts."""
    d, key = diff(old, new), {c.ordinal for c in table.primary_key()}
    bad = [c.name for c in d["removed"] if c.ordinal in key] + [a.name for a, b in d["changed"] if a.ordinal in key and a.name != b.name]
    if bad:
        raise ValueError(f"key columns can't be dropped or renamed: {bad}")


def physical_name(c: Column) -> str:
    """Stable storage name, so that a name used again is another column."""
    return f"c_{c.ordinal}"


def stored(rows: DataFrame, columns: Sequence[Column]) -> DataFrame:
    """Rows under physical names."""
    return rows.select(*[F.col(c.name).alias(physical_name(c)) for c in columns])


def as_version(rows: DataFrame, columns: Sequence[Column], types: dict[str, str]) -> DataFrame:
    """Stored rows, of any version, seen through one version: columns it has
    and the files don't are NULL (adding a default changes no old row)."""
    have = set(rows.columns)
    return rows.select(*[(F.col(physical_name(c)) if physical_name(c) in have else F.lit(None)).cast(types[c.type]).alias(c.name) for c in columns])


def missing_columns(columns: Sequence[Column], physical: Iterable[str]) -> list[str]:
    return [c.name for c in columns if c.name not in set(physical)]


def check_relation(mode: str, known: int, arriving: int) -> str:
    """What a sink does with a relation message of another version: ``error``
    and ``skip`` concern older ones, ``reject`` any change, ``apply`` none."""
    if arriving == known:
        return "same"
    if mode == "reject" or (mode == "error" and arriving < known):
        raise ValueError("a relation of a version that this sink can't go to")
    return "skip" if mode == "skip" and arriving < known else "apply"


def flagged_names(columns):
    """Names of a relation message's columns whose identity flag is set."""
    return F.transform(F.filter(columns, lambda c: c["flags"].bitwiseAND(F.lit(1)) == 1), lambda c: c["name"])


def as_of(events: DataFrame, versions: DataFrame, at: str = "commit_lsn", exact: bool = False) -> DataFrame:
    """Each event's newest schema version at or before it, by one sorted pass
    over both: a version row precedes the events it governs, and the last one
    seen is carried on; a long table's log is sorted in stretches. No range join. With ``exact``, events without a version
    at their own position are left out, as right after a schema change."""
    marks = versions.select("table_id", F.col("snapshot_id").alias("_at"), F.col("snapshot_id").alias("_version"), F.lit(0).alias("_event"), *[F.lit(None).cast(t).alias(c) for c, t in events.dtypes if c not in ("table_id",)])
    rows = events.select("table_id", F.col(at).alias("_at"), F.lit(None).cast(dict(versions.dtypes)["snapshot_id"]).alias("_version"), F.lit(1).alias("_event"), *[c for c in events.columns if c != "table_id"])
    out = last_known(marks.unionByName(rows), "table_id", ["_at", "_event"], F.col("_version"), "snapshot_id", F.col("_at")).where("_event = 1")
    return (out.where(F.col("snapshot_id") == F.col("_at")) if exact else out).select(*events.columns, "snapshot_id")


def as_of_broadcast(events: DataFrame, versions: DataFrame, at: str = "commit_lsn", limit: int = 100_000) -> DataFrame:
    """The same for few versions (checked): each table's versions become one
    sorted array beside its events, so events aren't exchanged at all."""
    if versions.count() > limit:
        return as_of(events, versions, at)
    by_table = versions.groupBy("table_id").agg(F.sort_array(F.collect_set("snapshot_id")).alias("_versions"))
    return events.join(F.broadcast(by_table), "table_id", "left").withColumn("snapshot_id", F.try_element_at(F.filter("_versions", lambda v: v <= F.col(at)), F.lit(-1))).drop("_versions")


def prune_versions(versions: DataFrame, bounds: DataFrame) -> DataFrame:
    """Versions to keep: of each table the newest at or before its retention
    bound, and all later ones; tables without a bound keep all."""
    base = versions.join(bounds, "table_id").where("snapshot_id <= retain_lsn").groupBy("table_id").agg(F.max("snapshot_id").alias("_base"))
    return versions.join(base, "table_id", "left").where("_base is null or snapshot_id >= _base").drop("_base")


def diff_frames(old: DataFrame, new: DataFrame) -> DataFrame:
    """:func:`diff` over tables of columns ``(ordinal, name, nullable,
    default_expression)``: one row for each difference."""
    a = old.select("ordinal", *[F.col(c).alias(f"old_{c}") for c in ("name", "nullable", "default_expression")], F.lit(True).alias("_old"))
    b = new.select("ordinal", *[F.col(c).alias(f"new_{c}") for c in ("name", "nullable", "default_expression")], F.lit(True).alias("_new"))
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed")
    same = F.lit(True)
    for c in ("name", "nullable", "default_expression"):
        same = same & F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    both = a.join(b, "ordinal", "full_outer").withColumn("change", kind.when(~same, "changed").otherwise("same"))
    return both.where("change <> 'same'").select("ordinal", "change", "old_name", "new_name")
