"""Names of destination objects, identifiers, slots and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes of replication slots.
APPLY_SLOT, SYNC_SLOT = "driftline_apply_", "driftline_table_sync_"


def destination_name(schema: Column, table: Column) -> Column:
    """``schema_table`` with inner underscores doubled, so that no two tables
    share a name; NULL for names that are empty or begin or end in ``_``."""
    good = lambda x: (x != "") & ~x.startswith("_") & ~x.endswith("_")
    twice = lambda x: F.replace(x, F.lit("_"), F.lit("__"))
    return F.when(good(schema) & good(table), F.concat(twice(schema), F.lit("_"), twice(table)))


def namespace(schema: Column) -> Column:
    """Lower case, anything outside ``[a-z0-9_]`` as ``_``, and a name that
    begins with a reserved prefix set apart by ``s_``."""
    clean = F.regexp_replace(F.lower(schema), "[^a-z0-9_]", "_")
    return F.when(clean.startswith("aws"), F.concat(F.lit("s_"), clean)).otherwise(clean)


def unique_name(wanted: str, taken: set[str]) -> str:
    """``wanted``, or with the first free suffix ``_1``, ``_2`` ..."""
    name, n = wanted, 0
    while name in taken:
        n += 1
        name = f"{wanted}_{n}"
    return name


def quote_identifier(name: str, mark: str = '"') -> str:
    return f"{mark}{name.replace(mark, mark * 2)}{mark}"


def quote_literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def slot_name(pipeline_id: int, table_id: int | None = None) -> str:
    return f"{APPLY_SLOT}{pipeline_id}" if table_id is None else f"{SYNC_SLOT}{pipeline_id}_{table_id}"


def parse_slot(name: Column) -> tuple[Column, Column]:
    """Pipeline id, and table id of a table-sync slot, of a slot's name."""
    apply, sync = f"^{APPLY_SLOT}(\\d+)$", f"^{SYNC_SLOT}(\\d+)_(\\d+)$"
    number = lambda pattern, n: F.nullif(F.regexp_extract(name, pattern, n), F.lit("")).cast("bigint")
    return F.coalesce(number(apply, 1), number(sync, 1)), number(sync, 2)


def size_bytes(text: Column) -> Column:
    """Bytes of a size such as ``500MB``: a whole number and a decimal unit."""
    units = F.create_map(*[F.lit(x) for k, unit in enumerate(("B", "KB", "MB", "GB", "TB")) for x in (unit, 1000**k)])
    pattern = r"^\s*(\d+)\s*([KMGT]?B)\s*$"
    return F.when(F.upper(text).rlike(pattern), F.regexp_extract(F.upper(text), pattern, 1).try_cast("bigint") * units[F.regexp_extract(F.upper(text), pattern, 2)])


def server_version(text: Column) -> Column:
    """``major * 10000 + minor * 100 + patch`` of a version text."""
    part = lambda n: F.coalesce(F.nullif(F.regexp_extract(text, r"^(\d+)(?:\.(\d+))?(?:\.(\d+))?", n), F.lit("")).cast("int"), F.lit(0))
    return F.when(text.rlike(r"^\d+"), part(1) * 10000 + part(2) * 100 + part(3))


def wal_status(text: Column) -> Column:
    return F.when(text.isin("reserved", "extended", "unreserved", "lost"), text).otherwise("unknown")


def error_class(sqlstate: Column) -> Column:
    """Whether an error means that the database can't be reached now."""
    away = sqlstate.startswith("08") | sqlstate.startswith("57P0") | (sqlstate == "53300")
    return F.when(away, "unavailable").when(sqlstate.startswith("28"), "authentication").otherwise("other")
