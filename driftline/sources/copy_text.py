"""COPY text captures and JDBC snapshots as typed DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.decode import copy_fields, copy_values, decode


def decode_copy(lines: DataFrame, columns: Sequence[tuple[str, str]], line: str = "value", with_bytes: bool = False, strict: bool = True) -> DataFrame:
    """Rows of a COPY text stream, one line each. ``columns``: (name, Postgres
    type) in order. ``with_bytes`` adds the wire size of each row, its line
    break included."""
    wire = (F.octet_length(line) + 1).cast("long").alias("wire_bytes")
    fields = lines.select(F.col(line).alias("line"), copy_fields(F.col(line), len(columns)).alias("f"), *([wire] if with_bytes else []))
    values, escaped = copy_values(F.col("line"), F.col("f"))
    fields = fields.select(values.alias("f"), escaped.alias("escaped"), *(["wire_bytes"] if with_bytes else []))
    #: A NULL mark is one still where nothing was resolved; else it is NULL by now.
    texts = fields.select(*[F.when(F.col("escaped") | (F.col("f")[i] != "\\N"), F.col("f")[i]).alias(f"f{i}") for i in range(len(columns))], *(["wire_bytes"] if with_bytes else []))
    typed = [decode(F.col(f"f{i}"), t, strict=strict).alias(n) for i, (n, t) in enumerate(columns)]
    return texts.select(*typed, *(["wire_bytes"] if with_bytes else []))


def read_copy(spark: SparkSession, path: str, columns: Sequence[tuple[str, str]], **options) -> DataFrame:
    """Captured COPY files; a line break inside a value is escaped in them, so
    files split at any line."""
    return decode_copy(spark.read.option("lineSep", "\n").text(path), columns, **options)


def copy_query(table: str, columns: Sequence[str], row_filter: str | None = None) -> str:
    """The statement of a snapshot scan: projection and filter at the source."""
    where = f" where ({row_filter})" if row_filter else ""
    return f"select {', '.join(columns)} from {table}{where}"


def range_predicates(bounds: Sequence[tuple[int | None, int | None]], key: str = "ctid_block") -> list[str]:
    """One half-open range for each partition, the first and last without a
    bound, so that rows beyond a stale estimate are still read."""
    parts = []
    for low, high in bounds:
        ends = ([f"{key} >= {low}"] if low is not None else []) + ([f"{key} < {high}"] if high is not None else [])
        parts.append(" and ".join(ends) or "true")
    return parts


def read_jdbc(spark: SparkSession, url: str, table: str, columns: Sequence[str], predicates: Sequence[str] | None = None, row_filter: str | None = None, snapshot: str | None = None, **properties: str) -> DataFrame:
    """A live table: a connection per predicate, all in one exported snapshot."""
    options = dict(properties)
    if snapshot:
        options["sessionInitStatement"] = f"set transaction isolation level repeatable read; set transaction snapshot '{snapshot}'"
    source = f"({copy_query(table, columns, row_filter)}) as source"
    return spark.read.jdbc(url, source, predicates=list(predicates) if predicates else None, properties=options)


def should_copy(mode: str, table_id: int, tables: Sequence[int] = ()) -> bool:
    """Whether a table's rows are copied at first: all, none, include or skip."""
    return {"all": True, "none": False, "include": table_id in tables, "skip": table_id not in tables}[mode]


def union_ranges(rows: DataFrame, key: str, bounds: Sequence[tuple[int | None, int | None]]) -> DataFrame:
    """The range scans of a table, put together again: one scan with a label,
    as a file source splits by bytes and needs no predicate per task."""
    label = F.lit(None).cast("int")
    for i, (low, high) in enumerate(bounds):
        inside = (F.col(key) >= low if low is not None else F.lit(True)) & (F.col(key) < high if high is not None else F.lit(True))
        label = F.when(inside, i).otherwise(label)
    return rows.withColumn("partition", label)


def bulk_fill(spark: SparkSession, rows: int, tables: int) -> DataFrame:
    """Generated rows for load tests, dealt over so many tables; every task
    makes its own."""
    return spark.range(rows).select((F.col("id") % tables).alias("table_id"), "id", F.concat(F.lit("row "), F.col("id").cast("string")).alias("payload"))
