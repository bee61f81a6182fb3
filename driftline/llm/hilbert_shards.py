"""Shards as runs of a Hilbert curve over metadata, in native expressions.

Several dimensions are quantised, the cells are ordered along a Hilbert curve,
and the order is cut into runs of equal row counts, so that each file covers a
compact box of every dimension and scans can skip it by its statistics.

A row's global rank is the start of its bucket plus its place in it. Buckets
are cells, or hashed parts of a cell that holds many rows, so no sort sees more
than a bounded share of the table, whatever one cell holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import Workspace

BITS = 5
#: A cell with more than 1/PARTS of the rows is split into hashed parts.
PARTS = 1024


def _gray(x: int) -> int:
    return x ^ (x >> 1)


def _trailing_ones(x: int) -> int:
    return 0 if not x & 1 else 1 + _trailing_ones(x >> 1)


def hilbert_index(axes: list[Column], bits: int = BITS) -> Column:
    """Position on the Hilbert curve of integer coordinates below 2**bits.

    Level by level from the highest bit, the cell's corner is read in the frame
    of the current entry point and direction; both follow from the corner.
    """
    n = len(axes)
    full = (1 << n) - 1
    inverse = [0] * (1 << n)
    for w in range(1 << n):
        inverse[_gray(w)] = w
    entry = [0 if w == 0 else _gray(2 * ((w - 1) // 2)) for w in range(1 << n)]
    turn = [0 if w == 0 else _trailing_ones(w - 1 if w % 2 == 0 else w) % n for w in range(1 << n)]
    of = lambda table, at: F.element_at(F.array(*map(F.lit, table)), at + 1)

    def right(x: Column, by: Column) -> Column:
        """x rotated right by ``by`` of n bits: one branch for each amount."""
        out = x
        for k in range(1, n):
            out = F.when(by == k, F.shiftright(x, k).bitwiseOR(F.shiftleft(x, n - k)).bitwiseAND(F.lit(full))).otherwise(out)
        return out

    def step(state: Column, level: Column) -> Column:
        corner = F.lit(0)
        for k, axis in enumerate(axes):
            bit = F.pmod(F.floor(axis / F.pow(F.lit(2.0), level)).cast("int"), F.lit(2))
            corner = corner.bitwiseOR(F.shiftleft(bit, k))
        by = F.pmod(state["turn"] + 1, F.lit(n))
        w = of(inverse, right(corner.bitwiseXOR(state["entry"]), by))
        return F.struct(
            (state["index"] * F.lit(1 << n) + w).cast("long").alias("index"),
            state["entry"].bitwiseXOR(right(of(entry, w), F.pmod(F.lit(n) - by, F.lit(n)))).cast("int").alias("entry"),
            F.pmod(state["turn"] + of(turn, w) + 1, F.lit(n)).cast("int").alias("turn"),
        )

    start = F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).alias("entry"), F.lit(0).alias("turn"))
    return F.aggregate(F.array(*(F.lit(k) for k in range(bits - 1, -1, -1))), start, step)["index"]


def _coded(work: Workspace, rows: DataFrame, name: str) -> Column:
    """The quantised rank of column ``name`` among its distinct values, nulls
    first. The values are ranked by ranges, so their number is no matter; what
    comes to the driver is the first value of each of the 2**BITS codes."""
    values = rows.select(F.col(name).alias("value")).distinct()
    ranges = work.write(values.repartitionByRange(F.col("value").asc_nulls_first()).withColumn("part", F.spark_partition_id()), "values")
    sizes = ranges.groupBy("part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    sizes = sizes.select("part", before.alias("before"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("values"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("value").asc_nulls_first())) - 1
    ranked = ranges.join(F.broadcast(sizes), "part").withColumn("place", F.col("before") + place)  # a row for each range
    code = F.floor(F.col("place") * (1 << BITS) / F.col("values")).cast("int")
    cuts = ranked.where("value is not null").groupBy(code.alias("code")).agg(F.min("value").alias("first")).orderBy("code").collect()
    out = F.lit(0)
    for r in cuts:
        out = F.when(F.col(name) >= F.lit(r["first"]), r["code"]).otherwise(out)
    return out


def hilbert_shards(spark: SparkSession, docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", dimensions: tuple[str, ...] = ("lang", "source"), carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` and
    ``curve`` (the cell's index) for every row, and a struct ``row`` of the
    columns ``carry`` if there are any.

    The curve runs over ``dimensions`` and the logarithm of the size. Law
    ``rows``: shard counts differ by one at most. Nulls in a dimension form a
    value of their own; a null text has size 1 and the checksum of nothing. A
    null or repeated doc_id is one more row; rows equal in every column are
    interchangeable. ``grown_shard`` is null under this law. Texts are measured
    whole, however long; other columns are ignored, whatever their names. An
    empty table gives an empty one.
    """
    work = Workspace(spark, "shards")
    text = F.coalesce(F.col(text_col), F.lit(""))
    carried = [F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row")] if carry else []
    more = ["row"] if carry else []
    rows = work.write(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            *(F.col(c).cast("string").alias(f"dim_{i}") for i, c in enumerate(dimensions)), *carried,
        ),
        "rows",
    )
    names = [f"dim_{i}" for i in range(len(dimensions))]
    rows = rows.withColumns({name: _coded(work, rows, name) for name in names})
    rows = rows.withColumn("log_size", F.least(F.lit((1 << BITS) - 1), F.floor(F.log2(F.col("size").cast("double"))).cast("int")))
    axes = [*names, "log_size"]
    cells = rows.groupBy(*axes).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    cells = work.write(cells.withColumns({"curve": hilbert_index([F.col(c) for c in axes]), "parts": F.greatest(F.lit(1), F.ceil(F.col("n") * PARTS / total)).cast("long"), "total": total}), "cells")
    #: At most 2**(BITS * axes) cells, then PARTS more buckets: both bounded.
    placed = rows.join(F.broadcast(cells.drop("n")), axes).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")))
    placed = work.write(placed.select("doc_id", "size", "text_crc32", "curve", "part", "total", *more), "placed")
    buckets = placed.groupBy("curve", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("curve", "part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    buckets = work.write(buckets.select("curve", "part", before.alias("before")), "buckets")
    place = F.row_number().over(Window.partitionBy("curve", "part").orderBy("doc_id", "size", "text_crc32"))
    ranked = placed.join(F.broadcast(buckets), ["curve", "part"]).withColumn("rank", F.col("before") + place - 1)
    shard = F.expr(f"(rank * {shards}) div total")
    begin = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return ranked.withColumn("shard", shard).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("rank") - begin).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve", *more)


def write_shards(spark: SparkSession, docs: DataFrame, path: str, shards: int = 16, **options) -> None:
    """Write ``docs`` with all of its columns, a folder for each shard, in the
    order of the curve, so that a scan passes over files and row groups by
    their statistics."""
    found = hilbert_shards(spark, docs, shards, carry=tuple(docs.columns), **options)
    found = found.select("row.*", F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    found.repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot").drop("_slot").write.partitionBy("_shard").parquet(path)
