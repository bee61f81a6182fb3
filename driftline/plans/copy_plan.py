"""Planning of parallel snapshot copies: how many ranges, of which table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges per connection, rows per range, and the most ranges.
PER_CONNECTION, ROWS_PER_RANGE, MOST_RANGES = 4, 250_000, 1024


def target_ranges(connections: int, rows: int) -> int:
    """Ranges that a table copy aims at."""
    if connections <= 1:
        return 1
    return max(1, min(MOST_RANGES, max(PER_CONNECTION * connections, -(-max(rows, 0) // ROWS_PER_RANGE))))


def block_ranges(blocks: int, n: int) -> list[tuple[int | None, int | None]]:
    """``min(n, blocks)`` proportional half-open ranges; the outer ends open."""
    n = min(n, blocks)
    if n <= 1:
        return [(None, None)]
    edges = [i * blocks // n for i in range(n + 1)]
    return [(None if i == 0 else edges[i], None if i == n - 1 else edges[i + 1]) for i in range(n)]


def plan_copies(leaves: DataFrame, target: int) -> DataFrame:
    """Ranges of each leaf ``(root_id, table_id, blocks, rows)`` in proportion
    to its weight, largest first: rows where every leaf of the root has a
    count, else blocks. Empty leaves get none."""
    w = Window.partitionBy("root_id")
    some = leaves.where("blocks > 0")
    counted = F.min(F.coalesce(F.col("rows") > 0, F.lit(False)).cast("int")).over(w) == 1
    weighed = some.withColumn("weight", F.when(counted, F.col("rows")).otherwise(F.col("blocks")))
    share = F.ceil(F.col("weight") * target / F.sum("weight").over(w))
    out = weighed.withColumn("partitions", F.greatest(F.lit(1), F.least("blocks", share)).cast("long"))
    return out.withColumn("planned_blocks", F.ceil(F.col("blocks") / F.col("partitions")).cast("long")).select("root_id", "table_id", "weight", "partitions", "planned_blocks")


def expand_ranges(plan: DataFrame, leaves: DataFrame) -> DataFrame:
    """One row per range: ``table_id, range_no, start_block, end_block``."""
    n = F.explode(F.sequence(F.lit(0).cast("long"), F.col("partitions") - 1)).alias("range_no")
    rows = plan.join(leaves.select("table_id", "blocks"), "table_id").select("table_id", "blocks", "partitions", n)
    return rows.select("table_id", "range_no", F.expr("range_no * blocks div partitions").alias("start_block"), F.expr("(range_no + 1) * blocks div partitions").alias("end_block"))


def batch_budget(max_bytes: int, memory: int, ratio: float, streams: int) -> int:
    """Bytes of one batch, at most ``max_bytes`` and its stream's share."""
    return max(1, min(max_bytes, int(memory * ratio) // max(1, streams)))


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)
