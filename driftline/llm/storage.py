"""Intermediate tables in the folder that driver and executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``; a table
survives the loss of any executor, unlike a local checkpoint.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows of one long column that may be broadcast: 8 MB.
BROADCAST_ROWS = 1_000_000


_SHIPPED: set[str] = set()

#: Sizes of Arrow batches for columns of whole texts, where the session has
#: Spark's defaults: both ends of the pipe hold one or two of them.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "500"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4194304b")}


def ship(spark: SparkSession) -> None:
    """Make a session ready: smaller Arrow batches, and this package for the
    executors' Python workers, which need not see the driver's folders. The
    package goes once an application."""
    for key, (default, wanted) in BATCHES.items():
        if spark.conf.get(key, None) == default:
            spark.conf.set(key, wanted)
    root = Path(__file__).resolve().parents[2]
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    path = Path(os.path.realpath(tempfile.mkdtemp()), "driftline-package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((root / "driftline").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(path))
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only for a local
    session that names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        found = tempfile.mkdtemp(prefix="driftline-")
        spark.conf.set("spark.checkpoint.dir", found)
        return found
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def application_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/driftline/{spark.sparkContext.applicationId}"


def forget(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application. Results read from
    them lazily, so call it when those have been written."""
    delete(spark, application_dir(spark))


class Workspace:
    """Named Parquet tables of one run, below one folder of its own."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.root = f"{application_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return a DataFrame that reads it back."""
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._driftline_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        for df in tables:
            delete(self.spark, df._driftline_path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def with_rows_bounded(spark: SparkSession, df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``limit`` rows: a count of partial counts, as
    a limit would gather its rows in one task."""
    return df.count() <= limit


def small_or_shuffled(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it is proven to have few rows, else left
    for a shuffled join. The rows of the result are the same either way."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if with_rows_bounded(df.sparkSession, df, limit) else df


def give_back() -> None:
    """Return free memory to the system, which the allocators of Python and
    Arrow would keep."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def giving_back(run):
    """``run`` over Arrow batches, in a Python worker that serves the tasks of
    all operators one after the other: what the task before has freed goes
    back to the system first, and what ``run`` has freed at its end, so an
    executor's memory follows the tasks that run and not all that have run."""

    def tidy(batches):
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidy


def beside_rows(docs: DataFrame, id_col: str, whole_rows: bool, columns: list, run, found: str) -> DataFrame:
    """``run`` over batches of an opaque first column and ``columns``, which
    it returns first again, beside columns of the DDL ``found``. The first
    column is the id as ``doc_id``, or a struct ``row`` of all columns."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import StructType

    first = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row") if whole_rows else F.col(id_col).cast("long").alias("doc_id")
    given = docs.select(first, *(c.alias(f"_{i}") for i, c in enumerate(columns)))
    return given.mapInArrow(giving_back(run), StructType([given.schema[0], *StructType.fromDDL(found)]))


#: Rows of one key that go to one task of a join before they are split.
HOT_ROWS = 100_000


def join_hot(work: Workspace, left: DataFrame, right: DataFrame, key: str, spread: list[str], most: int = HOT_ROWS, counted: DataFrame | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """``left`` left-joined to ``right``, which has one row for each ``key``.

    Keys of more than ``most`` rows are split into parts by a hash of the
    ``spread`` columns, and their one row of ``right`` is repeated for each
    part; there are at most rows/most such keys. ``counted`` has the keys of
    ``left`` where that would be costly to count, ``sizes`` their numbers of
    rows (``rows``) where they are known. Null keys join nothing and are dealt
    out by ``spread`` too."""
    from pyspark.sql import functions as F

    if sizes is None:
        sizes = (left if counted is None else counted).where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("rows"))
    hot = work.write(sizes.where(F.col("rows") > most).select(key, F.expr(f"1 + rows div {most}").alias("_parts")), "hot")
    if not hot.count():
        return left.join(right, key, "left")
    hot = small_or_shuffled(hot)
    parts = F.coalesce("_parts", F.lit(1).cast("long"))
    cut = left.join(hot, key, "left").withColumn("_part", F.when(F.col(key).isNull(), F.xxhash64(*spread)).otherwise(F.pmod(F.xxhash64(*spread), parts))).drop("_parts")
    whole = right.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")
    return cut.join(whole, [key, "_part"], "left").drop("_part")
