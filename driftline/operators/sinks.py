"""Forms in which a change log is materialised, as projections of the log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.lsn import hex16
from driftline.functions.names import unique_name
from driftline.functions.values import typed_zero

WORDS = {"I": "INSERT", "U": "UPDATE", "D": "DELETE"}


def operation_word(op: Column, lower: bool = False) -> Column:
    out = F.when(op == "I", "INSERT").when(op == "U", "UPDATE").when(op == "D", "DELETE")
    return F.lower(out) if lower else out


def key_delete_row(columns: Sequence[tuple[str, str, bool]], keys: Sequence[str]) -> list[Column]:
    """A row of full width for events that carry keys alone (deletes): keys as
    they are, other columns NULL, or the type's zero if they can't be.
    ``columns``: (name, Spark type, nullable)."""
    return [F.col(n) if n in keys else F.when(F.col("op") == "D", typed_zero(t, null)).otherwise(F.col(n)).alias(n) for n, t, null in columns]


#: Images of a delete that a destination can use.
DELETE_IMAGES = {"bigquery": ("full", "key"), "clickhouse": ("full", "key"), "iceberg": ("full",), "snowflake": ("full", "key")}


def image_rejected(destination: str) -> Column:
    """Whether a destination can't take an event: an insert or update whose
    ``new_kind`` isn't full, or a delete whose ``old_kind`` it can't use."""
    lacks_new = F.col("op").isin("I", "U") & ~F.col("new_kind").eqNullSafe("full")
    return lacks_new | ((F.col("op") == "D") & ~F.coalesce(F.col("old_kind").isin(*DELETE_IMAGES[destination]), F.lit(False)))


def strict_images(log: DataFrame, destination: str) -> DataFrame:
    """The log as it is; running it raises on an event that the destination
    can't take."""
    message = F.concat(F.lit(f"{destination}: operation "), F.col("op"), F.lit(" with new image "), F.coalesce("new_kind", F.lit("none")), F.lit(" and old image "), F.coalesce("old_kind", F.lit("none")))
    return log.where(F.when(image_rejected(destination), F.raise_error(message)).otherwise(F.lit(True)))


def json_absent(columns: Sequence[str], keys: Sequence[str]) -> Column:
    """Names that the images of an event lack, as JSON objects: ``new`` of an
    insert or update must have every column, ``old`` of a delete, or where an
    update has one, every key. A null value is a value; an absent one isn't."""
    lacks = lambda image, names: F.array_except(F.array(*map(F.lit, names)), F.coalesce(F.json_object_keys(image), F.array().cast("array<string>")))
    new = F.when(F.col("op").isin("I", "U"), lacks("new", columns))
    old = F.when((F.col("op") == "D") | ((F.col("op") == "U") & F.col("old").isNotNull()), lacks("old", keys))
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(new, none), F.coalesce(old, none))


def absent_message(absent: Column) -> Column:
    return F.concat(F.lit("partial image: operation "), F.col("op"), F.lit(" lacks "), F.array_join(absent, ", "))


def strict_json_images(log: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """The same as :func:`strict_images` for images as JSON objects."""
    absent = json_absent(columns, keys)
    return log.where(F.when(F.size(absent) > 0, F.raise_error(absent_message(absent))).otherwise(F.lit(True)))


def strict_parsed_op(columns: Sequence[str], keys: Sequence[str], new: str, old: str) -> Column:
    """The operation, or the same error, where ``new`` and ``old`` have been
    parsed into the columns of those names. A name that an image lacks is null
    there, so texts are read for their names only beside a null."""
    null = lambda image, names: F.greatest(*[F.col(f"{image}.{c}").isNull() for c in names], F.lit(False))
    doubtful = F.when(F.col("op") == "D", null(old, keys)).otherwise(null(new, columns) | (F.col("old").isNotNull() & null(old, keys)))
    absent = json_absent(columns, keys)
    return F.when(F.when(doubtful, F.size(absent) > 0).otherwise(F.lit(False)), F.raise_error(absent_message(absent)).cast("string")).otherwise(F.col("op"))


def audit_log(log: DataFrame, columns: Sequence[tuple[str, str, bool]], keys: Sequence[str]) -> DataFrame:
    """Append-only: user columns, ``cdc_operation`` and ``cdc_lsn``."""
    return log.select(*key_delete_row(columns, keys), operation_word(F.col("op")).alias("cdc_operation"), F.col("commit_lsn").alias("cdc_lsn"))


def versioned_rows(legs: DataFrame, keys: Sequence[str], values: Sequence[str], commit: str, ordinal: str) -> DataFrame:
    """Append-only with a version, the 128-bit sequence as fixed hex, and a
    tombstone flag; a reader keeps the highest version of a key."""
    version = F.concat(hex16(F.col(commit)), hex16(F.col(ordinal)))
    return legs.select(*keys, *values, version.alias("_version"), "sub", F.col("deleted").cast("int").alias("_deleted"))


def current_view(rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """User columns of the live rows of a versioned table."""
    last = rows.groupBy(*keys).agg(F.max_by(F.struct("_deleted", *values), F.struct("_version", "sub")).alias("last"))
    return last.where("last._deleted = 0").select(*keys, *(F.col(f"last.{v}") for v in values))


def changelog(log: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every image with its operation and sequence; the added columns step
    aside for user columns of the same name."""
    taken = set(columns)
    op, seq = (unique_name(n, taken) for n in ("cdc_operation", "sequence_number"))
    return log.select(*columns, operation_word(F.col("op")).alias(op), F.col("seq").alias(seq))


def upsert_rows(legs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Upserts and deletes with the three-part change sequence number."""
    seq = F.concat(F.col("seq"), F.lit("/"), hex16(F.col("sub")))
    return legs.select(*columns, F.when(F.col("deleted"), "DELETE").otherwise("UPSERT").alias("_change_type"), seq.alias("_change_sequence_number"))


def json_rows(log: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """One JSON object per event, operation in lower case; a delete has its
    keys and NULLs."""
    fields = [F.col(c) if c in keys else F.when(F.col("op") != "D", F.col(c)).alias(c) for c in columns]
    row = F.struct(*fields, operation_word(F.col("op"), True).alias("_cdc_operation"), F.col("seq").alias("_cdc_sequence_number"))
    return log.select(F.to_json(row, {"ignoreNullFields": "false"}).alias("row"), F.col("seq").alias("offset_token"))


class VersionedTable:
    """A table as numbered directories with one live version.

    A batch writes version n+1 whole and only then moves the manifest and the
    view, so a reader sees one version or the other, and a failed write leaves
    nothing behind that anyone reads. The manifest is a one-row Parquet table
    per version; the newest complete one counts.
    """

    def __init__(self, spark: SparkSession, root: str, view: str):
        self.spark, self.root, self.view = spark, root.rstrip("/"), view

    def _manifest(self) -> DataFrame | None:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema("version long, batch_id long, applied string").parquet(f"{self.root}/manifest")
        except AnalysisException:
            return None

    def head(self):
        """Row (version, batch_id, applied) that is live, or None."""
        found = self._manifest()
        rows = found.orderBy(F.desc("version")).limit(1).collect() if found is not None else []
        return rows[0] if rows else None

    def read(self, schema=None) -> DataFrame:
        live = self.head()
        if live is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.root}/v{live.version}")

    def publish(self, rows: DataFrame, batch_id: int | None = None, applied: str | None = None) -> int:
        """Write the next version and make it live; gives its number."""
        live = self.head()
        version = 1 if live is None else live.version + 1
        rows.write.mode("overwrite").parquet(f"{self.root}/v{version}")
        entry = self.spark.range(1).select(F.lit(version).cast("long").alias("version"), F.lit(batch_id).cast("long").alias("batch_id"), F.lit(applied).cast("string").alias("applied"))
        entry.coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")
        self.spark.read.parquet(f"{self.root}/v{version}").createOrReplaceTempView(self.view)
        return version

    def truncate(self, batch_id: int | None = None, applied: str | None = None) -> int:
        """An empty next version; the old one stays until it is dropped."""
        return self.publish(self.read().limit(0), batch_id, applied)

    def drop_versions_before(self, keep: int) -> None:
        """Delete the directories of versions below ``keep`` and not live."""
        live = self.head()
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for version in range(1, min(keep, live.version if live else 0)):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/v{version}")
            path.getFileSystem(conf).delete(path, True)


class BucketedTable:
    """A keyed table in hash buckets, of which a batch rewrites those it touches.

    The manifest's newest row maps each bucket to the version that holds it, so
    publishing costs what the batch touches and not what the table holds, and a
    reader sees one manifest or the other. Buckets are columns of the files'
    paths: a read of some buckets opens no other.
    """

    MANIFEST = "version long, batch_id long, applied string, buckets map<int,long>"

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], schema: str, buckets: int = 64):
        self.spark, self.root, self.keys, self.schema, self.buckets = spark, root.rstrip("/"), list(keys), schema, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def head(self):
        from pyspark.errors import AnalysisException

        try:
            rows = self.spark.read.schema(self.MANIFEST).parquet(f"{self.root}/manifest").orderBy(F.desc("version")).limit(1).collect()
        except AnalysisException:
            return None
        return rows[0] if rows else None

    def read(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """The live rows, of all buckets or of some."""
        live = self.head()
        held = {} if live is None else {b: v for b, v in live.buckets.items() if buckets is None or b in set(buckets)}
        if not held:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.root}/data/v{v}/bucket={b}" for b, v in sorted(held.items())))

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets of the rows' keys: as many numbers as buckets at most."""
        return [r[0] for r in rows.select(self.bucket()).distinct().collect()]

    def publish(self, rows: DataFrame, touched: Sequence[int], batch_id: int | None = None, applied: str | None = None) -> int:
        """Make ``rows`` all that the touched buckets hold."""
        live = self.head()
        version = 1 if live is None else live.version + 1
        path = f"{self.root}/data/v{version}"
        rows.withColumn("bucket", self.bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        full = {r[0] for r in self.spark.read.schema(f"{self.schema}, bucket int").parquet(path).select("bucket").distinct().collect()}
        held = {b: v for b, v in (live.buckets if live else {}).items() if b not in set(touched)} | dict.fromkeys(full, version)
        entry = self.spark.range(1).select(F.lit(version).cast("long").alias("version"), F.lit(batch_id).cast("long").alias("batch_id"), F.lit(applied).cast("string").alias("applied"), F.expr("map_from_entries(array(" + ", ".join(f"struct({b}, {v}L)" for b, v in sorted(held.items())) + "))" if held else "cast(map() as map<int,bigint>)").alias("buckets"))
        entry.coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")
        return version

    def drop_unreferenced(self, keep: int = 2) -> list[int]:
        """Delete versions that no bucket lives in, but the newest ``keep``."""
        live = self.head()
        used = set(live.buckets.values()) if live else set()
        jvm, conf, gone = self.spark._jvm, self.spark._jsc.hadoopConfiguration(), []
        for version in range(1, (live.version if live else 0) - keep + 1):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/data/v{version}")
            if version not in used and path.getFileSystem(conf).delete(path, True):
                gone.append(version)
        return gone


def write_chunked(rows: DataFrame, path: str, rows_per_file: int = 1_000_000, codec: str = "zstd") -> None:
    """Append Parquet files of bounded size."""
    rows.write.mode("append").option("maxRecordsPerFile", rows_per_file).option("compression", codec).parquet(path)


def discard(rows: DataFrame) -> None:
    """Run a plan and keep nothing; for measuring."""
    rows.write.format("noop").mode("overwrite").save()
