"""Renderings and checks of values for particular sinks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIRST_DATE, LAST_DATE = "1900-01-01", "2299-12-31"


def hex_text(b: Column, upper: bool = False) -> Column:
    return F.hex(b) if upper else F.lower(F.hex(b))


def date32_days(d: Column) -> Column:
    """Days since 1970, for dates of the sink's range; others raise."""
    inside = d.between(F.lit(FIRST_DATE).cast("date"), F.lit(LAST_DATE).cast("date"))
    return F.when(d.isNull() | inside, F.unix_date(d)).otherwise(F.raise_error(F.concat(F.lit("date out of range: "), d.cast("string"))))


def from_postgres_epoch(micros: Column) -> Column:
    """Microseconds since 2000-01-01 as a timestamp."""
    return F.timestamp_micros(micros + F.lit(946_684_800_000_000))


def epoch_age_seconds(now_ms: Column, oldest_ms: Column) -> Column:
    return F.coalesce(F.floor(F.greatest(now_ms - oldest_ms, F.lit(0)) / 1000), F.lit(0)).cast("long")


def has_null_element(a: Column) -> Column:
    return F.coalesce(F.exists(a, lambda x: x.isNull()), F.lit(False))


def json_integers_fit(text: Column) -> Column:
    """Whether every integer of a JSON text lies in the signed or unsigned
    64-bit range. Strings are blanked before numbers are looked for."""
    bare = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"', '""')
    numbers = F.regexp_extract_all(bare, F.lit(r"(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"), 1)
    whole = F.filter(numbers, lambda x: x.rlike(r"^-?\d+$"))
    fits = lambda x: F.coalesce(x.try_cast("decimal(38,0)").between(F.lit("-9223372036854775808").cast("decimal(38,0)"), F.lit("18446744073709551615").cast("decimal(38,0)")), F.lit(False))
    return F.forall(whole, fits)


def finite(x: Column) -> Column:
    """The value, or an error for NaN and infinities, which JSON can't hold."""
    return F.when(x.isNull() | ~(F.isnan(x) | x.isin(float("inf"), float("-inf"))), x).otherwise(F.raise_error(F.lit("NaN or infinity in a JSON row")))


def rate(n: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, n / seconds).otherwise(0.0)


def mib(n: Column) -> Column:
    return n / F.lit(1048576.0)


#: Value of a NOT NULL column that a key-only delete doesn't carry.
ZEROS = {"boolean": "false", "smallint": "0S", "int": "0", "bigint": "0L", "float": "0F", "double": "0D", "string": "''", "date": "DATE'1970-01-01'", "timestamp": "TIMESTAMP'1970-01-01 00:00:00'", "timestamp_ntz": "TIMESTAMP_NTZ'1970-01-01 00:00:00'", "binary": "X''"}


def typed_zero(spark_type: str, nullable: bool) -> Column:
    """What stands for an absent value: NULL where the column allows it."""
    if nullable:
        return F.lit(None).cast(spark_type)
    if spark_type.startswith("array"):
        return F.array().cast(spark_type)
    return F.expr(ZEROS.get(spark_type, "''")).cast(spark_type)
