"""Log positions: 64-bit LSNs as DECIMAL(20,0), and fixed-width hex keys.

An LSN uses all 64 bits, which BIGINT can't hold; hex keys of fixed width sort
as their numbers do.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LSN = "decimal(20,0)"


def hex16(number: Column) -> Column:
    """16 lower-case hex digits of an unsigned 64-bit number."""
    small = number.try_cast("bigint")  # all but positions from 2 ** 63 on
    digits = F.when(small >= 0, F.hex(small)).otherwise(F.conv(number.cast(LSN).cast("string"), 10, 16))
    return F.lpad(F.lower(digits), 16, "0")


def sequence_key(commit_lsn: Column, tx_ordinal: Column) -> Column:
    """Total order of change events: commit position, then place in it."""
    return F.concat(hex16(commit_lsn), F.lit("/"), hex16(tx_ordinal))


def sub_key(key: Column, ordinal: Column) -> Column:
    """A sequence key with a third section for the legs of one event."""
    return F.concat(key, F.lit("/"), hex16(ordinal))


def parse_sequence_key(key: Column) -> tuple[Column, Column]:
    """Both numbers of a canonical key; NULL for any other text."""
    good = key.rlike("^[0-9a-f]{16}/[0-9a-f]{16}$")
    part = lambda n: F.when(good, F.conv(F.split(key, "/")[n], 16, 10).cast(LSN))
    return part(0), part(1)


def lsn_text(lsn: Column) -> Column:
    """``hi/lo`` in upper-case hex without leading zeros."""
    whole = hex16(lsn)
    half = lambda start: F.regexp_replace(F.upper(F.substring(whole, start, 8)), "^0+(?=.)", "")
    return F.concat(half(1), F.lit("/"), half(9))


def parse_lsn(text: Column) -> Column:
    """The number of a ``hi/lo`` text, each half of 1 to 8 hex digits."""
    good = text.rlike("^[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}$")
    half = lambda n: F.conv(F.split(text, "/")[n], 16, 10).cast(LSN)
    return F.when(good, (half(0) * F.lit(4294967296).cast("decimal(10,0)") + half(1)).cast(LSN))


def saturating_lag(ahead: Column, behind: Column) -> Column:
    """Bytes between two positions, never below zero."""
    return F.greatest(ahead - behind, F.lit(0).cast(LSN))
