"""Exact deduplication with counting quotient filters.

Every partition turns the 64-bit fingerprints of its texts into counting
quotient filters, one for each range of fingerprints: the quotient is the
position in a bitmap, the remainder is stored in sorted order with its count.
Filters of one range merge without loss by their sorted remainders. Only
fingerprints whose merged count is above one go on, to a comparison of bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Workspace, join_hot, small_or_shuffled, with_rows_bounded

#: Quotient bits of one filter, and the fingerprints it is sized for.
QUOTIENT_BITS = 16
FILTER_KEYS = 1 << 16
#: Fingerprints that a task gathers before it emits its filters.
GATHER = 1 << 20


class QuotientFilter:
    """Distinct fingerprints of one range with counts.

    ``occupied``: a bit for each quotient that has a run; ``ends``: a bit for
    each slot that ends a run; ``remainders``: the slots, sorted by quotient
    and remainder; ``counts``: beside them. ``bits``: of a key in the range.
    """

    def __init__(self, bits: int, occupied: np.ndarray, ends: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.bits, self.occupied, self.ends, self.remainders, self.counts = bits, occupied, ends, remainders, counts

    @classmethod
    def of_sorted(cls, keys: np.ndarray, counts: np.ndarray, bits: int) -> QuotientFilter:
        rest = np.uint64(bits - QUOTIENT_BITS)
        quotient = (keys >> rest).astype(np.int64)
        occupied = np.zeros(1 << QUOTIENT_BITS, bool)
        occupied[quotient] = True
        ends = np.ones(len(keys), bool)
        ends[:-1] = quotient[1:] != quotient[:-1]
        return cls(bits, occupied, ends, keys & ((np.uint64(1) << rest) - np.uint64(1)), counts)

    def keys(self) -> np.ndarray:
        run = np.cumsum(self.ends) - self.ends
        return (np.flatnonzero(self.occupied)[run].astype(np.uint64) << np.uint64(self.bits - QUOTIENT_BITS)) | self.remainders

    def merge(self, *others: QuotientFilter) -> QuotientFilter:
        """One filter that holds what all of them hold, counts added."""
        keys = np.concatenate([self.keys(), *(x.keys() for x in others)])
        order = np.argsort(keys, kind="stable")  # a merge of sorted runs
        keys, counts = keys[order], np.concatenate([self.counts, *(x.counts for x in others)])[order]
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        at = np.flatnonzero(first)
        return QuotientFilter.of_sorted(keys[at], np.add.reduceat(counts, at) if len(at) else counts, self.bits)

    def pack(self) -> tuple[bytes, bytes, bytes, bytes]:
        return np.packbits(self.occupied).tobytes(), np.packbits(self.ends).tobytes(), self.remainders.tobytes(), self.counts.tobytes()

    @classmethod
    def unpack(cls, bits: int, occupied: bytes, ends: bytes, remainders: bytes, counts: bytes) -> QuotientFilter:
        rest = np.frombuffer(remainders, np.uint64)
        flags = np.unpackbits(np.frombuffer(ends, np.uint8), count=len(rest)).astype(bool)
        return cls(bits, np.unpackbits(np.frombuffer(occupied, np.uint8)).astype(bool), flags, rest, np.frombuffer(counts, np.int64))


_FILTER = "block long, occupied binary, ends binary, remainders binary, counts binary"
_NAMES = ["block", "occupied", "ends", "remainders", "counts"]


def _batch(found: list[tuple[int, QuotientFilter]]) -> pa.RecordBatch:
    packed = [x.pack() for _, x in found]
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int64()), *(pa.array([p[i] for p in packed], pa.binary()) for i in range(4))], names=_NAMES)


def _build(block_bits: int):
    bits = 64 - block_bits

    def emit(keys):
        keys, counts = np.unique(np.concatenate(keys).view(np.uint64), return_counts=True)
        block = (keys >> np.uint64(bits - 1) >> np.uint64(1)).astype(np.int64)
        ends = np.flatnonzero(np.append(block[1:] != block[:-1], True)) + 1
        mask = np.uint64((1 << bits) - 1)
        found = [(int(block[i]), QuotientFilter.of_sorted(keys[i:j] & mask, counts[i:j].astype(np.int64), bits)) for i, j in zip(np.append(0, ends[:-1]), ends, strict=True)]
        for k in range(0, len(found), 64):
            yield _batch(found[k : k + 64])

    def run(batches):
        keys, n = [], 0
        for b in batches:
            keys.append(b.column(0).to_numpy(zero_copy_only=False))
            n += b.num_rows
            if n >= GATHER:
                yield from emit(keys)
                keys, n = [], 0
        if n:
            yield from emit(keys)

    return run


def _repeated(block_bits: int):
    """Filters sorted by block: merges each block's and gives its fingerprints
    with a count above one. Holds one block at a time."""
    bits = 64 - block_bits

    def over(block, filters):
        whole = filters[0].merge(*filters[1:])
        many = whole.counts > 1
        keys = whole.keys()[many] | (np.uint64(block) << np.uint64(bits) if block_bits else np.uint64(0))
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(whole.counts[many])], names=["fp", "rows"])

    def run(batches):
        at, held = None, []
        for b in batches:
            for block, *packed in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if held and block != at:
                    yield over(at, held)
                    held = []
                at = block
                held.append(QuotientFilter.unpack(bits, *packed))
                if len(held) >= 64:
                    held = [held[0].merge(*held[1:])]
        if held:
            yield over(at, held)

    return run


def repeated_fingerprints(fingerprints: DataFrame, rows: int) -> DataFrame:
    """``fp`` and ``rows`` of the fingerprints (one long column) that occur
    more than once. ``rows`` sizes the filters."""
    block_bits = max(0, (rows // FILTER_KEYS).bit_length())
    built = fingerprints.where(fingerprints[0].isNotNull()).mapInArrow(_build(block_bits), _FILTER)
    return built.repartition("block").sortWithinPartitions("block").mapInArrow(_repeated(block_bits), "fp long, rows long")


def normalised(text: Column) -> Column:
    """Null as empty, every run of blanks as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row.

    Texts are equal when their normalised bytes are. The row with the smallest
    id of a group stays; null ids never stay unless the whole group has none,
    and rows that repeat the smallest id stay together. Null texts equal empty
    ones, and texts are compared whole, however long. An empty table gives an
    empty one; other columns are ignored, whatever their names.
    """
    work = Workspace(spark, "dedup")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("norm")).withColumn("fp", F.xxhash64("norm"))
    signed = work.write(texts.select("doc_id", "fp", F.sha2("norm", 256).alias("text_sha256")), "signed")
    twice = work.write(repeated_fingerprints(signed.select("fp"), signed.count()), "repeated")
    checked = texts.join(small_or_shuffled(twice.select("fp")), "fp", "left_semi")
    groups = checked.groupBy("fp", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = work.write(groups.select("fp", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size"), "groups")
    if with_rows_bounded(spark, groups, 200_000):
        out = signed.join(F.broadcast(groups), ["fp", "text_sha256"], "left")
    else:
        known = groups.groupBy("text_sha256").agg(F.max("group_size").alias("rows"))
        out = join_hot(work, signed, groups.drop("fp"), "text_sha256", ["doc_id"], sizes=known)
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")
