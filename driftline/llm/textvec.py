"""Word and n-gram hashes of Arrow string columns, without Python strings.

Texts stay in Arrow's UTF-8 buffers; NumPy works on slices of about
``SLICE_BYTES``, always whole texts, so memory follows the longest text and
not the batch or the number of short texts in it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
SLICE_ROWS = 4096
U64 = np.uint64
#: Odd constants of the hashes.
STEP = U64(0x9E3779B97F4A7C15)
TURN = U64(0xD6E8FEB86659FD93)
#: Spans of up to so many 8-byte blocks are hashed side by side, longer ones by
#: a cryptographic hash one by one.
BLOCKS = 16
#: By a number of bytes up to 8: the bits of that many.
BITS = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 over an array of uint64."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@dataclass
class Slice:
    """Some texts side by side: ``data`` holds their bytes, text k of the slice
    is ``data[bounds[k]:bounds[k+1]]`` and row ``first + k`` of the batch."""

    first: int
    data: np.ndarray
    bounds: np.ndarray
    valid: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1


def slices(column: pa.Array | pa.ChunkedArray, size: int = SLICE_BYTES, rows: int = SLICE_ROWS, together: int = 1) -> Iterator[Slice]:
    """At most ``rows`` texts each, and as many as make ``size`` bytes, but one
    at least, and always whole runs of ``together``. Null texts appear as empty
    ones with ``valid`` False."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return
    valid = np.ones(n, bool) if not column.null_count else np.asarray(column.is_valid())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if not valid.all() and (np.diff(offsets)[~valid] != 0).any():
        yield from slices(column.fill_null(""), size, rows, together)
        return
    at = 0
    while at < n:
        to = min(at + rows, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        to = max(at + together, to - (to - at) % together)
        yield Slice(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], valid[at:to])
        at = to


@dataclass
class Words:
    """Words of a slice: hash, start and end of each, and for text k the words
    ``first[k]:first[k+1]``. ``data``: the bytes that are hashed."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    data: np.ndarray

    def block(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The up to 8 bytes from each place on, as numbers."""
        return self._blocks[at] & BITS[np.minimum(size, 8)]

    def __post_init__(self) -> None:
        self._padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        self._blocks = np.ndarray(len(self.data) + 1, "<u8", self._padded, strides=(1,))

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte spans of the slice."""
        size = end - start
        out = size.astype(U64) * STEP
        long = size > 8 * BLOCKS
        row, at, left = np.arange(len(out)), start, np.where(long, 0, size)
        while len(row):
            out[row] = mix(out[row] * TURN ^ self.block(at, left))
            more = left > 8
            row, at, left = row[more], at[more] + 8, left[more] - 8
        for k in np.flatnonzero(long):
            out[k] = np.frombuffer(hashlib.blake2b(self.data[start[k] : end[k]].data, digest_size=8).digest(), U64)[0]
        return out

    def same_bytes(self, start: np.ndarray, end: np.ndarray, other: np.ndarray, there=None) -> np.ndarray:
        """Whether each span's bytes are those from ``other`` on, here or in
        ``there``, which has ``data`` and ``block``, for as many bytes."""
        there = self if there is None else there
        size = end - start
        out = np.ones(len(size), bool)
        row, at, to, left = np.arange(len(size)), start, other, np.minimum(size, 8 * BLOCKS)
        while len(row):
            out[row] &= self.block(at, left) == there.block(to, left)
            more = left > 8
            row, at, to, left = row[more], at[more] + 8, to[more] + 8, left[more] - 8
        for k in np.flatnonzero(size > 8 * BLOCKS):
            out[k] = np.array_equal(self.data[start[k] : end[k]], there.data[other[k] : other[k] + size[k]])
        return out


def words(s: Slice, separator: np.ndarray = BLANK, lower: bool = True) -> Words:
    """Maximal runs of bytes outside ``separator``, A-Z lower-cased in hashes."""
    inside = ~separator[s.data]
    cuts = s.bounds[:-1][np.diff(s.bounds) > 0]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    opens[cuts] = inside[cuts]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    last = s.bounds[1:][np.diff(s.bounds) > 0] - 1
    closes[last] = inside[last]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    out = Words(np.zeros(0, U64), start, end, np.searchsorted(start, s.bounds), LOWER[s.data] if lower else s.data)
    out.hash = out.span_hash(start, end)
    return out


def word_digests(s: Slice, w: Words, separator: np.ndarray = BLANK) -> list[bytes | None]:
    """A 128-bit digest of each text's words in order, None for no words: of
    their bytes, so texts with one digest are the same words."""
    inside = ~separator[s.data]
    keep = inside.copy()
    keep[w.end[w.end < len(keep)]] = True  # one separator after a word
    data = np.where(inside, w.data, np.uint8(32))[keep]
    at = np.concatenate([[0], np.cumsum(keep)])
    out: list[bytes | None] = []
    for k in range(len(s)):
        if w.first[k] == w.first[k + 1]:
            out.append(None)
        else:
            out.append(hashlib.blake2b(data[at[w.start[w.first[k]]] : at[w.end[w.first[k + 1] - 1]]].data, digest_size=16).digest())
    return out


def _chain(hashes: list[np.ndarray], size: int) -> np.ndarray:
    out = np.full(len(hashes[0]), size * int(STEP) % (1 << 64), U64)
    for h in hashes:
        out = mix(out * TURN ^ h)
    return out


def shingle_starts(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first word of every run of ``size`` words, text by text, with the
    bounds of each text's; a text with fewer words has its first one alone."""
    count = np.diff(w.first)
    many = np.where(count > 0, np.maximum(count - size + 1, 1), 0)
    bounds = np.concatenate([[0], np.cumsum(many)])
    return np.repeat(w.first[:-1], many) + np.arange(bounds[-1]) - np.repeat(bounds[:-1], many), bounds


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, text by text, with the bounds of
    each text's run; a text with fewer words gives its whole sequence."""
    start, bounds = shingle_starts(w, size)
    padded = np.concatenate([w.hash, np.zeros(size, U64)])
    out = _chain([padded[start + k] for k in range(size)], size)
    count = np.diff(w.first)
    for n in range(1, size):
        short = np.flatnonzero(count == n)
        if len(short):
            out[bounds[short]] = _chain([padded[w.first[short] + k] for k in range(n)], n)
    return out, bounds
