"""Byte-level BPE with a segment tree over byte positions.

The leaf of a live position holds the rank of the pair it starts, joined with
the position, so the root is the leftmost pair of least rank. A merge changes
three leaves (the merged token, its left neighbour, the position that dies) and
their ancestors, so a match of n bytes takes O(n log n).

The trees of many short matches lie side by side in one array and merge in step;
long matches have a tree of their own. Both use the same layout and pair table.
"""

from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import ship

#: Matches of more bytes get a tree of their own.
SHORT = 64
#: Chunks of a text, from one space to the next, whose ids are remembered by a
#: Python worker, and the longest one remembered.
REMEMBERED = 600_000
LONGEST = 48
#: Characters of texts that are encoded together.
GROUP_CHARS = 1 << 20
_NONE = np.int32(0x7FFFFFFF)


@dataclass
class Vocabulary:
    tokens: list[bytes]
    ranks: dict[bytes, int]
    pair_keys: np.ndarray
    pair_ranks: np.ndarray
    single: np.ndarray
    pairs: dict[int, int] = field(repr=False)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """From a file of lines "base64 rank"."""
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        tokens = [b""] * (max(ranks.values()) + 1)
        pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            tokens[rank] = token
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        keys = np.array(sorted(pairs), np.int64)
        return cls(tokens, ranks, keys, np.array([pairs[k] for k in keys.tolist()], np.int32), np.array([ranks[bytes([i])] for i in range(256)], np.int32), pairs)

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where((self.pair_keys[at] == key) & (b >= 0), self.pair_ranks[at], _NONE)


def merge_long(v: Vocabulary, piece: bytes) -> list[int]:
    """Ids of one match by its own tree."""
    n = len(piece)
    width = 1 << max(1, (n - 1).bit_length())
    none = 1 << 62
    token = [int(v.single[x]) for x in piece]
    after, before = list(range(1, n)) + [-1], list(range(-1, n - 1))
    tree = [none] * (2 * width)
    pairs = v.pairs

    def leaf(i: int) -> int:
        j = after[i]
        rank = pairs.get(token[i] << 32 | token[j]) if j >= 0 else None
        return none if rank is None else rank << 32 | i

    def put(i: int, value: int) -> None:
        k = width + i
        tree[k] = value
        while k > 1:
            k >>= 1
            least = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == least:
                break
            tree[k] = least

    for i in range(n):
        tree[width + i] = leaf(i)
    for k in range(width - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])
    while tree[1] < none:
        i, rank = tree[1] & 0xFFFFFFFF, tree[1] >> 32
        j = after[i]
        token[i], after[i] = rank, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        put(j, none)
        put(i, leaf(i))
        if before[i] >= 0:
            put(before[i], leaf(before[i]))
    out, i = [], 0
    while i >= 0:
        out.append(token[i])
        i = after[i]
    return out


def merge_short(v: Vocabulary, pieces: list[bytes], width: int) -> list[bytes]:
    """Ids of matches of 2 to ``width`` bytes (a power of two), as
    little-endian 32-bit numbers; their trees are the rows of one array."""
    n = len(pieces)
    size = np.array([len(p) for p in pieces])
    padded = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
    column = np.arange(width, dtype=np.int32)
    live = column[None] < size[:, None]
    token = np.where(live, v.single[padded], -1).astype(np.int32)
    after = np.where(column[None] + 1 < size[:, None], column[None] + 1, -1).astype(np.int16)
    before = np.broadcast_to(column - 1, (n, width)).astype(np.int16).copy()
    tree = np.full((n, 2 * width), _NONE, np.int32)
    right = np.full((n, width), -1, np.int32)
    right[:, :-1] = token[:, 1:]
    rank = v.pair_rank(np.maximum(token, 0).ravel(), right.ravel()).reshape(n, width)
    tree[:, width:] = np.where(rank == _NONE, _NONE, rank * width + column)
    level = width
    while level > 1:
        level >>= 1
        tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])

    def put(row: np.ndarray, i: np.ndarray, value: np.ndarray) -> None:
        at = width + i
        tree[row, at] = value
        while at[0] > 1:  # all leaves are equally deep
            at = at >> 1
            tree[row, at] = np.minimum(tree[row, 2 * at], tree[row, 2 * at + 1])

    def leaves(row: np.ndarray, i: np.ndarray) -> np.ndarray:
        j = after[row, i]
        rank = v.pair_rank(token[row, i], np.where(j >= 0, token[row, j], -1))
        return np.where(rank == _NONE, _NONE, rank * width + i).astype(np.int32)

    row = np.flatnonzero(tree[:, 1] != _NONE)
    while len(row):
        top = tree[row, 1]
        i = top & (width - 1)
        j = after[row, i].astype(np.int32)
        beyond = after[row, j]
        token[row, i], token[row, j] = top // width, -1
        after[row, i] = beyond
        has = beyond >= 0
        before[row[has], beyond[has]] = i[has]
        put(row, j, np.full(len(row), _NONE, np.int32))
        put(row, i, leaves(row, i))
        prior = before[row, i].astype(np.int32)
        has = prior >= 0
        if has.any():
            put(row[has], prior[has], leaves(row[has], prior[has]))
        row = row[tree[row, 1] != _NONE]
    keep = token >= 0
    flat, ends = token[keep].astype("<u4").tobytes(), np.append(0, np.cumsum(keep.sum(1))) * 4
    return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


class Encoder:
    """Encodes whole texts; remembers the ids of recurring chunks and matches."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.v, self.find = vocabulary, regex.compile(pattern).findall
        self.blanks = regex.compile(r"\s\s").search
        self.spaced: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _learn(self, wanted: set[str]) -> dict[str, bytes]:
        """Ids of matches, from memory or by merging those not met yet."""
        known = self.pieces
        if len(known) > REMEMBERED:
            known.clear()
        out, by_width = {}, {}
        for piece in wanted:
            ids = known.get(piece)
            if ids is None:
                data = piece.encode()
                rank = self.v.ranks.get(data)
                if rank is not None:
                    ids = rank.to_bytes(4, "little")
                elif len(data) > SHORT:
                    out[piece] = np.array(merge_long(self.v, data), "<u4").tobytes()
                    continue
                else:
                    by_width.setdefault(1 << (len(data) - 1).bit_length(), []).append((piece, data))
                    continue
                known[piece] = ids
            out[piece] = ids
        for width, some in by_width.items():
            for k in range(0, len(some), 20_000):
                part = some[k : k + 20_000]
                for (piece, _), ids in zip(part, merge_short(self.v, [d for _, d in part], width), strict=True):
                    known[piece] = out[piece] = ids
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers.

        Where blanks stand alone, every space starts a match and ends the one
        before, so a text is its first chunk and those from a space to the next.
        """
        if len(self.spaced) > REMEMBERED:
            self.spaced.clear()
        spaced, plans, chunks, plain = self.spaced, [], set(), set()
        for text in texts:
            if " " in text and not self.blanks(text):
                parts = text.split(" ")
                chunks.update(parts)
                head = self.find(parts[0])
                plain.update(head)
                plans.append((head, parts))
            else:
                head = self.find(text)
                plain.update(head)
                plans.append((head, None))
        new = {c: self.find(" " + c) for c in chunks.difference(spaced)}
        ids = self._learn(plain.union(*new.values()) if new else plain)
        extra = {}
        for chunk, matches in new.items():
            (spaced if len(chunk) <= LONGEST else extra)[chunk] = b"".join([ids[m] for m in matches])
        out = []
        for head, parts in plans:
            data = b"".join([ids[m] for m in head])
            if parts:
                try:
                    data += b"".join([spaced[c] for c in parts[1:]])
                except KeyError:
                    data += b"".join([extra[c] if c in extra else spaced[c] for c in parts[1:]])
            out.append(data)
        return out

    def decode(self, ids: bytes) -> bytes:
        tokens = self.v.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(Vocabulary.load(path), pattern)
    return _ENCODERS[path, pattern]


def groups(texts: list[str | None], chars: int = GROUP_CHARS):
    """Runs of whole texts of about so many characters; null as empty."""
    some, size = [], 0
    for t in texts:
        some.append(t or "")
        size += len(some[-1])
        if size >= chars:
            yield some
            some, size = [], 0
    if some:
        yield some


def encode_decode(spark: SparkSession, docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row: its whole
    text encoded, and the ids decoded again. Null texts are empty; null and
    repeated ids keep their rows; other columns are ignored. ``path`` is a
    vocabulary file that every executor has."""
    ship(spark)

    def run(batches):
        e = encoder(path, pattern)
        for b in batches:
            n, first, second = [], [], []
            for some in groups(b.column(1).to_pylist()):
                for ids in e.encode_batch(some):
                    n.append(len(ids) // 4)
                    first.append(hashlib.sha256(ids).hexdigest())
                    second.append(hashlib.sha256(e.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(spark: SparkSession, docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` (array of int) of every row."""
    ship(spark)

    def run(batches):
        e = encoder(path, pattern)
        for b in batches:
            found = [x for some in groups(b.column(1).to_pylist()) for x in e.encode_batch(some)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.frombuffer(x, np.int32) for x in found], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, ids array<int>")
