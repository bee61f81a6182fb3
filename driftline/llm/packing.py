"""Harmonic packing of documents into fixed-length training sequences.

A document of length up to capacity/k and over the next class's bound falls
into class k, and a bin of class k takes exactly k documents, whole. What such
a bin leaves empty is known when it closes, and is filled by pieces cut from
documents that are longer than a sequence, or, where too much has come
together, from the next document. Workers fill bins on their own, without any
exchange; at the end of its rows a worker packs what is in unfilled bins
together, cutting at the ends of sequences.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec
from .storage import giving_back, ship

CAPACITY = 4096
#: Documents in a bin of each class: every number up to 16, then steps of a
#: quarter, as more classes would leave a worker more unfilled bins.
CLASSES = [*range(1, 17)]
while CLASSES[-1] < CAPACITY:
    CLASSES.append(max(CLASSES[-1] + 1, CLASSES[-1] * 5 // 4))
#: Empty tokens of a bin that aren't worth a cut.
LEAST_GAP = 16
END_ID = 2
#: Words whose ids a Python worker remembers before it starts anew: about 60
#: bytes each.
REMEMBERED = 1_500_000
#: ASCII marks that the tokenizer always splits from a letter or digit before.
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = True


def class_of(length: int, capacity: int = CAPACITY) -> int:
    """The number of documents of that length in a bin."""
    return CLASSES[bisect_right(CLASSES, max(1, capacity // length)) - 1]


class Packer:
    """Places pieces (doc, start, length) and hands out (doc, start, length,
    sequence, offset) of closed sequences."""

    def __init__(self, first_sequence: int, capacity: int = CAPACITY):
        self.next, self.capacity = first_sequence, capacity
        self.open: dict[int, list[tuple]] = {}
        #: Closed bins with a gap: (-gap, order, pieces), the widest first.
        self.gaps: list[tuple] = []
        self.gap, self.order = 0, 0
        self.regular, self.mixed = 0, 0

    def _emit(self, pieces: list[tuple]) -> list[tuple]:
        out, offset = [], 0
        for p in pieces:
            out.append((*p, self.next, offset))
            offset += p[2]
        self.next += 1
        return out

    def _close(self, pieces: list[tuple], gap: int) -> list[tuple]:
        """Hands out a bin, or keeps it until its gap is filled."""
        if gap < LEAST_GAP:
            return self._emit(pieces)
        self.order += 1
        heapq.heappush(self.gaps, (-gap, self.order, pieces))
        self.gap += gap
        return []

    def _fill(self, piece: tuple) -> tuple[list[tuple], tuple | None]:
        """Cuts a piece into the gaps; gives what is left of it."""
        out, (doc, start, length) = [], piece
        while length and self.gaps:
            gap, _, pieces = heapq.heappop(self.gaps)
            self.gap += gap
            take = min(-gap, length)
            pieces.append((doc, start, take))
            start, length = start + take, length - take
            out += self._close(pieces, -gap - take)
        return out, (doc, start, length) if length else None

    def add(self, doc, length: int) -> list[tuple]:
        out, piece = [], (doc, 0, length)
        if length > self.capacity or self.gap >= length + self.capacity or (2 * length > self.capacity and self.gap >= length):
            out, piece = self._fill(piece)
        while piece and piece[2] >= self.capacity:
            out += self._emit([(doc, piece[1], self.capacity)])
            piece = (doc, piece[1] + self.capacity, piece[2] - self.capacity) if piece[2] > self.capacity else None
        if not piece:
            return out
        k = class_of(piece[2], self.capacity)
        held = self.open.setdefault(k, [])
        held.append(piece)
        if len(held) == k:
            del self.open[k]
            self.regular += 1
            out += self._close(held, self.capacity - sum(p[2] for p in held))
        return out

    def finish(self) -> list[tuple]:
        """What is in unfilled bins: into the gaps, then next-fit from the
        longest on, cut where a sequence is full. With more gaps than that, the
        narrowest bins' own pieces go into them. The last sequence is cut at
        powers of two, which need no padding."""
        left = sorted((p for x in self.open.values() for p in x), key=lambda p: p[2])
        self.open, out = {}, []
        while self.gaps:
            if not left:
                if len(self.gaps) == 1:
                    break
                smallest = max(self.gaps)
                self.gaps.remove(smallest)
                heapq.heapify(self.gaps)
                self.gap += smallest[0]
                left = sorted(smallest[2], key=lambda p: p[2])
                continue
            done, rest = self._fill(left.pop())
            out += done
            if rest:
                left.append(rest)
        left += [p for _, _, pieces in self.gaps for p in reversed(pieces)]
        self.gaps, held, room = [], [], self.capacity
        while left:
            doc, start, length = left.pop()
            take = min(length, room)
            held.append((doc, start, take))
            room -= take
            if take < length:
                left.append((doc, start + take, length - take))
            if not room:
                out += self._emit(held)
                self.mixed += 1
                held, room = [], self.capacity
        for bit in reversed(range((self.capacity - room).bit_length())):
            size = 1 << bit
            if not (self.capacity - room) & size:
                continue
            part = []
            while size:
                doc, start, length = held.pop(0)
                take = min(length, size)
                part.append((doc, start, take))
                size -= take
                if take < length:
                    held.insert(0, (doc, start + take, length - take))
            out += self._emit(part)
            self.mixed += 1
        return out


class WordTable:
    """From words to ids: open addressing by 64-bit hashes in NumPy arrays, the
    ids of all words end to end in one, and so their bytes, as a hash alone
    doesn't tell two words apart."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.keys, self.place, self.words = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int32), 0
        self.start, self.size = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int32)
        self.ids, self.used = np.zeros(1 << 17, np.uint32), 0
        self.at, self.length = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int64)
        self._hold(np.zeros(1 << 20, np.uint8), 0)

    def _hold(self, padded: np.ndarray, held: int) -> None:
        self.data, self.held = padded, held
        self._blocks = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))

    def block(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """As that of a slice's words."""
        return self._blocks[at] & textvec.BITS[np.minimum(size, 8)]

    def same(self, w: textvec.Words, start: np.ndarray, end: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether each place holds the very word."""
        out = self.length[place] == end - start
        out[out] = w.same_bytes(start[out], end[out], self.at[place[out]], self)
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each word, -1 for one not met."""
        mask = np.uint64(len(self.keys) - 1)
        out, open_, slot = np.full(len(keys), -1, np.int64), np.arange(len(keys)), keys & mask
        while len(open_):
            found = self.keys[slot]
            same = found == keys[open_]
            out[open_[same]] = self.place[slot[same]]
            more = ~same & (found != 0)
            open_, slot = open_[more], (slot[more] + np.uint64(1)) & mask
        return out

    def _insert(self, keys: np.ndarray, places: np.ndarray) -> None:
        mask = np.uint64(len(self.keys) - 1)
        slot = keys & mask
        while len(keys):
            free = self.keys[slot] == 0
            first = np.zeros(len(keys), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            take = free & first
            self.keys[slot[take]], self.place[slot[take]] = keys[take], places[take]
            keys, places, slot = keys[~take], places[~take], (slot[~take] + np.uint64(1) * (~free[~take]).astype(np.uint64)) & mask

    def append(self, words: list[bytes], ids: list[list[int]]) -> np.ndarray:
        """Places of words with their ids, which no key finds yet."""
        sizes, lengths = np.fromiter(map(len, ids), np.int32, len(ids)), np.fromiter(map(len, words), np.int64, len(words))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))
        double = lambda x: np.concatenate([x, np.zeros_like(x)])
        while self.words + len(ids) > len(self.start):
            self.start, self.size, self.at, self.length = map(double, (self.start, self.size, self.at, self.length))
        while self.used + len(flat) > len(self.ids):
            self.ids = double(self.ids)
        while self.held + int(lengths.sum()) + 8 > len(self.data):
            self._hold(double(self.data), self.held)
        places = np.arange(self.words, self.words + len(ids), dtype=np.int32)
        self.start[places], self.size[places] = self.used + np.cumsum(sizes) - sizes, sizes
        self.at[places], self.length[places] = self.held + np.cumsum(lengths) - lengths, lengths
        self.ids[self.used : self.used + len(flat)] = flat
        self.data[self.held : self.held + int(lengths.sum())] = np.frombuffer(b"".join(words), np.uint8)
        self.words, self.used, self.held = self.words + len(ids), self.used + len(flat), self.held + int(lengths.sum())
        return places

    def add(self, keys: np.ndarray, words: list[bytes], ids: list[list[int]]) -> None:
        """Distinct new keys with one word each and its ids."""
        places = self.append(words, ids)
        if 2 * self.words > len(self.keys):
            held = self.keys != 0
            keys, places = np.concatenate([self.keys[held], keys]), np.concatenate([self.place[held], places])
            slots = 1 << (2 * self.words).bit_length()
            self.keys, self.place = np.zeros(slots, np.uint64), np.zeros(slots, np.int32)
        self._insert(keys, places)


class WordIds:
    """Ids of texts by a lower-casing, word-splitting tokenizer file. The
    tokenizer never joins what ASCII blanks part, so a text's ids are those of
    its words; and what it splits inside a word, a mark at the end after an
    ASCII letter or digit, is a word of its own here. Words are found by their
    hashes and compared by their bytes, and each one goes through the tokenizer
    when it is first met.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.table = Tokenizer.from_file(path), WordTable()
        suffix = self.tokenizer.model.end_of_word_suffix
        self.ends = {i for token, i in self.tokenizer.get_vocab().items() if suffix and token.endswith(suffix)}

    def _encode(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words. Lower-case ASCII letters pass the tokenizer's
        normaliser and splitter as they are, so its model takes them alone;
        other words of letters go in runs, as each ends in its last token;
        the rest one by one."""
        out, alike, other = [None] * len(words), [], []
        tokenize = self.tokenizer.model.tokenize
        for i, w in enumerate(words):
            text = w.decode()
            if not text.isalpha():
                other.append((i, text))
            elif not text.isascii():
                alike.append((i, text))
            elif text.islower():
                out[i] = [t.id for t in tokenize(text)]
            else:
                other.append((i, text))
        runs = [alike[k : k + 50] for k in range(0, len(alike), 50)]
        for run, found in zip(runs, self._batch([" ".join(t for _, t in r) for r in runs]), strict=True):
            ends = [k + 1 for k, x in enumerate(found) if x in self.ends]
            if len(ends) != len(run) or ends[-1] != len(found):  # a word that isn't one word after all
                other += run
                continue
            for (i, _), start, end in zip(run, [0, *ends], ends, strict=False):
                out[i] = found[start:end]
        for (i, _), found in zip(other, self._batch([t for _, t in other]), strict=True):
            out[i] = found
        return out

    def _batch(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def encode(self, s: textvec.Slice) -> list[np.ndarray]:
        """Ids of each text of a slice."""
        w = textvec.words(s)
        start, end, hashes, first = w.start, w.end, w.hash, w.first
        mark = _MARK[s.data[end - 1]] & (end - start > 1) & _ALNUM[s.data[end - 2]] if len(end) else np.zeros(0, bool)
        if mark.any():
            cut = np.flatnonzero(mark)
            at = np.arange(len(start)) + np.cumsum(mark) - mark
            n = len(start) + len(cut)
            starts, ends = np.zeros(n, np.int64), np.zeros(n, np.int64)
            starts[at], ends[at] = start, end - mark
            starts[at[cut] + 1], ends[at[cut] + 1] = end[cut] - 1, end[cut]
            first = first + np.append(0, np.cumsum(mark))[first]
            start, end, hashes = starts, ends, w.span_hash(starts, ends)
        hashes = np.maximum(hashes, np.uint64(1))
        table = self.table
        if table.words > REMEMBERED or table.used > 8 * REMEMBERED or table.held > 16 * REMEMBERED:
            table.clear()
        bytes_of = lambda at: [w.data[i:j].tobytes() for i, j in zip(start[at].tolist(), end[at].tolist(), strict=True)]
        place = table.find(hashes)
        new = np.flatnonzero(place < 0)
        if len(new):
            keys, one = np.unique(hashes[new], return_index=True)
            found = bytes_of(new[one])
            table.add(keys, found, self._encode(found))
            place[new] = table.find(hashes[new])
        other = np.flatnonzero(~table.same(w, start, end, place))
        if len(other):  # two words with one hash
            found = bytes_of(other)
            place[other] = table.append(found, self._encode(found))
        size = table.size[place]
        total = np.append(0, np.cumsum(size))
        ids = table.ids[np.repeat(table.start[place] - total[:-1], size) + np.arange(total[-1])]
        bounds = total[first].tolist()
        out = [ids[i:j] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
        if b"<|" in s.data.tobytes():  # a special token may be spelled, and its case counts
            for k in range(len(s)):
                text = s.data[s.bounds[k] : s.bounds[k + 1]].tobytes()
                if b"<|" in text:
                    out[k] = np.array(self._batch([text.decode()])[0], np.uint32)
        return out


def pack_documents(spark: SparkSession, docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset`` and, if asked for, ``ids``.

    Each document's ids end with END_ID; a null text is empty, so it is that
    one id. ``start`` counts the document's ids before the piece, ``offset``
    the sequence's. Null or repeated doc_ids are documents like others, and
    very long texts are encoded whole and cut at sequences. Other columns are
    ignored, whatever their names. An empty table gives an empty one. ``path``
    is a tokenizer file that every executor has.
    """
    ship(spark)

    def run(batches):
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer, end = WordIds(path), np.array([END_ID], "<u4").tobytes()
        packer, held = Packer(TaskContext.get().partitionId() << 36, capacity), {}

        def rows_of(placed):
            """Rows of placed pieces; a document's ids are let go with its last
            piece."""
            rows = []
            for doc, start, length, sequence, offset in placed:
                name, data, left = held[doc]
                part = data[4 * start : 4 * (start + length)]
                rows.append((name, start, length, zlib.crc32(part), len(data) // 4, *([bytes(part)] if with_ids else []), sequence, offset))
                if left == length:
                    del held[doc]
                else:
                    held[doc] = (name, data, left - length)
            return rows

        number = 0
        for b in batches:
            names, at, rows = b.column(0).to_pylist(), 0, []
            for s in textvec.slices(b.column(1)):
                for ids in tokenizer.encode(s):
                    data = memoryview(ids.tobytes() + end)
                    held[number] = (names[at], data, len(data) // 4)
                    rows += rows_of(packer.add(number, len(data) // 4))
                    number, at = number + 1, at + 1
            if rows:
                yield _pieces(rows, with_ids)
        if rows := rows_of(packer.finish()):
            yield _pieces(rows, with_ids)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(giving_back(run), schema + (", ids array<int>" if with_ids else ""))


def _pieces(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    ids = [columns.pop(5)] if with_ids else []
    arrays = [pa.array(c, pa.int64()) for c in columns] + [pa.array([np.frombuffer(x, np.int32) for x in c], pa.list_(pa.int32())) for c in ids]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if ids else [])])
