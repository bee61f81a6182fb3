"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Every document is the set of its word shingles. Sets are ordered by one global
order, rare shingles first. Two sets that reach the threshold share at least
``l`` tokens of their ``l``-prefixes, for every ``l``; a document picks the
``l`` with the least estimated cost, and a pair must share ``min(l, l')``
tokens of those levels, and as many as its sizes still require, before its
whole texts are compared, word by word.

Plan: texts of the same words collapse into classes first. Prefix tokens are
sorted by token and size band, and each class is tried against the leader of
its run, which is linear in the postings; what that links becomes one
component. Only pairs that are still in different components then meet, the
smaller set through its shorter index prefix, in keys of token, size band and,
for tokens of very many classes, hashed parts. A sketch of each set bounds from
below how far two differ. No pair is skipped otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec
from .components import connected_components
from .storage import Workspace, join_hot, small_or_shuffled

#: Log2 of the counters that estimate shingle frequencies; 4 MB in all, as a
#: broadcast of fixed size. They only steer the order, never the result.
COUNTER_BITS = 20
BLOCKS = 64
#: Longest extension of a prefix.
MOST_MATCHES = 4
#: Weight of comparing two sets against reading one posting.
VERIFY_COST = 8.0
#: Postings of one token that go to one task before its run is split.
RUN_ROWS = 100_000
#: Where a token's run is split: classes of its size band that the others are
#: tried against in a round, and the share of postings outside their token's main
#: component that a round must bring in for another one to follow.
LEADERS = 4
LEAST_GAIN = 0.02
#: 64-bit words of a set's sketch. A token flips one bit of it, so two sets
#: differ in as many tokens as their sketches in bits, at least.
SKETCH = 2
#: Postings of a token up to which all of them may meet.
FEW = 64
#: Size bands are wider than the threshold allows sizes to differ by this
#: factor, so that linked sizes are never two bands apart.
BAND_SLACK = 1.0001


_SIGNED = ["doc_id", "key", "sha", "n", "fp", "block", "counts"]


def text_sets(w: textvec.Words, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, bounds = textvec.shingles(w, size)
    for k in range(len(bounds) - 1):
        yield np.unique(hashes[bounds[k] : bounds[k + 1]])


def _signatures(size: int):
    def run(batches):
        counters = np.zeros(1 << COUNTER_BITS, np.uint32)
        for b in batches:
            ns, fps = [], []
            for s in textvec.slices(b.column(3)):
                w = textvec.words(s)
                kept = list(text_sets(w, size))
                ns += map(len, kept)
                fps += textvec.word_digests(s, w)
                np.add.at(counters, np.concatenate(kept) >> textvec.U64(64 - COUNTER_BITS), 1)
            n = len(ns)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(ns, pa.int64()), pa.array(fps, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=_SIGNED)
        parts = counters.reshape(BLOCKS, -1)
        used = [i for i in range(BLOCKS) if parts[i].any()]
        yield pa.RecordBatch.from_arrays(
            [*(pa.nulls(len(used), k) for k in (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary())), pa.array(used, pa.int32()), pa.array([parts[i].tobytes() for i in used], pa.binary())],
            names=_SIGNED,
        )

    return run


def _add_counters(batches):
    parts: dict[int, np.ndarray] = {}
    for b in batches:
        for block, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            x = np.frombuffer(data.as_buffer(), np.uint32)
            parts[block] = np.minimum(parts[block].astype(np.uint64) + x, 0xFFFFFFFF).astype(np.uint32) if block in parts else x
    yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([x.tobytes() for x in parts.values()], pa.binary())], names=["block", "counts"])


def _counters(signatures: DataFrame) -> np.ndarray:
    """Sums of the tasks' counters; each adder streams, so its memory is the
    table's fixed size whatever the number of tasks."""
    rows = signatures.where("block is not null").select("block", "counts")
    tasks = rows.count() // BLOCKS
    if tasks > 512:
        rows = rows.repartition(tasks // 64).mapInArrow(_add_counters, "block int, counts binary")
    out = np.zeros((BLOCKS, (1 << COUNTER_BITS) // BLOCKS), np.uint32)
    for r in rows.repartition(16, "block").mapInArrow(_add_counters, "block int, counts binary").collect():
        out[r.block] = np.frombuffer(bytes(r.counts), np.uint32)
    return out.ravel()


def choose_matches(costs: np.ndarray, base: int, most: int) -> int:
    """The number of shared tokens to ask for. ``costs``: estimated postings of
    the tokens in order; ``base``: length of the shortest prefix. A prefix of
    level l reads its postings, and by Markov's bound at most that many
    documents over l share l tokens and are compared."""
    best, pick = None, 1
    for matches in range(1, most + 1):
        read = float(costs[: base + matches - 1].sum())
        cost = read + VERIFY_COST * read / matches
        if best is None or cost < best:
            best, pick = cost, matches
    return pick


def prefix(x: np.ndarray, counts: np.ndarray, load: float, num: int, den: int) -> tuple[int, np.ndarray]:
    """The chosen level and the prefix tokens, in global order, of a set."""
    n = len(x)
    least = -(-num * n // den)
    found = counts[(x >> textvec.U64(64 - COUNTER_BITS)).astype(np.int64)]
    reach = min(n, n - least + MOST_MATCHES)
    order = np.argsort(found, kind="stable")[:reach]
    costs = np.maximum(found[order].astype(np.float64) - load, 0.0)
    level = choose_matches(costs, n - least + 1, max(1, min(MOST_MATCHES, least)))
    return level, x[order[: n - least + level]]


def sketch(x: np.ndarray) -> np.ndarray:
    flips = np.bincount((x & textvec.U64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH)
    return np.packbits((flips & 1).astype(np.uint8)).view(np.int64)


def _prefixes(size: int, counters, num: int, den: int, run_rows: int):
    """Each text's sketch, prefix, and those of its tokens whose run may be too
    long."""

    def run(batches):
        counts = counters.value
        load = float(counts.mean())
        for b in batches:
            keys = b.column(0).to_pylist()
            out = ([], [], [], [], [], [], [])
            for s in textvec.slices(b.column(1)):
                w = textvec.words(s)
                for k, (x, fp) in enumerate(zip(text_sets(w, size), textvec.word_digests(s, w), strict=True)):
                    if len(x):
                        level, tokens = prefix(x, counts, load, num, den)
                        often = tokens[counts[(tokens >> textvec.U64(64 - COUNTER_BITS)).astype(np.int64)] - load > run_rows]
                        for to, value in zip(out, (keys[s.first + k], fp, len(x), level, sketch(x), tokens.view(np.int64), often.view(np.int64)), strict=True):
                            to.append(value)
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int32(), *(pa.list_(pa.int64()) for _ in range(3)))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["key", "fp", "n", "level", "sketch", "tokens", "often"])

    return run


_MEMBER = ["cls", "n", "level", "pos", "root", *(f"s{k}" for k in range(SKETCH))]
_POSTING = ["token", "salt", "band", "cls", "n", "level", "pos"]


def _runs(batches):
    """Rows sorted by (token, salt, band): those whose (token, salt) another
    class has too, each with the first class of its band's run as leader. A
    salted token (salt above 0) has more classes in other runs, so all of its
    rows stay. Carries one row."""
    held = None
    for b in batches:
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(len(_POSTING))]
        if not len(cols[0]):
            continue
        if held is not None:
            cols = [np.concatenate([h, c]) for h, c in zip(held[0], cols, strict=True)]
        m = len(cols[0])
        new = np.ones(m, bool)
        new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
        first = np.flatnonzero(new)
        length = np.diff(np.append(first, m))
        keep = np.repeat(length > 1, length) | (cols[1] > 0)
        new[1:] |= cols[2][1:] != cols[2][:-1]
        first = np.flatnonzero(new)
        leader = np.repeat(first, np.diff(np.append(first, m)))
        lead = [c[leader] for c in cols[3:]]
        if held is not None:
            keep[0] = keep[0] and not held[1]
            for x, value in zip(lead, held[2], strict=True):
                x[leader == 0] = value
        out = [c[keep] for c in cols] + [x[keep] for x in lead]
        held = ([c[-1:] for c in cols], bool(keep[m - 1]), tuple(x[-1] for x in lead))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=[*_POSTING, *(f"l_{x}" for x in _POSTING[3:])])


_RUN_SCHEMA = "token long, salt long, band int, cls long, n long, level int, pos int, l_cls long, l_n long, l_level int, l_pos int"


def _word_sets(text: str, size: int) -> set[tuple[bytes, ...]]:
    """A text's shingles as they are, for slices in which two words or shingles
    have one hash."""
    low = bytes(textvec.LOWER[np.frombuffer(text.encode(), np.uint8)])
    words = bytes(np.where(textvec.BLANK[np.frombuffer(low, np.uint8)], np.uint8(32), np.frombuffer(low, np.uint8))).split()
    return {tuple(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))} if words else set()


def linked(s: textvec.Slice, size: int, num: int, den: int) -> np.ndarray:
    """Which pairs of texts (0 and 1, 2 and 3, ...) reach the threshold, on the
    words themselves: hashes name words and shingles only where all that share
    one are found to be the same bytes."""
    w = textvec.words(s)
    _, first, name = np.unique(w.hash, return_index=True, return_inverse=True)
    length = w.end - w.start
    sound = bool((length == length[first[name]]).all() and w.same_bytes(w.start, w.end, w.start[first[name]]).all())
    hashes, bounds = textvec.shingles(w, size)
    start, _ = textvec.shingle_starts(w, size)
    text = np.repeat(np.arange(len(s)), np.diff(bounds))
    _, one, shingle = np.unique(hashes, return_index=True, return_inverse=True)
    many = np.minimum(np.diff(w.first)[text], size)
    name = np.append(name, np.full(size, -1))
    sound = sound and bool((many == many[one[shingle]]).all())
    for k in range(size):
        sound = sound and bool(((name[start + k] == name[start[one[shingle]] + k]) | (many <= k)).all())
    if not sound:
        texts = [bytes(s.data[i:j]).decode() for i, j in zip(s.bounds[:-1], s.bounds[1:], strict=True)]
        pairs = [(_word_sets(x, size), _word_sets(y, size)) for x, y in zip(texts[::2], texts[1::2], strict=True)]
        return np.array([den * len(x & y) >= num * len(x | y) for x, y in pairs], bool)
    distinct = np.unique(text * max(len(one), 1) + shingle)
    text, shingle = np.divmod(distinct, max(len(one), 1))
    sizes = np.bincount(text, minlength=len(s)).reshape(-1, 2).sum(1)
    pair, seen = np.unique((text // 2) * max(len(one), 1) + shingle, return_counts=True)
    both = np.bincount((pair // max(len(one), 1))[seen == 2], minlength=len(s) // 2)
    return den * both >= num * (sizes - both)


def _linked(size: int, num: int, den: int):
    """Rows (a, b, x, y) of two texts each: the (a, b) that reach the threshold."""

    def run(batches):
        for b in batches:
            side = np.arange(b.num_rows)
            texts = pa.concat_arrays([b.column(2), b.column(3)]).take(pa.array(np.stack([side, side + b.num_rows], 1).ravel()))
            keep = [linked(s, size, num, den) for s in textvec.slices(texts, together=2)]
            yield b.select([0, 1]).filter(pa.array(np.concatenate(keep) if keep else [], pa.bool_()))

    return run


class JaccardJoin:
    """One run of the join over ``docs``; see :func:`jaccard_components`.

    ``key`` finds a document's text again: its id, or a hash of the text where
    it has none. A class is all texts of the same words, and has a number of
    its own, as ids may repeat."""

    def __init__(self, spark: SparkSession, docs: DataFrame, size: int, num: int, den: int, id_col: str, text_col: str):
        self.spark, self.size, self.num, self.den = spark, size, num, den
        text = F.col(text_col)
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text)).alias("key"), F.unhex(F.sha2(text, 256)).alias("sha"), text.alias("text"))
        self.work = Workspace(spark, "jaccard")
        self.edges: DataFrame | None = None

    def sign(self) -> None:
        """Writes each document's size and digest, and the classes."""
        sig = self.work.write(self.docs.mapInArrow(_signatures(self.size), "doc_id long, key long, sha binary, n long, fp binary, block int, counts binary"), "signatures")
        self.counters = self.spark.sparkContext.broadcast(_counters(sig))
        self.signed = sig.where("block is null").select("doc_id", "key", "sha", "n", "fp").withColumn("me", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sha"))
        classes = self.signed.where("n > 0").groupBy("fp", "n").agg(F.min("me").alias("least"), F.coalesce(F.min("doc_id"), F.min("key")).alias("key"), F.count("*").alias("rows"))
        self.classes = self.work.write(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")

    def _band(self, n: str):
        return F.floor(F.log(F.col(n).cast("double")) / math.log(self.den / self.num * BAND_SLACK)).cast("int") if self.num < self.den else F.col(n).cast("int")

    def postings(self) -> DataFrame:
        rows = self.docs.select("key", "text").mapInArrow(_prefixes(self.size, self.counters, self.num, self.den, RUN_ROWS), "key long, fp binary, n long, level int, sketch array<long>, tokens array<long>, often array<long>")
        rows = rows.join(self.classes.select("key", "fp", "cls"), ["key", "fp"]).dropDuplicates(["key", "fp"]).drop("key", "fp")
        self.prefixes = self.work.write(rows, "prefixes")
        rows = self.prefixes.select("cls", "n", "level", "often", self._band("n").alias("band"), F.posexplode("tokens").alias("pos", "token"))
        parts = 1 + int(self.counters.value.max()) // RUN_ROWS
        salt = F.when(F.array_contains("often", F.col("token")), 1 + F.pmod(F.xxhash64("cls"), F.lit(parts))).otherwise(0).cast("long")
        rows = rows.select("token", salt.alias("salt"), "band", "cls", "n", "level", (F.col("pos") + 1).alias("pos"))
        runs = rows.repartition("token", "salt").sortWithinPartitions("token", "salt", "band", "pos", "cls").mapInArrow(_runs, _RUN_SCHEMA)
        return self.work.write(runs, "postings")

    def _want(self, a: str, b: str) -> str:
        """The overlap that two sizes need."""
        return f"(({self.num} * ({a} + {b}) + {self.num + self.den - 1}) div {self.num + self.den})"

    def _room(self) -> str:
        """Whether a shared token leaves room for that overlap: with l the lesser
        level, it does for each of a linked pair's first l shared tokens."""
        return f"least(level_a, level_b) + least(n_a - pos_a, n_b - pos_b) >= {self._want('n_a', 'n_b')}"

    def _alike(self, a: str, b: str, to_a: str = "", to_b: str = "") -> str:
        """Whether two sketches differ in no more bits than linked sets may
        differ in tokens."""
        apart = " + ".join(f"bit_count({a}s{k}{to_a} ^ {b}s{k}{to_b})" for k in range(SKETCH))
        n, m = f"{a}n{to_a}", f"{b}n{to_b}"
        return f"{apart} <= {n} + {m} - 2 * {self._want(n, m)}"

    def _pairs(self, near: DataFrame) -> DataFrame:
        """Pairs (a, b) of rows (a, b, n_a, n_b, level_a, level_b, pos_a,
        pos_b), one for each shared token that leaves room, that may be linked:
        as many tokens as the lesser level, and with what is left behind the
        last of them enough for the overlap."""
        rest = F.min(F.expr("least(n_a - pos_a, n_b - pos_b)")).alias("rest")
        counted = near.groupBy("a", "b", "n_a", "n_b", "level_a", "level_b").agg(F.count("*").alias("shared"), rest)
        return counted.where(f"shared >= least(level_a, level_b) and shared + rest >= {self._want('n_a', 'n_b')}").select("a", "b")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of classes whose whole texts reach the threshold."""
        pairs = self.work.write(pairs, "candidates")
        wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
        wanted = self.work.write(self.classes.select("cls", "key", "fp").join(small_or_shuffled(wanted), "cls", "left_semi"), "wanted")

        def signed(batches):
            for b in batches:
                fps = [fp for s in textvec.slices(b.column(1)) for fp in textvec.word_digests(s, textvec.words(s))]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.binary()), b.column(1)], names=["key", "fp", "text"])

        texts = self.docs.select("key", "text").join(small_or_shuffled(wanted.select("key").distinct()), "key", "left_semi").mapInArrow(signed, "key long, fp binary, text string")
        texts = self.work.write(texts.join(wanted, ["key", "fp"]).dropDuplicates(["key", "fp"]).select("cls", "text"), "texts")
        both = join_hot(self.work, pairs, texts.select(F.col("cls").alias("a"), F.col("text").alias("x")), "a", ["b"], 10_000)
        both = join_hot(self.work, both, texts.select(F.col("cls").alias("b"), F.col("text").alias("y")), "b", ["a"], 10_000, pairs)
        out = self.work.write(both.select("a", "b", "x", "y").mapInArrow(_linked(self.size, self.num, self.den), "a long, b long").distinct(), "links")
        self.work.drop(texts, wanted, pairs)
        return out

    def _joined(self, links: DataFrame) -> DataFrame:
        """Components of all links so far."""
        if self.edges is None or not links.isEmpty():
            self.edges = links if self.edges is None else self.edges.unionByName(links)
            self.roots = connected_components(self.spark, self.edges, self.work)
        return self.roots

    def _index(self) -> str:
        """Whether a posting lies in its set's index prefix: it leaves room for
        the overlap with a set as large."""
        return f"level + n - pos >= {self._want('n', 'n')}"

    def _placed(self, postings: DataFrame, roots: DataFrame) -> DataFrame:
        """Postings of tokens that still lie in several components, and in an
        index prefix, with the token's main component and number of postings."""
        known = self.prefixes.select("cls", *(F.col("sketch")[k].alias(f"s{k}") for k in range(SKETCH))).join(roots.withColumnRenamed("node", "cls"), "cls", "left")
        rows = postings.select(*_POSTING).join(known, "cls").withColumn("root", F.coalesce("root", "cls"))
        groups = rows.groupBy("token", "root").agg(F.count("*").alias("m"), F.max("salt").alias("last"), F.count_if(F.expr(self._index())).alias("index"))
        largest = F.max(F.struct("m", "root")).alias("largest")
        mixed = groups.groupBy("token").agg(largest, F.sum("m").alias("all"), F.max("last").alias("last"), F.sum("index").alias("index")).where("largest.m < `all` and index > 0")
        mixed = mixed.select("token", F.col("largest.root").alias("main"), "all", F.explode(F.sequence(F.least("last", F.lit(1)), "last")).alias("salt"))
        return self.work.write(rows.join(mixed, ["token", "salt"]), "mixed")

    def _outside(self, rows: DataFrame) -> int:
        """Postings of split runs outside their token's main component."""
        return rows.where("salt > 0 and root <> main").count()

    def stars(self, rows: DataFrame, turn: int) -> DataFrame:
        """Pairs of each class with LEADERS more of each of its tokens whose run
        was split, as the parts had leaders of their own: of its size band and
        those beside it, the first one in the order and some drawn by a hash.
        As many pairs as postings, whatever they share."""
        row = F.struct(*_MEMBER)
        rows = rows.where("salt > 0")
        drawn = rows.groupBy("token", "band").agg(*(F.min_by(row, F.struct(F.lit(0) if k else F.col("pos"), F.xxhash64("cls", F.lit(turn * LEADERS + k)))).alias(f"l{k}") for k in range(LEADERS)))
        drawn = drawn.select("token", F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)).alias("band"), F.array_distinct(F.array(*(f"l{k}" for k in range(LEADERS)))).alias("leads"))
        runs = rows.select("token", "salt", "band").distinct()
        near = rows.join(runs.join(drawn, ["token", "band"]), ["token", "salt", "band"]).withColumn("l", F.explode("leads"))
        near = near.where(F.expr(f"l.root <> root and {self.num} * greatest(n, l.n) <= {self.den} * least(n, l.n) and {self._alike('', 'l.')}"))
        near = near.select(*_POSTING[3:], *(F.col(f"l.{c}").alias(f"l_{c}") for c in _POSTING[3:]))
        return self._pairs(_ends(near).where(self._room()))

    def all_pairs(self, rows: DataFrame) -> DataFrame:
        """Pairs of classes in different components that may be linked, the
        smaller set as a. A pair needs room for its overlap behind a shared
        token, so the smaller one's lies within its index prefix; those of
        a token's main component meet only those outside it. Keys: the size
        band of the larger set, and parts of both sides, so no task holds more
        than two parts. Tokens of FEW postings have one key each."""
        few = F.col("all") <= FEW
        parts = F.expr(f"1 + `all` div {RUN_ROWS}")
        part = F.pmod(F.xxhash64("cls"), parts)
        every = F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))
        inside = ~few & (F.col("root") == F.col("main"))
        rows = rows.withColumn("band", F.when(few, F.lit(-1)).otherwise(F.col("band")))
        a = rows.where(self._index()).withColumn("band", F.explode(F.when(few, F.array("band")).otherwise(F.array(F.col("band"), F.col("band") + 1))))
        a = a.select("token", "band", F.when(inside, 1).otherwise(0).alias("side"), part.alias("part_a"), every.alias("part_b"), *(F.col(c).alias(f"{c}_a") for c in _MEMBER))
        b = rows.withColumn("side", F.explode(F.when(inside | few, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
        b = b.select("token", "band", "side", part.alias("part_b"), every.alias("part_a"), *(F.col(c).alias(f"{c}_b") for c in _MEMBER))
        near = a.join(b, ["token", "band", "side", "part_a", "part_b"])
        near = near.where(F.expr(f"(n_a < n_b or (n_a = n_b and cls_a < cls_b)) and root_a <> root_b and {self.num} * n_b <= {self.den} * n_a and {self._room()} and {self._alike('', '', '_a', '_b')}"))
        return self._pairs(near.withColumnsRenamed({"cls_a": "a", "cls_b": "b"}))

    def run(self) -> DataFrame:
        self.sign()
        postings = self.postings()
        near = postings.where(f"cls <> l_cls and {self.num} * greatest(n, l_n) <= {self.den} * least(n, l_n)")
        roots = self._joined(self.verify(self._pairs(_ends(near).where(self._room()))))
        rows, turn = self._placed(postings, roots), 0
        left = self._outside(rows)
        while left:
            roots = self._joined(self.verify(self.stars(rows, turn)))
            self.work.drop(rows)
            rows, turn, before = self._placed(postings, roots), turn + 1, left
            left = self._outside(rows)
            if before - left <= LEAST_GAIN * before:
                break
        roots = self._joined(self.verify(self.all_pairs(rows)))
        linked = self.classes.select("cls", "least").join(roots.select(F.col("node").alias("cls"), "root").union(roots.select(F.col("root").alias("cls"), "root").distinct()), "cls")
        linked = self.work.write(linked, "linked")
        least = linked.groupBy("root").agg(F.min("least").alias("reached"))
        reached = join_hot(self.work, linked, least, "root", ["cls"]).select("cls", "reached")
        named = self.classes.select("fp", "cls", "least").join(reached, "cls", "left").select("fp", F.coalesce("reached", "least").alias("first"))
        out = join_hot(self.work, self.signed.where("fp is not null"), named, "fp", ["doc_id", "sha"], sizes=self.classes.select("fp", "rows"))
        out = out.unionByName(self.signed.where("fp is null").withColumn("first", F.col("me")))
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("first.doc_id").alias("component_id"), (F.col("me") == F.col("first")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def _ends(near: DataFrame) -> DataFrame:
    """Class and leader of each posting, the smaller number as a."""
    flip = F.col("cls") <= F.col("l_cls")
    names = {"cls": "", "n": "n_", "level": "level_", "pos": "pos_"}
    pick = lambda c, first: F.when(flip if first else ~flip, F.col(c)).otherwise(F.col(f"l_{c}"))
    return near.select(*[pick(c, end == "a").alias(f"{to}{end}") for c, to in names.items() for end in "ab"])


def jaccard_components(spark: SparkSession, docs: DataFrame, size: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles`` (size of its set
    of ``size``-word shingles), ``component_id``, the smallest doc_id that links
    of Jaccard similarity ``num/den`` or more reach, ``kept`` for one text of
    each group, and the text's SHA-256, null for a null text: of the rows with
    the group's smallest doc_id, those whose text has the smallest digest are
    kept, so only rows equal in both are kept together.

    Words are the runs outside space and \\t-\\r, A-Z lower-cased. A text with
    fewer than ``size`` words is one shingle; a null, empty or blank text has
    none and links with nothing, so its component is its own id. Texts are read
    whole, however long. Every row is a document by itself: rows that repeat a
    doc_id link as their own texts do, and a null id never names a component
    but takes its group's, or null where the group has no id. Ties in the
    global order change no result. Other columns are ignored, whatever their
    names. An empty table gives an empty one.
    """
    return JaccardJoin(spark, docs, size, num, den, id_col, text_col).run()
