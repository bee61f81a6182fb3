"""Language identification by nearest centroids of character n-grams.

A text is the L2-normalised TF-IDF vector of its hashed byte n-grams, taken
over the whole text. Each language has several centroids, found by spherical
k-means over its own training vectors; a text takes the language of the
centroid with the largest cosine, and is rejected when even that one is farther
than nearly all training texts are from theirs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec
from .storage import beside_rows, giving_back, ship

#: Hashed n-gram dimensions and the n-gram lengths in bytes.
BUCKETS = 4096
GRAMS = (1, 2, 3)
#: Texts whose counts are held at once, and their bytes, but one whole text at
#: least: a worker's arrays are many times as large.
ROWS = 64
BYTES = 1 << 18
#: Training texts of one language, chosen by a hash of their id: the classifier
#: is fitted on about that many, and on TRAIN_TOTAL over all languages, but
#: TRAIN_LEAST of each, so that every language is learned.
TRAIN_PER_LANGUAGE = 800
TRAIN_TOTAL = 6000
TRAIN_LEAST = 20
#: Centroids of one language; fewer where MOST_CENTROIDS over all would be
#: exceeded, but one at least.
CENTROIDS = 4
MOST_CENTROIDS = 1024
#: A text is rejected when its distance exceeds REJECT_FACTOR times the
#: distance that this share of training texts stays within, or reaches
#: REJECT_FLOOR in any case. Short texts vary more, so the limit is per
#: power of two of n-grams; but it is nowhere below that of the class with the
#: most training texts, as a few texts without an odd one among them say little
#: about those of their length, and nothing about longer ones.
REJECT_QUANTILE = 0.999
REJECT_FACTOR = 1.25


#: Lower-case letters and the bytes of other scripts; all else is a blank.
_SYMBOL = np.full(256, 32, np.uint8)
_SYMBOL[97:123] = _SYMBOL[65:91] = np.arange(97, 123)
_SYMBOL[128:] = np.arange(128, 256)


def gram_counts(s: textvec.Slice) -> np.ndarray:
    """Counts of hashed n-grams of each text: letters alone, a run of anything
    else being one blank; n-grams don't cross texts. Texts by BUCKETS."""
    b = _SYMBOL[s.data]
    rows = len(s)
    row = np.repeat(np.arange(rows, dtype=np.int64), np.diff(s.bounds))
    keep = b != 32
    keep[1:] |= b[:-1] != 32
    b, row = b[keep].astype(np.uint32), row[keep]
    out = np.zeros(rows * BUCKETS, np.float32)
    code = np.zeros(len(b), np.uint32)
    for size in range(1, max(GRAMS) + 1):
        if len(b) < size:
            break
        code = code[: len(b) - size + 1] * np.uint32(256) + b[size - 1 :]
        if size in GRAMS:
            bucket = (code * np.uint32(2654435761) + np.uint32(size * 40503)) >> np.uint32(20)
            same = row[: len(code)] == row[size - 1 :]
            out += np.bincount(row[: len(code)][same] * BUCKETS + bucket[same], minlength=rows * BUCKETS)
    return out.reshape(rows, BUCKETS)


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """At most k unit centroids; farthest-first start, so no seed is needed."""
    centroids = [x.mean(0)]
    nearest = x @ (centroids[0] / max(np.linalg.norm(centroids[0]), 1e-12))
    centroids = [x[int(nearest.argmax())]]
    while len(centroids) < min(k, len(x)):
        nearest = np.max([x @ c for c in centroids], axis=0)
        centroids.append(x[int(nearest.argmin())])
    c = np.array(centroids)
    for _ in range(rounds):
        owner = (x @ c.T).argmax(1)
        c = np.array([x[owner == i].sum(0) if (owner == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    limit: np.ndarray

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, cosine and rejection of each row."""
        cosine = _vectors(counts, self.idf) @ self.centroids.T
        best = cosine.argmax(1)
        score = np.clip(cosine[np.arange(len(best)), best], 0.0, 1.0)
        size = np.minimum(np.log2(1 + counts.sum(1)).astype(int), len(self.limit) - 1)
        return self.owner[best], score, 1 - score > self.limit[size]


def distance_limits(distance: np.ndarray, size: np.ndarray) -> np.ndarray | None:
    """Of each size class, from the training texts' distances and classes; None
    if no class has enough texts."""
    limit, texts = np.full(40, np.nan), np.zeros(40, int)
    for k in range(40):
        near = distance[np.abs(size - k) <= 1]
        texts[k] = len(near)
        if len(near) >= 50:
            limit[k] = min(0.999, REJECT_FACTOR * float(np.quantile(near, REJECT_QUANTILE)))
    known_at = np.flatnonzero(~np.isnan(limit))
    if not len(known_at):
        return None
    limit[: known_at[0]] = 0.999  # too short to have been learned: only a text with nothing in common goes
    limit = np.array([limit[known_at[np.abs(known_at - k).argmin()]] if np.isnan(v) else v for k, v in enumerate(limit)])
    return np.maximum(limit, limit[texts.argmax()])


def fit(spark: SparkSession, labelled: DataFrame) -> LanguageModel:
    """``labelled(doc_id, text, lang)``: rows with a null text or lang are left
    out. The number of rows of each language is counted over all; then about
    TRAIN_PER_LANGUAGE of each are taken by a hash of doc_id."""
    ship(spark)
    known = labelled.where("lang is not null and text is not null")
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()  # a row for each language
    if not sizes:
        return LanguageModel([], np.ones(BUCKETS), np.zeros((1, BUCKETS)), np.array([-1]), np.full(40, np.inf))
    each = max(TRAIN_LEAST, min(TRAIN_PER_LANGUAGE, TRAIN_TOTAL / len(sizes)))
    centroids = max(1, min(CENTROIDS, MOST_CENTROIDS // len(sizes)))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map([F.lit(x) for r in sizes for x in (r["lang"], min(1.0, each / r["count"]))])[F.col("lang")]

    def vectors(batches):
        for b in batches:
            for s in textvec.slices(b.column(1), BYTES, ROWS):
                x = gram_counts(s)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s.first, len(s)), pa.array([r.astype(np.uint16 if r.max() < 65535 else np.float32).tobytes() for r in x], pa.binary())], names=["lang", "x"])

    rows = known.where(draw < share).select("lang", "text").mapInArrow(giving_back(vectors), "lang string, x binary").collect()
    x = np.array([np.frombuffer(bytes(r.x), np.uint16 if len(r.x) == 2 * BUCKETS else np.float32).astype(np.float32) for r in rows]).reshape(-1, BUCKETS)
    names = [r["lang"] for r in sizes]
    number = {name: i for i, name in enumerate(names)}
    lang = np.array([number[r["lang"]] for r in rows], int)
    del rows
    order = np.lexsort((x[:, 0], x.sum(1), lang))
    x, lang = x[order], lang[order]
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1).astype(np.float32)
    unit = _vectors(x, idf)
    parts = [spherical_kmeans(unit[lang == i], centroids) for i in range(len(names)) if (lang == i).any()]
    owner = np.concatenate([np.full(len(p), i) for p, i in zip(parts, [i for i in range(len(names)) if (lang == i).any()], strict=True)])
    model = LanguageModel(names, idf, np.concatenate(parts), owner, np.full(40, np.inf))
    del unit
    score = np.concatenate([model.predict(x[i : i + ROWS])[1] for i in range(0, len(x), ROWS)]) if len(x) else np.zeros(0)
    size = np.minimum(np.log2(1 + x.sum(1)).astype(int), 39)
    limit = distance_limits(1 - score, size)
    if limit is not None:
        model.limit = limit
    return model


def identify(spark: SparkSession, docs: DataFrame, model: LanguageModel, text_col: str = "text", id_col: str = "doc_id", whole_rows: bool = False) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` (cosine to the nearest centroid, 0
    to 1) and ``rejected`` for every row of ``docs``; with ``whole_rows`` a
    struct ``row`` of all its columns in the place of ``doc_id``.

    A null or letterless text is ``und`` with score 0 and counts as rejected.
    With no model (nothing labelled) every text is ``und``. Ties go to the
    centroid of the more frequent language. Ids may be null or repeat: each row
    is judged by itself. Very long texts are counted whole. Other columns are
    ignored, whatever their names. An empty table gives an empty one.
    """
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow.compute as pc

        m = shared.value
        for b in batches:
            names, scores, out = [], [], []
            for s in textvec.slices(b.column(1), BYTES, ROWS):
                index, score, far = m.predict(gram_counts(s))
                names += [m.languages[i] if i >= 0 else "und" for i in index]
                scores.append(score)
                out.append(far | (index < 0))
            letter = b.column(2)
            score = pc.if_else(letter, pa.array(np.concatenate(scores) if scores else [], pa.float64()), 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pc.if_else(letter, pa.array(names, pa.string()), "und"), score, pc.or_(pc.invert(letter), pa.array(np.concatenate(out) if out else [], pa.bool_()))], names=[b.schema.names[0], "lang_pred", "score", "rejected"])

    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    return beside_rows(docs, id_col, whole_rows, [F.col(text_col), letter], run, "lang_pred string, score double, rejected boolean")
