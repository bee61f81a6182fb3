"""Severity of toxic language by cumulative-link ordinal regression.

Features are sparse: counts of hashed words and word beginnings that the
labelled texts tie to toxicity. One weight vector serves all thresholds,
P(grade <= k) = sigmoid(theta_k - w.x), and the output is the expected grade.

A text is as toxic as its strongest passage: it is cut whole into overlapping
passages of PASSAGE words, so chance hits don't add up with its length.

Labels only say toxic or not, so training grades are 0 for the others and 1 to
GRADES for toxic texts, by quantiles of their amount of indicative features.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec
from .storage import beside_rows, giving_back, ship

#: Words of a passage; the next one begins in its middle.
PASSAGE = 128
#: Leading bits of a hash by which most of those that are no feature are passed
#: over; what remains is compared whole.
SIEVE_BITS = 20
#: Lengths, in bytes, of the word beginnings that are features beside the word.
STEMS = (3, 4, 5, 6)
#: The regression is fitted on so many labelled texts of each class at most,
#: chosen by a hash of their id.
TRAIN_PER_CLASS = 2500
#: Features kept, those with the largest log odds.
FEATURES = 2048
#: A feature needs this log-likelihood ratio (about p = 1e-6) and log odds.
LEAST_RATIO = 24.0
LEAST_LOG_ODDS = 4.0
GRADES = 3
#: A text is called toxic from this probability of a grade over 0.
TOXIC_AT = 0.5

_SEPARATOR = np.ones(256, bool)
_SEPARATOR[48:58] = _SEPARATOR[65:91] = _SEPARATOR[97:123] = False
_SEPARATOR[128:] = False


def feature_hashes(s: textvec.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of a slice's words, all words' first, then all word
    beginnings by length, with the word of each, and the first word of each
    text."""
    w = textvec.words(s, _SEPARATOR)
    word = np.arange(len(w.hash))
    found, words = [w.hash], [word]
    length = w.end - w.start
    for k in STEMS:
        long = length > k
        found.append(textvec.mix(w.span_hash(w.start[long], w.start[long] + k) + textvec.U64(k)))
        words.append(word[long])
    return np.concatenate(found), np.concatenate(words), w.first


class Features:
    """Feature hashes, ascending; a feature's column is its place among them."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)
        self.sieve[self._leading(hashes)] = True

    @staticmethod
    def _leading(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> textvec.U64(64 - SIEVE_BITS)).astype(np.int64)

    def passages(self, s: textvec.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Passage, column and count of what a slice's passages hold, in that
        order, and the first passage of each text, which has one at least."""
        hashes, word, first = feature_hashes(s)
        near = np.flatnonzero(self.sieve[self._leading(hashes)])
        column = np.searchsorted(self.hashes, hashes[near])
        same = self.hashes[np.minimum(column, len(self.hashes) - 1)] == hashes[near] if len(self.hashes) else np.zeros(len(near), bool)
        column, word = column[same], word[near[same]]
        number = np.maximum(-(-np.diff(first) // (PASSAGE // 2)) - 1, 1)
        start = np.concatenate([[0], np.cumsum(number)])
        text = np.searchsorted(first, word, "right") - 1
        half = (word - first[text]) // (PASSAGE // 2)
        opens, ends = half < number[text], half > 0
        passage = np.concatenate([(start[text] + half)[opens], (start[text] + half - 1)[ends]])
        cells, counts = np.unique(passage * max(len(self.hashes), 1) + np.concatenate([column[opens], column[ends]]), return_counts=True)
        return *np.divmod(cells, max(len(self.hashes), 1)), counts, start


@dataclass
class ToxicityModel:
    features: Features
    weight: np.ndarray
    theta: np.ndarray

    def grades(self, x: np.ndarray) -> np.ndarray:
        """P(grade = 0 .. GRADES) for each w.x."""
        at_most = 1 / (1 + np.exp(-np.clip(self.theta[None] - x[:, None], -40, 40)))
        return np.diff(np.concatenate([np.zeros((len(x), 1)), at_most, np.ones((len(x), 1))], axis=1), axis=1)

    def linear(self, s: textvec.Slice) -> np.ndarray:
        """w.x of each text's strongest passage."""
        passage, column, counts, start = self.features.passages(s)
        x = np.bincount(passage, np.log1p(counts) * self.weight[column], minlength=start[-1])
        return np.maximum.reduceat(x, start[:-1])


def _empty() -> ToxicityModel:
    return ToxicityModel(Features(np.zeros(0, textvec.U64)), np.zeros(0), np.arange(GRADES) + 5.0)


def fit_ordinal(x: np.ndarray, grade: np.ndarray, grades: int, rounds: int = 400, penalty: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds that maximise the penalised likelihood,
    by Adam on (w, theta_0, log gaps). Grade 0 and all others weigh the same."""
    n, d = x.shape
    weigh = np.where(grade > 0, 0.5 / max((grade > 0).sum(), 1), 0.5 / max((grade == 0).sum(), 1))
    share = np.clip(np.cumsum(np.bincount(grade, weigh, minlength=grades + 1))[:-1], 1e-3, 1 - 1e-3)
    theta = np.log(share / (1 - share))
    par = np.concatenate([np.zeros(d), theta[:1], np.log(np.maximum(np.diff(theta), 0.05))])
    m, v = np.zeros_like(par), np.zeros_like(par)
    for t in range(1, rounds + 1):
        gaps = np.exp(par[d + 1 :])
        theta = par[d] + np.concatenate([[0.0], np.cumsum(gaps)])
        z = x @ par[:d]
        up = 1 / (1 + np.exp(-np.clip(np.append(theta, np.inf)[grade] - z, -40, 40)))
        low = 1 / (1 + np.exp(-np.clip(np.append(-np.inf, theta)[grade] - z, -40, 40)))
        p = np.maximum(up - low, 1e-9)
        du, dl = weigh * up * (1 - up) / p, weigh * low * (1 - low) / p
        g_theta = np.bincount(grade, du, minlength=grades + 1)[:grades] - np.bincount(grade, dl, minlength=grades + 1)[1:]
        g = np.concatenate([x.T @ (dl - du), [g_theta.sum()], [g_theta[k + 1 :].sum() * gaps[k] for k in range(grades - 1)]])
        g[:d] -= penalty * par[:d]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        par += 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return par[:d], par[d] + np.concatenate([[0.0], np.cumsum(np.exp(par[d + 1 :]))])


def distinct_hashes(s: textvec.Slice) -> list[np.ndarray]:
    """Of each text."""
    hashes, word, first = feature_hashes(s)
    text = np.searchsorted(first, word, "right") - 1
    order = np.argsort(text, kind="stable")
    ends = np.searchsorted(text[order], np.arange(len(s) + 1))
    return [np.unique(hashes[order[i:j]]) for i, j in zip(ends[:-1], ends[1:], strict=True)]


def strongest(s: textvec.Slice, features: Features, odds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Columns and counts of each text's passage with the largest odds."""
    passage, column, counts, start = features.passages(s)
    amount = np.bincount(passage, np.log1p(counts) * odds[column], minlength=start[-1])
    best = [i + int(amount[i:j].argmax()) for i, j in zip(start[:-1], start[1:], strict=True)]
    low, high = np.searchsorted(passage, best), np.searchsorted(passage, best, "right")
    return [(column[i:j], counts[i:j]) for i, j in zip(low, high, strict=True)]


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """``labels(doc_id, toxic)``: null labels are left out; a document with
    several labels counts as toxic if one says so. Up to TRAIN_PER_CLASS texts
    of each class are taken by a hash of doc_id."""
    ship(spark)
    given = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sizes = {r.toxic: r["count"] for r in given.groupBy("toxic").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        return _empty()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    some = given.where(F.when(F.col("toxic") > 0, draw < TRAIN_PER_CLASS / sizes[1]).otherwise(draw < TRAIN_PER_CLASS / sizes[0]))
    #: The chosen labels are bounded by 2 * TRAIN_PER_CLASS in expectation, so they may be broadcast.
    chosen = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some), "doc_id").select("toxic", "text")

    def rows_of(packed) -> list[tuple[int, bytes]]:
        def run(batches):
            for b in batches:
                for s in textvec.slices(b.column(1)):
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(s.first, len(s)), pa.array(packed(s), pa.binary())], names=["toxic", "x"])

        return sorted((min(r.toxic, 1), bytes(r.x)) for r in chosen.mapInArrow(giving_back(run), "toxic int, x binary").collect())

    features, odds = choose_features([(t, np.frombuffer(x, textvec.U64)) for t, x in rows_of(lambda s: [h.tobytes() for h in distinct_hashes(s)])])
    if not len(odds):
        return _empty()
    found = rows_of(lambda s: [np.concatenate(f).astype(np.int32).tobytes() for f in strongest(s, features, odds)])
    return fit_rows([(t, *np.frombuffer(x, np.int32).reshape(2, -1)) for t, x in found], features, odds)


def _log_likelihood_ratio(toxic: np.ndarray, clean: np.ndarray, n: list[int]) -> np.ndarray:
    """Of each feature's presence against independence from the class."""
    total = np.array([[toxic, n[1] - toxic], [clean, n[0] - clean]], float)
    expected = total.sum(1)[:, None] * total.sum(0)[None] / (n[0] + n[1])
    return 2 * np.where(total > 0, total * np.log(np.maximum(total, 1e-9) / np.maximum(expected, 1e-9)), 0).sum((0, 1))


def choose_features(rows: list[tuple[int, np.ndarray]]) -> tuple[Features, np.ndarray]:
    """And their log odds, from (toxic, distinct hashes) of the chosen texts."""
    n = [sum(t == k for t, _ in rows) for k in (0, 1)]
    if not all(n):
        return Features(np.zeros(0, textvec.U64)), np.zeros(0)
    hashes, toxic = np.unique(np.concatenate([h for t, h in rows if t]), return_counts=True)
    clean = np.zeros(len(hashes))
    if len(hashes):
        for t, h in rows:
            if not t:
                at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                clean[at[hashes[at] == h]] += 1
    odds = np.log((toxic + 0.1) / n[1]) - np.log((clean + 0.1) / n[0])
    odds[odds < LEAST_LOG_ODDS] = 0
    often = np.flatnonzero(odds)
    odds[often[_log_likelihood_ratio(toxic[often], clean[often], n) < LEAST_RATIO]] = 0
    picked = np.argsort(-odds * np.sqrt(toxic), kind="stable")[:FEATURES]
    picked = np.sort(picked[odds[picked] > 0])
    return Features(hashes[picked]), odds[picked]


def fit_rows(rows: list[tuple[int, np.ndarray, np.ndarray]], features: Features, odds: np.ndarray) -> ToxicityModel:
    """From (toxic, columns, counts) of the chosen texts' strongest passages."""
    x, y, amount = np.zeros((len(rows), len(odds)), np.float32), np.zeros(len(rows), int), np.zeros(len(rows))
    for k, (label, column, counts) in enumerate(rows):
        x[k, column] = np.log1p(counts)
        y[k], amount[k] = label, (odds[column] * np.log1p(counts)).sum()
    cuts = np.quantile(amount[y == 1], np.arange(1, GRADES) / GRADES)
    y[y == 1] = 1 + np.searchsorted(cuts, amount[y == 1])
    return ToxicityModel(features, *fit_ordinal(x.astype(np.float64), y, GRADES))


def score(spark: SparkSession, docs: DataFrame, model: ToxicityModel, text_col: str = "text", id_col: str = "doc_id", whole_rows: bool = False) -> DataFrame:
    """``doc_id``, ``severity`` (expected grade, 0 to GRADES), ``grade`` (the
    most likely one), ``p_toxic`` and ``toxic`` for every row of ``docs``, from
    its whole text; with ``whole_rows`` a struct ``row`` of all its columns in
    the place of ``doc_id``. Null and empty texts have no features: grade 0.
    Ids may be null or repeat; each row is scored by itself. A very long text
    is as toxic as its strongest passage, wherever that is. Other columns are
    ignored, whatever their names. An empty table gives an empty one."""
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            parts = [m.grades(m.linear(s)) for s in textvec.slices(b.column(1))]
            p = np.concatenate(parts) if parts else np.zeros((0, GRADES + 1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(p @ np.arange(GRADES + 1)), pa.array(p.argmax(1).astype(np.int32)), pa.array(1 - p[:, 0]), pa.array(1 - p[:, 0] >= TOXIC_AT)],
                names=[b.schema.names[0], "severity", "grade", "p_toxic", "toxic"],
            )

    return beside_rows(docs, id_col, whole_rows, [F.col(text_col)], run, "severity double, grade int, p_toxic double, toxic boolean")
