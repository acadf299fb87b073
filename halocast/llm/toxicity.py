"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its words (runs of letters and digits) and the first bytes of its
words, so that inflected forms share a term; all are hashed. The score is logistic in a bias, a weight
per present term, and the products of the terms' factor vectors for all pairs of present terms, so a pair
can tell what neither term tells alone. The pairs cost no more than the terms:
half of (sum of vectors) squared minus the sum of squares.

Terms enter the model by what the sample says: those whose shares differ most between the two
labels, and, as partners in pairs, the most frequent ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halocast.llm import learning
from halocast.llm import text as tx

SAMPLE_ROWS = 12_000  # bound of the training sample
SPACE_BITS = 22
TELLING, FREQUENT = 3072, 1024  # bounds of the model's vocabulary
PREFIXES = (4, 5, 6)  # bytes
FACTORS = 8
EPOCHS, BATCH, RATE, SHRINK, SPARSE = 30, 256, 0.3, 1e-4, 1e-4
TOXIC_WEIGHT = 3.0  # toxic rows are the few; the score is for a high threshold

_BREAKS = np.ones(256, bool)
_BREAKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed terms of each document, and their n + 1 offsets."""
    codes, places = [], []
    for lo, hi in tx.windows(data, breaks=_BREAKS):
        bounds = offsets[np.searchsorted(offsets, lo): np.searchsorted(offsets, hi, "right")] - lo
        total = tx.prefix_sums(data[lo:hi])
        s, e = tx.word_spans(data[lo:hi], bounds, _BREAKS)
        codes.append(tx.run_hashes(total, s, e))
        places.append(s + lo)
        for size in PREFIXES:
            longer = s[e - s > size]
            codes.append(tx.mix(tx.run_hashes(total, longer, longer + size) + np.uint64(size)))
            places.append(longer + lo)
    if not codes:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    code = (np.concatenate(codes) >> np.uint64(64 - SPACE_BITS)).astype(np.int64)
    doc = np.searchsorted(offsets, np.concatenate(places), "right") - 1
    both = np.unique((doc << SPACE_BITS) | code)
    return both & ((1 << SPACE_BITS) - 1), np.searchsorted(both >> SPACE_BITS, np.arange(len(offsets)))


@dataclass(frozen=True)
class Machine:
    """Bias, and per known term (sorted) a weight and a factor vector."""

    known: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def find(self, code: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the known terms among all, and the documents' offsets in them."""
        if not len(self.known):
            return np.zeros(0, np.int64), np.zeros_like(bounds)
        at = np.minimum(np.searchsorted(self.known, code), len(self.known) - 1)
        hit = self.known[at] == code
        return at[hit], np.concatenate([[0], np.cumsum(hit)])[bounds]

    def margins(self, at: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        n = len(bounds) - 1
        linear = np.bincount(doc, self.weights[at], n)
        pairs = np.zeros(n)
        for f in range(self.factors.shape[1]):
            v = self.factors[at, f]
            pairs += (np.bincount(doc, v, n) ** 2 - np.bincount(doc, v * v, n)) / 2
        return self.bias + linear + pairs

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        margin = self.margins(*self.find(*terms(data, offsets)))
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def fit(known: np.ndarray, docs: list[np.ndarray], labels: np.ndarray, seed: int = 5) -> Machine:
    """Logistic loss by adaptive steps; weights are shrunk towards zero, vectors decay."""
    rng = np.random.default_rng(seed)
    n = len(known)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    bias = float(np.log(share / (1 - share)))
    weights, factors = np.zeros(n), rng.normal(0, 0.02, (n, FACTORS))
    seen_w, seen_v, seen_b = np.full(n, 1e-2), np.full((n, FACTORS), 1e-2), 1e-2
    sizes = np.array([len(d) for d in docs])
    for epoch in range(EPOCHS if n and len(docs) else 0):
        order = rng.permutation(len(docs))
        for lo in range(0, len(order), BATCH):
            own = order[lo: lo + BATCH]
            at = np.concatenate([docs[d] for d in own]) if sizes[own].sum() else np.zeros(0, np.int64)
            doc = np.repeat(np.arange(len(own)), sizes[own])
            now = Machine(known, bias, weights, factors)
            margin = now.margins(at, np.concatenate([[0], np.cumsum(sizes[own])]))
            miss = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[own]) / len(own)
            miss = miss * np.where(labels[own] > 0, TOXIC_WEIGHT, 1.0)
            whole = np.zeros((len(own), FACTORS))
            for f in range(FACTORS):
                whole[:, f] = np.bincount(doc, factors[at, f], len(own))
            slope_w = np.bincount(at, miss[doc], n)
            slope_v = np.stack([np.bincount(at, miss[doc] * (whole[doc, f] - factors[at, f]), n) for f in range(FACTORS)], axis=1)
            slope_v += SHRINK * factors
            seen_w, seen_v, seen_b = seen_w + slope_w ** 2, seen_v + slope_v ** 2, seen_b + miss.sum() ** 2
            step = RATE / np.sqrt(seen_w)
            weights = weights - step * slope_w
            weights = np.sign(weights) * np.maximum(np.abs(weights) - step * SPARSE, 0)
            factors = factors - 0.3 * RATE / np.sqrt(seen_v) * slope_v
            bias -= RATE / np.sqrt(seen_b) * miss.sum()
    return Machine(known, bias, weights, factors)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << SPACE_BITS), np.int32)
    for batch in batches:
        data, offsets = tx.utf8(batch.column(1))
        labels = batch.column(2).to_numpy(zero_copy_only=False)
        for lo, hi in tx.slices(offsets):
            code, bounds = terms(data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo])
            label = np.repeat(labels[lo:hi], np.diff(bounds))
            for k in (0, 1):
                at, many = np.unique(code[label == k], return_counts=True)
                counts[k, at] += many.astype(np.int32)
    at = np.flatnonzero(counts.sum(axis=0) > 0)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(counts[k, at].astype(np.int64)) for k in (0, 1))],
                                     ["term", "clean", "toxic"])


def _held(known: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blank = Machine(known, 0.0, np.zeros(len(known)), np.zeros((len(known), 1)))
        for batch in batches:
            data, offsets = tx.utf8(batch.column(1))
            for lo, hi in tx.slices(offsets):
                at, bounds = blank.find(*terms(data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo]))
                at = at.astype(np.int16)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo),
                     pa.array([at[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())],
                    ["id", "label", "terms"])
    return run


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id",
          text_col: str = "text") -> Machine:
    """Fit the machine on at most ``rows`` labelled documents of the training folds (the sample's documented bound).

    Only known terms come to the driver, at most TELLING + FREQUENT per document. Without labelled
    rows the machine has no terms and scores 0.5; with one label it scores that label's share.
    """
    tx.bounded_batches(docs.sparkSession)
    sample = learning.sample(docs, labels, "toxic", rows, id_col, text_col)
    totals = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    clean, toxic = totals.get(0, 0), totals.get(1, 0)
    counts = sample.mapInArrow(_counts, "term int, clean long, toxic long").groupBy("term").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where("clean + toxic >= 4")
    share = (F.col("clean") + F.col("toxic")) / max(clean + toxic, 1)
    differs = F.abs(F.col("toxic") / max(toxic, 1) - F.col("clean") / max(clean, 1)) / F.sqrt(
        share * (1 - share) * (1 / max(toxic, 1) + 1 / max(clean, 1)) + 1e-12)
    counts = counts.withColumn("differs", differs)
    known = {r.term for r in counts.orderBy(F.col("differs").desc(), "term").limit(TELLING).collect()}
    known |= {r.term for r in counts.orderBy((F.col("clean") + F.col("toxic")).desc(), "term").limit(FREQUENT).collect()}
    known = np.array(sorted(known), np.int64)
    got = sorted(sample.mapInArrow(_held(known), "id long, label int, terms binary").collect())
    return fit(known, [np.frombuffer(r.terms, np.int16).astype(np.int64) for r in got], np.array([r.label for r in got], float))


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row; null and empty texts have no terms and score the bias alone.

    Repeated rows score alike, null ids are carried along, other columns are not read.
    """
    tx.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tx.utf8(batch.column(1))
            for lo, hi in tx.slices(offsets):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo),
                     pa.array(machine.scores(data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo]))], ["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, score double")
