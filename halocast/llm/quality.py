"""Quality by a linear-chain conditional random field over lines.

Every line of a text is good or bad. A line's features are its own measures and those
of the lines before and after it, each cut into bins fitted to the sample. Two transition
weights tie neighbouring labels. In training all lines of a document carry the document's label,
which teaches the field how bad lines look and how they follow each other. A document's score is the mean of its lines'
forward-backward marginals, weighted by line length.

Forward and backward sums of all documents of a batch run at once, as prefix products of
2 x 2 matrices in doubling steps; at a document's first line the matrix forgets what was before it.
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

MEASURES = 13
LEVELS = (0.1, 0.3, 0.5, 0.7, 0.9)  # bins are cut at these quantiles of the sample ...
SHARES = (0.1, 0.25, 0.5, 0.75)  # ... and at these shares of its range, for rare, telling values
BINS = len(LEVELS) + len(SHARES) + 1
SAMPLE_ROWS = 4000  # bound of the training sample
SAMPLE_LINES = 400  # documents with more lines take no part in training; they are scored like all others
STEPS, RATE, SHRINK = 200, 0.1, 1e-3

_KIND = np.zeros(256, np.int8)  # 1 lower or beyond ASCII, 2 upper, 3 digit, 4 symbol, 0 blank
_KIND[33:127] = 4
_KIND[ord("a"): ord("z") + 1] = 1
_KIND[128:] = 1
_KIND[ord("A"): ord("Z") + 1] = 2
_KIND[ord("0"): ord("9") + 1] = 3
_PLAIN = np.zeros(256, bool)
_PLAIN[[ord(c) for c in ".,;:?'\"-()"]] = True


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def line_measures(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Measures of all lines, their lengths in bytes, and the n + 1 line offsets of the documents.

    An empty text is one empty line.
    """
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 0x0A) + 1
    breaks = breaks[~np.isin(breaks, offsets)]  # a final line feed begins no line
    # documents may be empty, so their starts may coincide: sort starts by (place, document)
    place = np.concatenate([offsets[:-1], breaks])
    doc = np.concatenate([np.arange(n), np.searchsorted(offsets, breaks, "right") - 1])
    order = np.lexsort((place, doc))
    place, doc = place[order], doc[order]
    bounds = np.append(place, len(data))
    lines = np.searchsorted(doc, np.arange(n + 1))
    size = np.diff(bounds)

    hashes, word_bounds = tx.words(data, bounds)
    count = np.diff(word_bounds)
    word_doc = np.repeat(doc, count)
    by = np.lexsort((hashes, word_doc))
    again = np.zeros(len(hashes), bool)
    again[by[1:]] = (hashes[by[1:]] == hashes[by[:-1]]) & (word_doc[by[1:]] == word_doc[by[:-1]])
    twin = np.zeros(len(hashes), bool)
    twin[1:] = (hashes[1:] == hashes[:-1]) & (word_doc[1:] == word_doc[:-1])
    line_code = np.zeros(len(size), np.uint64)
    if len(hashes):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tx.mix(hashes + (np.arange(len(hashes)) - np.repeat(word_bounds[:-1], count)).astype(np.uint64)), dtype=np.uint64)])
        line_code = total[word_bounds[1:]] - total[word_bounds[:-1]]
    by = np.lexsort((line_code, doc))
    same = np.zeros(len(size), bool)
    same[by[1:]] = (line_code[by[1:]] == line_code[by[:-1]]) & (doc[by[1:]] == doc[by[:-1]]) & (count[by[1:]] > 0)

    kind = _KIND[data]
    lower, upper, digit, mark = (_sums(kind == k, bounds) for k in (1, 2, 3, 4))
    plain = _sums(_PLAIN[data], bounds)
    double = np.zeros(len(data), bool)
    double[1:] = (data[1:] == data[:-1]) & (kind[1:] == 4)
    lone = np.zeros(len(data), bool)
    lone[1:-1] = (kind[1:-1] == 4) & (kind[:-2] == 0) & (kind[2:] == 0)
    letters, visible, some = np.maximum(lower + upper, 1), np.maximum(lower + upper + digit + mark, 1), np.maximum(count, 1)
    last = np.where(size > 0, data[np.maximum(bounds[1:] - 1, 0)] if len(data) else 0, 0)
    before = np.where((size > 1) & (last == 0x0A), data[np.maximum(bounds[1:] - 2, 0)] if len(data) else 0, last)
    measures = np.stack([
        np.log1p(size), count, visible / some, upper / letters, digit / visible, (mark - plain) / visible, plain / visible,
        _sums(double, bounds) / visible, _sums(again, word_bounds) / some, _sums(twin, word_bounds) / some,
        _sums(lone, bounds) / some, same.astype(float),
        np.isin(before, [ord(c) for c in ".!?"]).astype(float)], axis=1).astype(np.float32)
    return measures, size, lines


def _codes(measures: np.ndarray, cuts: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Feature numbers of every line: a bias, its own bins and those of its neighbours in the document."""
    n, width = measures.shape[0], BINS + 1  # the last value says that there is no such neighbour
    bins = np.stack([np.searchsorted(cuts[m], measures[:, m], "left") for m in range(MEASURES)], axis=1) if n else np.zeros((0, MEASURES), int)
    before, after = np.full_like(bins, BINS), np.full_like(bins, BINS)
    before[1:], after[:-1] = bins[:-1], bins[1:]
    starts = lines[:-1]
    before[starts] = BINS
    after[lines[1:] - 1] = BINS
    base = np.arange(MEASURES) * width
    return np.concatenate([np.zeros((n, 1), int)] + [1 + k * MEASURES * width + base + x for k, x in enumerate((bins, before, after))], axis=1)


FEATURES = 1 + 3 * MEASURES * (BINS + 1)


def _scan(steps: np.ndarray, longest: int) -> np.ndarray:
    """Products of each matrix with all before it, scaled."""
    out, reach = steps / steps.max(axis=(1, 2), keepdims=True), 1
    while reach < longest:
        new = out.copy()
        new[reach:] = out[reach:] @ out[:-reach]
        out = new / np.maximum(new.max(axis=(1, 2), keepdims=True), 1e-300)
        reach *= 2
    return out


def marginals(push: np.ndarray, tie: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line, and P(label before, label) of every line that has a line before it (else 0).

    ``push`` is each line's log-odds for good, ``tie`` the 2 x 2 transition weights.
    """
    n = len(push)
    if not n:
        return np.zeros(0), np.zeros((0, 2, 2))
    seen = np.exp(np.clip(np.stack([-push / 2, push / 2], axis=1), -30, 30))
    move = np.exp(tie)
    longest = int(np.diff(lines).max())
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    first[lines[:-1]], last[lines[1:] - 1] = True, True
    ahead = seen[:, :, None] * move.T[None]
    ahead[first] = np.repeat(seen[first][:, :, None], 2, axis=2)
    forward = _scan(ahead, longest)[:, :, 0]
    back = np.ones((n, 2, 2))
    back[:-1] = move[None] * seen[1:, None, :]
    back[last] = 1.0
    backward = _scan(back[::-1], longest)[::-1][:, :, 0]  # the product runs from a line to its document's end
    both = forward * backward
    good = both[:, 1] / both.sum(axis=1)
    pairs = np.zeros((n, 2, 2))
    pairs[1:] = forward[:-1, :, None] * move[None] * (seen[1:] * backward[1:])[:, None, :]
    pairs[first] = 0
    whole = pairs.sum(axis=(1, 2), keepdims=True)
    return good, np.divide(pairs, whole, out=np.zeros_like(pairs), where=whole > 0)


@dataclass(frozen=True)
class Field:
    """A trained field: bin edges, feature weights (log-odds of good), transition weights."""

    cuts: np.ndarray
    weights: np.ndarray
    tie: np.ndarray

    def line_probabilities(self, measures: np.ndarray, lines: np.ndarray) -> np.ndarray:
        push = self.weights[_codes(measures, self.cuts, lines)].sum(axis=1)
        return marginals(push, self.tie, lines)[0]

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        measures, size, lines = line_measures(data, offsets)
        good = self.line_probabilities(measures, lines)
        weight = np.maximum(size, 1).astype(float)
        return np.clip(np.add.reduceat(good * weight, lines[:-1]) / np.add.reduceat(weight, lines[:-1]), 0, 1) if len(good) else good


def fit(measures: np.ndarray, lines: np.ndarray, labels: np.ndarray) -> Field:
    """Conditional likelihood of the labels, by adaptive steps with weight decay."""
    if not len(measures):
        return Field(np.zeros((MEASURES, BINS - 1)), np.zeros(FEATURES), np.zeros((2, 2)))
    low, high = np.quantile(measures, (0.001, 0.999), axis=0)
    cuts = np.sort(np.concatenate([np.quantile(measures, LEVELS, axis=0).T,
                                   low[:, None] + (high - low)[:, None] * np.array(SHARES)], axis=1), axis=1)
    codes = _codes(measures, cuts, lines)
    truth = np.repeat(labels, np.diff(lines)).astype(float)
    follows = np.ones(len(truth), bool)
    follows[lines[:-1]] = False
    at = np.flatnonzero(follows)
    told = np.bincount(truth[at - 1].astype(int) * 2 + truth[at].astype(int), minlength=4).reshape(2, 2)
    both = np.zeros(FEATURES + 4)
    mean, square = np.zeros_like(both), np.zeros_like(both)
    docs = len(labels)
    for step in range(1, STEPS + 1):
        good, pairs = marginals(both[codes].sum(axis=1), both[FEATURES:].reshape(2, 2), lines)
        miss = np.repeat(truth - good, codes.shape[1])
        slope = np.concatenate([np.bincount(codes.ravel(), miss, FEATURES), (told - pairs.sum(axis=0)).ravel()]) / docs - SHRINK * both
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope * slope
        both = both + RATE * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
    return Field(cuts, both[:FEATURES], both[FEATURES:].reshape(2, 2))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = tx.utf8(batch.column(1))
        for lo, hi in tx.slices(offsets):
            measures, _, lines = line_measures(data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo])
            short = np.flatnonzero(np.diff(lines) <= SAMPLE_LINES)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo).take(pa.array(short)), batch.column(2).slice(lo, hi - lo).take(pa.array(short)),
                 pa.array([measures[lines[d]: lines[d + 1]].tobytes() for d in short], pa.binary())], ["id", "label", "measures"])


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id",
          text_col: str = "text") -> Field:
    """Fit the field on at most ``rows`` labelled documents of the training folds (the sample's documented bound).

    Only their lines' measures come to the driver. Without labelled rows the field is blank and scores 0.5.
    """
    tx.bounded_batches(docs.sparkSession)
    sample = learning.sample(docs, labels, "quality", rows, id_col, text_col)
    got = sorted(sample.mapInArrow(_measure, "id long, label int, measures binary").collect())
    parts = [np.frombuffer(r.measures, np.float32).reshape(-1, MEASURES) for r in got]
    measures = np.concatenate(parts) if parts else np.zeros((0, MEASURES), np.float32)
    lines = np.cumsum([0, *map(len, parts)])
    return fit(measures, lines, np.array([r.label for r in got]))


def score(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text",
          keep: list[str] | None = None) -> DataFrame:
    """(id, score) for every row; with ``keep``, those columns of ``docs`` and ``__score`` instead.

    Null and empty texts are one empty line and have the score of such a line. Repeated rows score alike. A
    null id is carried along. Columns that aren't named are not read.
    """
    tx.bounded_batches(docs.sparkSession)
    # a text that is kept is sent once
    at = keep.index(text_col) if keep is not None and text_col in keep and docs.schema[text_col].dataType.typeName() == "string" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tx.utf8(batch.column(at or 0))
            found = [field.scores(data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo])
                     for lo, hi in tx.slices(offsets)]
            scores = pa.array(np.concatenate(found) if found else np.zeros(0))
            first = 1 if at is None else 0
            yield pa.RecordBatch.from_arrays([*batch.columns[first:], scores], [*batch.schema.names[first:], "__score"])

    text = F.col(text_col).cast("string").alias("__text")
    if keep is None:
        rows = docs.select(text, F.col(id_col).cast("long").alias("id"))
        return rows.mapInArrow(run, "id long, __score double").withColumnRenamed("__score", "score")
    rows = docs.select(*([text] if at is None else []), *keep)
    return rows.mapInArrow(run, rows.drop("__text").withColumn("__score", F.lit(0.0)).schema)
