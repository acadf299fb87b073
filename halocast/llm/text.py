"""Whole-column text handling over Arrow buffers: words, word hashes, shingles.

A word is a run of bytes other than the six ASCII white-space bytes; A-Z count
as a-z. Words are named by 64-bit hashes: a polynomial over random byte values
modulo 2**64, mixed with the length. No text is ever cut: windows end at white
space or at the end of a document, so a word is always hashed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

WINDOW = 1 << 20  # bytes hashed at once
SLICE = 1 << 21  # bytes of whole documents handled at once; one longer document stands alone
BATCH = "16m"

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
VALUES[ord("A"): ord("Z") + 1] = VALUES[ord("a"): ord("z") + 1]

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, WINDOW), base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def bounded_batches(spark: SparkSession, size: str = BATCH) -> None:
    """Limit the bytes of an Arrow batch, so that long texts don't pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n + 1 offsets; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, ends, data = column.buffers()
    if len(column) == 0 or ends is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(ends, wide)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``limit`` bytes, or of one longer document."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def windows(data: np.ndarray, limit: int = WINDOW, breaks: np.ndarray = SPACE) -> Iterator[tuple[int, int]]:
    """Ranges of about ``limit`` bytes that end at a break."""
    start, n = 0, len(data)
    while start < n:
        end = min(start + limit, n)
        while end < n and not breaks[data[end]]:
            gap = np.flatnonzero(breaks[data[end: end + 65536]])
            end = end + int(gap[0]) if len(gap) else min(n, end + 65536)
        yield start, end
        start = end


def word_spans(data: np.ndarray, bounds: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of all words; no word crosses a document's bounds."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~breaks[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edges = bounds[(bounds >= 0) & (bounds < len(data))]
    first[edges] = solid[edges]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    edges = bounds[(bounds > 0) & (bounds <= len(data))] - 1
    last[edges] = solid[edges]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def prefix_sums(part: np.ndarray) -> np.ndarray:
    """Running sums from which the hash of any run of bytes follows."""
    total = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(VALUES[part] * _power(_BASE, len(part)), out=total[1:], dtype=np.uint64)
    return total


def run_hashes(total: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hashes of the runs of bytes from s to e."""
    code = (total[e] - total[s]) * _power(_INVERSE, len(total))[s]
    return mix(code ^ ((e - s).astype(np.uint64) * np.uint64(_BASE)))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the n + 1 word offsets of the documents."""
    hashes, starts = [], []
    for lo, hi in windows(data):
        bounds = offsets[np.searchsorted(offsets, lo): np.searchsorted(offsets, hi, "right")] - lo
        s, e = word_spans(data[lo:hi], bounds)
        hashes.append(run_hashes(prefix_sums(data[lo:hi]), s, e))
        starts.append(s + lo)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def chain(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` neighbours, one for each first place."""
    n = max(0, len(hashes) - width + 1)
    code = hashes[:n].copy()
    for k in range(1, width):
        code = mix(code * np.uint64(_BASE) + hashes[k: k + n])
    return code


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct shingles in ascending order, and their n + 1 offsets.

    A document of fewer words than ``width`` has its whole sequence as its one
    shingle, and one without words has none.
    """
    counts = np.diff(bounds)
    all_runs = chain(hashes, width)
    runs = np.maximum(counts - width + 1, 0)
    doc = np.repeat(np.arange(len(counts)), runs)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(bounds[:-1], runs)
    code = all_runs[place] if len(place) else np.zeros(0, np.uint64)
    for short in range(1, width):
        few = np.flatnonzero(counts == short)
        if len(few):
            code = np.concatenate([code, chain(hashes, short)[bounds[few]]])
            doc = np.concatenate([doc, few])
    order = np.lexsort((code, doc))
    code, doc = code[order], doc[order]
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
    code, doc = code[keep], doc[keep]
    return code, np.searchsorted(doc, np.arange(len(counts) + 1))


def list_column(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))
