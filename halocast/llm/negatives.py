"""Hard negatives by integer inner products, with Strassen's multiplication on tiles.

The corpus stays where it lies: each task packs its vectors into tiles. Anchors pass by in
batches of a bounded number of bytes. A task multiplies an anchor tile with a corpus tile by
Strassen's recursion on integers, odd sides padded with zeros. Sums and products are
exact: in 64 bits they hold modulo 2**64, and a tile whose scores might not fit takes Python
integers instead.

Two passes over the tiles: the first keeps, for each anchor, a heap of its best rows with the same
label; the second keeps, for each anchor and positive, a heap of the best rows with another
label inside the positive's window of scores. Heaps are lists of at most k rows; they merge by
concatenation and a ranking, before and after the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halocast.llm.vectors import rows_of
from halocast.session import stored, work_dir

TILE_BYTES = 8 << 20  # of a corpus tile's vectors
BATCH_BYTES = 2 << 20  # of an anchor tile's vectors; a few are broadcast at a time
BATCHES_AT_ONCE = 4
BATCH_ROWS = 4096  # anchors dealt to one packing task
LEAF = 32  # sides up to this size are multiplied plainly
FITS = 1 << 62


def whole(matrix: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as int64, or as Python integers where 64 bits may not hold it."""
    with np.errstate(over="ignore"):
        scaled = np.floor(matrix * scale)
    if not scaled.size or np.abs(scaled).max() < FITS:
        return scaled.astype(np.int64)
    # beyond 2**53 a double is an integer
    return np.array([[int(x) * scale if abs(x) >= 2.0**53 else int(np.floor(x * scale)) for x in row] for row in matrix.tolist()],
                    dtype=object).reshape(matrix.shape)


def _even(a: np.ndarray) -> np.ndarray:
    rows, cols = a.shape
    if not rows % 2 and not cols % 2:
        return a
    out = np.zeros((rows + rows % 2, cols + cols % 2), a.dtype)
    out[:rows, :cols] = a
    return out


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b by seven half-size products a level."""
    if min(a.shape[0], a.shape[1], b.shape[1]) <= leaf:
        return a @ b
    rows, cols = a.shape[0], b.shape[1]
    a, b = _even(a), _even(b)
    m, k, n = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    out = np.empty((2 * m, 2 * n), np.result_type(a, b))
    p = strassen(a11 + a22, b11 + b22, leaf)
    out[:m, :n], out[m:, n:] = p, p
    p = strassen(a21 + a22, b11, leaf)
    out[m:, :n] = p
    out[m:, n:] -= p
    p = strassen(a11, b12 - b22, leaf)
    out[:m, n:] = p
    out[m:, n:] += p
    p = strassen(a22, b21 - b11, leaf)
    out[:m, :n] += p
    out[m:, :n] += p
    p = strassen(a11 + a12, b22, leaf)
    out[:m, :n] -= p
    out[:m, n:] += p
    out[m:, n:] += strassen(a21 - a11, b11 + b12, leaf)
    out[:m, :n] += strassen(a12 - a22, b21 + b22, leaf)
    return out[:rows, :cols]


def scores_of(anchors: np.ndarray, rows: np.ndarray, scale: int, spare: int = 100) -> np.ndarray:
    """Exact integer inner products of all anchors with all rows.

    int64 if they also fit after a product with ``spare``, else Python integers.
    """
    a, b = whole(anchors, scale), whole(rows, scale)
    if a.dtype != object and b.dtype != object:
        largest = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
        if largest * spare < FITS:
            return strassen(a, b.T)
    return strassen(a.astype(object), b.T.astype(object))


PACKED = "size int, n int, ids binary, labels binary, vectors binary, windows binary"


def _pack(most: int) -> Callable:
    """Rows (id, label, vector, window) as tiles of vectors of one length; ``window`` holds the positives of an anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        count: dict[int, int] = {}

        def out(size: int) -> pa.RecordBatch:
            parts = held.pop(size)
            ids, labels, vectors, windows = (np.concatenate(x) for x in zip(*parts, strict=True))
            count.pop(size)
            values = [size, len(ids), ids.tobytes(), labels.tobytes(), vectors.tobytes(), windows.tobytes()]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], pa.int32() if i < 2 else pa.binary()) for i, v in enumerate(values)],
                ["size", "n", "ids", "labels", "vectors", "windows"])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            labels = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            windows = np.full(len(ids), -1, np.int64) if batch.num_columns < 4 else batch.column(3).to_numpy(zero_copy_only=False)
            for size, (at, matrix) in rows_of(batch.column(2))[1].items():
                limit = max(1, most // (8 * size))
                lo = 0
                while lo < len(at):
                    part = slice(lo, lo + limit - count.get(size, 0))
                    held.setdefault(size, []).append((ids[at[part]], labels[at[part]], matrix[part], windows[at[part]]))
                    count[size] = count.get(size, 0) + len(at[part])
                    lo += len(at[part])
                    if count[size] >= limit:
                        yield out(size)
        for size in list(held):
            yield out(size)
    return run


def _int(values: list) -> pa.Array:
    return pa.array([int(v) for v in values], pa.int64())


def _each_pair(batches: Iterator[pa.RecordBatch], scale: int):
    """For each pair of tiles: anchors' ids, labels and windows, rows' ids and labels sorted by id, the scores."""
    for batch in batches:
        for size, ids, labels, vectors, a_ids, a_labels, a_vectors, a_windows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ids, labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
            order = np.argsort(ids, kind="stable")
            rows = np.frombuffer(vectors).reshape(-1, size)[order]
            scores = scores_of(np.frombuffer(a_vectors).reshape(-1, size), rows, scale)
            yield (np.frombuffer(a_ids, np.int64), np.frombuffer(a_labels, np.int64), np.frombuffer(a_windows, np.int64),
                   ids[order], labels[order], scores)


def _best(ids: np.ndarray, scores: np.ndarray, at: np.ndarray, k: int) -> list[int]:
    """Of the rows ``at``, in the order of ids, the k best by score, an id once; ties to the smaller id."""
    if len(at) > 64 * k and scores.dtype != object:
        # all that reach the k-th best distinct id; equal ids lie together, so 64 k rows may hold too few
        floor = np.partition(scores[at], len(at) - 32 * k)[len(at) - 32 * k]
        few = at[scores[at] >= floor]
        if len(np.unique(ids[few])) >= k:
            at = few
    chosen, seen = [], set()
    for i in at[np.argsort(-scores[at], kind="stable")].tolist():
        if ids[i] not in seen:
            seen.add(ids[i])
            chosen.append(i)
            if len(chosen) == k:
                break
    return chosen


def _positives(k: int, scale: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a_ids, a_labels, _, ids, labels, scores in _each_pair(batches, scale):
            out = []
            for i, (anchor, label) in enumerate(zip(a_ids.tolist(), a_labels.tolist(), strict=True)):
                same = np.flatnonzero((labels == label) & (ids != anchor))
                out += [(anchor, ids[j], scores[i, j]) for j in _best(ids, scores[i], same, k)]
            yield pa.RecordBatch.from_arrays([_int(c) for c in zip(*out, strict=True)] if out else [_int([])] * 3,
                                             ["anchor_id", "positive_id", "positive_score"])
    return run


def _negatives(k: int, low: int, high: int, scale: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a_ids, a_labels, windows, ids, labels, scores in _each_pair(batches, scale):
            out = []
            for i, (anchor, label, window) in enumerate(zip(a_ids.tolist(), a_labels.tolist(), windows.tolist(), strict=True)):
                if scores.dtype == object:
                    inside = [low * window <= 100 * s <= high * window for s in scores[i]]
                else:  # the same, rounded to whole scores
                    inside = (scores[i] >= -(-low * window // 100)) & (scores[i] <= high * window // 100)
                other = np.flatnonzero(np.asarray(inside, bool) & (labels != label) & (ids != anchor))
                out += [(anchor, window, ids[j], scores[i, j]) for j in _best(ids, scores[i], other, k)]
            yield pa.RecordBatch.from_arrays([_int(c) for c in zip(*out, strict=True)] if out else [_int([])] * 4,
                                             ["anchor_id", "positive_score", "negative_id", "negative_score"])
    return run


def _over_tiles(tiles: DataFrame, asked: DataFrame, run: Callable, schema: str, label: str) -> DataFrame:
    """``run`` over all tiles of the corpus, for a few batches of anchors at a time; heaps are written as they come."""
    spark = tiles.sparkSession
    dealt = asked.repartition(max(1, -(-asked.count() // BATCH_ROWS)))
    packed = stored(dealt.mapInArrow(_pack(BATCH_BYTES), PACKED).withColumn("batch", F.monotonically_increasing_id()), label)
    numbers = [r[0] for r in packed.select("batch").orderBy("batch").toLocalIterator()]
    path = work_dir(spark, label)
    for lo in range(0, max(1, len(numbers)), BATCHES_AT_ONCE):
        some = packed.where(F.col("batch").isin(numbers[lo:lo + BATCHES_AT_ONCE])).select(
            "size", F.col("ids").alias("a_ids"), F.col("labels").alias("a_labels"), F.col("vectors").alias("a_vectors"),
            F.col("windows").alias("a_windows"))
        pairs = tiles.join(F.broadcast(some), "size").select(
            "size", "ids", "labels", "vectors", "a_ids", "a_labels", "a_vectors", "a_windows")
        pairs.mapInArrow(run, schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _merge(heaps: DataFrame, keys: list[str], row: str, score: str, k: int) -> DataFrame:
    once = heaps.groupBy(*keys, row).agg(F.max(score).alias(score))
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), row)
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, label: Column | str = "label", k_positive: int = 5, k_negative: int = 5,
                   low: int = 80, high: int = 100, id_col: str = "vec_id", vector_col: str = "embedding",
                   scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components count as floor(scale * x); scores are integer inner products. An anchor's positives are
    its ``k_positive`` best other rows of the same label; for each of them, the ``k_negative`` best rows of
    another label with low * positive <= 100 * score <= high * positive are returned, ranked from 1.
    Ties go to the smaller id.

    Rows take no part if their id, label or vector is null, the vector is empty or a component null or
    non-finite. Vectors of different lengths don't meet. Of an id's repeated rows the best score counts,
    once; an anchor whose id is repeated is its smallest (label, vector). An id never meets itself. No
    anchor, no positive or no row in the window gives no row; nor does an empty table. Scores are exact at
    any size; one that enters a heap and doesn't fit a long stops the job.
    """
    label = F.col(label) if isinstance(label, str) else label
    plain = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"),
                        F.col(vector_col).alias("vector"), is_anchor.alias("asks")).where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    tiles = stored(plain.select("id", "label", "vector").mapInArrow(_pack(TILE_BYTES), PACKED), "tiles")
    usable = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    anchors = stored(plain.where(F.col("asks") & usable).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row"))
                     .select("id", "row.label", "row.vector"), "anchors")
    heaps = _over_tiles(tiles, anchors, _positives(k_positive, scale),
                        "anchor_id long, positive_id long, positive_score long", "positives")
    positives = stored(_merge(heaps, ["anchor_id"], "positive_id", "positive_score", k_positive).drop("rank"), "positives")
    # positives with equal scores share a window
    windows = positives.groupBy("anchor_id", "positive_score").agg(F.count("*").alias("n")).withColumnRenamed("anchor_id", "id")
    asked = stored(anchors.join(windows, "id").select("id", "label", "vector", "positive_score"), "windows")
    heaps = _over_tiles(tiles, asked, _negatives(k_negative, low, high, scale),
                        "anchor_id long, positive_score long, negative_id long, negative_score long", "negatives")
    found = _merge(heaps, ["anchor_id", "positive_score"], "negative_id", "negative_score", k_negative)
    return positives.join(found, ["anchor_id", "positive_score"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
