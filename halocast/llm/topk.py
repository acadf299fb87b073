"""Exact top-k by integer inner product over an impact-ordered index.

Components are turned into integers. The corpus stays where it lies: each task packs its
vectors into blocks. A block's index has, for every dimension, its postings in the order
of their impact. Queries pass by in batches of a bounded number of rows, each broadcast as
one packed row.

For one query, all dimensions are processed score at a time: the segments with
contributions (query component times impact) of at least tau, for falling tau. A vector that
lacks postings can gain less than tau from each of them, which bounds its score. The
k-th best of some exactly rescored vectors bounds the answer from below. Work stops
only when few enough vectors can still reach that bound, or when nothing is left; all that
can reach it are then rescored exactly. Blocks give up to k rows per query, which
are pre-merged by a window limit before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halocast.llm.negatives import whole
from halocast.llm.vectors import rows_of
from halocast.session import stored

BLOCK = 16_384  # vectors in a block of the corpus
BATCH = 8_192  # queries in a batch
BATCHES_AT_ONCE = 4
LARGEST = float(1 << 28)  # vectors of larger integers lie in blocks of their own, which Python integers score
STEPS = (0.25, 0.0, -0.04, -0.12)  # tau, as shares of a query's largest contribution


def _pack(scale: int, limit: int):
    """Rows as blocks of vectors of one length: 32-bit integers, or the vectors themselves where ``wide``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool], list] = {}
        count: dict[tuple[int, bool], int] = {}

        def out(kind: tuple[int, bool]) -> pa.RecordBatch:
            ids = np.concatenate([i for i, _ in held[kind]])
            matrix = np.concatenate([m for _, m in held[kind]])
            held[kind], count[kind] = [], 0
            return pa.RecordBatch.from_arrays(
                [pa.array([kind[0]], pa.int32()), pa.array([kind[1]]), pa.array([ids.tobytes()], pa.binary()),
                 pa.array([matrix.tobytes()], pa.binary())], ["size", "wide", "ids", "vectors"])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            _, by_size = rows_of(batch.column(1))
            for size, (at, matrix) in by_size.items():
                with np.errstate(over="ignore"):
                    scaled = np.floor(matrix * scale)
                large = (np.abs(scaled) > LARGEST).any(axis=1)
                for wide, own in ((False, np.flatnonzero(~large)), (True, np.flatnonzero(large))):
                    kind = (size, wide)
                    values = matrix[own] if wide else scaled[own].astype(np.int32)
                    for lo in range(0, len(own), limit):
                        part = slice(lo, lo + limit)
                        if count.get(kind, 0) + len(own[part]) > limit:
                            yield out(kind)
                        held.setdefault(kind, []).append((ids[at[own[part]]], values[part]))
                        count[kind] = count.get(kind, 0) + len(own[part])
        for kind in list(held):
            if count[kind]:
                yield out(kind)
    return run


class Index:
    """Postings of one block: per dimension, rows in the order of their impact."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.rows = np.argsort(self.vectors, axis=0, kind="stable").T.copy()
        self.impacts = np.take_along_axis(self.vectors.T, self.rows, axis=1).astype(np.float64)

    def top(self, query: np.ndarray, own: int | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and exact scores of the k best, ties to smaller ids; ``own`` takes no part."""
        n = len(self.ids)
        dims = np.flatnonzero(query)
        spare = k + (own is not None)
        possible = np.arange(n)
        if len(dims) and n > 64 * spare:
            largest = np.maximum(query[dims] * self.impacts[dims, 0], query[dims] * self.impacts[dims, -1]).max()
            # gains and their number are summed as one float, which is exact below 2**53
            unit = 1 << len(dims).bit_length()
            if np.abs(self.vectors).max() * np.abs(query).sum() * unit >= 1 << 52:
                return self._best(np.arange(n), query, own, k)
            sums = np.zeros(n)
            done = np.where(query[dims] > 0, n, 0)  # first or last place that is already processed
            for step in STEPS:
                tau = step * largest
                rows, gains = [], []
                for j, d in enumerate(dims.tolist()):
                    q, impacts = float(query[d]), self.impacts[d]
                    if q > 0:  # places from the end, while q * impact >= tau
                        lo = int(np.searchsorted(impacts, tau / q, "left"))
                        part = slice(lo, done[j])
                        done[j] = min(lo, done[j])
                    else:
                        hi = int(np.searchsorted(impacts, tau / q, "right"))
                        part = slice(done[j], hi)
                        done[j] = max(hi, done[j])
                    if part.stop > part.start:
                        rows.append(self.rows[d, part])
                        gains.append(impacts[part] * (q * unit) + 1)
                if rows:
                    sums += np.bincount(np.concatenate(rows), np.concatenate(gains), n)
                have = np.floor(sums / unit)
                met = sums - have * unit
                # float rounding at tau / q could move a posting whose gain equals tau; one unit covers it
                bound = have + (len(dims) - met) * (tau + 1)
                best = np.argpartition(bound, n - 4 * spare)[n - 4 * spare:]
                floor = np.partition(self.vectors[best] @ query, len(best) - spare)[len(best) - spare]
                possible = np.flatnonzero(bound >= floor)
                if len(possible) <= 64 * spare:
                    break
        return self._best(possible, query, own, k)

    def _best(self, possible: np.ndarray, query: np.ndarray, own: int | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of some rows, by exact scores."""
        scores = self.vectors[possible] @ query
        if own is not None:
            keep = self.ids[possible] != own
            possible, scores = possible[keep], scores[keep]
        best = np.lexsort((self.ids[possible], -scores))[:k]
        return possible[best], scores[best]


def _vectors(data: bytes, size: int, wide: bool, scale: int) -> np.ndarray:
    if wide:
        return whole(np.frombuffer(data).reshape(-1, size), scale).astype(object)
    return np.frombuffer(data, np.int32).reshape(-1, size).astype(np.int64)


LONGEST = (1 << 63) - 1


def _top_of_all(ids: np.ndarray, scores: np.ndarray, own: int | None, k: int) -> list[tuple[int, int]]:
    """(id, score) of the k best by scores of any size."""
    rows = [(int(i), int(s)) for i, s in zip(ids, scores, strict=True) if i != own]
    return sorted(rows, key=lambda r: (-r[1], r[0]))[:k]


def _beyond(score: int) -> bytes | None:
    """Bytes that sort as the score does, for a score that no long holds."""
    if -LONGEST <= score <= LONGEST:
        return None
    size = abs(score)
    n = (size.bit_length() + 7) // 8
    if score > 0:
        return n.to_bytes(4, "big") + size.to_bytes(n, "big")
    return ((1 << 32) - 1 - n).to_bytes(4, "big") + ((1 << 8 * n) - 1 - size).to_bytes(n, "big")


def _search(k: int, itself: bool, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, wide, ids, vectors, q_wide, q_ids, q_vectors in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                asked = np.frombuffer(q_ids, np.int64)
                queries = _vectors(q_vectors, size, q_wide, scale)
                held = _vectors(vectors, size, wide, scale)
                out_q, out_v, out_s = [], [], []
                if wide or q_wide:
                    names, rows = np.frombuffer(ids, np.int64), held.astype(object)
                    for qid, query in zip(asked.tolist(), queries.astype(object), strict=True):
                        for vec_id, score in _top_of_all(names, rows @ query, None if itself else qid, k):
                            out_q.append([qid])
                            out_v.append([vec_id])
                            out_s.append([score])
                else:
                    index = Index(np.frombuffer(ids, np.int64), held)
                    for qid, query in zip(asked.tolist(), queries, strict=True):
                        rows, scores = index.top(query, None if itself else qid, k)
                        out_q.append(np.full(len(rows), qid))
                        out_v.append(index.ids[rows])
                        out_s.append(scores)
                columns = [[int(v) for part in x for v in part] for x in (out_q, out_v, out_s)]
                keys = pa.array([_beyond(s) for s in columns[2]] if wide or q_wide else [None] * len(columns[2]), pa.binary())
                columns[2] = [max(-LONGEST, min(LONGEST, s)) for s in columns[2]]
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns], keys], ["query_id", "vec_id", "score", "beyond"])
    return run


def exact_topk(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
               scale: int = 256, itself: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the highest integer inner product for each query.

    Components count as floor(scale * x). Ties go to the smaller id. Vectors that are null or empty, or
    hold null or non-finite components, take no part, nor do rows with a null id; vectors of different
    lengths don't meet. A query's own id is no candidate unless ``itself``; rows that
    repeat another id's vector are candidates like any other, and repeated ids count once, with their
    best score. No query or no candidate gives no row. Scores rank exactly at any size; one that no long
    holds is shown as the greatest or least long.
    """
    spark = rows.sparkSession
    plain = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"),
                        is_query.alias("asks")).where("id IS NOT NULL")
    packed = "size int, wide boolean, ids binary, vectors binary"
    blocks = stored(plain.select("id", "vector").mapInArrow(_pack(scale, BLOCK), packed), "blocks")
    queries = stored(plain.where("asks").dropDuplicates(["id"]).select("id", "vector"), "queries")
    tasks = max(1, -(-queries.count() // BATCH))
    asked = stored(queries.repartition(tasks).mapInArrow(_pack(scale, BATCH), packed).select(
        "size", F.col("wide").alias("q_wide"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"),
        F.monotonically_increasing_id().alias("batch")), "asked")
    numbers = [r[0] for r in asked.select("batch").collect()]  # one per batch of queries
    found = None
    for first in range(0, max(1, len(numbers)), BATCHES_AT_ONCE):
        # a few batches of a bounded number of rows, sent to every block
        some = asked.where(F.col("batch").isin(numbers[first:first + BATCHES_AT_ONCE])).drop("batch")
        both = blocks.join(F.broadcast(some), "size").select("size", "wide", "ids", "vectors", "q_wide", "q_ids", "q_vectors")
        part = both.mapInArrow(_search(k, itself, scale), "query_id long, vec_id long, score long, beyond binary")
        found = part if found is None else found.unionByName(part)
    best = F.max(F.struct("score", "beyond"))
    once = found.groupBy("query_id", "vec_id").agg(best.alias("best")).select("query_id", "vec_id", "best.*")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("beyond").desc(), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
