"""k nearest rows per query, for vectors and for positions.

The pairs of queries and corpus rows are never written out. A task compares a
block of the corpus with a block of the queries in numpy and emits at most k
rows per query; a window then merges those short lists. Two ways to bring
blocks together:

* vectors: queries are dealt out in stripes of a bounded number. A task holds one stripe with its best rows so far,
  and the corpus streams by; rows that can't be among the k best are told by a product in single precision;
* search texts: the corpus is read where it lies, and any number of queries pass by
  in packed batches of a bounded number of rows, without a shuffle;
* positions: corpus and queries go to the cells of a grid, a crowded cell is cut into several
  blocks, and both sides lie in one table that is dealt out by block in ranges of equal size. A task
  walks over its many blocks in sorted arrays. Radii and cells grow from round to round, so that
  dense and sparse places alike measure few pairs per query.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from halocast.functions.geo import valid_coordinates
from halocast.rules import EARTH_RADIUS_KM
from halocast.session import stored

SCANNED_SCHEMA = "query_id string, profile_id string, distance double, k int, exact double"
SCANNED = pa.schema([("query_id", pa.string()), ("profile_id", pa.string()), ("distance", pa.float64()), ("k", pa.int32()), ("exact", pa.float64())])
HIT_SCHEMA = "query_id string, profile_id string, distance double, k int"
MERGE_SALTS = 32              # partial lists per query before the last merge
QUERY_BATCH = 200_000         # search texts sent to the corpus at once
LETTERS = 2_000_000           # and their letters
CORPUS_BLOCK = 50_000         # corpus rows per block of a cell
QUERY_BLOCK = 2_048           # queries per block of a cell
CELLS_SENT = 500_000          # rows of a table of cells that may be sent to all tasks
CELL_RADII = 8                # cells of a round are as tall as this many of its radii
GROWTH = 3                    # a round's radius is that of the round before times this
DIRECT_PAIRS = 200_000_000    # up to so many pairs of points and profiles one round does
WALK_ROWS = 100_000           # rows of whole blocks that a task holds at once
PAIRS = 2_000_000             # pairs measured at once
QUERY_SLICE = 256             # queries compared with a block at a time inside a task
ROW_SLICE = 2_048             # corpus rows compared at a time inside a task
STRIPE_QUERIES = 65_536       # queries that a task holds at most
STRIPE_LEAST = 4_096          # queries of a stripe where there are enough tasks
STRIPE_HITS = 1_000_000       # best rows that the queries of a stripe hold at most
DIGITS = 9                    # distances are compared after rounding to this


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows whose vector is there and finite, and these vectors."""
    held = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    lists = column.drop_null()
    sizes = np.unique(lists.value_lengths().to_numpy(zero_copy_only=False))
    if len(sizes) > 1:
        raise ValueError("vectors differ in length")
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    rows = flat.reshape(len(lists), int(sizes[0]) if len(sizes) else 0)
    fine = np.isfinite(rows).all(1)
    return held[fine], rows[fine].astype(np.float64)


def _numbers(table, names: list[str]) -> np.ndarray:
    """Columns side by side as doubles, null as NaN."""
    return np.stack([table.column(n).cast(pa.float64()).to_numpy(zero_copy_only=False) for n in names], axis=1) if names else np.zeros((len(table), 0))


BOUNDS = ["lat_min", "lat_max", "lon_min", "lon_max", "ts_from", "ts_to", "months"]
PLACED = ["lat", "lon", "ts", "month"]


def _allowed(rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which rows (``PLACED``) pass one query's box, time span and months (``BOUNDS``; NaN is open)."""
    lat, lon, ts, month = rows.T
    lat_min, lat_max, lon_min, lon_max, since, until, months = bounds
    fine = np.ones(len(rows), dtype=bool)
    if not np.isnan(lat_min):
        east, west = lon >= lon_min, lon <= lon_max
        fine &= (lat >= lat_min) & (lat <= lat_max) & (east | west if lon_min > lon_max else east & west)
    if not np.isnan(since):
        fine &= (ts >= since) & (ts < until)
    if not np.isnan(months):
        fine &= ((int(months) >> np.nan_to_num(month).astype(np.int64)) & 1 == 1) & ~np.isnan(month)
    return fine


class VectorScan:
    """The k nearest rows of each query of a stripe, of all rows that have passed by.

    A product in single precision rules out the rows that are further than the k-th best so far by more than its
    rounding error; the few others are measured in double precision, so that ties fall alike wherever a row passes.
    With a ``book`` rows are ranked by their decoded codes, and the distance to the vector itself goes along as ``exact``.
    """

    def __init__(self, asked: pa.Table, metric: str, prefilter: bool, book: Codebook | None, slices: tuple[int, int], digits: int):
        self.metric, self.book, self.digits = metric, book, digits
        self.query_slice, self.row_slice = slices
        held, q = _vectors(asked.column("query_vector").combine_chunks())
        wanted = np.nan_to_num(asked.column("k").cast(pa.float64()).to_numpy(zero_copy_only=False)).astype(np.int64)[held]
        held, q, k = held[wanted > 0], q[wanted > 0], wanted[wanted > 0]
        self.groups = [(0, len(held), None)]
        if prefilter and len(held):  # queries with the same bounds stand together
            bounds = _numbers(asked, BOUNDS)[held]
            _, code = np.unique(np.nan_to_num(bounds, nan=1e300, posinf=2e300), axis=0, return_inverse=True)
            order = np.argsort(code.ravel(), kind="stable")
            held, q, k, bounds, code = held[order], q[order], k[order], bounds[order], code.ravel()[order]
            cuts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(held)]
            self.groups = [(lo, hi, bounds[lo]) for lo, hi in zip(cuts[:-1], cuts[1:])]
        self.names, self.q, self.k = asked.column("query_id").take(pa.array(held)), q, k
        self.size = np.sqrt((q * q).sum(1))
        left = q / np.where(self.size == 0, 1.0, self.size)[:, None] if metric == "cosine" else q
        self.left = np.concatenate([left, np.ones((len(q), 1))], axis=1) if metric == "l2sq" else left
        self.edge, self.least = np.full(len(q), np.inf), np.full(len(q), -np.inf)
        # (query, distance, row's id, exact) of the best rows and of those that came since
        self.best = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, "<U1"), np.zeros(0))
        self.fresh: list[tuple] = []

    def add(self, rows: pa.RecordBatch) -> None:
        at, vectors = _vectors(rows.column("embedding"))
        if not len(at) or not len(self.k):
            return
        ids = rows.column("profile_id").take(pa.array(at)).to_numpy(zero_copy_only=False).astype(str)
        c = vectors
        if self.book is not None:
            codes = rows.column("code").take(pa.array(at)).to_pylist()
            c = self.book.decode(np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1))
        placed = None if self.groups[0][2] is None else _numbers(rows, PLACED)[at]
        for lo, hi, bounds in self.groups:
            some = slice(None) if bounds is None else np.flatnonzero(_allowed(placed, bounds))
            self._compare(lo, hi, c[some], vectors[some], ids[some])
        if not len(self.best[0]) or sum(len(f[0]) for f in self.fresh) > max(len(self.best[0]), 100_000):
            self._settle()

    def _compare(self, lo: int, hi: int, c: np.ndarray, vectors: np.ndarray, ids: np.ndarray) -> None:
        size = np.sqrt((c * c).sum(1))
        if self.metric == "cosine":
            right = c / np.where(size == 0, 1.0, size)[:, None]
        elif self.metric == "l2sq":
            right = np.concatenate([c, -(size * size)[:, None] / 2], axis=1)
        else:
            right = c
        for start in range(0, len(c), self.row_slice):
            block, far = right[start:start + self.row_slice], size[start:start + self.row_slice].max()
            for first in range(lo, hi, self.query_slice):
                asks = slice(first, min(first + self.query_slice, hi))
                left = self.left[asks]
                huge = max(np.abs(block).max(initial=0), np.abs(left).max(initial=0)) > 1e15
                kind, step = (np.float64, 2.0 ** -50) if huge else (np.float32, 2.0 ** -22)
                near = left.astype(kind) @ block.astype(kind).T
                if self.metric == "cosine":
                    error = np.full(len(left), step * (left.shape[1] + 8))
                else:
                    error = step * (left.shape[1] + 8) * (self.size[asks] * far + (far * far if self.metric == "l2sq" else 0))
                error += 1e-8 + 1e-12 * (self.size[asks] ** 2 + far * far)
                least = self.least[asks] - error
                new = np.flatnonzero(np.isneginf(self.least[asks]) & (self.k[asks] <= near.shape[1]))
                if len(new):  # the k-th best of this block is a bound as well
                    place = near.shape[1] - self.k[asks][new]
                    least[new] = np.partition(near[new], np.unique(place), axis=1)[np.arange(len(new)), place] - 2 * error[new]
                hit = np.flatnonzero(near >= least.astype(np.float64)[:, None])
                for part in range(0, len(hit), 100_000):
                    some = hit[part:part + 100_000]
                    col = some // near.shape[1]
                    row = some - col * near.shape[1] + start
                    self._measure(col + first, row, c, vectors, ids, size)

    def _distance(self, col: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
        left = self.q[col]
        if self.metric == "l2sq":
            exact = ((left - right) ** 2).sum(1)
        elif self.metric == "cosine":
            norm = size * self.size[col]
            exact = 1 - (left * right).sum(1) / np.where(norm == 0, 1.0, norm)
        else:
            exact = -(left * right).sum(1)
        return np.round(exact, self.digits) + 0.0

    def _measure(self, col, row, c, vectors, ids, size) -> None:
        distance = self._distance(col, c[row], size[row])
        keep = np.isfinite(distance) & (distance <= self.edge[col])
        col, row, distance = col[keep], row[keep], distance[keep]
        exact = distance if self.book is None else self._distance(col, vectors[row], size[row])
        self.fresh.append((col, distance, ids[row], exact))

    def _settle(self) -> None:
        """Keep the k best of each query; of rows at the distance of the k-th the first by id."""
        if not self.fresh:
            return
        col, distance, ids, exact = (np.concatenate(parts) for parts in zip(self.best, *self.fresh))
        self.fresh = []
        order = np.lexsort((distance, col))
        col, distance, ids, exact = col[order], distance[order], ids[order], exact[order]
        n = np.bincount(col, minlength=len(self.k))
        full = n >= self.k
        first = np.cumsum(n) - n
        self.edge[full] = distance[first[full] + self.k[full] - 1]
        nearer, tied = distance < self.edge[col], distance == self.edge[col]
        room = self.k - np.bincount(col[nearer], minlength=len(self.k))
        crowded = np.flatnonzero(tied & (np.bincount(col[tied], minlength=len(self.k)) > room)[col])
        crowded = crowded[np.lexsort((ids[crowded], col[crowded]))]
        nth = np.arange(len(crowded)) - np.searchsorted(col[crowded], col[crowded], "left")
        keep = nearer | tied
        keep[crowded[nth >= room[col[crowded]]]] = False
        self.best = (col[keep], distance[keep], ids[keep], exact[keep])
        if self.metric == "l2sq":
            self.least[full] = (self.size[full] ** 2 - self.edge[full]) / 2
        else:
            self.least[full] = (1.0 if self.metric == "cosine" else 0.0) - self.edge[full]

    def hits(self) -> Iterator[pa.RecordBatch]:
        self._settle()
        col, distance, ids, exact = self.best
        for lo in range(0, len(col), 100_000):
            part = slice(lo, lo + 100_000)
            names = self.names.take(pa.array(col[part]))
            names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
            yield pa.RecordBatch.from_arrays(
                [names.cast(pa.string()), pa.array(ids[part].tolist(), pa.string()), pa.array(distance[part]),
                 pa.array(self.k[col[part]].astype(np.int32)), pa.array(exact[part])], schema=SCANNED)


def scan_in_stripes(corpus: DataFrame, queries: DataFrame, metric: str = "l2sq", prefilter: bool = False, book: Codebook | None = None,
                    size: int = STRIPE_QUERIES) -> DataFrame:
    """(query_id, profile_id, distance, k, exact): per query its k best rows of each stripe of the corpus that it met.

    Queries are stored and dealt out in stripes of ``size`` at most, and the corpus is sent to each stripe. Where queries are few, the
    corpus is cut into stripes too, so that all tasks have work. In a task the queries come first, then the corpus streams by.
    """
    slices, digits = (QUERY_SLICE, ROW_SLICE), DIGITS
    spark = corpus.sparkSession
    queries = stored(queries, "queries")
    n, most = queries.where("k > 0").agg(F.count(F.lit(1)), F.max("k")).first()
    tasks = 2 * spark.sparkContext.defaultParallelism
    stripes = max(1, -(-n // size), -(-n * (most or 0) // STRIPE_HITS), min(-(-n // STRIPE_LEAST), tasks))
    cuts = max(1, -(-tasks // stripes))
    names = lambda count: F.sequence(F.lit(0), F.lit(count - 1))
    cut = F.pmod(F.xxhash64(*corpus.columns), F.lit(cuts)).cast("int")
    stripe = F.pmod(F.monotonically_increasing_id(), F.lit(stripes)).cast("int")
    rows = corpus.withColumn("_cut", cut).withColumn("_stripe", F.explode(names(stripes)))
    asks = queries.withColumn("_stripe", stripe).withColumn("_cut", F.explode(names(cuts)))
    place = F.col("_stripe") * cuts + F.col("_cut")
    both = asks.withColumn("_turn", place * 2).unionByName(rows.withColumn("_turn", place * 2 + 1), allowMissingColumns=True).drop("_cut", "_stripe")

    def run(batches):
        at, asked, scan = None, [], None
        for batch in batches:
            turns = batch.column("_turn").to_numpy()
            ends = [*(np.flatnonzero(np.diff(turns)) + 1).tolist(), len(turns)] if len(turns) else []
            for lo, hi in zip([0, *ends], ends):
                turn, part = int(turns[lo]), batch.slice(lo, hi - lo)
                if turn // 2 != at:
                    if scan is not None:
                        yield from scan.hits()
                    at, asked, scan = turn // 2, [], None
                if turn % 2 == 0:
                    asked.append(part)
                elif asked:
                    scan = scan or VectorScan(pa.Table.from_batches(asked), metric, prefilter, book, slices, digits)
                    scan.add(part)
        if scan is not None:
            yield from scan.hits()

    dealt = both.repartitionById(stripes * cuts, F.floor(F.col("_turn") / 2).cast("int")).sortWithinPartitions("_turn")
    return dealt.mapInArrow(run, SCANNED_SCHEMA)


def nearest_vectors(corpus: DataFrame, queries: DataFrame, metric: str = "l2sq", prefilter: bool = False, size: int = STRIPE_QUERIES) -> DataFrame:
    """(query_id, profile_id, distance, rank): the k nearest vectors per query, exactly.

    Corpus rows have ``profile_id``, ``embedding`` and, with ``prefilter``, ``PLACED``; queries ``query_id``, ``query_vector``, ``k`` and ``BOUNDS``.
    """
    return _merge(scan_in_stripes(corpus, queries, metric, prefilter, size=size).drop("exact"), thin=False)


def position_walk(radius_degrees: float) -> Callable:
    """Nearest positions by great-circle distance within a radius in degrees of arc, over many blocks at once.

    Rows are sorted by block and latitude; what a query can reach is one run of that order.
    """
    digits, radius_earth, pairs = DIGITS, EARTH_RADIUS_KM, PAIRS
    height = 180 + 3 * radius_degrees  # blocks don't reach into each other

    def walk(corpus: pd.DataFrame, queries: pd.DataFrame) -> Iterator[pd.DataFrame]:
        radius_km = np.radians(radius_degrees) * radius_earth
        blocks, code = np.unique(corpus["block"].to_numpy(), return_inverse=True)
        place = np.searchsorted(blocks, queries["block"].to_numpy())
        met = (place < len(blocks)) & (blocks[np.minimum(place, len(blocks) - 1)] == queries["block"].to_numpy())
        queries, place = queries[met], place[met]
        sorted_by = np.lexsort((corpus["lat"].to_numpy(), code))
        corpus, code = corpus.iloc[sorted_by], code[sorted_by]
        ids = corpus["profile_id"].to_numpy().astype(str)
        lat, lon = corpus["lat"].to_numpy(dtype=float), corpus["lon"].to_numpy(dtype=float)
        line = code * height + lat
        qlat, qlon = queries["lat"].to_numpy(dtype=float), queries["lon"].to_numpy(dtype=float)
        names, k = queries["query_id"].to_numpy(), queries["k"].to_numpy(dtype=np.int64)
        # a little more than the radius, for the rounding of the sums
        lo = np.searchsorted(line, place * height + qlat - radius_degrees - 1e-6, "left")
        hi = np.searchsorted(line, place * height + qlat + radius_degrees + 1e-6, "right")
        ends = np.cumsum(hi - lo)
        start = 0
        while start < len(names):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + pairs, "right")))
            n = (hi - lo)[start:stop]
            col = np.repeat(np.arange(start, stop), n)
            row = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[start:stop], n)
            p1, p2 = np.radians(qlat[col]), np.radians(lat[row])
            a = (np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2)
                 * np.sin(np.radians(lon[row] - qlon[col]) / 2) ** 2)
            km = 2 * radius_earth * np.arctan2(np.sqrt(a), np.sqrt(np.maximum(0.0, 1 - a)))
            km = np.round(km, digits - 3) + 0.0
            near = km <= radius_km
            row, col, km = row[near], col[near], km[near]
            order = np.lexsort((ids[row], km, col))
            row, col, km = row[order], col[order], km[order]
            keep = np.arange(len(col)) - np.searchsorted(col, col, "left") < k[col]
            row, col, km = row[keep], col[keep], km[keep]
            yield pd.DataFrame({"query_id": names[col], "profile_id": ids[row], "distance": km, "k": k[col].astype("int32")})
            start = stop

    return walk


def _merge(hits: DataFrame, repeated: bool = False, thin: bool = True) -> DataFrame:
    """Final k per query, merged in two steps.

    Every task hands in up to k rows per query. They are first thinned per
    (query, salt), so that the last step sees a bounded list per query however
    many tasks there were; without ``thin``, where a query meets few blocks, in one step.
    """
    if repeated:
        hits = hits.dropDuplicates(["query_id", "profile_id"])
    order = ["distance", "profile_id"]
    if not thin:
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(*order))
        return hits.withColumn("rank", rank).filter(F.col("rank") <= F.col("k")).drop("k")
    salt = F.pmod(F.xxhash64("profile_id"), F.lit(MERGE_SALTS))
    part = F.row_number().over(W.partitionBy("query_id", "_salt").orderBy(*order))
    thinned = hits.withColumn("_salt", salt).withColumn("_part", part).filter(
        F.col("_part") <= F.col("k"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(*order))
    return thinned.withColumn("rank", rank).filter(F.col("rank") <= F.col("k")).drop(
        "_salt", "_part", "k")


HITS = pa.schema([("query_id", pa.string()), ("profile_id", pa.string()), ("distance", pa.float64()), ("k", pa.int32())])


def _pack(rows: DataFrame) -> DataFrame:
    """The rows of each task packed as one binary row, all with the same ``side``."""
    def run(batches):
        batches = [b for b in batches if len(b)]
        if batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batches[0].schema) as out:
                for batch in batches:
                    out.write_batch(batch)
            yield pa.RecordBatch.from_arrays(
                [pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([True], pa.bool_())], ["asked", "side"])

    return rows.mapInArrow(run, "asked binary, side boolean")


def scan_in_batches(corpus: DataFrame, queries: DataFrame, scan: Callable, size: int) -> DataFrame:
    """Any number of search texts pass by a corpus that stays where it is.

    Queries are stored and dealt out once, ``size`` rows and ``LETTERS`` letters to a task on average, which packs them into one row.
    Each packed batch is sent to all tasks, where it comes with the first row of the corpus; the other rows stream by its
    ``scan``, which keeps one list of the k best per query. Nothing passes the driver's Python.
    """
    def run(batches):
        held = None
        for batch in batches:
            for asked in batch.column("asked").drop_null():
                held = scan(pa.ipc.open_stream(asked.as_buffer()).read_all())
            if held is not None:
                held.add(batch)
        if held is not None:
            yield from held.hits()

    # rows of a task are numbered in the lower 33 bits
    rows = corpus.withColumn("_first", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0)
    queries = stored(queries, "queries")
    n, letters = queries.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("word")), F.lit(0))).first()
    tasks = max(1, -(-n // size), -(-letters // LETTERS))
    asked = stored(_pack(queries.repartition(tasks)).withColumn("batch", F.monotonically_increasing_id()), "asked")
    numbers = [r[0] for r in asked.select("batch").collect()]  # one per ``size`` queries
    hits = []
    for number in numbers or [0]:
        some = F.broadcast(asked.where(F.col("batch") == number).select("asked", "side"))
        hits.append(rows.join(some, F.col("_first") == F.col("side"), "left").drop("_first", "side").mapInArrow(run, HIT_SCHEMA))
    return reduce(DataFrame.unionByName, hits)


def meet_in_blocks(corpus: DataFrame, queries: DataFrame, walk: Callable) -> DataFrame:
    """``block`` on the corpus meets the same block on the queries, many blocks to a task.

    Both sides are one table, dealt out by ranges of the block name, which are balanced by the number of rows. A
    task holds whole blocks of ``WALK_ROWS`` rows together at a time.
    """
    limit = WALK_ROWS
    both = corpus.withColumn("_asks", F.lit(False)).unionByName(queries.withColumn("_asks", F.lit(True)), allowMissingColumns=True)
    left, right = corpus.columns, queries.columns

    def run(batches):
        held: list[pa.RecordBatch] = []

        def walked(table: pa.Table):
            frame = table.to_pandas()
            asks = frame["_asks"].to_numpy(dtype=bool)
            if asks.any() and not asks.all():
                for found in walk(frame.loc[~asks, left], frame.loc[asks, right]):
                    if len(found):
                        yield pa.RecordBatch.from_pandas(found.reset_index(drop=True), preserve_index=False, schema=HITS)

        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= limit:
                table = pa.Table.from_batches(held)
                names = table.column("block").to_numpy(zero_copy_only=False)
                cut = int(np.flatnonzero(names != names[-1])[-1]) + 1 if names[0] != names[-1] else 0
                if cut:  # all but the last block, which may go on
                    yield from walked(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
                    rows = table.num_rows - cut
        if held:
            yield from walked(pa.Table.from_batches(held))

    dealt = both.repartitionByRange("block").sortWithinPartitions("block")
    return dealt.mapInArrow(run, HIT_SCHEMA)


def _counted(cells: DataFrame) -> DataFrame:
    """A table of cells, sent to all tasks while it is short; a sort-merge join meets it beyond."""
    return F.broadcast(cells) if cells.count() <= CELLS_SENT else cells.hint("merge")


def _cell_blocks(left: DataFrame, right: DataFrame, n_left: DataFrame):
    """Blocks are cells; a crowded cell is cut into several blocks on both sides.

    ``left`` has a row per corpus row and ``right`` one per query and cell that it visits, with the cell as ``_cell``.
    ``n_left`` counts the corpus rows of the cells. The sizes of the visited cells decide the cuts; only they are ever broadcast.
    """
    n_right = right.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("_columns"))
    rows = n_left.select("_cell", F.ceil(F.col("n") / CORPUS_BLOCK).alias("_rows"))
    sizes = _counted(stored(rows.join(n_right, "_cell"), "cells"))
    pos_left = F.pmod(F.xxhash64("profile_id"), F.col("_rows"))
    pos_right = F.pmod(F.xxhash64("query_id"), F.col("_columns"))

    def name(row: Column, column: Column) -> Column:
        return F.concat_ws(":", F.col("_cell").cast("string"), row.cast("string"),
                           column.cast("string"))

    zero = F.lit(0).cast("bigint")
    left = left.join(sizes, "_cell").withColumn(
        "_other", F.explode(F.sequence(zero, F.col("_columns") - 1))).withColumn(
        "block", name(pos_left, F.col("_other"))).drop("_cell", "_rows", "_columns", "_other")
    right = right.join(sizes, "_cell").withColumn(
        "_other", F.explode(F.sequence(zero, F.col("_rows") - 1))).withColumn(
        "block", name(F.col("_other"), pos_right)).drop("_cell", "_rows", "_columns", "_other")
    return left, right


def topk(corpus: DataFrame, queries: DataFrame, scan: Callable, size: int = QUERY_BATCH) -> DataFrame:
    """(query_id, profile_id, distance, rank): the k nearest per query, exactly.

    Corpus rows have ``profile_id`` and the columns of the scan; queries have ``query_id``, ``word``, ``k`` and
    the columns of the scan, which is made from a batch of queries, takes rows and gives its hits. The queries pass by the corpus in batches.
    """
    return _merge(scan_in_batches(corpus, queries, scan, size))


# --- nearest positions -------------------------------------------------------
def _columns_of(band: Column, size: float) -> Column:
    """Number of cells in a band of latitude: each about as wide as it is tall, one at least."""
    low = band * F.lit(size) - 90
    edge = F.greatest(F.lit(0.0), low, -(low + size))  # of the band's latitudes the nearest to the equator
    return F.greatest(F.lit(1), F.floor(F.lit(360.0) * F.cos(F.radians(edge)) / size)).cast("bigint")


def _cell(size: float) -> Column:
    """Cell of a position in bands ``size`` degrees tall."""
    band = F.floor((F.col("lat") + 90) / size).cast("bigint")
    n = _columns_of(band, size)
    column = F.pmod(F.floor((F.col("lon") + 180) * n / 360).cast("bigint"), n)
    return band * (math.floor(360 / size) + 2) + column


def _cells_around(size: float, radius: float) -> Column:
    """Cells that the circle around a position reaches, with longitude wrapped at 180 degrees; all of a band's at a pole."""
    far = radius + 1e-6
    bands = F.sequence(F.greatest(F.lit(0), F.floor((F.col("lat") - far + 90) / size)).cast("bigint"),
                       F.least(F.lit(math.floor(180 / size)), F.floor((F.col("lat") + far + 90) / size)).cast("bigint"))
    # the widest the circle gets, in degrees of longitude
    reach = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(F.lit(far))) / F.cos(F.radians(F.col("lat")))))) + 1e-6
    whole = (F.abs("lat") + far >= 90) | (reach >= 180)

    def columns(band: Column) -> Column:
        n = _columns_of(band, size)
        first = F.floor((F.col("lon") - reach + 180) * n / 360).cast("bigint")
        last = F.floor((F.col("lon") + reach + 180) * n / 360).cast("bigint")
        span = F.when(whole | (last - first >= n), F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.sequence(first, last))
        return F.transform(span, lambda c: band * (math.floor(360 / size) + 2) + F.pmod(c, n))

    return F.array_distinct(F.flatten(F.transform(bands, columns)))


def _radii(rows: DataFrame, asked: DataFrame, k: int, radius: float) -> list[float]:
    """Radii to look in, growing to ``radius``; the first suits the most crowded square degree."""
    if rows.count() * asked.count() <= DIRECT_PAIRS or k < 1:
        return [radius]
    most = rows.groupBy(_cell(1.0).alias("_cell")).count().agg(F.max("count")).first()[0]
    radii = [math.sqrt((4 * k + 8) / (math.pi * most))]
    while radii[-1] * GROWTH < radius:
        radii.append(radii[-1] * GROWTH)
    return [r for r in radii if r * 2 < radius] + [radius]


def nearest_profiles(catalog: DataFrame, points: DataFrame, k: int,
                     radius_degrees: float = 2.0) -> DataFrame:
    """k nearest profiles within a radius (degrees of arc) of each point.

    Rounds with growing radii: a point that has k profiles within the radius of a round is settled, since all others
    lie further away; the rest goes on, to the full radius at last. A round leaves points for later whose cell holds too few
    profiles, so that the pairs of a point stay few, however dense its surroundings are. Of the profiles at one
    position only the k first by id can ever be among the k nearest.
    """
    order = W.partitionBy("lat", "lon").orderBy(F.coalesce("profile_id", F.lit("None")))
    rows = stored(catalog.filter(valid_coordinates()).select("profile_id", "lat", "lon").withColumn(
        "_nth", F.row_number().over(order)).where(F.col("_nth") <= k).drop("_nth"), "places")
    asked = stored(points.filter(valid_coordinates()).select("query_id", "lat", "lon", F.lit(k).alias("k")), "points")
    found = []
    for radius in _radii(rows, asked, k, radius_degrees):
        last = radius == radius_degrees
        size = radius * (2 if last else CELL_RADII)
        left = rows.withColumn("_cell", _cell(size))
        n_left = left.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"))
        tried, postponed = asked, None
        if not last:
            # of a cell with this many rows the circle holds 2k + 2, if they lie evenly
            enough = math.ceil((2 * k + 2) * CELL_RADII ** 2 / math.pi)
            dense = stored(n_left.where(F.col("n") >= enough).select(F.col("_cell").alias("_home"), F.lit(True).alias("_dense")), "dense")
            homes = asked.withColumn("_home", _cell(size)).join(_counted(dense), "_home", "left").drop("_home")
            tried = homes.where("_dense").drop("_dense")
            if tried.isEmpty():
                continue
            postponed = homes.where("_dense IS NULL").select("query_id")
        right = tried.withColumn("_cell", F.explode(_cells_around(size, radius)))
        hits = _merge(meet_in_blocks(*_cell_blocks(left, right, n_left), position_walk(radius)), thin=False)
        if last:
            found.append(hits)
            break
        hits = stored(hits, "hits")
        sure = math.radians(radius) * EARTH_RADIUS_KM * (1 - 1e-6) - 1e-5
        # points that share an id settle together
        settled = hits.where((F.col("rank") == k) & (F.col("distance") < sure) & F.col("query_id").isNotNull()).select("query_id")
        settled = stored(settled.join(postponed, "query_id", "left_anti"), "settled")
        found.append(hits.join(settled, "query_id", "left_semi"))
        asked = stored(asked.join(settled, "query_id", "left_anti"), "points")
        if asked.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


# --- vectors -----------------------------------------------------------------
def vector_topk(corpus: DataFrame, queries: DataFrame, metric: str = "l2sq",
                size: int = STRIPE_QUERIES) -> DataFrame:
    """k nearest vectors per query vector; similarity is 1 - distance (dot: the product)."""
    hits = nearest_vectors(corpus.select("profile_id", "embedding"), queries.select("query_id", "query_vector", "k"), metric, size=size)
    base = 0.0 if metric == "dot" else 1.0
    return hits.withColumn("similarity", F.round(F.lit(base) - F.col("distance"), 6) + F.lit(0.0))


def vector_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Squared L2 distance of vectors ``a`` and ``b`` paired by an equi-join."""
    joined = left.join(right, on)
    squares = F.zip_with(F.col("a"), F.col("b"),
                         lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2))
    distance = F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x)
    return joined.withColumn("distance", F.round(distance, 6) + F.lit(0.0)).drop("a", "b")


class Codebook:
    """Short codes for vectors: each part of ``PART`` components is named by its nearest of 256 centres."""

    PART = 4

    def __init__(self, sample: np.ndarray, rounds: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.size = sample.shape[1]
        self.parts = [slice(lo, lo + self.PART) for lo in range(0, self.size, self.PART)]
        self.centres = []
        for part in self.parts:
            x = sample[:, part]
            c = x[rng.permutation(len(x))[:256]].copy()
            for _ in range(rounds):
                near = self._nearest(x, c)
                n = np.bincount(near, minlength=len(c))
                total = np.zeros_like(c)
                np.add.at(total, near, x)
                c[n > 0] = total[n > 0] / n[n > 0, None]
            self.centres.append(c)

    @staticmethod
    def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.argmin((c * c).sum(1)[None, :] / 2 - x @ c.T, axis=1)

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.stack([self._nearest(x[:, p], c) for p, c in zip(self.parts, self.centres)], axis=1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([c[codes[:, i]] for i, c in enumerate(self.centres)], axis=1)


def _encode(book: Codebook) -> Callable:
    def run(batches):
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), dtype=np.float64).reshape(-1, book.size)
            codes = [row.tobytes() for row in book.encode(x)] if len(x) else []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.binary())], ["profile_id", "embedding", "code"])
    return run


def _usable(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull() & ~F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def _measured(corpus: DataFrame, queries: DataFrame, measured: int, sample_rows: int) -> DataFrame:
    """(query_id, profile_id, distance, rank, exact): the rows worth measuring by their codes, and their exact distance.

    All rows are compared by short codes, a sixteenth or less of the vectors' size, whose centres are fitted on a sample of at most
    ``sample_rows`` vectors, chosen by a hash of the id. Every vector is encoded. Vectors have one length. The task that finds a row by its code
    measures its vector too, so no vector travels to its pairs.
    """
    vectors = _usable(corpus, "embedding").select("profile_id", "embedding")
    some = vectors.orderBy(F.xxhash64("profile_id"), "profile_id").limit(sample_rows).select("embedding").collect()
    if not some:
        return corpus.sparkSession.createDataFrame([], "query_id string, profile_id string, distance double, rank int, exact double")
    book = Codebook(np.array([r[0] for r in some], dtype=np.float64))
    kind = vectors.schema["embedding"].dataType.simpleString()
    coded = vectors.mapInArrow(_encode(book), f"profile_id string, embedding {kind}, code binary")
    asked = _usable(queries, "query_vector").where("k > 0").select(
        "query_id", "query_vector", F.greatest(F.lit(measured), F.col("k") * 2).cast("int").alias("k"))
    return _merge(scan_in_stripes(coded, asked, book=book), thin=False)


def approx_candidates(corpus: DataFrame, queries: DataFrame, measured: int = 64, sample_rows: int = 20_000) -> DataFrame:
    """(query_id, profile_id, rank) of the rows worth measuring: ``measured`` per query, or twice its k if that is more."""
    return _measured(corpus, queries, measured, sample_rows).select("query_id", "profile_id", "rank")


def vector_topk_approx(corpus: DataFrame, queries: DataFrame, measured: int = 64, sample_rows: int = 20_000) -> DataFrame:
    """Nearest vectors among the candidates that short codes give for each query, measured exactly.

    Ids that several rows or queries share pair each with each.
    """
    found = _measured(corpus, queries, measured, sample_rows)
    order = W.partitionBy("query_id").orderBy("distance", "profile_id")
    asks = queries.groupBy("query_id").agg(F.max("k").alias("k"), F.count(F.lit(1)).alias("_asks"))
    rows = corpus.groupBy("profile_id").agg(F.count(F.lit(1)).alias("_rows"))
    first = found.select("query_id", "profile_id", F.col("exact").alias("distance")).join(asks, "query_id").withColumn(
        "rank", F.row_number().over(order)).where(F.col("rank") <= F.col("k"))
    pairs = first.join(rows, "profile_id").withColumn(
        "_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.col("_asks") * F.col("_rows"), F.col("k").cast("bigint")))))
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("k")).select(
        "query_id", "profile_id", "distance", "rank", (F.round(1 - F.col("distance"), 6) + F.lit(0.0)).alias("similarity"))


def approx_quality(corpus: DataFrame, queries: DataFrame, measured: int = 64) -> DataFrame:
    """(recall, pairs_share): what the approximate search finds of the exact hits, and the pairs it measures, as shares."""
    keys = ["query_id", "profile_id"]
    found = vector_topk_approx(corpus, queries, measured).select(*keys, F.lit(1).alias("hit"))
    recall = vector_topk(corpus, queries).join(found, keys, "left").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))
    pairs = approx_candidates(corpus, queries, measured).agg(F.count(F.lit(1))).scalar()
    every = _usable(corpus, "embedding").agg(F.count(F.lit(1))).scalar() * _usable(queries, "query_vector").where("k > 0").agg(F.count(F.lit(1))).scalar()
    return recall.withColumn("pairs_share", pairs / every)
