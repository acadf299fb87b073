"""Embedding near-duplicates by collision counting on one-dimensional projections.

Every vector is projected on many random lines. Two vectors collide on a line when one
lies in the window centred on the other. Pairs that collide on enough lines are verified by
their cosine in double precision; the number of lines, the window and the count are
calibrated so that a pair just at the threshold passes with probability ``RECALL_COUNT``.

So that not all pairs are looked at, tables of a few lines each sort the projections into
slabs, and only vectors that share the slabs of a whole table meet. The number of lines per
table follows the logarithm of the number of distinct vectors (a cell of unrelated vectors then holds
about ``LOAD``), and the number of tables follows from ``RECALL_TABLES``.

Copies of a vector are one node with a count. A cell is cut into chunks, and pairs of chunks
are the unit of work, so a crowded cell spreads over tasks. Of its links a unit gives each node's
number of partners and a forest that joins them, not the pairs. A pair that shares
several tables counts in the first of them only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, erf, exp, log, pi, sqrt
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halocast.llm.components import components
from halocast.llm.text import mix
from halocast.llm.vectors import rows_of
from halocast.session import stored

LINES, WINDOW, SLAB = 64, 0.6, 2.0
RECALL_COUNT, RECALL_TABLES, LOAD = 0.995, 0.96, 32
CHUNK = 1024


def _same_slab(distance: float) -> float:
    """Chance that projections of two points at this distance share a slab."""
    s = distance
    inside = erf(SLAB / (s * sqrt(2)))
    mean = s * sqrt(2 / pi) * (1 - exp(-SLAB * SLAB / (2 * s * s)))
    return inside - mean / SLAB


def calibrate(n: int, cosine: float) -> tuple[int, int, int]:
    """Lines per table, tables, and the collisions that a pair must have."""
    near = sqrt(2 - 2 * cosine)
    lines = max(1, ceil(log(max(n / LOAD, 1.0)) / -log(_same_slab(sqrt(2)))))
    tables = ceil(log(1 - RECALL_TABLES) / log(1 - _same_slab(near) ** lines))
    hit = erf(WINDOW / (near * sqrt(2)))
    low = LINES * hit + NormalDist().inv_cdf(1 - RECALL_COUNT) * sqrt(LINES * hit * (1 - hit))
    return lines, tables, max(1, int(low - 0.5))


@lru_cache(maxsize=16)
def _lines(size: int, count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, size, count])
    return rng.standard_normal((size, count)), rng.random(count) * SLAB


def unit(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags of vectors with a length, and all of them at length 1."""
    top = np.abs(matrix).max(axis=1)
    scaled = matrix / np.where(top > 0, top, 1.0)[:, None]
    return top > 0, scaled / np.maximum(np.sqrt((scaled * scaled).sum(axis=1)), 1e-300)[:, None]


def _raw(row: np.ndarray) -> bytes:
    short = row.astype(np.float32)
    return short.tobytes() if np.array_equal(short.astype(np.float64), row) else row.tobytes()


def _unraw(raw: list[bytes], size: int) -> np.ndarray:
    return unit(np.array([np.frombuffer(r, np.float32 if len(r) == 4 * size else np.float64) for r in raw], np.float64))[1]


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = len(batch)
        sizes, raws = np.zeros(n, np.int32), [None] * n
        with np.errstate(over="ignore"):
            for size, (at, matrix) in rows_of(batch.column(1))[1].items():
                matrix = matrix + 0.0  # one zero
                has, _ = unit(matrix)
                sizes[at[has]] = size
                for i, row in zip(at[has].tolist(), matrix[has], strict=True):
                    raws[i] = _raw(row)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(raws, pa.binary())], ["id", "size", "raw"])


def _cells(lines: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_numpy()
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                vectors = _unraw(batch.column(3).take(pa.array(at)).to_pylist(), size)
                axes, shift = _lines(size, lines * tables, 1)
                slabs = np.floor((vectors @ axes + shift) / SLAB).astype(np.int64).astype(np.uint64).reshape(-1, tables, lines)
                code = np.broadcast_to(np.arange(tables, dtype=np.uint64), slabs.shape[:2]) + np.uint64(size) * np.uint64(1 << 32)
                for k in range(lines):
                    code = mix(code * np.uint64(0x9E3779B97F4A7C15) + slabs[:, :, k])
                code = code.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(pa.array(at)) for c in range(4)),
                     pa.array([row.astype(np.int32).tobytes() for row in code], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(np.arange(0, code.size + 1, tables, dtype=np.int32)), pa.array(code.ravel()))],
                    ["node", "many", "size", "raw", "all_cells", "cells"])
    return run


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place each place is joined with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _links(left: dict, right: dict | None, table: int, least: int, cosine: float):
    """Places (in left, in right) of the pairs that this table owns and that are alike."""
    other = left if right is None else right
    hits = np.zeros((len(left["node"]), len(other["node"])), np.int16)
    for line in range(LINES):
        hits += np.abs(left["places"][:, line, None] - other["places"][None, :, line]) <= WINDOW
    a, b = np.nonzero(hits >= least)
    keep = left["node"][a] < other["node"][b] if right is None else left["node"][a] != other["node"][b]
    a, b = a[keep], b[keep]
    cosines = np.einsum("ij,ij->i", left["vectors"][a], other["vectors"][b])
    earlier = (left["cells"][a, :table] == other["cells"][b, :table]).any(axis=1)
    keep = (cosines >= cosine) & ~earlier
    return a[keep], b[keep]


def _count(least: int, cosine: float):
    """Partners and a forest from rows sorted by unit of work."""
    key_of = ("table", "cell", "low", "high", "size")

    def unit_of(rows: pa.Table, key: tuple) -> pa.RecordBatch | None:
        table, _, low, high, size = key
        raw = rows.column("raw").to_pylist()
        vectors = _unraw(raw, size)
        axes, _ = _lines(size, LINES, 2)
        every = {"node": rows.column("node").to_numpy(), "many": rows.column("many").to_numpy(), "vectors": vectors,
                 "places": vectors @ axes,
                 "cells": np.array([np.frombuffer(c, np.int32) for c in rows.column("all_cells").to_pylist()])}
        chunk = rows.column("chunk").to_numpy()
        n = len(raw)
        if low == high:
            a, b = _links(every, None, table, least, cosine)
        else:
            one, two = np.flatnonzero(chunk == low), np.flatnonzero(chunk == high)
            if not len(one) or not len(two):
                return None
            a, b = _links({k: v[one] for k, v in every.items()}, {k: v[two] for k, v in every.items()}, table, least, cosine)
            a, b = one[a], two[b]
        if not len(a):
            return None
        partners = np.bincount(a, every["many"][b], n) + np.bincount(b, every["many"][a], n)
        root = _roots(n, a, b)
        at = np.flatnonzero(partners)
        return pa.RecordBatch.from_arrays(
            [pa.array(every["node"][at]), pa.array(partners[at].astype(np.int64)), pa.array(every["node"][root[at]])],
            ["node", "partners", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = now if rest is None else pa.concat_tables([rest, now])
            keys = np.stack([now.column(c).to_numpy().astype(np.int64) for c in key_of])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            bounds = [0, *cuts.tolist()]
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                if hi - lo > 1 and (found := unit_of(now.slice(lo, hi - lo), tuple(keys[:, lo].tolist()))):
                    yield found
            rest = now.slice(bounds[-1])
        if rest is not None and len(rest) > 1:
            key = tuple(int(rest.column(c)[0].as_py()) for c in key_of)
            if found := unit_of(rest, key):
                yield found
    return run


def near_duplicates(rows: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component): direct partners of each row, and the smallest id that links reach.

    Vectors that are null, empty or zero, or hold null or non-finite components, have no links and
    are their own component; so has a vector whose length no other has. Equal vectors are linked. Repeated ids are rows of their own;
    rows with a null id can't be named in a link and are left out. Only the two named
    columns are read. An empty table gives no rows.
    """
    plain = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).where("id IS NOT NULL")
    described = stored(plain.mapInArrow(_describe, "id long, size int, raw binary").withColumn(
        "digest", F.when(F.col("size") > 0, F.sha2("raw", 256))), "vectors")
    nodes = described.where("size > 0").groupBy("digest").agg(
        F.min("id").alias("node"), F.count("*").alias("many"), F.any_value("size").alias("size"), F.any_value("raw").alias("raw"))
    nodes = stored(nodes, "nodes")
    lines, tables, least = calibrate(nodes.count(), cosine)
    cells = nodes.withColumn("node", F.xxhash64("digest")).select("node", "many", "size", "raw").mapInArrow(
        _cells(lines, tables), "node long, many long, size int, raw binary, all_cells binary, cells array<long>")
    cells = cells.select("node", "many", "size", "raw", "all_cells", F.posexplode("cells").alias("table", "cell"))
    crowd = nodes.select(F.xxhash64("digest").alias("node"), F.lit(1).cast("long").alias("many"), "size", "raw").mapInArrow(
        _cells(lines, tables), "node long, many long, size int, raw binary, all_cells binary, cells array<long>").select(
        F.posexplode("cells").alias("table", "cell")).groupBy("table", "cell").agg(F.count("*").alias("members")).where("members > 1")
    met = cells.join(crowd, ["table", "cell"]).withColumn("chunks", F.ceil(F.col("members") / CHUNK)).withColumn(
        "chunk", F.pmod(F.xxhash64("node", F.lit(7)), F.col("chunks")))
    units = met.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).select(
        "table", "cell", "size", F.least("chunk", "with").alias("low"), F.greatest("chunk", "with").alias("high"), "chunk",
        "node", "many", "raw", "all_cells")
    dealt = units.repartition("table", "cell", "low", "high").sortWithinPartitions("table", "cell", "low", "high", "size")
    found = stored(dealt.mapInArrow(_count(least, cosine), "node long, partners long, root long"), "partners")
    label = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    partners = found.groupBy("node").agg(F.sum("partners").alias("partners"))
    known = nodes.select("digest", F.col("node").alias("least"), "many", F.xxhash64("digest").alias("node")).join(
        partners, "node", "left").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    lowest = known.groupBy("label").agg(F.min("least").alias("component"))
    known = known.join(lowest, "label").select(
        "digest", (F.coalesce("partners", F.lit(0)) + F.col("many") - 1).alias("n_links"), "component")
    alone = described.where("digest IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return described.where("digest IS NOT NULL").select("id", "digest").join(known, "digest").drop("digest").unionByName(alone)
