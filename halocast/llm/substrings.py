"""Substring de-duplication by content-defined seeds.

A gear hash rolls over the bytes (each step shifts left by one bit and adds the byte's random
value, so it depends on the last 32 bytes). The seed of a run of ``least`` words is the word end with the smallest
hash inside the run, so seeds follow the content alone: two documents that share a run of
that many words share its seed, and neighbouring runs mostly have the same one.

A first pass finds the seeds that different documents have; a second one names all runs of those seeds by 128 bits and
keeps the ones that different documents have. Runs in a row with one seed travel as one row, and a task that has all rows of a seed
joins its common runs to stretches before they go back to their documents. Neighbouring and overlapping runs together are the common
passages, word by word. The document with the smallest id keeps a run; the others' are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halocast.llm import text as tx

BITS = 3  # one in 8 white-space bytes is a cut
GEAR = tx.mix(np.arange(1000, 1256, dtype=np.uint64)).astype(np.uint32)
BYTES = tx.mix(np.arange(2001, 2257, dtype=np.uint64) * np.uint64(tx._BASE))  # upper and lower case differ
REACH = 32  # bytes that the rolling hash depends on
LEAST_WORDS = 25
ROW = 64  # runs that travel in one row at most


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte, by doubling: sums over 1, 2, 4 ... 32 bytes."""
    code = GEAR[data]
    reach = 1
    while reach < REACH:
        code[reach:] += code[:-reach].copy() << np.uint32(reach)
        reach *= 2
    return code


def cuts(data: np.ndarray) -> np.ndarray:
    """Places after which a chunk ends, by content alone; the end of the data isn't listed."""
    found = []
    for lo in range(0, len(data), tx.WINDOW):
        start = max(0, lo - REACH + 1)
        code = gear(data[start: lo + tx.WINDOW])[lo - start:]
        lucky = tx.SPACE[data[lo: lo + tx.WINDOW]] & ((code >> np.uint32(32 - BITS)) == 0)
        found.append(np.flatnonzero(lucky) + lo + 1)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _sums(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The running sum of the bytes before each of the ascending places, and the factor that makes runs from there comparable."""
    total, factor = np.zeros(len(places), np.uint64), np.ones(len(places), np.uint64)
    carry, mask = 0, (1 << 64) - 1
    for lo in range(0, len(data), tx.WINDOW):
        part = data[lo: lo + tx.WINDOW]
        scale = np.uint64(pow(tx._BASE, lo, 1 << 64))
        run = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(BYTES[part] * tx._power(tx._BASE, len(part)), out=run[1:], dtype=np.uint64)
        a, b = np.searchsorted(places, [lo, lo + len(part)]).tolist()
        b = len(places) if lo + len(part) == len(data) else b
        at = places[a:b] - lo
        total[a:b] = run[at] * scale + np.uint64(carry)
        factor[a:b] = tx._power(tx._INVERSE, len(part) + 1)[at] * np.uint64(pow(tx._INVERSE, lo, 1 << 64))
        carry = (carry + int(run[-1]) * int(scale)) & mask
    return total, factor


def _gear_before(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The rolling hash after the byte before each of the ascending places."""
    out = np.zeros(len(places), np.uint32)
    for lo in range(0, len(data), tx.WINDOW):
        start = max(0, lo - REACH + 1)
        a, b = np.searchsorted(places, [lo + 1, lo + 1 + tx.WINDOW]).tolist()
        out[a:b] = gear(data[start: lo + tx.WINDOW])[places[a:b] - 1 - start]
    return out


class _Windows:
    """All runs of ``least`` words inside a document, and the seed of each.

    A seed is the place with the smallest rolling hash among the ends of the run's words whose hash lies inside the run,
    named by that hash and 32 bits more of the same bytes: it follows from the run's own bytes.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, least: int):
        reach = min(REACH, 2 * least - 1)  # any run has that many bytes
        s, e = tx.word_spans(data, offsets)
        doc = np.searchsorted(offsets, s, "right") - 1
        at = np.flatnonzero(doc[: max(0, len(s) - least + 1)] == doc[least - 1:]) if len(s) >= least else np.zeros(0, np.int64)
        self.doc, self.first, self.last = doc[at], s[at], e[at + least - 1]
        if not len(at):
            self.seed = np.zeros(0, np.uint64)
            return
        back = np.maximum(e - reach, 0)
        (high, _), (low, factor) = _sums(data, e), _sums(data, back)
        key = tx.mix((high - low) * factor) & np.uint64(0xFFFFFFFF)
        key |= (_gear_before(data, e) << np.uint32(32 - reach)).astype(np.uint64) << np.uint64(32)
        lo, hi = np.searchsorted(e, self.first + reach), at + least
        # the smallest of each range, from those of 1, 2, 4 ... neighbours
        self.seed, width = np.zeros(len(at), np.uint64), hi - lo
        step = 1
        while True:
            fits = np.flatnonzero((width >= step) & (width < 2 * step))
            self.seed[fits] = np.minimum(key[lo[fits]], key[hi[fits] - step])
            if 2 * step > least:
                break
            key = np.concatenate([np.minimum(key[:-step], key[step:]), key[-step:]])
            step *= 2

    def names(self, data: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """64-bit names of the chosen runs' bytes."""
        first, last = self.first[chosen], self.last[chosen]
        (low, factor), (high, _) = _sums(data, first), _sums(data, last)
        return tx.mix((high - low) * factor ^ (last - first).astype(np.uint64) * np.uint64(tx._BASE))


def _slices(column: pa.Array, least: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, _Windows]]:
    data, offsets = tx.utf8(column)
    for lo, hi in tx.slices(offsets):
        part, own = data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo]
        yield lo, hi, part, own, _Windows(part, own, least)


def _seeds(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, _, _, runs in _slices(batch.column(1), least):
                fresh = np.ones(len(runs.seed), bool)
                fresh[1:] = (runs.seed[1:] != runs.seed[:-1]) | (runs.doc[1:] != runs.doc[:-1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).take(pa.array(runs.doc[fresh])), pa.array(runs.seed[fresh].view(np.int64))],
                    ["id", "seed"])

    return run


def _candidates(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told, ends = np.asarray(batch.column(2).values).view(np.uint64), np.asarray(batch.column(2).offsets)
            for lo, hi, part, own, runs in _slices(batch.column(1), least):
                bounds = np.searchsorted(runs.doc, np.arange(hi - lo + 1))
                chosen = np.concatenate([a + np.flatnonzero(np.isin(runs.seed[a:b], told[ends[lo + k]: ends[lo + k + 1]]))
                                         for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))])
                doc, seed, first, last = (x[chosen] for x in (runs.doc, runs.seed, runs.first, runs.last))
                char = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80, dtype=np.int32)])
                base = char[own[doc]]
                heads = _heads(doc, seed, chosen, first, last)
                bounds = np.append(heads, len(chosen))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).take(pa.array(doc[heads])), pa.array(seed[heads].view(np.int64)),
                     tx.list_column(runs.names(part, chosen).view(np.int64), bounds, pa.int64()),
                     tx.list_column((char[first] - base).astype(np.int32), bounds, pa.int32()),
                     tx.list_column((char[last] - base).astype(np.int32), bounds, pa.int32())], ["id", "seed", "name", "first", "last"])

    return run


def _heads(doc: np.ndarray, seed: np.ndarray, run: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Where rows begin: a row holds at most ``ROW`` runs of a document that follow and overlap each other and have one seed."""
    opens = np.ones(len(doc), bool)
    opens[1:] = (doc[1:] != doc[:-1]) | (seed[1:] != seed[:-1]) | (run[1:] != run[:-1] + 1) | (first[1:] > last[:-1])
    begin = np.flatnonzero(opens)
    place = np.arange(len(doc)) - np.repeat(begin, np.diff(np.append(begin, len(doc))))
    return np.flatnonzero(place % ROW == 0)


def _common(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows whose key another id has too, with the smallest id of the key as ``keeper``; ``rows`` are dealt out by (some of) the keys."""
    key = Window.partitionBy(*keys)
    return rows.withColumns({"keeper": F.min("id").over(key), "other": F.max("id").over(key)}).where("keeper <> other").drop("other")


def _stretches(runs: DataFrame) -> DataFrame:
    """(id, cut, first, last): the runs that other documents have too (``cut``: a smaller id has them), those in a row joined.

    All steps share the partitioning by seed. Hot runs pass by in order; no group is gathered.
    """
    inside = Window.partitionBy("seed", "id", "row").orderBy("k")
    one = runs.withColumn("row", F.monotonically_increasing_id()).repartition("seed").select(
        "id", "seed", "row", F.posexplode(F.arrays_zip("name", "first", "last")).alias("k", "run")).select(
        "id", "seed", "row", "k", "run.name", "run.first", "run.last")
    # runs in a row without a gap have their place and their rank at the same distance
    ranked = _common(one, "seed", "name").withColumn("cut", (F.col("keeper") < F.col("id")).cast("int")).withColumns({
        "rank": F.row_number().over(inside),
        "cuts": F.sum("cut").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    every = F.struct(F.lit(False).alias("cut"), (F.col("k") - F.col("rank")).cast("long").alias("part"))
    removed = F.struct(F.lit(True).alias("cut"), (F.col("k") - F.col("cuts")).cast("long").alias("part"))
    return ranked.select("id", "seed", "row", "first", "last", F.inline(F.when(F.col("cut") == 1, F.array(every, removed)).otherwise(F.array(every)))).groupBy(
        "seed", "id", "row", "cut", "part").agg(F.min("first").alias("first"), F.max("last").alias("last")).select("id", "cut", "first", "last")


def repeated_spans(docs: DataFrame, least: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, repeated, removed): two lists of character spans for every document, empty if there are none.

    ``repeated`` spans cover all runs of ``least`` words, white space between them included, whose bytes another document
    has too: a common passage of at least ``least`` words is always found, from its first whole word to its last.
    ``removed`` spans cover the runs that a document of smaller id has. Spans are structs of the first
    character and one past the last; overlapping runs make one span. Null, empty and blank texts have none. Rows
    that share an id are taken for one document, whose rows' spans are joined; rows with a null
    id are left out. Only the two named columns are read.
    """
    if least < 1:
        raise ValueError("least must be at least 1")
    tx.bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL")
    seeds = texts.mapInArrow(_seeds(least), "id long, seed long").repartition("seed")
    told = _common(seeds, "seed").groupBy("id").agg(F.collect_set("seed").alias("told"))
    marks = _stretches(texts.join(told, "id").select("id", "text", "told").mapInArrow(
        _candidates(least), "id long, seed long, name array<long>, first array<int>, last array<int>"))
    order = Window.partitionBy("id", "cut").orderBy("first", "last")
    before = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = marks.withColumn("opens", (F.col("first") > F.coalesce(before, F.lit(-1))).cast("int")).withColumn(
        "span", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("id", "cut", "span").agg(
        F.min("first").alias("first"), F.max("last").alias("last"))
    listed = lambda cut, name: F.array_sort(F.collect_list(F.when(F.col("cut") == cut, F.struct("first", "last")))).alias(name)
    none = F.array().cast("array<struct<first:int,last:int>>")
    return texts.select("id").distinct().join(spans.groupBy("id").agg(listed(False, "repeated"), listed(True, "removed")), "id", "left").select(
        "id", F.coalesce("repeated", none).alias("repeated"), F.coalesce("removed", none).alias("removed"))


def without(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the removed spans cut out of their texts; null ids and unlisted ids keep their text."""
    cut = spans.where(F.size("removed") > 0).select(F.col("id").alias("__id"), F.col("removed").alias("__removed"))
    whole = F.col(text_col).cast("string")
    places = F.concat(F.array(F.lit(0)), F.col("__removed.last"))
    ends = F.concat(F.col("__removed.first"), F.array(F.length(whole)))
    kept = F.array_join(F.transform(F.arrays_zip(places.alias("a"), ends.alias("b")),
                                    lambda s: F.substring(whole, s["a"] + 1, s["b"] - s["a"])), "")
    both = docs.join(cut, docs[id_col].cast("long") == F.col("__id"), "left")
    return both.withColumn(text_col, F.when(F.col("__removed").isNull(), whole).otherwise(kept)).select(*docs.columns)
