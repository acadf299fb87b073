"""Language-model scoring from Elias-Fano tries.

The model is a smoothed bigram model: p(w | v) mixes c(v w) / c(v) and the unigram base, with
weight ``BACKOFF`` on the base; an unseen context leaves the base alone. Counts cover all training
documents.

Texts become blocks of about ``BLOCK`` bytes: word numbers of the block, its distinct words by
64-bit hash, its documents. Nothing that grows with the corpus is broadcast or held whole:

1. Blocks send their distinct words with their training counts to word shards, which add them up and answer with
   a number and the count of each word.
2. Blocks send their distinct bigrams, dealt by a hash of both words so that no frequent word crowds a shard, with
   training counts, the counts of both words and the documents they stand in.
3. Each bigram shard builds a trie: the contexts' numbers, pointers to their successors, the successors,
   all as Elias-Fano sequences, and probabilities quantised to 16 bits. Its levels are written to files and
   memory-mapped; every bigram of the shard is looked up in them, and sums per document go back.

Shards grow in number with the tokens (``SHARD`` per shard), not in size.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halocast.llm import text as tx
from halocast.session import stored

BLOCK = 6 << 20  # bytes of text in a block; a longer document stands alone
SHARD = 2_000_000  # tokens per shard
BACKOFF = 0.4
END = np.uint64(0x5555AAAA5555AAAA)  # the hash that stands for the end of a text
FLOOR, STEP = -24.0, 24.0 / 65535  # quantised log10 probabilities


# --- Elias-Fano sequences -------------------------------------------------------------

_BYTE_SELECT = np.array([[([i for i in range(8) if b >> i & 1] + [8] * 8)[k] for k in range(8)] for b in range(256)], np.uint8)


def _bits(values: np.ndarray, width: int) -> np.ndarray:
    """Values of ``width`` bits side by side in 64-bit words."""
    words = np.zeros(len(values) * width // 64 + 2, np.uint64)
    if width and len(values):
        place = np.arange(len(values), dtype=np.int64) * width
        word, shift = place >> 6, (place & 63).astype(np.uint64)
        np.bitwise_or.at(words, word, values << shift)
        over = np.flatnonzero((place & 63) + width > 64)
        np.bitwise_or.at(words, word[over] + 1, values[over] >> (np.uint64(64) - shift[over]))
    return words


def _bits_at(words: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    if not width:
        return np.zeros(len(at), np.uint64)
    place = at.astype(np.int64) * width
    word, shift = place >> 6, (place & 63).astype(np.uint64)
    low = words[word] >> shift
    high = np.where(shift > 0, words[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
    return (low | high) & np.uint64((1 << width) - 1)


class EliasFano:
    """A rising sequence of integers: low bits packed, high bits as gaps in a bit string."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray, ones: np.ndarray):
        self.n, self.width, self.low, self.high, self.zeros, self.ones = n, width, low, high, zeros, ones

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        high = (values >> np.uint64(width)).astype(np.int64)
        length = n + (int(high[-1]) if n else 0) + 2
        words = np.zeros(length // 64 + 1, np.uint64)
        place = high + np.arange(n)
        np.bitwise_or.at(words, place >> 6, np.uint64(1) << (place & 63).astype(np.uint64))
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])
        zeros = np.arange(len(ones)) * 64 - ones
        return cls(n, width, _bits(values & np.uint64((1 << width) - 1), width), words, zeros, ones)

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.width]), self.low, self.high, self.zeros, self.ones]

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the k-th bit (from 0) that is one, or zero."""
        table = self.ones if ones else self.zeros
        word = np.minimum(np.searchsorted(table, k, "right") - 1, len(self.high) - 1)
        left = k - table[word]
        bits = self.high[word] if ones else ~self.high[word]
        place = word * 64
        open_ = np.ones(len(k), bool)
        out = place.copy()
        for b in range(8):
            byte = ((bits >> np.uint64(8 * b)) & np.uint64(255)).astype(np.int64)
            many = np.bitwise_count(byte.astype(np.uint8)).astype(np.int64)
            here = open_ & (left < many)
            out[here] = place[here] + 8 * b + _BYTE_SELECT[byte[here], left[here]]
            open_ &= ~here
            left = np.where(open_, left - many, left)
        return out

    def get(self, at: np.ndarray) -> np.ndarray:
        high = (self._select(at, True) - at).astype(np.uint64)
        return (high << np.uint64(self.width)) | _bits_at(self.low, self.width, at)

    def successor(self, values: np.ndarray) -> np.ndarray:
        """Place of the first element that isn't smaller; n if there is none."""
        values = values.astype(np.uint64)
        out = np.full(len(values), self.n, np.int64)
        if not self.n:
            return out
        high = (values >> np.uint64(self.width)).astype(np.int64)
        most = int(self.zeros[-1]) - 1
        inside = np.flatnonzero(high <= most)
        high, wanted = high[inside], values[inside] & np.uint64((1 << self.width) - 1)
        lo = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) - (high - 1), 0)
        hi = np.minimum(self._select(high, False) - high, self.n)
        lo = np.minimum(lo, self.n)
        while len(open_ := np.flatnonzero(lo < hi)):
            middle = (lo[open_] + hi[open_]) // 2
            less = _bits_at(self.low, self.width, middle) < wanted[open_]
            lo[open_[less]] = middle[less] + 1
            hi[open_[~less]] = middle[~less]
        out[inside] = lo
        return out


class Trie:
    """Contexts, pointers, successors and quantised probabilities, memory-mapped from level files.

    Successor w of the i-th context is stored as i * universe + w, which rises over the whole
    level; a lookup is a successor search for that value, inside the context's pointers.
    """

    def __init__(self, folder: Path):
        self.levels = []
        for name in ("contexts", "pointers", "successors"):
            n, width = np.load(folder / f"{name}0.npy").tolist()
            self.levels.append(EliasFano(n, width, *(np.load(folder / f"{name}{k}.npy", mmap_mode="r") for k in range(1, 5))))
        self.codes = np.load(folder / "codes.npy", mmap_mode="r")
        self.universe = int(np.load(folder / "universe.npy")[0])

    @staticmethod
    def write(folder: Path, context: np.ndarray, word: np.ndarray, log10: np.ndarray) -> None:
        """Levels from (context, word) pairs in ascending order, without repeats."""
        names, first = np.unique(context, return_index=True)
        universe = int(word.max()) + 1 if len(word) else 1
        owner = np.repeat(np.arange(len(names)), np.diff(np.append(first, len(word))))
        sequences = {"contexts": names, "pointers": np.append(first, len(word)), "successors": owner * universe + word}
        for name, values in sequences.items():
            for k, part in enumerate(EliasFano.of(values).parts()):
                np.save(folder / f"{name}{k}.npy", part)
        np.save(folder / "codes.npy", np.clip(np.rint((log10 - FLOOR) / STEP), 0, 65535).astype(np.uint16))
        np.save(folder / "universe.npy", np.array([universe]))

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Quantised log10 probability of each pair; NaN for a pair that isn't stored."""
        contexts, pointers, successors = self.levels
        out = np.full(len(context), np.nan)
        node = contexts.successor(context)
        at = np.flatnonzero((node < contexts.n) & (word < self.universe))
        at = at[contexts.get(node[at]) == context[at].astype(np.uint64)]
        value = node[at] * self.universe + word[at]
        place = successors.successor(value)
        inside = (place >= pointers.get(node[at]).astype(np.int64)) & (place < pointers.get(node[at] + 1).astype(np.int64))
        at, place, value = at[inside], place[inside], value[inside]
        same = successors.get(place) == value.astype(np.uint64)
        out[at[same]] = FLOOR + STEP * self.codes[place[same]].astype(float)
        return out


# --- Rows of arrays ---------------------------------------------------------------------


def _planes(a: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones and so on, which compresses better."""
    return np.ascontiguousarray(np.frombuffer(a.tobytes(), np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes()


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays compressed together: types and lengths first, then their bytes."""
    head = ";".join(f"{a.dtype.str}:{len(a)}" for a in arrays).encode()
    return len(head).to_bytes(4, "little") + head + zstandard.ZstdCompressor(level=1).compress(b"".join(map(_planes, arrays)))


def _unpack(raw: bytes) -> list[np.ndarray]:
    size = int.from_bytes(raw[:4], "little")
    body, out, at = zstandard.ZstdDecompressor().decompress(raw[4 + size:]), [], 0
    for part in raw[4: 4 + size].decode().split(";"):
        kind, n = part.rsplit(":", 1)
        wide, n = np.dtype(kind).itemsize, int(n)
        planes = np.frombuffer(body, np.uint8, n * wide, at).reshape(wide, n)
        out.append(np.frombuffer(np.ascontiguousarray(planes.T).tobytes(), kind))
        at += n * wide
    return out


def _small(a: np.ndarray) -> np.ndarray:
    """The same numbers in 32 bits where they fit."""
    return a.astype(np.uint32) if not len(a) or a.max() < 1 << 32 else a.astype(np.uint64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
    for batch in batches:
        data, offsets = tx.utf8(batch.column(1))
        ids = batch.column(0)
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        named = ids.fill_null(0).to_numpy(zero_copy_only=False)
        held = batch.column(2).to_numpy(zero_copy_only=False)
        for lo, hi in tx.slices(offsets, BLOCK):
            hashes, bounds = tx.words(data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo])
            # an end after each document
            tokens = np.insert(hashes, bounds[1:], END)
            bounds = bounds + np.arange(len(bounds))
            words, local, many = np.unique(tokens, return_inverse=True, return_counts=True)
            train = np.bincount(local, np.repeat(~held[lo:hi], np.diff(bounds)), len(words)).astype(np.uint32)
            # texts hold word numbers by frequency, which are small; ``order`` leads back to the order of the hashes
            order = np.argsort(-many, kind="stable")
            by_frequency = np.empty(len(words), np.int64)
            by_frequency[order] = np.arange(len(words))
            number += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([len(tokens)]), pa.array([int((~held[lo:hi]).sum())]),
                 pa.array([_pack(words, train)], pa.binary()),
                 pa.array([_pack(named[lo:hi], known[lo:hi].astype(np.uint8), held[lo:hi].astype(np.uint8), bounds,
                           by_frequency[local].astype(np.uint32), order.astype(np.uint32))], pa.binary())],
                ["block", "tokens", "train_docs", "words", "texts"])


def _word_requests(shards: int):
    """Words and training counts by ranges of the hash, so that the answers follow the order of the words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words, train = _unpack(raw)
                shard = ((words >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
                cuts = np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))
                full = np.flatnonzero(np.diff(cuts))
                blobs = [_pack(words[cuts[s]: cuts[s + 1]], train[cuts[s]: cuts[s + 1]]) for s in full]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full.astype(np.int32)), pa.array(np.full(len(full), block)), pa.array(blobs, pa.binary())],
                    ["shard", "block", "blob"])
    return run


def _word_shard(shards: int):
    """Numbers and counts of a shard's words, block by block; the block -1 holds its totals."""
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        blobs = [_unpack(raw) for raw in table.column("blob").to_pylist()]
        words, place = np.unique(np.concatenate([b[0] for b in blobs]), return_inverse=True)
        total = np.bincount(place, np.concatenate([b[1] for b in blobs]), len(words)).astype(np.int64)
        rank = np.empty(len(words), np.int64)
        rank[np.argsort(-total, kind="stable")] = np.arange(len(words))
        number = rank * shards + shard + 1  # small for frequent words; 0 stands for the start of a text
        ends = np.cumsum([0, *(len(b[0]) for b in blobs)])
        answers = [_pack(_small(number[place[a:z]]), _small(total[place[a:z]])) for a, z in zip(ends[:-1], ends[1:], strict=True)]
        answers.append(_pack(np.array([total.sum(), np.count_nonzero(total)])))
        return pa.table({"shard": pa.array([shard] * len(answers), pa.int32()),
                         "block": pa.array([*table.column("block").to_pylist(), -1], pa.int64()),
                         "blob": pa.array(answers, pa.binary())})
    return run


def _bigram_requests(shards: int, total: int, distinct: int, train_docs: int):
    """A block's bigrams for each shard, and what it knows of its documents for the first of them."""
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        out_shard, out_blob = [], []
        for raw in blocks.column("texts").to_pylist():
            ids, known_id, held, bounds, local, order = _unpack(raw)
            told = [_unpack(blob) for _, blob in sorted(zip(answers.column("shard").to_pylist(), answers.column("blob").to_pylist(), strict=True))]
            number, count = (np.concatenate([t[k] for t in told]).astype(np.int64)[order] for k in (0, 1))
            n_docs, size = len(ids), len(order) + 1
            doc = np.repeat(np.arange(n_docs), np.diff(bounds))
            base = np.log10((count + 0.1) / (total + 0.1 * (distinct + 1)))
            stats = (ids, known_id, held, np.diff(bounds), np.bincount(doc, count[local] > 0, n_docs).astype(np.int64),
                     np.bincount(doc, base[local], n_docs))
            # words from 1, 0 for the start of a text
            now = local.astype(np.int64) + 1
            before = np.concatenate([[0], now[:-1]]) if len(now) else now
            before[bounds[:-1]] = 0
            pair, many = _pairs(before * size + now, doc)
            gram = pair[0]
            first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])) if len(gram) else np.zeros(0, np.int64)
            docs = np.diff(np.append(first, len(gram)))
            v, w = gram[first] // size, gram[first] % size - 1
            trained = np.add.reduceat(np.where(held[pair[1]] > 0, 0, many), first) if len(first) else np.zeros(0, np.int64)
            context = np.where(v > 0, number[np.maximum(v - 1, 0)], 0)
            of_context = np.where(v > 0, count[np.maximum(v - 1, 0)], train_docs)
            shard = (tx.mix(context.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + number[w].astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
            order = np.lexsort((number[w], context, shard))
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            start = np.cumsum(docs) - docs
            for k, s in enumerate(np.flatnonzero(np.diff(cuts)).tolist()):
                own = order[cuts[s]: cuts[s + 1]]
                sizes = docs[own]
                rows = np.arange(sizes.sum()) + np.repeat(start[own] - np.cumsum(sizes) + sizes, sizes)
                out_shard.append(s)
                out_blob.append(_pack(*map(_small, (np.diff(context[own], prepend=0), number[w[own]], trained[own], of_context[own], count[w[own]], sizes,
                                                    pair[1][rows], many[rows])), *(stats if k == 0 else ())))
        block = blocks.column("block")[0].as_py() if len(blocks) else -1
        return pa.table({"shard": pa.array(out_shard, pa.int32()), "block": pa.array([block] * len(out_shard), pa.int64()),
                         "blob": pa.array(out_blob, pa.binary())})
    return run


def _pairs(gram: np.ndarray, doc: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Distinct (gram, document) pairs in order, and how often each occurs."""
    order = np.lexsort((doc, gram))
    gram, doc = gram[order], doc[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return (gram[first], doc[first]), np.diff(np.append(first, len(gram)))


def _bigram_shard(total: int, distinct: int, backoff: float):
    """Build the shard's trie, look all its bigrams up, and give each block its documents' sums."""
    def run(table: pa.Table) -> pa.Table:
        blobs = [_unpack(raw) for raw in table.column("blob").to_pylist()]
        context = np.concatenate([np.cumsum(b[0], dtype=np.int64) for b in blobs])  # sent as gaps
        word, trained, of_context, of_word = (np.concatenate([b[k] for b in blobs]).astype(np.int64) for k in range(1, 5))
        order = np.lexsort((word, context))
        new = np.ones(len(order), bool)
        new[1:] = (context[order][1:] != context[order][:-1]) | (word[order][1:] != word[order][:-1])
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        one = order[new]
        count = np.bincount(place, trained, len(one)).astype(np.int64)
        context, word, of_context, of_word = context[one], word[one], of_context[one], of_word[one]
        base = (of_word + 0.1) / (total + 0.1 * (distinct + 1))
        stored_ = np.flatnonzero(count > 0)
        smoothed = (1 - backoff) * count[stored_] / np.maximum(of_context[stored_], 1) + backoff * base[stored_]
        with tempfile.TemporaryDirectory() as folder:
            Trie.write(Path(folder), context[stored_], word[stored_], np.log10(smoothed))
            found = Trie(Path(folder)).find(context, word)
        unseen = np.log10(base) + np.where(of_context > 0, np.log10(backoff), 0.0)
        log10 = np.where(np.isnan(found), unseen, found)
        ends, answers = np.cumsum([0, *(len(b[0]) for b in blobs)]), []
        for b, a, z in zip(blobs, ends[:-1], ends[1:], strict=True):
            each = np.repeat(log10[place[a:z]], b[5].astype(np.int64)) * b[7]
            sums = np.bincount(b[6], each)
            at = np.flatnonzero(sums)
            answers.append(_pack(_small(at), sums[at].astype(np.float32), *b[8:]))
        return pa.table({"block": table.column("block"), "blob": pa.array(answers, pa.binary())})
    return run


def _documents(table: pa.Table) -> pa.Table:
    blobs = [_unpack(raw) for raw in table.column("blob").to_pylist()]
    ids, known, held, tokens, seen, base = next(b[2:] for b in blobs if len(b) > 2)
    score = np.zeros(len(ids))
    for b in blobs:
        score[b[0]] += b[1].astype(float)
    return pa.table({"id": pa.array(ids, pa.int64(), mask=known == 0), "held_out": pa.array(held.astype(bool)),
                     "n_tokens": pa.array(tokens, pa.int64()), "n_known": pa.array(seen, pa.int64()),
                     "base_score": pa.array(base), "score": pa.array(score)})


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10,
          backoff: float = BACKOFF) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Documents whose crc32(id as text) mod ``folds`` is 0 are held out; all others teach the model. Null and empty
    texts are an end alone; a null id counts as held out and stays null. Repeated rows count
    as often as they occur. An empty table gives no rows; without training
    documents every word has the base's floor. Other columns are not read.
    """
    tx.bounded_batches(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    plain = plain.withColumn("held", F.coalesce(F.crc32(F.col("id").cast("string")) % folds == 0, F.lit(True)))
    blocks = stored(plain.mapInArrow(_blocks, "block long, tokens long, train_docs long, words binary, texts binary"), "blocks")
    tokens, train_docs = blocks.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("train_docs"), F.lit(0))).first()
    shards = max(1, -(-tokens // SHARD))
    answers = stored(blocks.select("block", "words").mapInArrow(_word_requests(shards), "shard int, block long, blob binary")
                     .groupBy("shard").applyInArrow(_word_shard(shards), "shard int, block long, blob binary"), "words")
    total = distinct = 0
    for row in answers.where("block = -1").toLocalIterator():  # a row per shard
        here = _unpack(bytes(row.blob))[0]
        total, distinct = total + int(here[0]), distinct + int(here[1])
    asked = blocks.select("block", "texts").groupBy("block").cogroup(answers.where("block <> -1").groupBy("block")).applyInArrow(
        _bigram_requests(shards, total, distinct, train_docs), "shard int, block long, blob binary")
    sums = asked.groupBy("shard").applyInArrow(_bigram_shard(total, distinct, backoff), "block long, blob binary")
    out = sums.groupBy("block").applyInArrow(
        _documents, "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(total).cast("long"))
