"""Byte-level BPE encoding and decoding over Arrow batches.

The tokenizer of the ``tokenizers`` library is made from a rank file: every
rank becomes a vocabulary entry in the byte-to-character alphabet, and its merge
is the last pair that lower ranks leave of its bytes. Texts are cut before a
space that follows a visible character; no match of the split pattern
crosses such a place, so each distinct piece is encoded once per batch and the ids
are put together by position. Long texts are handled whole in this way.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halocast.llm import text as tx

PIECES = 200_000  # distinct pieces remembered by a worker; beyond it starts anew


def byte_alphabet() -> list[str]:
    """The character of each byte: printable Latin-1 stands for itself, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    other = (b for b in range(256) if b not in set(plain))
    table = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}
    return [table[b] for b in range(256)]


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _last_pair(token: bytes, rank: int, known: dict[bytes, int]) -> tuple[bytes, bytes]:
    parts = [token[i: i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best, at = min((known.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1))
        if best >= rank:
            raise ValueError(f"rank {rank} is not made by lower ranks")
        parts[at: at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


class Codec:
    """Encoder and decoder of one rank file and split pattern, kept by a worker."""

    def __init__(self, path: str, pattern: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        known = ranks(path)
        alphabet = byte_alphabet()
        spell = lambda token: "".join(alphabet[b] for b in token)
        merges = [tuple(map(spell, _last_pair(token, rank, known)))
                  for token, rank in sorted(known.items(), key=lambda x: x[1]) if len(token) > 1]
        self.tokenizer = Tokenizer(models.BPE(
            vocab={spell(token): rank for token, rank in known.items()}, merges=merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(Regex(pattern), "isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=False)])
        # decoding: the characters of each entry, back through the reversed byte table
        byte_of = {c: b for b, c in enumerate(alphabet)}
        entries = self.tokenizer.get_vocab()
        self.bytes = [b""] * (max(entries.values()) + 1)
        for entry, rank in entries.items():
            self.bytes[rank] = bytes(byte_of[c] for c in entry)
        self.lengths = np.array([len(b) for b in self.bytes])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.places: dict[str, int] = {}
        self.ids = [np.zeros(0, np.int32)]
        self.ends = [np.zeros(1, np.int64)]

    def _learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.places]
        if not new:
            return
        found = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.places.update(zip(new, range(len(self.places), len(self.places) + len(new)), strict=True))
        self.ends.append(self.ends[-1][-1] + np.cumsum(sizes))
        self.ids.append(np.fromiter((i for ids in found for i in ids), np.int32, int(sizes.sum())))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the n + 1 offsets of the texts."""
        if len(self.places) > PIECES:
            self._forget()
        split = [pieces(t) for t in texts]
        self._learn({p for part in split for p in part})
        self.ids, self.ends = [np.concatenate(self.ids)], [np.concatenate(self.ends)]
        ids, ends = self.ids[0], self.ends[0]
        at = np.fromiter((self.places[p] for part in split for p in part), np.int64)
        sizes = ends[at + 1] - ends[at]
        after = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.arange(after[-1]) + np.repeat(ends[at] - after[:-1], sizes)
        last = np.cumsum([0, *map(len, split)])
        return ids[flat], after[last]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids; an id that isn't in the file raises an error."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lengths)):
            raise ValueError("an id is not in the vocabulary")
        sizes = self.lengths[ids]
        after = np.cumsum(sizes)
        total = int(after[-1]) if len(after) else 0
        return self.flat[np.arange(total) + np.repeat(self.starts[ids] - after + sizes, sizes)].tobytes()

    def spans(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and one-past-last character of each id; a split character counts for every id with a part."""
        data = np.frombuffer(self.decode(ids), np.uint8)
        char = np.cumsum((data & 0xC0) != 0x80) - 1
        after = np.cumsum(self.lengths[ids])
        return char[after - self.lengths[ids]], char[after - 1] + 1


_ODD = re.compile(r"\s ")


def pieces(text: str) -> list[str]:
    """The text in parts, cut before each space that follows a visible character."""
    first, *rest = text.split(" ")
    parts = [first] if first else []
    if not _ODD.search(text) and first:
        parts += [" " + p for p in rest]
        return parts
    before = first
    for p in rest:
        if parts and before and not before[-1].isspace():
            parts.append(" " + p)
        elif parts:
            parts[-1] += " " + p
        else:
            parts.append(" " + p)
        before = p
    return parts


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str]]]:
    _, offsets = tx.utf8(batch.column(1))
    for lo, hi in tx.slices(offsets):
        part = batch.slice(lo, hi - lo)
        yield part.column(0), [t or "" for t in part.column(1).to_pylist()]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           with_spans: bool = False) -> DataFrame:
    """(id, ids) for every row, as each match of the pattern is encoded by itself, without special tokens.

    ``with_spans`` adds starts and ends: the characters that each id covers, wholly
    or in part. A null or empty text has no ids. Repeated rows stay; null
    ids are carried along; other columns are not read, whatever their names.
    """
    tx.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(path, pattern)
        for batch in batches:
            for keys, texts in _texts(batch):
                ids, bounds = made.encode(texts)
                columns = [keys, tx.list_column(ids, bounds, pa.int32())]
                if with_spans:
                    both = [made.spans(ids[a:b]) if b > a else (ids[:0], ids[:0])
                            for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                    columns += [tx.list_column(np.concatenate([x[k] for x in both]).astype(np.int32), bounds, pa.int32())
                                for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "ids", "starts", "ends"][: len(columns)])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, ids array<int>" + ", starts array<int>, ends array<int>" * with_spans)


def decode(tokens: DataFrame, path: str, pattern: str, with_text: bool = True) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, text) from the columns id and ids.

    Bytes are put together before they are read as UTF-8, so a character split
    between ids comes back whole; bytes that are no UTF-8 become U+FFFD in ``text``.
    Null ids count as none.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(path, pattern)
        for batch in batches:
            sizes, own, back, texts = [], [], [], []
            for row in batch.column(1):
                ids = row.values.to_numpy(zero_copy_only=False) if row.is_valid else np.zeros(0, np.int32)
                raw = made.decode(ids)
                sizes.append(len(ids))
                own.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                back.append(hashlib.sha256(raw).hexdigest())
                if with_text:
                    texts.append(raw.decode("utf-8", "replace"))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(own, pa.string()), pa.array(back, pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_text:
                columns, names = [*columns, pa.array(texts, pa.string())], [*names, "text"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return tokens.select("id", "ids").mapInArrow(
        run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", text string" * with_text)
