"""Prefix trie of conversations by truncation peeling.

A turn is a 16-byte digest, and a node a 16-byte key: the digest of its parent's key and its
last turn. A conversation's path is the row of its nodes' keys, so that sorted paths put every
subtree in one stretch. Equal conversations are one entry with a count, their smallest id and
the digest of all their ids.

Paths are sorted over all tasks by range. A task peels blocks of a bounded number of bytes from
the greatest depth upwards: at each depth the entries that end there join the surviving nodes, equal
keys are merged, children give their sums to their parent, and the last turn is stripped. Only nodes
on the first or last path of a block can go on in another block. They stay open: what the block knows of
them follows as two entries a block, which are sorted and peeled like conversations, round by
round, until one block is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halocast.llm.sizes import sendable
from halocast.session import stored

KEY = 16  # bytes of a digest
BLOCK_BYTES = 8 << 20  # of the paths peeled at once
LAST_BYTES = 16 << 20  # open paths of this size are peeled as the last block
ROUND_BYTES = 64 << 20  # of open paths that a task of a further round is given
IDS_BITS = 12  # a chunk of ids spans 2**12 numbers
NONE = np.iinfo(np.int64).max
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_digest(role: Column, text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * KEY))


def _chain(graft: tuple[int, int] | None) -> Callable:
    """Sorted turns (base, conv_id, digest, size) as one path per conversation; turns stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        weight = 0
        base = conv = None
        heads: list[tuple] = []
        key, path, sizes, own, skipped = b"", bytearray(), [], 0, 0

        def add(digest: bytes, size: int) -> None:
            nonlocal key
            key = hashlib.blake2b(key + digest, digest_size=KEY).digest()
            path.extend(key)
            sizes.append(size)

        def out() -> pa.RecordBatch:
            nonlocal weight
            rows, weight = list(zip(*done, strict=True)), 0
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.binary())],
                                              ["conv_id", "path", "sizes"])

        def close() -> None:
            nonlocal weight
            done.append((conv, bytes(path), np.array(sizes, np.int64).tobytes()))
            weight += 2 * len(path) + 64

        for batch in batches:
            for b, c, digest, size in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if c != conv:
                    if conv is not None:
                        close()
                        if weight > BLOCK_BYTES:
                            yield out()
                    if b != base:
                        base, heads = b, []
                    conv, own = c, 0
                    key, path, sizes = b"", bytearray(), []
                    skipped = crc32(str(c).encode()) % graft[1] if graft and c != base else 0
                    for head in heads[:skipped]:
                        add(*head)
                own += 1
                if graft and c == base and own < graft[1]:
                    heads.append((digest, size))
                if own > skipped:
                    add(digest, size)
        if conv is not None:
            close()
            yield out()
    return run


def paths(turns: DataFrame, graft: tuple[int, int] | None = None, conv_col: str = "conv_id", turn_col: str = "turn",
          role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, path, sizes): the path of every conversation and the UTF-8 bytes of each turn's text.

    Turns are ordered by ``turn``, null first, then role, then the turn's digest; every row is a turn, repeated ones
    too. A null role or text is empty. Rows without a conversation id take no part.

    ``graft`` (g, m) rebuilds every conversation c: it begins with the first h turns of conversation c - c % g (all
    if it has fewer, none if it is absent), followed by its own turns after its first h, where h is
    crc32 of c as decimal text modulo m. It may be left without turns.

    A conversation is walked by one task, since each key needs the one before; its turns stream by and leave 24 bytes each.
    """
    conv = F.col(conv_col).cast("long")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.select(
        (conv - conv % graft[0] if graft else conv).alias("base"), conv.alias("conv_id"), F.col(turn_col).alias("turn"),
        role.alias("role"), turn_digest(role, text).alias("digest"), F.octet_length(text).cast("long").alias("size")).where("conv_id IS NOT NULL")
    order = ["base", (F.col("conv_id") != F.col("base")), "conv_id", F.col("turn").asc_nulls_first(), "role", "digest"]
    dealt = rows.repartition("base").sortWithinPartitions(*order).select("base", "conv_id", "digest", "size")
    return dealt.mapInArrow(_chain(graft), "conv_id long, path binary, sizes binary")


class _Block:
    """Sorted paths and their entries: what is known of a node before its children are counted."""

    def __init__(self) -> None:
        self.paths: list[bytes] = []
        self.sizes: list[bytes] = []
        self.entries: list[tuple] = []  # row, depth, members, smallest, children, leaves, saved, digest of ends
        self.bytes = 0

    def row(self, path: bytes, sizes: bytes) -> int:
        self.paths.append(path)
        self.sizes.append(sizes)
        self.bytes += len(path) + 64
        return len(self.paths) - 1


FIELDS = [("key", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()),
          ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()),
          ("path", pa.binary()), ("sizes", pa.binary()), ("depths", pa.list_(pa.int64())), ("sums", pa.list_(pa.int64())), ("ends", pa.list_(pa.string()))]
SCHEMA = ("key binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
          "saved_tokens long, ends_sha256 string, path binary, sizes binary, depths array<long>, sums array<long>, ends array<string>")


def _batch(columns: dict, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f], t) if f in columns else pa.nulls(n, t) for f, t in FIELDS], [f for f, _ in FIELDS])


def _peel(block: _Block, last: bool) -> Iterator[pa.RecordBatch]:
    """The block's nodes that are whole, and its open entries; in the ``last`` block all nodes are whole."""
    rows = len(block.paths)
    length = np.array([len(p) // KEY for p in block.paths], np.int64)
    off = np.concatenate([[0], np.cumsum(length)])
    keys = np.frombuffer(b"".join(block.paths), np.uint64).reshape(-1, KEY // 8)
    size = np.frombuffer(b"".join(block.sizes), np.int64)
    cols = list(zip(*block.entries, strict=True))
    e_row, e_depth = np.array(cols[0], np.int64), np.array(cols[1], np.int64)
    e_sums, e_ends = np.array(cols[2:7], np.int64), np.array(cols[7], object)
    by_depth = np.argsort(e_depth, kind="stable")
    starts = np.searchsorted(e_depth[by_depth], np.arange(int(length.max()) + 2))
    name = lambda at, d: [b""] * len(at) if not d else [k.tobytes() for k in keys[off[at] + d - 1]]
    open_at: dict[int, list] = {0: [], rows - 1: []}
    # surviving nodes of the depth below: first and last row, whole or not, members, smallest, children, leaves, saved, ends
    first, until = np.zeros(0, np.int64), np.zeros(0, np.int64)
    whole, sums, ends = np.zeros(0, bool), np.zeros((5, 0), np.int64), np.zeros(0, object)
    for d in range(int(length.max()), -1, -1):
        here = by_depth[starts[d]:starts[d + 1]]
        # newly ended entries join the survivors, which lost their last turn
        at = np.concatenate([first, e_row[here]])
        order = np.argsort(at, kind="stable")
        at, child = at[order], (order < len(first))
        name_at = keys[off[at] + d - 1] if d else np.zeros((len(at), 1), np.uint64)
        new = np.concatenate([[True], (name_at[1:] != name_at[:-1]).any(axis=1)])
        heads, group = np.flatnonzero(new), np.cumsum(new) - 1
        n = len(heads)
        # sums of entries, and of whole children
        took = np.zeros((5, len(at)), np.int64)
        took[1] = NONE
        took[:, ~child] = e_sums[:, here[order[~child] - len(first)]]
        kids = order[child]
        counted = child.copy()
        counted[child] = whole[kids]
        took[:, counted] = sums[:, order[counted]]
        took[2, counted] = 1
        out = np.stack([np.add.reduceat(took[0], heads), np.minimum.reduceat(took[1], heads)] + [np.add.reduceat(took[i], heads) for i in (2, 3, 4)])
        above_first = at[heads]
        span = at.copy()
        span[child] = until[kids]
        above_until = np.maximum.reduceat(span, heads)
        above_whole = np.full(n, last) | ((above_first > 0) & (above_until < rows - 1))
        above_ends = np.full(n, "", object)
        ended = np.flatnonzero(~child)
        ended = ended[e_ends[here[order[ended] - len(first)]] != ""]
        above_ends[group[ended]] = e_ends[here[order[ended] - len(first)]]
        # whole nodes: a node without children is a leaf, and its text is saved once a further member
        bottom = above_whole & (out[2] == 0)
        out[3, bottom] = 1
        if d:
            out[4] += np.where(above_whole, (out[0] - 1) * size[off[above_first] + d - 1], 0)
        # children follow when their parent is known
        ready = np.flatnonzero(counted)
        if len(ready):
            nodes, above = order[ready], group[ready]
            yield _batch({
                "key": name(first[nodes], d + 1), "parent": name(first[nodes], d), "depth": np.full(len(nodes), d + 1), "conv_id": sums[1, nodes],
                "parent_conv_id": pa.array(out[1, above], mask=~above_whole[above]), "n_convs": sums[0, nodes], "n_children": sums[2, nodes],
                "n_leaves": sums[3, nodes], "saved_tokens": sums[4, nodes], "ends_sha256": [e or NO_ENDS for e in ends[nodes]]}, len(nodes))
        for i in np.flatnonzero(~above_whole).tolist():
            open_at[0 if not above_first[i] else rows - 1].append((d, out[:, i].tolist(), above_ends[i]))
        first, until, whole, sums, ends = above_first, above_until, above_whole, out, above_ends
    if last:
        yield _batch({"key": [b""], "depth": [0], "conv_id": sums[1], "n_convs": sums[0], "n_children": sums[2], "n_leaves": sums[3],
                      "saved_tokens": sums[4], "ends_sha256": [ends[0] or NO_ENDS]}, 1)
    for at, found in open_at.items():
        if found:
            yield _batch({"path": [block.paths[at]], "sizes": [block.sizes[at]], "depths": [[d for d, _, _ in found]],
                          "sums": [[v for _, s, _ in found for v in s]], "ends": [[e for _, _, e in found]]}, 1)


def _peel_convs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted chunks (path, sizes, n, conv_id, ids) of conversations, peeled block by block."""
    block, path, digest = _Block(), None, None
    sizes, members, smallest = b"", 0, 0

    def close() -> None:
        block.entries.append((block.row(path, sizes), len(path) // KEY, members, smallest, 0, 0, 0, digest.hexdigest()))

    for batch in batches:
        for p, s, n, conv, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if p == path:
                members += n
                digest.update(b"," + ids.encode())
                continue
            if path is not None:
                close()
                if block.bytes > BLOCK_BYTES:
                    yield from _peel(block, False)
                    block = _Block()
            # chunks come in the order of ids
            path, sizes, members, smallest, digest = p, s, n, conv, hashlib.sha256(ids.encode())
    if path is not None:
        close()
        yield from _peel(block, False)


def _peel_open(last: bool) -> Callable:
    """Sorted open entries (path, sizes, depths, sums, ends), peeled again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block()
        for batch in batches:
            for p, s, depths, sums, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = block.row(p, s)
                block.entries += [(row, d, *sums[5 * i:5 * i + 5], ends[i]) for i, d in enumerate(depths)]
            if not last and block.bytes > BLOCK_BYTES:
                yield from _peel(block, False)
                block = _Block()
        if block.paths:
            yield from _peel(block, last)
    return run


NODE = ["key", "parent", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
OPEN = ["path", "sizes", "depths", "sums", "ends"]


def prefix_trie(convs: DataFrame) -> DataFrame:
    """The nodes of the trie over ``paths``: key, parent and the columns below.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): smallest member, turns
    from the root, the parent's smallest member (root: null), members, children, childless nodes of the subtree,
    summed (n_convs - 1) times the bytes of the last text, and the SHA-256 of the ids that end here, ascending and joined
    by commas (none: of the empty string). Conversations without turns end at the root. No conversation gives no row.
    """
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    chunks = stored(convs.groupBy("path", F.shiftright("conv_id", IDS_BITS).alias("chunk")).agg(
        F.min("sizes").alias("sizes"), F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), ids.alias("ids")), "conversations")
    sorted_ = chunks.repartitionByRange("path").sortWithinPartitions("path", "chunk").select("path", "sizes", "n", "conv_id", "ids")
    found = stored(sorted_.mapInArrow(_peel_convs, SCHEMA), "peeled")
    nodes, rest = found.where("depth IS NOT NULL").select(*NODE), found.where("path IS NOT NULL").select(*OPEN)
    weight, late = None, None
    while True:
        before, weight = weight, rest.agg(F.sum(F.length("path") + F.length("sizes") * 5)).first()[0] or 0
        last = weight <= LAST_BYTES or (before is not None and weight >= before)
        # the last block holds a bounded number of bytes, or what no further round would shrink
        dealt = rest.coalesce(1) if last else rest.repartitionByRange(max(2, weight // ROUND_BYTES), "path")
        found = stored(dealt.sortWithinPartitions("path").mapInArrow(_peel_open(last), SCHEMA), "peeled")
        whole = found.where("depth IS NOT NULL").select(*NODE)
        late = whole if late is None else late.unionByName(whole)
        if last:
            break
        rest = found.where("path IS NOT NULL").select(*OPEN)
    # a parent that was open when its children were whole is among the nodes of the later rounds
    parents = sendable(stored(late.select(F.col("key").alias("parent"), F.col("conv_id").alias("late_conv_id")), "parents"))
    known = nodes.unionByName(late).join(parents, "parent", "left")
    return known.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "late_conv_id")).drop("late_conv_id")
