"""N-gram Jaccard join over token-combination prefixes.

Two documents link when the Jaccard similarity of their shingle sets reaches
``num / den``. The join is exact. Its filter:

* All shingles get one global order, rarest first, and a class: 1 for rare ones,
  2 and 3 for frequent and very frequent ones. Both come from document counts
  in ``2**16`` hash buckets, summed over all documents. The order only steers
  the work; any order gives the same links.
* Frequent shingles are dealt by hash into groups. A document's prefix is
  extended, in the global order, until the sum over class-1 shingles (1 each) and
  groups (members - k + 1, at least 0) passes the number of shingles that a partner
  may lack. It then indexes its rare shingles alone and every k-combination
  inside a group, k being the class. If two sets link, the shorter-reaching
  prefix holds so many shared shingles that one of these signatures is common.
* The number of groups follows the size band of a document, so that a group
  holds a few members whatever the length. Linked sizes lie in the same or
  in neighbouring bands; a document whose prefix reaches frequent shingles
  indexes its combinations for its own band and the next.

Copies are nodes of one set digest. Every node is first verified against the center of one of its
signatures, the one it shares most with. The center is a signature's most usual node, whose shingles
occur most often on average: of near copies with edits of their own that is the text they come from, which more of them
link with than with any other copy. Only nodes that this leaves in another
component than most of a signature's nodes are compared further, and only with
nodes of other components whose sizes and parity bits leave a link possible. So a group of
near copies costs a number of pairs in proportion to its size, and no link
between different components is lost. The links of this way span the components and are not the whole join;
``whole`` verifies every pair of different sets that shares a signature instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halocast.llm import text as tx
from halocast.llm.components import components
from halocast.llm.sizes import sendable
from halocast.session import stored

BUCKETS = 1 << 16
SLICE, BATCH = 1 << 20, "4m"  # bytes of texts in work at once, and in an Arrow batch
#: Expected members of a group, by class, and the smallest set that uses combinations.
MEMBERS = {2: 4, 3: 6}
LEAST_SET = 10
#: Nodes of a signature that meet in one task.
BLOCK = 500
MAPS = tuple(f"m{k}" for k in range(16))
FOLDS = tuple(f"w{k}" for k in range(8))
PARTS = 512  # hash parts in which shingles are counted
#: Centers among which a node's first partner is chosen.
CENTERS = 3


def _band_edges(num: int, den: int) -> np.ndarray:
    """Smallest size of each band: sizes that can link are at most one band apart."""
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(edges[-1] * den // num + 1)
    return np.array(edges)


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    data, offsets = tx.utf8(batch.column(1))
    for lo, hi in tx.slices(offsets, SLICE):
        words, bounds = tx.words(data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo])
        yield batch.column(0).slice(lo, hi - lo), *tx.shingles(words, bounds, width)


def _digests(code: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set: sums of mixed shingles, mixed with the size."""
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(tx.mix(code ^ np.uint64(salt)), out=total[1:], dtype=np.uint64)
        size = np.diff(bounds).astype(np.uint64)
        out.append(tx.mix(total[bounds[1:]] - total[bounds[:-1]] + size * np.uint64(salt | 1)).view(np.int64))
    return out[0], out[1]


def _parities(code: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """1024 bits of each set, as 16 integers: whether a bit's shingles are odd in number.

    Sets differ in at least as many shingles as their bits differ.
    """
    out = []
    for word in range(len(MAPS)):
        at = np.flatnonzero((code >> np.uint64(6)) & np.uint64(len(MAPS) - 1) == word)
        bits = np.append(np.uint64(1) << (code[at] & np.uint64(63)), np.uint64(0))
        first = np.searchsorted(at, bounds)
        whole = np.bitwise_xor.reduceat(bits, first)[:-1]
        out.append(np.where(first[1:] > first[:-1], whole, np.uint64(0)).view(np.int64))
    return out


def _bucket(code: np.ndarray) -> np.ndarray:
    return (code >> np.uint64(48)).astype(np.int64)


def _describe(width: int):
    """A row per document, and after them a row per bucket with the task's count in it."""
    names = ["id", "n", "node", "check", *MAPS, "bucket"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for ids, code, bounds in _sets(batch, width):
                d1, d2 = _digests(code, bounds)
                counts += np.bincount(_bucket(code), minlength=BUCKETS)
                yield pa.RecordBatch.from_arrays(
                    [ids, *map(pa.array, (np.diff(bounds), d1, d2, *_parities(code, bounds))), pa.nulls(len(ids), pa.int32())],
                    names)
        at = np.flatnonzero(counts)
        none = pa.nulls(len(at), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [none, pa.array(counts[at]), *[none] * (2 + len(MAPS)), pa.array(at.astype(np.int32))], names)
    return run


def classes(counts: np.ndarray) -> np.ndarray:
    """Class 1, 2 or 3 of each bucket, by how far it stands out of the usual noise."""
    usual = float(np.median(counts))
    noise = 6 * np.sqrt(usual) + 8
    return 1 + (counts > usual + noise).astype(np.int64) + (counts > usual + 32 * noise)


def signatures(code: np.ndarray, heat: np.ndarray, kind: np.ndarray, num: int, den: int,
               edges: np.ndarray) -> np.ndarray:
    """Signatures of one set; ``code`` in the global order, ``kind`` its classes."""
    size = len(code)
    lacking = size - -(-size * num // den) + 1
    rare = int(np.searchsorted(kind, 2))
    if rare >= lacking:
        return code[:lacking]
    band = int(np.searchsorted(edges, size, "right")) - 1
    out = [code[:rare]]
    for at in (band, band + 1):
        smallest = int(edges[max(at - 1, 0)])
        if smallest < LEAST_SET:
            out.append(code[rare:lacking])
            continue
        dealt = {k: max(1, smallest // (den * m // (den - num))) for k, m in MEMBERS.items()}
        budget, members = rare, {}
        for c, k in zip(code[rare:].tolist(), kind[rare:].tolist(), strict=True):
            if budget >= lacking:
                break
            group = members.setdefault((k, (c >> 20) % dealt[k]), [])
            group.append(c)
            budget += len(group) >= k
        for (k, group), inside in members.items():
            inside.sort()
            if len(inside) < k:
                continue
            runs = np.fromiter((c for run in combinations(inside, k) for c in run), np.uint64,
                               comb(len(inside), k) * k).reshape(-1, k)
            code_of = np.full(len(runs), at * 8 + k, np.uint64)
            for j in range(k):
                code_of = tx.mix(code_of * np.uint64(0x9E3779B97F4A7C15) + runs[:, j])
            out.append(code_of)
    return np.unique(np.concatenate(out))


def _index(width: int, num: int, den: int, shared):
    edges = _band_edges(num, den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        kinds = classes(counts)
        for batch in batches:
            for _, code, bounds in _sets(batch, width):
                if not len(code):
                    continue
                node, _ = _digests(code, bounds)
                size = np.diff(bounds)
                doc = np.repeat(np.arange(len(size)), size)
                heat = counts[_bucket(code)]
                order = np.lexsort((code, heat, doc))
                code, heat = code[order], heat[order]
                kind = kinds[_bucket(code)]
                lacking = size - -(-size * num // den) + 1
                rare = np.add.reduceat(np.append(kind == 1, False).astype(np.int64), bounds[:-1])
                plain = (size > 0) & (rare >= lacking)
                usual = _usualness(heat, bounds)
                place = np.arange(len(code)) - bounds[:-1][doc]
                take = plain[doc] & (place < lacking[doc])
                sig, owner = [code[take]], [doc[take]]
                for d in np.flatnonzero((size > 0) & ~plain):
                    own = slice(bounds[d], bounds[d + 1])
                    found = signatures(code[own], heat[own], kind[own], num, den, edges)
                    sig.append(found)
                    owner.append(np.full(len(found), d))
                sig, owner = np.concatenate(sig), np.concatenate(owner)
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(node[owner]), pa.array(usual[owner])], ["sig", "node", "usual"])
    return run


def _usualness(heat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """16 times the mean heat of each set's shingles; 0 for an empty set."""
    total = np.zeros(len(heat) + 1, np.int64)
    np.cumsum(heat, out=total[1:])
    return np.minimum(16 * (total[bounds[1:]] - total[bounds[:-1]]) // np.maximum(np.diff(bounds), 1), (1 << 42) - 1)


def _centered(index: DataFrame) -> DataFrame:
    """The rows of signatures that several nodes have, with the most usual of these nodes (of equals one by its digest) as ``center``."""
    place = F.expr("usual * 1048576L + (node & 1048575L)")
    ends = index.groupBy("sig").agg(F.max_by("node", place).alias("center"), F.min("node").alias("first"), F.max("node").alias("last")).where(
        "first <> last").select("sig", "center")
    return index.join(ends, "sig")  # with all columns, so that the index is dealt out once


def _shingle_lists(width: int):
    """Each document's shingles, and how many of them fall into each of ``PARTS`` hash parts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, code, bounds in _sets(batch, width):
                part = (code >> np.uint64(10)).astype(np.int64) % PARTS
                counts = [np.bincount(part[lo:hi], minlength=PARTS).astype(np.uint32).tobytes()
                          for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_digests(code, bounds)[0]), tx.list_column(code.view(np.int64), bounds, pa.int64()), pa.array(counts, pa.binary())],
                    ["node", "shingles", "parts"])
    return run


def _parts_allow(num: int, den: int):
    """Of pairs (a, b, x, y) those whose counts by part leave enough shared shingles possible: the sum of the smaller counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, PARTS).astype(np.int64) for i in (2, 3))
            most, total = np.minimum(x, y).sum(1), x.sum(1) + y.sum(1)
            keep = pa.array(den * most >= num * (total - most))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])
    return run


def _possible(num: int, den: int):
    """Sizes and parity bits that leave a link possible."""
    differ = " + ".join(f"bit_count({m} ^ other_{m})" for m in MAPS)
    return F.expr(f"{den}L * least(n, other_n) >= {num}L * greatest(n, other_n) AND "
                  f"{den + num}L * ({differ}) <= {den - num}L * (n + other_n)")


def _other(nodes: DataFrame) -> list:
    return [F.col(c).alias(f"other_{c}") for c in ("n", *MAPS)]


def _verified(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough.

    Only the texts of nodes in a pair become lists of shingles; their ids are sent to the texts
    while they are few, else a shuffle brings them together.
    """
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    ids = stored(nodes.join(wanted, "node", "left_semi").select(F.col("least").alias("id")), "wanted")
    lists = stored(texts.join(sendable(ids), "id", "left_semi").mapInArrow(
        _shingle_lists(width), "node long, shingles array<long>, parts binary"), "shingles")
    # counts by part are far smaller than long lists, and rule out most pairs that don't link
    side = lambda node, column, name: lists.select(F.col("node").alias(node), F.col(column).alias(name))
    likely = stored(pairs.join(side("a", "parts", "x"), "a").join(side("b", "parts", "y"), "b").select("a", "b", "x", "y").mapInArrow(
        _parts_allow(num, den), "a long, b long"), "likely")
    # the long lists travel for the nodes of likely pairs only
    compared = stored(likely.select(F.col("a").alias("node")).unionByName(likely.select(F.col("b").alias("node"))).distinct(), "compared")
    lists = lists.join(sendable(compared), "node", "left_semi")
    both = likely.join(side("a", "shingles", "x"), "a").join(side("b", "shingles", "y"), "b")
    return stored(both.select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("shared"),
                              (F.size("x") + F.size("y")).cast("long").alias("total")).where(
        f"{den}L * shared >= {num}L * (total - shared)").select("a", "b").distinct(), "verified")


def _meetings(live: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """All pairs (a, b) of nodes that share a signature and may link; signatures of many nodes are cut into blocks that meet two by two."""
    sized = stored(live.join(live.groupBy("sig").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "sig").withColumn(
        "own", F.expr("cast(pmod(xxhash64(node), blocks) as int)")), "blocks")
    left = sized.select("sig", "node", F.col("own").alias("x"), F.explode(F.expr("sequence(own, blocks - 1)")).alias("y")).join(
        nodes.select("node", "n", *MAPS), "node")
    right = sized.select("sig", F.col("node").alias("other"), F.explode(F.expr("sequence(0, own)")).alias("x"), F.col("own").alias("y")).join(
        nodes.select(F.col("node").alias("other"), *_other(nodes)), "other")
    return left.join(right, ["sig", "x", "y"]).where("x < y OR node < other").where(_possible(num, den)).select(
        F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _sizes_fit(num: int, den: int):
    return F.expr(f"{den}L * least(n, other_n) >= {num}L * greatest(n, other_n)")


def _likely(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b, ..) that sizes and parity bits leave possible; the bits are joined to pairs, not to signatures."""
    left = nodes.select(F.col("node").alias("a"), "n", *MAPS)
    right = nodes.select(F.col("node").alias("b"), *_other(nodes))
    return pairs.join(left, "a").join(right, "b").where(_possible(num, den)).select(*pairs.columns)


def _roughly_possible(num: int, den: int):
    """As ``_possible``, by half as many bits."""
    differ = " + ".join(f"bit_count({w} ^ other_{w})" for w in FOLDS)
    return F.expr(f"{den + num}L * ({differ}) <= {den - num}L * (n + other_n)") & _sizes_fit(num, den)


def _meeting_sets(labelled: DataFrame) -> DataFrame:
    """(sig, main): of the signatures with nodes of several labels one for each set of nodes, and the label most of them have.

    Signatures of the same nodes hold the same pairs. Sets are told apart by their size and sums of 128 hashed bits.
    """
    sums = {}
    for k, code in enumerate((F.xxhash64("node"), F.xxhash64("node", F.lit(1)))):
        sums |= {f"low{k}": code.bitwiseAND(F.lit(0xFFFFFFFF)), f"high{k}": F.shiftrightunsigned(code, 32)}
    parts = labelled.groupBy("sig", "label").agg(F.count("*").alias("members"), *(F.sum(c).alias(name) for name, c in sums.items()))
    several = parts.groupBy("sig").agg(
        F.max_by("label", F.struct("members", "label")).alias("main"), F.count("*").alias("parts"),
        *(F.sum(c).alias(c) for c in ("members", *sums))).where("parts > 1")
    return several.groupBy("members", *sums).agg(F.max("sig").alias("sig"), F.max_by("main", "sig").alias("main")).select("sig", "main")


def _spanning(live: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Links enough to join every component."""
    sizes = nodes.select("node", "n")
    # of the centers met in its signatures, a node is first compared with the likely one it shares most with
    near = live.where("node <> center").groupBy("center", "node").agg(F.count("*").alias("common")).join(sizes, "node").join(
        nodes.select(F.col("node").alias("center"), F.col("n").alias("other_n")), "center").where(_sizes_fit(num, den)).select(
        F.col("center").alias("a"), F.col("node").alias("b"), "common")
    best = F.row_number().over(Window.partitionBy("b").orderBy(F.col("common").desc(), F.col("a").desc()))
    near = near.withColumn("place", best).where(F.col("place") <= CENTERS).drop("place")
    stars = stored(_likely(near, nodes, num, den).groupBy("b").agg(F.max_by("a", F.struct("common", "a")).alias("a")).select("a", "b"), "stars")
    linked = _verified(stars, texts, nodes, width, num, den)

    # dealt out by signature once, for the sums of each and for the rows of those chosen
    labelled = stored(live.select("sig", "node").join(components(linked), "node", "left").withColumn(
        "label", F.coalesce("label", "node")), "labelled").repartition("sig")
    main = _meeting_sets(labelled)
    half = len(FOLDS)
    facts = nodes.select("node", "n", *[F.expr(f"{MAPS[k]} ^ {MAPS[k + half]}").alias(w) for k, w in enumerate(FOLDS)])
    mixed = stored(labelled.join(main, "sig").join(facts, "node"), "mixed")
    odd = mixed.where("label <> main").select("sig", "node", "label", "n", *FOLDS)
    rest = mixed.select("sig", F.col("node").alias("other"), F.col("label").alias("other_label"), (F.col("label") == F.col("main")).alias("other_main"),
                        *[F.col(c).alias(f"other_{c}") for c in ("n", *FOLDS)])
    # bits are tested where the rows meet, so that few pairs leave the join
    crossing = odd.join(rest, "sig").where("label <> other_label AND (other_main OR node < other)").where(
        _roughly_possible(num, den)).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    crossing = stored(crossing, "meetings").join(stars, ["a", "b"], "left_anti")
    crossing = stored(_likely(crossing, nodes, num, den), "crossing")
    return linked.unionByName(_verified(crossing, texts, nodes, width, num, den))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                 num: int = 80, den: int = 100, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """Members and links of the similarity join.

    Members: (id, n, component), one row per document: the size of its shingle set
    and the smallest id that links reach, itself included. Links: (a, b), between
    class representatives (the smallest ids of equal sets). With ``whole`` they are all links
    between different sets; without it a spanning set, true links enough to join every component.

    Null or wordless texts have no shingles and link with nothing; a text shorter than
    ``width`` words is one shingle. Equal texts are one class. Rows with a null id
    can't be named in a link: they stay, with their size and without a component. Repeated ids are
    rows of their own. An empty table gives empty results. Columns other than
    the two named ones are not read, whatever their names.
    """
    spark = docs.sparkSession
    tx.bounded_batches(spark, BATCH)
    every = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = every.where("id IS NOT NULL")
    passed = stored(texts.mapInArrow(_describe(width), "id long, n long, node long, check long, "
                                     + ", ".join(f"{m} long" for m in MAPS) + ", bucket int"), "sets")
    described = passed.where("bucket IS NULL").drop("bucket")
    counts = np.zeros(BUCKETS, np.int64)
    for row in passed.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[row.bucket] = row.n  # at most BUCKETS rows
    shared = spark.sparkContext.broadcast(counts)

    nodes = stored(described.where("n > 0").groupBy("node", "check", "n").agg(
        F.min("id").alias("least"), *(F.min(m).alias(m) for m in MAPS)), "nodes")

    # one document of each node is indexed; the index is dealt out once, for its ends and for what has several nodes
    firsts = sendable(stored(nodes.select(F.col("least").alias("id")).distinct(), "firsts"))
    index = texts.join(firsts, "id", "left_semi").mapInArrow(
        _index(width, num, den, shared), "sig long, node long, usual long").repartition("sig")
    live = stored(_centered(index), "live")
    if whole:
        links = _verified(stored(_meetings(live, nodes, num, den), "meetings"), texts, nodes, width, num, den)
    else:
        links = _spanning(live, nodes, texts, width, num, den)
    final = components(links)

    known = nodes.join(final, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = known.groupBy("label").agg(F.min("least").alias("component"))
    classes_ = known.join(least, "label").select("node", "check", "n", "component")
    members = described.join(classes_, ["node", "check", "n"]).select("id", "n", "component")
    alone = described.where("n = 0").select("id", "n", F.col("id").alias("component"))
    unnamed = every.where("id IS NULL").mapInArrow(_describe(width), passed.schema).where("bucket IS NULL").select(
        "id", "n", F.lit(None).cast("long").alias("component"))
    names = nodes.select("node", "least")
    return members.unionByName(alone).unionByName(unnamed), links.join(names.select(F.col("node").alias("a"), F.col("least").alias("x")), "a").join(
        names.select(F.col("node").alias("b"), F.col("least").alias("y")), "b").select(
        F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
