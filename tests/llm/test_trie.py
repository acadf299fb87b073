"""The prefix trie against a plain trie, over one block and over many."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import types as T

from halocast.llm import trie

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
                       T.StructField("text", T.StringType()), T.StructField("path", T.StringType()), T.StructField("depth", T.StringType()),
                       T.StructField("base", T.StringType()), T.StructField("digest", T.StringType())])


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)


def brute(rows, graft=None):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(v)] for c, v in own.items()}
    members = collections.defaultdict(list)
    ends = collections.defaultdict(list)
    for c, turns in sorted(own.items()):
        if graft:
            g, m = graft
            h = zlib.crc32(str(c).encode()) % m
            base = c - (abs(c) % g) * (1 if c > 0 else -1)
            turns = own.get(base, [])[:h] + turns[h:]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        gain = (len(m) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += gain
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -10**9, len(m), kids[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in members.items())


def run(spark, rows, graft=None):
    nodes = trie.prefix_trie(trie.paths(table(spark, rows).repartition(3), graft)).collect()
    return sorted((r.conv_id, r.depth, -10**9 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves,
                   r.saved_tokens, r.ends_sha256) for r in nodes)


def conversations(seed, n, turns=7, words=3):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 4 * n), n):
        rows += [(c, t, rng.choice("ua"), rng.choice("abc"[:words]) * rng.randint(1, 2)) for t in range(rng.randint(1, turns))]
    rng.shuffle(rows)
    return rows


SMALL = [("BLOCK_BYTES", 600), ("LAST_BYTES", 2000), ("ROUND_BYTES", 1500), ("IDS_BITS", 3)]


@pytest.mark.parametrize("seed, graft, small", [(1, None, False), (2, (5, 9), False), (3, None, True), (4, (5, 9), True), (5, (3, 4), True)])
def test_equals_plain_trie(spark, monkeypatch, seed, graft, small):
    for name, value in SMALL if small else []:
        monkeypatch.setattr(trie, name, value)
    rows = conversations(seed, 150)
    assert run(spark, rows, graft) == brute(rows, graft)


def test_copies_and_depth(spark, monkeypatch):
    for name, value in SMALL:
        monkeypatch.setattr(trie, name, value)
    rows = [(c, t, "user", f"same {t}") for c in range(200) for t in range(3)]  # one end holds them all
    rows += [(1000 + c, t, "user", f"same {t}") for c in range(3) for t in range(150 + c)]  # long stems
    rows += [(2000 + c, 0, "user", f"other {c}") for c in range(100)]
    assert run(spark, rows) == brute(rows)


def test_awkward_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (2, None, "", ""), (None, 0, "user", "lost"), (3, 1, "user", "ü😀" * 1000),
            (3, 0, "user", "x" * 500_000), (-7, 0, "u", "1:ab"), (-8, 0, "u1:", "ab"), (0, 5, "a", "b"), (0, 5, "a", "b")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, (5, 9)) == brute(rows, (5, 9))


def test_nothing(spark):
    assert run(spark, []) == [] and run(spark, [(None, 0, "user", "x")]) == []
