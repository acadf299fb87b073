"""Jaccard join, embedding near-duplicates, exact top-k, substring de-duplication."""

import collections
import itertools
import math
import random
import re

import numpy as np
import pytest
from cases import PROSE, documents, nothing, words

from halocast.llm import jaccard, neardup, substrings, topk
from pyspark.sql import functions as F


def sets_of(rows, width=5):
    out = {}
    for i, t in rows:
        w = words(t)
        out[i] = {tuple(w[k: k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    return out


def expected(rows, num=80, den=100):
    sets = sets_of(rows)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(seed):
    """Copies with few words changed, over shared passages and a small vocabulary, so that frequent classes come into play."""
    rng = random.Random(seed)
    passages = [" ".join(rng.choice("abcdefghij") for _ in range(30)) for _ in range(6)]
    rows, n = [], 0
    for _ in range(25):
        base = " ".join(rng.choice([rng.choice(passages), " ".join(f"w{rng.randrange(400)}" for _ in range(20))]) for _ in range(rng.randint(1, 5)))
        for _ in range(rng.randint(1, 9)):
            w = base.split()
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                w = w[: rng.randint(max(1, len(w) - 8), len(w))]
            rows.append((n, " ".join(w)))
            n += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join_is_exact(spark, seed):
    rows = near_copies(seed)
    members, links = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.id: (r.n, r.component) for r in members.collect()} == expected(rows)
    sets = sets_of(rows)
    for r in links.collect():
        both = len(sets[r.a] & sets[r.b])
        assert 100 * both >= 80 * (len(sets[r.a]) + len(sets[r.b]) - both)


@pytest.mark.parametrize("block", [500, 3])
def test_whole_join_has_all_links(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = near_copies(3)
    members, links = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), whole=True)
    assert {r.id: (r.n, r.component) for r in members.collect()} == expected(rows)
    least = {}
    for i, s in sorted(sets_of(rows).items()):
        if s:
            least.setdefault(frozenset(s), i)
    want = sorted((a, b) for (x, a), (y, b) in itertools.permutations(least.items(), 2)
                  if a < b and 100 * len(x & y) >= 80 * len(x | y))
    assert sorted((r.a, r.b) for r in links.collect()) == want
    components_ = {c for _, c in expected(rows).values()}
    assert len(want) > len(least) - len(components_)  # more than a spanning set


def test_combinations_meet():
    """Pairs that link share a signature, whatever is frequent."""
    rng = np.random.default_rng(0)
    edges = jaccard._band_edges(80, 100)
    for trial in range(300):
        n = int(rng.integers(1, 120))
        union = rng.choice(1 << 62, n, replace=False).astype(np.uint64)
        lacking = n - -(-n * 80 // 100)
        a = union if lacking == 0 else np.delete(union, rng.choice(n, rng.integers(0, lacking // 2 + 1), replace=False))
        left = lacking - (n - len(a))
        b = union if left <= 0 else np.setdiff1d(union, rng.choice(a, min(left, len(a) - 1), replace=False) if len(a) > 1 else [])
        both = len(np.intersect1d(a, b))
        if 100 * both < 80 * (len(a) + len(b) - both) or not both:
            continue
        heat = {int(x): int(h) for x, h in zip(union, rng.integers(0, 40, n))}
        kinds = {x: 1 + (h > trial % 40) + (h > trial % 40 + 10) for x, h in heat.items()}
        found = []
        for own in (a, b):
            h = np.array([heat[int(x)] for x in own])
            order = np.lexsort((own, h))
            found.append(jaccard.signatures(own[order], h[order], np.array([kinds[int(x)] for x in own])[order], 80, 100, edges))
        assert len(np.intersect1d(*found)), (trial, n)


def test_centers_are_the_most_usual_nodes(spark):
    """Copies with edits of their own meet at the text they come from, and signatures of the same nodes meet once."""
    rng = random.Random(5)
    base = [f"t{i}" for i in range(120)]
    texts = [" ".join(base)]
    for k in range(60):
        w = list(base)
        for j in range(2):
            w[rng.randrange(len(w))] = f"e{k}x{j}"
        texts.append(" ".join(w))
    batch = jaccard.pa.RecordBatch.from_arrays([jaccard.pa.array(range(len(texts))), jaccard.pa.array(texts)], ["id", "text"])
    described = [r for b in jaccard._describe(5)([batch]) for r in b.to_pylist()]
    node_of = {r["id"]: r["node"] for r in described if r["bucket"] is None}
    counts = np.zeros(jaccard.BUCKETS, np.int64)
    for r in described:
        if r["bucket"] is not None:
            counts[r["bucket"]] = r["n"]
    shared = type("Shared", (), {"value": counts})
    rows = [(r["sig"], r["node"], r["usual"]) for b in jaccard._index(5, 80, 100, shared)([batch]) for r in b.to_pylist()]
    live = jaccard._centered(spark.createDataFrame(rows, "sig long, node long, usual long")).collect()
    with_base = {r.sig for r in live if r.node == node_of[0]}
    assert with_base and all(r.center == node_of[0] for r in live if r.sig in with_base)

    labelled = [(s, n, n % 3) for s, nodes in ((1, (3, 4, 5)), (2, (5, 4, 3)), (3, (3, 4)), (4, (3, 6)), (5, (3, 4, 8))) for n in nodes]
    chosen = jaccard._meeting_sets(spark.createDataFrame(labelled, "sig long, node long, label long")).collect()
    assert {r.sig for r in chosen} == {2, 3, 5}  # 1 has the nodes of 2; the nodes of 4 have one label
    assert {r.sig: r.main for r in chosen}[5] in (0, 1, 2)


def test_jaccard_awkward_rows(spark):
    docs = documents(spark)
    got = sorted((r.id if r.id is not None else -1, r.n, r.component) for r in jaccard.jaccard_join(docs)[0].collect())
    want = expected([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None])
    assert [g for g in got if g[0] >= 0 and g[0] != 12] == [(i, *want[i]) for i in sorted(want) if i != 12]
    unnamed = sets_of([(-1, r.text) for r in docs.collect() if r.doc_id is None])
    assert sum(g[0] == 12 for g in got) == 2 and (-1, len(unnamed[-1]), None) in got
    assert want[1][1] == 0 and want[2] == (0, 2) and want[6][1] == 5
    members, links = jaccard.jaccard_join(nothing(spark))
    assert members.count() == 0 and links.count() == 0


def vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 16))
    rows = []
    for k in range(400):
        v = base[k % 40] + rng.normal(size=16) * [0.02, 0.08, 0.5][k % 3]
        rows.append((k, v.tolist(), "x"))
    rows += [(400, rows[0][1], "x"), (401, rows[0][1], None), (402, None, "x"), (403, [], "x"), (404, [0.0] * 16, "x"),
             (405, [float("nan")] + [1.0] * 15, "x"), (406, [None] + [1.0] * 15, "x"), (407, [float("inf")] * 16, "x"),
             (408, [1.0, 2.0], "x"), (409, [2.0, 4.0], "x"), (410, [1e300] * 16, "x"), (411, [1e-300] * 16, "x"),
             (None, rows[0][1], "x")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, node string")


def test_near_duplicates_against_all_pairs(spark):
    df = vectors(spark)
    usable = {r.vec_id: np.array(r.embedding) for r in df.collect()
              if r.vec_id is not None and r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)}
    unit = {i: v / np.abs(v).max() for i, v in usable.items()}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    links = {i: {j for j in unit if j != i and len(unit[j]) == len(unit[i]) and unit[i] @ unit[j] >= 0.9} for i in unit}
    got = {r.id: r for r in neardup.near_duplicates(df).collect()}
    assert set(got) == set(range(412))
    for i in (402, 403, 404, 405, 406, 407):
        assert (got[i].n_links, got[i].component) == (0, i)
    assert got[400].n_links == got[0].n_links == len(links[0]) and got[401].component == got[0].component
    found, true = sum(got[i].n_links for i in links), sum(map(len, links.values()))
    assert all(got[i].n_links <= len(links[i]) for i in links) and found >= 0.95 * true
    assert got[409].n_links == 1 and got[410].component == 410 - 0 if not links[410] else True
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_crowded_cells_are_cut(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CHUNK", 16)
    rng = np.random.default_rng(5)
    centre = rng.normal(size=8)
    rows = [(k, (centre + rng.normal(size=8) * 1e-3).tolist()) for k in range(150)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {(r.n_links, r.component) for r in got} == {(149, 0)}


def test_calibration():
    lines, tables, least = neardup.calibrate(10**6, 0.9)
    assert lines > neardup.calibrate(10**4, 0.9)[0] and tables > 10 and 30 < least < 60
    assert neardup.calibrate(0, 0.9)[0] == 1


def brute_topk(rows, asks, k):
    whole = lambda x: int(x) * 256 if abs(x) >= 2**53 else math.floor(x * 256)
    good = [(i, [whole(x) for x in v]) for i, v in rows
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, qv in good:
        if asks(q):
            hits = sorted(((-int(sum(a * b for a, b in zip(qv, v))), i) for i, v in good if i != q and len(v) == len(qv)))[:k]
            out |= {(q, n + 1, i, max(1 - 2**63, min(2**63 - 1, -s))) for n, (s, i) in enumerate(hits)}
    return out


def test_exact_topk(spark, monkeypatch):
    df = vectors(spark)
    got = {tuple(r) for r in topk.exact_topk(df, F.col("vec_id") % 7 == 0, k=5).collect()}
    assert got == brute_topk([(r.vec_id, r.embedding) for r in df.collect()], lambda i: i % 7 == 0, 5)
    monkeypatch.setattr(topk, "BATCH", 16)
    assert {tuple(r) for r in topk.exact_topk(df, F.col("vec_id") % 7 == 0, k=5).collect()} == got
    assert topk.exact_topk(df.limit(0), F.col("vec_id") % 7 == 0).count() == 0
    assert topk.exact_topk(df, F.lit(False)).count() == 0


def test_index_stops_only_on_proof():
    rng = np.random.default_rng(6)
    for shape in ((3000, 24), (2000, 3)):
        v = np.floor(rng.normal(size=shape) * 40).astype(np.int64)
        v[:900] = v[5]  # many ties
        ids = rng.permutation(shape[0])
        index = topk.Index(ids, v)
        for q in range(0, shape[0], 157):
            query = v[q]
            rows, scores = index.top(query, int(ids[q]), 4)
            all_scores = v @ query
            order = [i for i in np.lexsort((ids, -all_scores)) if ids[i] != ids[q]][:4]
            assert index.ids[rows].tolist() == ids[order].tolist() and scores.tolist() == all_scores[order].tolist()


def test_topk_of_large_components(spark):
    """Components whose integers leave 28 bits are ranked exactly, beside small ones."""
    rows = [(50, [1.0]), (1, [2.0**21]), (2, [2.0**22]), (3, [-(2.0**21)]), (4, [0.5]), (100, [2.0**25]), (5, [float(2**22 - 1)])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got: dict = {}
    for r in topk.exact_topk(df, F.col("vec_id") % 50 == 0, k=3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    whole = {i: int(v[0] * 256) for i, v in rows}
    want = {q: [(i, min(2**63 - 1, s)) for i, s in sorted(((i, whole[q] * whole[i]) for i in whole if i != q), key=lambda r: (-r[1], r[0]))[:3]] for q in (50, 100)}
    assert got == want and got[50][0][0] == 100
    # scores that no long holds still rank exactly, both ways
    huge = [(50, [1e200]), (1, [1e200]), (2, [3e200]), (3, [-1e200]), (4, [-2e200]), (5, [1.0]), (6, [1e190])]
    df = spark.createDataFrame(huge, "vec_id long, embedding array<double>").repartition(3)
    got = [r.vec_id for r in topk.exact_topk(df, F.col("vec_id") == 50, k=9).orderBy("rank").collect()]
    assert got == [2, 1, 6, 5, 3, 4]


def test_substrings(spark):
    rng = random.Random(7)
    say = lambda n: " ".join(f"{rng.choice('bcdfg')}{rng.randrange(10**6)}" for _ in range(n))
    passage = say(60)
    rows = [(i, f"{say(40 + 7 * i)} {passage} {say(30)}" if i % 2 else say(150)) for i in range(20)]
    rows += [(20, say(5) + " " + passage.replace(" ", " inserted ", 1)), (21, None), (22, ""), (23, " \n"), (24, (say(3) + " ") * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = substrings.repeated_spans(df)
    got = {r.id: r for r in spans.collect()}
    text = dict(rows)
    assert set(got) == set(text)
    for i, r in got.items():
        assert bool(r.repeated) == (i < 20 and i % 2 == 1 or i == 20), i
        for s in r.repeated:
            shared = text[i][s.first:s.last]
            assert shared.strip() in text[1 if i == 20 else (i + 2) % 20 if i + 2 < 20 else 1] and len(shared.split()) >= 25
        assert bool(r.removed) == (bool(r.repeated) and i != 1)
    cleaned = {r.doc_id: r.text for r in substrings.without(df, spans).collect()}
    for i, t in cleaned.items():
        out = text[i]
        for s in reversed(got[i].removed):
            out = out[: s.first] + out[s.last:]
        assert t == out
    assert substrings.repeated_spans(nothing(spark)).count() == 0
    assert {r.id for r in substrings.repeated_spans(documents(spark)).collect()} == set(range(15))


def common_words(texts, least):
    """By brute force over all documents: the characters covered by runs of words that another, or a smaller, id has."""
    spans = {i: [m.span() for m in re.finditer(r"[^ \t\n\x0b\x0c\r]+", t or "")] for i, t in texts.items()}
    runs = {i: [(texts[i][s[k][0]: s[k + least - 1][1]], s[k][0], s[k + least - 1][1]) for k in range(len(s) - least + 1)] for i, s in spans.items()}
    held = collections.defaultdict(set)
    for i, own in runs.items():
        for run, _, _ in own:
            held[run].add(i)
    out = {}
    for i, own in runs.items():
        both = []
        for chosen in ([r for r in own if len(held[r[0]]) > 1], [r for r in own if min(held[r[0]]) < i]):
            merged = []
            for _, a, b in sorted(chosen, key=lambda r: r[1:]):
                if merged and a <= merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
                else:
                    merged.append((a, b))
            both.append(merged)
        out[i] = tuple(both)
    return out


def spans_of(rows):
    return {r.id: ([tuple(s) for s in r.repeated], [tuple(s) for s in r.removed]) for r in rows}


def test_shared_passages_of_every_length(spark):
    """40 passages of each length from 25 to 70 words, each between other words in two documents, found whole."""
    rng = random.Random(11)
    say = lambda n: " ".join(f"{rng.choice('bcdfgéß')}{rng.randrange(10**rng.randint(1, 6))}" for _ in range(n))
    texts, places = {}, {}
    for length in range(24, 71):
        for k in range(40):
            passage = say(length)
            for half in (0, 1):
                i = (length * 40 + k) * 2 + half
                before = f"{half}a{i} " + say(rng.randint(0, 12)) + f" {half}b{i} "
                texts[i] = before + passage + f" {half}c{i} " + say(rng.randint(0, 40))
                places[i] = (len(before), len(before) + len(passage))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = spans_of(substrings.repeated_spans(df).collect())
    for i, place in places.items():
        want = [place] if i >= 25 * 80 else []
        assert got[i] == (want, want if i % 2 else []), (i // 80, got[i], place)


@pytest.mark.parametrize("least", [1, 3, 25])
def test_spans_are_the_common_runs(spark, least):
    """Small vocabularies, repeats inside documents, several kinds of white space."""
    rng = random.Random(least)
    stock = [[rng.choice(["a", "b", "cc", "Ab", "é", "漢字"]) for _ in range(rng.randint(10, 60))] for _ in range(12)]
    texts = {}
    for i in range(60):
        words_ = [w for _ in range(rng.randint(0, 6)) for w in rng.choice([rng.choice(stock), [f"n{rng.randrange(300)}"] * rng.randint(1, 30)])]
        texts[i] = "".join(w + rng.choice([" "] * 60 + ["\n", "  ", "\t"]) for w in words_)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = substrings.repeated_spans(df, least)
    assert spans_of(got.collect()) == common_words(texts, least)


def test_runs_in_a_row_travel_as_one_row():
    text = " ".join(f"w{i}" for i in range(400))
    column = substrings.pa.array([text, "a " * 500])
    told = [sorted(set(substrings._Windows(*substrings.tx.utf8(column.slice(k, 1)), 25).seed.view(np.int64).tolist())) for k in range(2)]
    batch = substrings.pa.RecordBatch.from_arrays(
        [substrings.pa.array([1, 2]), column, substrings.pa.array(told, substrings.pa.list_(substrings.pa.int64()))], ["id", "text", "told"])
    rows = [r for b in substrings._candidates(25)([batch]) for r in b.to_pylist()]
    runs = [(r["id"], f, e) for r in rows for f, e in zip(r["first"], r["last"], strict=True)]
    assert len(runs) == len(set(runs)) == 400 - 24 + 500 - 24
    assert len(rows) < len(runs) / 3 and max(len(r["name"]) for r in rows) <= substrings.ROW
    assert all(r["first"] == sorted(r["first"]) and len(r["name"]) == len(r["first"]) for r in rows)


def test_rows_of_one_id_keep_their_gaps(spark):
    """Texts of one id that begin alike, with a gap between their common passages, keep the gap."""
    rng = random.Random(9)
    one, two, gap = (" ".join(f"{c}{rng.randrange(10**6)}" for _ in range(60)) for c in "xyz")
    whole = f"{one} {gap} {two}"
    df = spark.createDataFrame([(1, one), (2, whole), (2, whole), (3, two)], "doc_id long, text string")
    got = spans_of(substrings.repeated_spans(df).collect())
    assert got[2][0] == [(0, len(one)), (len(whole) - len(two), len(whole))] and got[2][1] == [(0, len(one))]


def test_seeds_and_names_follow_the_content(monkeypatch):
    text = " ".join(f"w{random.Random(3).randrange(50) + i % 37}" for i in range(900)).encode()
    data = np.frombuffer(text + b" before " + text, np.uint8)
    offsets = np.array([0, len(text), len(data)])
    runs = substrings._Windows(data, offsets, 25)
    names = runs.names(data, np.arange(len(runs.seed)))
    assert len(names) == 876 + 877 and names[:876].tolist() == names[-876:].tolist() and runs.seed[:876].tolist() == runs.seed[-876:].tolist()
    monkeypatch.setattr(substrings.tx, "WINDOW", 100)
    small = substrings._Windows(data, offsets, 25)
    assert small.seed.tolist() == runs.seed.tolist() and small.names(data, np.arange(len(names))).tolist() == names.tolist()


def test_cuts_follow_the_content():
    data = np.frombuffer((PROSE * 50).encode(), np.uint8)
    moved = np.concatenate([np.frombuffer(b"some words before ", np.uint8), data])
    a, b = substrings.cuts(data), substrings.cuts(moved) - 18
    assert set(a[a > 40]) == set(b[b > 40]) and len(a)
    old, substrings.tx.WINDOW = substrings.tx.WINDOW, 100
    try:
        assert substrings.cuts(data).tolist() == a.tolist()
    finally:
        substrings.tx.WINDOW = old
    assert collections.Counter(np.diff(a)).total()
