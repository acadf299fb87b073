"""Hard negatives: Strassen's products and whole results against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halocast.llm import negatives

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType()),
    T.StructField("id", T.StringType()), T.StructField("rank", T.StringType()), T.StructField("asks", T.StringType()),
    T.StructField("size", T.StringType()), T.StructField("vector", T.StringType()), T.StructField("positive_score", T.StringType())])


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "x", "x", "x", "x", "x") for i, v, label in rows], SCHEMA)


def fine(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def brute(rows, asks, kp=5, kn=5):
    whole = lambda v: [math.floor(x * 256) if abs(x) < 2**53 else int(x) * 256 for x in v]
    use = [(i, whole(v), label) for i, v, label in rows if i is not None and label is not None and fine(v)]
    anchors = {}
    for i, v, label in rows:
        if i is not None and label is not None and fine(v) and asks(i):
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    out = []
    for a, (label, v) in anchors.items():
        w = whole(v)
        best = {True: {}, False: []}
        for i, u, lab in use:
            if i == a or len(u) != len(w):
                continue
            s = sum(x * y for x, y in zip(u, w))
            if lab == label:
                best[True][i] = max(s, best[True].get(i, s))
            else:
                best[False].append((i, s))
        for p, ps in sorted(best[True].items(), key=lambda r: (-r[1], r[0]))[:kp]:
            inside = {}
            for i, s in best[False]:
                if 80 * ps <= 100 * s <= 100 * ps:
                    inside[i] = max(s, inside.get(i, s))
            for rank, (i, s) in enumerate(sorted(inside.items(), key=lambda r: (-r[1], r[0]))[:kn], 1):
                out.append((a, p, rank, i, ps, s))
    return sorted(out)


def run(df, asks):
    return sorted(tuple(r) for r in negatives.hard_negatives(df, asks).collect())


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 70, 5), (64, 64, 64), (65, 33, 129), (200, 128, 77), (130, 0, 40)])
def test_strassen_equals_plain_product(shape):
    rng = np.random.default_rng(1)
    a, b = rng.integers(-10**6, 10**6, shape[:2]), rng.integers(-10**6, 10**6, shape[1:])
    assert (negatives.strassen(a, b, 8) == a @ b).all()
    big = negatives.strassen(a.astype(object) * 10**12, b.astype(object), 16)
    assert (big == a.astype(object) @ b.astype(object) * 10**12).all()


def test_sums_wrap_but_products_hold():
    # sums inside the recursion leave 64 bits; the results do not
    a = np.full((64, 64), 2**31, np.int64) * np.where(np.arange(64) % 2, 1, -1)
    b = np.full((64, 64), 2**25, np.int64)
    assert (negatives.strassen(a, b, 4) == 0).all()


def test_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(6, 12))
    rows = [(i, (centre[rng.integers(6)] + rng.normal(size=12) * 0.3).round(2).tolist(), int(rng.choice([0, 0, 1, 2]))) for i in range(700)]
    rows += [(i, v, label) for i, v, label in rows[:40]]  # repeated rows
    rows += [(i + 1000, v, 1) for i, v, label in rows[:60]]  # ties with another label
    rows += [(-100, rows[0][1], 0), (2000, [0.5] * 7, 0), (2100, [0.4] * 7, 1), (2001, [0.5] * 7, 0), (2200, [-1.0] * 12, 3)]
    rows += [(3000, None, 0), (3100, rows[0][1], None), (None, rows[0][1], 0), (3200, [], 0), (3300, [float("nan")] * 12, 0),
             (3400, [None] + [1.0] * 11, 0), (3500, [float("inf")] + [1.0] * 11, 0)]
    for name, value in (("TILE_BYTES", 6000), ("BATCH_BYTES", 900), ("BATCHES_AT_ONCE", 3), ("BATCH_ROWS", 7), ("LEAF", 4)):
        monkeypatch.setattr(negatives, name, value)
    got = run(table(spark, rows).repartition(5), F.col("vec_id") % 20 == 0)
    assert got == brute(rows, lambda i: i % 20 == 0) and len(got) > 200


def test_large_components(spark):
    rows = [(0, [1.0, 2.0**20], 0), (1, [3.0, 2.0**25], 0), (2, [1.5, 0.9 * 2**25], 1), (3, [1.0, 2.0**26], 1), (4, [7.0, 2.0**25 - 1], 1),
            (5, [1.0, 1e300], 1), (6, [0.0, -1e300], 0)]
    asks = F.col("vec_id") == 0
    with pytest.raises(Exception, match="OverflowError|too large"):
        run(table(spark, rows), asks)  # a positive heap takes -1e300 * 2**21
    got = run(table(spark, rows[:6]), asks)
    assert got == brute(rows[:6], lambda i: i == 0) and [r[3] for r in got] == [4, 2]


def test_nothing(spark):
    assert run(table(spark, []), F.lit(True)) == []
    assert run(table(spark, [(1, [1.0], 1), (2, [1.0], 2)]), F.lit(True)) == []  # no positive
    assert run(table(spark, [(1, [1.0], 1), (2, [1.0], 1)]), F.lit(True)) == []  # no negative
