"""Nearest rows by both ways of meeting, against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from halocast.operators import topk


def km(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371 * math.atan2(math.sqrt(h), math.sqrt(max(0, 1 - h)))


@pytest.fixture(scope="module")
def places(spark):
    rng = random.Random(11)
    rows = [(f"P{i:04d}", rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(1500)]
    # a third of all rows in one small place, and places where cells wrap or narrow
    rows += [(f"H{i:04d}", 10 + rng.uniform(0, 1), 20 + rng.uniform(0, 1)) for i in range(900)]
    rows += [("E1", 0.0, 179.9), ("E2", 0.0, -179.9), ("N1", 89.5, 10.0), ("N2", 89.5, -170.0),
             ("S1", -90.0, 0.0), ("B", 95.0, 0.0), ("Z", 0.0, 180.0)]
    points = [("q1", 10.5, 20.5), ("q2", 0.0, 179.0), ("q3", 89.9, 100.0), ("q4", -89.0, -60.0),
              ("q5", 70.0, 0.0), ("q6", 0.0, -180.0)] + [
        (f"r{i}", rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(30)]
    return rows, points


def nearest(places, k, radius):
    rows, points = places
    limit, out = math.radians(radius) * 6371, set()
    for q, a, b in points:
        near = sorted((round(km(a, b, c, d), 6), p) for p, c, d in rows if abs(c) <= 90)
        out |= {(q, p, i + 1) for i, (x, p) in enumerate([n for n in near if n[0] <= limit][:k])}
    return out


@pytest.mark.parametrize("radius", [2.0, 7.5])
def test_nearest_profiles(spark, places, radius, monkeypatch):
    monkeypatch.setattr(topk, "CORPUS_BLOCK", 100)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    c = spark.createDataFrame(places[0], "profile_id string, lat double, lon double")
    q = spark.createDataFrame(places[1], "query_id string, lat double, lon double")
    got = topk.nearest_profiles(c, q, 5, radius).collect()
    assert {(r.query_id, r.profile_id, r["rank"]) for r in got} == nearest(places, 5, radius)


@pytest.fixture(scope="module")
def vecs(spark):
    rng = random.Random(5)
    rows = [(f"V{i:03d}", [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    rows += [(f"W{i}", rows[0][1]) for i in range(4)] + [("NONE", None)]
    asks = [(f"q{i}", rows[i * 7][1], i % 6) for i in range(40)] + [("none", None, 3)]
    return rows, asks


def distance(metric, a, b):
    dot = sum(x * y for x, y in zip(a, b))
    if metric == "l2sq":
        return sum((x - y) ** 2 for x, y in zip(a, b))
    if metric == "dot":
        return -dot
    return 1 - dot / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))


@pytest.mark.parametrize("metric", ["l2sq", "cosine", "dot"])
@pytest.mark.parametrize("size", [4096, 7])
def test_vector_topk(spark, vecs, metric, size, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_SLICE", 5)
    rows, asks = vecs
    c = spark.createDataFrame(rows, "profile_id string, embedding array<double>").repartition(5)
    q = spark.createDataFrame(asks, "query_id string, query_vector array<double>, k int")
    got = topk.vector_topk(c, q, metric, size=size).collect()
    want = set()
    for name, vector, k in asks:
        if vector is not None:
            best = sorted((round(distance(metric, v, vector), 9), p) for p, v in rows if v)[:k]
            want |= {(name, p, i + 1) for i, (_, p) in enumerate(best)}
    assert {(r.query_id, r.profile_id, r["rank"]) for r in got} == want


def test_approximate_search_finds_most_neighbours(spark):
    rng = random.Random(8)
    rows = [(f"V{i:04d}", [rng.gauss(0, 1) for _ in range(10)]) for i in range(1500)]
    rows += [(f"W{i}", rows[0][1]) for i in range(4)] + [("NONE", None), ("NAN", [float("nan")] * 10)]
    asks = [(f"q{i}", [x + rng.gauss(0, 0.3) for x in rows[i * 7][1]], i % 6) for i in range(80)] + [("none", None, 3)]
    c = spark.createDataFrame(rows, "profile_id string, embedding array<double>").repartition(3)
    q = spark.createDataFrame(asks, "query_id string, query_vector array<double>, k int")
    exact = {(r.query_id, r.profile_id, r.distance) for r in topk.vector_topk(c.where("profile_id <> 'NAN'"), q).collect()}
    near = topk.vector_topk_approx(c, q).collect()
    found = {(r.query_id, r.profile_id, r.distance) for r in near}
    assert len(exact & found) / len(exact) > 0.95
    assert all(1 <= r["rank"] <= 5 and r.similarity <= 1 for r in near)
    measured = topk.approx_candidates(c, q).groupBy("query_id").count().collect()
    assert {r["count"] for r in measured} == {64}
    assert topk.vector_topk_approx(c.where("false"), q).count() == 0 and topk.vector_topk_approx(c, q.where("false")).count() == 0


def test_codes_of_few_vectors_are_exact():
    import numpy as np
    x = np.arange(60, dtype=float).reshape(6, 10)  # the last part is shorter
    book = topk.Codebook(x)
    assert (book.decode(book.encode(x)) == x).all() and book.encode(x).shape == (6, 3)


def test_many_cells_walk_in_few_tasks(spark, places):
    """One range exchange brings both sides together; no Python group per cell."""
    from compare import plan

    c = spark.createDataFrame(places[0], "profile_id string, lat double, lon double")
    q = spark.createDataFrame(places[1], "query_id string, lat double, lon double")
    text = plan(topk.nearest_profiles(c, q, 5, 2.0))
    assert "rangepartitioning(block" in text and "MapInArrow" in text
    assert "CoGroup" not in text and "FlatMapGroups" not in text


def test_blocks_are_cut_between_arrow_batches(spark, places, monkeypatch):
    monkeypatch.setattr(topk, "WALK_ROWS", 50)
    monkeypatch.setattr(topk, "PAIRS", 300)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        c = spark.createDataFrame(places[0], "profile_id string, lat double, lon double")
        q = spark.createDataFrame(places[1], "query_id string, lat double, lon double")
        got = topk.nearest_profiles(c, q, 5, 7.5).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.query_id, r.profile_id, r["rank"]) for r in got} == nearest(places, 5, 7.5)


def test_vector_join_measures_pairs(spark):
    a = spark.createDataFrame([("x", 1, [0.0, 3.0])], "id string, label int, a array<double>")
    b = spark.createDataFrame([(1, [4.0, 0.0])], "label int, b array<double>")
    assert topk.vector_join(a, b, ["label"]).first().distance == 25.0


def brute_km(rows, points, k, radius):
    """The same as ``nearest``, for many points; of rows that share a position the first ids count."""
    import numpy as np
    limit, out = math.radians(radius) * 6371, set()
    ids = [p for p, _, _ in rows]
    c = np.radians(np.array([r[1:] for r in rows]))
    for q, a, b in points:
        p, z = math.radians(a), math.radians(b)
        h = np.sin((c[:, 0] - p) / 2) ** 2 + math.cos(p) * np.cos(c[:, 0]) * np.sin((c[:, 1] - z) / 2) ** 2
        d = np.round(2 * 6371 * np.arctan2(np.sqrt(h), np.sqrt(np.maximum(0, 1 - h))), 6)
        near = sorted((d[i], ids[i]) for i in np.flatnonzero(d <= limit))[:k]
        out |= {(q, x, n + 1) for n, (_, x) in enumerate(near)}
    return out


def test_rounds_give_the_nearest_positions(spark, places, monkeypatch):
    """Dense, sparse, polar and repeated positions settle in different rounds."""
    monkeypatch.setattr(topk, "DIRECT_PAIRS", 0)
    rows = [r for r in places[0] if abs(r[1]) <= 90] + [(f"D{i:03d}", 10.25, 20.25) for i in range(300)]
    points = places[1] + [(p, a, b) for p, a, b in rows[::5]]
    c = spark.createDataFrame(rows, "profile_id string, lat double, lon double")
    q = spark.createDataFrame(points, "query_id string, lat double, lon double")
    radii = topk._radii(c, q, 3, 30.0)
    assert len(radii) > 3 and radii[-1] == 30.0
    got = topk.nearest_profiles(c, q, 3, 30.0).collect()
    assert {(r.query_id, r.profile_id, r["rank"]) for r in got} == brute_km(rows, points, 3, 30.0)


def test_only_tables_of_cells_are_broadcast(spark, places):
    """Points and the cells they visit, many times as many rows, were once broadcast where the points looked small."""
    from compare import plan
    from halocast.session import stored

    c = stored(spark.createDataFrame(places[0], "profile_id string, lat double, lon double"), "c")
    q = stored(spark.createDataFrame(places[1], "query_id string, lat double, lon double"), "q")
    text = plan(topk.nearest_profiles(c, q, 3, 10.0))
    builds = [line for line in text.splitlines() if "BroadcastHashJoin" in line]
    assert builds and all("BuildRight" in line for line in builds)


def test_vector_searches_give_every_task_work(spark, vecs):
    """A corpus that lies in one file part was once searched by one task, whatever the number of queries."""
    from halocast.session import stored

    rows, asks = vecs
    c = stored(spark.createDataFrame(rows, "profile_id string, embedding array<double>").coalesce(1), "c")
    q = stored(spark.createDataFrame(asks, "query_id string, query_vector array<double>, k int").coalesce(1), "q")
    met = topk.scan_in_stripes(c, q)
    assert met.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert met.select(F.spark_partition_id()).distinct().count() > 1


@pytest.mark.parametrize("stripes", [1, 9])
def test_a_stripe_keeps_the_best_of_many_blocks(spark, stripes, monkeypatch):
    """Ties at the k-th place, values of very different size, and rows that are no numbers, over many small blocks."""
    monkeypatch.setattr(topk, "ROW_SLICE", 16)
    monkeypatch.setattr(topk, "STRIPE_LEAST", 1 if stripes > 1 else 4096)
    rng = random.Random(3)
    rows = [(f"V{i:03d}", [rng.gauss(0, 1) * 10 ** (i % 5 - 2) for _ in range(6)]) for i in range(200)]
    rows += [(f"T{i:02d}", rows[7][1]) for i in range(30)] + [("NAN", [float("nan")] * 6), ("HUGE", [1e20] * 6), ("ZERO", [0.0] * 6)]
    asks = [(f"q{i}", rows[i * 5][1], 1 + i % 4) for i in range(30)] + [("t", rows[7][1], 12)]
    c = spark.createDataFrame(rows, "profile_id string, embedding array<double>").repartition(1)
    q = spark.createDataFrame(asks, "query_id string, query_vector array<double>, k int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "23")
    try:
        got = {(r.query_id, r.profile_id, r["rank"]) for r in topk.vector_topk(c, q).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = set()
    for name, vector, k in asks:
        best = sorted((round(distance("l2sq", v, vector), 9), p) for p, v in rows if p != "NAN")[:k]
        want |= {(name, p, i + 1) for i, (_, p) in enumerate(best)}
    assert got == want


def test_no_vector_travels_to_the_pairs_of_the_approximate_search(spark, vecs):
    """Rows were once joined to their 64 pairs a query with both vectors; now hits alone are exchanged after the scan."""
    from compare import plan

    rows, asks = vecs
    c = spark.createDataFrame(rows, "profile_id string, embedding array<double>")
    q = spark.createDataFrame(asks, "query_id string, query_vector array<double>, k int")
    text = plan(topk.vector_topk_approx(c, q)).split("== Physical Plan ==")[1]
    above = text[:text.index("MapInArrow")]
    assert "Exchange" in above and "query_vector" not in above
