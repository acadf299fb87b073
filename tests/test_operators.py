"""Operators on hand-made rows: normalisation, quality, catalogue, skew."""

import random
from datetime import datetime

import pytest
from pyspark.sql import Row, functions as F

from halocast import rules
from halocast.operators import catalog as cat, filters, joins, normalise as nm, quality, stats, textsearch, topk
from halocast.operators.ordering import dense_index
from halocast.plans import health, ingest as ing, routing
from halocast.session import stored
from halocast.sources import fixtures as fx

VALUES = "source_file string, profile_key long, var_name string, level_idx int, value double"


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


@pytest.fixture(scope="module")
def raw(spark):
    data = []
    nan, inf = float("nan"), float("inf")
    for name, values in {"TEMP": [1.0, nan, 3.0, None, nan], "PSAL": [30.0, 31.0, None, 33.0, 34.0],
                         "DOXY": [None, None], "X": [9.0], "PRES": [0.0, 10.0, inf, 30.0]}.items():
        data += [("a.nc", 0, name, i, v) for i, v in enumerate(values)]
    data += [("b.nc", 0, "temp", 0, 5.0), ("b.nc", 0, "TEMP_QC", 0, 1.0)]
    return spark.createDataFrame(data, VALUES)


@pytest.fixture(scope="module")
def variables(raw):
    return raw.groupBy("source_file", "var_name").agg(
        F.lit("float64").alias("dtype"), F.array(F.lit("N_PROF"), F.lit("N_LEVELS")).alias("dims"),
        F.array(F.lit(1), F.lit(5)).alias("shape"))


def test_first_variant_wins_and_flags_are_excluded(spark, variables):
    got = rows(nm.resolve_variables(variables), "source_file", "std_name", "var_name")
    assert ("b.nc", "TEMPERATURE", "temp") in got
    with_qc = rows(nm.resolve_variables(variables, exclude_qc=False), "source_file", "std_name",
                   "var_name")
    assert ("b.nc", "TEMPERATURE", "TEMP_QC") in with_qc
    assert len(rules.alias_rows(exclude_qc=False)) > len(rules.alias_rows())


def test_trim_and_align(raw, variables):
    trimmed = nm.trim_trailing_nulls(raw)
    sizes = {r.var_name: r["count"] for r in trimmed.filter("source_file = 'a.nc'")
             .groupBy("var_name").count().collect()}
    assert sizes == {"TEMP": 3, "PSAL": 5, "X": 1, "PRES": 4}
    aligned = nm.align_levels(nm.standard_values(raw, nm.resolve_variables(variables)))
    got = rows(aligned.filter("source_file = 'a.nc'"), "level_idx", "temperature", "salinity",
               "pressure", "oxygen")
    assert got == [(0, 1.0, 30.0, 0.0, None), (1, None, 31.0, 10.0, None),
                   (2, 3.0, None, None, None), (3, None, 33.0, 30.0, None),
                   (4, None, 34.0, None, None)]


def test_trim_array_form(spark):
    df = spark.createDataFrame([([1.0, None, 3.0, None],), ([None, None],), ([],)], "v array<double>")
    got = [r.x for r in df.select(nm.trim_array("v").alias("x")).collect()]
    assert got == [[1.0, None, 3.0], None, None]


def test_ragged_arrays_are_padded(spark):
    df = spark.createDataFrame([("p", [1.0, 2.0, None], [5.0, 6.0, None, 8.0])],
                               "id string, t array<double>, s array<double>")
    got = rows(nm.align_arrays(df, ["t", "s"]), "id", "t", "s")
    assert got == [("p", 1.0, 5.0), ("p", 2.0, 6.0), ("p", None, 8.0)]


def test_counts_and_score(spark, raw, variables):
    facts = nm.standard_facts(nm.variable_facts(raw), nm.resolve_variables(variables))
    r = nm.count_levels(facts).filter("source_file = 'a.nc'").first()
    assert (r.n_levels, r.n_pressure, r.n_longest_list) == (5, 4, 5)
    scalars = spark.createDataFrame(
        [("a.nc", 0, "LATITUDE", "0", "float64"), ("a.nc", 0, "LONGITUDE", "0.0", "float64"),
         ("a.nc", 0, "JULD", "26829.5", "float64"), ("b.nc", 0, "lat", "91", "float64"),
         ("b.nc", 0, "lon", "1", "float64"), ("c.nc", 0, "lat", "1", "float64")],
        "source_file string, profile_key long, name string, value string, dtype string")
    profiles = nm.assemble_profiles(nm.resolve_coordinates(scalars), facts)
    scores = {r.source_file: r.s for r in
              profiles.select("source_file", quality.quality_score().alias("s")).collect()}
    # a: 2 + 4 + 3 values of 3 + 5 + 4 cells, all three key names
    assert scores == {"a.nc": round(9 / 12, 6), "b.nc": round(0.5 * (0.5 + 0.5 / 3), 6), "c.nc": 0.1}
    accepted, rejected = quality.validate_profiles(profiles)
    assert [r.source_file for r in accepted.collect()] == ["a.nc"]
    assert accepted.first().time_start == datetime(2023, 6, 16, 12)
    assert rows(rejected, "source_file", "reject_reason") == [
        ("b.nc", "coordinates_out_of_range"), ("c.nc", "missing_coordinates")]
    assert accepted.count() + rejected.count() == profiles.count()


def test_measures_in_one_aggregate_equal_the_facts_summed_up(spark, raw, variables):
    """No row per variable between: the same profiles, those without a standard variable or with two files' names too."""
    more = spark.createDataFrame([("b.nc", 1, "sal", 3, 2.0), ("b.nc", 1, "sal", 3, 2.0), ("b.nc", None, "sal", 0, 1.0),
                                  ("c.nc", 0, "X", 0, 1.0)], VALUES)
    both, resolved = raw.unionByName(more), stored(nm.resolve_variables(variables.unionByName(spark.createDataFrame(
        [("b.nc", "sal", "float64", ["N_PROF"], [2])], variables.schema))), "resolved")
    scalars = spark.createDataFrame(
        [(f, k, n, "1", "float64") for f, k in (("a.nc", 0), ("b.nc", 0), ("b.nc", 1), ("c.nc", 0)) for n in ("LATITUDE", "lon")],
        "source_file string, profile_key long, name string, value string, dtype string")
    places = nm.resolve_coordinates(scalars)
    facts = nm.standard_facts(nm.variable_facts(both, largest=True), resolved)
    wanted = nm.assemble_profiles(places, facts).withColumn("raw_metadata", F.to_json("raw_metadata"))
    measured = nm.profile_measures(nm.standard_values(both, resolved))
    got = nm.assemble_measured(places, measured).withColumn("raw_metadata", F.to_json("raw_metadata"))
    assert got.columns == wanted.columns and rows(got, "*") == rows(wanted, "*")
    # the values go through one shuffle: none for the join to the few names, none for rows per variable
    assert measured._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_join_to_a_counted_table(spark, monkeypatch):
    big = spark.createDataFrame([("f", i % 5, i) for i in range(200)], "f string, k long, v long")
    small = spark.createDataFrame([("f", k, str(k)) for k in range(3)] + [(None, 1, "x")], "f string, k long, s string")
    sent = joins.counted_join(big, small, ["f", "k"], ["v"])
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 2)
    dealt = joins.counted_join(big, small, ["f", "k"], ["v"])
    assert rows(sent, "f", "k", "v", "s") == rows(dealt, "f", "k", "v", "s") and sent.count() == 120
    assert "BroadcastHashJoin" not in dealt._jdf.queryExecution().executedPlan().toString()


def test_one_dimensional_values_belong_to_every_profile(spark):
    flat = spark.createDataFrame(
        [("f", "P", 0, 1.0), ("f", "P", 1, 2.0)] + [("f", "T", i, float(i)) for i in range(4)]
        + [("g", "T", i, float(i)) for i in range(6)],
        "source_file string, var_name string, pos long, value double")
    variables = spark.createDataFrame(
        [("f", "P", "float64", ["N_LEVELS"], [2]), ("f", "T", "float64", ["N_PROF", "N_LEVELS"], [2, 2]),
         ("g", "T", "float64", ["N_LEVELS", "N_PROF"], [3, 2])],
        "source_file string, var_name string, dtype string, dims array<string>, shape array<int>")
    got = rows(nm.split_profiles(flat, variables), "source_file", "var_name", "profile_idx",
               "level_idx", "value")
    assert [g for g in got if g[:2] == ("f", "P")] == [
        ("f", "P", 0, 0, 1.0), ("f", "P", 0, 1, 2.0), ("f", "P", 1, 0, 1.0), ("f", "P", 1, 1, 2.0)]
    assert ("f", "T", 1, 0, 2.0) in got
    assert {g[2:] for g in got if g[0] == "g"} == {
        (p, l, float(l * 2 + p)) for p in range(2) for l in range(3)}


def test_scalars_and_levels_are_routed(raw):
    scalars, levels = nm.route_scalars_and_levels(raw)
    assert {(r.source_file, r.var_name) for r in scalars.collect()} == {
        ("a.nc", "X"), ("b.nc", "temp"), ("b.nc", "TEMP_QC")}
    assert scalars.count() + levels.count() == raw.count()


def test_structure_rules(spark):
    v = spark.createDataFrame(
        [("one", "TEMP", "float64", ["N_PROF", "N_LEVELS"], [1, 9]),
         ("odd", "TEMP", "float64", ["A", "B"], [4, 9])],
        "source_file string, var_name string, dtype string, dims array<string>, shape array<int>")
    def found(ruleset):
        return {r.source_file: (r.profile_dim, r.n_profiles) for r in
                nm.detect_structure(v, ruleset).collect()}
    assert found("robust") == {"one": ("N_PROF", 1), "odd": (None, 1)}
    assert found("ultra") == {"one": (None, 1), "odd": (None, 1)}
    assert found("optimized") == {"one": ("N_PROF", 1), "odd": (None, 4)}


def test_schema_evolution(spark):
    a = spark.createDataFrame([("p", 1.0)], "profile_id string, lat double")
    b = spark.createDataFrame([("q", "x")], "profile_id string, method string")
    out = nm.evolve_schema(a, b, {"lat": 0.0})
    assert rows(out, "profile_id", "lat", "method") == [("p", 1.0, None), ("q", 0.0, "x")]
    t = spark.createDataFrame([("A", "1"), ("A", "2.5"), ("B", "3"), ("some_time", "4"), ("C", "z")],
                              "name string, value string")
    types = {r.column_name: r.column_type for r in nm.infer_types(t).collect()}
    assert types == {"a": "double", "b": "bigint", "some_time": "string", "c": "string"}


def test_packed_metadata_drops_nulls(spark):
    df = spark.createDataFrame([("p", None, 1)], "profile_id string, a string, b int")
    assert nm.pack_metadata(df, ["profile_id"]).first().raw_metadata == '{"b":1}'


def test_admission(spark):
    df = spark.createDataFrame(
        [("ok", 5, datetime(2000, 1, 1), 0.0, 0.0, 10), ("few", 4, datetime(2000, 1, 1), 0.0, 0.0, 10),
         ("old", 9, datetime(1960, 1, 1), 0.0, 0.0, 10), ("big", 9, datetime(2000, 1, 1), 0.0, 0.0,
                                                         600 << 20)],
        "id string, n_levels int, time_start timestamp_ntz, lat double, lon double, file_size long")
    assert rows(nm.admission_filter(df, "2001-01-01"), "id") == [("ok",)]


# --- skew --------------------------------------------------------------------
def test_dense_index_with_a_hot_key(spark):
    rng = random.Random(3)
    data = [(0 if rng.random() < 0.4 else rng.randrange(1, 50), rng.randrange(20), i)
            for i in range(3000)]
    df = spark.createDataFrame(data, "k long, day int, n long")
    got = {r.n: r.pos for r in dense_index(df, "k", ["day", "n"], "pos").collect()}
    seen: dict = {}
    for k, day, n in sorted(data):
        assert got[n] == seen.get(k, 0)
        seen[k] = seen.get(k, 0) + 1


def test_dense_index_shuffles_the_rows_once(spark):
    """Only rows of large groups are counted by chunk; rows without a leading value take the first positions and fall away."""
    data = [(k, d, n) for n, (k, d) in enumerate([(1, 2), (1, 1), (2, None), (None, 3), (1, 1), (3, 0), (1, None)])]
    data += [(9, d % 7, 100 + d) for d in range(300)] + [(9, None, 500)]
    df = spark.createDataFrame(data, "k long, day int, n long")
    got = dense_index(df, "k", ["day", "n"], "pos")
    small = {r.n: r.pos for r in got.where("k < 9").collect()}
    assert small == {0: 3, 1: 1, 4: 2, 5: 0}
    assert sorted(r.pos for r in got.where("k = 9").collect()) == list(range(1, 301))
    light, anti, _ = got._jdf.queryExecution().optimizedPlan().toString().partition("Join LeftAnti")
    assert anti and light.count("Window [") == 1 and "Join " not in light


def test_spread_join_equals_a_plain_join(spark):
    big = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(900)], "k long, v long")
    small = spark.createDataFrame([(k, str(k)) for k in range(0, 900, 2)], "k long, s string")
    for how in ("inner", "left"):
        spread = joins.spread_join(big, small, ["k"], ["v"], how)
        assert rows(spread, "k", "v", "s") == rows(big.join(small, "k", how), "k", "v", "s")


def test_heavy_keys_are_split_by_their_share(spark):
    big = spark.createDataFrame([(0 if i % 3 == 0 else i, i) for i in range(3000)], "k long, v long")
    small = spark.createDataFrame([(k, str(k)) for k in range(0, 3000, 2)], "k long, s string")
    weights = big.groupBy("k").agg(F.count("*").alias("n"))
    heavy = {r.k: r._fanout for r in joins.heavy_keys(weights, ["k"], parts=64).collect()}
    assert set(heavy) == {0} and 40 <= heavy[0] <= 44  # a third of the rows goes to two thirds of 64 tasks
    for how in ("inner", "left"):
        spread = joins.spread_join(big, small, ["k"], ["v"], how, weights=weights)
        assert rows(spread, "k", "v", "s") == rows(big.join(small, "k", how), "k", "v", "s")
    none = big.where("false")
    assert joins.spread_join(none, small, ["k"], ["v"], weights=none.groupBy("k").agg(F.count("*").alias("n"))).count() == 0


def test_orientation_by_shape(spark):
    variables = spark.createDataFrame(
        [("a", "T", "float64", ["X", "Y"], [2, 3]), ("b", "T", "float64", ["X", "Y"], [3, 2]), ("c", "T", "float64", ["X", "Y"], [1, 4]),
         ("d", "T", "float64", ["X", "Y"], [4, 1]), ("e", "T", "float64", ["X", "Y"], [3, 5]), ("f", "T", "float64", ["X"], [2])],
        "source_file string, var_name string, dtype string, dims array<string>, shape array<int>")
    sizes = {"a": 6, "b": 6, "c": 4, "d": 4, "e": 15, "f": 2}
    flat = spark.createDataFrame([(f, "T", i, float(i)) for f, n in sizes.items() for i in range(n)],
                                 "source_file string, var_name string, pos long, value double")
    counts = spark.createDataFrame([("a", 2), ("b", 2), ("c", 1), ("d", 1), ("e", 2), ("f", 2)], "source_file string, n_profiles long")
    got: dict = {}
    for r in nm.split_profiles(flat, variables, "shape", counts).collect():
        got.setdefault((r.source_file, r.profile_idx), {})[r.level_idx] = r.value
    got = {k: [v[i] for i in sorted(v)] for k, v in got.items()}
    assert got == {
        ("a", 0): [0, 1, 2], ("a", 1): [3, 4, 5], ("b", 0): [0, 2, 4], ("b", 1): [1, 3, 5], ("c", 0): [0, 1, 2, 3], ("d", 0): [0, 1, 2, 3],
        ("e", 0): [0, 1, 2, 3, 4], ("e", 1): [0, 1, 2, 3, 4], ("f", 0): [0, 1], ("f", 1): [0, 1]}


# --- strategies --------------------------------------------------------------
def test_each_file_by_its_own_strategy(spark):
    def both(lat, lon, key=0):
        return [(key, "LATITUDE", lat), (key, "LONGITUDE", lon)]
    scalars = {"exact.nc": both("1", "2") + both("95", "0", 1), "std.nc": [(0, "lat", "3"), (0, "lon", "4")],
               "simple.nc": [(0, "lat", None), (0, "lon", "9"), (1, "lat", "5"), (1, "lon", "6"), (1, "platform_number", "F9")], "bare.nc": []}
    values = {"exact.nc": [(0, "TEMP", 1.0), (0, "CHLA", 2.0), (1, "PSAL", 3.0)], "std.nc": [(0, "sal", 1.0)],
              "simple.nc": [(0, "odd-name", 1.0), (1, "odd-name", 2.0), (1, "odd-name", 4.0)],
              "any_7.5S_3W.nc": [(4, "temp", 8.0), (4, "temp", 9.0), (5, "temp", 7.0), (4, "one", 1.0)], "min_1N_2E.nc": [(0, "q", 1.0)]}
    v, seen = [], {}
    for f, items in values.items():
        for key, name, x in items:
            level = seen[f, key, name] = seen.get((f, key, name), -1) + 1
            v.append((f, key, name, level, x))
    s = [(f, k, n, t, "str") for f, items in scalars.items() for k, n, t in items]
    names = sorted({(f, n) for f, _, n, _, _ in v})
    files = spark.createDataFrame([(f,) for f in [*values, "bare.nc"]], "source_file string")
    run = routing.ingest_routed(
        spark.createDataFrame(v, VALUES), spark.createDataFrame(s, "source_file string, profile_key long, name string, value string, dtype string"),
        spark.createDataFrame([(f, n, "float64", ["N_LEVELS"], [2]) for f, n in names],
                              "source_file string, var_name string, dtype string, dims array<string>, shape array<int>"), files)
    got = {r.profile_id: (r.extraction_method, r.lat, r.lon, r.n_levels, r.variables_csv, r.reject_reason) for r in run.judged.collect()}
    assert got == {
        "exact_profile_0": ("exact_schema", 1, 2, 1, "TEMPERATURE", None),
        "exact_profile_1": ("exact_schema", 95, 0, 1, "SALINITY", "coordinates_out_of_range"),
        "std_profile_0": ("standard", 3, 4, 1, "SALINITY", None),
        "simple_simple_profile": ("simple_variables", 5, 6, 2, "ODDNAME", None),
        "any_7.5S_3W_any_data": ("any_numeric", -7.5, -3, 2, "TEMPERATURE", None),
        "min_1N_2E_minimal": ("minimal_fallback", 1, 2, 0, "", None),
        "bare_minimal": ("minimal_fallback", None, None, 0, "", "missing_coordinates")}
    assert {(r.profile_id, r.level_idx, r.temperature, r.salinity) for r in run.levels.collect()} == {
        ("exact_profile_0", 0, 1, None), ("std_profile_0", 0, None, 1), ("any_7.5S_3W_any_data", 0, 8, None), ("any_7.5S_3W_any_data", 1, 9, None)}
    assert {(r.profile_id, r.var_name, r.level_idx, r.value) for r in run.extra_values.collect()} == {
        ("simple_simple_profile", "ODDNAME", 0, 2), ("simple_simple_profile", "ODDNAME", 1, 4)}
    found = {r.profile_id: r.raw_metadata for r in run.judged.collect()}
    assert found["simple_simple_profile"] == {"latitude": "5", "longitude": "6", "platform": "F9"}


# --- texts and health --------------------------------------------------------
def test_many_texts_at_once(spark, monkeypatch):
    c = spark.createDataFrame(
        [("P1", "F1", "TEMP,PSAL", 0.0, 0.0, 500.0, datetime(2023, 5, 1)), ("P2", "F2", "DOXY", 50.0, 100.0, 1500.0, datetime(2023, 6, 1)),
         ("P3", "F_3", None, 50.0, 100.0, None, None), ("P2", "X", "a%b", None, None, 1.0, datetime(2020, 1, 1))],
        "profile_id string, float_id string, variables_csv string, lat double, lon double, max_depth double, time_start timestamp_ntz").repartition(3)
    asks = [("temp", "temp", 5), ("again", "TEMP", 5), ("any", "", 2), ("none", None, 2), ("zero", "temp", 0), ("p", "p", 9), ("%", "%", 9),
            ("_", "_", 9), ("x", "lpf", 9), ("missing", "zzz", 3)]
    q = spark.createDataFrame(asks, "query_id string, word string, k int")
    got: dict = {}
    for r in textsearch.keyword_search_many(c, q).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.profile_id)
    assert got == {"temp": ["P1"], "again": ["P1"], "any": ["P3", "P2"], "p": ["P3", "P2", "P1", "P2"], "%": ["P2"], "_": ["P3"]}
    ask = [("s", "salinity", 3), ("d", "deep water", 3), ("y", "2023", 3), ("e", "", 2), ("z", "zzz", 2), ("n", None, 2)]
    found: dict = {}
    for r in textsearch.facet_search_many(c, spark.createDataFrame(ask, "query_id string, text string, k int")).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.profile_id, r.matched))
    assert found == {"s": [("P1", True)], "d": [("P2", True)], "y": [("P2", True), ("P1", True)],
                     "e": [("P3", False), ("P2", False)], "z": [("P3", False), ("P2", False)]}
    assert textsearch.keyword_search_many(c.where("false"), q).count() == 0
    assert textsearch.keyword_search_many(c, q.where("false")).count() == 0


def test_texts_pass_by_once_whatever_their_number(spark, monkeypatch):
    c = spark.createDataFrame(
        [(f"P{i}", f"F{i % 3}", ("TEMP", "DOXY", "PSAL")[i % 3], 0.0, 0.0, 500.0 + 100 * i, datetime(2020 + i % 4, 1, 1)) for i in range(12)],
        "profile_id string, float_id string, variables_csv string, lat double, lon double, max_depth double, time_start timestamp_ntz")
    sent = []
    monkeypatch.setattr(textsearch, "topk", lambda rows, asked, kernel: sent.append(asked) or topk.topk(rows, asked, kernel))
    texts = [("oxygen", 2), ("oxygen", 4), ("2020", 3), ("oxygen " + "x" * 500, 3), ("salt " * 300, 1), ("p1", 2), ("f1", 9)]
    asks = [(f"q{j}_{i}", t, k) for j in range(5) for i, (t, k) in enumerate(texts)]
    got: dict = {}
    for r in textsearch.facet_search_many(c, spark.createDataFrame(asks, "query_id string, text string, k int")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.profile_id, r.matched))
    assert sent[0].count() == 4  # of 35 texts the distinct ones that a row could hold
    for j in range(5):
        want = [["P7", "P10"], ["P7", "P10", "P1", "P4"], ["P0", "P4", "P8"], ["P7", "P10", "P1"], ["P11"], ["P11", "P10"], ["P7", "P10", "P1", "P4"]]
        assert [got[f"q{j}_{i}"] for i in range(7)] == [[(p, True) for p in ps] for ps in want]


def test_words_are_looked_for_once_in_rows_of_many_batches(spark, monkeypatch):
    rows = [(f"P{i}" if i % 37 else None, f"F{i % 11}", ("TEMP,PSAL", "DOXY", None, "a%b,NITRATE")[i % 4],
             datetime(2020, 1, 1 + i % 5) if i % 29 else None) for i in range(700)] * 2
    c = spark.createDataFrame(rows, "profile_id string, float_id string, variables_csv string, time_start timestamp_ntz").repartition(3)
    words = ["nitrate", "NITRATE", "p1", "p12", "f1", "", "%", "sal", None, "psal", "zzz", "p77", "1", "é", "t" * 300]
    asks = [(f"q{i}", words[i % len(words)], i % 7) for i in range(150)] + [(None, "doxy", 3), ("q1", "f2", 1), ("none", "p", None)]
    sent = []
    monkeypatch.setattr(textsearch, "topk", lambda rows, asked, scan: sent.append(asked) or topk.topk(rows, asked, scan, 5))
    monkeypatch.setattr(textsearch, "FOUND", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        found = textsearch.keyword_search_many(c, spark.createDataFrame(asks, "query_id string, word string, k int")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sent[0].count() == 15  # the distinct words of 153 questions, without the null one
    newest = sorted(((-r[3].timestamp() if r[3] else float("-inf"), r[0] or "", "\n".join(x or "" for x in (r[2], r[1], r[0])).lower(), r[0]) for r in rows),
                    key=lambda r: r[:2])
    want: dict = {}
    for name, word, k in asks:
        if word is not None and k:
            want.setdefault(name, []).extend((*r[:2], r[3], k) for r in [r for r in newest if word.lower() in r[2]][:k])
    expected = sorted((str(name), i + 1, str(r[2])) for name, held in want.items()
                      for i, r in enumerate(sorted(held, key=lambda r: r[:2])) if i < r[3])
    assert sorted((str(r.query_id), r["rank"], str(r.profile_id)) for r in found) == expected


def test_health_scans_each_table_once(spark, sf):
    from compare import plan
    from halocast.session import work_dir

    tables = {}
    for name, df in (("catalog", fx.catalog(spark, sf)), ("errors", fx.ingestion_errors(spark, sf)), ("vectors", fx.vectors(spark, sf)),
                     ("listing", spark.sql("SELECT 'store/P1.parquet' AS path, 0 AS length"))):
        path = work_dir(spark, f"health-{name}")
        df.write.parquet(path)
        tables[name] = spark.read.parquet(path)
    issues = health.health_issues(tables["catalog"], tables["errors"], tables["listing"], tables["vectors"], "2024-01-31")
    text = plan(issues)
    # the executed plan is printed once before and once after it ran, or not yet run: initial plan only
    assert text.count("FileScan parquet") == 4 and text.count("Exchange hashpartitioning") == 1
    kinds = {r.type for r in issues.collect()}
    assert {"corrupt_parquet_files", "missing_parquet_files"} <= kinds


def test_repairs_follow_the_plan(spark):
    c = spark.createDataFrame(
        [("a", 1, "x", "m", 0.8, 0.0, 0.0), ("a", 2, "x", "m", None, 0.0, 0.0), ("b", 1, None, "m", 0.8, 0.0, 0.0), ("c", 1, "y", "m", 0.6, 0.0, 0.0),
         ("d", 1, "x", "m", 0.9, 95.0, 0.0)],
        "profile_id string, seq long, parquet_path string, extraction_method string, data_quality_score double, lat double, lon double")
    gone = spark.createDataFrame([("c",)], "profile_id string")
    def plan_of(*types):
        return health.repair_plan(spark.createDataFrame([(t,) for t in types], "type string"))
    assert [(r.step, r.repair, r.wanted) for r in plan_of("duplicate_profiles").orderBy("step").collect()] == [
        (0, "mark_orphans", False), (1, "mark_missing_levels", False), (2, "latest_per_profile", True), (3, "drop_invalid_coordinates", False),
        (4, "default_quality", True)]
    every = health.repair_catalog(c, gone, plan_of("duplicate_profiles", "orphaned_records", "missing_parquet_files", "invalid_coordinates"))
    assert rows(every, "profile_id", "seq", "parquet_path", "data_quality_score") == [
        ("a", 2, "x", 0.1), ("b", 1, None, 0.2), ("c", 1, None, 0.3)]
    few = health.repair_catalog(c, gone, plan_of("duplicate_profiles"))
    assert rows(few, "profile_id", "seq", "parquet_path", "data_quality_score") == [
        ("a", 2, "x", 0.1), ("b", 1, None, 0.8), ("c", 1, "y", 0.6), ("d", 1, "x", 0.9)]


# --- catalogue ---------------------------------------------------------------
OLD = "profile_id string, float_id string, data_quality_score double, created_at int, seq long"


def test_upsert_is_idempotent_and_order_free(spark):
    old = spark.createDataFrame([("a", "F", 0.1, 1, -1), ("b", "G", 0.2, 1, -1)], OLD)
    changes = [("a", "Z", 0.5, 9, 1), ("c", "H", 0.6, 9, 2), ("a", "Z", 0.7, 9, 3)]
    want = [("a", "F", 0.7, 1, -1), ("b", "G", 0.2, 1, -1), ("c", "H", 0.6, 9, 2)]
    for order in (changes, changes[::-1]):
        batch = spark.createDataFrame(order, OLD)
        once = cat.upsert_catalog(old, batch)
        cols = ["profile_id", "float_id", "data_quality_score", "created_at", "seq"]
        assert rows(once, *cols) == want
        assert rows(cat.upsert_catalog(once, batch), *cols) == want


def test_insert_ignore_keeps_the_first_write(spark):
    old = spark.createDataFrame([("a", 0)], "profile_id string, seq long")
    batch = spark.createDataFrame([("a", 1), ("b", 3), ("b", 2)], "profile_id string, seq long")
    assert rows(cat.insert_ignore(old, batch), "profile_id", "seq") == [("a", 0), ("b", 2)]


def test_marks(spark):
    c = spark.createDataFrame(
        [("a", "x", "m", 0.8, {"k": "v"}), ("b", "", "m", 0.8, None), ("c", None, "m", None, None),
         ("d", None, "minimal_fallback", 0.9, None)],
        "profile_id string, parquet_path string, extraction_method string, "
        "data_quality_score double, raw_metadata map<string,string>")
    out = {r.profile_id: (r.data_quality_score, (r.raw_metadata or {}).get("status"))
           for r in cat.mark_orphans(c).collect()}
    # least() skips nulls
    assert out == {"a": (0.8, None), "b": (0.2, "orphaned"), "c": (0.2, "orphaned"), "d": (0.9, None)}
    gone = spark.createDataFrame([("a",)], "profile_id string")
    r = cat.mark_missing_levels(c, gone).filter("profile_id = 'a'").first()
    assert (r.parquet_path, r.data_quality_score) == (None, 0.4)
    assert cat.default_quality(c).filter("profile_id = 'c'").first().data_quality_score == 0.1


def test_prune_keeps_rows_without_a_time(spark):
    e = spark.createDataFrame([("new", datetime(2024, 1, 30)), ("old", datetime(2023, 1, 1)),
                               ("none", None)], "id string, occurred_at timestamp_ntz")
    assert rows(cat.prune_errors(e, "2024-01-31"), "id") == [("new",), ("none",)]


def test_float_summary_does_not_multiply(spark):
    c = spark.createDataFrame(
        [("F", datetime(2020, 1, 1), 1.0, 2.0, 10, ["A", "B"]), ("F", datetime(2021, 1, 1), 3.0, 4.0,
                                                               20, ["B", "C"])],
        "float_id string, time_start timestamp_ntz, lat double, lon double, n_levels long, "
        "variables array<string>")
    r = stats.float_summary(c).first()
    assert (r.total_profiles, r.avg_lat, r.avg_levels, r.all_variables) == (2, 2.0, 15.0, "A,B,C")


def test_facets(spark):
    c = spark.createDataFrame(
        [("P1", "F1", "TEMP,PSAL", 0.0, 0.0, 500.0), ("P2", "F2", "DOXY", 50.0, 100.0, 1500.0)],
        "profile_id string, float_id string, variables_csv string, lat double, lon double, "
        "max_depth double").withColumn("time_start", F.lit(datetime(2023, 5, 1)))
    def ids_for(q):
        return [r[0] for r in rows(filters.facet_filter(c, q), "profile_id")]
    assert ids_for("salinity") == ["P1"] and ids_for("deep water") == ["P2"]
    assert ids_for("2023") == ["P1", "P2"] and ids_for("f2") == ["P2"]
    assert ids_for("zzz") == ["P1", "P2"] and ids_for("") == ["P1", "P2"]


def test_box_filter_uses_stored_cells(spark):
    c = filters.with_cells(spark.createDataFrame(
        [(i, float(i % 180 - 90), float(i % 360 - 180)) for i in range(0, 3600, 7)],
        "id long, lat double, lon double"))
    for box in ((-60, 70, 120, -70), (10, 25, 50, 75), (-23.5, 23.5, -180, 180)):
        assert rows(filters.bbox_filter(c, box), "id") == rows(
            filters.bbox_filter(c.drop("cell_lat", "cell_lon"), box), "id")


def test_fallback_rejects_instead_of_inventing(spark):
    values = spark.createDataFrame([("u.nc", 0, "q", 0, 1.0), ("u.nc", 0, "q", 1, 2.0)], VALUES)
    scalars = spark.createDataFrame([], "source_file string, profile_key long, name string, "
                                        "value string, dtype string")
    files = spark.createDataFrame([("u.nc",), ("v_1N_2E.nc",)], "source_file string")
    got = {r.source_file: r for r in ing.fallback_extract(values, scalars, files).collect()}
    assert got["u.nc"].accepted is False and got["u.nc"].lat is None
    assert (got["v_1N_2E.nc"].lat, got["v_1N_2E.nc"].lon, got["v_1N_2E.nc"].accepted) == (1, 2, True)
