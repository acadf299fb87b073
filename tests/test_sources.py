"""Readers and writers on small files."""

import json

from halocast.operators.joins import missing_level_files
from halocast.session import work_dir
from halocast.sources import inventory, landing, sinks, store
from pyspark.sql import functions as F


def test_inventory_lists_by_extension(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("b.nc", "a.NC", "sub/c.netcdf", "d.h5", "e.txt"):
        (tmp_path / name).write_bytes(b"x" * 3)
    (tmp_path / "z.nc").write_bytes(b"")
    def names(*args, **kw):
        return [r.path.rsplit("/", 1)[-1] for r in
                inventory.file_inventory(spark, str(tmp_path), *args, **kw).collect()]
    assert sorted(names()) == ["a.NC", "b.nc", "c.netcdf", "d.h5"]  # the empty file is left out
    assert sorted(names("basic")) == ["a.NC", "b.nc", "c.netcdf"]
    assert names(first=2) == names()[:2]
    listed = inventory.file_inventory(spark, str(tmp_path))
    assert listed.columns == ["path", "length", "modified"]


def test_empty_level_file_counts_as_missing(spark, tmp_path):
    (tmp_path / "full.nc").write_bytes(b"x")
    (tmp_path / "empty.nc").write_bytes(b"")
    listed = inventory.file_inventory(spark, str(tmp_path))
    catalog = spark.createDataFrame([(n, f"file:{tmp_path}/{n}.nc") for n in ("full", "empty", "no")],
                                    "profile_id string, parquet_path string")
    gone = {r.profile_id for r in missing_level_files(catalog, listed).collect()}
    assert gone == {"empty", "no"}


def test_profile_document(spark, tmp_path):
    doc = {"profiles": [
        {"profile_id": "d1", "float_id": "1", "lat": -33.25, "lon": 101.5, "time": "2021-11-09T17:45:00",
         "n_levels": 31, "variables": ["DOXY", "PRES"], "region": "R", "max_depth": 640,
         "temperature_range": "-0.4-6.1°C"}, {"profile_id": "d2", "lat": None}],
        "metadata": {"count": 2}}
    (tmp_path / "p.json").write_text(json.dumps(doc, indent=1), encoding="utf-8")
    got = landing.read_profile_json(spark, str(tmp_path)).orderBy("profile_id").collect()
    assert [r.profile_id for r in got] == ["d1", "d2"]
    assert got[0].time.isoformat() == "2021-11-09T17:45:00" and got[0].variables == ["DOXY", "PRES"]
    assert got[1].lat is None


def test_documents_need_an_id_and_a_text(spark):
    df = spark.createDataFrame([("a", "x"), (None, "x"), ("", "x"), ("b", "  "), ("c", None)],
                               "profile_id string, summary string")
    assert [r.profile_id for r in sinks.vector_documents(df).collect()] == ["a"]


def test_levels_layout(spark):
    path = work_dir(spark, "levels")
    df = spark.createDataFrame([("F1", 1.0, None), ("F2", None, None), ("F2", None, 2.0)],
                               "float_id string, t double, s double")
    sinks.write_levels(df, path, ["t", "s"], n_buckets=4)
    back = landing.read_levels(spark, path)
    assert back.count() == 2 and "float_bucket" in back.columns


def test_errors_append_and_reports_are_kept(spark):
    path = work_dir(spark, "errors")
    rejected = spark.createDataFrame([("a.nc", "p", None, 1.0, "no_data")],
                                     "source_file string, profile_id string, lat double, "
                                     "lon double, reject_reason string")
    for _ in range(2):
        sinks.append_errors(sinks.error_rows(rejected, "2024-01-01"), path)
    got = spark.read.parquet(path).collect()
    assert len(got) == 2 and got[0].error_type == "NO_PROFILES"
    reports = spark.range(250).selectExpr("cast(id as string) report_id", "id report_time")
    kept = sinks.kept_reports(reports)
    assert kept.count() == 100 and kept.agg({"report_time": "min"}).first()[0] == 150


def test_catalogue_versions(spark):
    root = work_dir(spark, "store")
    def version(n):
        return spark.range(n).selectExpr("concat('P', id) profile_id", "1e1 lat", "2e1 lon",
                                         "cast(null as timestamp_ntz) time_start")
    sinks.publish_catalog(version(3), root, run_id=1)
    first = sinks.current_catalog(spark, root)
    sinks.publish_catalog(version(4), root, run_id=2)
    before = sinks.current_catalog(spark, root)
    sinks.publish_catalog(version(5), root, run_id=2)  # a retry
    assert sinks.current_catalog(spark, root).count() == 5
    assert before.count() == 4 and first.count() == 3  # readers opened earlier still finish
    grown = sinks.current_catalog(spark, root).drop("cell_lat", "cell_lon").unionByName(version(5))
    sinks.publish_catalog(grown, root, run_id=3)       # reads run 2, writes run 3
    assert sinks.current_catalog(spark, root).count() == 10
    assert len(sinks.live_runs(spark, root)) == 3


def test_store_over_runs_and_a_retry(spark, sf):
    from halocast.operators import joins
    from halocast.plans import registry

    root = work_dir(spark, "store")
    registry.two_runs(spark, sf, root)
    catalog = store.catalog(spark, root)
    assert catalog.count() == registry.ingest_catalog(spark, sf).count()
    for name in ("levels", "vectors"):
        held = store.owned_table(spark, root, name).select("profile_id").distinct()
        assert catalog.join(held, "profile_id", "left_anti").count() == 0
    assert store.errors(spark, root).count() == registry._run(spark, sf).rejected.count()  # the retry adds none
    assert store.reconcile_levels(spark, root).where("state <> 'present'").count() == 0
    inventory = store.level_inventory(spark, root)
    assert joins.missing_level_files(catalog, inventory).count() == 0
    missing = joins.missing_level_files(catalog, inventory.where("path <> 'run=1/float_bucket=3'"))
    assert missing.count() > 0 and {r.parquet_path for r in missing.collect()} == {"run=1/float_bucket=3"}


def test_compacted_catalogue_is_read_as_it_is(spark, sf):
    from compare import plan
    from halocast.operators.filters import bbox_filter
    from halocast.plans import registry

    root = work_dir(spark, "store")
    registry.two_runs(spark, sf, root)
    merged = {r.profile_id: r.run for r in store.catalog(spark, root).collect()}
    store.compact(spark, root)
    compacted = store.catalog(spark, root)
    assert {r.profile_id: r.run for r in compacted.collect()} == merged
    text = plan(bbox_filter(compacted, (10, 25, 50, 75)).select("profile_id"))
    assert "PartitionFilters: [isnotnull(cell_lat" in text and "Exchange" not in text
    # a newer run is merged over the compacted version; a retry of an older one is not hidden by it
    registry.ing.publish(registry._part(spark, sf, F.col("profile_key") % 500 == 4), root, "2024-01-01", run_id=2)
    late = store.catalog(spark, root)
    assert late.count() == len(merged) and {r.run for r in late.where("source_file = 'batch_4.nc'").collect()} == {2}
    registry.ing.publish(registry._part(spark, sf, (F.col("profile_key") % 2 == 0) & (F.col("profile_key") % 500 != 6)), root,
                         "2024-01-02", run_id=0)
    assert store.catalog(spark, root).where("source_file = 'batch_6.nc'").count() == 0


def test_created_at_stays_and_a_vanished_profile_goes(spark):
    changes = spark.createDataFrame(
        [("a", "f", 0, 1, "x"), ("b", "f", 0, 1, "x"), ("a", "f", 1, 5, "y"), ("c", "g", 0, 1, "x"), ("c", "h", 1, 7, "z")],
        "profile_id string, source_file string, run int, created_at int, note string").withColumns(
        {"seq": F.lit(0), "lat": F.lit(1.0), "lon": F.lit(2.0)})
    sources = spark.createDataFrame([("f", 0), ("f", 1), ("g", 0), ("h", 1)], "source_file string, run int")
    got = {r.profile_id: (r.created_at, r.note, r.run) for r in store.merge_changes(changes, sources).collect()}
    assert got == {"a": (1, "y", 1), "c": (1, "z", 1)}  # b isn't in f any more; c is in two files


def test_changes_are_merged_in_one_aggregate(spark):
    """Rows without a profile, of a file without an owner, or of a file that no run names, give nothing; changes are read once."""
    changes = spark.createDataFrame(
        [("a", "f", 0, 3, "x"), ("a", "f", 1, 5, "y"), (None, "f", 1, 1, "n"), ("d", None, 1, 1, "n"), ("e", "z", 1, 1, "n"),
         ("a", "z", 1, 2, "n")], "profile_id string, source_file string, run int, created_at int, note string").withColumns(
        {"seq": F.lit(0), "lat": F.lit(1.0), "lon": F.lit(2.0)})
    sources = spark.createDataFrame([("f", 0), ("f", 1), (None, 1)], "source_file string, run int")
    merged = store.merge_changes(changes, sources)
    assert {r.profile_id: (r.created_at, r.note, r.run) for r in merged.collect()} == {"a": (2, "y", 1)}
    assert merged._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_ledger_of_an_empty_store(spark):
    root = work_dir(spark, "store")
    assert store.ledger(spark, root).count() == 0 and store.catalog(spark, root).count() == 0


def test_pending_files(spark):
    at = "timestamp'2024-01-01'"
    listed = spark.sql(f"SELECT * FROM VALUES ('a', 1, {at}), ('b', 1, {at}), ('c', 1, {at}) AS t(path, length, modified)")
    known = spark.sql(f"SELECT * FROM VALUES ('a', 1, {at}, 0), ('b', 2, {at}, 0), ('c', 1, timestamp'2023-01-01', 0) AS t(path, length, modified, run)")
    assert {r.path for r in store.pending(listed, known).collect()} == {"b", "c"}


def test_second_ingest_reads_no_row(spark, sf, monkeypatch):
    """Where nothing is new no landed row is read, no run entered; a new file takes its drop only."""
    from halocast.plans import incremental as inc, registry

    landing_dir, root = work_dir(spark, "landing"), work_dir(spark, "store")
    registry.inc_drop(spark, sf, landing_dir, 0)
    assert inc.ingest_new(spark, landing_dir, root, "2024-01-01", 0) is not None
    monkeypatch.setattr(inc, "read_drops", None)
    assert inc.ingest_new(spark, landing_dir, root, "2024-01-02", 1) is None
    assert len(store.live(spark, root)) == 1
    assert {(r.run, r.state) for r in store.ledger(spark, root).collect()} == {(0, "loaded")}
    monkeypatch.undo()
    registry.inc_drop(spark, sf, landing_dir, 1)
    assert inc.new_drops(spark, landing_dir, root) == ["d1"]


def test_readers_of_few_columns_merge_few_columns(spark):
    """The change set of the greatest run that owns the file wins, and columns that nobody asks for aren't read."""
    rows = [("P1", "a", 0, 1, "first", 5), ("P1", "a", 1, 1, "second", 7), ("P2", "a", 0, 2, "replaced", 5), ("P3", "b", 0, 3, "stays", 6),
            ("P4", "b", 0, 4, "moves", 9), ("P4", "c", 1, 4, "moved", None), ("P5", "c", 1, 5, "early", 4), ("P5", "c", 1, 6, "late", 8),
            (None, "b", 0, 7, "nameless", 1), ("P6", "z", 0, 8, "no owner", 1)]
    path = work_dir(spark, "changes")
    spark.createDataFrame(rows, "profile_id string, source_file string, run int, seq long, variables_csv string, created_at long").withColumns(
        {"lat": F.lit(1.0), "lon": F.lit(2.0), "parquet_path": F.concat("variables_csv", F.lit("!"))}).write.parquet(path)
    sources = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("c", 1)], "source_file string, run int")
    merged = store.merge_changes(spark.read.parquet(path), sources)
    assert {(r.profile_id, r.variables_csv, r.created_at, r.run) for r in merged.collect()} == {
        ("P1", "second", 5, 1), ("P3", "stays", 6, 0), ("P4", "moved", 9, 1), ("P5", "late", 4, 1)}
    few = merged.select("profile_id", "parquet_path")
    text = few._jdf.queryExecution().executedPlan().toString()
    assert "parquet_path" in text and "variables_csv" not in text and "created_at" not in text
    assert {r.parquet_path for r in few.collect()} == {"second!", "stays!", "moved!", "late!"}


def test_files_are_counted_per_method(spark, sf):
    """What a run took from each file is counted without a sort of its verdicts."""
    from halocast.plans import ingest as ing
    from halocast.sources import fixtures as fx

    root = work_dir(spark, "store")
    path = ing.publish(ing.ingest(fx.raw_values(spark, sf), fx.raw_scalars(spark, sf), fx.raw_variables(spark, sf)), root, "2001-07-31", 0)
    got = {r.source_file: (r.n_profiles, r.n_accepted, r.extraction_method) for r in spark.read.parquet(store.part_of(path, "sources")).collect()}
    accepted = {r[0]: r[1] for r in store.catalog(spark, root).groupBy("source_file").count().collect()}
    assert {k: v[1] for k, v in got.items() if v[1]} == accepted and {v[2] for v in got.values()} == {"standard"}
    assert sum(v[0] for v in got.values()) == fx.profiles(spark, sf).count()
