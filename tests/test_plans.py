"""What the physical plans must and must not hold."""

import pytest

import __spark_entry__ as entry
from compare import plan
from halocast import session
from halocast.operators import catalog as cat, filters, stats
from halocast.sources import fixtures as fx, sinks

QUERIES = entry.queries()


@pytest.fixture(scope="module")
def stored_catalog(spark, sf):
    path = session.work_dir(spark, "catalog")
    sinks.write_catalog_version(fx.catalog(spark, sf), path)
    return spark.read.parquet(path)


def test_box_and_time_reach_the_scan(spark, stored_catalog):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = plan(filters.bbox_filter(stored_catalog, (10, 25, 50, 75)).select("profile_id"))
    assert "PartitionFilters: [isnotnull(cell_lat" in text
    assert "GreaterThanOrEqual(lat,10.0)" in text and "LessThanOrEqual(lon,75.0)" in text
    text = plan(filters.time_filter(stored_catalog, "2001-07-31", year=2000).select("profile_id"))
    assert "GreaterThanOrEqual(time_start" in text and "LessThan(time_start" in text
    assert "variables" not in text[text.index("ReadSchema"):]


def test_bands_prune_files(spark, stored_catalog):
    kept = filters.bbox_filter(stored_catalog, (10, 15, 50, 75))
    assert {r.cell_lat for r in kept.select("cell_lat").distinct().collect()} <= {1}


def test_columns_are_pruned(spark, sf):
    text = plan(stats.region_stats(fx.profiles(spark, sf)))
    assert "ReadSchema: struct<o_orderkey:bigint>" in text


def test_latest_row_is_cut_on_both_sides_of_the_shuffle(spark, sf):
    text = plan(cat.latest_per_profile(fx.catalog_batches(spark, sf)))
    assert text.count("WindowGroupLimit") == 2


def test_topk_reports_do_not_sort_everything(spark, sf):
    assert "TakeOrderedAndProject" in plan(stats.latest_profiles(fx.profiles(spark, sf), 5))


def test_aggregates_are_partial_before_the_shuffle(spark, sf):
    text = plan(QUERIES["quality_score"](spark, sf))
    assert "partial_max" in text and "partial_count" in text and "partial_sum" in text


class FakeContext:
    def __init__(self, master):
        self.master = master


class FakeSession:
    def __init__(self, master, **conf):
        self.sparkContext, self._conf = FakeContext(master), conf
        self.conf = self

    def get(self, key, default=None):
        return self._conf.get(key, default)

    def set(self, key, value):
        self._conf[key] = value


def test_work_folder_follows_the_session():
    shared = FakeSession("spark://host:7077", **{"spark.checkpoint.dir": "s3://bucket/ck/"})
    assert session.work_dir(shared, "x").startswith("s3://bucket/ck/x-")
    with pytest.raises(ValueError):
        session.work_dir(FakeSession("spark://host:7077"), "x")
    local = FakeSession("local[2]")
    assert session.work_dir(local, "x").startswith(local.get("spark.checkpoint.dir"))
