"""Statistics over the catalogue, the levels and the error log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from halocast import rules
from halocast.functions import geo
from halocast.functions.geo import mean6, round6
from halocast.operators.quality import quality_tier


def _ntz(as_of: str) -> Column:
    return F.to_timestamp_ntz(F.lit(as_of))


def _n(name: str = "n") -> Column:
    return F.count(F.lit(1)).alias(name)


def count_profiles(catalog: DataFrame) -> DataFrame:
    return catalog.agg(_n("total_profiles"))


def region_stats(catalog: DataFrame, ladder: str = "stats") -> DataFrame:
    """Count and position summary per region label, most frequent first."""
    aggs = [_n("count"), mean6("lat").alias("avg_lat"), mean6("lon").alias("avg_lon")]
    if ladder == "stats":
        aggs += [F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"),
                 F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon")]
    return (
        catalog.filter("lat IS NOT NULL AND lon IS NOT NULL")
        .groupBy(geo.classify_region(ladder=ladder).alias("region")).agg(*aggs)
        .orderBy(F.desc("count"), "region")
    )


def latitude_band_stats(catalog: DataFrame) -> DataFrame:
    return (
        catalog.filter("lat IS NOT NULL")
        .groupBy(geo.classify_region(ladder="bands").alias("region")).agg(_n("count"))
        .orderBy(F.desc("count"), "region")
    )


def variable_frequency(catalog: DataFrame) -> DataFrame:
    """Profiles per variable; empty lists vanish with the explode."""
    return (
        catalog.select(F.explode("variables").alias("variable"))
        .groupBy("variable").agg(_n("count")).orderBy(F.desc("count"), "variable")
    )


def top_variables(catalog: DataFrame, n: int = 10) -> DataFrame:
    return variable_frequency(catalog).limit(n)


def date_range(catalog: DataFrame) -> DataFrame:
    return catalog.agg(F.min("time_start").alias("earliest"), F.max("time_start").alias("latest"))


def float_summary(catalog: DataFrame) -> DataFrame:
    """Per float: profiles, first and last time, mean position and levels, variables; in one pass.

    The arrays of names are made distinct as they are, without an explode that would multiply the counts; a
    float has few distinct ones, however many profiles.
    """
    return catalog.filter("variables IS NOT NULL").groupBy("float_id").agg(
        _n("total_profiles"),
        F.min("time_start").alias("first_measurement"),
        F.max("time_start").alias("last_measurement"),
        mean6("lat").alias("avg_lat"), mean6("lon").alias("avg_lon"),
        mean6("n_levels").alias("avg_levels"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("variables")))), ",").alias("all_variables"),
    ).orderBy(F.desc("first_measurement"), "float_id")


def method_stats(catalog: DataFrame) -> DataFrame:
    return (
        catalog.groupBy("extraction_method")
        .agg(_n("count"), mean6("data_quality_score").alias("avg_quality"))
        .orderBy(F.desc("count"), "extraction_method")
    )


def quality_tiers(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy(quality_tier().alias("quality_tier")).agg(_n("count"))


def error_stats(errors: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Recent errors by type with their last occurrence."""
    since = _ntz(as_of) - F.make_dt_interval(F.lit(days))
    day_ago = _ntz(as_of) - F.make_dt_interval(F.lit(1))
    return (
        errors.filter(F.col("occurred_at") > since).groupBy("error_type")
        .agg(_n("count"), F.max("occurred_at").alias("last_occurrence"),
             F.count(F.when(F.col("occurred_at") > day_ago, 1)).alias("count_24h"))
        .orderBy(F.desc("count"), "error_type")
    )


def catalog_metrics(catalog: DataFrame, as_of: str, approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return catalog.agg(
        _n("total_profiles"), mean6("n_levels").alias("avg_levels"),
        distinct("float_id").alias("unique_floats"),
        mean6("data_quality_score").alias("avg_quality"),
        F.count(F.when(F.col("created_at") > _ntz(as_of), 1)).alias("records_today"),
    )


def completeness(catalog: DataFrame) -> DataFrame:
    return catalog.agg(_n("total"), F.count("lat").alias("has_lat"), F.count("lon").alias("has_lon"),
                       F.count("time_start").alias("has_time"),
                       F.count("parquet_path").alias("has_parquet"))


def duplicate_profiles(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("profile_id").agg(_n("count")).filter("count > 1")


def orphan_ratio(catalog: DataFrame) -> DataFrame:
    with_path = F.count(F.when(F.col("parquet_path") != "", 1))
    total = F.count(F.lit(1))
    return catalog.agg(
        total.alias("total"), with_path.alias("with_parquet"),
        round6(F.when(total > 0, 1 - with_path / total).otherwise(0.0)).alias("orphan_ratio"))


def run_summary(files: DataFrame, judged: DataFrame, embedded: Column) -> DataFrame:
    """Files and profiles of a run with success rates in percent, as one row.

    ``judged`` holds every extracted profile with its ``reject_reason`` and is
    read once; ``embedded`` tells which accepted profiles became documents.
    """
    saved = F.col("reject_reason").isNull()
    per_file = judged.groupBy("source_file").agg(
        _n("extracted"), F.count(F.when(saved, 1)).alias("saved"),
        F.count(F.when(saved & embedded, 1)).alias("embedded"))
    tried = files.select("source_file").distinct().join(per_file, "source_file", "left")
    total = tried.agg(
        _n("files_attempted"),
        F.count(F.when(F.col("saved") > 0, 1)).alias("files_successful"),
        F.count(F.when(F.coalesce("saved", F.lit(0)) == 0, 1)).alias("files_failed"),
        F.coalesce(F.sum("extracted"), F.lit(0)).alias("profiles_extracted"),
        F.coalesce(F.sum("saved"), F.lit(0)).alias("profiles_saved"),
        F.coalesce(F.sum("embedded"), F.lit(0)).alias("profiles_embedded"),
    )

    def rate(part: str, whole: str) -> Column:
        return round6(F.when(F.col(whole) > 0, F.col(part) / F.col(whole) * 100))

    return total.withColumns({
        "profile_success_rate": rate("profiles_saved", "profiles_extracted"),
        "file_success_rate": rate("files_successful", "files_attempted"),
    })


def top_error_types(errors: DataFrame, n: int = 5) -> DataFrame:
    return errors.groupBy("error_type").agg(_n("count")).orderBy(
        F.desc("count"), "error_type").limit(n)


def region_label() -> Column:
    return F.when(F.col("lat").isNull() | F.col("lon").isNull(), "Unknown").otherwise(
        geo.classify_region(ladder="stats"))


def overview_metrics(catalog: DataFrame) -> DataFrame:
    """Profiles, distinct regions, distinct variables, deepest level, as one row.

    Names are made distinct before they are counted, so no task holds a set of arrays.
    """
    per_region = catalog.groupBy(region_label().alias("region")).agg(_n("n"), F.max("max_depth").alias("max_depth"))
    return per_region.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("matching_profiles"), F.count("region").alias("n_regions"),
        F.max("max_depth").alias("max_depth")).withColumn(
        "n_parameters", union_variables(catalog).agg(F.count("variable")).scalar())


def region_share(catalog: DataFrame) -> DataFrame:
    counts = catalog.groupBy(region_label().alias("region")).agg(_n("count"))
    total = F.sum("count").over(W.partitionBy())
    return counts.withColumn("percent", round6(F.col("count") * 100 / total))


def parameter_ranges(levels: DataFrame, columns: list[str]) -> DataFrame:
    """Per profile and variable: non-null count, least and greatest value."""
    wide = levels.groupBy("profile_id").agg(*[
        F.struct(F.count(c).alias("n_values"), F.min(c).alias("min_value"),
                 F.max(c).alias("max_value")).alias(c) for c in columns])
    entries = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"{c}.n_values").alias("n_values"),
                                 F.col(f"{c}.min_value").alias("min_value"),
                                 F.col(f"{c}.max_value").alias("max_value")) for c in columns])
    return wide.select("profile_id", F.inline(entries))


def depth_series(catalog: DataFrame, levels: DataFrame, n_profiles: int | None = None) -> DataFrame:
    """Depth-ordered points of all profiles, or of the first ``n_profiles``, for plotting.

    The series stays in rows under a global sort, so a profile of any length
    is never one array. Levels have the names of the store or the short ones.
    """
    chosen = catalog.select("profile_id", *(c for c in ("id",) if c in catalog.columns))
    if n_profiles is not None:
        chosen = chosen.orderBy(chosen.columns[-1]).limit(n_profiles)
    names = {"pres": "depth", "pressure": "depth", "temp": "temperature", "temperature": "temperature", "psal": "salinity",
             "salinity": "salinity", "doxy": "oxygen", "oxygen": "oxygen"}
    return (
        levels.join(chosen.select("profile_id").distinct(), "profile_id", "left_semi")
        .select("profile_id", *[F.col(c).alias(names[c]) for c in levels.columns if c in names])
        .select("profile_id", "depth", "temperature", "salinity", "oxygen")
        .orderBy("profile_id", "depth")
    )


def collection_summary(catalog: DataFrame) -> DataFrame:
    """The whole collection as one row; names and regions are made distinct before they are joined."""
    per_region = catalog.groupBy(region_label().alias("region")).agg(
        _n("n"), F.min("time_start").alias("t0"), F.max("time_start").alias("t1"),
        F.min("lat").alias("lat0"), F.max("lat").alias("lat1"),
        F.min("lon").alias("lon0"), F.max("lon").alias("lon1"),
        F.max("max_depth").alias("deepest"))
    listed = lambda c: F.array_join(F.array_sort(F.collect_list(c)), ",")
    return per_region.withColumn("names", union_variables(catalog).agg(listed("variable")).scalar()).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("profile_count"), F.coalesce(F.max("names"), F.lit("")).alias("variables_available"),
        listed("region").alias("regions_covered"),
        F.min("t0").alias("time_from"), F.max("t1").alias("time_to"),
        F.min("lat0").alias("lat_min"), F.max("lat1").alias("lat_max"),
        F.min("lon0").alias("lon_min"), F.max("lon1").alias("lon_max"),
        F.max("deepest").alias("depth_max"))


def storage_summary(inventory: DataFrame) -> DataFrame:
    """Files, megabytes and empty files; every file is counted."""
    return inventory.agg(
        _n("total_files"), F.round(F.sum("length") / 1024 / 1024, 2).alias("total_size_mb"),
        F.count(F.when(F.col("length") == 0, 1)).alias("zero_byte_files"))


def latest_profiles(catalog: DataFrame, k: int, nulls_first: bool = True) -> DataFrame:
    """The k newest profiles; missing times lead unless asked otherwise."""
    newest = F.col("time_start").desc_nulls_first() if nulls_first else (
        F.col("time_start").desc_nulls_last())
    return catalog.orderBy(newest, "profile_id").limit(k)


def distinct_regions(hits: DataFrame) -> DataFrame:
    return hits.select(geo.classify_region(ladder="answer").alias("region")).filter(
        "region IS NOT NULL").distinct()


def union_variables(catalog: DataFrame) -> DataFrame:
    return catalog.select(F.explode("variables").alias("variable")).distinct()


def distinct_sources(catalog: DataFrame) -> DataFrame:
    return catalog.select("source_file").distinct()


def error_rate_windows(errors: DataFrame, days: int = 7) -> DataFrame:
    """Errors per day and over the trailing week, with the limits they pass.

    Counts per day come first; the day spine between first and last day has one
    row per calendar day, so the ordered window runs over a short table.
    """
    daily = errors.groupBy(F.to_date("occurred_at").alias("day")).agg(_n("n"))
    span = daily.agg(F.min("day").alias("d0"), F.max("day").alias("d1"))
    spine = span.select(F.explode(F.sequence("d0", "d1")).alias("day"))
    dense = spine.join(daily, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))
    trailing = W.partitionBy().orderBy("day").rowsBetween(-(days - 1), 0)
    return dense.select(
        "day", F.col("n").alias("errors_1d"), F.sum("n").over(trailing).alias("errors_7d")
    ).withColumns({
        "warn_1d": F.col("errors_1d") > rules.ERRORS_24H_WARN,
        "high_1d": F.col("errors_1d") > rules.ERRORS_24H_HIGH,
        "recurring_7d": F.col("errors_7d") > rules.ERRORS_PER_TYPE,
    })
