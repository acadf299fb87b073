"""Selections over the catalogue and the question log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from halocast import rules
from halocast.functions import geo, text


def bbox_filter(catalog: DataFrame, box: tuple, wrap: bool = True) -> DataFrame:
    """Profiles inside an inclusive box; rows without a position are out.

    The bounds are literals, so they reach the Parquet scan. Where the
    catalogue is stored with 10-degree cells, the cells are tested too, which
    prunes partitions.
    """
    keep = geo.box_filter(box, wrap=wrap)
    if {"cell_lat", "cell_lon"} <= set(catalog.columns):
        lat_min, lat_max, lon_min, lon_max = box
        lon_from, lon_to = int(lon_min // 10), int(lon_max // 10)
        lon_cells = F.col("cell_lon").between(lon_from, lon_to)
        if wrap and lon_min > lon_max:
            lon_cells = (F.col("cell_lon") >= lon_from) | (F.col("cell_lon") <= lon_to)
        keep = keep & F.col("cell_lat").between(int(lat_min // 10), int(lat_max // 10)) & lon_cells
    return catalog.filter(keep)


def with_cells(catalog: DataFrame) -> DataFrame:
    """10-degree cells to partition the stored catalogue by."""
    return catalog.withColumns({"cell_lat": F.floor(F.col("lat") / 10).cast("int"),
                                "cell_lon": F.floor(F.col("lon") / 10).cast("int")})


def after_months_back(as_of: str, months: Column) -> Column:
    return F.add_months(F.to_date(F.lit(as_of)), -months).cast("timestamp_ntz")


def time_matches(as_of: str, months: Column, year: Column, ts: str = "time_start") -> Column:
    """Time constraint of a question; a missing time fails any constraint."""
    test = (F.when(months.isNotNull(), F.col(ts) >= after_months_back(as_of, months))
            .when(year.isNotNull(), F.year(ts) == year).otherwise(F.lit(True)))
    return F.coalesce(test, F.lit(False))


def time_filter(catalog: DataFrame, as_of: str, months: int | None = None,
                year: int | None = None) -> DataFrame:
    """Months back from ``as_of``, else one calendar year as a range the scan can use."""
    ts = F.col("time_start")
    if months is not None:
        return catalog.filter(ts >= after_months_back(as_of, F.lit(months)))
    if year is not None:
        first = F.to_timestamp_ntz(F.lit(f"{year}-01-01"))
        return catalog.filter((ts >= first) & (ts < F.to_timestamp_ntz(F.lit(f"{year + 1}-01-01"))))
    return catalog


def season_filter(catalog: DataFrame, season: str) -> DataFrame:
    return catalog.filter(F.month("time_start").isin(*rules.SEASON_MONTHS[season]))


def keyword_search(catalog: DataFrame, word: str, k: int, nulls_first: bool = True) -> DataFrame:
    """The k newest profiles whose variables, float or id contain the word."""
    newest = F.col("time_start").desc_nulls_first() if nulls_first else (
        F.col("time_start").desc_nulls_last())
    match = text.keyword_match(word, ["variables_csv", "float_id", "profile_id"])
    return catalog.filter(match).orderBy(newest, "profile_id").limit(k)


# fixed values: facet words asked for, and marks looked for in a profile
FACETS = [
    (["temperature", "temp", "thermal"], ["temperature", "temp", "thermal"]),
    (["salinity", "salt"], ["salinity", "psal", "salt"]),
    (["oxygen", "o2"], ["oxygen", "doxy", "o2"]),
]
DEPTH_WORDS = ["deep", "1000m", "1000", "depth"]


def facet_match(query: str, searchable: Column, max_depth: Column, time: Column) -> Column:
    """First-true cascade of facets for one question text."""
    low = query.lower()
    tests = []
    for asked, marks in FACETS:
        if any(w in low for w in asked):
            tests.append(searchable.rlike("|".join(marks)))
    if "equator" in low:
        tests.append(searchable.contains("equatorial"))
    if "atlantic" in low:
        tests.append(searchable.contains("atlantic"))
    if any(w in low for w in DEPTH_WORDS):
        tests.append(max_depth >= 1000)
    if "2023" in low:
        tests.append(time.contains("2023"))
    tests.append(searchable.contains(low))
    match = F.lit(False)
    for t in tests:
        match = match | F.coalesce(t, F.lit(False))
    return match


def facet_filter(catalog: DataFrame, query: str) -> DataFrame:
    """Profiles matching the text's facets; every profile if none matches.

    Whether anything matches is a scalar subquery of one row, computed once.
    """
    from halocast.operators.stats import region_label

    if not query:
        return catalog
    time = F.coalesce(F.date_format("time_start", "yyyy-MM-dd HH:mm:ss"), F.lit("None"))
    searchable = F.lower(F.concat(
        F.col("variables_csv"), region_label(), F.col("float_id"), F.col("profile_id"), time))
    flagged = catalog.withColumn("_match", facet_match(query, searchable, F.col("max_depth"), time))
    any_match = flagged.agg(F.coalesce(F.max("_match"), F.lit(False))).scalar()
    return flagged.filter(F.col("_match") | ~any_match).drop("_match")


def variables_contain(catalog: DataFrame, variable: str | None = None,
                      group: str | None = None) -> DataFrame:
    """Profiles that hold a variable, or any variable of a parameter group."""
    if variable is not None:
        return catalog.filter(F.array_contains("variables", variable))
    names = F.array(*[F.lit(v) for v in rules.group_names(group)])
    return catalog.filter(F.arrays_overlap("variables", names))


def region_join(catalog: DataFrame, ruleset: str = "base", wrap: bool = True) -> DataFrame:
    """One row per profile and region that holds it.

    The handful of boxes become expressions of one projection; no join is
    needed, and a row is only repeated for boxes it lies in.
    """
    names = geo.matching_regions("lat", "lon", ruleset, wrap)
    return catalog.withColumn("region", F.explode(names))
