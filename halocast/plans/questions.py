"""Questions over the vector store and the catalogue, many at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from halocast import rules
from halocast.functions import geo, text
from halocast.functions.geo import round6
from halocast.functions.text import constraints
from halocast.operators import filters
from halocast.operators.topk import nearest_vectors


def _seconds(ts: Column) -> Column:
    return F.unix_timestamp(ts.cast("timestamp")).cast("double")


def _month_mask() -> Column:
    """Bits of the months that a season word allows; null without one."""
    masks = [F.when(F.col("seasonal") & (F.col("season") == name), sum(1 << m for m in months))
             for name, months in rules.SEASON_MONTHS.items()]
    return F.coalesce(*masks)


def _hits(corpus: DataFrame, asked: DataFrame, by_place: Column, as_of: str | None = None,
          by_time: Column | None = None) -> DataFrame:
    """The k nearest vectors of each question among the rows that satisfy it.

    Rows are filtered before they are ranked, so k rows come back whenever k
    exist. ``by_place`` and ``by_time`` say whether a question's bounds count.
    """
    if by_time is None:
        since, until, mask = F.lit(None), F.lit(None), F.lit(None)
    else:
        months, year = F.when(by_time, F.col("months_back")), F.when(by_time, F.col("year_asked"))
        first = F.make_timestamp_ntz(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
        after = F.make_timestamp_ntz(year + 1, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
        since = _seconds(F.coalesce(F.when(months.isNotNull(), filters.after_months_back(as_of, months)), first))
        until = F.when(months.isNotNull(), F.lit(float("inf"))).otherwise(_seconds(after))
        mask = F.when(by_time, _month_mask())
    wanted = asked.select(
        "query_id", "query_vector", "k",
        *[F.when(by_place, F.col(c)).alias(c) for c in ("lat_min", "lat_max", "lon_min", "lon_max")],
        since.cast("double").alias("ts_from"), until.cast("double").alias("ts_to"),
        mask.cast("double").alias("months"))
    rows = corpus.select("profile_id", "embedding", "lat", "lon", _seconds(F.col("time_start")).alias("ts"),
                         F.month("time_start").cast("double").alias("month"))
    found = nearest_vectors(rows, wanted, prefilter=True)
    return found.withColumn("similarity", F.round(1 - F.col("distance"), 6) + F.lit(0.0))


def _placed(found: DataFrame, corpus: DataFrame, asked: DataFrame) -> DataFrame:
    """Hits with the position of the row and the question's constraint; hits are the small side."""
    return (found.withColumnRenamed("rank", "vector_rank")
            .join(asked.drop("query_vector", "text"), "query_id")
            .join(corpus.select("profile_id", "lat", "lon"), "profile_id"))


def _distance_to_center() -> Column:
    middle = (F.col("lat_min") + F.col("lat_max")) / 2
    return geo.haversine(middle, geo.center_lon("lon_min", "lon_max"), "lat", "lon")


def rank_by_relevance(hits: DataFrame, k: str = "k") -> DataFrame:
    """First k hits per question by relevance, vector rank breaking ties."""
    order = W.partitionBy("query_id").orderBy(F.desc_nulls_last("relevance"), "vector_rank")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= F.col(k))


def _result(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "rank", "profile_id", "similarity",
                       round6("distance_km").alias("distance_km"),
                       round6("relevance").alias("relevance"))


def _scored(hits: DataFrame, constrained: Column, scale: str) -> DataFrame:
    """Relevance is rounded before it ranks, so equal places tie in every engine."""
    km = F.when(constrained, _distance_to_center())
    return hits.withColumn("distance_km", km).withColumn(
        "relevance", F.when(constrained, F.round(geo.relevance("distance_km", scale), 6)))


def geo_search(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """The k nearest vectors inside each question's region, ranked by nearness to its centre."""
    asked = constraints(queries, "base")
    has_box = F.col("lat_min").isNotNull()
    hits = _placed(_hits(corpus, asked, has_box), corpus, asked)
    return _result(rank_by_relevance(_scored(hits, has_box, "base")))


def constrained_search(corpus: DataFrame, queries: DataFrame, as_of: str) -> DataFrame:
    """As geo_search, with time and season too, and the questions' flags honoured."""
    asked = constraints(queries, "enhanced")
    by_place = F.col("lat_min").isNotNull() & F.col("geographic_filter")
    hits = _placed(_hits(corpus, asked, by_place, as_of, F.col("temporal_filter")), corpus, asked)
    return _result(rank_by_relevance(_scored(hits, by_place, "enhanced")))


def smart_flags(queries: DataFrame) -> DataFrame:
    """Filters stay on only for questions that name a region."""
    named = text.has_region_word(F.lower("text"), "enhanced")
    return queries.withColumns({"geographic_filter": F.col("geographic_filter") & named,
                                "temporal_filter": F.col("temporal_filter") & named})


def smart_search(corpus: DataFrame, queries: DataFrame, as_of: str) -> DataFrame:
    return constrained_search(corpus, smart_flags(queries), as_of)


def prefilter_search(corpus: DataFrame, queries: DataFrame, as_of: str) -> DataFrame:
    """As constrained_search, ranked by the vectors alone."""
    asked = constraints(queries, "enhanced")
    hits = _hits(corpus, asked, F.col("geographic_filter"), as_of, F.col("temporal_filter"))
    return hits.select("query_id", "rank", "profile_id", "similarity")


def _number(c: str) -> Column:
    """Bounds without a trailing .0."""
    return F.regexp_replace(F.round(F.col(c), 4).cast("string"), r"\.0$", "")


# The sentence parts below are fixed values.
def answer_summary(queries: DataFrame, results: DataFrame, catalog: DataFrame) -> DataFrame:
    """One answer per question: counts, regions, parameters, levels and a sentence.

    A question without hits is answered too, with its bounds if it had any.
    """
    asked = constraints(queries, "base").select(
        "query_id", "text", "lat_min", "lat_max", "lon_min", "lon_max")
    rows = results.select("query_id", "profile_id").join(
        catalog.select("profile_id", "lat", "lon", "n_levels", "variables_csv"), "profile_id",
        "left")
    levels = F.when(F.col("n_levels") > 0, F.col("n_levels"))
    per_query = rows.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("total_results"),
        F.array_sort(F.collect_set(geo.classify_region(ladder="answer"))).alias("regions"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(
            text.parameter_phrases(F.coalesce("variables_csv", F.lit(""))))))).alias("parameters"),
        F.bround(F.avg(levels)).cast("bigint").alias("avg_levels"),
        F.max(levels).alias("max_levels"),
    )
    joined = asked.join(per_query, "query_id", "left")
    n = F.coalesce("total_results", F.lit(0).cast("bigint"))
    has_box = F.col("lat_min").isNotNull()
    found = F.concat(F.concat_ws(
        " ", F.concat(F.lit("Found "), n.cast("string"), F.lit(" oceanographic profiles")),
        F.when(F.size("regions") == 1, F.concat(F.lit("in the "), F.col("regions")[0]))
        .when(F.size("regions") > 1, F.concat(F.lit("across "), F.array_join("regions", ", "))),
        F.when(F.size("parameters") > 0, F.concat(F.lit("with measurements of "),
                                                  F.array_join("parameters", ", "))),
        F.when(F.col("max_levels").isNotNull(), F.concat(
            F.lit("Profiles contain an average of "), F.col("avg_levels").cast("string"),
            F.lit(" depth levels (up to "), F.col("max_levels").cast("string"), F.lit(" levels)"))),
        F.when(has_box, "All results are within your specified region"),
        F.lit("Click on map markers to see exact locations, then select a profile to view "
              "detailed depth measurements."),
    ), F.lit("."))
    nowhere = F.concat(
        F.lit("No oceanographic profiles found in region "), _number("lat_min"), F.lit("-"),
        _number("lat_max"), F.lit("°N, "), _number("lon_min"), F.lit("-"), _number("lon_max"),
        F.lit("°E matching '"), F.col("text"),
        F.lit("'. Try expanding your search area or using different search terms."))
    nothing = F.concat(
        F.lit("No profiles found matching '"), F.col("text"),
        F.lit("'. Try terms like 'temperature', 'salinity', 'equator', or 'Atlantic Ocean'."))
    return joined.select(
        "query_id", n.alias("total_results"),
        F.coalesce(F.array_join("regions", ","), F.lit("")).alias("regions"),
        F.coalesce(F.array_join("parameters", ","), F.lit("")).alias("parameters"),
        F.col("avg_levels"), F.col("max_levels"),
        F.when(n > 0, found).when(has_box, nowhere).otherwise(nothing).alias("answer"))
