"""Composite searches against the same rules in plain Python."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from halocast.plans import questions

CORPUS = [
    ("P1", [1.0, 0.0], 17.0, 60.0, datetime(2000, 5, 1)),
    ("P2", [0.9, 0.1], 40.0, -30.0, datetime(2001, 6, 1)),
    ("P3", [0.8, 0.2], 12.0, 70.0, None),
    ("P4", [0.0, 1.0], 18.0, 62.0, datetime(1999, 1, 1)),
    ("P5", [0.7, 0.3], None, None, datetime(2000, 7, 1)),
    ("P6", [-1.0, 0.0], 17.5, 62.5, datetime(2000, 8, 1)),
]
LOG = "query_id string, text string, k int, geographic_filter boolean, temporal_filter boolean, " \
      "query_vector array<double>"


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(CORPUS, "profile_id string, embedding array<double>, lat double, "
                                         "lon double, time_start timestamp_ntz")


def ask(spark, *rows):
    return spark.createDataFrame([(*r, [1.0, 0.0]) for r in rows], LOG)


def hits(df):
    out: dict = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.profile_id)
    return out


def test_geo_search_filters_before_the_search(spark, corpus):
    q = ask(spark, ("near", "Arabian Sea", 1, True, True), ("all", "anything", 2, True, True),
            ("wide", "arabian sea", 2, True, True))
    # the k nearest vectors in the region, ranked by nearness to its centre
    assert hits(questions.geo_search(corpus, q)) == {
        "near": ["P1"], "all": ["P1", "P2"], "wide": ["P1", "P3"]}


def test_flags_and_time_are_honoured(spark, corpus):
    q = ask(spark, ("both", "arabian sea 2000", 2, True, True), ("time", "arabian sea 2000", 3, False, True),
            ("place", "arabian sea 2000", 2, True, False), ("none", "arabian sea 2000", 2, False, False))
    got = hits(questions.constrained_search(corpus, q, "2001-07-31"))
    # P3 has no time, P4 another year
    assert got == {"both": ["P6", "P1"], "time": ["P1", "P5", "P6"], "place": ["P1", "P3"],
                   "none": ["P1", "P2"]}


def test_season_counts(spark, corpus):
    q = ask(spark, ("summer", "profiles in summer", 5, True, True), ("off", "profiles in summer", 2, True, False),
            ("year", "summer 2000", 5, True, True), ("monsoon", "monsoon profiles", 2, True, True))
    got = hits(questions.constrained_search(corpus, q, "2001-07-31"))
    # June to August; a year goes before a season; monsoon has no months
    assert got == {"summer": ["P2", "P5", "P6"], "off": ["P1", "P2"], "year": ["P1", "P5", "P6"],
                   "monsoon": ["P1", "P2"]}


def test_smart_search_drops_filters_without_a_region(spark, corpus):
    q = ask(spark, ("plain", "profiles of 2000", 2, True, True), ("named", "arabian sea 2000", 2, True, True))
    got = hits(questions.smart_search(corpus, q, "2001-07-31"))
    assert got == {"plain": ["P1", "P2"], "named": ["P6", "P1"]}


def test_prefilter_always_fills_up(spark, corpus):
    q = ask(spark, ("q", "arabian sea in 2000", 2, True, True), ("m", "past 6 months", 3, True, True))
    assert hits(questions.prefilter_search(corpus, q, "2001-07-31")) == {"q": ["P1", "P6"], "m": ["P2"]}


def test_every_question_is_answered(spark, corpus):
    q = ask(spark, ("hit", "Arabian Sea", 2, True, True), ("miss", "mediterranean", 1, True, True))
    catalog = corpus.withColumns({"n_levels": F.lit(5), "variables_csv": F.lit("TEMP,PSAL")})
    got = {r.query_id: r for r in
           questions.answer_summary(q, questions.geo_search(corpus, q), catalog).collect()}
    assert got["hit"].total_results == 2 and got["hit"].parameters == "salinity,temperature"
    assert got["hit"].answer.startswith("Found 2 oceanographic profiles in the Arabian Sea with "
                                        "measurements of salinity, temperature")
    assert got["miss"].answer.startswith("No oceanographic profiles found in region 30-46°N, -6-42°E")
