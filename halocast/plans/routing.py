"""Ingest with a strategy per file, chosen from facts before any level is read.

The raw values are read once for the facts (one row per file, profile and variable) and once for the
levels. What each file's strategy takes is a reading plan, one row per file and variable, and the levels are
one join of the values with that plan, whatever the strategies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from halocast.functions import geo, identifiers as ids
from halocast.functions.times import normalise_time
from halocast.operators import normalise as nm
from halocast.operators.joins import counted_join, spread_join
from halocast.operators.quality import reject_reason
from halocast.plans.ingest import EXACT_VARIABLES, STRATEGIES, Ingested, judge
from halocast import rules
from halocast.session import stored

EXACT, STANDARD, SIMPLE, NUMERIC, MINIMAL = range(len(STRATEGIES))
VARIANTS = sorted({v for kind, _, v, _ in rules.alias_rows() if kind == "variable"})


def _exact_places(raw_scalars: DataFrame) -> DataFrame:
    """Positions of profiles under the two names the exact strategy knows."""
    def named(name: str) -> Column:
        return F.max(F.when(F.col("name") == name, F.col("value")))

    return raw_scalars.where(F.col("name").isin("LATITUDE", "LONGITUDE")).groupBy(*nm.PROFILE_KEYS).agg(
        named("LATITUDE").alias("exact_lat"), named("LONGITUDE").alias("exact_lon"))


def choose(facts: DataFrame, coordinates: DataFrame, files: DataFrame) -> DataFrame:
    """(source_file, priority, first): the first strategy that yields a placed profile with data.

    ``coordinates`` holds a row per profile with the texts of its coordinates and the exact ones; ``first`` is the row of
    the first profile with a position, for the strategies that take a file as one profile.
    """
    held = facts.where("n_values > 0")
    per_profile = held.groupBy(*nm.PROFILE_KEYS).agg(
        F.max(F.col("var_name").isin(EXACT_VARIABLES)).alias("exact"), F.max(F.col("var_name").isin(VARIANTS)).alias("known"))
    number = ids.clean_number
    lat, lon = number("latitude"), number("longitude")
    placed = coordinates.join(per_profile, nm.PROFILE_KEYS, "left")
    complete = F.when(lat.isNotNull() & lon.isNotNull(), F.col("profile_key"))
    exact_fine = geo.valid_coordinates(number("exact_lat"), number("exact_lon"))
    yields = placed.groupBy("source_file").agg(
        F.max(F.coalesce(F.col("exact"), F.lit(False)) & F.coalesce(exact_fine, F.lit(False))).alias("exact"),
        F.max(F.coalesce(F.col("known"), F.lit(False)) & F.coalesce(geo.valid_coordinates(lat, lon), F.lit(False))).alias("known"),
        F.min_by(F.struct("latitude", "longitude", "time", "time_dtype", "platform"), complete).alias("first"))
    longest = held.groupBy("source_file").agg(F.max("n_trimmed").alias("longest"))
    both = files.select("source_file").distinct().join(yields, "source_file", "left").join(longest, "source_file", "left")
    name_lat, name_lon = ids.coords_from_filename("source_file")
    first_fine = F.coalesce(geo.valid_coordinates(number("first.latitude"), number("first.longitude")), F.lit(False))
    name_fine = F.coalesce(geo.valid_coordinates(name_lat, name_lon), F.lit(False))
    priority = (F.when(F.col("exact"), EXACT).when(F.col("known"), STANDARD)
                .when(first_fine & F.col("longest").isNotNull(), SIMPLE)
                .when(name_fine & (F.col("longest") > 1), NUMERIC).otherwise(MINIMAL))
    return both.select("source_file", priority.alias("priority"), "first")


def reading_plan(facts: DataFrame, raw_variables: DataFrame, chosen: DataFrame) -> DataFrame:
    """(source_file, var_name, std_name, only_key): the variables that each file's strategy takes.

    ``only_key`` is null where all profiles are read. A file taken as one profile reads each variable from
    the profile that holds it longest, under the name of highest standing where several mean the same.
    """
    per_file = facts.where("n_values > 0").groupBy("source_file", "var_name").agg(
        F.max("n_trimmed").alias("longest"),
        F.min_by("profile_key", F.struct(-F.col("n_trimmed"), F.col("profile_key"))).alias("key"))
    routed = per_file.join(chosen.select("source_file", "priority"), "source_file")
    exact = routed.where((F.col("priority") == EXACT) & F.col("var_name").isin(EXACT_VARIABLES)).select(
        "source_file", "var_name", ids.map_standard_name("var_name").alias("std_name"), F.lit(None).cast("bigint").alias("only_key"))
    standard = nm.resolve_variables(raw_variables).join(chosen.where(F.col("priority") == STANDARD).select("source_file"), "source_file", "left_semi") \
        .select("source_file", "var_name", "std_name", F.lit(None).cast("bigint").alias("only_key"))
    place = F.array_position(F.array(*[F.lit(v) for v in VARIANTS]), F.col("var_name"))
    whole = routed.where((F.col("priority") == SIMPLE) | ((F.col("priority") == NUMERIC) & (F.col("longest") > 1))).groupBy(
        "source_file", ids.map_standard_name("var_name").alias("std_name")).agg(
        F.min_by(F.struct("var_name", "key"), F.struct(-F.col("longest"), place, F.col("var_name"))).alias("best")).select(
        "source_file", "best.var_name", "std_name", F.col("best.key").alias("only_key"))
    return exact.unionByName(standard).unionByName(whole)


def _planned(rows: DataFrame, plan: DataFrame, spread_by: list[str], weights: DataFrame | None = None) -> DataFrame:
    """Rows of (file, profile, variable, ...) that the plan takes, under its names; files taken as one profile have key 0."""
    met = counted_join(rows, plan, ["source_file", "var_name"], spread_by, weights)
    return met.where("only_key IS NULL OR only_key = profile_key").withColumn(
        "profile_key", F.when(F.col("only_key").isNull(), F.col("profile_key")).otherwise(0)).drop("only_key")


def _per_profile(facts: DataFrame) -> DataFrame:
    """Counts and names per profile; names beside the standard ones are kept."""
    has = F.col("n_values") > 0
    return facts.groupBy(*nm.PROFILE_KEYS).agg(
        F.max("n_trimmed").alias("n_levels"), F.sum("n_values").alias("n_values"), F.sum("n_trimmed").alias("n_cells"),
        F.count_distinct(F.when(has & F.col("std_name").isin(rules.KEY_VARIABLES), F.col("std_name"))).alias("n_key"),
        F.max(F.when(F.col("std_name") == "PRESSURE", F.col("largest"))).alias("max_depth"),
        F.array_sort(F.collect_set(F.when(has, F.col("std_name")))).alias("variables"))


def ingest_routed(raw_values: DataFrame, raw_scalars: DataFrame, raw_variables: DataFrame, files: DataFrame) -> Ingested:
    """Every file by the first strategy that yields something; the method is recorded with its profiles.

    exact_schema and standard take profile by profile, simple_variables takes a file as one profile at its first position,
    any_numeric as one at the position its name tells, with all numeric variables of more than one value, and
    minimal_fallback records a file without data, refused where its name tells no position. Files of
    the list that hold no rows at all get a minimal profile too.
    """
    facts = stored(nm.variable_facts(raw_values, largest=True), "facts")
    texts = nm.resolve_coordinates(raw_scalars).join(_exact_places(raw_scalars), nm.PROFILE_KEYS, "left")
    coordinates = stored(texts, "coordinates")
    chosen = stored(choose(facts, coordinates, files), "strategies")
    plan = stored(reading_plan(facts, raw_variables, chosen), "plan")
    measured = _per_profile(_planned(facts, plan, ["profile_key"]))

    by_profile = spread_join(coordinates, chosen.where(F.col("priority") <= STANDARD).select("source_file", "priority"),
                             ["source_file"], spread_by=["profile_key"])
    exact = F.col("priority") == EXACT
    own = by_profile.select(
        *nm.PROFILE_KEYS, "priority", "time", "time_dtype", "platform",
        F.when(exact, F.col("exact_lat")).otherwise(F.col("latitude")).alias("latitude"),
        F.when(exact, F.col("exact_lon")).otherwise(F.col("longitude")).alias("longitude"),
        ids.build_profile_id("source_file", "profile_key").alias("profile_id"))
    name_lat, name_lon = ids.coords_from_filename("source_file")
    simple = F.col("priority") == SIMPLE
    suffix = F.element_at(F.array(F.lit("_simple_profile"), F.lit("_any_data"), F.lit("_minimal")), F.col("priority") - 1)
    taken = {c: F.when(simple, F.col(f"first.{c}")) for c in ("time", "time_dtype", "platform")}
    one = chosen.where(F.col("priority") >= SIMPLE).select(
        "source_file", F.lit(0).cast("bigint").alias("profile_key"), "priority", *(v.alias(c) for c, v in taken.items()),
        F.when(simple, F.col("first.latitude")).otherwise(name_lat.cast("string")).alias("latitude"),
        F.when(simple, F.col("first.longitude")).otherwise(name_lon.cast("string")).alias("longitude"),
        F.concat(ids.file_stem("source_file"), suffix).alias("profile_id"))

    cut = ids.truncate_fields()
    every = own.unionByName(one).join(measured, nm.PROFILE_KEYS, "left")
    candidates = every.select(
        *nm.PROFILE_KEYS, "priority", "profile_id", ids.clean_platform("platform", "profile_key").alias("float_id"),
        ids.clean_number("latitude").alias("lat"), ids.clean_number("longitude").alias("lon"),
        normalise_time("time", F.coalesce(F.col("time_dtype").startswith("float"), F.lit(False))).alias("time_start"),
        F.coalesce("variables", F.array().cast("array<string>")).alias("variables"),
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_levels", "n_values", "n_cells", "n_key")],
        "max_depth", nm.read_texts().alias("raw_metadata")).withColumns({c: cut[c] for c in ("profile_id", "float_id")})
    method = F.element_at(F.array(*[F.lit(s) for s in STRATEGIES]), F.col("priority") + 1)
    reason = reject_reason()
    # a minimal profile has no data by its nature
    reason = F.when((F.col("priority") == MINIMAL) & (reason == "no_data"), F.lit(None)).otherwise(reason)
    # the facts tell how many values each variable of each file has
    weights = facts.groupBy("source_file", "var_name").agg(F.sum("n_values").alias("n"))
    values = _planned(nm.clean_values(raw_values).where("value IS NOT NULL"), plan, ["profile_key", "level_idx"], weights)
    standard = F.col("std_name").isin(nm.STANDARD_NAMES)
    extras = values.where(~standard).select(*nm.PROFILE_KEYS, F.col("std_name").alias("var_name"), "level_idx", "value")
    return Ingested(judge(candidates, method, reason), nm.align_levels(values.where(standard)), files, extras)
