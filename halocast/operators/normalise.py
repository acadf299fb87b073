"""From decoded variables of any naming convention to levels and profiles.

Raw tables are long: ``raw_values(source_file, profile_key, var_name,
level_idx, value)`` and ``raw_scalars(source_file, profile_key, name, value,
dtype)``. Aggregates always run on (file, profile, ...) keys with partial
aggregation, so one big file does not end in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from halocast import rules
from halocast.functions import identifiers as ids
from halocast.functions.geo import _col, valid_coordinates
from halocast.functions.times import normalise_time
from halocast.operators.joins import counted_join, spread_join

PROFILE_KEYS = ["source_file", "profile_key"]
SORT_KEYS = PROFILE_KEYS[::-1]  # for sorts: numbers differ at once, file names begin alike
STANDARD_NAMES = sorted(n.upper() for n in rules.VARIABLE_ALIASES)


# --- which variable is which -------------------------------------------------
def resolve_variables(raw_variables: DataFrame, exclude_qc: bool = True,
                      names: list[str] | None = None) -> DataFrame:
    """Per file and standard name, the first variant present in list order."""
    aliases = rules.aliases(raw_variables.sparkSession, "variable", exclude_qc, names)
    return (
        raw_variables.select("source_file", F.col("var_name").alias("variant"))
        .join(F.broadcast(aliases), "variant")
        .groupBy("source_file", "std_name")
        .agg(F.min_by("variant", "priority").alias("var_name"))
    )


def resolve_coordinates(raw_scalars: DataFrame, exclude_qc: bool = True) -> DataFrame:
    """Per profile, the first non-null variant of each coordinate, as text."""
    aliases = rules.aliases(raw_scalars.sparkSession, "coordinate", exclude_qc)
    named = raw_scalars.withColumnRenamed("name", "variant").join(F.broadcast(aliases), "variant")

    def first(kind: str, column: str = "value") -> Column:
        is_kind = F.col("std_name") == kind
        rank = F.when(is_kind & F.col("value").isNotNull(), F.col("priority"))
        return F.min_by(column, rank)

    return named.groupBy(*SORT_KEYS).agg(
        first("latitude").alias("latitude"), first("longitude").alias("longitude"),
        first("time").alias("time"), first("time", "dtype").alias("time_dtype"),
        first("platform").alias("platform")).select(*PROFILE_KEYS, "latitude", "longitude", "time", "time_dtype", "platform")


def detect_structures(raw_variables: DataFrame, rulesets: list[str]) -> DataFrame:
    """Profile and level dimension of each file by several rule sets, in one pass; one row per file and rule set."""
    def place(name: Column, order: list[str]) -> Column:
        found = F.array_position(F.array(*[F.lit(d) for d in order]), name)
        return F.when(found > 0, found)

    one = raw_variables.select(
        "source_file", "var_name", F.col("shape")[0].alias("lead_size"), F.size("dims").alias("n_dims"),
        F.explode(F.arrays_zip("dims", "shape")).alias("d"),
    ).select("*", F.col("d.dims").alias("dim"), F.col("d.shape").alias("size"))
    level_rank = place(F.col("dim"), rules.LEVEL_DIMS)
    parts = [F.min_by("dim", level_rank).alias("level_dim"),
             F.max(F.when((F.col("var_name") == "TEMP") & (F.col("n_dims") >= 2), F.col("lead_size"))).alias("temp_lead")]
    for ruleset in rulesets:
        rank = place(F.col("dim"), rules.PROFILE_DIMS[ruleset])
        if ruleset == "ultra":
            rank = F.when(F.col("size") > 1, rank)
        parts.append(F.min_by(F.struct("dim", "size"), rank).alias(f"_{ruleset}"))
    found = one.groupBy("source_file").agg(*parts)

    def row(ruleset: str) -> Column:
        best = F.col(f"_{ruleset}")
        n = F.coalesce(best["size"], F.col("temp_lead")) if ruleset == "optimized" else best["size"]
        return F.struct(
            F.lit(ruleset).alias("ruleset"), best["dim"].alias("profile_dim"), "level_dim",
            F.coalesce(n, F.lit(1)).cast("bigint").alias("n_profiles"),
            F.when(best["dim"].isNotNull(), "multi_profile").otherwise("single_profile").alias("profile_structure"))

    return found.select("source_file", F.inline(F.array(*map(row, rulesets))))


def detect_structure(raw_variables: DataFrame, ruleset: str = "robust") -> DataFrame:
    """Profile and level dimension of each file, by dimension name priority."""
    return detect_structures(raw_variables, [ruleset]).drop("ruleset")


def split_profiles(flat_values: DataFrame, raw_variables: DataFrame, orientation: str = "names",
                   profile_counts: DataFrame | None = None) -> DataFrame:
    """Flat array positions to (profile, level).

    ``names``: [profile, level] order unless the dimension names say [level, profile]. ``shape``: names don't count; with
    several profiles the side as long as their number is the profiles (the first side if both are; the values of
    the first row belong to every profile if none is), with one profile the longer side is the levels (the first if equal)
    and the first row or column across is read. The number of profiles comes from ``profile_counts`` (source_file, n_profiles),
    else from the dimension names, else from the leading side of TEMP, else it is 1. One-dimensional data belongs to
    every profile of its file.
    """
    structure = detect_structure(raw_variables, "robust" if orientation == "names" else "optimized").select("source_file", "n_profiles")
    if profile_counts is not None:
        counts = profile_counts.select("source_file", F.col("n_profiles").alias("_counted"))
        structure = structure.join(counts, "source_file", "left").select(
            "source_file", F.coalesce("_counted", "n_profiles").cast("bigint").alias("n_profiles"))
    profile_names = [F.lit(d) for d in rules.PROFILE_DIMS["robust"]]
    level_names = [F.lit(d) for d in rules.LEVEL_DIMS]
    first, second, n = F.col("shape")[0], F.try_element_at("shape", F.lit(2)), F.col("n_profiles")
    flat = F.size("dims") > 1
    if orientation == "names":
        swapped = flat & (F.coalesce(F.try_element_at("dims", F.lit(2)).isin(profile_names), F.lit(False)) | F.col("dims")[0].isin(level_names))
        shared = F.lit(False)
    else:
        swapped = flat & F.when(n > 1, (first != n) & (second == n)).otherwise(first >= second)
        shared = flat & (n > 1) & (first != n) & (second != n)
    shapes = raw_variables.join(structure, "source_file").select(
        "source_file", "var_name", "n_profiles", F.size("dims").alias("n_dims"), second.alias("trail"),
        swapped.alias("swapped"), shared.alias("shared"))
    joined = spread_join(flat_values, shapes, ["source_file", "var_name"], spread_by=["pos"])
    quotient = F.floor(F.col("pos") / F.col("trail"))
    remainder = F.col("pos") % F.col("trail")
    own = F.when(F.col("swapped"), remainder).otherwise(quotient)
    level = (F.when(F.col("n_dims") == 1, F.col("pos"))
             .when(F.col("swapped"), quotient).otherwise(remainder))
    every = F.sequence(F.lit(0).cast("bigint"), F.col("n_profiles") - 1)
    owners = F.when((F.col("n_dims") == 1) | (F.col("shared") & (own == 0)), every).when(F.col("shared"), F.array().cast("array<bigint>")).otherwise(
        F.array(own.cast("bigint")))
    if orientation != "names":  # with one profile, one row or column across is all that is read
        owners = F.when((F.col("n_dims") > 1) & (F.col("n_profiles") == 1) & (own > 0), F.array().cast("array<bigint>")).otherwise(owners)
    return joined.select("source_file", "var_name", F.explode(owners).alias("profile_idx"),
                         level.cast("bigint").alias("level_idx"), "value")


# --- values ------------------------------------------------------------------
def clean_values(raw_values: DataFrame) -> DataFrame:
    """NaN, infinities and unreadable values become null."""
    return raw_values.withColumn("value", ids.clean_number("value"))


def variable_facts(raw_values: DataFrame, largest: bool = False) -> DataFrame:
    """Per (file, profile, variable): stored length, trimmed length, non-null count.

    This is the small table that counting, scoring, routing and the fallback
    strategies work on; the long table is read once for it. ``largest`` adds the
    greatest value, from which the depth of a profile follows.
    """
    present = F.col("value").isNotNull()
    return clean_values(raw_values).groupBy(*PROFILE_KEYS, "var_name").agg(
        *([F.max("value").alias("largest")] if largest else []),
        (F.max("level_idx") + 1).cast("bigint").alias("n_stored"),
        (F.coalesce(F.max(F.when(present, F.col("level_idx"))), F.lit(-1)) + 1).cast("bigint")
        .alias("n_trimmed"),
        F.count("value").alias("n_values"),
    )


def standard_facts(facts: DataFrame, resolved: DataFrame) -> DataFrame:
    """Variable facts under standard names; other variables fall away."""
    return spread_join(facts, resolved, ["source_file", "var_name"], spread_by=["profile_key"])


def trim_trailing_nulls(raw_values: DataFrame) -> DataFrame:
    """Drop nulls after the last value of each (profile, variable).

    A plain join on the profile keys: the aggregate side has one row per key,
    and the next step needs another partitioning, so adaptive execution is free
    to split the tasks of a profile that holds very many levels.
    """
    cleaned = clean_values(raw_values)
    last = cleaned.filter("value IS NOT NULL").groupBy(*PROFILE_KEYS, "var_name").agg(
        F.max("level_idx").alias("_last"))
    return (
        cleaned.join(last, [*PROFILE_KEYS, "var_name"])
        .filter(F.col("level_idx") <= F.col("_last")).drop("_last")
    )


def trim_array(values) -> Column:
    """Array form of the same trim; an all-null array becomes null."""
    values = _col(values)
    last = F.array_max(F.transform(values, lambda x, i: F.when(x.isNotNull(), i + 1)))
    return F.when(last.isNotNull(), F.slice(values, 1, last))


def standard_values(raw_values: DataFrame, resolved: DataFrame) -> DataFrame:
    """Cleaned values under standard names, from the variable chosen per file; ``resolved`` is a stored table."""
    return counted_join(clean_values(raw_values), resolved, ["source_file", "var_name"],
                        spread_by=["profile_key", "level_idx"])


def align_levels(values: DataFrame) -> DataFrame:
    """One row per level with a column per standard name; all-null rows dropped.

    The level index is part of the grouping key, so a profile with very many
    levels still spreads over all tasks.
    """
    names = [n.upper() for n in rules.VARIABLE_ALIASES]
    wide = values.filter("value IS NOT NULL").groupBy(*PROFILE_KEYS, "level_idx").agg(
        *[F.max(F.when(F.col("std_name") == n, F.col("value"))).alias(n.lower()) for n in names])
    return wide


def align_arrays(df: DataFrame, columns: list[str]) -> DataFrame:
    """Ragged arrays side by side to rows: padded with null, all-null rows dropped."""
    keep = [c for c in df.columns if c not in columns]
    rows = df.select(*keep, F.inline(F.arrays_zip(*columns)))
    return rows.filter(F.coalesce(*columns).isNotNull())


def count_levels(facts: DataFrame) -> DataFrame:
    """Level counts per profile by three conventions, from standard facts."""
    return facts.groupBy(*PROFILE_KEYS).agg(
        F.max("n_trimmed").alias("n_levels"),
        F.max(F.when(F.col("std_name") == "PRESSURE", F.col("n_stored"))).alias("n_pressure"),
        F.coalesce(F.max(F.when(F.col("n_stored") > 1, F.col("n_stored"))), F.lit(0))
        .alias("n_longest_list"),
    )


def _flag(name: str) -> str:
    return f"_has_{name}"


def name_flags() -> list[Column]:
    """One boolean aggregate per standard name: does it hold data?

    The names are fixed, so flags replace a collected set; flags aggregate in a
    hash table inside generated code, which a collected set does not.
    """
    return [F.max((F.col("std_name") == n) & (F.col("n_values") > 0)).alias(_flag(n))
            for n in STANDARD_NAMES]


def profile_measures(values: DataFrame) -> DataFrame:
    """What ``assemble_profiles`` needs per profile, from ``standard_values`` in one aggregate.

    The same as ``standard_facts`` summed up per profile, without a row per variable between: the standard names are
    fixed, so each has its length and its count in the one row that a profile has per task.
    """
    present = F.col("value").isNotNull()
    parts = []
    for n in STANDARD_NAMES:
        held = F.when((F.col("std_name") == n) & present, F.col("level_idx"))
        parts += [F.max(held).alias(f"_last_{n}"),
                  F.count(F.when(F.col("std_name") == n, F.col("value"))).alias(f"_n_{n}")]
    depth = F.max(F.when(F.col("std_name") == "PRESSURE", F.col("value"))).cast("double").alias("max_depth")
    length = [(F.coalesce(F.col(f"_last_{n}"), F.lit(-1)) + 1).cast("bigint") for n in STANDARD_NAMES]
    count = {n: F.col(f"_n_{n}") for n in STANDARD_NAMES}
    return values.groupBy(*SORT_KEYS).agg(*parts, depth).withColumns(
        {_flag(n): count[n] > 0 for n in STANDARD_NAMES}).select(
        *PROFILE_KEYS, F.greatest(*length).alias("n_levels"), sum(count.values(), F.lit(0).cast("bigint")).alias("n_values"),
        sum(length, F.lit(0).cast("bigint")).alias("n_cells"),
        sum(((count[n] > 0).cast("bigint") for n in STANDARD_NAMES if n in rules.KEY_VARIABLES), F.lit(0).cast("bigint"))
        .alias("n_key"), "max_depth", flagged_names().alias("variables"))


def flagged_names(with_pressure: bool = True) -> Column:
    """Array of the names whose flag is set, in alphabetical order."""
    names = [n for n in STANDARD_NAMES if with_pressure or n != "PRESSURE"]
    return F.array_compact(F.array(*[F.when(F.col(_flag(n)), F.lit(n)) for n in names]))


def list_variables(facts: DataFrame, with_pressure: bool = True) -> DataFrame:
    """Standard names with data per profile, in alphabetical order (nine at most)."""
    flags = facts.groupBy(*PROFILE_KEYS).agg(*name_flags())
    return flags.select(*PROFILE_KEYS, flagged_names(with_pressure).alias("variables"))


def route_scalars_and_levels(raw_values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scalars, levels): a variable with one stored value per profile is a scalar."""
    sizes = raw_values.groupBy(*PROFILE_KEYS, "var_name").agg(
        F.count(F.lit(1)).alias("n_values"), F.max("value").alias("value"))
    scalars = sizes.filter("n_values = 1").drop("n_values")
    many = sizes.filter("n_values > 1").drop("value", "n_values")
    levels = raw_values.join(many, [*PROFILE_KEYS, "var_name"], "left_semi")
    return scalars, levels


def any_numeric_variables(raw_values: DataFrame, raw_variables: DataFrame) -> DataFrame:
    """Values of every numeric variable with more than one value, upper-cased names."""
    size = F.aggregate(F.col("shape"), F.lit(1).cast("bigint"), lambda acc, x: acc * x)
    numeric = raw_variables.filter(F.col("dtype").rlike("^(float|double|complex)") & (size > 1))
    chosen = numeric.select("source_file", "var_name")
    return spread_join(raw_values, chosen, ["source_file", "var_name"],
                       spread_by=["profile_key", "level_idx"]).withColumn(
        "var_name", F.replace(F.upper("var_name"), F.lit(" "), F.lit("_")))


def variable_catalog(raw_variables: DataFrame) -> DataFrame:
    """What exists: files, dtypes and largest shape per variable."""
    return raw_variables.groupBy("var_name").agg(
        F.count_distinct("source_file").alias("n_files"),
        F.array_join(F.array_sort(F.collect_set("dtype")), ",").alias("dtypes"),
        F.max(F.size("dims")).cast("bigint").alias("n_dims"),
        F.max(F.array_max("shape")).cast("bigint").alias("longest_dim"),
    )


# --- profiles ----------------------------------------------------------------
def assemble_profiles(coordinates: DataFrame, facts: DataFrame) -> DataFrame:
    """One row per profile: identity, position, time, level count, variables.

    Facts with ``largest`` give the greatest pressure as ``max_depth`` and the texts read as ``raw_metadata``.
    """
    wide = "largest" in facts.columns
    deepest = F.max(F.when(F.col("std_name") == "PRESSURE", F.col("largest"))) if wide else F.lit(None)
    per_profile = facts.groupBy(*SORT_KEYS).agg(
        F.max("n_trimmed").alias("n_levels"), deepest.cast("double").alias("max_depth"),
        *name_flags(),
        F.sum("n_values").alias("n_values"), F.sum("n_trimmed").alias("n_cells"),
        # one row per standard name here, so counting rows counts names
        F.count(F.when((F.col("n_values") > 0) & F.col("std_name").isin(rules.KEY_VARIABLES), 1))
        .alias("n_key"),
    ).select(
        *PROFILE_KEYS, "n_levels", "n_values", "n_cells", "n_key", "max_depth",
        flagged_names().alias("variables"),
    )
    return assemble_measured(coordinates, per_profile, wide)


def assemble_measured(coordinates: DataFrame, per_profile: DataFrame, wide: bool = True) -> DataFrame:
    """The same from one row of measures per profile; ``wide`` adds ``max_depth`` and ``raw_metadata``."""
    joined = coordinates.join(per_profile, SORT_KEYS, "left")
    cut = ids.truncate_fields()
    return joined.select(
        *PROFILE_KEYS,
        ids.build_profile_id("source_file", "profile_key").alias("profile_id"),
        ids.clean_platform("platform", "profile_key").alias("float_id"),
        ids.clean_number("latitude").alias("lat"), ids.clean_number("longitude").alias("lon"),
        normalise_time("time", F.coalesce(F.col("time_dtype").startswith("float"), F.lit(False)))
        .alias("time_start"),
        F.coalesce("n_levels", F.lit(0)).cast("bigint").alias("n_levels"),
        F.coalesce("variables", F.array().cast("array<string>")).alias("variables"),
        F.coalesce("n_values", F.lit(0)).alias("n_values"),
        F.coalesce("n_cells", F.lit(0)).alias("n_cells"),
        F.coalesce("n_key", F.lit(0)).alias("n_key"),
        *(["max_depth", read_texts().alias("raw_metadata")] if wide else []),
    ).withColumns({c: cut[c] for c in ("profile_id", "float_id")})


def read_texts() -> Column:
    """The coordinate texts of a profile as they were read, without the missing ones."""
    names = ["latitude", "longitude", "time", "platform"]
    return F.map_filter(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))]), lambda k, v: v.isNotNull())


# --- schema ------------------------------------------------------------------
def infer_types(raw_scalars: DataFrame) -> DataFrame:
    """Column type per name, from all of its values rather than one sample."""
    v = F.col("value")
    by_name = raw_scalars.groupBy(ids.safe_column_name("name").alias("column_name")).agg(
        F.count(v).alias("n"),
        F.count(v.try_cast("bigint")).alias("n_int"),
        F.count(v.try_cast("double")).alias("n_double"),
    )
    n = F.col("n")
    return by_name.select(
        "column_name",
        F.when(F.col("column_name").contains("time") & (F.col("column_name") != "time_start"),
               "string")
        .when((n > 0) & (F.col("n_int") == n), "bigint")
        .when((n > 0) & (F.col("n_double") == n), "double")
        .otherwise("string").alias("column_type"),
        n.alias("n_values"),
    )


def evolve_schema(base: DataFrame, incoming: DataFrame, defaults: dict | None = None) -> DataFrame:
    """Union by name; columns missing on either side are added, then defaulted."""
    union = base.unionByName(incoming, allowMissingColumns=True)
    return union.withColumns({c: F.coalesce(F.col(c), F.lit(d))
                              for c, d in (defaults or {}).items()})


def pack_metadata(df: DataFrame, exclude: list[str], out: str = "raw_metadata") -> DataFrame:
    """All columns but the excluded ones as one JSON text; nulls are left out."""
    packed = [c for c in df.columns if c not in exclude]
    return df.withColumn(out, F.to_json(F.struct(*packed)))


def admission_filter(profiles: DataFrame, as_of: str, min_levels: int = rules.MIN_LEVELS,
                     max_age_years: int = rules.MAX_AGE_YEARS,
                     max_file_mb: int = rules.MAX_FILE_MB) -> DataFrame:
    """Profiles with enough levels, recent enough, strictly placed, file not too large."""
    oldest = F.add_months(F.to_date(F.lit(as_of)), -12 * max_age_years).cast("timestamp_ntz")
    keep = ((F.col("n_levels") >= min_levels) & (F.col("time_start") >= oldest)
            & valid_coordinates())
    if "file_size" in profiles.columns:
        limit = max_file_mb * 1024 * 1024
        keep = keep & (F.coalesce("file_size", F.lit(0)) <= limit)
    return profiles.filter(keep)


def chunk_levels(aligned: DataFrame, n: int, column: str) -> DataFrame:
    """Documents of ``n`` consecutive levels; no array is longer than ``n``."""
    point = F.struct("level_idx", F.col(column).alias("v"))
    chunks = aligned.groupBy(*PROFILE_KEYS, F.floor(F.col("level_idx") / n).alias("chunk")).agg(
        F.array_sort(F.collect_list(point)).alias("points"))
    return chunks.select(
        *PROFILE_KEYS, "chunk", F.size("points").cast("bigint").alias("n_points"),
        F.transform("points", lambda p: p.v).alias("values"))
