"""From landed tables to catalogue, levels, documents and errors."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from halocast import rules
from halocast.functions import geo, identifiers as ids
from halocast.functions.embedding import embed_text
from halocast.functions.summaries import summarise
from halocast.operators import normalise as nm
from halocast.operators.joins import spread_join
from halocast.operators.quality import quality_score, reject_reason
from halocast.session import stored
from halocast.sources import sinks, store


MEASURES = list(rules.VARIABLE_ALIASES)


@dataclass
class Ingested:
    """A run: every profile with its verdict, the aligned levels, and the files tried; all lazy.

    ``extras`` holds values under names that are no standard ones, where a strategy keeps them.
    """

    judged: DataFrame
    aligned: DataFrame
    sources: DataFrame | None = None
    extras: DataFrame | None = None

    @property
    def profiles(self) -> DataFrame:
        return self.judged.filter("reject_reason IS NULL").drop("reject_reason")

    @property
    def rejected(self) -> DataFrame:
        return self.judged.filter("reject_reason IS NOT NULL")

    def _of_accepted(self, values: DataFrame, *more: Column) -> DataFrame:
        owners = self.profiles.select(*nm.PROFILE_KEYS, "profile_id", "float_id", *more)
        columns = dict.fromkeys([*nm.PROFILE_KEYS, *values.columns, *owners.columns])
        return values.join(owners, nm.SORT_KEYS).select(*columns)

    @property
    def levels(self) -> DataFrame:
        """Levels of the accepted profiles."""
        return self._of_accepted(self.aligned)

    @property
    def bucketed_levels(self) -> DataFrame:
        """The same with the bucket of each level's float, computed once per profile."""
        return self._of_accepted(self.aligned, sinks.float_bucket().alias("float_bucket"))

    @property
    def extra_values(self) -> DataFrame | None:
        """(.., var_name, level_idx, value) of the accepted profiles, beside the standard names."""
        return None if self.extras is None else self._of_accepted(self.extras)

    def stored(self) -> Ingested:
        """The same run with its verdicts written once and read back.

        Levels, vectors, errors and catalogue all start from the verdicts; the
        raw values behind them are then read once, and lost executors cost a
        re-read only.
        """
        return replace(self, judged=stored(self.judged, "judged"))


#: What a judged profile carries into the store, beside its verdict.
KEPT = [*nm.PROFILE_KEYS, "profile_id", "float_id", "lat", "lon", "time_start", "time_end", "n_levels", "variables",
        "variables_csv", "max_depth", "raw_metadata", "parquet_path", "extraction_method", "data_quality_score", "reject_reason"]


def judge(candidates: DataFrame, method: Column, reason: Column | None = None) -> DataFrame:
    """Assembled profiles with method, score, level folder and verdict."""
    bucket = F.concat(F.lit("float_bucket="), sinks.float_bucket().cast("string"))
    return candidates.withColumns({
        "time_end": F.col("time_start"), "variables_csv": F.array_join("variables", ","),
        "parquet_path": F.when(F.col("n_values") > 0, bucket), "extraction_method": method,
        "data_quality_score": quality_score(), "reject_reason": reject_reason() if reason is None else reason}).select(*KEPT)


def ingest(raw_values: DataFrame, raw_scalars: DataFrame, raw_variables: DataFrame) -> Ingested:
    """Normalise, validate and score every profile of the landed tables."""
    resolved = stored(nm.resolve_variables(raw_variables), "resolved")
    values = nm.standard_values(raw_values, resolved)
    candidates = nm.assemble_measured(nm.resolve_coordinates(raw_scalars), nm.profile_measures(values))
    return Ingested(judge(candidates, F.lit("standard")), nm.align_levels(values))


def publish(run: Ingested, root: str, occurred_at: str, run_id: int, files: DataFrame | None = None) -> str:
    """Write all of a run into a folder of its own attempt, its manifest entry last; returns the folder.

    Levels, values of other names, vectors and errors come first, then the change set of the catalogue, the source files taken,
    the landed ``files`` behind them (path, length, modified) and what level files were written. Readers (``sources.store``)
    merge the live attempts, the latest of each run; no attempt touches another one's files.
    """
    run = run.stored()
    spark = run.judged.sparkSession
    path = sinks.attempt_path(root, run_id)

    def at(name: str) -> str:
        return store.part_of(path, name)

    sinks.write_levels(run.bucketed_levels, at("levels"), MEASURES)
    if run.extras is not None:
        run.extra_values.write.parquet(at("extras"))
    # taken out of an array of one, the sentence isn't built a second time by the filter of blank texts
    documents = embed_text(run.profiles.withColumn("summary", F.explode(F.array(summarise("rich")))))
    sinks.write_vectors(documents, at("vectors"))
    sinks.append_errors(sinks.error_rows(run.rejected, occurred_at), at("errors"))
    now = F.to_timestamp_ntz(F.lit(occurred_at))
    fresh = run.profiles.withColumns({
        "seq": F.col("profile_key"), "created_at": now, "updated_at": now, "file_size": F.lit(None).cast("bigint"),
        "parquet_path": F.concat(F.lit(f"run={run_id}/"), F.col("parquet_path"))})
    per_file = run.judged.groupBy("source_file", "extraction_method").agg(
        F.count(F.lit(1)).alias("n_profiles"), F.count(F.when(F.col("reject_reason").isNull(), 1)).alias("n_accepted")).groupBy("source_file").agg(
        F.sum("n_profiles").alias("n_profiles"), F.sum("n_accepted").alias("n_accepted"), F.max("extraction_method").alias("extraction_method"))
    tried = per_file if run.sources is None else run.sources.select("source_file", *(
        c for c in ("file_size",) if c in run.sources.columns)).dropDuplicates(["source_file"]).join(per_file, "source_file", "left")
    if "file_size" in tried.columns:
        sizes = tried.select("source_file", "file_size")
        fresh = spread_join(fresh.drop("file_size"), sizes, ["source_file"], spread_by=["profile_id"], how="left")
    sinks.write_catalog_version(fresh, at("changes"))
    tried.write.parquet(at("sources"))
    if files is not None:
        files.write.parquet(at("files"))
    store.level_files(spark, at("levels")).write.parquet(at("level_files"))
    sinks.enter(spark, root, run_id, path)
    return path


# --- ordered fallback strategies --------------------------------------------
# fixed values: strategy order and the names the exact strategy looks for
STRATEGIES = ["exact_schema", "standard", "simple_variables", "any_numeric", "minimal_fallback"]
EXACT_VARIABLES = ["TEMP", "PSAL", "DOXY", "PRES"]


def _per_file_place(raw_scalars: DataFrame) -> DataFrame:
    """Position of the first profile of each file that has one."""
    placed = nm.resolve_coordinates(raw_scalars).select(
        *nm.PROFILE_KEYS, ids.clean_number("latitude").alias("lat"),
        ids.clean_number("longitude").alias("lon"))
    complete = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.col("profile_key"))
    return placed.groupBy("source_file").agg(
        F.min_by("lat", complete).alias("lat"), F.min_by("lon", complete).alias("lon"))


def fallback_extract(raw_values: DataFrame, raw_scalars: DataFrame,
                     files: DataFrame) -> DataFrame:
    """Per file, the profiles of the first strategy that yields any.

    All strategies work on variable facts, a table far smaller than the raw
    values, which is stored because each of them reads it. Invalid profiles do not count as a yield. The last strategy only
    records the file, placed by its name if the name tells; no dummy data.
    """
    facts = stored(nm.variable_facts(raw_values).filter("n_values > 0"), "facts")
    spark = raw_values.sparkSession
    aliases = rules.aliases(spark, "variable").withColumnRenamed("variant", "var_name")
    by_alias = facts.join(F.broadcast(aliases), "var_name").select(
        *nm.PROFILE_KEYS, "std_name", "n_trimmed")
    coordinates = nm.resolve_coordinates(raw_scalars).select(
        *nm.PROFILE_KEYS, ids.clean_number("latitude").alias("lat"),
        ids.clean_number("longitude").alias("lon"))
    exact_names = F.col("name").isin("LATITUDE", "LONGITUDE")
    exact_place = raw_scalars.filter(exact_names).groupBy(*nm.PROFILE_KEYS).agg(
        F.max(F.when(F.col("name") == "LATITUDE", ids.clean_number("value"))).alias("lat"),
        F.max(F.when(F.col("name") == "LONGITUDE", ids.clean_number("value"))).alias("lon"))

    def gather(df: DataFrame, keys: list[str], name: Column) -> DataFrame:
        return df.groupBy(*keys).agg(
            F.max("n_trimmed").alias("n_levels"),
            F.array_join(F.array_sort(F.collect_set(name)), ",").alias("variables_csv"))

    def labelled(df: DataFrame, place: int, profile_id: Column) -> DataFrame:
        return df.select("source_file", profile_id.alias("profile_id"), "lat", "lon", "n_levels",
                         "variables_csv", F.lit(STRATEGIES[place]).alias("extraction_method"),
                         F.lit(place).alias("priority"))

    stem = ids.file_stem("source_file")
    per_profile = ids.build_profile_id("source_file", "profile_key")
    name_lat, name_lon = ids.coords_from_filename("source_file")
    exact = gather(facts.filter(F.col("var_name").isin(EXACT_VARIABLES)), nm.PROFILE_KEYS,
                   F.col("var_name")).join(exact_place, nm.PROFILE_KEYS)
    standard = gather(by_alias, nm.PROFILE_KEYS, F.col("std_name")).join(
        coordinates, nm.PROFILE_KEYS)
    file_facts = facts.groupBy("source_file", "var_name").agg(
        F.max("n_trimmed").alias("n_trimmed"))
    simple = gather(file_facts, ["source_file"], ids.map_standard_name("var_name")).join(
        _per_file_place(raw_scalars), "source_file")
    numeric = gather(file_facts.filter("n_trimmed > 1"), ["source_file"],
                     F.replace(F.upper("var_name"), F.lit(" "), F.lit("_"))).withColumns(
        {"lat": name_lat, "lon": name_lon})
    minimal = files.select("source_file").withColumns({
        "lat": name_lat, "lon": name_lon, "n_levels": F.lit(0).cast("bigint"),
        "variables_csv": F.lit("METADATA_ONLY")})
    valid = geo.valid_coordinates()
    candidates = (
        labelled(exact.filter(valid), 0, per_profile)
        .unionByName(labelled(standard.filter(valid), 1, per_profile))
        .unionByName(labelled(simple.filter(valid), 2, F.concat(stem, F.lit("_simple_profile"))))
        .unionByName(labelled(numeric.filter(valid), 3, F.concat(stem, F.lit("_any_data"))))
        .unionByName(labelled(minimal, 4, F.concat(stem, F.lit("_minimal"))))
    )
    candidates = stored(candidates, "candidates")
    best = candidates.groupBy("source_file").agg(F.min("priority").alias("_best"))
    chosen = spread_join(candidates, best, ["source_file"], spread_by=["profile_id"]).filter(
        F.col("priority") == F.col("_best"))
    return chosen.drop("_best").withColumn("accepted", valid)
