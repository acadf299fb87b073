"""Every operator as a query over the given tables.

Each entry takes (spark, sf_dir) and returns a DataFrame over the whole of the
tables it reads. Arrays are shown as joined text and doubles to six digits, so
that results compare across engines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from halocast import rules
from halocast.functions import geo, identifiers as ids, summaries, text, times
from halocast.functions.embedding import embed_text
from halocast.functions.geo import round6
from halocast.operators import catalog as cat, filters, joins, normalise as nm, quality, stats, textsearch, topk
from halocast.plans import health, incremental as inc, ingest as ing, questions, routing
from halocast.session import stored, work_dir
from halocast.sources import fixtures as fx, inventory, landing, sinks, store
from halocast.sources.tables import read_table, table_path
from halocast.streaming import streams

# pinned clocks: queries never ask for the current time
CATALOG_AS_OF = "2001-07-31"
ERRORS_AS_OF = "2024-01-31"
MEASURES = ["pres", "temp", "psal", "doxy"]

QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def csv(column) -> Column:
    return F.array_join(column, ",")


def facts_of(spark, sf):
    resolved = nm.resolve_variables(fx.raw_variables(spark, sf))
    return nm.standard_facts(nm.variable_facts(fx.raw_values(spark, sf)), resolved)


def assembled(spark, sf):
    return nm.assemble_profiles(nm.resolve_coordinates(fx.raw_scalars(spark, sf)),
                                facts_of(spark, sf))


def level_listing(spark, sf):
    """Listing of the level files that exist: those of profiles that have levels."""
    held = fx.levels(spark, sf).groupBy("profile_id").agg(F.count(F.lit(1)).alias("n"))
    return held.select(F.concat(F.lit("store/"), F.col("profile_id"), F.lit(".parquet"))
                       .alias("path"), (F.col("n") * 64).alias("length"))


# --- sources and sinks -------------------------------------------------------
@query
def file_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.file_inventory(spark, sf, ["parquet"])


@query
def read_raw(spark, sf):
    path = work_dir(spark, "raw")
    fx.derive_raw_values(spark, sf).write.parquet(path)
    return landing.read_raw(spark, path, "values")


@query
def read_profile_json(spark, sf):
    path = work_dir(spark, "json")
    row = F.struct(
        "profile_id", "float_id", "lat", "lon",
        F.date_format("time_start", "yyyy-MM-dd'T'HH:mm:ss").alias("time"),
        F.size("variables").alias("n_levels"), "variables",
        stats.region_label().alias("region"))
    # documents of a hundred neighbouring ids
    docs = fx.profiles(spark, sf).groupBy(F.floor(F.col("id") / 100).alias("doc")).agg(
        F.collect_list(row).alias("profiles"))
    docs.select("profiles").write.json(path)
    out = landing.read_profile_json(spark, path, multi_line=False)
    return out.select("profile_id", "float_id", "lat", "lon", "time", "n_levels",
                      csv("variables").alias("variables"), "region")


@query
def write_levels(spark, sf):
    path = work_dir(spark, "levels")
    owners = fx.profiles(spark, sf).select("profile_id", "float_id")
    sinks.write_levels(joins.profile_levels(owners, fx.levels(spark, sf)), path, MEASURES)
    return landing.read_levels(spark, path).select("profile_id", "float_id", *MEASURES)


@query
def read_levels(spark, sf):
    path = work_dir(spark, "levels")
    lv = fx.levels(spark, sf)
    lv.filter("doxy IS NULL").drop("doxy").write.parquet(f"{path}/part=0")
    lv.filter("doxy IS NOT NULL").write.parquet(f"{path}/part=1")
    return landing.read_levels(spark, path).select("profile_id", *MEASURES)


@query
def append_errors(spark, sf):
    path = work_dir(spark, "errors")
    _, rejected = quality.validate_profiles(assembled(spark, sf))
    sinks.append_errors(sinks.error_rows(rejected, CATALOG_AS_OF), path)
    return spark.read.parquet(path).select("file_path", "error_type", "error_message",
                                           "occurred_at")


@query
def write_vectors(spark, sf):
    path = work_dir(spark, "vectors")
    docs = read_table(spark, sf, "documents").select(
        F.when(F.col("lang") != "fr", F.concat(F.lit("D"), F.col("doc_id").cast("string")))
        .alias("profile_id"),
        F.when(F.col("source") == "src1", "  ").otherwise(F.col("text")).alias("summary"))
    sinks.write_vectors(docs, path)
    return spark.read.parquet(path).select("profile_id", F.length("summary").alias("n_chars"))


@query
def write_report(spark, sf):
    path = work_dir(spark, "reports")
    hourly = read_table(spark, sf, "events").groupBy(
        F.date_format("ts", "yyyy-MM-dd HH").alias("report_time")).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count(F.when(F.col("event_type") == "error", 1)).alias("n_errors"))
    sinks.write_report(hourly.withColumn("report_id", F.col("report_time")), path)
    reports = spark.read.schema(
        "report_time string, n_events bigint, n_errors bigint, report_id string").json(path)
    return sinks.kept_reports(reports).drop("report_id")


# --- normalisation -----------------------------------------------------------
@query
def resolve_variables(spark, sf):
    return nm.resolve_variables(fx.raw_variables(spark, sf))


@query
def resolve_variables_short_with_qc(spark, sf):
    return nm.resolve_variables(fx.raw_variables(spark, sf), exclude_qc=False,
                                names=rules.SHORT_RULESET_NAMES)


@query
def resolve_coordinates(spark, sf):
    return nm.resolve_coordinates(fx.raw_scalars(spark, sf)).drop("time_dtype")


@query
def map_standard_name(spark, sf):
    names = fx.raw_variables(spark, sf).select("var_name").unionByName(
        read_table(spark, sf, "part").select(F.col("p_name").alias("var_name")))
    return names.groupBy("var_name").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "std_name", ids.map_standard_name("var_name"))


@query
def detect_structure(spark, sf):
    return nm.detect_structures(fx.raw_variables(spark, sf), ["robust", "ultra", "optimized"])


@query
def split_profiles(spark, sf):
    return nm.split_profiles(fx.flat_values(spark, sf), fx.raw_variables(spark, sf)).withColumn(
        "value", ids.clean_number("value"))


@query
def split_profiles_by_shape(spark, sf):
    """The same files where only shapes tell the orientation; their scalars count the profiles."""
    counts = fx.file_shapes(fx.raw_values(spark, sf)).select("source_file", F.col("n_prof").alias("n_profiles"))
    return nm.split_profiles(fx.flat_values(spark, sf), fx.raw_variables(spark, sf), "shape", counts).withColumn(
        "value", ids.clean_number("value"))


@query
def clean_values(spark, sf):
    return nm.clean_values(fx.raw_values(spark, sf))


@query
def trim_trailing_nulls(spark, sf):
    return nm.trim_trailing_nulls(fx.raw_values(spark, sf)).select(
        *nm.PROFILE_KEYS, "var_name", "level_idx", "value")


@query
def align_levels(spark, sf):
    resolved = stored(nm.resolve_variables(fx.raw_variables(spark, sf)), "resolved")
    return nm.align_levels(nm.standard_values(fx.raw_values(spark, sf), resolved)).select(
        *nm.PROFILE_KEYS, "level_idx", "temperature", "salinity", "pressure", "oxygen")


@query
def normalise_time(spark, sf):
    seconds = F.unix_timestamp(F.date_trunc("second", F.col("ts").cast("timestamp")))
    days = F.datediff("ts", F.lit("1950-01-01").cast("date"))
    kind = F.col("event_type")
    raw = (F.when(kind == "click", seconds.cast("string"))
           .when(kind == "view", F.concat(days.cast("string"), F.lit(".25")))
           .when(kind == "error", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
           .when(kind == "signup", F.date_format("ts", "yyyyMMdd"))
           .otherwise(F.concat(F.lit("junk "), F.col("event_id").cast("string"))))
    ev = read_table(spark, sf, "events").select("event_id", raw.alias("raw"),
                                                kind.isin("click", "view").alias("numeric"))
    return ev.select(
        "event_id", "raw", times.normalise_time("raw", F.col("numeric")).alias("time_ultra"),
        F.when(F.col("numeric"), times.normalise_number(F.col("raw").try_cast("double"),
                                                        "optimized")).alias("time_optimized"))


@query
def clean_identifiers(spark, sf):
    names = read_table(spark, sf, "pages").select(F.col("page_id").alias("id"),
                                                  F.col("url").alias("name")).unionByName(
        read_table(spark, sf, "part").select(F.col("p_partkey").alias("id"),
                                             F.col("p_type").alias("name")))
    return names.select("id", "name", ids.clean_filename("name").alias("file_name"),
                        ids.safe_column_name("name").alias("column_name"))


@query
def clean_platform(spark, sf):
    sc = fx.raw_scalars(spark, sf).filter(F.col("name").isin(*fx.SCALAR_NAMES["platform"]))
    return sc.select(*nm.PROFILE_KEYS, ids.clean_platform("value", "profile_key").alias("float_id"))


@query
def build_profile_id(spark, sf):
    paths = fx.profiles(spark, sf).select(
        "id", F.concat(F.lit("/data/in/"), F.col("source_file")).alias("path"))
    return paths.select("id", *[ids.build_profile_id("path", "id", s).alias(f"{s}_id")
                                for s in ids.PROFILE_ID_SEPARATORS])


@query
def coords_from_filename(spark, sf):
    name = F.concat(
        F.lit("x_"), F.abs(F.col("s_acctbal")).cast("decimal(9,2)").cast("string"),
        F.when(F.col("s_suppkey") % 2 == 0, "N").otherwise("S"), F.lit("_"),
        F.col("s_nationkey").cast("string"),
        F.when(F.col("s_suppkey") % 3 == 0, "W").when(F.col("s_suppkey") % 3 == 1, "E")
        .otherwise("X"), F.lit(".nc"))
    lat, lon = ids.coords_from_filename("file_name")
    return read_table(spark, sf, "supplier").select("s_suppkey", name.alias("file_name")).select(
        "s_suppkey", "file_name", lat.alias("lat"), lon.alias("lon"))


@query
def count_levels(spark, sf):
    return nm.count_levels(facts_of(spark, sf))


@query
def list_variables(spark, sf):
    facts = facts_of(spark, sf)
    out = nm.list_variables(facts).withColumnRenamed("variables", "all_names")
    core = F.array_remove("all_names", "PRESSURE")
    return out.select(*nm.PROFILE_KEYS, csv("all_names").alias("variables"),
                      csv(core).alias("without_pressure"))


@query
def route_scalars_and_levels(spark, sf):
    scalars, levels = nm.route_scalars_and_levels(nm.clean_values(fx.raw_values(spark, sf)))
    cols = [*nm.PROFILE_KEYS, "var_name", "value"]
    return scalars.select(*cols, F.lit("scalar").alias("route"), F.lit(0).alias("level_idx")) \
        .unionByName(levels.select(*cols, F.lit("level").alias("route"), "level_idx"))


@query
def validate_profiles(spark, sf):
    judged = assembled(spark, sf).withColumn("reason", quality.reject_reason())
    return judged.select("profile_id", "lat", "lon", "n_levels",
                         F.coalesce("reason", F.lit("accepted")).alias("reason"))


def degraded(spark, sf):
    """Landing with unknown variable names, lost coordinates and telling file names."""
    def renamed(df: DataFrame) -> DataFrame:
        n = fx.file_number()
        return df.withColumn("source_file", F.when(
            n % 10 == 7, F.concat(F.lit("batch_"), n.cast("string"), F.lit("_12.5N_65W.nc")))
            .otherwise(F.col("source_file")))

    n = fx.file_number()
    values = fx.raw_values(spark, sf).withColumn("var_name", F.when(
        n % 10 == 3, F.concat(F.lit("x-"), F.col("var_name"))).otherwise(F.col("var_name")))
    scalars = fx.raw_scalars(spark, sf).filter(~(n % 10).isin(7, 9))
    files = fx.raw_scalars(spark, sf).select("source_file").distinct()
    return renamed(values), renamed(scalars), renamed(files)


@query
def fallback_extract(spark, sf):
    return ing.fallback_extract(*degraded(spark, sf)).select(
        "source_file", "profile_id", "lat", "lon", "n_levels", "variables_csv",
        "extraction_method", "accepted")


@query
def any_numeric_variables(spark, sf):
    found = nm.any_numeric_variables(fx.raw_values(spark, sf), fx.raw_variables(spark, sf))
    return nm.clean_values(found).groupBy("source_file", "var_name").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("value").alias("n_values"))


@query
def variable_catalog(spark, sf):
    return nm.variable_catalog(fx.raw_variables(spark, sf))


@query
def evolve_schema(spark, sf):
    base = fx.profiles(spark, sf).select("profile_id", "lat", "extraction_method")
    batch = fx.catalog_batches(spark, sf).select("profile_id", "extraction_method",
                                                 "data_quality_score", "seq")
    return nm.evolve_schema(base, batch, {"data_quality_score": 1.0})


@query
def evolve_schema_types(spark, sf):
    return nm.infer_types(fx.raw_scalars(spark, sf))


@query
def pack_metadata(spark, sf):
    packed = nm.pack_metadata(fx.profiles(spark, sf).select(
        "profile_id", "float_id", "time_start", "parquet_path", "variables"), ["variables"])
    seen = F.from_json("raw_metadata", "map<string,string>")
    return packed.select("profile_id", csv(F.array_sort(F.map_keys(seen))).alias("fields"),
                         seen["float_id"].alias("float_id"),
                         seen["parquet_path"].alias("parquet_path"))


@query
def truncate_fields(spark, sf):
    cut = ids.truncate_fields({"name": 12, "body": 255})
    return read_table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("name"), F.col("text").alias("body")).withColumns(cut)


@query
def admission_filter(spark, sf):
    kept = nm.admission_filter(fx.catalog(spark, sf), CATALOG_AS_OF, max_age_years=3)
    return kept.select("profile_id", "lat", "lon", "n_levels", "time_start")


@query
def chunk_levels(spark, sf):
    resolved = stored(nm.resolve_variables(fx.raw_variables(spark, sf)), "resolved")
    aligned = nm.align_levels(nm.standard_values(fx.raw_values(spark, sf), resolved))
    chunks = nm.chunk_levels(aligned, 4, "pressure")
    shown = F.transform("values", lambda v: v.cast("bigint").cast("string"))
    return chunks.select(*nm.PROFILE_KEYS, "chunk", "n_points", csv(shown).alias("pressures"))


# --- predicates and text constraints -----------------------------------------
@query
def bbox_filter(spark, sf):
    p = fx.profiles(spark, sf).select("profile_id", "lat", "lon")
    boxes = {n: (a, b, c, d) for n, a, b, c, d in rules.REGIONS["base"]}
    parts = [filters.bbox_filter(p, boxes[n], wrap).withColumn("box", F.lit(label))
             for n, wrap, label in (("pacific", True, "pacific"),
                                    ("pacific", False, "pacific literal"),
                                    ("indian ocean", True, "indian ocean"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _texts(spark, sf):
    docs = read_table(spark, sf, "documents").select(
        F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("query_id"), "text")
    return fx.query_log(spark, sf).select("query_id", "text").unionByName(docs)


@query
def extract_region(spark, sf):
    t = _texts(spark, sf).withColumn("low", F.lower("text"))
    return t.select("query_id", *[
        text.region_box("low", rs, m)["name"].alias(f"{rs}_{m}")
        for rs in ("base", "enhanced") for m in ("longest", "first")])


@query
def extract_point_box(spark, sf):
    t = text.constraints(_texts(spark, sf), "base").withColumn(
        "e", text.point_box("text", "enhanced"))
    bounds = ("lat_min", "lat_max", "lon_min", "lon_max")
    return t.select("query_id", F.col("region_name").alias("source"),
                    *[F.round(c, 6).alias(c) for c in bounds],
                    *[F.round(F.col(f"e.{c}"), 6).alias(f"point_{c}") for c in bounds])


@query
def extract_time_constraint(spark, sf):
    return text.constraints(_texts(spark, sf)).select(
        "query_id", "months_back", "year_asked", "seasonal", "season")


@query
def time_filter(spark, sf):
    p = fx.profiles(spark, sf).select("profile_id", "time_start")
    back = filters.time_filter(p, CATALOG_AS_OF, months=6).withColumn("rule", F.lit("6 months"))
    year = filters.time_filter(p, CATALOG_AS_OF, year=2000).withColumn("rule", F.lit("2000"))
    return back.unionByName(year)


@query
def season_filter(spark, sf):
    p = fx.profiles(spark, sf).select("profile_id", "time_start")
    return filters.season_filter(p, "winter")


@query
def keyword_search(spark, sf):
    p = fx.profiles(spark, sf)
    parts = [filters.keyword_search(p, w, 20).select("profile_id", "float_id", "time_start")
             .withColumn("word", F.lit(w)) for w in ("nitrate", "f77", "P_1", "%")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query
def keyword_search_many(spark, sf):
    """A word per supplier, empty and repeated ones too, in one pass over the catalogue."""
    key = F.col("s_suppkey")
    word = F.when(key % 4 == 0, F.concat(F.lit("p"), key.cast("string"))).when(key % 4 == 1, F.concat(F.lit("F"), (key % 7).cast("string"))).when(
        key % 4 == 2, "Nitrate").when(key % 8 == 3, "").otherwise("%")
    texts = read_table(spark, sf, "supplier").select(
        F.concat(F.lit("S"), key.cast("string")).alias("query_id"), word.alias("word"), (key % 6).cast("int").alias("k"))
    return textsearch.keyword_search_many(fx.profiles(spark, sf), texts)


@query
def facet_search_many(spark, sf):
    """All questions of the log in one pass."""
    return textsearch.facet_search_many(fx.catalog(spark, sf), fx.query_log(spark, sf).select("query_id", "text", "k"))


@query
def facet_filter(spark, sf):
    c = fx.catalog(spark, sf)
    return filters.facet_filter(c, "oxygen near the equator below 1000m").select(
        "profile_id", "variables_csv", "max_depth")


@query
def facet_filter_no_match(spark, sf):
    return filters.facet_filter(fx.catalog(spark, sf), "zzz nothing of the kind").select(
        "profile_id", "variables_csv", "max_depth")


@query
def scope_filter(spark, sf):
    flagged = text.in_scope(_texts(spark, sf), "by_token")
    return text.in_scope(flagged, "by_substring", mode="substring").drop("text")


@query
def invalid_coordinates(spark, sf):
    return cat.invalid_coordinates(fx.profiles(spark, sf)).select("profile_id", "lat", "lon")


@query
def variables_contain(spark, sf):
    p = fx.profiles(spark, sf).select("profile_id", "variables")
    one = filters.variables_contain(p, variable="CHLA").withColumn("rule", F.lit("CHLA"))
    group = filters.variables_contain(p, group="nutrients").withColumn("rule", F.lit("nutrients"))
    return one.unionByName(group).drop("variables")


# --- joins -------------------------------------------------------------------
@query
def candidates_semi_catalog(spark, sf):
    kept = filters.time_filter(fx.profiles(spark, sf), CATALOG_AS_OF, year=1999)
    return joins.candidates_semi_catalog(fx.vectors(spark, sf).select("profile_id", "label"), kept)


@query
def skip_loaded(spark, sf):
    """Files to load where the catalogue holds those whose number is no multiple of three."""
    files = fx.profiles(spark, sf).select("source_file").distinct()
    loaded = fx.profiles(spark, sf).where(fx.file_number() % 3 != 0)
    return joins.skip_loaded(files, loaded)


@query
def missing_level_files(spark, sf):
    """Profiles of a published store whose level bucket is gone."""
    root = damaged(spark, sf)
    return joins.missing_level_files(store.catalog(spark, root), store.level_inventory(spark, root)).select(
        "profile_id", "parquet_path")


@query
def reconcile_levels(spark, sf):
    """Level buckets of a published store that aren't as they were written."""
    return store.reconcile_levels(spark, damaged(spark, sf)).where("state <> 'present'").select(
        F.col("run").cast("bigint").alias("run"), F.col("float_bucket").cast("bigint").alias("float_bucket"), "path", "state")


@query
def profile_levels(spark, sf):
    owners = fx.profiles(spark, sf).select("profile_id", "float_id", "lat", "lon")
    return joins.profile_levels(owners, fx.levels(spark, sf)).select(
        "profile_id", "float_id", "lat", "lon", *MEASURES)


@query
def catalog_vector_reconcile(spark, sf):
    return joins.reconcile(fx.profiles(spark, sf), fx.vectors(spark, sf), rules.MISMATCH_LIMIT)


@query
def region_join(spark, sf):
    return filters.region_join(fx.profiles(spark, sf)).select("profile_id", "region")


@query
def nearest_profiles(spark, sf):
    return topk.nearest_profiles(fx.profiles(spark, sf), fx.search_points(spark, sf), k=3) \
        .withColumnRenamed("distance", "distance_km")


@query
def vector_join(spark, sf):
    """Every vector against the mean vector of its label."""
    v = fx.vectors(spark, sf)
    places = F.transform("embedding", lambda x, i: F.struct(i.alias("i"),
                                                           x.cast("double").alias("x")))
    means = v.select("label", F.inline(places)).groupBy("label", "i").agg(F.avg("x").alias("x"))
    center = means.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p.x).alias("b"))
    return topk.vector_join(v.select("profile_id", "label", F.col("embedding").alias("a")),
                            center, ["label"])


# --- aggregations ------------------------------------------------------------
@query
def count_profiles(spark, sf):
    return stats.count_profiles(fx.profiles(spark, sf))


@query
def region_stats(spark, sf):
    return stats.region_stats(fx.profiles(spark, sf))


@query
def region_stats_basic(spark, sf):
    return stats.region_stats(fx.profiles(spark, sf), "stats_basic")


@query
def latitude_band_stats(spark, sf):
    return stats.latitude_band_stats(fx.profiles(spark, sf))


@query
def variable_frequency(spark, sf):
    return stats.variable_frequency(fx.profiles(spark, sf))


@query
def date_range(spark, sf):
    return stats.date_range(fx.profiles(spark, sf))


@query
def float_summary(spark, sf):
    return stats.float_summary(fx.catalog(spark, sf))


@query
def method_stats(spark, sf):
    return stats.method_stats(fx.catalog(spark, sf))


@query
def quality_tiers(spark, sf):
    return stats.quality_tiers(fx.catalog(spark, sf))


@query
def quality_score(spark, sf):
    return assembled(spark, sf).select(
        "profile_id", "n_values", "n_cells", "n_key",
        quality.quality_score().alias("data_quality_score"))


@query
def error_stats(spark, sf):
    return stats.error_stats(fx.ingestion_errors(spark, sf), ERRORS_AS_OF)


@query
def catalog_metrics(spark, sf):
    return stats.catalog_metrics(fx.catalog(spark, sf), CATALOG_AS_OF)


@query
def completeness(spark, sf):
    return stats.completeness(fx.profiles(spark, sf))


@query
def duplicate_profiles(spark, sf):
    return stats.duplicate_profiles(fx.catalog_batches(spark, sf))


@query
def orphan_ratio(spark, sf):
    return stats.orphan_ratio(fx.profiles(spark, sf))


@query
def run_summary(spark, sf):
    files = fx.profiles(spark, sf).select("source_file")
    judged = assembled(spark, sf).withColumn("reject_reason", quality.reject_reason())
    return stats.run_summary(files, judged, F.col("time_start").isNotNull())


@query
def overview_metrics(spark, sf):
    return stats.overview_metrics(fx.catalog(spark, sf))


@query
def region_share(spark, sf):
    return stats.region_share(fx.profiles(spark, sf))


@query
def parameter_ranges(spark, sf):
    return stats.parameter_ranges(fx.levels(spark, sf), ["temp", "psal", "doxy"])


@query
def depth_series(spark, sf):
    return stats.depth_series(fx.profiles(spark, sf), fx.levels(spark, sf))


@query
def collection_summary(spark, sf):
    return stats.collection_summary(fx.catalog(spark, sf))


@query
def storage_summary(spark, sf):
    """Level buckets of a published store; a damaged one counts as empty."""
    found = stats.storage_summary(store.level_inventory(spark, damaged(spark, sf)))
    return found.select("total_files", "zero_byte_files", (F.col("total_size_mb") > 0).alias("has_size"))


# --- windows, sorts, sets ----------------------------------------------------
@query
def latest_per_profile(spark, sf):
    return cat.latest_per_profile(fx.catalog_batches(spark, sf))


@query
def error_rate_windows(spark, sf):
    return stats.error_rate_windows(fx.ingestion_errors(spark, sf))


@query
def latest_profiles(spark, sf):
    return stats.latest_profiles(fx.profiles(spark, sf), 25).select("profile_id", "time_start")


@query
def latest_profiles_dated(spark, sf):
    return stats.latest_profiles(fx.profiles(spark, sf), 25, nulls_first=False).select(
        "profile_id", "time_start")


@query
def top_variables(spark, sf):
    return stats.top_variables(fx.profiles(spark, sf))


@query
def top_error_types(spark, sf):
    return stats.top_error_types(fx.ingestion_errors(spark, sf))


@query
def distinct_regions(spark, sf):
    return stats.distinct_regions(fx.profiles(spark, sf))


@query
def union_variables(spark, sf):
    return stats.union_variables(fx.profiles(spark, sf))


@query
def distinct_sources(spark, sf):
    return stats.distinct_sources(fx.profiles(spark, sf))


# --- vectors -----------------------------------------------------------------
def _vector_queries(spark, sf):
    return fx.query_vectors(spark, sf).select("query_id", "query_vector", "k")


@query
def vector_topk(spark, sf):
    return topk.vector_topk(fx.vectors(spark, sf), _vector_queries(spark, sf)).drop("distance")


@query
def vector_topk_cosine(spark, sf):
    return topk.vector_topk(fx.vectors(spark, sf), _vector_queries(spark, sf), "cosine") \
        .drop("distance")


@query
def vector_topk_dot(spark, sf):
    return topk.vector_topk(fx.vectors(spark, sf), _vector_queries(spark, sf), "dot") \
        .drop("distance")


@query
def vector_topk_approx(spark, sf):
    return topk.vector_topk_approx(fx.vectors(spark, sf), _vector_queries(spark, sf)) \
        .drop("distance")


@query
def vector_topk_approx_quality(spark, sf):
    """Whether the approximate search keeps its promises with the parameters above."""
    found = topk.approx_quality(fx.vectors(spark, sf), _vector_queries(spark, sf))
    return found.select((F.col("recall") >= 0.9).alias("finds_nine_tenths"), (F.col("pairs_share") < 0.2).alias("measures_a_fifth_at_most"))


@query
def nearest_profiles_all(spark, sf):
    """Every catalogue row as a search point."""
    p = fx.profiles(spark, sf).select("profile_id", "lat", "lon")
    points = fx.profiles(spark, sf).select(F.col("profile_id").alias("query_id"), F.col("lat"), F.col("lon"))
    return topk.nearest_profiles(p, points, 3, 10.0).select("query_id", "rank", "profile_id", F.col("distance").alias("km"))


@query
def rank_by_relevance(spark, sf):
    """Profiles near each named search point's region, by relevance then id."""
    p = fx.profiles(spark, sf).select("profile_id", "id", "lat", "lon")
    hits = filters.bbox_filter(p, (10, 25, 50, 75)).select(
        F.lit("arabian sea").alias("query_id"), "profile_id", F.col("id").alias("vector_rank"),
        F.round(geo.relevance(geo.haversine(F.lit(17.5), F.lit(62.5), "lat", "lon")), 6)
        .alias("relevance"), F.lit(50).alias("k"))
    return questions.rank_by_relevance(hits).select("query_id", "rank", "profile_id", "relevance")


# --- scalar functions --------------------------------------------------------
@query
def haversine(spark, sf):
    return fx.profiles(spark, sf).select("profile_id", F.round(
        geo.haversine(F.lit(17.5), F.lit(62.5), "lat", "lon"), 4).alias("distance_km"))


@query
def geo_relevance(spark, sf):
    km = geo.haversine(F.lit(17.5), F.lit(62.5), "lat", "lon")
    p = filters.bbox_filter(fx.profiles(spark, sf), (10, 25, 50, 75))
    return p.select("profile_id", round6(geo.relevance(km, "base")).alias("base"),
                    round6(geo.relevance(km, "enhanced")).alias("enhanced"))


@query
def classify_region(spark, sf):
    ladders = ("stats", "stats_basic", "bands", "answer", "hemispheres")
    return fx.profiles(spark, sf).filter("lat IS NOT NULL AND lon IS NOT NULL").select(
        "profile_id", *[geo.classify_region(ladder=x).alias(x) for x in ladders])


@query
def guess_basin(spark, sf):
    return fx.profiles(spark, sf).select(
        "profile_id", geo.guess_basin().alias("basin"),
        geo.guess_basin(ruleset="reference").alias("basin_wide_atlantic"))


@query
def format_position(spark, sf):
    return fx.profiles(spark, sf).select("profile_id", geo.format_position().alias("position"),
                                         geo.signed_position().alias("signed_position"))


@query
def summarise_profile(spark, sf):
    return fx.catalog(spark, sf).select("profile_id", *[
        summaries.summarise(v).alias(v) for v in ("ingest", "robust", "ultra", "rich", "rebuild")])


@query
def enrich_summary(spark, sf):
    return fx.profiles(spark, sf).select("profile_id",
                                         summaries.enrich(CATALOG_AS_OF).alias("summary"))


@query
def parameter_phrases(spark, sf):
    return fx.profiles(spark, sf).select(
        "profile_id", csv(text.parameter_phrases("variables_csv")).alias("base"),
        csv(text.parameter_phrases("variables_csv", "enhanced")).alias("enhanced"))


@query
def parse_variables(spark, sf):
    as_text = F.when(F.col("time_start").isNull(), "{not json").otherwise(
        F.concat(F.lit('["'), F.replace("variables_csv", F.lit(","), F.lit('","')), F.lit('"]')))
    return fx.profiles(spark, sf).select("profile_id", as_text.alias("t")).select(
        "profile_id", csv(ids.parse_variables("t")).alias("variables"))


@query
def count_variables(spark, sf):
    return fx.profiles(spark, sf).select("profile_id", F.size("variables").cast("bigint")
                                         .alias("n_variables"))


@query
def range_parse(spark, sf):
    lo = F.col("c_acctbal").cast("decimal(12,2)")
    hi = lo + F.lit(50)
    parsed = ids.parse_range("t")
    return read_table(spark, sf, "customer").select(
        "c_custkey", F.concat(lo.cast("string"), F.lit("-"), hi.cast("string"), F.lit("°C"))
        .alias("t")).select("c_custkey", "t", parsed["min"].alias("range_min"),
                            parsed["max"].alias("range_max"))


@query
def embed_text_of_summaries(spark, sf):
    docs = fx.catalog(spark, sf).select("profile_id", summaries.summarise("rebuild").alias("summary"))
    return embed_text(docs).select("profile_id", "embedding")


QUERIES["embed_text"] = QUERIES.pop("embed_text_of_summaries")


# --- catalogue changes -------------------------------------------------------
def _old_and_batch(spark, sf):
    old = fx.catalog(spark, sf).select("profile_id", "float_id", "extraction_method",
                                       "data_quality_score", "parquet_path", "created_at",
                                       F.lit(-1).cast("bigint").alias("seq"),
                                       F.col("created_at").alias("updated_at"))
    # half of the keys are known profiles, half are new
    batch = fx.catalog_batches(spark, sf)
    new = batch.withColumn("profile_id", F.when(F.col("seq") % 2 == 0, F.col("profile_id"))
                           .otherwise(F.concat(F.lit("N"), F.col("profile_id"))))
    return old, new


_UPSERT = ["profile_id", "float_id", "extraction_method", "data_quality_score", "parquet_path",
           "updated_at", "seq"]


@query
def upsert_catalog(spark, sf):
    return cat.upsert_catalog(*_old_and_batch(spark, sf)).select(*_UPSERT)


@query
def upsert_catalog_all_columns(spark, sf):
    return cat.upsert_catalog(*_old_and_batch(spark, sf), variant="ultra").select(*_UPSERT)


@query
def insert_ignore(spark, sf):
    return cat.insert_ignore(*_old_and_batch(spark, sf)).select(*_UPSERT)


@query
def mark_missing_levels(spark, sf):
    root = damaged(spark, sf)
    c = store.catalog(spark, root)
    gone = joins.missing_level_files(c, store.level_inventory(spark, root))
    return cat.mark_missing_levels(c, gone).select(
        "profile_id", "parquet_path", round6("data_quality_score").alias("data_quality_score"))


@query
def mark_orphans(spark, sf):
    return cat.mark_orphans(fx.catalog(spark, sf)).select(
        "profile_id", round6("data_quality_score").alias("data_quality_score"),
        F.col("raw_metadata")["status"].alias("status"))


@query
def drop_invalid_coordinates(spark, sf):
    return cat.drop_invalid_coordinates(fx.profiles(spark, sf)).select("profile_id", "lat", "lon")


@query
def default_quality(spark, sf):
    return cat.default_quality(fx.catalog(spark, sf)).select("profile_id", "data_quality_score")


@query
def prune_errors(spark, sf):
    return cat.prune_errors(fx.ingestion_errors(spark, sf), ERRORS_AS_OF, days=10)


@query
def rebuild_vectors(spark, sf):
    docs = sinks.vector_documents(fx.catalog(spark, sf).withColumn(
        "summary", summaries.summarise("rebuild")))
    return embed_text(docs).select("profile_id", "summary", "lat", "lon", "embedding")


@query
def seed_catalog(spark, sf):
    path = work_dir(spark, "seed")
    c = fx.catalog(spark, sf)
    c.select("profile_id", "float_id", "lat", "lon", "n_levels", "variables").write.json(path)
    rows = spark.read.schema("profile_id string, float_id string, lat double, lon double, "
                             "n_levels bigint, variables array<string>").json(path)
    known = fx.catalog_batches(spark, sf).select("profile_id", "seq")
    old = cat.latest_per_profile(known)
    return cat.insert_ignore(old, rows.withColumn("seq", F.lit(0).cast("bigint"))).select(
        "profile_id", "float_id", "lat", "lon", "n_levels", csv("variables").alias("variables"))


# --- streams -----------------------------------------------------------------
def _stream(spark, sf, name):
    return streams.read_stream(spark, table_path(sf, name), read_table(spark, sf, name).schema)


def land_parts(spark, sf, path):
    """Values in three parts by level and scalars in two, so that profiles spread over batches.

    Every seventh profile lacks its row count and is settled by time, which a last row far ahead drives on.
    """
    at = lambda hour: F.lit(f"2024-01-01 {hour:02d}:00:00").cast("timestamp")
    values, scalars = fx.raw_values(spark, sf), fx.raw_scalars(spark, sf)
    counts = values.select(*nm.PROFILE_KEYS).unionByName(scalars.select(*nm.PROFILE_KEYS)).groupBy(*nm.PROFILE_KEYS).agg(
        F.count("*").cast("string").alias("value"))
    told = counts.where("profile_key % 7 <> 0").withColumns({"name": F.lit(streams.ROW_COUNT), "dtype": F.lit("int64")})
    beat = spark.range(1).select(F.lit("heartbeat").alias("source_file"), F.lit(-1).cast("bigint").alias("profile_key"),
                                 F.lit("beat").alias("name"), F.lit("").alias("value"), F.lit("str").alias("dtype"),
                                 F.lit("2024-02-01").cast("timestamp").alias("landed_at"))
    for part in range(3):
        rows = values.where(F.col("level_idx") % 3 == part).withColumn("landed_at", at(part))
        rows.repartition(4, *rows.columns).write.mode("append").parquet(f"{path}/values")
    half = F.xxhash64("name") % 2 == 0
    first = scalars.where(half).withColumn("landed_at", at(0))
    rest = scalars.where(~half).unionByName(told.select(scalars.columns)).withColumn("landed_at", at(2))
    for rows in (first, rest, beat.select(rest.columns)):
        rows.repartition(4, *rows.columns).write.mode("append").parquet(f"{path}/scalars")


@query
def stream_ingest(spark, sf):
    """Profiles that arrive over several batches of two streams, each judged once."""
    path = work_dir(spark, "landing")
    land_parts(spark, sf, path)
    resolved = stored(nm.resolve_variables(fx.raw_variables(spark, sf)), "resolved")

    def judge(facts, scalars):
        return nm.assemble_profiles(nm.resolve_coordinates(scalars), nm.standard_facts(facts, resolved)).withColumn(
            "reject_reason", quality.reject_reason())

    parts = [streams.read_stream(spark, f"{path}/{kind}", spark.read.parquet(f"{path}/{kind}").schema, max_files=4)
             for kind in ("values", "scalars")]
    accepted, rejected = streams.stream_ingest(streams.profile_events(*parts), work_dir(spark, "ingest"), judge)
    cols = ["profile_id", "float_id", "lat", "lon", "time_start"]
    return accepted.select(*cols, F.lit("accepted").alias("reason")).unionByName(
        rejected.select(*cols, F.col("reject_reason").alias("reason")))


@query
def stream_upsert(spark, sf):
    changes = fx.project(_stream(spark, sf, "events"), fx.BATCH_COLUMNS)
    return streams.stream_upsert(changes, work_dir(spark, "upsert"))


@query
def stream_upsert_catalog(spark, sf):
    """The change stream merged into an existing catalogue, in batches of few files."""
    old, batch = _old_and_batch(spark, sf)
    path = work_dir(spark, "changes")
    batch.repartition(6).write.parquet(path)
    changes = streams.read_stream(spark, path, batch.schema, max_files=2)
    return streams.stream_upsert_catalog(changes, old, work_dir(spark, "upsert")).select(*_UPSERT)


@query
def stream_error_rates(spark, sf):
    def errors():
        return fx.project(_stream(spark, sf, "events").filter("event_type = 'error'"),
                           fx.ERROR_COLUMNS)

    day = streams.stream_error_rates(errors(), work_dir(spark, "rates"), "1 day")
    slide = streams.stream_error_rates(errors(), work_dir(spark, "rates"), "1 day", "6 hours")
    return day.withColumn("kind", F.lit("tumbling")).unionByName(
        slide.withColumn("kind", F.lit("sliding")))


@query
def stream_dedupe(spark, sf):
    changes = fx.project(_stream(spark, sf, "events"), fx.BATCH_COLUMNS)
    return streams.stream_dedupe(changes, work_dir(spark, "dedupe")).select("profile_id")


# --- composite queries -------------------------------------------------------
@query
def geo_search(spark, sf):
    return questions.geo_search(fx.vector_corpus(spark, sf), fx.query_vectors(spark, sf))


@query
def constrained_search(spark, sf):
    return questions.constrained_search(fx.vector_corpus(spark, sf), fx.query_vectors(spark, sf),
                                        CATALOG_AS_OF)


@query
def smart_search(spark, sf):
    return questions.smart_search(fx.vector_corpus(spark, sf), fx.query_vectors(spark, sf),
                                  CATALOG_AS_OF)


@query
def prefilter_search(spark, sf):
    return questions.prefilter_search(fx.vector_corpus(spark, sf), fx.query_vectors(spark, sf),
                                      CATALOG_AS_OF)


@query
def answer_summary(spark, sf):
    results = questions.geo_search(fx.vector_corpus(spark, sf), fx.query_vectors(spark, sf))
    return questions.answer_summary(fx.query_log(spark, sf), results, fx.catalog(spark, sf))


@query
def health_issues(spark, sf):
    return health.health_issues(fx.catalog(spark, sf), fx.ingestion_errors(spark, sf),
                                level_listing(spark, sf), fx.vectors(spark, sf), ERRORS_AS_OF)


@query
def health_recommendations(spark, sf):
    return health.recommendations(health.health_issues(
        fx.catalog(spark, sf), fx.ingestion_errors(spark, sf), level_listing(spark, sf),
        fx.vectors(spark, sf), ERRORS_AS_OF))


@query
def health_report(spark, sf):
    path = work_dir(spark, "health")
    report = health.health_report(fx.catalog(spark, sf), fx.ingestion_errors(spark, sf),
                                  level_listing(spark, sf), fx.vectors(spark, sf), ERRORS_AS_OF)
    sinks.write_report(report, path)
    return spark.read.schema("section string, name string, value double").json(path)


def broken_catalog(spark, sf):
    """The catalogue with rows entered twice, many paths lost, and some level files gone."""
    c = fx.catalog(spark, sf).withColumns({
        "seq": F.col("id"), "parquet_path": F.when(F.col("id") % 7 != 0, F.col("parquet_path")),
        "raw_metadata": F.create_map(F.lit("file"), F.col("source_file"))})
    twice = c.where("id % 50 = 0").withColumns({"seq": F.col("seq") + 10**9, "data_quality_score": F.lit(None).cast("double")})
    listing = level_listing(spark, sf).where(F.regexp_extract("path", "P([0-9]+)", 1).cast("bigint") % 17 != 0)
    return c.unionByName(twice), listing


@query
def repair_catalog(spark, sf):
    """Check a broken catalogue, plan its repairs, apply them, and give the next version."""
    broken, listing = broken_catalog(spark, sf)
    broken = stored(broken, "broken")
    issues = health.health_issues(broken, fx.ingestion_errors(spark, sf), listing, fx.vectors(spark, sf), ERRORS_AS_OF)
    plan = health.repair_plan(stored(issues, "issues"))
    fixed = health.repair_catalog(broken, joins.missing_level_files(broken, listing), plan)
    return fixed.select("profile_id", "seq", "parquet_path", round6("data_quality_score").alias("data_quality_score"),
                        F.col("raw_metadata")["status"].alias("status"))


@query
def repair_plan(spark, sf):
    broken, listing = broken_catalog(spark, sf)
    return health.repair_plan(health.health_issues(broken, fx.ingestion_errors(spark, sf), listing, fx.vectors(spark, sf), ERRORS_AS_OF))


def _run(spark, sf):
    return ing.ingest(fx.raw_values(spark, sf), fx.raw_scalars(spark, sf),
                      fx.raw_variables(spark, sf))


_STORE_COLUMNS = ["profile_id", "float_id", "lat", "lon", "time_start", "n_levels", "variables_csv", "data_quality_score"]


def shown(catalog: DataFrame, *more) -> DataFrame:
    return catalog.select(*_STORE_COLUMNS, *more).withColumnRenamed("variables_csv", "variables")


@query
def ingest_catalog(spark, sf):
    """End to end: publish a whole run, then read the current catalogue back."""
    root = work_dir(spark, "store")
    ing.publish(_run(spark, sf), root, CATALOG_AS_OF, run_id=0)
    return shown(store.catalog(spark, root))


def _part(spark, sf, rows: Column):
    return ing.ingest(fx.raw_values(spark, sf).where(rows), fx.raw_scalars(spark, sf).where(rows),
                      fx.raw_variables(spark, sf))


def two_runs(spark, sf, root):
    """Publish the files of even and of odd number as two runs, and the second one twice, as a retry would."""
    for run_id in (0, 1, 1):
        ing.publish(_part(spark, sf, F.col("profile_key") % 2 == run_id), root, CATALOG_AS_OF, run_id=run_id)


def late_retry(spark, sf, root):
    """Run 0 fails half-way and is tried again only after run 1."""
    key = F.col("profile_key")
    ing.publish(_part(spark, sf, (key % 2 == 0) & (key % 3 == 0)), root, CATALOG_AS_OF, run_id=0)
    ing.publish(_part(spark, sf, key % 2 == 1), root, CATALOG_AS_OF, run_id=1)
    store.compact(spark, root)
    ing.publish(_part(spark, sf, key % 2 == 0), root, CATALOG_AS_OF, run_id=0)


def _with_parts(spark, root):
    has = lambda name, flag: store.owned_table(spark, root, name).select("profile_id").distinct().withColumn(
        flag, F.lit(True))
    rows = store.catalog(spark, root).join(has("levels", "has_levels"), "profile_id", "left").join(
        has("vectors", "has_vector"), "profile_id", "left")
    return shown(rows, F.coalesce("has_levels", F.lit(False)).alias("has_levels"),
                 F.coalesce("has_vector", F.lit(False)).alias("has_vector"))


@query
def ingest_two_runs(spark, sf):
    """Two runs and a retry give the catalogue of one run, every row with its levels and its vector."""
    root = work_dir(spark, "store")
    two_runs(spark, sf, root)
    return _with_parts(spark, root)


@query
def ingest_late_retry(spark, sf):
    """A retry of the older run, after a newer one and a compaction, gives the catalogue of one run."""
    root = work_dir(spark, "store")
    late_retry(spark, sf, root)
    return _with_parts(spark, root)


@query
def ingest_incremental(spark, sf):
    """Two drops, a run that finds nothing new, and one that takes a changed drop again.

    The changed drop lost the values of every third profile, which leave the catalogue with it.
    """
    landing_dir, root = work_dir(spark, "landing"), work_dir(spark, "store")
    first = inc_drop(spark, sf, landing_dir, 0)
    runs = [inc.ingest_new(spark, landing_dir, root, CATALOG_AS_OF, 0, routed=False)]
    inc_drop(spark, sf, landing_dir, 1)
    runs.append(inc.ingest_new(spark, landing_dir, root, CATALOG_AS_OF, 1, routed=False))
    runs.append(inc.ingest_new(spark, landing_dir, root, CATALOG_AS_OF, 2, routed=False))
    fx.raw_values(spark, sf).where("profile_key % 2 = 0 AND profile_key % 3 <> 0").write.mode("overwrite").parquet(f"{first}/values")
    runs.append(inc.ingest_new(spark, landing_dir, root, CATALOG_AS_OF, 3, routed=False))
    idle = F.lit(runs[2] is None)
    return shown(store.catalog(spark, root), F.col("run").cast("bigint").alias("run"), idle.alias("idle_when_nothing_is_new"))


def inc_drop(spark, sf, landing_dir, parity):
    """Land the files of one parity as a drop."""
    path, rows = f"{landing_dir}/drop=d{parity}", F.col("profile_key") % 2 == parity
    fx.raw_values(spark, sf).where(rows).write.parquet(f"{path}/values")
    fx.raw_scalars(spark, sf).where(rows).write.parquet(f"{path}/scalars")
    fx.raw_variables(spark, sf).where(fx.file_number() % 2 == parity).write.parquet(f"{path}/variables")
    return path


def degraded_run(spark, sf):
    values, scalars, files = degraded(spark, sf)
    n = fx.file_number()
    variables = fx.raw_variables(spark, sf).withColumns({
        "var_name": F.when(n % 10 == 3, F.concat(F.lit("x-"), F.col("var_name"))).otherwise(F.col("var_name")),
        "source_file": F.when(n % 10 == 7, F.concat(F.lit("batch_"), n.cast("string"), F.lit("_12.5N_65W.nc")))
        .otherwise(F.col("source_file"))})
    return routing.ingest_routed(values, scalars, variables, files)


@query
def ingest_with_fallback(spark, sf):
    """Degraded files, each by the first strategy that yields something, through one ingest."""
    return degraded_run(spark, sf).judged.select(
        "profile_id", "lat", "lon", "n_levels", "variables_csv", "extraction_method", "data_quality_score",
        F.coalesce("reject_reason", F.lit("accepted")).alias("reason"))


@query
def ingest_fallback_values(spark, sf):
    """What the strategies read: values per profile and name, standard or not."""
    run = degraded_run(spark, sf).stored()
    names = [n.lower() for n in nm.STANDARD_NAMES]
    long = run.levels.select("profile_id", F.inline(F.array(*[
        F.struct(F.lit(n.upper()).alias("name"), F.col(n).alias("value")) for n in names])))
    other = run.extra_values.select("profile_id", F.col("var_name").alias("name"), "value")
    return long.unionByName(other).where("value IS NOT NULL").groupBy("profile_id", "name").agg(
        F.count("*").alias("n_values"), F.min("value").alias("least"), F.max("value").alias("greatest"))


@query
def ingest_methods(spark, sf):
    """Profiles and mean score by the strategy that took them."""
    return stats.method_stats(degraded_run(spark, sf).profiles)


# --- the published store ------------------------------------------------------
_STORES: dict = {}


def _once(spark, sf, build):
    """The root of a store that ``build`` fills, written once per application: an input of the queries."""
    key = (spark.sparkContext.applicationId, sf, build.__name__)
    if key not in _STORES:
        root = work_dir(spark, "store")
        build(spark, sf, root)
        _STORES[key] = root
    return _STORES[key]


def published(spark, sf):
    return _once(spark, sf, two_runs)


def damaged(spark, sf):
    return _once(spark, sf, damage)


def damage(spark, sf, root):
    """A store of two runs of which a bucket of levels is lost and the files of another one are cut short."""
    two_runs(spark, sf, root)
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = files.Path(store.part_of(store.live(spark, root)[1], "levels"))
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(files.Path(folder, "float_bucket=3"), True)
    parts = [s.getPath() for s in fs.listStatus(files.Path(folder, "float_bucket=7")) if s.getPath().getName().endswith(".parquet")]
    for part in parts:
        out = fs.create(part, True)
        out.write(0)
        out.close()


@query
def store_metrics(spark, sf):
    return stats.catalog_metrics(store.catalog(spark, published(spark, sf)), CATALOG_AS_OF)


@query
def store_overview(spark, sf):
    return stats.overview_metrics(store.catalog(spark, published(spark, sf)))


@query
def store_collection(spark, sf):
    return stats.collection_summary(store.catalog(spark, published(spark, sf)))


@query
def store_depth_series(spark, sf):
    root = published(spark, sf)
    return stats.depth_series(store.catalog(spark, root), store.owned_table(spark, root, "levels"))


@query
def store_groups(spark, sf):
    """Published profiles by parameter group, and the words for their variables."""
    rows = store.catalog(spark, published(spark, sf)).select("profile_id", "variables", "variables_csv")
    parts = [filters.variables_contain(rows, group=g).withColumn("rule", F.lit(g)) for g in ("core", "bgc", "nutrients")]
    found = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return found.select("profile_id", "rule", csv(text.parameter_phrases("variables_csv")).alias("phrases"))


@query
def store_health(spark, sf):
    """The checks over a store with damaged levels, its own errors and vectors."""
    root = damaged(spark, sf)
    return health.health_issues(store.catalog(spark, root), store.errors(spark, root), store.level_inventory(spark, root),
                                store.owned_table(spark, root, "vectors"), CATALOG_AS_OF)


@query
def ingest_levels(spark, sf):
    return _run(spark, sf).levels.select("profile_id", "float_id", "level_idx", "temperature",
                                         "salinity", "pressure", "oxygen")


@query
def ingest_region_stats(spark, sf):
    """The flagship: normalise everything, then the statistics by region."""
    return stats.region_stats(_run(spark, sf).profiles)
