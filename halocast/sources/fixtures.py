"""Ocean-shaped tables projected from the given tables.

The expressions are plain SQL that other engines read as well; the oracle
builds the same tables from the same text. Each projection covers its whole
source table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from halocast.operators.ordering import dense_index
from halocast.session import stored, work_dir
from halocast.sources.tables import read_table

LAT = ("CASE WHEN o_orderkey % 211 = 0 THEN NULL WHEN o_orderkey % 223 = 0 THEN 95e0 "
       "ELSE CAST((o_orderkey * 7919) % 18001 AS DOUBLE) / 1e2 - 9e1 END")
LON = ("CASE WHEN o_orderkey % 227 = 0 THEN NULL "
       "ELSE CAST((o_orderkey * 104729) % 36001 AS DOUBLE) / 1e2 - 18e1 END")
SOURCE_FILE = "concat('batch_', CAST({key} % 500 AS STRING), '.nc')"

PROFILE_COLUMNS = {
    "id": "o_orderkey",
    "profile_id": "concat('P', CAST(o_orderkey AS STRING))",
    "float_id": "concat('F', CAST(o_custkey AS STRING))",
    "source_file": SOURCE_FILE.format(key="o_orderkey"),
    "lat": LAT,
    "lon": LON,
    "time_start": "CASE WHEN o_orderkey % 229 = 0 THEN NULL ELSE o_orderdate END",
    "variables_csv": (
        "concat('TEMP,PSAL', CASE WHEN o_orderkey % 2 = 0 THEN ',DOXY' ELSE '' END, "
        "CASE WHEN o_orderkey % 3 = 0 THEN ',CHLA' ELSE '' END, "
        "CASE WHEN o_orderkey % 5 = 0 THEN ',NITRATE' ELSE '' END)"),
    "extraction_method": "o_orderpriority",
    "parquet_path": ("CASE WHEN o_orderkey % 13 = 0 THEN NULL "
                     "ELSE concat('store/P', CAST(o_orderkey AS STRING), '.parquet') END"),
}

LEVEL_COLUMNS = {
    "profile_id": "concat('P', CAST(l_orderkey AS STRING))",
    "pres": "CAST(l_partkey % 2001 AS DOUBLE)",
    "temp": "CASE WHEN l_suppkey % 17 = 0 THEN NULL ELSE l_quantity / 2e0 END",
    "psal": "CASE WHEN l_suppkey % 19 = 0 THEN NULL ELSE 34e0 + l_discount * 1e1 END",
    "doxy": "CASE WHEN l_returnflag = 'N' THEN NULL ELSE 1e2 + l_tax * 1e3 END",
}

# naming convention by (profile key mod 4), one name per standard variable
RAW_NAMES = {
    "TEMPERATURE": ["TEMP", "TEMPERATURE", "TEMP_ADJUSTED", "temp"],
    "SALINITY": ["PSAL", "SALINITY", "PSAL_ADJUSTED", "sal"],
    "PRESSURE": ["PRES", "PRESSURE", "PRES_ADJUSTED", "depth"],
    "OXYGEN": ["DOXY", None, "DOXY_ADJUSTED", None],
}
RAW_VALUES = {
    "TEMPERATURE": ("CASE WHEN l_suppkey % 17 <> 0 THEN l_quantity / 2e0 "
                    "WHEN l_suppkey % 34 = 0 THEN CAST('NaN' AS DOUBLE) END"),
    "SALINITY": "CASE WHEN l_suppkey % 19 <> 0 THEN 34e0 + l_discount * 1e1 END",
    "PRESSURE": "CAST(l_partkey % 2001 AS DOUBLE)",
    "OXYGEN": "CASE WHEN l_returnflag <> 'N' THEN 1e2 + l_tax * 1e3 END",
}
LEVEL_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice",
               "l_quantity"]

SCALAR_NAMES = {
    "latitude": ["LATITUDE", "latitude", "lat", "LAT"],
    "longitude": ["LONGITUDE", "longitude", "lon", "LON"],
    "time": ["JULD", "TIME", "time", "DATE_TIME"],
    "platform": ["PLATFORM_NUMBER", "platform_number", "FLOAT_ID", "float_id"],
}

ERROR_COLUMNS = {
    "id": "event_id",
    "file_path": "concat('batch_', CAST(user_id AS STRING), '.nc')",
    "error_type": ("CASE WHEN value < 5e0 THEN 'NO_PROFILES' WHEN value < 2e1 "
                   "THEN 'CRITICAL_ERROR' ELSE 'PARSE_ERROR' END"),
    "occurred_at": "ts",
}
BATCH_COLUMNS = {
    "seq": "event_id",
    "profile_id": "concat('P', CAST(user_id AS STRING))",
    "updated_at": "ts",
    "extraction_method": "event_type",
    "data_quality_score": "value / 1e2",
}

# phrases appended to the users' turns, so that a text log holds ocean questions
QUERY_PHRASES = [
    "temperature in Atlantic",
    "salinity profiles in the North Atlantic from last 6 months",
    "oxygen near the equator in 2000",
    "float data around 12.5N, 65E",
    "monsoon chlorophyll in the Arabian Sea",
    "nitrate in the Pacific past year",
    "ocean measurements",
    "equatorial water temperature during summer",
    "carbon content of deep water in the South Atlantic",
    "arctic profiles of iceland 2001",
    "weather and hotel near the sea",
    "temperature at 30S 20W last 3 months",
    "bay of bengal salinity in winter 1999",
    "Mediterranean float 2000",
    "what is the best restaurant",
    "salinity data",
    "tropical oxygen minimum at 5.25°N 100.5°E",
    "indian ocean spring bloom past 6 months",
    "pH and phone numbers",
    "deep profile below 1000m last year",
]


def project(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{expr} AS {name}" for name, expr in columns.items()])


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = project(read_table(spark, sf_dir, "orders"), PROFILE_COLUMNS)
    return df.withColumn("variables", F.split("variables_csv", ","))


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(read_table(spark, sf_dir, "lineitem"), LEVEL_COLUMNS)


def level_facts(lv: DataFrame) -> DataFrame:
    """Per profile: level count, deepest level and completeness."""
    measured = sum((F.count(c) for c in ("pres", "temp", "psal", "doxy")), F.lit(0))
    return lv.groupBy("profile_id").agg(
        F.count(F.lit(1)).alias("n_levels"),
        F.max("pres").alias("max_depth"),
        F.round(measured / (F.count(F.lit(1)) * 4), 6).alias("data_quality_score"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles with the facts computed from their levels."""
    facts = level_facts(levels(spark, sf_dir))
    return (
        profiles(spark, sf_dir).join(facts, "profile_id", "left")
        .withColumn("n_levels", F.coalesce("n_levels", F.lit(0)).cast("bigint"))
        .withColumn("created_at", F.col("time_start"))
    )


_LANDED: dict[tuple[str, str, str], str] = {}


def landed(spark: SparkSession, sf_dir: str, name: str, build: Callable) -> DataFrame:
    """A derived landing table, written once per application and then read.

    Landing tables are inputs of every later step, so they are stored like any
    input: scans prune columns and nothing derives them twice.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key in _LANDED:
        try:
            return spark.read.parquet(_LANDED[key])
        except AnalysisException:  # the folder was cleared meanwhile
            pass
    path = work_dir(spark, f"landing-{name}")
    build(spark, sf_dir).write.parquet(path)
    _LANDED[key] = path
    return spark.read.parquet(path)


def raw_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landed(spark, sf_dir, "values", derive_raw_values)


def raw_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landed(spark, sf_dir, "variables", derive_raw_variables)


def derive_raw_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded values in long form: one row per file, profile, variable, level."""
    lines = dense_index(read_table(spark, sf_dir, "lineitem"), "l_orderkey", LEVEL_ORDER,
                        "level_idx")
    entries = []
    for std, names in RAW_NAMES.items():
        name = F.element_at(F.array(*[F.lit(n) for n in names]),
                            (F.col("l_orderkey") % 4 + 1).cast("int"))
        entries.append(F.struct(name.alias("var_name"), F.expr(RAW_VALUES[std]).alias("value")))
    return (
        lines.select(
            F.expr(SOURCE_FILE.format(key="l_orderkey")).alias("source_file"),
            F.col("l_orderkey").alias("profile_key"), "level_idx",
            F.explode(F.array(*entries)).alias("entry"),
        )
        .select("source_file", "profile_key", "entry.var_name", "level_idx", "entry.value")
        .filter(F.col("var_name").isNotNull())
    )


def scalar_rows(orders: DataFrame) -> DataFrame:
    """Per-profile scalars as text, named by four conventions."""
    key = F.col("o_orderkey")
    days = F.datediff("o_orderdate", F.lit("1950-01-01").cast("date")).cast("string")
    time_text = (
        F.when(key % 229 == 0, F.lit(None)).when(key % 233 == 0, F.lit("junk"))
        .when(key % 4 == 0, days).when(key % 4 == 1, F.concat(days, F.lit(".5")))
        .when(key % 4 == 2, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    )
    platform = (
        F.when(key % 239 == 0, "nan").when(key % 241 == 0, " ")
        .otherwise(F.concat(F.lit("F"), F.col("o_custkey").cast("string"), F.lit("  ")))
    )
    decimal_text = {
        "latitude": F.expr(f"CAST(CAST({LAT} AS DECIMAL(9,2)) AS STRING)"),
        "longitude": F.expr(f"CAST(CAST({LON} AS DECIMAL(9,2)) AS STRING)"),
    }
    values = {**decimal_text, "time": time_text, "platform": platform}
    entries = []
    for kind, names in SCALAR_NAMES.items():
        name = F.element_at(F.array(*[F.lit(n) for n in names]), (key % 4 + 1).cast("int"))
        numeric = key % 4 < 2 if kind == "time" else F.lit(kind != "platform")
        entries.append(F.struct(name.alias("name"), values[kind].alias("value"),
                                F.when(numeric, "float64").otherwise("str").alias("dtype")))
    # an instrument type that must never be taken for a platform number
    entries.append(F.struct(F.when(key % 6 == 0, "WMO_INST_TYPE").alias("name"),
                            F.lit("846").alias("value"), F.lit("str").alias("dtype")))
    return (
        orders
        .select(F.expr(SOURCE_FILE.format(key="o_orderkey")).alias("source_file"),
                key.alias("profile_key"), F.explode(F.array(*entries)).alias("entry"))
        .select("source_file", "profile_key", "entry.name", "entry.value", "entry.dtype")
        .filter(F.col("name").isNotNull())
    )


def raw_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scalar_rows(read_table(spark, sf_dir, "orders"))


def file_number(col: str = "source_file"):
    return F.regexp_extract(col, "([0-9]+)", 1).cast("int")


def file_shapes(raw: DataFrame) -> DataFrame:
    """Per file: number of profiles and of levels."""
    return raw.groupBy("source_file").agg(
        (F.floor(F.max("profile_key") / 500).cast("int") + 1).alias("n_prof"),
        (F.max("level_idx") + 1).cast("int").alias("n_lev"),
    )


def derive_raw_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variable catalogue of every file: dims, shape, dtype.

    Every fifth file stores [level, profile]; every eleventh names neither
    dimension as expected; some carry an adjusted and a flag variable too.
    """
    raw = raw_values(spark, sf_dir)
    per_var = stored(raw.groupBy("source_file", "var_name").agg(
        F.max("profile_key").alias("profile_key"), F.max("level_idx").alias("level_idx")), "per-variable")
    shapes = file_shapes(per_var)
    n = file_number()
    names = per_var.select("source_file", "var_name", F.lit("float64").alias("dtype"))
    extras = shapes.select(
        "source_file",
        F.explode(F.filter(F.array(
            F.when(n % 20 == 0, F.struct(F.lit("TEMP_ADJUSTED").alias("var_name"),
                                         F.lit("float64").alias("dtype"))),
            F.when(n % 20 == 3, F.struct(F.lit("TEMP_QC").alias("var_name"),
                                         F.lit("S1").alias("dtype"))),
            F.when(n % 7 == 0, F.struct(F.lit("SALINITY").alias("var_name"),
                                        F.lit("float32").alias("dtype"))),
        ), lambda x: x.isNotNull())).alias("e"),
    ).select("source_file", "e.var_name", "e.dtype")
    extras = extras.join(names, ["source_file", "var_name"], "left_anti")
    prof_dim = F.when(n % 11 == 0, "STATION").otherwise(
        F.element_at(F.array(*[F.lit(d) for d in ("N_PROF", "N_PROFILES", "profile", "PROFILE")]),
                     n % 4 + 1))
    lev_dim = F.when(n % 11 == 0, "Z").otherwise(
        F.element_at(F.array(*[F.lit(d) for d in ("N_LEVELS", "N_LEVEL", "level", "DEPTH")]),
                     n % 4 + 1))
    swapped = n % 5 == 1
    return names.unionByName(extras).join(shapes, "source_file").select(
        "source_file", "var_name", "dtype",
        F.when(swapped, F.array(lev_dim, prof_dim)).otherwise(F.array(prof_dim, lev_dim))
        .alias("dims"),
        F.when(swapped, F.array("n_lev", "n_prof")).otherwise(F.array("n_prof", "n_lev"))
        .alias("shape"),
    )


def flat_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by position in the flattened [profile, level] array of a variable."""
    raw = raw_values(spark, sf_dir)
    shapes = file_shapes(raw)
    prof = F.floor(F.col("profile_key") / 500)
    return raw.join(shapes, "source_file").select(
        "source_file", "var_name",
        F.when(file_number() % 5 == 1, F.col("level_idx") * F.col("n_prof") + prof)
        .otherwise(prof * F.col("n_lev") + F.col("level_idx")).cast("bigint").alias("pos"),
        "value",
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("P"), F.col("vec_id").cast("string")).alias("profile_id"),
        "vec_id", "embedding", "label")


def ingestion_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(read_table(spark, sf_dir, "events").filter("event_type = 'error'"),
                    ERROR_COLUMNS)


def catalog_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(read_table(spark, sf_dir, "events"), BATCH_COLUMNS)


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per user turn: the whole turn followed by an ocean phrase."""
    phrase = F.element_at(F.array(*[F.lit(p) for p in QUERY_PHRASES]),
                          ((F.col("conv_id") * 3 + F.col("turn")) % len(QUERY_PHRASES) + 1)
                          .cast("int"))
    turns = read_table(spark, sf_dir, "conversations").filter("role = 'user'")
    return turns.select(
        F.concat(F.lit("Q"), F.col("conv_id").cast("string"), F.lit("_"),
                 F.col("turn").cast("string")).alias("query_id"),
        "conv_id",
        F.concat(F.col("text"), F.lit(" "), phrase).alias("text"),
        ((F.col("conv_id") + F.col("turn")) % 5 + 1).cast("int").alias("k"),
        (F.col("conv_id") % 4 != 0).alias("geographic_filter"),
        (F.col("conv_id") % 3 != 0).alias("temporal_filter"),
    )


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query log with a vector per question (null where there is none)."""
    emb = read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("conv_id"), F.col("embedding").alias("query_vector"))
    return query_log(spark, sf_dir).join(emb, "conv_id", "left")


def vector_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with the catalogue columns a search filters on."""
    return vectors(spark, sf_dir).select("profile_id", "embedding").join(
        profiles(spark, sf_dir).select("profile_id", "lat", "lon", "time_start"),
        "profile_id", "left")


def search_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points to look around, one per supplier."""
    return read_table(spark, sf_dir, "supplier").selectExpr(
        "concat('S', CAST(s_suppkey AS STRING)) AS query_id",
        "CAST((s_suppkey * 3571) % 1801 AS DOUBLE) / 1e1 - 9e1 AS lat",
        "CAST((s_suppkey * 7103) % 3601 AS DOUBLE) / 1e1 - 18e1 AS lon",
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")
