"""Fixed values of the domain, and their use as small tables.

Every table here has a size fixed by this file, so joining one by broadcast is
always safe. They are built as SQL VALUES, which gives Catalyst exact sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: measurement names and their variants, in search order -----
VARIABLE_ALIASES = {
    "temperature": ["TEMP", "TEMPERATURE", "TEMP_ADJUSTED", "TEMP_QC", "temp", "temperature",
                    "T", "THETA", "POTENTIAL_TEMPERATURE", "SEA_WATER_TEMPERATURE",
                    "TEMP_DOXY", "TEMP_CNDC", "TEMP_ADJUSTED_QC", "TEMP_dPRES"],
    "salinity": ["PSAL", "SALINITY", "PSAL_ADJUSTED", "PSAL_QC", "psal", "salinity", "sal",
                 "S", "PRACTICAL_SALINITY", "SEA_WATER_PRACTICAL_SALINITY",
                 "PSAL_ADJUSTED_QC", "PSAL_dPRES"],
    "pressure": ["PRES", "PRESSURE", "PRES_ADJUSTED", "pres", "pressure", "depth", "DEPTH",
                 "P", "SEA_WATER_PRESSURE", "PRES_QC", "PRES_ADJUSTED_QC"],
    "oxygen": ["DOXY", "OXYGEN", "DOXY_ADJUSTED", "doxy", "oxygen", "O2",
               "DISSOLVED_OXYGEN", "DOXY_QC", "DOXY_ADJUSTED_QC"],
    "chlorophyll": ["CHLA", "CHLOROPHYLL", "CHLA_ADJUSTED", "chla", "chlorophyll", "CHL",
                    "CHLOROPHYLL_A", "CHLA_QC", "CHLA_ADJUSTED_QC"],
    "nitrate": ["NITRATE", "NO3", "nitrate", "no3", "NITRATE_QC", "NITRATE_ADJUSTED",
                "NITRATE_ADJUSTED_QC"],
    "ph": ["PH_IN_SITU_TOTAL", "PH", "ph", "pH", "PH_IN_SITU_TOTAL_QC",
           "PH_IN_SITU_TOTAL_ADJUSTED", "PH_IN_SITU_TOTAL_ADJUSTED_QC"],
    "turbidity": ["TURBIDITY", "turbidity", "TURB", "TURBIDITY_QC",
                  "TURBIDITY_ADJUSTED", "TURBIDITY_ADJUSTED_QC"],
    "conductivity": ["CNDC", "CONDUCTIVITY", "conductivity", "CNDC_QC",
                     "CNDC_ADJUSTED", "CNDC_ADJUSTED_QC"],
}
# the shorter rule set knows eight names
SHORT_RULESET_NAMES = ["temperature", "salinity", "pressure", "oxygen", "chlorophyll",
                       "nitrate", "ph", "turbidity"]

COORDINATE_ALIASES = {
    "latitude": ["LATITUDE", "latitude", "lat", "LAT", "LATITUDE_DEGREES",
                 "LATITUDE_DM", "latitude_dm", "lats", "Latitude"],
    "longitude": ["LONGITUDE", "longitude", "lon", "LON", "LONGITUDE_DEGREES",
                  "LONGITUDE_DM", "longitude_dm", "lons", "Longitude"],
    "time": ["JULD", "TIME", "time", "DATE_TIME", "DATE", "REFERENCE_DATE_TIME",
             "JULD_QC", "JULD_LOCATION", "TIME_QC", "times"],
    "platform": ["PLATFORM_NUMBER", "platform_number", "FLOAT_ID", "float_id",
                 "WMO_INST_TYPE", "PLATFORM_TYPE", "platform_type"],
}
INSTRUMENT_TYPE_NAMES = ["WMO_INST_TYPE", "PLATFORM_TYPE", "platform_type"]

# --- fixed values: dimension names, in search order --------------------------
PROFILE_DIMS = {
    "robust": ["N_PROF", "N_PROFILES", "profile", "PROFILE"],
    "ultra": ["N_PROF", "N_PROFILES", "profile"],
    "optimized": ["N_PROF", "profile", "PROFILE"],
}
LEVEL_DIMS = ["N_LEVELS", "N_LEVEL", "level", "LEVEL", "depth", "DEPTH"]

# --- fixed values: named boxes (name, lat_min, lat_max, lon_min, lon_max) ----
REGIONS = {
    "base": [
        ("arabian sea", 10, 25, 50, 75),
        ("bay of bengal", 5, 22, 80, 100),
        ("equator", -10, 10, -180, 180),
        ("equatorial", -5, 5, -180, 180),
        ("tropical", -23.5, 23.5, -180, 180),
        ("atlantic", -60, 70, -80, 20),
        ("pacific", -60, 70, 120, -70),
        ("mediterranean", 30, 46, -6, 42),
        ("indian ocean", -40, 25, 20, 120),
    ],
    "enhanced": [
        ("arabian sea", 10, 25, 50, 75),
        ("bay of bengal", 5, 22, 80, 100),
        ("indian ocean", -40, 25, 20, 120),
        ("atlantic", -60, 70, -80, 20),
        ("pacific", -60, 70, 120, -70),
        ("mediterranean", 30, 46, -6, 42),
        ("equator", -10, 10, -180, 180),
        ("tropical", -23.5, 23.5, -180, 180),
        ("north atlantic", 0, 70, -80, 20),
        ("south atlantic", -60, 0, -70, 20),
    ],
    "config": [
        ("equatorial_pacific", -5, 5, -180, -80),
        ("equatorial_atlantic", -5, 5, -50, 20),
        ("equatorial_indian", -5, 5, 40, 120),
        ("arabian_sea", 8, 27, 50, 80),
        ("bay_of_bengal", 5, 25, 80, 100),
        ("mediterranean", 30, 46, -6, 37),
        ("north_atlantic", 40, 70, -80, 20),
        ("south_atlantic", -60, -20, -70, 20),
        ("north_pacific", 20, 70, 120, -120),
        ("south_pacific", -60, -20, 120, -70),
        ("southern_ocean", -70, -45, -180, 180),
    ],
}

# --- fixed values: seasons and parameter groups ------------------------------
SEASON_MONTHS = {
    "spring": [3, 4, 5],
    "summer": [6, 7, 8],
    "autumn": [9, 10, 11],
    "fall": [9, 10, 11],
    "winter": [12, 1, 2],
}
SEASON_WORDS = ["summer", "winter", "monsoon", "spring"]

PARAMETER_GROUPS = {
    "core": ["TEMP", "PSAL", "PRES"],
    "bgc": ["DOXY", "NITRATE", "PHOSPHATE", "SILICATE", "PH", "CHLA"],
    "physical": ["TEMP", "PSAL", "PRES", "CNDC"],
    "biogeochemical": ["DOXY", "NITRATE", "PHOSPHATE", "SILICATE", "PH", "CHLA", "BBP", "CDOM"],
    "carbon": ["PH", "ALKALINITY", "DIC", "PCO2"],
    "nutrients": ["NITRATE", "PHOSPHATE", "SILICATE"],
    "optics": ["CHLA", "BBP", "CDOM", "DOWNWELLING_PAR"],
}

# --- fixed values: words that put a question in or out of scope --------------
OCEAN_WORDS = [
    "ocean", "argo", "float", "profile", "temperature", "salinity", "oxygen", "temp", "psal",
    "doxy", "depth", "sea", "marine", "water", "atlantic", "pacific", "indian", "southern",
    "equatorial", "thermocline", "chlorophyll", "nitrate", "silicate", "ph", "conductivity",
    "pressure", "oceanographic", "hydrographic", "biogeochemical", "upwelling", "downwelling",
    "current", "gyre", "mixed layer", "halocline", "pycnocline", "water mass", "deep water",
    "surface", "antarctic", "arctic", "tropical", "subtropical", "polar", "coastal", "offshore",
    "buoyancy", "density", "oxygen minimum", "nutrients",
]
GENERIC_WORDS = ["float", "profile", "measurement", "data", "analysis", "depth", "level"]
OFF_TOPIC_WORDS = [
    "weather", "rain", "snow", "tornado", "hurricane", "land", "forest", "mountain", "desert",
    "politics", "economy", "sports", "entertainment", "movie", "music", "food", "restaurant",
    "car", "plane", "train", "computer", "software", "programming", "business", "finance",
    "health", "medicine", "doctor", "hospital", "school", "education", "university",
    "shopping", "clothes", "fashion", "travel", "hotel", "vacation", "tourism",
]

# --- fixed values: numbers ---------------------------------------------------
EARTH_RADIUS_KM = 6371.0
POINT_BOX_DEGREES = 5.0
RELEVANCE_SCALE_KM = {"base": 2000.0, "enhanced": 1000.0}
SEARCH_RADIUS_DEGREES = 2.0
QUALITY_HIGH, QUALITY_MEDIUM = 0.8, 0.5
NO_DATA_SCORE = 0.1
KEY_VARIABLES = ["TEMPERATURE", "SALINITY", "PRESSURE"]
MIN_LEVELS, MAX_AGE_YEARS, MAX_FILE_MB = 5, 30, 500
FIELD_LENGTHS = {"float_id": 50, "profile_id": 100, "source_file": 255, "extraction_method": 50}
FILE_PATTERNS = {
    "basic": ["nc", "NC", "netcdf", "NETCDF"],
    "robust": ["nc", "NC", "netcdf", "NETCDF", "cdf", "CDF"],
    "full": ["nc", "NC", "netcdf", "NETCDF", "nc4", "NC4", "cdf", "CDF", "hdf", "HDF",
             "h5", "H5"],
}
# health limits
ERRORS_24H_WARN, ERRORS_24H_HIGH, ERRORS_PER_TYPE = 10, 50, 20
ORPHAN_LIMIT, MISMATCH_LIMIT, LOW_QUALITY = 0.1, 0.1, 0.3

# --- fixed values: advice per issue type, and per count of severities --------
RECOMMENDATIONS = {
    "high_error_rate_24h": "High error rate detected - review recent NetCDF files for corruption",
    "corrupt_parquet_files": "Corrupt parquet files found - run cleanup and re-ingestion",
    "embedding_db_mismatch": "Embedding sync issue - consider rebuilding embeddings",
    "low_average_quality": "Low data quality detected - review source files and parsing logic",
}
SEVERITY_ADVICE = {
    "critical": "CRITICAL: Address database connectivity and schema issues immediately",
    "moderate": "Multiple moderate issues detected - consider running full system cleanup",
    "none": "System appears healthy - continue regular monitoring",
}
MODERATE_ISSUES_LIMIT = 3


def is_quality_flag(variant: str) -> bool:
    """QC columns and derivative columns are not measurements."""
    return variant.endswith("_QC") or variant.endswith("_dPRES")


def alias_rows(exclude_qc: bool = True, names: list[str] | None = None) -> list[tuple]:
    """(kind, std_name, variant, priority); priority is the place in the list."""
    rows = []
    for kind, table in (("variable", VARIABLE_ALIASES), ("coordinate", COORDINATE_ALIASES)):
        for std, variants in table.items():
            if kind == "variable" and names is not None and std not in names:
                continue
            for priority, variant in enumerate(variants):
                if exclude_qc and (is_quality_flag(variant) or variant in INSTRUMENT_TYPE_NAMES):
                    continue
                rows.append((kind, std.upper() if kind == "variable" else std, variant, priority))
    return rows


def region_rows(ruleset: str) -> list[tuple]:
    return [(i, name, float(a), float(b), float(c), float(d))
            for i, (name, a, b, c, d) in enumerate(REGIONS[ruleset])]


def _literal(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, float):
        return f"{value!r}" if "e" in repr(value) else f"{value!r}e0"
    return str(value)


def values_sql(rows: list[tuple]) -> str:
    """Rows as a VALUES list that Spark and other SQL engines read alike."""
    return "VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)


def table(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM ({values_sql(rows)}) AS t({columns})")


def aliases(spark: SparkSession, kind: str, exclude_qc: bool = True,
            names: list[str] | None = None) -> DataFrame:
    rows = [r[1:] for r in alias_rows(exclude_qc, names) if r[0] == kind]
    return table(spark, rows, "std_name, variant, priority")


def upper_alias_rows() -> list[tuple]:
    """Upper-cased variant -> standard name; the first name in order wins."""
    seen: dict[str, str] = {}
    for kind, std, variant, _ in alias_rows(exclude_qc=False):
        if kind == "variable":
            seen.setdefault(variant.upper(), std)
    return list(seen.items())


def group_names(group: str) -> list[str]:
    """Variables of a parameter group, by their own and by their standard names."""
    known, names = dict(upper_alias_rows()), PARAMETER_GROUPS[group]
    return list(dict.fromkeys([*names, *(known[n] for n in names if n in known)]))


def regions(spark: SparkSession, ruleset: str = "base") -> DataFrame:
    return table(spark, region_rows(ruleset), "priority, name, lat_min, lat_max, lon_min, lon_max")


def seasons(spark: SparkSession) -> DataFrame:
    rows = [(s, m) for s, months in SEASON_MONTHS.items() for m in months]
    return table(spark, rows, "season, month")


def parameter_groups(spark: SparkSession) -> DataFrame:
    rows = [(g, v) for g, vs in PARAMETER_GROUPS.items() for v in vs]
    return table(spark, rows, "param_group, variable")
