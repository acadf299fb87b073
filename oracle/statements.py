"""One SQL statement per query that SQL can express on whole tables."""

from __future__ import annotations

import re

from halocast import rules
from halocast.operators.filters import DEPTH_WORDS, FACETS
from halocast.plans.registry import CATALOG_AS_OF, ERRORS_AS_OF
from halocast.sources import fixtures as fx
from oracle.base import (ANSWER_LADDER, BAND_LADDER, BASIC_LADDER, CENTER_LON, HEMISPHERE_LADDER,
                         IN_OWN_BOX, LABEL, MONTHS, POSITION, SIGNED, STATS_LADDER, YEAR,
                         alias_values, basin, constrained, haversine, mean6, point_part, r6,
                         region_lookup, sql)

S: dict[str, str] = {}
T_CAT, T_ERR = f"TIMESTAMP '{CATALOG_AS_OF}'", f"TIMESTAMP '{ERRORS_AS_OF}'"

# --- sources and sinks -------------------------------------------------------
S["read_raw"] = sql("SELECT source_file, profile_key, var_name, level_idx, value FROM raw")
S["read_profile_json"] = sql(f"""SELECT profile_id, float_id, lat, lon, time_start AS time,
 len(variables) AS n_levels, array_to_string(variables, ',') AS variables, {LABEL} AS region
 FROM profiles""")
S["write_levels"] = sql("""SELECT l.profile_id, p.float_id, pres, temp, psal, doxy
 FROM levels l JOIN profiles p USING (profile_id)
 WHERE coalesce(pres, temp, psal, doxy) IS NOT NULL""")
S["read_levels"] = sql("SELECT profile_id, pres, temp, psal, doxy FROM levels")
S["append_errors"] = sql(f"""SELECT source_file AS file_path,
 CASE WHEN reason = 'no_data' THEN 'NO_PROFILES' ELSE 'CRITICAL_ERROR' END AS error_type,
 reason AS error_message, {T_CAT} AS occurred_at FROM judged WHERE reason <> 'accepted'""")
S["write_vectors"] = """SELECT 'D' || doc_id AS profile_id, length(text) AS n_chars FROM documents
 WHERE lang <> 'fr' AND source <> 'src1' AND length(trim(text)) > 0"""
S["write_report"] = """SELECT strftime(ts, '%Y-%m-%d %H') AS report_time, count(*) AS n_events,
 count(*) FILTER (event_type = 'error') AS n_errors FROM events GROUP BY 1
 ORDER BY 1 DESC LIMIT 100"""

# --- normalisation -----------------------------------------------------------
S["resolve_variables"] = sql("SELECT source_file, std_name, var_name FROM resolved")
S["resolve_variables_short_with_qc"] = sql(f"""SELECT source_file, std_name,
 arg_min(variant, priority) AS var_name FROM var_names
 JOIN {alias_values('variable', False, rules.SHORT_RULESET_NAMES)} ON var_name = variant
 GROUP BY ALL""")
S["resolve_coordinates"] = sql(
    "SELECT source_file, profile_key, latitude, longitude, time, platform FROM coords")
_alias_upper = f"({rules.values_sql(rules.upper_alias_rows())}) AS a(up, std)"
S["map_standard_name"] = sql(f"""SELECT var_name, n, coalesce(std, CASE
 WHEN regexp_replace(upper(var_name), '[^A-Z0-9_]', '', 'g') = '' THEN 'UNKNOWN_VAR'
 ELSE regexp_replace(upper(var_name), '[^A-Z0-9_]', '', 'g') END) AS std_name
 FROM (SELECT var_name, count(*) AS n FROM (SELECT var_name FROM variables
       UNION ALL SELECT p_name FROM part) GROUP BY var_name)
 LEFT JOIN {_alias_upper} ON up = upper(var_name)""")


def _structure(ruleset: str) -> str:
    dims = rules.values_sql([(d, i) for i, d in enumerate(rules.PROFILE_DIMS[ruleset])])
    levs = rules.values_sql([(d, i) for i, d in enumerate(rules.LEVEL_DIMS)])
    big = "AND size > 1" if ruleset == "ultra" else ""
    lead = ("coalesce(arg_min(size, p.rank) FILTER (p.rank IS NOT NULL {b}), "
            "max(shape[1]) FILTER (var_name = 'TEMP'), 1)" if ruleset == "optimized"
            else "coalesce(arg_min(size, p.rank) FILTER (p.rank IS NOT NULL {b}), 1)")
    return f"""SELECT source_file, '{ruleset}' AS ruleset,
 arg_min(dim, p.rank) FILTER (p.rank IS NOT NULL {big}) AS profile_dim,
 arg_min(dim, l.rank) FILTER (l.rank IS NOT NULL) AS level_dim,
 CAST({lead.format(b=big)} AS BIGINT) AS n_profiles,
 CASE WHEN count(*) FILTER (p.rank IS NOT NULL {big}) > 0 THEN 'multi_profile'
   ELSE 'single_profile' END AS profile_structure
 FROM (SELECT *, unnest(dims) AS dim, unnest(shape) AS size FROM variables) v
 LEFT JOIN ({dims}) AS p(d, rank) ON p.d = dim LEFT JOIN ({levs}) AS l(d, rank) ON l.d = dim
 GROUP BY source_file"""


S["detect_structure"] = sql(" UNION ALL ".join(
    _structure(r) for r in ("robust", "ultra", "optimized")))
# a file that names its dimensions oddly is read as [profile, level] even where it is the
# other way round, so its flat positions fall on other pairs
S["split_profiles"] = sql("""SELECT source_file, var_name,
 CASE WHEN odd AND swapped THEN pos // n_prof ELSE profile_key // 500 END AS profile_idx,
 CASE WHEN odd AND swapped THEN pos % n_prof ELSE level_idx END AS level_idx, value
 FROM (SELECT c.*, s.n_prof, fno % 11 = 0 AS odd, fno % 5 = 1 AS swapped,
       level_idx * n_prof + profile_key // 500 AS pos
       FROM (SELECT *, CAST(regexp_extract(source_file, '([0-9]+)', 1) AS INT) AS fno
             FROM cleaned) c JOIN shapes s USING (source_file))""")
# by shape, with the true number of profiles: equal sides read as [profile, level], a lone profile along the longer side
S["split_profiles_by_shape"] = sql("""SELECT source_file, var_name,
 CASE WHEN swapped AND NOT by_shape THEN pos // n_prof WHEN NOT swapped AND by_shape THEN pos % n_lev ELSE profile_key // 500 END AS profile_idx,
 CASE WHEN swapped AND NOT by_shape THEN pos % n_prof WHEN NOT swapped AND by_shape THEN pos // n_lev ELSE level_idx END AS level_idx, value
 FROM (SELECT c.*, s.n_prof, s.n_lev, fno % 5 = 1 AS swapped,
       CASE WHEN fno % 5 = 1 THEN level_idx * n_prof + profile_key // 500 ELSE (profile_key // 500) * n_lev + level_idx END AS pos,
       CASE WHEN n_prof > 1 THEN CASE WHEN fno % 5 = 1 THEN n_lev <> n_prof ELSE false END
         ELSE CASE WHEN fno % 5 = 1 THEN n_lev >= n_prof ELSE n_prof >= n_lev END END AS by_shape
       FROM (SELECT *, CAST(regexp_extract(source_file, '([0-9]+)', 1) AS INT) AS fno
             FROM cleaned) c JOIN shapes s USING (source_file))
 WHERE n_prof > 1 OR profile_idx = 0""")
S["clean_values"] = sql("SELECT * FROM cleaned")
S["trim_trailing_nulls"] = sql("""SELECT source_file, profile_key, var_name, level_idx, value FROM (
 SELECT *, max(CASE WHEN value IS NOT NULL THEN level_idx END)
   OVER (PARTITION BY source_file, profile_key, var_name) AS last FROM cleaned)
 WHERE level_idx <= last""")
S["align_levels"] = sql("""SELECT source_file, profile_key, level_idx, temperature, salinity,
 pressure, oxygen FROM aligned""")
S["normalise_time"] = """SELECT event_id,
 CASE event_type WHEN 'click' THEN CAST(CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS VARCHAR)
  WHEN 'view' THEN date_diff('day', DATE '1950-01-01', CAST(ts AS DATE)) || '.25'
  WHEN 'error' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 'signup' THEN strftime(ts, '%Y%m%d')
  ELSE 'junk ' || event_id END AS raw,
 CASE event_type WHEN 'click' THEN date_trunc('second', ts)
  WHEN 'view' THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 6 HOUR
  WHEN 'error' THEN date_trunc('second', ts)
  WHEN 'signup' THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) END AS time_ultra,
 CASE event_type WHEN 'view' THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 6 HOUR
  END AS time_optimized FROM events"""
S["clean_identifiers"] = r"""SELECT id, name,
 CASE WHEN f = '' THEN 'unknown' ELSE left(f, 100) END AS file_name,
 CASE WHEN c = '' THEN 'unknown_var' WHEN regexp_matches(c, '^[0-9]') THEN left('var_' || c, 60)
   ELSE left(c, 60) END AS column_name
 FROM (SELECT id, name,
   regexp_replace(regexp_replace(name, '[/\\: <>]', '_', 'g'), '[^A-Za-z0-9_.\-]', '', 'g') AS f,
   trim(regexp_replace(lower(name), '[^a-z0-9]', '_', 'g'), '_') AS c
   FROM (SELECT page_id AS id, url AS name FROM pages
         UNION ALL SELECT p_partkey, p_type FROM part))"""
_platform_names = ", ".join(f"'{n}'" for n in fx.SCALAR_NAMES["platform"])
S["clean_platform"] = sql(f"""SELECT source_file, profile_key,
 CASE WHEN trim(value) IN ('', 'nan') THEN 'float_' || left(lpad(CAST(profile_key AS VARCHAR), 4,
   '0'), 4) ELSE trim(value) END AS float_id FROM scalars WHERE name IN ({_platform_names})""")
_stem = "'batch_' || (id % 500)"
S["build_profile_id"] = sql(f"""SELECT id, {_stem} || '::profile_' || id AS ingest_id,
 {_stem} || '_profile_' || id AS robust_id, {_stem} || '_prof_' || id AS optimized_id
 FROM profiles""")
S["coords_from_filename"] = """SELECT s_suppkey, 'x_' || a || ns || '_' || s_nationkey || ew || '.nc'
  AS file_name,
 CASE WHEN ew <> 'X' THEN CAST(a AS DOUBLE) * CASE WHEN ns = 'S' THEN -1 ELSE 1 END END AS lat,
 CASE WHEN ew <> 'X' THEN CAST(s_nationkey AS DOUBLE) * CASE WHEN ew = 'W' THEN -1 ELSE 1 END END
  AS lon
 FROM (SELECT s_suppkey, s_nationkey, CAST(CAST(abs(s_acctbal) AS DECIMAL(9,2)) AS VARCHAR) AS a,
  CASE WHEN s_suppkey % 2 = 0 THEN 'N' ELSE 'S' END AS ns,
  CASE s_suppkey % 3 WHEN 0 THEN 'W' WHEN 1 THEN 'E' ELSE 'X' END AS ew FROM supplier)"""
S["count_levels"] = sql("""SELECT source_file, profile_key, max(n_trimmed) AS n_levels,
 max(n_stored) FILTER (std_name = 'PRESSURE') AS n_pressure,
 coalesce(max(n_stored) FILTER (n_stored > 1), 0) AS n_longest_list FROM facts GROUP BY 1, 2""")
S["list_variables"] = sql("""SELECT source_file, profile_key,
 array_to_string(coalesce(variables, []), ',') AS variables,
 array_to_string(list_filter(coalesce(variables, []), lambda v: v <> 'PRESSURE'), ',')
  AS without_pressure FROM per_profile""")
S["route_scalars_and_levels"] = sql("""SELECT source_file, profile_key, var_name, value,
 CASE WHEN n = 1 THEN 'scalar' ELSE 'level' END AS route,
 CASE WHEN n = 1 THEN 0 ELSE level_idx END AS level_idx
 FROM (SELECT *, count(*) OVER (PARTITION BY source_file, profile_key, var_name) AS n
       FROM cleaned)""")
S["validate_profiles"] = sql("SELECT profile_id, lat, lon, n_levels, reason FROM judged")
# degraded landing: files ...3 have unknown names, ...7 only a telling file name, ...9 no place
_fno = "CAST(regexp_extract(source_file, '([0-9]+)', 1) AS INT)"
_renamed = (f"CASE WHEN {_fno} % 10 = 7 THEN 'batch_' || {_fno} || '_12.5N_65W.nc' "
            "ELSE source_file END")
_stem_of = "replace(source_file, '.nc', '')"


def _names(expr: str, where: str = "true") -> str:
    return (f"max(n_trimmed) AS n_levels, array_to_string(list_sort(list_distinct(list({expr}) "
            f"FILTER ({where}))), ',') AS variables_csv")


_known = "lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180"
_by_name = """CASE WHEN contains(source_file, '12.5N_65W') THEN {0} END"""
_fallback = (f"""WITH
 bad_facts AS (SELECT {_renamed} AS source_file, profile_key, n_trimmed,
   CASE WHEN {_fno} % 10 = 3 THEN 'x-' || var_name ELSE var_name END AS var_name
   FROM var_facts WHERE n_values > 0),
 bad_scalars AS (SELECT {_renamed} AS source_file, profile_key, name, value FROM scalars
   WHERE {_fno} % 10 NOT IN (7, 9)),
 files AS (SELECT DISTINCT {_renamed} AS source_file FROM scalars),
 place AS (SELECT source_file, profile_key, try_cast(latitude AS DOUBLE) AS lat,
   try_cast(longitude AS DOUBLE) AS lon FROM coords WHERE {_fno} % 10 NOT IN (7, 9)),
 exact_place AS (SELECT source_file, profile_key,
   max(CASE WHEN name = 'LATITUDE' THEN try_cast(value AS DOUBLE) END) AS lat,
   max(CASE WHEN name = 'LONGITUDE' THEN try_cast(value AS DOUBLE) END) AS lon
   FROM bad_scalars WHERE name IN ('LATITUDE', 'LONGITUDE') GROUP BY ALL),
 first_place AS (SELECT source_file, arg_min(lat, profile_key) AS lat,
   arg_min(lon, profile_key) AS lon FROM place
   WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY 1),
 file_facts AS (SELECT source_file, var_name, max(n_trimmed) AS n_trimmed FROM bad_facts
   GROUP BY ALL),
 cand AS (
   SELECT source_file, {_stem_of} || '_profile_' || profile_key AS profile_id, lat, lon, n_levels,
     variables_csv, 'exact_schema' AS extraction_method, 0 AS priority
   FROM (SELECT source_file, profile_key, {_names('var_name')} FROM bad_facts
         WHERE var_name IN ('TEMP', 'PSAL', 'DOXY', 'PRES') GROUP BY ALL)
   JOIN exact_place USING (source_file, profile_key) WHERE {_known}
   UNION ALL
   SELECT source_file, {_stem_of} || '_profile_' || profile_key, lat, lon, n_levels,
     variables_csv, 'standard', 1
   FROM (SELECT source_file, profile_key, {_names('std_name')} FROM bad_facts
         JOIN {alias_values('variable')} ON var_name = variant GROUP BY ALL)
   JOIN place USING (source_file, profile_key) WHERE {_known}
   UNION ALL
   SELECT source_file, {_stem_of} || '_simple_profile', lat, lon, n_levels, variables_csv,
     'simple_variables', 2
   FROM (SELECT source_file, {_names(
       "coalesce(std, regexp_replace(upper(var_name), '[^A-Z0-9_]', '', 'g'))")}
         FROM file_facts LEFT JOIN {_alias_upper} ON up = upper(var_name) GROUP BY ALL)
   JOIN first_place USING (source_file) WHERE {_known}
   UNION ALL
   SELECT source_file, {_stem_of} || '_any_data', 12.5e0, -65e0, n_levels, variables_csv,
     'any_numeric', 3
   FROM (SELECT source_file, {_names("replace(upper(var_name), ' ', '_')")} FROM file_facts
         WHERE n_trimmed > 1 GROUP BY ALL) WHERE contains(source_file, '12.5N_65W')
   UNION ALL
   SELECT source_file, {_stem_of} || '_minimal', {_by_name.format('12.5e0')},
     {_by_name.format('-65e0')}, 0, 'METADATA_ONLY', 'minimal_fallback', 4 FROM files)
 SELECT source_file, profile_id, lat, lon, n_levels, variables_csv, extraction_method,
  coalesce({_known}, false) AS accepted
 FROM (SELECT *, min(priority) OVER (PARTITION BY source_file) AS best FROM cand)
 WHERE priority = best""")
S["fallback_extract"] = sql(_fallback)
S["any_numeric_variables"] = sql("""SELECT c.source_file, upper(c.var_name) AS var_name,
 count(*) AS n_rows, count(value) AS n_values FROM cleaned c
 JOIN variables v ON v.source_file = c.source_file AND v.var_name = c.var_name
 WHERE v.dtype LIKE 'float%' AND list_product(v.shape) > 1 GROUP BY ALL""")
S["variable_catalog"] = sql("""SELECT var_name, count(DISTINCT source_file) AS n_files,
 array_to_string(list_sort(list_distinct(list(dtype))), ',') AS dtypes,
 CAST(max(len(dims)) AS BIGINT) AS n_dims, CAST(max(list_max(shape)) AS BIGINT) AS longest_dim
 FROM variables GROUP BY var_name""")
S["evolve_schema"] = sql("""SELECT profile_id, lat, extraction_method,
 1e0 AS data_quality_score, CAST(NULL AS BIGINT) AS seq FROM profiles
 UNION ALL SELECT profile_id, NULL, extraction_method, coalesce(data_quality_score, 1e0), seq
 FROM batches""")
S["evolve_schema_types"] = sql("""SELECT column_name,
 CASE WHEN contains(column_name, 'time') AND column_name <> 'time_start' THEN 'string'
  WHEN n > 0 AND n_int = n THEN 'bigint' WHEN n > 0 AND n_double = n THEN 'double'
  ELSE 'string' END AS column_type, n AS n_values
 FROM (SELECT lower(name) AS column_name, count(value) AS n,
       count(*) FILTER (regexp_full_match(trim(value), '[+-]?\\d+')) AS n_int,
       count(try_cast(value AS DOUBLE)) AS n_double FROM scalars GROUP BY 1)""")
S["pack_metadata"] = sql("""SELECT profile_id, array_to_string(list_filter(['float_id',
  CASE WHEN parquet_path IS NOT NULL THEN 'parquet_path' END, 'profile_id',
  CASE WHEN time_start IS NOT NULL THEN 'time_start' END], lambda x: x IS NOT NULL), ',') AS fields,
 float_id, parquet_path FROM profiles""")
S["truncate_fields"] = """SELECT doc_id, left(source, 12) AS name, substring(text, 1, 255) AS body
 FROM documents"""
S["admission_filter"] = sql(f"""SELECT profile_id, lat, lon, n_levels, time_start FROM catalog
 WHERE n_levels >= 5 AND time_start >= {T_CAT} - INTERVAL 36 MONTH
 AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180""")
S["chunk_levels"] = sql("""SELECT source_file, profile_key, CAST(level_idx // 4 AS BIGINT) AS chunk,
 count(*) AS n_points, coalesce(string_agg(CAST(CAST(pressure AS BIGINT) AS VARCHAR), ','
   ORDER BY level_idx), '') AS pressures FROM aligned GROUP BY ALL""")

# --- predicates and text constraints -----------------------------------------
S["bbox_filter"] = sql("""SELECT profile_id, lat, lon, 'pacific' AS box FROM profiles
  WHERE lat BETWEEN -60 AND 70 AND (lon >= 120 OR lon <= -70)
 UNION ALL SELECT profile_id, lat, lon, 'pacific literal' FROM profiles
  WHERE lat BETWEEN -60 AND 70 AND lon BETWEEN 120 AND -70
 UNION ALL SELECT profile_id, lat, lon, 'indian ocean' FROM profiles
  WHERE lat BETWEEN -40 AND 25 AND lon BETWEEN 20 AND 120""")
S["extract_region"] = sql("SELECT t.query_id, " + ", ".join(
    f"{r}_{m}.name AS {r}_{m}" for r in ("base", "enhanced") for m in ("longest", "first"))
    + " FROM texts t " + " ".join(
    f"LEFT JOIN {region_lookup(r, m, 'texts')} {r}_{m} ON {r}_{m}.query_id = t.query_id"
    for r in ("base", "enhanced") for m in ("longest", "first")))
S["extract_point_box"] = sql(f"""SELECT t.query_id, region_name AS source,
 round(lat_min, 6) AS lat_min, round(lat_max, 6) AS lat_max, round(lon_min, 6) AS lon_min,
 round(lon_max, 6) AS lon_max, round(plat - 5, 6) AS point_lat_min,
 round(plat + 5, 6) AS point_lat_max, round(plon - 5, 6) AS point_lon_min,
 round(plon + 5, 6) AS point_lon_max
 FROM (SELECT query_id, {point_part('enhanced')} FROM texts) t
 JOIN {constrained('base', 'texts')} c ON c.query_id = t.query_id""")
_season = ("CASE " + " ".join(f"WHEN contains(lower(text), '{s}') THEN '{s}'"
                              for s in rules.SEASON_MONTHS) + " END")
S["extract_time_constraint"] = sql(f"""SELECT query_id, {MONTHS} AS months_back, {YEAR} AS year_asked,
 ({MONTHS}) IS NULL AND ({YEAR}) IS NULL
  AND regexp_matches(lower(text), 'summer|winter|monsoon|spring') AS seasonal,
 {_season} AS season FROM texts""")
S["time_filter"] = sql(f"""SELECT profile_id, time_start, '6 months' AS rule FROM profiles
  WHERE time_start >= {T_CAT} - INTERVAL 6 MONTH
 UNION ALL SELECT profile_id, time_start, '2000' FROM profiles WHERE year(time_start) = 2000""")
S["season_filter"] = sql("""SELECT profile_id, time_start FROM profiles
 WHERE month(time_start) IN (12, 1, 2)""")
S["keyword_search"] = sql(" UNION ALL ".join(
    f"""SELECT * FROM (SELECT profile_id, float_id, time_start, '{w}' AS word FROM profiles
    WHERE contains(lower(variables_csv), '{w.lower()}') OR contains(lower(float_id), '{w.lower()}')
    OR contains(lower(profile_id), '{w.lower()}')
    ORDER BY time_start DESC NULLS FIRST, profile_id LIMIT 20)"""
    for w in ("nitrate", "f77", "P_1", "%")))
S["keyword_search_many"] = sql("""WITH words AS (SELECT 'S' || s_suppkey AS query_id, CAST(s_suppkey % 6 AS INT) AS k,
  CASE WHEN s_suppkey % 4 = 0 THEN 'p' || s_suppkey WHEN s_suppkey % 4 = 1 THEN 'f' || (s_suppkey % 7) WHEN s_suppkey % 4 = 2 THEN 'nitrate'
   WHEN s_suppkey % 8 = 3 THEN '' ELSE '%' END AS word FROM supplier)
 SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY time_start DESC NULLS FIRST, profile_id) AS INT) AS rank, profile_id
 FROM words JOIN profiles ON contains(lower(variables_csv), word) OR contains(lower(float_id), word) OR contains(lower(profile_id), word)
 WHERE k > 0 QUALIFY rank <= k""")
_asks = lambda words: "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")"
S["facet_search_many"] = sql(f"""WITH rows AS (SELECT profile_id, time_start, max_depth,
   lower(variables_csv || ({LABEL}) || float_id || profile_id || coalesce(strftime(time_start, '%Y-%m-%d %H:%M:%S'), 'None')) AS hay,
   coalesce(strftime(time_start, '%Y-%m-%d %H:%M:%S'), 'None') AS tm FROM catalog),
 asked AS (SELECT query_id, k, lower(text) AS low FROM query_log),
 hit AS (SELECT query_id, k, profile_id, time_start FROM asked JOIN rows ON contains(hay, low)
   OR ({_asks(FACETS[0][0])} AND regexp_matches(hay, '{"|".join(FACETS[0][1])}'))
   OR ({_asks(FACETS[1][0])} AND regexp_matches(hay, '{"|".join(FACETS[1][1])}'))
   OR ({_asks(FACETS[2][0])} AND regexp_matches(hay, '{"|".join(FACETS[2][1])}'))
   OR (contains(low, 'equator') AND contains(hay, 'equatorial')) OR (contains(low, 'atlantic') AND contains(hay, 'atlantic'))
   OR ({_asks(DEPTH_WORDS)} AND max_depth >= 1000) OR (contains(low, '2023') AND contains(tm, '2023'))),
 alls AS (SELECT query_id, k, profile_id, time_start FROM asked, rows WHERE query_id NOT IN (SELECT query_id FROM hit))
 SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY time_start DESC NULLS FIRST, profile_id) AS INT) AS rank,
  profile_id, matched FROM (SELECT *, true AS matched FROM hit UNION ALL SELECT *, false FROM alls) QUALIFY rank <= k""")
S["facet_filter"] = sql(f"""SELECT profile_id, variables_csv, max_depth FROM catalog
 WHERE regexp_matches(lower(variables_csv || ({LABEL})), 'oxygen|doxy|o2')
 OR contains(lower({LABEL}), 'equatorial') OR coalesce(max_depth >= 1000, false)
 OR contains(lower(profile_id || float_id), 'o2')""")
S["facet_filter_no_match"] = sql("SELECT profile_id, variables_csv, max_depth FROM catalog")


def _scope(token: bool) -> str:
    edge = r"[^\p{L}\p{N}_]"

    def any_of(words: list[str]) -> str:
        body = "|".join(re.escape(w).replace(r"\ ", " ") for w in dict.fromkeys(words))
        return f"(?:^|{edge})(?:{body})s?(?:$|{edge})" if token else body

    return (f"(length(trim(text)) >= 3 "
            f"AND regexp_matches(lower(text), '{any_of(rules.OCEAN_WORDS + rules.GENERIC_WORDS)}') "
            f"AND NOT regexp_matches(lower(text), '{any_of(rules.OFF_TOPIC_WORDS)}'))")


S["scope_filter"] = sql(f"""SELECT query_id, {_scope(True)} AS by_token,
 {_scope(False)} AS by_substring FROM texts""")
S["invalid_coordinates"] = sql("""SELECT profile_id, lat, lon FROM profiles WHERE lat IS NULL
 OR lon IS NULL OR lat < -90 OR lat > 90 OR lon < -180 OR lon > 180""")
S["variables_contain"] = sql("""SELECT profile_id, 'CHLA' AS rule FROM profiles
  WHERE list_contains(variables, 'CHLA')
 UNION ALL SELECT profile_id, 'nutrients' FROM profiles
  WHERE list_has_any(variables, ['NITRATE', 'PHOSPHATE', 'SILICATE'])""")

# --- joins -------------------------------------------------------------------
S["candidates_semi_catalog"] = sql("""SELECT profile_id, label FROM vectors WHERE profile_id IN
 (SELECT profile_id FROM profiles WHERE year(time_start) = 1999)""")
S["skip_loaded"] = sql("""SELECT DISTINCT source_file FROM profiles WHERE (id % 500) % 3 = 0""")
S["missing_level_files"] = sql("SELECT profile_id, parquet_path FROM store_missing")
S["reconcile_levels"] = sql("""SELECT DISTINCT run, bucket AS float_bucket, parquet_path AS path,
 CASE bucket WHEN 3 THEN 'missing' ELSE 'damaged' END AS state FROM store_catalog WHERE run = 1 AND bucket IN (3, 7)""")
S["profile_levels"] = sql("""SELECT l.profile_id, float_id, lat, lon, pres, temp, psal, doxy
 FROM levels l JOIN profiles p USING (profile_id)""")
S["catalog_vector_reconcile"] = sql("""SELECT
 count(*) FILTER (p.profile_id IS NOT NULL AND v.profile_id IS NOT NULL) AS matched,
 count(*) FILTER (v.profile_id IS NULL) AS only_catalog,
 count(*) FILTER (p.profile_id IS NULL) AS only_vectors,
 count(p.profile_id) AS catalog_count, count(v.profile_id) AS vector_count,
 abs(count(p.profile_id) - count(v.profile_id)) > count(p.profile_id) * 0.1 AS mismatch
 FROM profiles p FULL JOIN vectors v ON p.profile_id = v.profile_id""")
_regions = rules.values_sql(rules.region_rows("base"))
S["region_join"] = sql(f"""SELECT profile_id, name AS region FROM profiles JOIN ({_regions})
 AS r(priority, name, lat_min, lat_max, lon_min, lon_max) ON {IN_OWN_BOX}""")
_points = """SELECT 'S' || s_suppkey AS query_id,
 CAST((s_suppkey * 3571) % 1801 AS DOUBLE) / 1e1 - 9e1 AS qlat,
 CAST((s_suppkey * 7103) % 3601 AS DOUBLE) / 1e1 - 18e1 AS qlon FROM supplier"""
S["nearest_profiles"] = sql(f"""SELECT query_id, profile_id, rank, round(km, 6) AS distance_km FROM (
 SELECT query_id, profile_id, km, CAST(row_number() OVER (PARTITION BY query_id
   ORDER BY round(km, 6), profile_id) AS INT) AS rank
 FROM (SELECT query_id, profile_id, {haversine('qlat', 'qlon', 'lat', 'lon')} AS km
       FROM ({_points}) CROSS JOIN profiles WHERE lat BETWEEN -90 AND 90
       AND lon BETWEEN -180 AND 180) WHERE round(km, 6) <= radians(2e0) * 6371) WHERE rank <= 3""")
S["vector_join"] = sql("""WITH v AS (SELECT profile_id, label, unnest(embedding)::DOUBLE AS x,
   generate_subscripts(embedding, 1) AS i FROM vectors),
 m AS (SELECT label, i, avg(x) AS c FROM v GROUP BY label, i)
 SELECT profile_id, v.label, (round(sum((x - c) ** 2), 6) + 0e0) AS distance
 FROM v JOIN m ON v.label = m.label AND v.i = m.i GROUP BY profile_id, v.label""")

# --- aggregations ------------------------------------------------------------
S["count_profiles"] = sql("SELECT count(*) AS total_profiles FROM profiles")
_placed = "FROM profiles WHERE lat IS NOT NULL AND lon IS NOT NULL"
_spread = "min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon"
_means = f"count(*) AS count, {mean6('lat')} AS avg_lat, {mean6('lon')} AS avg_lon"
S["region_stats"] = sql(
    f"SELECT {STATS_LADDER} AS region, {_means}, {_spread} {_placed} GROUP BY 1")
S["region_stats_basic"] = sql(f"SELECT {BASIC_LADDER} AS region, {_means} {_placed} GROUP BY 1")
S["latitude_band_stats"] = sql(f"""SELECT {BAND_LADDER} AS region, count(*) AS count FROM profiles
 WHERE lat IS NOT NULL GROUP BY 1""")
_variables = "(SELECT unnest(variables) AS variable FROM profiles)"
S["variable_frequency"] = sql(
    f"SELECT variable, count(*) AS count FROM {_variables} GROUP BY 1", "profiles")
S["top_variables"] = sql(f"""SELECT variable, count(*) AS count FROM {_variables} GROUP BY 1
 ORDER BY 2 DESC, 1 LIMIT 10""", "profiles")
S["date_range"] = sql("""SELECT min(time_start) AS earliest, max(time_start) AS latest
 FROM profiles""")
S["float_summary"] = sql(f"""SELECT s.*, v.all_variables FROM (
 SELECT float_id, count(*) AS total_profiles, min(time_start) AS first_measurement,
 max(time_start) AS last_measurement, {mean6('lat')} AS avg_lat, {mean6('lon')} AS avg_lon,
 {mean6('n_levels')} AS avg_levels FROM catalog GROUP BY float_id) s
 JOIN (SELECT float_id, array_to_string(list_sort(list_distinct(list(variable))), ',')
       AS all_variables FROM (SELECT float_id, unnest(variables) AS variable FROM catalog)
       GROUP BY float_id) v USING (float_id)""")
S["method_stats"] = sql(f"""SELECT extraction_method, count(*) AS count,
 {mean6('data_quality_score')} AS avg_quality FROM catalog GROUP BY 1""")
_tier = """CASE WHEN data_quality_score >= 8e-1 THEN 'high'
 WHEN data_quality_score >= 5e-1 THEN 'medium' ELSE 'low' END"""
S["quality_tiers"] = sql(f"""SELECT {_tier} AS quality_tier, count(*) AS count FROM catalog
 GROUP BY 1""")
S["quality_score"] = sql("""SELECT profile_id, n_values, n_cells, n_key, data_quality_score
 FROM scored""")
S["error_stats"] = sql(f"""SELECT error_type, count(*) AS count, max(occurred_at) AS last_occurrence,
 count(*) FILTER (occurred_at > {T_ERR} - INTERVAL 1 DAY) AS count_24h
 FROM errors WHERE occurred_at > {T_ERR} - INTERVAL 7 DAY GROUP BY 1""")
_metrics = f"""count(*) AS total_profiles, {mean6('n_levels')} AS avg_levels,
 count(DISTINCT float_id) AS unique_floats, {mean6('data_quality_score')} AS avg_quality,
 count(*) FILTER (created_at > {{t}}) AS records_today"""
S["catalog_metrics"] = sql(f"SELECT {_metrics.format(t=T_CAT)} FROM catalog")
S["completeness"] = sql("""SELECT count(*) AS total, count(lat) AS has_lat, count(lon) AS has_lon,
 count(time_start) AS has_time, count(parquet_path) AS has_parquet FROM profiles""")
S["duplicate_profiles"] = sql("""SELECT profile_id, count(*) AS count FROM batches GROUP BY 1
 HAVING count(*) > 1""")
S["orphan_ratio"] = sql(f"""SELECT count(*) AS total, count(*) FILTER (parquet_path <> '')
 AS with_parquet, {r6("1 - count(*) FILTER (parquet_path <> '') / count(*)")} AS orphan_ratio
 FROM profiles""")
S["run_summary"] = sql(f"""SELECT *, {r6('profiles_saved / profiles_extracted * 100')}
  AS profile_success_rate, {r6('files_successful / files_attempted * 100')} AS file_success_rate
 FROM (SELECT count(*) AS files_attempted, count(*) FILTER (saved > 0) AS files_successful,
   count(*) FILTER (saved = 0) AS files_failed, CAST(sum(n) AS BIGINT) AS profiles_extracted,
   CAST(sum(saved) AS BIGINT) AS profiles_saved, CAST(sum(emb) AS BIGINT) AS profiles_embedded
  FROM (SELECT source_file, count(*) AS n, count(*) FILTER (reason = 'accepted') AS saved,
    count(*) FILTER (reason = 'accepted' AND time_start IS NOT NULL) AS emb
    FROM judged GROUP BY 1))""")
S["overview_metrics"] = sql(f"""SELECT count(*) AS matching_profiles,
 count(DISTINCT {LABEL}) AS n_regions,
 (SELECT count(DISTINCT variable) FROM {_variables}) AS n_parameters,
 max(max_depth) AS max_depth FROM catalog""", "profiles")
S["region_share"] = sql(f"""SELECT region, count, {r6('count * 100 / sum(count) OVER ()')} AS percent
 FROM (SELECT {LABEL} AS region, count(*) AS count FROM profiles GROUP BY 1)""")
S["parameter_ranges"] = sql(" UNION ALL ".join(
    f"""SELECT profile_id, '{c}' AS variable, count({c}) AS n_values, min({c}) AS min_value,
    max({c}) AS max_value FROM levels GROUP BY profile_id""" for c in ("temp", "psal", "doxy")))
S["depth_series"] = sql("""SELECT profile_id, pres AS depth, temp AS temperature, psal AS salinity,
 doxy AS oxygen FROM levels WHERE profile_id IN
 (SELECT profile_id FROM profiles)""")
S["collection_summary"] = sql(f"""SELECT count(*) AS profile_count,
 (SELECT array_to_string(list_sort(list_distinct(list(variable))), ',') FROM {_variables})
  AS variables_available,
 array_to_string(list_sort(list_distinct(list({LABEL}))), ',') AS regions_covered,
 min(time_start) AS time_from, max(time_start) AS time_to, min(lat) AS lat_min,
 max(lat) AS lat_max, min(lon) AS lon_min, max(lon) AS lon_max, max(max_depth) AS depth_max
 FROM catalog""", "profiles")
S["storage_summary"] = sql("""SELECT count(*) AS total_files, count(*) FILTER (length = 0) AS zero_byte_files,
 true AS has_size FROM store_listing""")

# --- windows, sorts, sets ----------------------------------------------------
S["latest_per_profile"] = sql("""SELECT * FROM batches QUALIFY row_number()
 OVER (PARTITION BY profile_id ORDER BY seq DESC) = 1""")
S["error_rate_windows"] = sql("""SELECT day, errors_1d, errors_7d, errors_1d > 10 AS warn_1d,
 errors_1d > 50 AS high_1d, errors_7d > 20 AS recurring_7d FROM (
 SELECT day, n AS errors_1d, CAST(sum(n) OVER (ORDER BY day ROWS 6 PRECEDING) AS BIGINT)
  AS errors_7d FROM (
  SELECT CAST(s.day AS DATE) AS day, coalesce(n, 0) AS n
  FROM (SELECT unnest(generate_series(min(CAST(occurred_at AS DATE)), max(CAST(occurred_at AS DATE)),
        INTERVAL 1 DAY)) AS day FROM errors) s
  LEFT JOIN (SELECT CAST(occurred_at AS DATE) AS day, count(*) AS n FROM errors GROUP BY 1) d
   ON d.day = CAST(s.day AS DATE)))""")
S["latest_profiles"] = sql("""SELECT profile_id, time_start FROM profiles
 ORDER BY time_start DESC NULLS FIRST, profile_id LIMIT 25""")
S["latest_profiles_dated"] = sql("""SELECT profile_id, time_start FROM profiles
 ORDER BY time_start DESC NULLS LAST, profile_id LIMIT 25""")
S["top_error_types"] = sql("""SELECT error_type, count(*) AS count FROM errors GROUP BY 1
 ORDER BY 2 DESC, 1 LIMIT 5""")
S["distinct_regions"] = sql(f"""SELECT DISTINCT {ANSWER_LADDER} AS region FROM profiles
 WHERE ({ANSWER_LADDER}) IS NOT NULL""")
S["union_variables"] = sql(f"SELECT DISTINCT variable FROM {_variables}", "profiles")
S["distinct_sources"] = sql("SELECT DISTINCT source_file FROM profiles")

# --- vectors -----------------------------------------------------------------


def _topk(distance: str, similarity: str) -> str:
    return sql(f"""SELECT query_id, profile_id, rank, {r6(similarity)} AS similarity FROM (
 SELECT query_id, profile_id, k, d, CAST(row_number() OVER (PARTITION BY query_id
   ORDER BY d, profile_id) AS INT) AS rank
 FROM (SELECT q.query_id, q.k, c.profile_id, round({distance}, 9) + 0e0 AS d
       FROM asked_vectors q CROSS JOIN corpus c)) WHERE rank <= k""")


S["vector_topk"] = _topk("list_distance(c.embedding, q.query_vector) ** 2", "1 - d")
S["vector_topk_cosine"] = _topk("1 - list_cosine_similarity(c.embedding, q.query_vector)", "1 - d")
S["vector_topk_dot"] = _topk("-list_inner_product(c.embedding, q.query_vector)", "-d")
S["vector_topk_approx_quality"] = "SELECT true AS finds_nine_tenths, true AS measures_a_fifth_at_most FROM embeddings LIMIT 1"
_arabian = f"round(greatest(0e0, 1 - {haversine('17.5e0', '62.5e0', 'lat', 'lon')} / 2000), 6)"
S["nearest_profiles_all"] = sql(f"""WITH p AS (SELECT profile_id, lat, lon FROM profiles
   WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180),
 pairs AS (SELECT a.profile_id AS query_id, b.profile_id,
   round({haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 6) + 0e0 AS km
   FROM p a JOIN p b ON b.lat BETWEEN a.lat - 10.1e0 AND a.lat + 10.1e0)
 SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY km, profile_id) AS INT) AS rank,
  profile_id, km FROM pairs WHERE km <= radians(10e0) * 6371 QUALIFY rank <= 3""")
S["rank_by_relevance"] = sql(f"""SELECT 'arabian sea' AS query_id, rank, profile_id, relevance
 FROM (SELECT *, CAST(row_number() OVER (ORDER BY relevance DESC, id) AS INT) AS rank
  FROM (SELECT id, profile_id, {_arabian} AS relevance FROM profiles
        WHERE lat BETWEEN 10 AND 25 AND lon BETWEEN 50 AND 75)) WHERE rank <= 50""")

# --- scalar functions --------------------------------------------------------
_km = haversine("17.5e0", "62.5e0", "lat", "lon")
S["haversine"] = sql(f"SELECT profile_id, round({_km}, 4) AS distance_km FROM profiles")
S["geo_relevance"] = sql(f"""SELECT profile_id, {r6(f'greatest(0e0, 1 - {_km} / 2000)')} AS base,
 {r6(f'greatest(0e0, 1 - {_km} / 1000)')} AS enhanced FROM profiles
 WHERE lat BETWEEN 10 AND 25 AND lon BETWEEN 50 AND 75""")
S["classify_region"] = sql(f"""SELECT profile_id, {STATS_LADDER} AS stats, {BASIC_LADDER}
 AS stats_basic, {BAND_LADDER} AS bands, {ANSWER_LADDER} AS answer,
 {HEMISPHERE_LADDER} AS hemispheres FROM profiles WHERE lat IS NOT NULL AND lon IS NOT NULL""")
S["guess_basin"] = sql(f"""SELECT profile_id, {basin(-70)} AS basin,
 {basin(-180)} AS basin_wide_atlantic FROM profiles""")
S["format_position"] = sql(f"""SELECT profile_id, {POSITION} AS position,
 {SIGNED} AS signed_position FROM profiles""")
_time = "strftime(time_start, '%Y-%m-%d %H:%M:%S')"
_name = "'Float ' || float_id || ' profile ' || profile_id"
_depth = "CASE WHEN n_levels > 0 THEN 'with ' || n_levels || ' depth levels' END"
_some = "'measuring ' || array_to_string(variables[1:5], ', ')"
_five = f"""concat_ws(' ', {_name}, 'at ' || {SIGNED}, 'measured on ' || {_time}, {_depth},
 {_some}) || '.'"""
_where = "lat IS NOT NULL AND lon IS NOT NULL"
S["summarise_profile"] = sql(f"""SELECT profile_id,
 CASE WHEN {_where} THEN {_name} || ': ' || n_levels || ' levels at (' || printf('%.2f', lat) || ','
  || printf('%.2f', lon) || ') time ' || coalesce({_time}, 'None') || '. Variables: '
  || array_to_string(variables, ',') END AS ingest,
 CASE WHEN {_where} THEN concat_ws(' ', {_name} || ':', 'Located at ' || {SIGNED},
  'measured on ' || {_time}, {_depth}, 'measuring ' || array_to_string(variables, ', ')) || '.'
  ELSE 'Profile ' || profile_id END AS robust,
 {_five} AS ultra, {_five} AS rebuild,
 CASE WHEN {_where} THEN concat_ws(' ', 'ARGO float ' || float_id || ' profile',
  'at ' || {POSITION}, 'measured on ' || {_time},
  CASE WHEN n_levels > 0 THEN 'with ' || n_levels || ' depth measurements' END,
  'measuring ' || lower(array_to_string(variables, ', ')),
  CASE WHEN coalesce(data_quality_score, 5e-1) > 8e-1 THEN '(high quality data)'
   WHEN coalesce(data_quality_score, 5e-1) < 3e-1 THEN '(limited data)' END,
  'in the ' || ({basin(-70)})) || '.' ELSE 'ARGO profile ' || profile_id END AS rich
 FROM catalog""")
_bgc = ("list_filter(variables, lambda v: list_contains(['DOXY','NITRATE','PHOSPHATE','SILICATE',"
        "'PH','CHLA'], v))")
_core = "list_filter(variables, lambda v: list_contains(['TEMP','PSAL','PRES'], v))"
_age = f"date_diff('day', CAST(time_start AS DATE), DATE '{CATALOG_AS_OF}')"
S["enrich_summary"] = sql(f"""SELECT profile_id, concat_ws(' ',
 'ARGO oceanographic profile ' || profile_id || ' from float ' || float_id,
 CASE WHEN {_where} THEN 'located at ' || printf('%.3f', lat) || '°N ' || printf('%.3f', lon)
  || '°E in the ' || ({STATS_LADDER}) END,
 CASE WHEN {_where} THEN CASE WHEN abs(lat) <= 5 THEN 'near equatorial waters'
  WHEN region = 'Arabian Sea' THEN 'in Arabian Sea waters'
  WHEN region = 'Pacific Ocean' THEN 'in Pacific Ocean basin'
  WHEN region = 'Atlantic Ocean' THEN 'in Atlantic Ocean basin' END END,
 'measured in ' || strftime(time_start, '%B %Y'),
 'during ' || CASE WHEN month(time_start) IN (3,4,5) THEN 'spring'
  WHEN month(time_start) IN (6,7,8) THEN 'summer' WHEN month(time_start) IN (9,10,11) THEN 'autumn'
  WHEN month(time_start) IN (12,1,2) THEN 'winter' END || ' season',
 CASE WHEN {_age} < 180 THEN 'recent measurements' WHEN {_age} < 365 THEN 'within last year' END,
 CASE WHEN len({_bgc}) > 0 THEN 'with biogeochemical parameters: ' || array_to_string({_bgc}, ', ')
  || ' BGC-Argo float data' END,
 CASE WHEN list_contains(variables, 'DOXY') THEN 'including dissolved oxygen measurements' END,
 CASE WHEN list_contains(variables, 'NITRATE') THEN 'including nitrate nutrient data' END,
 CASE WHEN list_contains(variables, 'CHLA') THEN 'including chlorophyll fluorescence' END,
 CASE WHEN len({_core}) > 0 THEN 'with core measurements: ' || array_to_string({_core}, ', ') END,
 CASE WHEN list_contains(variables, 'TEMP') THEN 'temperature profile data' END,
 CASE WHEN list_contains(variables, 'PSAL') THEN 'salinity profile measurements' END) || '.'
 AS summary FROM (SELECT *, {STATS_LADDER} AS region FROM profiles)""")


def _phrases(pairs: list[tuple[str, str]], column: str) -> str:
    cases = ", ".join(f"CASE WHEN contains(lower({column}), '{m}') THEN '{w}' END"
                      for m, w in sorted(pairs, key=lambda p: p[1]))
    return f"concat_ws(',', {cases})"


_base_words = [("temp", "temperature"), ("psal", "salinity"), ("doxy", "dissolved oxygen"),
               ("chla", "chlorophyll"), ("nitrate", "nitrate")]
_enhanced_words = [("temp", "temperature"), ("psal", "salinity"), ("doxy", "oxygen")]
S["parameter_phrases"] = sql(f"""SELECT profile_id,
 {_phrases(_base_words, 'variables_csv')} AS base,
 {_phrases(_enhanced_words, 'variables_csv')} AS enhanced FROM profiles""")
S["parse_variables"] = sql("""SELECT profile_id, CASE WHEN time_start IS NULL THEN ''
 ELSE variables_csv END AS variables FROM profiles""")
S["count_variables"] = sql("SELECT profile_id, len(variables) AS n_variables FROM profiles")
S["range_parse"] = """SELECT c_custkey, lo || '-' || hi || '°C' AS t, CAST(lo AS DOUBLE) AS range_min,
 CAST(hi AS DOUBLE) AS range_max FROM (SELECT c_custkey,
 CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR) AS lo,
 CAST(CAST(c_acctbal AS DECIMAL(12,2)) + 50 AS VARCHAR) AS hi FROM customer)"""

# --- catalogue changes -------------------------------------------------------
_news = """SELECT seq, CASE WHEN seq % 2 = 0 THEN profile_id ELSE 'N' || profile_id END
 AS profile_id, updated_at, extraction_method, data_quality_score FROM batches"""
_last = f"""SELECT * FROM ({_news}) QUALIFY row_number() OVER (PARTITION BY profile_id
 ORDER BY seq DESC) = 1"""
_first = f"""SELECT * FROM ({_news}) QUALIFY row_number() OVER (PARTITION BY profile_id
 ORDER BY seq) = 1"""
_has_new, _is_old = "n.profile_id IS NOT NULL", "o.profile_id IS NOT NULL"


def _upsert(updates: set[str]) -> str:
    def col(c: str, old: str) -> str:
        test = _has_new if c in updates else f"{_has_new} AND NOT ({_is_old})"
        return f"CASE WHEN {test} THEN n.{c} ELSE {old} END AS {c}"

    return sql(f"""SELECT coalesce(o.profile_id, n.profile_id) AS profile_id, o.float_id,
 {col('extraction_method', 'o.extraction_method')},
 {col('data_quality_score', 'o.data_quality_score')}, o.parquet_path,
 {col('updated_at', 'o.created_at')}, {col('seq', '-1')}
 FROM catalog o FULL JOIN ({_last}) n ON o.profile_id = n.profile_id""")


S["upsert_catalog"] = _upsert({"data_quality_score", "extraction_method", "updated_at"})
S["upsert_catalog_all_columns"] = _upsert(
    {"data_quality_score", "extraction_method", "updated_at", "seq"})
S["insert_ignore"] = sql(f"""SELECT profile_id, float_id, extraction_method, data_quality_score,
 parquet_path, created_at AS updated_at, -1 AS seq FROM catalog
 UNION ALL SELECT profile_id, NULL, extraction_method, data_quality_score, NULL, updated_at, seq
 FROM ({_first}) WHERE profile_id NOT IN (SELECT profile_id FROM catalog)""")
S["mark_missing_levels"] = sql(f"""SELECT profile_id,
 CASE WHEN run = 1 AND bucket = 3 THEN NULL ELSE parquet_path END AS parquet_path,
 {r6("CASE WHEN run = 1 AND bucket = 3 THEN data_quality_score * 5e-1 ELSE data_quality_score END")}
  AS data_quality_score FROM store_catalog""")
_orphan = "((parquet_path IS NULL OR parquet_path = '') AND extraction_method <> 'minimal_fallback')"
S["mark_orphans"] = sql(f"""SELECT profile_id, {r6(f'''CASE WHEN {_orphan}
 THEN least(data_quality_score, 2e-1) ELSE data_quality_score END''')} AS data_quality_score,
 CASE WHEN {_orphan} THEN 'orphaned' END AS status FROM catalog""")
S["drop_invalid_coordinates"] = sql("""SELECT profile_id, lat, lon FROM profiles
 WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180""")
S["default_quality"] = sql("""SELECT profile_id, coalesce(data_quality_score, 1e-1)
 AS data_quality_score FROM catalog""")
S["prune_errors"] = sql(f"""SELECT * FROM errors WHERE occurred_at IS NULL
 OR occurred_at >= {T_ERR} - INTERVAL 10 DAY""")
S["seed_catalog"] = sql("""SELECT b.profile_id, NULL AS float_id, NULL AS lat, NULL AS lon,
  NULL AS n_levels, NULL AS variables FROM (SELECT DISTINCT profile_id FROM batches) b
 UNION ALL SELECT profile_id, float_id, lat, lon, n_levels, array_to_string(variables, ',')
 FROM catalog WHERE profile_id NOT IN (SELECT profile_id FROM batches)""")

# --- streams -----------------------------------------------------------------
S["stream_ingest"] = sql("""SELECT profile_id, float_id, lat, lon, time_start, reason FROM judged""")
S["stream_upsert"] = S["latest_per_profile"]
S["stream_upsert_catalog"] = S["upsert_catalog"]
_watermark = "(SELECT max(occurred_at) - INTERVAL 1 HOUR FROM errors)"
S["stream_error_rates"] = sql(f"""SELECT * FROM (
 SELECT 'tumbling' AS kind, date_trunc('day', occurred_at) AS window_start,
  date_trunc('day', occurred_at) + INTERVAL 1 DAY AS window_end, error_type, count(*) AS n_errors
 FROM errors GROUP BY ALL
 UNION ALL
 SELECT 'sliding', ws, ws + INTERVAL 1 DAY, error_type, count(*) FROM (
  SELECT error_type, time_bucket(INTERVAL 6 HOUR, occurred_at)
   - to_hours(CAST(6 * unnest(range(4)) AS INT)) AS ws FROM errors) GROUP BY ALL)
 WHERE window_end <= {_watermark}""")
S["stream_dedupe"] = sql("SELECT DISTINCT profile_id FROM batches")

# --- composite queries -------------------------------------------------------


_season_ok = f"""(CASE WHEN temporal_filter AND ({MONTHS}) IS NULL AND ({YEAR}) IS NULL
 AND regexp_matches(lower(text), 'summer|winter|monsoon|spring') THEN coalesce(CASE {_season}
 {" ".join(f"WHEN '{s}' THEN month(time_start) IN ({', '.join(map(str, m))})"
           for s, m in rules.SEASON_MONTHS.items())}
 ELSE true END, false) ELSE true END)"""


def _search(ruleset: str, by_place: str, keep: str, scale: int, month: str = "NULL",
            year: str = "NULL") -> str:
    km = haversine("(lat_min + lat_max) / 2", f"({CENTER_LON})", "lat", "lon")
    return f"""WITH asked AS (SELECT q.*, c.lat_min, c.lat_max, c.lon_min, c.lon_max,
   {MONTHS} AS months_back, {YEAR} AS year_asked,
   regexp_matches(lower(text), '{"|".join(n for n, *_ in rules.REGIONS["enhanced"])}') AS named
   FROM query_log q JOIN {constrained(ruleset, 'query_log')} c USING (query_id)),
 hits AS (SELECT a.*, d.profile_id, d.distance, p.lat, p.lon, p.time_start,
   {by_place} AS placed, {month} AS m, {year} AS y
   FROM distances d JOIN asked a USING (query_id) LEFT JOIN profiles p USING (profile_id)),
 near AS (SELECT *, row_number() OVER (PARTITION BY query_id
   ORDER BY distance, profile_id) AS vector_rank FROM hits
   WHERE (NOT placed OR coalesce({IN_OWN_BOX}, false)) AND {keep}),
 kept AS (SELECT *, CASE WHEN placed THEN {km} END AS km FROM near WHERE vector_rank <= k),
 result AS (SELECT query_id, profile_id, {r6('1 - distance')} AS similarity, {r6('km')} AS distance_km,
   {r6(f'greatest(0e0, 1 - km / {scale})')} AS relevance, k,
   CAST(row_number() OVER (PARTITION BY query_id ORDER BY
     round(CASE WHEN placed THEN greatest(0e0, 1 - km / {scale}) END, 6) DESC NULLS LAST, vector_rank)
     AS INT) AS rank FROM kept)"""


_columns = """SELECT query_id, rank, profile_id, similarity, distance_km,
 CASE WHEN distance_km IS NOT NULL THEN relevance END AS relevance FROM result"""
_geo = _search("base", "lat_min IS NOT NULL", "true", 2000)
S["geo_search"] = sql(f"{_geo} {_columns}")
_time_ok = f"""coalesce(CASE WHEN m IS NOT NULL THEN time_start >= {T_CAT} - to_months(m)
 WHEN y IS NOT NULL THEN year(time_start) = y ELSE true END, false)"""
_flagged = "lat_min IS NOT NULL AND geographic_filter"
_m, _y = "CASE WHEN temporal_filter THEN months_back END", "CASE WHEN temporal_filter THEN year_asked END"
S["constrained_search"] = sql(
    _search("enhanced", _flagged, f"{_time_ok} AND {_season_ok}", 1000, _m, _y) + " " + _columns)
S["smart_search"] = sql(
    _search("enhanced", _flagged + " AND named", f"{_time_ok} AND (NOT named OR {_season_ok})", 1000,
            "CASE WHEN temporal_filter AND named THEN months_back END",
            "CASE WHEN temporal_filter AND named THEN year_asked END") + " " + _columns)
S["prefilter_search"] = sql(f"""WITH asked AS (SELECT q.*, c.lat_min, c.lat_max, c.lon_min, c.lon_max,
   CASE WHEN temporal_filter THEN {MONTHS} END AS m, CASE WHEN temporal_filter THEN {YEAR} END AS y
   FROM query_log q JOIN {constrained('enhanced', 'query_log')} c USING (query_id)),
 kept AS (SELECT a.query_id, a.k, d.profile_id, d.distance FROM distances d
   JOIN asked a USING (query_id) LEFT JOIN profiles p USING (profile_id)
   WHERE (lat_min IS NULL OR NOT geographic_filter OR coalesce({IN_OWN_BOX}, false)) AND {_time_ok} AND {_season_ok})
 SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, profile_id) AS INT)
   AS rank, profile_id, {r6('1 - distance')} AS similarity FROM kept QUALIFY rank <= k""")
_trim = "regexp_replace(CAST(round({0}, 4) AS VARCHAR), '\\.0$', '')"
_bounds = (f"{_trim.format('lat_min')} || '-' || {_trim.format('lat_max')} || '°N, ' || "
           f"{_trim.format('lon_min')} || '-' || {_trim.format('lon_max')} || '°E'")
S["answer_summary"] = sql(f"""{_geo},
 rows AS (SELECT r.query_id, {ANSWER_LADDER} AS region, variables_csv,
   CASE WHEN n_levels > 0 THEN n_levels END AS n_levels
   FROM result r LEFT JOIN catalog USING (profile_id)),
 words AS (SELECT query_id, list_sort(list_distinct(list(w))) AS parameters FROM (
   SELECT query_id, unnest(string_split({_phrases(_base_words, 'variables_csv')}, ',')) AS w FROM rows)
   WHERE w <> '' GROUP BY 1),
 per AS (SELECT query_id, count(*) AS n, coalesce(list_sort(list_distinct(list(region)
    FILTER (region IS NOT NULL))), []) AS regions,
   CAST(round_even(avg(n_levels), 0) AS BIGINT) AS avg_levels, max(n_levels) AS max_levels
   FROM rows GROUP BY 1),
 joined AS (SELECT a.query_id, a.text, a.lat_min, a.lat_max, a.lon_min, a.lon_max,
   coalesce(n, 0) AS n, coalesce(regions, []) AS regions, coalesce(parameters, []) AS parameters,
   avg_levels, max_levels FROM asked a LEFT JOIN per USING (query_id)
   LEFT JOIN words USING (query_id))
 SELECT query_id, n AS total_results, array_to_string(regions, ',') AS regions,
  array_to_string(parameters, ',') AS parameters, avg_levels, max_levels,
  CASE WHEN n > 0 THEN concat_ws(' ', 'Found ' || n || ' oceanographic profiles',
    CASE WHEN len(regions) = 1 THEN 'in the ' || regions[1]
     WHEN len(regions) > 1 THEN 'across ' || array_to_string(regions, ', ') END,
    CASE WHEN len(parameters) > 0 THEN 'with measurements of ' || array_to_string(parameters, ', ') END,
    CASE WHEN max_levels IS NOT NULL THEN 'Profiles contain an average of ' || avg_levels
     || ' depth levels (up to ' || max_levels || ' levels)' END,
    CASE WHEN lat_min IS NOT NULL THEN 'All results are within your specified region' END,
    'Click on map markers to see exact locations, then select a profile to view detailed depth measurements.')
    || '.'
  WHEN lat_min IS NOT NULL THEN 'No oceanographic profiles found in region ' || {_bounds}
    || ' matching ''' || text
    || '''. Try expanding your search area or using different search terms.'
  ELSE 'No profiles found matching ''' || text || '''. Try terms like ''temperature'', '
    || '''salinity'', ''equator'', or ''Atlantic Ocean''.' END AS answer FROM joined""")
_advice = ("CASE type " + " ".join(f"WHEN '{t}' THEN '{a}'" for t, a in rules.RECOMMENDATIONS.items())
           + " ELSE '' END")


def _one(kind: str, severity: str, value: str, test: str, source: str) -> str:
    return (f"SELECT '{kind}' AS type, '{severity}' AS severity, '' AS subject, "
            f"{r6(f'CAST({value} AS DOUBLE)')} AS value FROM {source} WHERE {test}")


_issues = f"""WITH one AS (SELECT count(*) AS total, count(*) FILTER (parquet_path <> '') AS ok,
   count(*) FILTER (lat IS NULL OR lon IS NULL OR lat NOT BETWEEN -90 AND 90
     OR lon NOT BETWEEN -180 AND 180) AS invalid, {mean6('data_quality_score')} AS quality FROM catalog),
 by_type AS ({S['error_stats'][S['error_stats'].index('SELECT error_type'):]}),
 recent AS (SELECT coalesce(sum(count_24h), 0) AS n FROM by_type),
 gone AS (SELECT count(*) AS n FROM missing),
 dup AS (SELECT count(*) AS n FROM (SELECT profile_id FROM catalog GROUP BY 1 HAVING count(*) > 1)),
 store AS (SELECT (SELECT count(*) FROM vectors) AS v, (SELECT count(*) FROM catalog) AS c),
 files AS (SELECT count(*) AS n, count(*) FILTER (length = 0) AS empty FROM listing),
 found AS (
 {_one('no_data', 'warning', 'total', 'total = 0', 'one')} UNION ALL
 {_one('high_error_rate', 'warning', 'n', 'n > 10', 'recent')} UNION ALL
 {_one('orphaned_records', 'moderate', '1 - ok / total', '1 - ok / total > 1e-1', 'one')} UNION ALL
 {_one('no_parquet_files', 'warning', 'n', 'n = 0', 'files')} UNION ALL
 {_one('corrupt_parquet_files', 'moderate', 'empty', 'empty > 0', 'files')} UNION ALL
 {_one('embedding_db_mismatch', 'moderate', 'v - c', 'abs(v - c) > c * 1e-1', 'store')} UNION ALL
 {_one('missing_parquet_files', 'moderate', 'n', 'n > 0', 'gone')} UNION ALL
 {_one('duplicate_profiles', 'moderate', 'n', 'n > 0', 'dup')} UNION ALL
 {_one('invalid_coordinates', 'moderate', 'invalid', 'invalid > 0', 'one')} UNION ALL
 {_one('high_error_rate_24h', 'warning', 'n', 'n > 50', 'recent')} UNION ALL
 SELECT 'recurring_error_pattern', 'moderate', error_type, CAST(count AS DOUBLE) FROM by_type
  WHERE count > 20 UNION ALL
 {_one('low_average_quality', 'warning', 'quality', 'quality < 3e-1', 'one')})"""
S["health_issues"] = sql(f"{_issues} SELECT *, {_advice} AS recommendation FROM found")
S["health_recommendations"] = sql(f"""{_issues}, advised AS (SELECT *, {_advice} AS a FROM found)
 SELECT '{rules.SEVERITY_ADVICE['critical']}' AS recommendation FROM advised
  HAVING count(*) FILTER (severity = 'critical') > 0
 UNION ALL SELECT '{rules.SEVERITY_ADVICE['moderate']}' FROM advised
  HAVING count(*) FILTER (severity = 'moderate') > 3
 UNION ALL SELECT '{rules.SEVERITY_ADVICE['none']}' FROM advised
  HAVING count(*) FILTER (severity = 'critical') = 0 AND count(*) FILTER (severity = 'moderate') <= 3
  AND count(*) FILTER (a <> '') = 0
 UNION ALL SELECT DISTINCT a FROM advised WHERE a <> ''""")
S["health_report"] = sql(f"""{_issues}, metrics AS (SELECT {_metrics.format(t=T_ERR)} FROM catalog)
 SELECT 'issue' AS section, type || CASE WHEN subject <> '' THEN ':' || subject ELSE '' END AS name,
  value FROM found
 UNION ALL SELECT 'metric', unnest(['total_profiles', 'avg_levels', 'unique_floats', 'avg_quality',
  'records_today']), unnest([CAST(total_profiles AS DOUBLE), avg_levels, unique_floats, avg_quality,
  records_today]) FROM metrics
 UNION ALL SELECT 'quality', {_tier}, CAST(count(*) AS DOUBLE) FROM catalog GROUP BY 2
 UNION ALL SELECT 'error', error_type, CAST(count AS DOUBLE) FROM by_type""")
_broken = """broken AS (SELECT * REPLACE (CASE WHEN id % 7 <> 0 THEN parquet_path END AS parquet_path), id AS seq FROM catalog
   UNION ALL SELECT * REPLACE (CASE WHEN id % 7 <> 0 THEN parquet_path END AS parquet_path, NULL AS data_quality_score),
     id + 1000000000 FROM catalog WHERE id % 50 = 0),
 left_over AS (SELECT * FROM listing WHERE CAST(regexp_extract(path, 'P([0-9]+)', 1) AS BIGINT) % 17 <> 0),
 gone_ids AS (SELECT profile_id FROM broken WHERE parquet_path <> '' AND parquet_path NOT IN (SELECT path FROM left_over)),
 wants AS (SELECT count(*) FILTER (parquet_path <> '') < 9e-1 * count(*) AS orphans, (SELECT count(*) FROM gone_ids) > 0 AS missing,
   count(*) > count(DISTINCT profile_id) AS twice, bool_or(lat IS NULL OR lon IS NULL OR lat NOT BETWEEN -90 AND 90
   OR lon NOT BETWEEN -180 AND 180) AS lost FROM broken)"""
S["repair_plan"] = sql(f"""WITH {_broken} SELECT CAST(unnest([0, 1, 2, 3, 4]) AS INT) AS step,
 unnest(['mark_orphans', 'mark_missing_levels', 'latest_per_profile', 'drop_invalid_coordinates', 'default_quality']) AS repair,
 unnest([orphans, missing, twice, lost, true]) AS wanted FROM wants""")
_repaired = """coalesce(CASE WHEN orphans AND coalesce(parquet_path, '') = '' AND extraction_method <> 'minimal_fallback' THEN least(data_quality_score, 2e-1)
   ELSE data_quality_score END * CASE WHEN missing AND profile_id IN (SELECT profile_id FROM gone_ids) THEN 5e-1 ELSE 1e0 END, 1e-1)"""
S["repair_catalog"] = sql(f"""WITH {_broken} SELECT profile_id, seq,
 CASE WHEN NOT (missing AND profile_id IN (SELECT profile_id FROM gone_ids)) THEN parquet_path END AS parquet_path,
 {r6(_repaired)} AS data_quality_score,
 CASE WHEN orphans AND coalesce(parquet_path, '') = '' AND extraction_method <> 'minimal_fallback' THEN 'orphaned' END AS status
 FROM broken, wants WHERE (NOT lost OR (lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180))
 QUALIFY NOT twice OR row_number() OVER (PARTITION BY profile_id ORDER BY seq DESC) = 1""")
S["ingest_catalog"] = sql("""SELECT profile_id, float_id, lat, lon, time_start, n_levels,
 array_to_string(variables, ',') AS variables, data_quality_score FROM scored
 WHERE reason = 'accepted'""")
S["ingest_two_runs"] = sql("""SELECT profile_id, float_id, lat, lon, time_start, n_levels,
 array_to_string(variables, ',') AS variables, data_quality_score, true AS has_levels,
 true AS has_vector FROM scored WHERE reason = 'accepted'""")
S["ingest_late_retry"] = S["ingest_two_runs"]
S["ingest_incremental"] = sql("""SELECT profile_id, float_id, lat, lon, time_start, n_levels,
 array_to_string(variables, ',') AS variables, data_quality_score,
 CASE WHEN profile_key % 2 = 0 THEN 3 ELSE 1 END AS run, true AS idle_when_nothing_is_new
 FROM scored WHERE reason = 'accepted' AND (profile_key % 2 = 1 OR profile_key % 3 <> 0)""")
# the candidates of the fallback, then what the chosen strategy of each file reads
_cand = _fallback[:_fallback.index(" SELECT source_file, profile_id, lat, lon, n_levels, variables_csv, extraction_method,\n  coalesce")].rstrip()
_std_of = "coalesce(std, regexp_replace(upper(var_name), '[^A-Z0-9_]', '', 'g'))"
_routed = sql(f"""{_cand},
 picked AS (SELECT source_file, min(priority) AS best FROM cand GROUP BY 1),
 bad_values AS (SELECT {_renamed} AS source_file, profile_key, level_idx, value,
   CASE WHEN {_fno} % 10 = 3 THEN 'x-' || var_name ELSE var_name END AS var_name
   FROM cleaned WHERE value IS NOT NULL),
 counted AS (SELECT source_file, profile_key, var_name, best, max(level_idx) + 1 AS n_trimmed
   FROM bad_values JOIN picked USING (source_file) GROUP BY ALL),
 plan AS (
   SELECT DISTINCT source_file, var_name, std AS name, NULL AS only_key
   FROM counted JOIN {_alias_upper} ON up = var_name WHERE best = 0 AND var_name IN ('TEMP', 'PSAL', 'DOXY', 'PRES')
   UNION ALL SELECT source_file, var_name, std_name, NULL FROM resolved JOIN picked USING (source_file) WHERE best = 1
   UNION ALL SELECT source_file, var_name, {_std_of}, profile_key FROM counted
   LEFT JOIN {_alias_upper} ON up = upper(var_name)
   WHERE best IN (2, 3) QUALIFY row_number() OVER (PARTITION BY source_file, var_name
     ORDER BY n_trimmed DESC, profile_key) = 1 AND (best = 2 OR n_trimmed > 1)),
 read AS (SELECT source_file, CASE WHEN only_key IS NULL THEN profile_key ELSE 0 END AS profile_key, name, level_idx, value
   FROM bad_values JOIN plan USING (source_file, var_name) WHERE only_key IS NULL OR only_key = profile_key),
 per_name AS (SELECT source_file, profile_key, name, max(level_idx) + 1 AS n_trimmed, count(*) AS n_values,
   min(value) AS least, max(value) AS greatest FROM read GROUP BY ALL),
 measured AS (SELECT source_file, profile_key, max(n_trimmed) AS n_levels, sum(n_trimmed) AS n_cells,
   sum(n_values) AS n_values, list_sort(list(name)) AS names,
   count(*) FILTER (name IN ('TEMPERATURE', 'SALINITY', 'PRESSURE')) AS n_key FROM per_name GROUP BY ALL),
 owners AS (
   SELECT p.source_file, p.profile_key, best, {_stem_of.replace('source_file', 'p.source_file')} || '_profile_' || p.profile_key AS profile_id,
     CASE best WHEN 0 THEN e.lat ELSE p.lat END AS lat, CASE best WHEN 0 THEN e.lon ELSE p.lon END AS lon
   FROM place p JOIN picked k ON k.source_file = p.source_file LEFT JOIN exact_place e
     ON e.source_file = p.source_file AND e.profile_key = p.profile_key WHERE best <= 1
   UNION ALL SELECT k.source_file, 0, best, {_stem_of.replace('source_file', 'k.source_file')} || CASE best WHEN 2 THEN '_simple_profile' WHEN 3 THEN '_any_data'
     ELSE '_minimal' END, CASE best WHEN 2 THEN f.lat WHEN 3 THEN 125e-1 ELSE {_by_name.format('125e-1').replace('source_file', 'k.source_file')} END,
     CASE best WHEN 2 THEN f.lon WHEN 3 THEN -65e0 ELSE {_by_name.format('-65e0').replace('source_file', 'k.source_file')} END
   FROM picked k LEFT JOIN first_place f USING (source_file) WHERE best >= 2),
 routed AS (SELECT o.*, coalesce(n_levels, 0) AS n_levels, coalesce(names, []) AS names,
   ['exact_schema', 'standard', 'simple_variables', 'any_numeric', 'minimal_fallback'][best + 1] AS extraction_method,
   CASE WHEN coalesce(n_cells, 0) = 0 THEN 1e-1 ELSE round(CAST(n_values AS DOUBLE) / n_cells * (5e-1 + 5e-1 * n_key / 3)
     * CASE WHEN lat IS NOT NULL AND lon IS NOT NULL AND NOT ({_known}) THEN 5e-1 ELSE 1e0 END, 6) END AS data_quality_score,
   CASE WHEN lat IS NULL OR lon IS NULL THEN 'missing_coordinates' WHEN NOT ({_known}) THEN 'coordinates_out_of_range'
     WHEN n_cells IS NULL AND best < 4 THEN 'no_data' ELSE 'accepted' END AS reason
   FROM owners o LEFT JOIN measured USING (source_file, profile_key))""" + " {0}")
S["ingest_with_fallback"] = _routed.replace("{0}", """SELECT profile_id, lat, lon, CAST(n_levels AS BIGINT) AS n_levels,
 array_to_string(names, ',') AS variables_csv, extraction_method, data_quality_score, reason FROM routed""")
S["ingest_fallback_values"] = _routed.replace("{0}", """SELECT profile_id, name, n_values, least, greatest
 FROM per_name JOIN routed USING (source_file, profile_key) WHERE reason = 'accepted'""")
S["ingest_methods"] = _routed.replace("{0}", f"""SELECT extraction_method, count(*) AS count,
 {mean6('data_quality_score')} AS avg_quality FROM routed WHERE reason = 'accepted' GROUP BY 1""")

# --- the published store -----------------------------------------------------
S["store_metrics"] = sql(f"""SELECT count(*) AS total_profiles, {mean6('n_levels')} AS avg_levels,
 count(DISTINCT float_id) AS unique_floats, {mean6('data_quality_score')} AS avg_quality, 0 AS records_today
 FROM store_catalog""")
S["store_overview"] = sql(f"""SELECT count(*) AS matching_profiles, count(DISTINCT {LABEL}) AS n_regions,
 (SELECT count(DISTINCT v) FROM (SELECT unnest(variables) AS v FROM store_catalog)) AS n_parameters,
 max(max_depth) AS max_depth FROM store_catalog""")
S["store_collection"] = sql(f"""SELECT count(*) AS profile_count,
 (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT unnest(variables) AS v FROM store_catalog)) AS variables_available,
 (SELECT string_agg(r, ',' ORDER BY r) FROM (SELECT DISTINCT {LABEL} AS r FROM store_catalog)) AS regions_covered,
 min(time_start) AS time_from, max(time_start) AS time_to, min(lat) AS lat_min,
 max(lat) AS lat_max, min(lon) AS lon_min, max(lon) AS lon_max, max(max_depth) AS depth_max
 FROM store_catalog""")
S["store_depth_series"] = sql("""SELECT s.profile_id, pressure AS depth, temperature, salinity, oxygen
 FROM aligned a JOIN stored s ON a.source_file = s.source_file AND a.profile_key = s.profile_key""")
S["store_groups"] = sql("""SELECT profile_id, rule, array_to_string(list_sort(list_filter([
  CASE WHEN list_contains(variables, 'TEMPERATURE') THEN 'temperature' END, CASE WHEN list_contains(variables, 'SALINITY') THEN 'salinity' END,
  CASE WHEN list_contains(variables, 'OXYGEN') THEN 'dissolved oxygen' END], lambda w: w IS NOT NULL)), ',') AS phrases
 FROM store_catalog JOIN (VALUES ('core', ['TEMPERATURE', 'SALINITY', 'PRESSURE']), ('bgc', ['OXYGEN', 'NITRATE', 'CHLOROPHYLL', 'PH']),
  ('nutrients', ['NITRATE'])) AS g(rule, names) ON list_has_any(variables, names)""")
_store_issues = _issues.replace("FROM catalog", "FROM store_catalog").replace("FROM missing", "FROM store_missing").replace(
    "FROM listing", "FROM store_listing").replace("FROM vectors", "FROM store_vectors")
_types = "SELECT error_type, count(*) AS count, count(*) AS count_24h FROM store_errors GROUP BY 1"
_old_types = S['error_stats'][S['error_stats'].index('SELECT error_type'):]
S["store_health"] = sql(f"{_store_issues.replace(_old_types, _types)} SELECT *, {_advice} AS recommendation FROM found")
S["ingest_levels"] = sql("""SELECT s.profile_id, s.float_id, a.level_idx, temperature, salinity,
 pressure, oxygen FROM aligned a JOIN scored s ON a.source_file = s.source_file
 AND a.profile_key = s.profile_key WHERE s.reason = 'accepted'""")
S["ingest_region_stats"] = sql(f"""SELECT {STATS_LADDER} AS region, {_means}, {_spread} FROM scored
 WHERE reason = 'accepted' GROUP BY 1""")

STATEMENTS = S
