"""Common table expressions shared by the statements."""

from __future__ import annotations

from halocast import rules
from halocast.sources import fixtures as fx


def project(columns: dict[str, str], source: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + f" FROM {source}"


def r6(x: str) -> str:
    return f"(round({x}, 6) + 0e0)"


def mean6(x: str) -> str:
    """Mean to six digits, half away from zero, by whole-number arithmetic."""
    total = f"sum(CAST(round({x} * 1e12) AS HUGEINT))"
    return (f"(CAST(sign({total}) * ((abs({total}) + count({x}) * 500000) "
            f"// (count({x}) * 1000000)) AS DOUBLE) / 1e6)")


def pick(names: list, key: str) -> str:
    """CASE over (key % 4)."""
    arms = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names) if n)
    return f"CASE {key} % 4 {arms} END"


def pick_mod(names: list, key: str) -> str:
    arms = " ".join(f"WHEN {i} THEN '" + n.replace("'", "''") + "'" for i, n in enumerate(names))
    return f"CASE {key} % {len(names)} {arms} END"


_numbered = (
    "SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY " + ", ".join(fx.LEVEL_ORDER)
    + ") - 1 AS INT) AS level_idx FROM lineitem")
_raw_parts = " UNION ALL ".join(
    f"SELECT {fx.SOURCE_FILE.format(key='l_orderkey')} AS source_file, l_orderkey AS profile_key, "
    f"{pick(names, 'l_orderkey')} AS var_name, level_idx, {fx.RAW_VALUES[std]} AS value "
    "FROM numbered" for std, names in fx.RAW_NAMES.items())

_days = "CAST(date_diff('day', DATE '1950-01-01', CAST(o_orderdate AS DATE)) AS VARCHAR)"
_scalar_value = {
    "latitude": f"CAST(CAST({fx.LAT} AS DECIMAL(9,2)) AS VARCHAR)",
    "longitude": f"CAST(CAST({fx.LON} AS DECIMAL(9,2)) AS VARCHAR)",
    "time": f"""CASE WHEN o_orderkey % 229 = 0 THEN NULL WHEN o_orderkey % 233 = 0 THEN 'junk'
        WHEN o_orderkey % 4 = 0 THEN {_days} WHEN o_orderkey % 4 = 1 THEN {_days} || '.5'
        WHEN o_orderkey % 4 = 2 THEN strftime(o_orderdate, '%Y-%m-%d')
        ELSE strftime(o_orderdate, '%Y%m%d') END""",
    "platform": """CASE WHEN o_orderkey % 239 = 0 THEN 'nan' WHEN o_orderkey % 241 = 0 THEN ' '
        ELSE 'F' || CAST(o_custkey AS VARCHAR) || '  ' END""",
}
_dtype = {"latitude": "'float64'", "longitude": "'float64'", "platform": "'str'",
          "time": "CASE WHEN o_orderkey % 4 < 2 THEN 'float64' ELSE 'str' END"}
_scalar_file = fx.SOURCE_FILE.format(key="o_orderkey")
_scalars = " UNION ALL ".join(
    [f"SELECT {_scalar_file} AS source_file, o_orderkey AS profile_key, "
     f"{pick(names, 'o_orderkey')} AS name, {_scalar_value[kind]} AS value, "
     f"{_dtype[kind]} AS dtype FROM orders" for kind, names in fx.SCALAR_NAMES.items()]
    + [f"SELECT {_scalar_file}, o_orderkey, 'WMO_INST_TYPE', '846', 'str' FROM orders "
       "WHERE o_orderkey % 6 = 0"])

_file_no = "CAST(regexp_extract(source_file, '([0-9]+)', 1) AS INT)"


def alias_values(kind: str, exclude_qc: bool = True, names=None) -> str:
    rows = [r[1:] for r in rules.alias_rows(exclude_qc, names) if r[0] == kind]
    return f"({rules.values_sql(rows)}) AS a(std_name, variant, priority)"


_inf = "(value = 'infinity'::DOUBLE OR value = '-infinity'::DOUBLE)"
_measured = "count(pres) + count(temp) + count(psal) + count(doxy)"
_profile_dims = "['N_PROF','N_PROFILES','profile','PROFILE']"
_level_dims = "['N_LEVELS','N_LEVEL','level','DEPTH']"

CTES: dict[str, str] = {
    "profiles": "SELECT *, string_split(variables_csv, ',') AS variables FROM ("
                + project(fx.PROFILE_COLUMNS, "orders") + ")",
    "levels": project(fx.LEVEL_COLUMNS, "lineitem"),
    "level_facts": f"""SELECT profile_id, count(*) AS n_levels, max(pres) AS max_depth,
        round(({_measured}) / (count(*) * 4), 6) AS data_quality_score
        FROM levels GROUP BY profile_id""",
    "catalog": """SELECT p.*, coalesce(f.n_levels, 0) AS n_levels, f.max_depth,
        f.data_quality_score, p.time_start AS created_at
        FROM profiles p LEFT JOIN level_facts f USING (profile_id)""",
    "numbered": _numbered,
    "raw": f"SELECT * FROM ({_raw_parts}) WHERE var_name IS NOT NULL",
    "cleaned": f"""SELECT source_file, profile_key, var_name, level_idx,
        CASE WHEN isnan(value) OR {_inf} THEN NULL ELSE value END AS value FROM raw""",
    "scalars": f"SELECT * FROM ({_scalars})",
    "shapes": """SELECT source_file, CAST(max(profile_key // 500) + 1 AS INT) AS n_prof,
        max(level_idx) + 1 AS n_lev FROM raw GROUP BY source_file""",
    "var_names": f"""SELECT DISTINCT source_file, var_name, 'float64' AS dtype FROM raw
        UNION ALL SELECT e.source_file, e.var_name, e.dtype FROM (
          SELECT source_file, 'TEMP_ADJUSTED' AS var_name, 'float64' AS dtype FROM shapes
            WHERE {_file_no} % 20 = 0
          UNION ALL SELECT source_file, 'TEMP_QC', 'S1' FROM shapes WHERE {_file_no} % 20 = 3
          UNION ALL SELECT source_file, 'SALINITY', 'float32' FROM shapes WHERE {_file_no} % 7 = 0
        ) e WHERE NOT EXISTS (SELECT 1 FROM raw r WHERE r.source_file = e.source_file
                              AND r.var_name = e.var_name)""",
    "variables": f"""SELECT source_file, var_name, dtype,
        CASE WHEN n % 5 = 1 THEN [lev_dim, prof_dim] ELSE [prof_dim, lev_dim] END AS dims,
        CASE WHEN n % 5 = 1 THEN [n_lev, n_prof] ELSE [n_prof, n_lev] END AS shape
        FROM (SELECT *, CASE WHEN n % 11 = 0 THEN 'STATION' ELSE {_profile_dims}[n % 4 + 1] END
                AS prof_dim,
              CASE WHEN n % 11 = 0 THEN 'Z' ELSE {_level_dims}[n % 4 + 1] END AS lev_dim
              FROM (SELECT v.*, s.n_prof, s.n_lev, CAST(regexp_extract(v.source_file, '([0-9]+)', 1)
                    AS INT) AS n FROM var_names v JOIN shapes s USING (source_file)))""",
    "resolved": f"""SELECT source_file, std_name, arg_min(variant, priority) AS var_name
        FROM var_names JOIN {alias_values('variable')} ON var_name = variant
        GROUP BY source_file, std_name""",
    "coords": f"""SELECT source_file, profile_key,
        arg_min(value, priority) FILTER (std_name = 'latitude' AND value IS NOT NULL) AS latitude,
        arg_min(value, priority) FILTER (std_name = 'longitude' AND value IS NOT NULL) AS longitude,
        arg_min(value, priority) FILTER (std_name = 'time' AND value IS NOT NULL) AS time,
        arg_min(dtype, priority) FILTER (std_name = 'time' AND value IS NOT NULL) AS time_dtype,
        arg_min(value, priority) FILTER (std_name = 'platform' AND value IS NOT NULL) AS platform
        FROM scalars JOIN {alias_values('coordinate')} ON name = variant
        GROUP BY source_file, profile_key""",
    "var_facts": """SELECT source_file, profile_key, var_name,
        CAST(max(level_idx) + 1 AS BIGINT) AS n_stored,
        CAST(coalesce(max(level_idx) FILTER (value IS NOT NULL), -1) + 1 AS BIGINT) AS n_trimmed,
        count(value) AS n_values FROM cleaned GROUP BY ALL""",
    "facts": """SELECT f.*, r.std_name FROM var_facts f
        JOIN resolved r ON f.source_file = r.source_file AND f.var_name = r.var_name""",
    "per_profile": """SELECT source_file, profile_key, max(n_trimmed) AS n_levels,
        list_sort(list_distinct(list(std_name) FILTER (n_values > 0))) AS variables,
        CAST(sum(n_values) AS BIGINT) AS n_values, CAST(sum(n_trimmed) AS BIGINT) AS n_cells,
        count(DISTINCT std_name) FILTER (n_values > 0 AND std_name IN
          ('TEMPERATURE','SALINITY','PRESSURE')) AS n_key
        FROM facts GROUP BY source_file, profile_key""",
    "assembled": """SELECT c.source_file, c.profile_key,
        replace(c.source_file, '.nc', '') || '_profile_' || c.profile_key AS profile_id,
        CASE WHEN platform IS NULL OR trim(platform) IN ('', 'nan')
          THEN 'float_' || left(lpad(CAST(c.profile_key AS VARCHAR), 4, '0'), 4)
          ELSE trim(platform) END AS float_id,
        CAST(latitude AS DOUBLE) AS lat, CAST(longitude AS DOUBLE) AS lon,
        CASE WHEN time_dtype = 'float64' THEN
               CASE WHEN try_cast(time AS DOUBLE) > 10000 THEN TIMESTAMP '1950-01-01'
                 + to_seconds(CAST(floor(try_cast(time AS DOUBLE) * 86400) AS BIGINT)) END
             WHEN regexp_full_match(time, '\\d{4}-\\d{2}-\\d{2}') THEN strptime(time, '%Y-%m-%d')
             WHEN regexp_full_match(time, '\\d{8}') THEN strptime(time, '%Y%m%d') END AS time_start,
        coalesce(n_levels, 0) AS n_levels, coalesce(variables, []) AS variables,
        coalesce(n_values, 0) AS n_values, coalesce(n_cells, 0) AS n_cells,
        coalesce(n_key, 0) AS n_key
        FROM coords c LEFT JOIN per_profile p
          ON c.source_file = p.source_file AND c.profile_key = p.profile_key""",
    "judged": """SELECT *, CASE WHEN lat IS NULL OR lon IS NULL THEN 'missing_coordinates'
        WHEN lat < -90 OR lat > 90 OR lon < -180 OR lon > 180 THEN 'coordinates_out_of_range'
        WHEN n_values = 0 THEN 'no_data' ELSE 'accepted' END AS reason FROM assembled""",
    "scored": """SELECT *, CASE WHEN n_cells = 0 THEN 1e-1 ELSE round(
        CAST(n_values AS DOUBLE) / n_cells * (5e-1 + 5e-1 * n_key / 3)
        * CASE WHEN lat IS NOT NULL AND lon IS NOT NULL
               AND NOT (lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180)
               THEN 5e-1 ELSE 1e0 END, 6) END AS data_quality_score FROM judged""",
    "standard_values": """SELECT c.source_file, c.profile_key, c.level_idx, r.std_name, c.value
        FROM cleaned c JOIN resolved r
          ON c.source_file = r.source_file AND c.var_name = r.var_name""",
    "aligned": """SELECT source_file, profile_key, level_idx,
        max(value) FILTER (std_name = 'TEMPERATURE') AS temperature,
        max(value) FILTER (std_name = 'SALINITY') AS salinity,
        max(value) FILTER (std_name = 'PRESSURE') AS pressure,
        max(value) FILTER (std_name = 'OXYGEN') AS oxygen
        FROM standard_values WHERE value IS NOT NULL GROUP BY ALL""",
    "stored": """SELECT *, profile_key % 2 AS run, CAST('0x' || substr(md5(float_id), 1, 8) AS BIGINT) % 32 AS bucket
        FROM scored WHERE reason = 'accepted'""",
    "store_catalog": """SELECT profile_id, float_id, lat, lon, time_start, n_levels, variables, source_file,
        array_to_string(variables, ',') AS variables_csv, data_quality_score, run, bucket,
        'run=' || run || '/float_bucket=' || bucket AS parquet_path, max_depth
        FROM stored LEFT JOIN (SELECT source_file, profile_key, max(pressure) AS max_depth FROM aligned GROUP BY ALL)
          USING (source_file, profile_key)""",
    "store_listing": """SELECT DISTINCT parquet_path AS path, CASE WHEN run = 1 AND bucket = 7 THEN 0 ELSE 1 END AS length
        FROM store_catalog WHERE NOT (run = 1 AND bucket = 3)""",
    "store_missing": "SELECT profile_id, parquet_path FROM store_catalog WHERE run = 1 AND bucket = 3",
    "store_vectors": "SELECT profile_id FROM store_catalog",
    "store_errors": "SELECT CASE WHEN reason = 'no_data' THEN 'NO_PROFILES' ELSE 'CRITICAL_ERROR' END AS error_type FROM judged WHERE reason <> 'accepted'",
    "vectors": "SELECT 'P' || vec_id AS profile_id, vec_id, embedding, label FROM embeddings",
    "errors": project(fx.ERROR_COLUMNS, "events") + " WHERE event_type = 'error'",
    "batches": project(fx.BATCH_COLUMNS, "events"),
    "query_log": f"""SELECT 'Q' || conv_id || '_' || turn AS query_id, conv_id,
        text || ' ' || {pick_mod(fx.QUERY_PHRASES, '(conv_id * 3 + turn)')} AS text,
        CAST((conv_id + turn) % 5 + 1 AS INT) AS k, conv_id % 4 <> 0 AS geographic_filter,
        conv_id % 3 <> 0 AS temporal_filter FROM conversations WHERE role = 'user'""",
    "texts": """SELECT query_id, text FROM query_log
        UNION ALL SELECT 'D' || doc_id, text FROM documents""",
    "corpus": """SELECT v.profile_id, CAST(v.embedding AS DOUBLE[]) AS embedding, p.lat, p.lon,
        p.time_start FROM vectors v LEFT JOIN profiles p USING (profile_id)""",
    "asked_vectors": """SELECT q.*, CAST(e.embedding AS DOUBLE[]) AS query_vector
        FROM query_log q JOIN embeddings e ON e.vec_id = q.conv_id""",
    "distances": """SELECT q.query_id, c.profile_id,
        round(list_distance(c.embedding, q.query_vector) ** 2, 9) + 0e0 AS distance
        FROM asked_vectors q CROSS JOIN corpus c""",
    "listing": """SELECT 'store/' || profile_id || '.parquet' AS path, count(*) * 64 AS length
        FROM levels GROUP BY profile_id""",
    "missing": """SELECT profile_id, parquet_path FROM profiles WHERE parquet_path IS NOT NULL
        AND parquet_path <> '' AND parquet_path NOT IN (SELECT path FROM listing)""",
}


def sql(body: str, *names: str) -> str:
    """The body behind the named expressions and what those refer to."""
    import re

    needed: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"(FROM|JOIN)\s+{name}\b", text):
                visit(CTES[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    for name in names:
        visit(f"FROM {name}")
    if not needed:
        return body
    head = ", ".join(f"{n} AS ({CTES[n]})" for n in needed)
    return (f"WITH {head}, " + body[5:]) if re.match(r"WITH\s", body) else f"WITH {head} {body}"


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
         f" * pow(sin(radians({lon2} - {lon1}) / 2), 2))")
    return f"(2 * 6371e0 * atan2(sqrt({a}), sqrt(greatest(0e0, 1 - {a}))))"


STATS_LADDER = """CASE WHEN lat BETWEEN 10 AND 25 AND lon BETWEEN 50 AND 75 THEN 'Arabian Sea'
 WHEN lat BETWEEN 5 AND 22 AND lon BETWEEN 80 AND 100 THEN 'Bay of Bengal'
 WHEN lat BETWEEN -10 AND 10 THEN 'Equatorial'
 WHEN lat BETWEEN 30 AND 46 AND lon BETWEEN -6 AND 42 THEN 'Mediterranean'
 WHEN lon BETWEEN -80 AND 20 THEN 'Atlantic Ocean'
 WHEN lon BETWEEN 120 AND 180 OR lon BETWEEN -180 AND -70 THEN 'Pacific Ocean'
 ELSE 'Other Region' END"""
LABEL = f"CASE WHEN lat IS NULL OR lon IS NULL THEN 'Unknown' ELSE {STATS_LADDER} END"
BASIC_LADDER = """CASE WHEN lat BETWEEN 10 AND 25 AND lon BETWEEN 50 AND 75 THEN 'Arabian Sea'
 WHEN lat BETWEEN -10 AND 10 THEN 'Equatorial'
 WHEN lat BETWEEN 30 AND 46 AND lon BETWEEN -6 AND 42 THEN 'Mediterranean'
 WHEN lon BETWEEN -80 AND 20 THEN 'Atlantic'
 WHEN lon BETWEEN 120 AND 180 OR lon BETWEEN -180 AND -70 THEN 'Pacific' ELSE 'Other' END"""
BAND_LADDER = """CASE WHEN lat BETWEEN -10 AND 10 THEN 'Equatorial' WHEN lat > 40 THEN 'Northern High'
 WHEN lat < -40 THEN 'Southern High' WHEN lat > 0 THEN 'Northern Mid' ELSE 'Southern Mid' END"""
ANSWER_LADDER = """CASE WHEN lat BETWEEN 10 AND 25 AND lon BETWEEN 50 AND 75 THEN 'Arabian Sea'
 WHEN lat BETWEEN 5 AND 22 AND lon BETWEEN 80 AND 100 THEN 'Bay of Bengal'
 WHEN lat BETWEEN -10 AND 10 THEN 'equatorial waters'
 WHEN lat BETWEEN 30 AND 46 AND lon BETWEEN -6 AND 42 THEN 'Mediterranean Sea'
 WHEN lon BETWEEN -80 AND 20 THEN 'Atlantic Ocean'
 WHEN lon BETWEEN 120 AND 180 OR lon BETWEEN -180 AND -70 THEN 'Pacific Ocean' END"""
HEMISPHERE_LADDER = """CASE WHEN lat IS NULL OR lon IS NULL THEN NULL
 WHEN lat BETWEEN 10 AND 25 AND lon BETWEEN 50 AND 75 THEN 'Arabian Sea'
 WHEN lat BETWEEN -10 AND 10 THEN 'Equatorial region' WHEN lat > 0 THEN 'Northern Hemisphere'
 ELSE 'Southern Hemisphere' END"""


def basin(west: int) -> str:
    return f"""CASE WHEN lat IS NULL OR lon IS NULL THEN NULL
 WHEN lon BETWEEN {west} AND -30 THEN CASE WHEN lat > 0 THEN 'North Atlantic' ELSE 'South Atlantic' END
 WHEN lon BETWEEN -30 AND 20 THEN CASE WHEN lat > 30 THEN 'North Atlantic'
   WHEN lat < -30 THEN 'South Atlantic' ELSE 'tropical Atlantic' END
 WHEN lon BETWEEN 20 AND 120 THEN CASE WHEN lat > 0 THEN 'North Indian Ocean'
   ELSE 'South Indian Ocean' END
 WHEN lon BETWEEN 120 AND 180 OR lon BETWEEN -180 AND {west} THEN
   CASE WHEN lat > 0 THEN 'North Pacific' ELSE 'South Pacific' END
 ELSE 'Pacific Ocean' END"""


POSITION = """CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN
 printf('%.2f', abs(lat)) || '°' || CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END || ', '
 || printf('%.2f', abs(lon)) || '°' || CASE WHEN lon >= 0 THEN 'E' ELSE 'W' END END"""
SIGNED = """CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN
 printf('%.2f', lat) || '°N, ' || printf('%.2f', lon) || '°E' END"""


# --- constraints in texts ----------------------------------------------------
def region_lookup(ruleset: str, match: str, source: str, want: str = "name") -> str:
    """(query_id, wanted columns): the region chosen per text."""
    order = "priority" if match == "first" else "-length(name) * 100 + priority"
    rows = rules.values_sql(rules.region_rows(ruleset))
    cols = ", ".join(f"arg_min({c}, {order}) AS {c}" for c in want.split(","))
    return (f"(SELECT query_id, {cols} FROM {source} JOIN ({rows}) "
            "AS r(priority, name, lat_min, lat_max, lon_min, lon_max) "
            "ON contains(lower(text), name) GROUP BY query_id)")


POINT = {
    "base": r"(\d+\.?\d*)[°]?\s*([NS])\s*,?\s*(\d+\.?\d*)[°]?\s*([EW])",
    "enhanced": r"(\d+\.?\d*)[°]?([NS])\s*,?\s*(\d+\.?\d*)[°]?([EW])",
}


def point_part(ruleset: str) -> str:
    p = POINT[ruleset]
    found = f"regexp_matches(text, '{p}')"
    lat = (f"CASE WHEN {found} THEN CAST(regexp_extract(text, '{p}', 1) AS DOUBLE) "
           f"* CASE WHEN regexp_extract(text, '{p}', 2) = 'N' THEN 1 ELSE -1 END END")
    lon = (f"CASE WHEN {found} THEN CAST(regexp_extract(text, '{p}', 3) AS DOUBLE) "
           f"* CASE WHEN regexp_extract(text, '{p}', 4) = 'E' THEN 1 ELSE -1 END END")
    return f"{lat} AS plat, {lon} AS plon"


def constrained(ruleset: str, source: str) -> str:
    """Texts with their box: named region, else the box around a point."""
    want = "name,lat_min,lat_max,lon_min,lon_max"
    return f"""(SELECT t.query_id, coalesce(g.name, CASE WHEN t.plat IS NOT NULL THEN 'point' END)
        AS region_name, coalesce(g.lat_min, t.plat - 5) AS lat_min,
        coalesce(g.lat_max, t.plat + 5) AS lat_max, coalesce(g.lon_min, t.plon - 5) AS lon_min,
        coalesce(g.lon_max, t.plon + 5) AS lon_max
        FROM (SELECT query_id, {point_part(ruleset)} FROM {source}) t
        LEFT JOIN {region_lookup(ruleset, 'longest', source, want)} g USING (query_id))"""


MONTHS = """CASE WHEN regexp_matches(lower(text), 'last 6 months|past 6 months') THEN 6
 WHEN regexp_matches(lower(text), 'last year|past year') THEN 12
 WHEN contains(lower(text), 'last 3 months') THEN 3 END"""
YEAR = f"""CASE WHEN ({MONTHS}) IS NULL AND regexp_matches(text, '20\\d{{2}}')
 THEN CAST(regexp_extract(text, '(20\\d{{2}})', 1) AS INT) END"""

IN_OWN_BOX = """(lat BETWEEN lat_min AND lat_max AND CASE WHEN lon_min > lon_max
 THEN lon >= lon_min OR lon <= lon_max ELSE lon BETWEEN lon_min AND lon_max END)"""
CENTER_LON = """CASE WHEN lon_min <= lon_max THEN (lon_min + lon_max) / 2
 WHEN (lon_min + lon_max + 360) / 2 > 180 THEN (lon_min + lon_max + 360) / 2 - 360
 ELSE (lon_min + lon_max + 360) / 2 END"""
