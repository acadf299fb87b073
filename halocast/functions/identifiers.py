"""Names, ids and values cleaned by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from halocast import rules
from halocast.functions.geo import _col


def clean_platform(platform, profile_idx) -> Column:
    """Platform number without NUL and blanks; '' and 'nan' become float_%04d."""
    text = F.trim(F.regexp_replace(_col(platform), "\\x00", ""))
    fallback = F.concat(F.lit("float_"), F.lpad(_col(profile_idx).cast("string"), 4, "0"))
    return F.when(text.isNull() | (text == "") | (text == "nan"), fallback).otherwise(text)


def clean_filename(name) -> Column:
    """Safe file or directory name of at most 100 characters, never empty."""
    text = F.regexp_replace(F.regexp_replace(_col(name), r"[/\\: <>]", "_"), r"[^A-Za-z0-9_.\-]", "")
    return F.when(text == "", "unknown").otherwise(F.substring(text, 1, 100))


def safe_column_name(name) -> Column:
    """Lower-cased column name of at most 60 characters, never starting with a digit."""
    text = F.regexp_replace(F.lower(_col(name)), "[^a-z0-9]", "_")
    text = F.regexp_replace(text, "^_+|_+$", "")
    text = F.when(text.rlike("^[0-9]"), F.concat(F.lit("var_"), text)).otherwise(text)
    return F.when(text == "", "unknown_var").otherwise(F.substring(text, 1, 60))


def file_stem(path) -> Column:
    return F.regexp_extract(_col(path), r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)


# fixed values: the three id formats
PROFILE_ID_SEPARATORS = {"ingest": "::profile_", "robust": "_profile_", "optimized": "_prof_"}


def build_profile_id(path, profile_idx, style: str = "robust") -> Column:
    return F.concat(file_stem(path), F.lit(PROFILE_ID_SEPARATORS[style]),
                    _col(profile_idx).cast("string"))


def coords_from_filename(name) -> tuple[Column, Column]:
    """(lat, lon) read from names such as ``x_12.5N_65W.nc``; null where absent."""
    pattern, name = r"(\d+\.?\d*)([NS])_(\d+\.?\d*)([EW])", _col(name)
    part = [F.regexp_extract(name, pattern, i) for i in range(1, 5)]
    lat = part[0].try_cast("double") * F.when(part[1] == "S", -1.0).otherwise(1.0)
    lon = part[2].try_cast("double") * F.when(part[3] == "W", -1.0).otherwise(1.0)
    return lat, lon


def map_standard_name(name) -> Column:
    """Standard name of a variable, or its cleaned upper-cased self."""
    upper = F.upper(_col(name))
    known = F.create_map(*[F.lit(x) for pair in rules.upper_alias_rows() for x in pair])
    cleaned = F.regexp_replace(upper, "[^A-Z0-9_]", "")
    return F.coalesce(F.try_element_at(known, upper),
                      F.when(cleaned == "", "UNKNOWN_VAR").otherwise(cleaned))


def parse_variables(text) -> Column:
    """JSON text of names -> array; malformed text -> empty array."""
    return F.coalesce(F.from_json(_col(text), "array<string>"),
                      F.array().cast("array<string>"))


def parse_range(text) -> Column:
    """'-1.2-8.7 °C' -> struct(min, max)."""
    pattern, text = r"(-?[0-9.]+)-(-?[0-9.]+)", _col(text)
    return F.struct(F.regexp_extract(text, pattern, 1).try_cast("double").alias("min"),
                    F.regexp_extract(text, pattern, 2).try_cast("double").alias("max"))


def clean_number(value) -> Column:
    """Double with NaN, infinities and unreadable text as null."""
    number = _col(value).try_cast("double")
    return F.when(F.isnan(number) | (F.abs(number) == float("inf")), F.lit(None)).otherwise(number)


def truncate_fields(fields: dict[str, int] | None = None) -> dict[str, Column]:
    """Column name -> the column cut to its declared length."""
    return {c: F.substring(F.col(c), 1, n) for c, n in (fields or rules.FIELD_LENGTHS).items()}
