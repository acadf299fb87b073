"""Sentences about profiles, used as search documents."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from halocast import rules
from halocast.functions import geo


def time_text(ts="time_start") -> Column:
    return F.date_format(F.col(ts), "yyyy-MM-dd HH:mm:ss")


def _joined(variables, n: int | None = None, sep: str = ", ") -> Column:
    array = F.slice(F.col(variables), 1, n) if n else F.col(variables)
    return F.array_join(array, sep)


# The sentence parts below are fixed values.
def summarise(variant: str = "rich") -> Column:
    """One sentence per profile. Variants: ingest, robust, ultra, rich, rebuild.

    Needs float_id, profile_id, lat, lon, time_start, n_levels, variables, and
    for ``rich`` data_quality_score.
    """
    has_position = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    has_variables = F.size("variables") > 0
    name = F.concat(F.lit("Float "), F.col("float_id"), F.lit(" profile "), F.col("profile_id"))
    measured = F.concat(F.lit("measured on "), time_text())
    depth_levels = F.when(F.col("n_levels") > 0, F.concat(
        F.lit("with "), F.col("n_levels").cast("string"), F.lit(" depth levels")))
    if variant == "ingest":
        return F.when(has_position, F.concat(
            name, F.lit(": "), F.col("n_levels").cast("string"), F.lit(" levels at ("),
            F.format_string("%.2f,%.2f", "lat", "lon"), F.lit(") time "),
            F.coalesce(time_text(), F.lit("None")), F.lit(". Variables: "),
            _joined("variables", sep=",")))
    if variant == "robust":
        body = F.concat_ws(
            " ", F.concat(name, F.lit(":")),
            F.concat(F.lit("Located at "), geo.signed_position()), measured, depth_levels,
            F.when(has_variables, F.concat(F.lit("measuring "), _joined("variables"))))
        return F.when(has_position, F.concat(body, F.lit("."))).otherwise(
            F.concat(F.lit("Profile "), F.col("profile_id")))
    if variant in ("ultra", "rebuild"):
        body = F.concat_ws(
            " ", name, F.concat(F.lit("at "), geo.signed_position()), measured, depth_levels,
            F.when(has_variables, F.concat(F.lit("measuring "), _joined("variables", 5))))
        return F.concat(body, F.lit("."))
    if variant == "rich":
        score = F.coalesce(F.col("data_quality_score"), F.lit(0.5))
        body = F.concat_ws(
            " ", F.concat(F.lit("ARGO float "), F.col("float_id"), F.lit(" profile")),
            F.concat(F.lit("at "), geo.format_position()), measured,
            F.when(F.col("n_levels") > 0, F.concat(
                F.lit("with "), F.col("n_levels").cast("string"), F.lit(" depth measurements"))),
            F.when(has_variables, F.concat(F.lit("measuring "), F.lower(_joined("variables")))),
            F.when(score > 0.8, "(high quality data)").when(score < 0.3, "(limited data)"),
            F.concat(F.lit("in the "), geo.guess_basin()))
        return F.when(has_position, F.concat(body, F.lit("."))).otherwise(
            F.concat(F.lit("ARGO profile "), F.col("profile_id")))
    raise ValueError(f"unknown variant: {variant}")


def enrich(as_of: str) -> Column:
    """Longer sentence with region, month and season, recency and parameter groups."""
    region = geo.classify_region(ladder="stats")
    known = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    variables = F.col("variables")

    def of_group(group: str) -> Column:
        names = rules.group_names(group)
        return F.filter(variables, lambda v: F.upper(v).isin(*names))

    def mentions(array: Column, *marks: str) -> Column:
        return F.exists(array, lambda v: F.upper(v).rlike("|".join(marks)))

    bgc, core = of_group("bgc"), of_group("core")
    has_bgc, has_core = F.size(bgc) > 0, F.size(core) > 0
    age = F.datediff(F.to_date(F.lit(as_of)), F.to_date("time_start"))
    low_region = F.lower(region)
    return F.concat(F.concat_ws(
        " ",
        F.concat(F.lit("ARGO oceanographic profile "), F.col("profile_id"),
                 F.lit(" from float "), F.col("float_id")),
        F.when(known, F.concat(F.format_string("located at %.3f°N %.3f°E in the ", "lat", "lon"),
                               region)),
        F.when(known, F.when(F.abs("lat") <= 5, "near equatorial waters")
               .when(low_region.contains("arabian"), "in Arabian Sea waters")
               .when(low_region.contains("pacific"), "in Pacific Ocean basin")
               .when(low_region.contains("atlantic"), "in Atlantic Ocean basin")),
        F.concat(F.lit("measured in "), F.date_format("time_start", "MMMM yyyy")),
        F.concat(F.lit("during "), geo.season_of("time_start"), F.lit(" season")),
        F.when(age < 180, "recent measurements").when(age < 365, "within last year"),
        F.when(has_bgc, F.concat(F.lit("with biogeochemical parameters: "),
                                 F.array_join(bgc, ", "), F.lit(" BGC-Argo float data"))),
        F.when(mentions(bgc, "DOXY", "OXYGEN"), "including dissolved oxygen measurements"),
        F.when(mentions(bgc, "NITRATE"), "including nitrate nutrient data"),
        F.when(mentions(bgc, "CHLA", "CHLOROPHYLL"), "including chlorophyll fluorescence"),
        F.when(has_core, F.concat(F.lit("with core measurements: "), F.array_join(core, ", "))),
        F.when(has_core & mentions(variables, "TEMP"), "temperature profile data"),
        F.when(has_core & mentions(variables, "PSAL", "SALINITY"), "salinity profile measurements"),
        F.when(has_core & mentions(variables, "PRES"), "pressure depth measurements"),
    ), F.lit("."))
