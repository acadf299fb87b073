"""Scores and validity of profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from halocast import rules
from halocast.functions.geo import valid_coordinates


def quality_score() -> Column:
    """Completeness x key variables x position, in [0, 1].

    Needs n_values, n_cells, n_key, lat, lon as made by ``assemble_profiles``.
    Missing coordinates do not lower the score; coordinates out of range halve it.
    """
    completeness = F.col("n_values") / F.col("n_cells")
    key_share = 0.5 + 0.5 * F.col("n_key") / len(rules.KEY_VARIABLES)
    placed = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    position = F.when(placed & ~valid_coordinates(), 0.5).otherwise(1.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), completeness * key_share * position))
    return F.when(F.col("n_cells") > 0, F.round(score, 6)).otherwise(rules.NO_DATA_SCORE)


def quality_tier(score="data_quality_score") -> Column:
    """high, medium or low; no score counts as low."""
    score = F.col(score) if isinstance(score, str) else score
    return (F.when(score >= rules.QUALITY_HIGH, "high")
            .when(score >= rules.QUALITY_MEDIUM, "medium").otherwise("low"))


def reject_reason() -> Column:
    """Why a profile is refused; null where it is accepted."""
    return (
        F.when(F.col("lat").isNull() | F.col("lon").isNull(), "missing_coordinates")
        .when(~valid_coordinates(), "coordinates_out_of_range")
        .when(F.col("n_levels") < 0, "negative_levels")
        .when(F.col("n_values") == 0, "no_data")
    )


def validate_profiles(profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason); together they are the whole input."""
    judged = profiles.withColumn("reject_reason", reject_reason())
    accepted = judged.filter("reject_reason IS NULL").drop("reject_reason")
    return accepted, judged.filter("reject_reason IS NOT NULL")
