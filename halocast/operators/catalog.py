"""Changes to the catalogue as transforms from one DataFrame to the next.

Nothing is updated in place: each change reads a catalogue and yields the next
one, to be written as a new version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from halocast import rules
from halocast.functions.geo import valid_coordinates


def latest_per_profile(df: DataFrame, key: str = "profile_id", order: str = "seq") -> DataFrame:
    """The row with the greatest ``order`` per key.

    Spark applies the limit of 1 before the shuffle as well (window group
    limit), so a key with very many versions sends one row per task.
    """
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


# fixed values: columns an update overwrites, by ingest variant
UPDATE_COLUMNS = {
    "ingest": ["parquet_path", "created_at"],
    "robust": ["parquet_path", "schema_info", "raw_metadata", "updated_at"],
    "scored": ["parquet_path", "data_quality_score", "schema_info", "raw_metadata",
                    "extraction_method", "updated_at"],
    "populate": ["raw_metadata", "updated_at"],
}


def upsert_catalog(old: DataFrame, batch: DataFrame, variant: str = "scored",
                   key: str = "profile_id", order: str = "seq") -> DataFrame:
    """Insert new profiles and overwrite the variant's columns of known ones.

    The batch is first reduced to its latest row per profile, so the result
    does not depend on row order and applying a batch twice changes nothing.
    ``ultra`` overwrites every column of the batch.
    """
    new = latest_per_profile(batch, key, order)
    if variant == "ultra":
        updated = [c for c in new.columns if c != key]
    else:
        updated = UPDATE_COLUMNS[variant]
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    is_new, is_old = F.col(f"n.{key}").isNotNull(), F.col(f"o.{key}").isNotNull()
    columns = [F.coalesce(F.col(f"o.{key}"), F.col(f"n.{key}")).alias(key)]
    for c in dict.fromkeys([*old.columns, *new.columns]):
        if c == key:
            continue
        if c not in new.columns:
            columns.append(F.col(f"o.{c}").alias(c))
        elif c not in old.columns:
            columns.append(F.col(f"n.{c}").alias(c))
        else:
            take_new = is_new & (~is_old | F.lit(c in updated))
            columns.append(F.when(take_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return both.select(*columns)


def insert_ignore(old: DataFrame, batch: DataFrame, key: str = "profile_id",
                  order: str = "seq") -> DataFrame:
    """Add the profiles not there yet; known ones stay as they are.

    Of several new rows for a profile the first one written is kept.
    """
    rank = F.row_number().over(W.partitionBy(key).orderBy(order))
    first = batch.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")
    fresh = first.join(old.select(key), key, "left_anti")
    return old.unionByName(fresh, allowMissingColumns=True)


def mark_missing_levels(catalog: DataFrame, missing: DataFrame, key: str = "profile_id") -> DataFrame:
    """Clear the path and halve the score of profiles whose level file is gone."""
    flags = missing.select(key).distinct().withColumn("_gone", F.lit(True))
    gone = F.col("_gone").isNotNull()
    return catalog.join(flags, key, "left").withColumns({
        "parquet_path": F.when(~gone, F.col("parquet_path")),
        "data_quality_score": F.when(gone, F.col("data_quality_score") * 0.5)
        .otherwise(F.col("data_quality_score")),
    }).drop("_gone")


def is_orphan() -> Column:
    no_path = F.col("parquet_path").isNull() | (F.col("parquet_path") == "")
    return F.coalesce(no_path & (F.col("extraction_method") != "minimal_fallback"), F.lit(False))


def mark_orphans(catalog: DataFrame) -> DataFrame:
    """Cap the score at 0.2 and note the status where no level file is known."""
    status = F.create_map(F.lit("status"), F.lit("orphaned"))
    columns = {
        "data_quality_score": F.when(
            is_orphan(), F.least(F.col("data_quality_score"), F.lit(0.2))
        ).otherwise(F.col("data_quality_score")),
    }
    if "raw_metadata" in catalog.columns:
        kept = F.map_filter(F.col("raw_metadata"), lambda k, v: k != "status")
        columns["raw_metadata"] = F.when(
            is_orphan(), F.map_concat(F.coalesce(kept, F.create_map().cast("map<string,string>")),
                                      status)).otherwise(F.col("raw_metadata"))
    else:
        columns["raw_metadata"] = F.when(is_orphan(), status)
    return catalog.withColumns(columns)


def invalid_coordinates(catalog: DataFrame) -> DataFrame:
    """Rows with null or out-of-range coordinates."""
    return catalog.filter(~valid_coordinates())


def drop_invalid_coordinates(catalog: DataFrame) -> DataFrame:
    return catalog.filter(valid_coordinates())


def default_quality(catalog: DataFrame) -> DataFrame:
    return catalog.withColumn("data_quality_score",
                              F.coalesce("data_quality_score", F.lit(rules.NO_DATA_SCORE)))


def prune_errors(errors: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Errors of the last ``days``; rows without a time are kept."""
    cut = F.to_timestamp_ntz(F.lit(as_of)) - F.make_dt_interval(F.lit(days))
    return errors.filter(F.col("occurred_at").isNull() | (F.col("occurred_at") >= cut))
