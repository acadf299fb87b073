"""Equi-joins that stay balanced when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def heavy_keys(weights: DataFrame, keys: list[str], weight: str = "n", parts: int = 64) -> DataFrame:
    """(keys.., _fanout) of the keys that hold more than one of ``parts`` shares of all rows.

    ``weights`` has a row per key with its measured number of rows. A key of s shares is spread over 2 s tasks; there are
    less than ``parts`` such keys, whatever the data, so the table may be sent to all tasks.
    """
    share = weights.agg(F.greatest(F.sum(weight) / parts, F.lit(1.0))).scalar()
    return weights.where(F.col(weight) > share).select(*keys, F.ceil(F.col(weight) * 2 / share).cast("int").alias("_fanout"))


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], spread_by: list[str],
                how: str = "inner", fanout: int = 8, weights: DataFrame | None = None) -> DataFrame:
    """Join ``big`` to ``small`` with the rows of a key split over several tasks.

    ``small`` has few rows per key (one, usually) and is repeated per salt;
    ``big`` is salted by ``spread_by``, columns that vary inside a key. With ``weights`` (a measured number of rows ``n``
    per key) each heavy key is split by its own share of the rows and the others are not; without, every key over ``fanout``
    tasks. When ``small`` turns out to fit a broadcast, Spark broadcasts it and nothing is shuffled.
    """
    spread = F.xxhash64(*spread_by)
    if weights is None:
        salted_big = big.withColumn("_salt", F.pmod(spread, F.lit(fanout)).cast("int"))
        salted_small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(fanout - 1))))
        return salted_big.join(salted_small, [*keys, "_salt"], how).drop("_salt")
    heavy = F.broadcast(heavy_keys(weights, keys))
    fan = F.coalesce("_fanout", F.lit(1))
    salted_big = big.join(heavy, keys, "left").withColumn("_salt", F.pmod(spread, fan).cast("int")).drop("_fanout")
    salted_small = small.join(heavy, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), fan - 1))).drop("_fanout")
    return salted_big.join(salted_small, [*keys, "_salt"], how).drop("_salt")


#: Rows of a few short texts each that may be broadcast: some 20 MB.
BROADCAST_ROWS = 100_000


def counted_join(big: DataFrame, small: DataFrame, keys: list[str], spread_by: list[str],
                 weights: DataFrame | None = None) -> DataFrame:
    """Inner join to a stored table: where it is counted to have few rows it is sent to all tasks and ``big`` stays
    where it lies; beyond that ``big`` is spread by ``spread_join``."""
    if small.count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), keys)
    return spread_join(big, small.hint("merge"), keys, spread_by, weights=weights)


def candidates_semi_catalog(hits: DataFrame, kept: DataFrame, key: str = "profile_id") -> DataFrame:
    """Search hits whose id survives the catalogue filters."""
    return hits.join(kept.select(key), key, "left_semi")


def skip_loaded(files: DataFrame, catalog: DataFrame, key: str = "source_file") -> DataFrame:
    """Files with no row in the catalogue yet."""
    return files.join(catalog.select(key).distinct(), key, "left_anti")


def missing_level_files(catalog: DataFrame, inventory: DataFrame) -> DataFrame:
    """Catalogue rows whose level file is not in the listing; every row is checked."""
    listed = inventory.select(F.col("path").alias("parquet_path"))
    has_path = F.col("parquet_path").isNotNull() & (F.col("parquet_path") != "")
    return catalog.filter(has_path).join(listed, "parquet_path", "left_anti")


def profile_levels(catalog: DataFrame, levels: DataFrame, key: str = "profile_id") -> DataFrame:
    """Every level with its profile's catalogue columns.

    One catalogue row per profile, so no row multiplies; a profile that owns a
    great share of the levels is split by the adaptive skew join.
    """
    return levels.join(catalog, key)


def reconcile(catalog: DataFrame, vectors: DataFrame, limit: float, key: str = "profile_id") -> DataFrame:
    """Catalogue and vector store compared: one row of counts and the mismatch flag.

    Both sides are reduced to one row per id before the outer join.
    """
    left = catalog.groupBy(key).agg(F.count(F.lit(1)).alias("n_left"))
    right = vectors.groupBy(key).agg(F.count(F.lit(1)).alias("n_right"))
    both = left.join(right, key, "full_outer")
    totals = both.agg(
        F.count(F.when(F.col("n_left").isNotNull() & F.col("n_right").isNotNull(), 1))
        .alias("matched"),
        F.count(F.when(F.col("n_right").isNull(), 1)).alias("only_catalog"),
        F.count(F.when(F.col("n_left").isNull(), 1)).alias("only_vectors"),
        F.coalesce(F.sum("n_left"), F.lit(0)).alias("catalog_count"),
        F.coalesce(F.sum("n_right"), F.lit(0)).alias("vector_count"),
    )
    gap = F.abs(F.col("catalog_count") - F.col("vector_count"))
    return totals.withColumn("mismatch", gap > F.col("catalog_count") * limit)
