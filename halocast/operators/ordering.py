"""Position within a group, without gathering the group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from halocast.operators.joins import heavy_keys

BUCKETS = 4096  # of the hash by which heavy keys are looked for


def _heavy(whole: DataFrame, key: str, parts: int = 64) -> DataFrame:
    """Keys that hold more than one of ``parts`` shares of all rows: only those in buckets that hold as much are counted."""
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
    counts = whole.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("n"))
    share = counts.agg(F.greatest(F.sum("n") / parts, F.lit(1.0))).scalar()
    crowded = F.broadcast(heavy_keys(counts, ["_bucket"], parts=parts))
    some = whole.select(key, bucket.alias("_bucket")).join(crowded, "_bucket", "left_semi")
    return some.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > share).select(key)


def dense_index(df: DataFrame, key: str, order: list[str], out: str) -> DataFrame:
    """0-based position of each row inside its ``key`` group under ``order``.

    Rows without a key fall away; those without a leading value too, after they took the first positions. Groups are sorted whole, after one shuffle by ``key``, but for those that hold more than a 64th of
    all rows: their rows are counted chunk by chunk, so that such a group spreads over many tasks.
    """
    whole = df.where(F.col(key).isNotNull())
    heavy = F.broadcast(_heavy(whole, key))
    inside = W.partitionBy(key).orderBy(*order)
    light = whole.join(heavy, key, "left_anti").withColumn(out, (F.row_number().over(inside) - 1).cast("int")).where(
        F.col(order[0]).isNotNull())
    return light.unionByName(_chunked_index(whole.join(heavy, key, "left_semi"), key, order, out))


def _chunked_index(df: DataFrame, key: str, order: list[str], out: str) -> DataFrame:
    """The same for large groups.

    The leading order column cuts each group into chunks. A running sum over the
    counts per chunk gives each chunk its offset, and only a chunk is ever sorted in
    one task. A group that holds a third of all rows is thus spread over as
    many tasks as it has chunks.
    """
    lead, rest = order[0], order[1:]
    counts = df.groupBy(key, lead).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(key).orderBy(lead).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(key, lead, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = W.partitionBy(key, lead).orderBy(*rest)
    return (
        df.join(offsets, [key, lead])
        .withColumn(out, (F.col("_off") + F.row_number().over(inside) - 1).cast("int"))
        .drop("_off")
    )
