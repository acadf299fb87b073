"""Readers of landed tables and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from halocast import schemas


def read_raw(spark: SparkSession, path: str, kind: str, fmt: str = "parquet") -> DataFrame:
    """A landing table (values, scalars or variables) with its declared schema."""
    return spark.read.format(fmt).schema(schemas.LANDING[kind]).load(path)


def read_profile_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Documents with a nested ``profiles`` array, one row per profile.

    One document per file, or per line without ``multi_line``, which lets large
    files be split. The schema is declared, which saves the pass to infer it.
    """
    fields = schemas.JSON_PROFILE.replace(" ", ":").replace(",:", ",")
    doc = f"profiles array<struct<{fields}>>"
    text = spark.read.schema(doc).option("multiLine", str(multi_line).lower()).json(path)
    return text.select(F.explode("profiles").alias("p")).select("p.*").withColumn(
        "time", F.col("time").cast("timestamp_ntz"))


def read_levels(spark: SparkSession, path: str, merge_schema: bool = True) -> DataFrame:
    return spark.read.option("mergeSchema", str(merge_schema).lower()).parquet(path)
