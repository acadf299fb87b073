"""Writers of the stored tables."""

from __future__ import annotations

import time
import uuid
from pyspark.sql import DataFrame, SparkSession, functions as F

from halocast.operators.filters import with_cells


def float_bucket(n: int = 32, col: str = "float_id"):
    """Bucket of a float by a digest that any engine can compute."""
    return F.pmod(F.conv(F.substring(F.md5(F.col(col).cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(n)).cast("int")


def write_levels(levels: DataFrame, path: str, measures: list[str], n_buckets: int = 32) -> None:
    """Levels as one Parquet dataset, by float bucket (computed here where they lack it); all-null levels are left out.

    The rebalance hint lets adaptive execution cut a bucket that holds a hot
    float into several files, and join small ones.
    """
    if "float_bucket" not in levels.columns:
        levels = levels.withColumn("float_bucket", float_bucket(n_buckets))
    (
        levels.filter(F.coalesce(*measures).isNotNull())
        .hint("rebalance", F.col("float_bucket"))
        .write.mode("overwrite").option("compression", "snappy")
        .partitionBy("float_bucket").parquet(path)
    )


def append_errors(rejects: DataFrame, path: str) -> None:
    """Rejected profiles as rows of the append-only error log."""
    rejects.write.mode("append").parquet(path)


def error_rows(rejected: DataFrame, occurred_at: str) -> DataFrame:
    """Error log rows of rejected profiles."""
    return rejected.select(
        F.col("source_file").alias("file_path"),
        F.when(F.col("reject_reason") == "no_data", "NO_PROFILES").otherwise("CRITICAL_ERROR")
        .alias("error_type"),
        F.col("reject_reason").alias("error_message"),
        F.to_json(F.struct("profile_id", "lat", "lon")).alias("error_details"),
        F.to_timestamp_ntz(F.lit(occurred_at)).alias("occurred_at"),
    )


def vector_documents(df: DataFrame, text: str = "summary") -> DataFrame:
    """Documents worth storing: an id and a text that is not blank."""
    return df.filter(F.col("profile_id").isNotNull() & (F.col("profile_id") != "")
                     & (F.length(F.trim(F.col(text))) > 0))


def write_vectors(df: DataFrame, path: str, text: str = "summary") -> None:
    vector_documents(df, text).write.mode("overwrite").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("append").json(path)


def kept_reports(reports: DataFrame, keep: int = 100, order: str = "report_time",
                 tie: str = "report_id") -> DataFrame:
    """The newest ``keep`` reports; which ones to hold is a top-k over the log."""
    return reports.orderBy(F.desc(order), F.desc(tie)).limit(keep)


def attempt_path(root: str, run_id: int) -> str:
    """A folder for one attempt at a run; no attempt ever writes where another one wrote."""
    return f"{root}/runs/run={run_id}/attempt={time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def enter(spark: SparkSession, root: str, run_id: int, path: str) -> None:
    """Make an attempt visible: one new entry in the manifest, written after all of its data."""
    entry = spark.range(1).select(F.lit(run_id).cast("bigint").alias("run"), F.lit(path).alias("path"))
    entry.write.json(f"{root}/manifest/{path.rsplit('/', 1)[-1]}")


def publish_catalog(catalog: DataFrame, root: str, run_id: int, path: str | None = None) -> str:
    """Write the catalogue of an attempt and make the attempt the live one of its run.

    A reader that opened an earlier attempt still finds its files.
    """
    path = path or attempt_path(root, run_id)
    write_catalog_version(catalog, f"{path}/catalog")
    enter(catalog.sparkSession, root, run_id, path)
    return path


def live_runs(spark: SparkSession, root: str) -> list[str]:
    """Folders of the live attempts by run: of each run the latest. One manifest row per attempt is read."""
    entries = spark.read.schema("run bigint, path string").json(f"{root}/manifest/*")
    live = entries.groupBy("run").agg(F.max("path").alias("path")).orderBy("run")
    return [r.path for r in live.collect()]


def current_catalog(spark: SparkSession, root: str) -> DataFrame:
    """The catalogue version of the greatest run."""
    return spark.read.parquet(f"{live_runs(spark, root)[-1]}/catalog")


def write_catalog_version(catalog: DataFrame, path: str) -> None:
    """A new catalogue version, by 10-degree band and sorted inside files.

    Bands prune folders; the sort makes row-group statistics prune longitude
    and time. Longitude is not a folder level, which would make many small files.
    """
    (
        with_cells(catalog).hint("rebalance", F.col("cell_lat"))
        .sortWithinPartitions("cell_lat", "cell_lon", "time_start")
        .write.partitionBy("cell_lat").parquet(path)
    )
