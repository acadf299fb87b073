"""Ingest of what is new: list the landing, drop what the ledger holds, take the rest.

The landing holds drops, folders ``drop=<name>/{values,scalars,variables}`` of Parquet files; a drop holds whole
source files. A drop with a new or changed file is taken whole, since a changed file may touch any profile in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from halocast.plans.ingest import Ingested, ingest, publish
from halocast.plans.routing import ingest_routed
from halocast.schemas import LANDING
from halocast.sources import store
from halocast.sources.inventory import file_inventory


def list_landing(spark: SparkSession, landing: str) -> DataFrame:
    """(path, length, modified, drop) of the landed files; no content is read."""
    return file_inventory(spark, landing, ["parquet"]).withColumn("drop", F.regexp_extract("path", "/drop=([^/]+)/", 1))


def new_drops(spark: SparkSession, landing: str, root: str) -> list[str]:
    """Names of the drops that hold a file the ledger lacks or knows otherwise."""
    pending = store.pending(list_landing(spark, landing), store.ledger(spark, root))
    return sorted(r[0] for r in pending.select("drop").distinct().collect())


def read_drops(spark: SparkSession, landing: str, kind: str, drops: list[str]) -> DataFrame:
    paths = [f"{landing}/drop={d}/{kind}" for d in drops]
    return spark.read.schema(LANDING[kind] + ", drop string").option("basePath", landing).parquet(*paths)


def ingest_new(spark: SparkSession, landing: str, root: str, occurred_at: str, run_id: int, routed: bool = True) -> str | None:
    """Take the new and changed drops as one run; the attempt's folder, or None where nothing is new.

    Nothing but the listing and the ledger is read to find that out, and then no run is entered.
    """
    drops = new_drops(spark, landing, root)
    if not drops:
        return None
    tables = {kind: read_drops(spark, landing, kind, drops) for kind in LANDING}
    raw = {kind: df.drop("drop") for kind, df in tables.items()}
    named = [tables[kind].select("source_file", "drop") for kind in ("scalars", "variables")]
    sources = named[0].unionByName(named[1]).distinct()
    if routed:
        run = ingest_routed(raw["values"], raw["scalars"], raw["variables"], sources)
    else:
        plain = ingest(raw["values"], raw["scalars"], raw["variables"])
        run = Ingested(plain.judged, plain.aligned, sources)
    run = run.stored()
    fruitful = run.profiles.select("source_file").distinct().join(sources, "source_file").select("drop").distinct()
    files = list_landing(spark, landing).where(F.col("drop").isin(drops)).join(
        fruitful.withColumn("_fruitful", F.lit(True)), "drop", "left").select(
        "path", "length", "modified", F.when(F.col("_fruitful"), "loaded").otherwise("empty").alias("state"))
    return publish(run, root, occurred_at, run_id, files)
