"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halocast.session import stored


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Hang neighbours on the smallest node around: the larger ones, or the smaller ones and itself."""
    if small:
        arcs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        arcs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = arcs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    hung = arcs.join(low, "u")
    if small:
        out = hung.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            low.where("u <> m").select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        out = hung.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that links reach, for every node with a link.

    ``edges`` has the columns a and b. Rounds of a large star and a small star
    go on until the links no longer change; each round is stored in the shared
    folder, so a lost executor costs a re-read. No group is collected: the
    minimum of a node is pre-aggregated and joined back.
    """
    now = stored(edges.where("a <> b").select("a", "b").distinct(), "links")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        now = stored(_star(_star(now, small=False), small=True), "links")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
