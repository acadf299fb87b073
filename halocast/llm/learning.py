"""What the classifiers share: a bounded sample of labelled rows, and the folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: Column | str) -> Column:
    """crc32 of the id as text; a null id counts as 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) if isinstance(id_col, str) else F.crc32(id_col.cast("string")),
                      F.lit(0))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(id, text, label): whole texts of at most ``rows`` labelled documents of the training folds.

    Labels other than 0 and 1 and null ids are left out; of contradicting labels of one id the
    smaller counts. Which rows are taken follows from a hash of the id, not from the order of the table.
    The ids are few by their number (``rows``), so they are sent to the texts.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("label")).where(
        "label IN (0, 1) AND id IS NOT NULL").where(fold("id") % 3 != 1).groupBy("id").agg(F.min("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "id")
