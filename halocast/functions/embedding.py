"""Text to vector.

The default encoder is lexical: hashed word counts, scaled to unit length. It
is deterministic and runs in the JVM, and it does not stand for a sentence
model. Any other encoder plugs in as a function over batches of texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import HashingTF, Normalizer, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F


def embed_text(df: DataFrame, text: str = "summary", out: str = "embedding", dims: int = 256,
               encoder: Callable | None = None) -> DataFrame:
    """Add a float array column ``out`` computed from ``text``."""
    if encoder is not None:
        import pandas as pd

        @F.pandas_udf("array<float>")
        def encode(texts: pd.Series) -> pd.Series:
            return pd.Series([list(map(float, v)) for v in encoder(texts.tolist())])

        return df.withColumn(out, encode(F.col(text)))
    filled = df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    words = Tokenizer(inputCol="_text", outputCol="_words").transform(filled)
    counts = HashingTF(numFeatures=dims, inputCol="_words", outputCol="_tf").transform(words)
    unit = Normalizer(p=2.0, inputCol="_tf", outputCol="_unit").transform(counts)
    return unit.withColumn(out, vector_to_array("_unit", "float32")).drop(
        "_text", "_words", "_tf", "_unit")
