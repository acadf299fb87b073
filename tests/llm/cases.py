"""Awkward rows that every operator on texts meets."""

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.IntegerType()),
    # names that the operators use inside
    T.StructField("id", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("node", T.LongType()),
    T.StructField("positions", T.StringType()), T.StructField("removed", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("held", T.StringType()), T.StructField("size", T.LongType()), T.StructField("label", T.IntegerType()),
])

PROSE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near the river bank"
LONG = " ".join(f"word{i % 977} and{i}" for i in range(60_000))


def documents(spark):
    texts = [
        (0, PROSE), (1, PROSE.upper()), (2, None), (3, ""), (4, " \t\n "), (5, "one two"), (6, "one two"), (7, "x" * 2_000_000),
        (8, LONG), (9, LONG + " tail"), (10, "naïve Ünïcode – 漢字 かな 😀👍 é     end"), (None, PROSE + " no id"), (11, "\n\n\na\nb"),
        (12, "a  b   c\x0bd\x0ce\r\nf"), (12, "a  b   c\x0bd\x0ce\r\nf"), (13, "x b\u0000c \x85 　"), (14, PROSE + " again"),
    ]
    rows = [(i, t, None if i == 3 else "en", None if i in (5, 6) else f"s{(i or 0) % 3}", None if t is None else len(t),
             "x", 1, 2, "y", "z", 0.5, "h", 3, 1) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().lower().split()
