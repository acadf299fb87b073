"""Mixing sources to target weights along a time-varying curriculum.

Targets are filled like water: every source asks for words in proportion to its
weight, none for more than ``most`` times its size, and what a full source leaves
is shared again by weight. A source's documents stand in the order of a digest of
their id; whole passes over the source and then a first part of that order make
up the words taken, to the nearest document.

Each source's weight runs over training time along straight lines between
knots, scaled so that its integral is its target. A copy asks for its words at its
place in the cumulative demand of its source; inverting the integral at the
copy's middle word gives its training position, and the mix is range-sorted by it.

Running sums stay distributed: sums per source and digest bucket first, a running
sum inside one bucket after that, so no task orders a whole source. The table
of sources (one row each) is the only thing ordered as a whole.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halocast.session import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Weight over training time by base weight: knots at equal distances, early for heavy sources, late for light ones.
SCHEDULES = {5: (1.5, 0.5), 2: (1.0, 1.0), 1: (0.5, 1.5)}


def words_in(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_size, weight, target) from (source, size) rows; sources by code point, null last."""
    per = sizes.groupBy("source").agg(F.sum(F.col("size")).alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)),
                          ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight.cast("double")).withColumn("cap", (F.col("source_size") * most).cast("double"))
    everything = Window.partitionBy()
    by_need = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1)
    per = per.select(
        "*", F.coalesce(F.sum("cap").over(by_need), F.lit(0.0)).alias("cap_before"),
        F.coalesce(F.sum("weight").over(by_need), F.lit(0.0)).alias("weight_before"),
        (F.sum("source_size").over(everything) * share).alias("budget"), F.sum("weight").over(everything).alias("weight_all"))
    per = per.withColumn("level", (F.col("budget") - F.col("cap_before")) / (F.col("weight_all") - F.col("weight_before")))
    full = F.col("cap") <= F.col("weight") * F.col("level")
    # levels of sources that aren't full all come after those that are; the lowest need decides
    level = F.min_by(F.when(~full, F.col("level")), F.when(~full, F.col("cap_before"))).over(everything)
    return per.select("source", "source_size", "weight", "cap",
                      F.when(full, F.col("cap")).otherwise(F.least("cap", F.col("weight") * level)).alias("target"))


def _segments(schedules: Mapping[int, Sequence[float]]) -> Column:
    """Per base weight: straight pieces (start, length, first and last weight, integral before), integral 1 in all."""
    out = F.lit(None)
    for weight, knots in schedules.items():
        step = 1 / (len(knots) - 1)
        area = sum((a + b) / 2 * step for a, b in zip(knots, knots[1:], strict=False))
        before, rows = 0.0, []
        for k, (a, b) in enumerate(zip(knots, knots[1:], strict=False)):
            rows.append(F.struct(F.lit(k * step).alias("start"), F.lit(step).alias("length"), F.lit(a / area).alias("w0"),
                                 F.lit(b / area).alias("w1"), F.lit(before).alias("before")))
            before += (a + b) / 2 * step / area
        out = F.when(F.col("weight") == weight, F.array(*rows)).otherwise(out)
    return out


def _position(asked: Column, pieces: Column) -> Column:
    """Training time at which a source's cumulative demand reaches the share ``asked``."""
    piece = F.element_at(F.filter(pieces, lambda p: p["before"] <= asked), -1)
    more = asked - piece["before"]
    slope = (piece["w1"] - piece["w0"]) / piece["length"]
    return piece["start"] + 2 * more / (piece["w0"] + F.sqrt(piece["w0"] * piece["w0"] + 2 * slope * more))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         weights: Sequence[int] = WEIGHTS, share: float = 1.5, most: int = 2,
         schedules: Mapping[int, Sequence[float]] = SCHEDULES) -> DataFrame:
    """How often and when each document is taken.

    Columns: id, source, size, rows, source_size, target, copies, taken, positions;
    one row for all rows that agree in id, source and size (``rows`` of them), which are
    drawn alike, so repeated rows can't change the outcome between runs. A null source is a
    source of its own, the last one; a null id stands as an empty text in the order.
    Documents without words take nothing and have no position. An empty
    table gives an empty plan. Other columns are not read.
    """
    sized = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"),
                        words_in(F.col(text_col).cast("string")).alias("size"))
    rows = stored(sized.groupBy("id", "source", "size").agg(F.count("*").alias("rows")), "sizes")
    key = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))
    rows = rows.withColumn("key", key).withColumn("bucket", F.substring("key", 1, 3))
    goal = targets(rows.select("source", (F.col("size") * F.col("rows")).alias("size")), weights, share, most)
    goal = goal.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
                           ).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    by_bucket = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("rows")).alias("inside"))
    sums = sums.select("source", "bucket", F.coalesce(F.sum("inside").over(by_bucket), F.lit(0)).alias("offset"))
    same = F.col("l.source").eqNullSafe(F.col("r.source"))
    sums = sums.alias("l").join(goal.alias("r"), same).select("l.*", *(F.col(f"r.{c}") for c in goal.columns if c != "source"))
    in_bucket = Window.partitionBy("source", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inner", F.coalesce(F.sum(F.col("size") * F.col("rows")).over(in_bucket), F.lit(0)))
    both = placed.alias("l").join(sums.alias("r"), same & (F.col("l.bucket") == F.col("r.bucket"))).select(
        "l.id", "l.source", "l.size", "l.rows", "l.inner", *(F.col(f"r.{c}") for c in sums.columns if c not in ("source", "bucket")))
    before = F.col("offset") + F.col("inner")
    extra = (2 * before + F.col("size") * F.col("rows") <= 2 * F.col("rest")).cast("int")
    both = both.withColumn("before", before).withColumn(
        "copies", F.when(F.col("size") > 0, (F.col("passes") + extra).cast("int")).otherwise(0))
    asked = lambda copy: F.least((copy * F.col("source_size") + F.col("before") + F.col("size") * F.col("rows") / 2) / F.col("target"), F.lit(1.0))
    positions = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1),
                                                        lambda c: _position(asked(c), F.col("pieces"))))
    return both.withColumn("pieces", _segments(schedules)).select(
        "id", "source", "size", "rows", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"), positions.alias("positions"))


def _copies(docs: DataFrame, drawn: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """The rows of ``docs`` with the name of their draw and a row for each copy taken, range-sorted by training position."""
    drawn = drawn.where("copies > 0").select(
        F.col("id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), F.col("positions").alias("__positions"))
    rows = docs.withColumn("__words", words_in(F.col(text_col).cast("string")))
    both = rows.join(drawn, rows[id_col].cast("long").eqNullSafe(drawn["__id"]) & (rows["__words"] == drawn["__size"])
                     & rows[source_col].cast("string").eqNullSafe(drawn["__source"]))
    out = both.select(*(rows[c] for c in docs.columns), "__id", "__source", "__size", F.explode("__positions").alias("__position"))
    return out.repartitionByRange(F.col("__position")).sortWithinPartitions("__position")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row for each copy taken, range-sorted by training position."""
    return _copies(docs, plan(docs, id_col, text_col, source_col, **options), id_col, text_col, source_col).select(*docs.columns)


def taken(docs: DataFrame, drawn: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, source_size, target, taken, first_position) per row of ``docs``, as the mix that is drawn holds it.

    The mix is made, range-sorted and written, and its copies are counted; rows that agree in id, source and
    size share their copies alike. Rows that nothing is taken of have no position.
    """
    drawn = stored(drawn, "drawn")
    key = ["__id", "__source", "__size"]
    mixed = stored(_copies(docs.select(id_col, text_col, source_col), drawn, id_col, text_col, source_col).select(*key, "__position"), "mix")
    held = mixed.groupBy(*key).agg(F.sum("__size").alias("__words"), F.min("__position").alias("first_position"))
    same = (F.col("id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source")) & (F.col("size") == F.col("__size")))
    both = drawn.join(held, same, "left").withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows").cast("long"))))
    words = F.coalesce((F.col("__words") / F.col("rows")).cast("long"), F.lit(0).cast("long"))
    return both.select("id", "source", "size", "source_size", "target", words.alias("taken"), "first_position")
