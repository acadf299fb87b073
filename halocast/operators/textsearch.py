"""Many search texts against the catalogue in one pass.

The distinct texts pass by the catalogue in packed batches. A task looks for all texts of a batch at once in the joined
texts of many rows (Aho-Corasick) and keeps a list of at most k rows per text; lists are merged in two steps.
Texts that agree in word and facets pass by once, however many questions ask for them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from halocast.operators import filters
from halocast.operators.joins import spread_join
from halocast.operators.stats import region_label
from halocast.operators.topk import HITS, topk
from halocast.session import stored

GAP = "\x00"  # between the searched columns, so that no text matches across them
FOUND = 200_000  # finds looked at together


def _age(nulls_first: bool = True) -> Column:
    """A distance that grows with age; missing times come first, or last."""
    far = F.lit(float("-inf" if nulls_first else "inf"))
    return F.coalesce(-F.unix_micros(F.col("time_start").cast("timestamp")).cast("double"), far)


class TextScan:
    """Per text the k newest rows that hold it and share no facet with it, of all rows that have passed by.

    Rows have ``profile_id``, ``hay``, ``bits`` and ``age``, texts ``query_id``, ``word``, ``mask`` and ``k``. An empty word is in
    every row. Rows older than the k-th newest so far of their text are dropped as they are found.
    """

    def __init__(self, asked: pa.Table):
        import ahocorasick

        asked = asked.filter(pc.and_(pc.is_valid(asked.column("word")), pc.greater(pc.fill_null(asked.column("k"), 0), 0)))
        places: dict[str, int] = {}
        code = np.array([places.setdefault(w, len(places)) for w in asked.column("word").to_pylist()], dtype=np.int64)
        # texts with the same word stand together
        order = np.argsort(code, kind="stable")
        asked = asked.take(pa.array(order))
        self.names = asked.column("query_id").combine_chunks()
        self.k, self.mask = (asked.column(c).to_numpy().astype(np.int64) for c in ("k", "mask"))
        self.count = np.bincount(code, minlength=len(places))
        self.first = np.cumsum(self.count) - self.count
        self.length = np.array([len(w) for w in places], dtype=np.int64)
        self.empty = range(0)
        self.finder = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for word, at in places.items():
            if word:
                self.finder.add_word(word, at)
            else:
                self.empty = range(int(self.first[at]), int(self.first[at] + self.count[at]))
        if len(self.finder):
            self.finder.make_automaton()
        # the age of the k-th newest row of a text, and the greatest of these of a word
        self.edge, self.word_edge = np.full(len(self.k), np.inf), np.full(len(places), np.inf)
        # (text, age, row's id) of the newest rows and of those that came since
        self.best = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object))
        self.fresh: list[tuple] = []

    def add(self, rows: pa.RecordBatch) -> None:
        if not len(rows) or not len(self.k):
            return
        age, bits = rows.column("age").to_numpy(), rows.column("bits").to_numpy().astype(np.int64)
        ids = rows.column("profile_id").to_numpy(zero_copy_only=False)
        if len(self.finder):
            hay = rows.column("hay")
            ends = np.cumsum(pc.utf8_length(hay).to_numpy().astype(np.int64))
            starts = np.concatenate([[0], ends[:-1]])
            found = self.finder.iter("".join(hay.to_pylist()))
            while some := list(islice(found, FOUND)):
                last, word = np.array(some, dtype=np.int64).T
                row = np.searchsorted(ends, last, "right")
                # a text that was found lies in one row
                near = (last - self.length[word] + 1 >= starts[row]) & (age[row] <= self.word_edge[word])
                pair = np.unique(word[near] * len(age) + row[near])
                self._keep(pair // len(age), pair % len(age), age, bits, ids)
        for text in self.empty:
            row = np.flatnonzero((bits & self.mask[text] == 0) & (age <= self.edge[text]))
            if len(row) > self.k[text]:
                row = row[age[row] <= np.partition(age[row], self.k[text] - 1)[self.k[text] - 1]]
            self.fresh.append((np.full(len(row), text), age[row], ids[row]))
        if not len(self.best[0]) or sum(len(f[0]) for f in self.fresh) > max(len(self.best[0]), FOUND // 2):
            self._settle()

    def _keep(self, word: np.ndarray, row: np.ndarray, age: np.ndarray, bits: np.ndarray, ids: np.ndarray) -> None:
        """Of the words found in rows, those of texts that share no facet with the row."""
        n = self.count[word]
        text = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[word], n)
        row = np.repeat(row, n)
        fine = (bits[row] & self.mask[text] == 0) & (age[row] <= self.edge[text])
        self.fresh.append((text[fine], age[row[fine]], ids[row[fine]]))
        if sum(len(f[0]) for f in self.fresh) > max(len(self.best[0]), 5 * FOUND):
            self._settle()

    def _settle(self) -> None:
        """Keep the k newest rows of each text; of rows as old as the k-th the first by id, a missing one before all."""
        if not self.fresh:
            return
        text, age, ids = (np.concatenate(parts) for parts in zip(self.best, *self.fresh))
        self.fresh = []
        order = np.lexsort((age, text))
        text, age, ids = text[order], age[order], ids[order]
        n = np.bincount(text, minlength=len(self.k))
        full = n >= self.k
        first = np.cumsum(n) - n
        self.edge[full] = age[first[full] + self.k[full] - 1]
        newer, tied = age < self.edge[text], age == self.edge[text]
        open_ = ~full[text]  # an age may be infinite
        newer, tied = newer | open_, tied & ~open_
        room = self.k - np.bincount(text[newer], minlength=len(self.k))
        crowded = np.flatnonzero(tied & (np.bincount(text[tied], minlength=len(self.k)) > room)[text])
        names = np.array(["" if i is None else "\x01" + i for i in ids[crowded]], dtype=str)
        crowded = crowded[np.lexsort((names, text[crowded]))]
        nth = np.arange(len(crowded)) - np.searchsorted(text[crowded], text[crowded], "left")
        keep = newer | tied
        keep[crowded[nth >= room[text[crowded]]]] = False
        self.best = (text[keep], age[keep], ids[keep])
        if len(self.first):
            self.word_edge = np.maximum.reduceat(self.edge, self.first)

    def hits(self) -> Iterator[pa.RecordBatch]:
        self._settle()
        text, age, ids = self.best
        for lo in range(0, len(text), 100_000):
            part = slice(lo, lo + 100_000)
            yield pa.RecordBatch.from_arrays(
                [self.names.take(pa.array(text[part])).cast(pa.string()), pa.array(ids[part].tolist(), pa.string()), pa.array(age[part]),
                 pa.array(self.k[text[part]].astype(np.int32))], schema=HITS)


def keyword_search_many(catalog: DataFrame, texts: DataFrame, nulls_first: bool = True) -> DataFrame:
    """(query_id, rank, profile_id): for each text its k newest profiles whose variables, float or id contain it.

    ``texts`` has query_id, word and k. Case doesn't count and all characters stand for themselves. A null word finds
    nothing, an empty one every row; rows that repeat a profile id count apart. Each word is looked for once, for the
    greatest k that is asked of it, and its rows are given to the texts that ask for it.
    """
    columns = [F.coalesce(F.lower(F.col(c)), F.lit("")) for c in ("variables_csv", "float_id", "profile_id")]
    rows = catalog.select("profile_id", F.concat_ws(GAP, *columns).alias("hay"), F.lit(0).alias("bits"), _age(nulls_first).alias("age"))
    asked = stored(texts.select("query_id", F.lower("word").alias("word"), F.col("k").cast("int").alias("k")).where(
        "word IS NOT NULL AND k > 0"), "asked")
    words = stored(asked.groupBy("word").agg(F.max("k").alias("most"), F.count(F.lit(1)).alias("n")), "words")
    newest = topk(rows, words.select(F.col("word").alias("query_id"), "word", F.lit(0).alias("mask"), F.col("most").alias("k")), TextScan).select(
        F.col("query_id").alias("word"), "profile_id", "distance", F.col("rank").alias("nth"))
    found = spread_join(asked, newest, ["word"], spread_by=["query_id"], weights=words).where("nth <= k")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "profile_id"))
    return found.withColumn("rank", rank).where("rank <= k").select("query_id", "rank", "profile_id")


def _facet_bits(tests: list[Column]) -> Column:
    return sum((F.when(F.coalesce(t, F.lit(False)), 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0))


def facet_search_many(catalog: DataFrame, texts: DataFrame) -> DataFrame:
    """(query_id, rank, profile_id, matched): for each text its k newest profiles by facets or substring.

    Facets are those of ``facet_filter``: a row matches a text if it has any facet the text asks for, or contains the
    text. A text that nothing matches gets the k newest profiles of all, with ``matched`` false; so does an empty one.
    """
    time = F.coalesce(F.date_format("time_start", "yyyy-MM-dd HH:mm:ss"), F.lit("None"))
    searchable = F.lower(F.concat(F.col("variables_csv"), region_label(), F.col("float_id"), F.col("profile_id"), time))
    marks = [F.col("hay").rlike("|".join(m)) for _, m in filters.FACETS]
    marks += [F.col("hay").contains("equatorial"), F.col("hay").contains("atlantic"), F.col("max_depth") >= 1000, F.col("_time").contains("2023")]
    rows = catalog.select("profile_id", F.coalesce(searchable, F.lit("")).alias("hay"), "max_depth", time.alias("_time"), _age().alias("age")) \
        .select("profile_id", "hay", _facet_bits(marks).alias("bits"), "age")
    low = F.lower("text")
    any_of = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))
    wanted = [any_of(words) for words, _ in filters.FACETS]
    wanted += [low.contains("equator"), low.contains("atlantic"), any_of(filters.DEPTH_WORDS), low.contains("2023")]
    asked = texts.where("text IS NOT NULL").select("query_id", F.col("k").cast("int").alias("k"), F.when(low == "", None).otherwise(low).alias("word"),
                                                  _facet_bits(wanted).alias("mask"))
    rows, asked = stored(rows, "rows"), stored(asked, "asked")
    keys, order = ["word", "mask"], ["age", "profile_id"]
    # the k newest rows by facets: of the rows with the same facets the newest are enough, and texts that ask for the same share them
    most = asked.agg(F.max("k")).first()[0] or 0
    newest_of = W.partitionBy("bits").orderBy(*order)
    some = rows.where("bits <> 0").select("profile_id", "bits", "age", F.row_number().over(newest_of).alias("nth")).where(F.col("nth") <= most)
    masks = asked.where("mask <> 0 AND k > 0").groupBy("mask").agg(F.max("k").alias("most"))
    by_facet = masks.join(some, F.col("mask").bitwiseAND(F.col("bits")) != 0).withColumn(
        "nth", F.row_number().over(W.partitionBy("mask").orderBy(*order))).where("nth <= most").select("mask", "profile_id", "age")
    # the k newest rows by words that share no facet with them; a word longer than any row is in none
    longest_row = rows.agg(F.max(F.length("hay"))).first()[0] or 0
    words = asked.where(F.col("word").isNotNull() & (F.length("word") <= longest_row) & (F.col("k") > 0)).groupBy(*keys).agg(F.max("k").alias("k"))
    name = F.concat_ws(":", F.col("mask").cast("string"), F.col("word"))
    by_word = topk(rows, words.select(name.alias("query_id"), *keys, "k"), TextScan).select(
        F.col("query_id").alias("pair"), "profile_id", F.col("distance").alias("age"))
    wanted = asked.where("k > 0").select("query_id", "k", "mask", F.when(F.col("word").isNotNull(), name).alias("pair"))
    both = wanted.join(by_facet, "mask").select("query_id", "k", "profile_id", "age").unionByName(
        wanted.join(by_word, "pair").select("query_id", "k", "profile_id", "age"))
    found = stored(both.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(
        F.col("rank") <= F.col("k")).select("query_id", "rank", "profile_id", F.lit(True).alias("matched")), "found")
    rest = asked.join(found.select("query_id").distinct(), "query_id", "left_anti").where("k > 0")
    longest = rest.agg(F.max("k")).first()[0] or 0
    newest = rows.orderBy("age", "profile_id").limit(longest).withColumn("rank", F.row_number().over(W.orderBy("age", "profile_id"))).select(
        "rank", "profile_id")
    others = rest.select("query_id", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("rank")).join(newest, "rank").select(
        "query_id", "rank", "profile_id", F.lit(False).alias("matched"))
    return found.unionByName(others)
