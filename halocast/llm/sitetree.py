"""Main text of pages by site style trees.

The pages of a host are merged into one tree. Its nodes are element paths; each holds the styles
(sequences of child elements) and the content features (words of short blocks, longer blocks as a whole)
that its pages show there. Entropies over pages tell template from article: a style or feature that
is on every page says nothing. An element's importance is

    (1 - GAMMA**l) * entropy of its l styles + GAMMA**l * mean of (1 - entropy of a feature over pages),

and a branch's importance is the largest below it. A branch below the threshold is removed from each
page, with all that is in it. Pages of a host whose text is the same count as one, so copies of an article are
no template. Where a host shows an element on few pages, its importance is drawn to the mean
of the same path over all hosts. Parts that the markup itself puts beside the article (see ``html``) have no
importance at all; inside a named article only what is nearly the same on all pages goes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halocast.llm import html
from halocast.llm.sizes import sendable
from halocast.session import stored

GAMMA = 0.9
LEAST, LEAST_INSIDE = 0.3, 0.05  # importance below which a branch goes, outside and inside a named article
PRIOR = 8.0  # pages that the mean over all hosts is worth

TREE = ("site long, digest long, nodes array<struct<node:long,style:long,inside:boolean,up:array<long>>>, "
        "features array<struct<node:long,feature:long,n:int>>")
_NODE = pa.struct([("node", pa.int64()), ("style", pa.int64()), ("inside", pa.bool_()), ("up", pa.list_(pa.int64()))])
_FEATURE = pa.struct([("node", pa.int64()), ("feature", pa.int64()), ("n", pa.int32())])


def host(url: Column) -> Column:
    """The lower-cased host of an address, without user and port; addresses without one share the empty host."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages (site, html) as their nodes and features."""
    for batch in batches:
        sites = batch.column(0).to_pylist()
        digests, all_nodes, all_features = [], [], []
        for page in batch.column(1):
            blocks, elements = html.read(page.as_py() or "")
            nodes, features = {}, Counter()
            for b in blocks:
                for f in html.features(b.text):
                    features[b.element.place, f] += 1
            held = {b.element.place for b in blocks}
            for e in elements:
                if e.place in held:
                    up = list(e.above())
                    nodes.setdefault(e.place, (html.hash64(" ".join(e.seen)), any(x.kind == "article" for x in up), [x.place for x in up]))
            digests.append(html.hash64("\n".join(b.text for b in html.candidates(blocks, elements))))
            all_nodes.append([{"node": n, "style": s, "inside": i, "up": u} for n, (s, i, u) in nodes.items()])
            all_features.append([{"node": n, "feature": f, "n": c} for (n, f), c in features.items()])
        yield pa.RecordBatch.from_arrays(
            [pa.array(sites, pa.int64()), pa.array(digests, pa.int64()), pa.array(all_nodes, pa.list_(_NODE)), pa.array(all_features, pa.list_(_FEATURE))],
            ["site", "digest", "nodes", "features"])


def _entropy(total: Column, weighted: Column, base: Column) -> Column:
    """Entropy of counts c, to a base: ``total`` is the sum of c, ``weighted`` that of c log c."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.log(total) - weighted / total) / F.log(base)))


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(site, node, pages, importance, inside, up): the elements that hold text, of all hosts.

    ``up`` are the nodes from the element to the root, ``inside`` says whether a named article is one of them.
    """
    plain = pages.select(F.xxhash64(host(F.col(url_col))).alias("site"), F.col(html_col).cast("string").alias("html")).where("html IS NOT NULL")
    seen = stored(plain.mapInArrow(_describe, TREE).dropDuplicates(["site", "digest"]), "pages")
    log_sum = lambda c: F.sum(F.col(c) * F.log(c))
    styles = seen.select("site", F.explode("nodes").alias("x")).select("site", "x.*").groupBy("site", "node", "style").agg(
        F.count("*").alias("c"), F.first("inside").alias("inside"), F.first("up").alias("up"))
    shape = styles.groupBy("site", "node").agg(
        F.sum("c").alias("pages"), F.count("*").alias("styles"), log_sum("c").alias("weighted"), F.first("inside").alias("inside"), F.first("up").alias("up"))
    terms = seen.select("site", F.explode("features").alias("x")).select("site", "x.*").groupBy("site", "node", "feature").agg(
        F.sum("n").alias("c"), log_sum("n").alias("weighted"))
    content = terms.groupBy("site", "node").agg(F.count("*").alias("weight"), F.sum(F.log("c") - F.col("weighted") / F.col("c")).alias("spread"))
    many = F.col("pages") > 1
    both = shape.join(content, ["site", "node"])
    mean = F.least(F.lit(1.0), F.col("spread") / F.col("weight") / F.log("pages"))
    discount = F.pow(F.lit(GAMMA), F.col("styles"))
    own = stored(both.withColumn("own", F.when(many, (1 - discount) * _entropy(F.col("pages"), F.col("weighted"), F.col("pages"))
                                                + discount * (1 - mean))), "elements")
    # the same path on other hosts, each host with its pages but none with more than the prior's
    trust = F.least(F.col("pages").cast("double"), F.lit(PRIOR))
    everywhere = own.where("own IS NOT NULL").groupBy("node").agg((F.sum(F.col("own") * trust) / F.sum(trust)).alias("usual"))
    usual = F.coalesce(F.col("usual"), F.lit(1.0))
    told = F.when(many, F.col("pages")).otherwise(0)
    return own.join(sendable(stored(everywhere, "paths")), "node", "left").select(
        "site", "node", "pages", "inside", "up",
        ((told * F.coalesce(F.col("own"), F.lit(0.0)) + PRIOR * usual) / (told + PRIOR)).alias("importance"))


def noise(tree: DataFrame) -> DataFrame:
    """(site, noise): for each host with any, the branches that hold no element of importance."""
    least = F.when(F.col("inside"), LEAST_INSIDE).otherwise(LEAST)
    below = tree.select("site", (F.col("importance") / least).alias("share"), F.explode("up").alias("node"))
    branches = below.groupBy("site", "node").agg(F.max("share").alias("share"))
    return branches.where("share < 1").groupBy("site").agg(F.collect_list("node").alias("noise"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(.., html, noise) as (.., text): the blocks that the markup allows and no branch of noise holds."""
    for batch in batches:
        texts = []
        for page, low in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            blocks, elements = html.read(page.as_py() or "")
            gone = set(low or ())
            texts.append("\n".join(b.text for b in html.candidates(blocks, elements)
                                   if not gone or not any(e.place in gone for e in b.element.above())))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(texts, pa.string())], ["id", "url", "text"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text): the article of every page, its blocks in order, one a line.

    White space inside a block, line breaks included, is one space; character references are decoded. A null or empty
    page, and one without an article, gives an empty text. Every row gives a row: null and repeated ids
    too. Pages with a null address or none with a host form one site. Extra columns are left out.
    """
    low = sendable(stored(noise(style_tree(pages, url_col, html_col)), "noise"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"),
                        F.xxhash64(host(F.col(url_col))).alias("__site"))
    met = rows.join(low.withColumnRenamed("site", "__site"), "__site", "left").select("id", "url", "html", "noise")
    kinds = dict(rows.dtypes)
    return met.mapInArrow(_extract, f"id {kinds['id']}, url {kinds['url']}, text string")
