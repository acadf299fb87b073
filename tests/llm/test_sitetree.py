"""Main text: given pages against their articles, templates without names, awkward markup, entropies by hand."""

import collections
import math
import random
import re
from html import unescape

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halocast.llm import html, sitetree
from halocast.sources.tables import read_table

SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
                       T.StructField("id", T.StringType()), T.StructField("site", T.StringType()), T.StructField("noise", T.StringType()),
                       T.StructField("text", T.StringType())])


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)


def texts(spark, rows):
    return {r.id: r.text for r in sitetree.main_text(table(spark, rows)).collect()}


def body_of(page):
    """The article of a given page, by its known form."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = (" ".join(unescape(re.sub(r"<[^>]*>", " ", p.replace("<b>", ""))).split()) for p in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(p for p in parts if p)


def test_given_pages(spark, sf):
    pages = read_table(spark, sf, "pages")
    want = {r.page_id: body_of(r.html) for r in pages.collect()}
    got = {r.id: r.text for r in sitetree.main_text(pages).collect()}
    assert got == want


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_templates_without_names(spark):
    """Same frame on all pages of a host, in plain div elements; articles differ."""
    rng = random.Random(5)
    rows, want = [], {}
    for i in range(60):
        title, paragraphs = prose(rng, 6), [prose(rng, rng.randint(5, 60)) for _ in range(rng.randint(1, 6))]
        frame = ("<div><div><span>Home</span> <span>News</span></div><div class='x9'>Visitors today 12{0}: see our offers</div></div>"
                 "<div class='k{0}'><h2>{1}</h2>{2}<div>Read all about it here</div></div><div><p>All rights kept by us</p></div>")
        rows.append((i, "https://plain.example/" + str(i), "<html><body>" + frame.format(i, title, "".join(f"<p>{p}" for p in paragraphs))))
        want[i] = "\n".join([title, *paragraphs])
    rows.append((1000, "http://alone.example/1", "<body><h2>Only</h2><p>page of its host</p>"))
    want[1000] = "Only\npage of its host"
    assert texts(spark, rows) == want


def test_copies_are_no_template(spark):
    """A host whose pages hold one article many times keeps it."""
    page = "<body><nav>menu {}</nav><div><h2>Same title</h2><p>One text on every page of this host</p></div>"
    rows = [(i, "http://copies.example/", page.format(i)) for i in range(50)]
    assert set(texts(spark, rows).values()) == {"Same title\nOne text on every page of this host"}


CASES = [
    ("<article><h1>T</h1><p>a&nbsp;&amp;\n\t b<br>c</p>x &lt;y&gt; <b>bo</b>ld</article><aside>side</aside>", "T\na & b c\nx <y> bold"),
    ("<header><h1>Site</h1></header><nav>n</nav><main><div class='breadcrumbs'>a</div><article><header><h1>T</h1></header><p>x</article></main>", "T\nx"),
    ("<article><p>x<section id=comments><article class=comment><p>nice</article></section><form>s</form><div class='cookie-notice'>c</div>y</article>", "x\ny"),
    ("<div class='content with-sidebar'><article>in</article></div><div class=sidebar>out</div><div id='ad-top'>buy</div>", "in"),
    ("<p>one<p>two<ul><li>1<li>2</ul><script>var t='</p>';</script><style>p{}</style><!-- no --><table><tr><td>p<td>q</table>", "one\ntwo\n1\n2\np\nq"),
    ("plain text 1 < 2 & 3", "plain text 1 < 2 & 3"), ("", ""), (None, ""), ("<nav>only a menu</nav>", ""), ("<article></article><p>out", ""),
    ("<p class='x>unclosed quote</p><p>y</p>", "unclosed quote\ny"), ("<p>cut in a tag <a href='x", "cut in a tag"), ("<!-- never closed <p>x", ""),
    ("<ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a></ul><p>Body <a href=4>with link</a> and words", "Body with link and words"),
    ("<form><h1>A</h1><p>whole page in a form</p></form>", "A\nwhole page in a form"), ("<p hidden>h</p><p style='display:none'>h</p><p>seen", "seen"),
    ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"), ("<P>Upper</P><SCRIPT>x</SCRIPT>&#233;&eacute;&#x1F600;", "Upper\néé😀"),
    ("x  y\r\n z", "x y z"),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_reader(k):
    page, want = CASES[k]
    assert "\n".join(b.text for b in html.candidates(*html.read(page or ""))) == want


def test_rows(spark):
    rows = [(i, f"http://h{i}.example/", page) for i, (page, _) in enumerate(CASES)]
    rows += [(None, None, "<p>no id"), (500, "", "<p>no host"), (500, "", "<p>no host"), (501, "HTTP://u@H.example:80/x", "<p>" + "long " * 400_000)]
    got = [(r.id, r.text) for r in sitetree.main_text(table(spark, rows)).collect()]
    want = [(i, t) for i, (_, t) in enumerate(CASES)]
    want += [(None, "no id"), (500, "no host"), (500, "no host"), (501, ("long " * 400_000).strip())]
    assert collections.Counter(got) == collections.Counter(want)


def test_nothing(spark):
    assert texts(spark, []) == {}


def test_host(spark):
    urls = ["https://A.example.org/x", "http://u:p@b.example:8080?q", "//c.example", "no host", None, "ftp://d.example#x"]
    got = [r.h for r in spark.createDataFrame([(u,) for u in urls], "u string").select(sitetree.host(F.col("u")).alias("h")).collect()]
    assert got == ["a.example.org", "b.example", "c.example", "", "", "d.example"]


def test_importance_by_hand(spark):
    """Content and style entropies against plain sums over distinct pages."""
    rng = random.Random(2)
    pages = [f"<body><div>{rng.choice(['red', 'green', 'blue'])} note {rng.choice(['x', 'y'])}</div><section>{'<p>' * rng.randint(0, 1)}{prose(rng, 20)}</section>" for _ in range(40)]
    rows = [(i, "http://one.example/", p) for i, p in enumerate(pages + pages[:10])]
    tree = {r.node: r for r in sitetree.style_tree(table(spark, rows)).collect()}
    places, seen = collections.defaultdict(list), {}
    for p in pages:
        blocks, elements = html.read(p)
        seen.setdefault("\n".join(b.text for b in html.candidates(blocks, elements)), (blocks, elements))
    styles = collections.defaultdict(collections.Counter)
    for blocks, elements in seen.values():
        counts = collections.defaultdict(collections.Counter)
        for b in blocks:
            counts[b.element.place].update(html.features(b.text))
        for place, c in counts.items():
            places[place].append(c)
            styles[place][" ".join(next(e.seen for e in elements if e.place == place))] += 1
    for place, shown in places.items():
        m = len(shown)
        total = sum(shown, collections.Counter())
        entropy = lambda cs, t: -sum(c / t * math.log(c / t) for c in cs if c) / math.log(m)
        content = sum(1 - entropy([c[f] for c in shown], t) for f, t in total.items()) / len(total)
        g = sitetree.GAMMA ** len(styles[place])
        own = (1 - g) * entropy(styles[place].values(), m) + g * content
        assert tree[place].pages == m and tree[place].importance == pytest.approx(own)
