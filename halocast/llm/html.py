"""Pages as blocks of text, each with its place in the tree of elements.

A small reader of real-world HTML: tags need not be closed or nested, quotes may be missing, raw
text and comments are passed over. Inline elements belong to the block around them; a run of
siblings with one signature (tag and class words, digits folded) is one element.
"""

from __future__ import annotations

import html as entities
import re
from functools import lru_cache

import xxhash

# ---- fixed values ----
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object canvas audio video select textarea title noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr img br input picture source track".split())
#: Tags whose text is no part of an article.
ASIDE_TAGS = frozenset("nav footer aside form button menu dialog fieldset".split())
#: Words of a class, id or role that name such parts.
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion promoted banner banners "
    "nav navbar navigation navi menu menus menubar breadcrumb breadcrumbs pagination pager sidebar sidebars sidenav side aside complementary "
    "header headers masthead topbar footer footers colophon contentinfo copyright legal notice notices cookie cookies consent gdpr alert alerts popup "
    "modal overlay dialog newsletter subscribe subscription signup login search form forms comment comments commentlist respond replies reply disqus "
    "discussion reactions share sharing social related recommended recommendations teaser teasers widget widgets toolbar skip tags".split())
#: Headings and rows end an open one of their kind, and any block ends an open paragraph.
ENDS_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
               "option": {"option"}, "tbody": {"thead", "tbody", "tfoot", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
# ---- end of fixed values ----

LEVELS = 64  # elements below this depth count as their ancestor at it
SHORT = 12  # blocks of so many words have their words as features, longer ones are one feature

TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role|style|itemprop|aria-hidden|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/"']|$)""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
DIGITS = re.compile(r"\d+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def hash64(text: str) -> int:
    n = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return n - (1 << 64) if n >= 1 << 63 else n


@lru_cache(maxsize=1 << 16)
def _place(parent: int, signature: str) -> int:
    return hash64(f"{parent}>{signature}")


@lru_cache(maxsize=1 << 14)
def _traits(tag: str, attrs: str) -> tuple[str, bool, bool, bool]:
    """An element's signature, and whether it names a part beside the article, an article, or is hidden."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(attrs)} if attrs.strip(" /") else {}
    words = [w.lower() for name in ("class", "id", "role") for w in WORDS.findall(found.get(name, ""))]
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(HIDDEN.search(found.get("style", "")))
    names_article = tag in ("article", "main") or found.get("role", "").lower() in ("main", "article") or found.get("itemprop", "").lower() == "articlebody"
    frame = names_article or tag in ("html", "body", "h1")
    beside = not frame and (tag in ASIDE_TAGS or any(w in ASIDE_WORDS for w in words))
    if tag == "article" and any(w in ASIDE_WORDS for w in words):
        names_article, beside = False, True  # a comment or a teaser
    classes = " ".join(sorted(set(DIGITS.sub("0", found.get("class", "")).lower().split())))
    return f"{tag}.{classes}" if classes else tag, beside, names_article, hidden


class Element:
    __slots__ = ("tag", "place", "up", "level", "kind", "holds", "link_chars", "chars", "links", "seen")

    def __init__(self, tag: str, place: int, up: Element | None, kind: str):
        self.tag, self.place, self.up, self.kind = tag, place, up, kind
        self.level = up.level + 1 if up else 0
        self.holds = set()  # articles or headings inside
        self.link_chars = self.chars = self.links = 0
        self.seen: list[str] = []  # signatures of children, runs folded

    def above(self):
        e = self
        while e:
            yield e
            e = e.up


class Block:
    __slots__ = ("element", "text", "links", "link_chars")

    def __init__(self, element: Element, text: str, links: int, link_chars: int):
        self.element, self.text, self.links, self.link_chars = element, text, links, link_chars

    def inside(self, kind: str) -> bool:
        return any(e.kind == kind for e in self.element.above())

    def menu(self) -> bool:
        return self.links >= 3 and 10 * self.link_chars >= 7 * len(self.text)


def read(page: str) -> tuple[list[Block], list[Element]]:
    """All blocks of a page in their order, and all its elements."""
    root = Element("html", _place(0, "html"), None, "")
    elements, blocks, stack = [root], [], [root]
    pieces: list[str] = []
    links = link_start = link_chars = 0
    in_link = False
    tag_at, pos, size = TAG, 0, len(page)

    def flush() -> None:
        nonlocal links, link_chars, link_start
        if pieces:
            if in_link:
                link_chars += sum(map(len, pieces)) - link_start
            raw = "".join(pieces)
            text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
            pieces.clear()
            if text:
                blocks.append(Block(stack[-1], text, links, link_chars))
                for e in stack:
                    if e.kind == "list":
                        e.chars += len(text)
                        e.link_chars += link_chars
                        e.links += links
        links = link_chars = link_start = 0

    def close(depth: int) -> None:
        flush()
        del stack[depth:]

    while pos < size:
        at = page.find("<", pos)
        if at < 0:
            pieces.append(page[pos:])
            break
        if at > pos:
            pieces.append(page[pos:at])
        after = page[at + 1:at + 2]
        if after in ("!", "?") or (after == "/" and not page[at + 2:at + 3].isalpha()):
            if page.startswith("<!--", at):
                end = page.find("-->", at + 2)
                pos = size if end < 0 else end + 3
            else:
                end = page.find(">", at)
                pos = size if end < 0 else end + 1
            continue
        if not (after == "/" or (after.isascii() and after.isalpha())):
            pieces.append("<")
            pos = at + 1
            continue
        m = tag_at.match(page, at)
        if not m and tag_at is TAG:
            tag_at = LOOSE  # a quote stays open to the end of the page: from here on, quotes don't count
            m = LOOSE.match(page, at)
        if not m:
            if page.find(">", at) < 0:
                break  # the page ends inside a tag
            pieces.append("<")
            pos = at + 1
            continue
        pos = m.end()
        closing, tag, attrs = m[1], m[2].lower(), m[3]
        if closing:
            if tag == "a":
                if in_link:
                    link_chars += sum(map(len, pieces)) - link_start
                in_link = False
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    close(depth)
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, pos) if not attrs.endswith("/") or tag in ("script", "style") else None
            if end:
                close_at = page.find(">", end.end())
                pos = size if close_at < 0 else close_at + 1
            elif tag in ("script", "style", "title", "textarea"):
                pos = size
            pieces.append(" ")
            continue
        signature, beside, article, hidden = _traits(tag, attrs)
        kind = "beside" if beside or hidden else "article" if article else "list" if tag in ("ul", "ol") else ""
        if tag in INLINE and not kind:
            if tag == "br":
                pieces.append(" ")
            elif tag == "a":
                if in_link:
                    link_chars += sum(map(len, pieces)) - link_start
                in_link, links, link_start = True, links + 1, sum(map(len, pieces))
            top = stack[-1]
            if not top.seen or top.seen[-1] != tag:
                top.seen.append(tag)
            continue
        if tag in VOID:
            close(len(stack))
            continue
        if tag not in INLINE:
            flush()
            in_link = False
            ends, holder = ENDS_ITSELF.get(tag, set()) | {"p"}, HOLDS.get(tag, set())
            cut = None
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in holder:
                    break
                if stack[depth].tag in ends:
                    cut = depth
                elif tag not in ENDS_ITSELF and stack[depth].tag not in INLINE:
                    break
            if cut is not None:
                del stack[cut:]
        else:
            flush()
        if tag in ("html", "body"):
            continue
        if tag == "head":
            kind = "beside"
        if tag == "header" and not any(e.kind == "article" for e in stack):
            kind = "beside"
        top = stack[-1]
        if not top.seen or top.seen[-1] != signature:
            top.seen.append(signature)
        place = top.place if top.level >= LEVELS else _place(top.place, signature)
        e = Element(tag, place, top, kind)
        e.level = min(e.level, LEVELS)
        if kind == "article" or tag == "h1":
            for up in top.above():
                up.holds.add("h1" if tag == "h1" else "article")
        elements.append(e)
        stack.append(e)
    flush()
    return blocks, elements


def beside(block: Block) -> bool:
    """Whether the block's markup puts it beside the article; a part that holds the article itself doesn't count."""
    inner = True
    for e in block.element.above():
        if e.kind == "article":
            inner = False
        if e.kind == "beside" and inner and "article" not in e.holds and not (e.tag == "form" and "h1" in e.holds):
            return True
        if e.kind == "beside" and not inner and "article" not in e.holds:
            return True
        if e.kind == "list" and e.links >= 3 and 10 * e.link_chars >= 9 * e.chars and not block.inside("article"):
            return True
    return block.menu() and not block.inside("article")


def features(text: str) -> list[int]:
    """What the block says, digits folded: its words, or the whole of it if it is longer than ``SHORT`` words."""
    folded = DIGITS.sub("0", text.lower())
    words = folded.split()
    return [hash64(w) for w in words] if len(words) <= SHORT else [hash64(folded)]


def candidates(blocks: list[Block], elements: list[Element]) -> list[Block]:
    """The blocks that the page's own markup allows: those of its article, if it names one, and its main heading."""
    article = any(e.kind == "article" and e.tag != "main" for e in elements) or any(e.kind == "article" for e in elements)
    strict = any(e.kind == "article" and e.tag == "article" for e in elements)
    out = []
    for b in blocks:
        if beside(b):
            continue
        if article and b.element.tag != "h1":
            if strict and not any(e.kind == "article" and e.tag != "main" for e in b.element.above()):
                continue
            if not b.inside("article"):
                continue
        out.append(b)
    return out
