"""Main text of web pages, with site templates removed.

Every page is parsed into a tree.  Subtrees are hashed and counted per host over
pages of different content; those that recur on many of a host's pages are its
template and are deleted, as are menus, forms, adverts and other page furniture
that tags, roles or names give away.  What is left of the article is the text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import small, stage, table

#: A subtree is template when pages of at least LEAST_PAGES different contents
#: of the host have it, and at least this share of the host's contents.
LEAST_PAGES = 5
SHARE = 0.2
#: Hosts whose templates are broadcast; those of more hosts are joined by shuffle.
BROADCAST_HOSTS = 50_000

#: Words of a class or id: runs of letters, cut where small letters turn to capitals.
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_NAME = re.compile(r"/?[a-zA-Z][^\s/<>]*+")
#: What ends a tag, or begins a quoted value of it.
_STOP = re.compile(r"[<>]|=\s*+([\"'])")
_ATTRIBUTE = re.compile(r"([^\s=\"'/<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_MATH = {"math", "mrow", "mi", "mo", "mn", "ms", "mtext", "mspace", "mfrac", "msqrt", "mroot", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mstyle", "mpadded", "semantics"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"} | _MATH
_FURNITURE = {"head", "nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "audio", "video", "canvas", "annotation", "annotation-xml"} | _RAW
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "tablist"}
#: Words in a class or id that mark page furniture.
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar side menu nav navbar navigation topnav breadcrumb breadcrumbs "
    "footer header masthead topbar toolbar cookie cookies consent gdpr notice notices alert notification popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations trending popular comment comments commentlist discussion disqus respond reply replies responses widget pagination "
    "pager search paywall skip hidden".split()
)
#: Of them, those that an article's heading may have, those that a layout around
#: the article may have, and those that may mark an editor's own words.
_HEADERS = {"header", "masthead", "banner"}
_LAYOUT = {"side", "sidebar", "widget", "hidden", "overlay"}
_REMARKS = {"comment", "comments", "notice", "notices", "reply", "discussion", "responses", "related"}
#: Words that say where furniture is or what it is made of; a class or id of these
#: and words of furniture names furniture (comments-area, adSlot), one with any other
#: word something else (side-by-side, social-science, notice-period).
_PLACES = {"site", "left", "right", "bottom", "box", "links", "list", "global"}
_MADE_OF = _PLACES | set(
    "area section block wrap wrapper wrappers container containers unit units slot slots bar panel inner outer button buttons icon icons link form item items thread threads "
    "count js user users reader readers top main primary secondary mobile desktop sticky fixed body content post posts entry entries article articles page story stories".split()
)
#: Of them, those that can be the article's own.
_OWN = set("main body content post posts entry entries article articles page story stories wrap wrapper inner outer container".split())
#: Those that mark an article as not the page's own.
_BESIDE = frozenset({"ad", "ads", "advert", "advertisement", "comment", "comments", "reply", "replies", "respond", "related", "recommended", "promo", "sponsored", "teaser", "teasers"})
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_FLOW = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "blockquote", "pre", "td", "th", "tr", "figcaption"}
_PHRASES = (_INLINE | _HEADINGS | {"p", "blockquote", "figcaption"}) - {"a"}
_ENDS_P = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "div", "table", "section", "article", "aside", "nav", "header", "footer", "form", "blockquote", "pre", "main", "figure", "hr", "address", "fieldset", "details"}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_LISTS = {"table", "ul", "ol", "dl", "select"}
_SCOPE = {"html", "body", "table", "ul", "ol", "dl", "select", "td", "th", "div", "section", "article", "main", "nav", "aside", "header", "footer", "form"}


@lru_cache(1 << 16)
def _marked(token: str, marks: frozenset[str]) -> frozenset[str]:
    words = {w.lower() for w in _WORDS.findall(token) if len(w) > 1}
    found = words & marks
    known = marks | _PLACES if found <= _HEADERS else marks | (_MADE_OF - _OWN if found <= _LAYOUT else _MADE_OF)
    return frozenset(found) if words <= known else frozenset()


def _marks(names: str, marks: frozenset[str], tag: str) -> set[str]:
    """The words of marks in those classes and ids that name furniture.  A single
    paragraph or part of one is no list of comments."""
    found = {w for token in names.split() for w in _marked(token, marks)}
    return found - _REMARKS if tag in _PHRASES else found


class _Element:
    __slots__ = ("tag", "names", "parts", "furniture", "named", "main", "key", "headed", "linked")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.parts, self.key, self.headed = tag, [], 0, tag in _HEADINGS
        #: Of an element with a heading, whether the first one is a link.
        self.linked = False
        given = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes.strip() else {}
        names = f"{given.get('class', '')} {given.get('id', '')}".strip() if given else ""
        self.names = names.lower()
        role = given.get("role", "").lower()
        self.main = tag in ("article", "main") or role in ("main", "article") or given.get("itemprop", "").lower() == "articlebody"
        found = _marks(names, _BESIDE if self.main else _NAMES, tag) if names and tag not in ("html", "body") else set()
        unseen = "hidden" in given or given.get("aria-hidden", "").lower() == "true" or "display:none" in given.get("style", "").lower().replace(" ", "")
        #: Whether only names mark the element, and whether only as a header.
        plain = not (tag in _FURNITURE or role in _ROLES or unseen)
        self.named = (2 if found <= _HEADERS else 1) if found and plain else 0
        self.furniture = bool(found) or not plain


def _token(page: str, at: int, quotes: set[str]) -> tuple[int, int, str, str] | None:
    """The next markup: where it begins and ends, its name (with a slash for an end
    tag, empty for comments and the like) and its attributes.  A tag that has no
    end stops before the next one.  A quote that nothing closes is none, and is
    taken out of quotes, so that none is looked for twice."""
    size = len(page)
    while (begin := page.find("<", at)) >= 0:
        name = _NAME.match(page, begin + 1)
        if name:
            at = first = name.end()
            while (stop := _STOP.search(page, at)) and stop[1]:
                close = page.find(stop[1], stop.end()) if stop[1] in quotes else -1
                if close < 0:
                    quotes.discard(stop[1])
                at = close + 1 if close >= 0 else stop.end()
            last = stop.start() if stop else size
            return begin, last + 1 if stop and stop[0] == ">" else last, name[0].lower(), page[first:last]
        if page.startswith("!--", begin + 1):
            close = page.find("-->", begin + 4)
            return begin, close + 3 if close >= 0 else size, "", ""
        if begin + 1 < size and page[begin + 1] in "!?/":
            close = page.find(">", begin + 1)
            return begin, close + 1 if close >= 0 else size, "", ""
        at = begin + 1
    return None


class _Open:
    """The open elements, outermost first, with the places of those of each name."""

    def __init__(self, root: _Element):
        self.all, self.at = [root], {}
        self.scopes, self.lists = [], []

    def last(self, *tags: str) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def push(self, e: _Element) -> None:
        place = len(self.all)
        self.all[-1].parts.append(e)
        self.all.append(e)
        self.at.setdefault(e.tag, []).append(place)
        if e.tag in _SCOPE:
            self.scopes.append(place)
        if e.tag in _LISTS:
            self.lists.append(place)

    def close(self, place: int) -> None:
        while len(self.all) > place:
            self.at[self.all.pop().tag].pop()
        for places in (self.scopes, self.lists):
            while places and places[-1] >= place:
                places.pop()


def parse(page: str) -> _Element:
    """The page as a tree; unclosed and stray tags are put right as browsers do,
    in short; text of raw elements (scripts, styles) is left out.  Takes time in
    proportion to the page, whatever it holds."""
    root = _Element("#root")
    open_ = _Open(root)
    at, quotes = 0, {'"', "'"}
    while token := _token(page, at, quotes):
        begin, end, name, attributes = token
        if begin > at:
            open_.all[-1].parts.append(page[at:begin])
        at = end
        tag = name.lstrip("/")
        if not name:
            continue
        if name[0] == "/":
            place = open_.last(tag)
            if place > 0 and (tag not in _INLINE or not open_.scopes or place > open_.scopes[-1]):
                open_.close(place)
            if tag in ("p", "br"):
                open_.all[-1].parts.append(" ")
            continue
        if tag in _ENDS_P:
            place = open_.last("p")
            if place > 0 and (not open_.scopes or place > open_.scopes[-1]):
                open_.close(place)
        elif tag in _SIBLINGS:
            place = open_.last(*_SIBLINGS[tag])
            if place > 0 and (not open_.lists or place > open_.lists[-1]):
                open_.close(place)
        elif tag == "body" and open_.all[-1].tag == "head":
            open_.close(len(open_.all) - 1)
        if tag in _VOID or attributes.endswith("/") and tag in _RAW:
            if tag not in _INLINE:
                open_.all[-1].parts.append(" ")
        elif tag in _RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            at = close.end() if close else len(page)
        else:
            open_.push(_Element(tag, attributes))
    if at < len(page):
        open_.all[-1].parts.append(page[at:])
    for e in _deep(root):
        inside = [x for x in e.parts if x.__class__ is _Element]
        if e.tag in _HEADINGS:
            e.linked = any(x.tag == "a" or x.linked for x in inside) and not any(x.strip() for x in e.parts if x.__class__ is str)
        else:
            headed = next((x for x in inside if x.headed), None)
            e.headed = headed is not None
            e.linked = headed.linked if headed else e.tag not in ("article", "main") and any(x.tag == "a" or x.linked for x in inside)
    return root


def _deep(root: _Element) -> list[_Element]:
    """All elements, each after the elements inside it."""
    out, todo = [], [root]
    while todo:
        e = todo.pop()
        out.append(e)
        todo += [x for x in e.parts if x.__class__ is _Element]
    return out[::-1]


def key(e: _Element) -> int:
    """A hash of an element's tag, names, text and children."""
    if not e.key:
        for x in _deep(e):
            made = blake2b(f"{x.tag} {x.names}".encode(), digest_size=8)
            for y in x.parts:
                made.update(b"<%d>" % y.key if y.__class__ is _Element else " ".join(y.split()).encode("utf-8", "surrogatepass"))
            x.key = int.from_bytes(made.digest(), "little", signed=True) or 1
    return e.key


def _spared(e: _Element) -> bool:
    """Whether an element named as a header holds a heading."""
    return e.named == 2 and e.headed


def _mains(root: _Element, named: bool) -> list[_Element]:
    found, todo = [], [root]
    while todo:
        e = todo.pop()
        if e.furniture and not (named and e.named and not e.main):
            continue
        if e.main:
            found.append(e)
        else:
            todo += [x for x in reversed(e.parts) if x.__class__ is _Element]
    return found


def _main(root: _Element) -> list[_Element]:
    """The outermost elements that hold the article, else the whole page.  Where
    all of them are inside elements that only a name marks, these are no furniture."""
    found = _mains(root, False) or _mains(root, True)
    inner = []
    for e in found:  # a main that wraps articles stands for them
        if e.tag != "article":
            own = [x for part in e.parts if part.__class__ is _Element for x in _articles(part)]
            inner += own or [e]
        else:
            inner.append(e)
    # Beside the page's own article, those headed by a link lead to others.
    own = [e for e in inner if not _teaser(e)]
    return own or inner or [root]


def _teaser(e: _Element) -> bool:
    return e.tag == "article" and e.headed and e.linked


def _articles(e: _Element) -> list[_Element]:
    found, todo = [], [e]
    while todo:
        x = todo.pop()
        if x.furniture:
            continue
        if x.tag == "article":
            found.append(x)
        else:
            todo += [y for y in reversed(x.parts) if y.__class__ is _Element]
    return found


def main_text(root: _Element, template: frozenset | set = frozenset(), met: set | None = None) -> str:
    """Blocks of the article in page order, joined by one space.  Inside an
    article element only containers count as template, so a sentence that many
    articles share stays; a header inside it stays if it holds a heading."""
    out: list[str] = []
    for main in _main(root):
        whole = main.tag == "#root"
        todo: list = [main]
        while todo:
            e = todo.pop()
            if e.__class__ is str:
                out.append(e)
                continue
            if e is not main:
                if e.furniture and (whole or not _spared(e)) or e.tag == "header" and (whole or not e.headed) or _teaser(e):
                    out.append(" ")
                    continue
                if e.tag not in _INLINE and (whole or e.tag not in _FLOW) and e.tag not in ("html", "body") and not e.main:
                    if met is not None:
                        met.add(key(e))
                    if template and key(e) in template:
                        out.append(" ")
                        continue
            block = e.tag not in _INLINE
            if block:
                out.append(" ")
                todo.append(" ")
            todo += reversed(e.parts)
        out.append(" ")
    return " ".join(html.unescape("".join(out)).split())


def host(url) -> F.Column:
    """Host of a URL, lower-cased; a URL without one is its own host."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    return F.lower(F.when(found != "", found).otherwise(F.coalesce(url, F.lit(""))))


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = batch.column("html").to_pylist()
        texts, keys, contents = [], [], []
        for page in pages:
            met: set[int] = set()
            texts.append(main_text(parse(page or ""), met=met))
            keys.append(sorted(met))
            contents.append(int.from_bytes(blake2b(texts[-1].encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True))
        rest = [p if k else None for p, k in zip(pages, keys)]
        columns = {"html": pa.array(rest, pa.string()), "text": pa.array(texts, pa.string()), "keys": pa.array(keys, pa.list_(pa.int64())), "content": pa.array(contents, pa.int64())}
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), batch.column("host"), *columns.values()], ["page_id", "url", "host", *columns])


def templates(parsed: DataFrame, least: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """parsed(host, keys, content) -> host, template: the subtrees that recur on
    the host.  A host has at most 1/share times the elements of a page of them.
    Key 0 stands for the page itself."""
    met = parsed.select("host", "content", F.explode(F.concat(F.array(F.lit(0).cast("long")), "keys")).alias("key")).distinct()
    counts = stage(met.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least), "subtrees")
    total = counts.where("key = 0").select("host", F.col("n").alias("of"))
    found = counts.where("key <> 0").join(total, "host").where(F.col("n") >= F.col("of") * share)
    return found.groupBy("host").agg(F.collect_list("key").alias("template"))


def _cleared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for page, text, keys, template in zip(*(batch.column(c).to_pylist() for c in ("html", "text", "keys", "template"))):
            gone = set(template or ()) & set(keys)
            out.append(main_text(parse(page or ""), gone) if gone else text)
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame, least: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars.

    Pages are parsed once; only those that hold a template subtree are parsed
    again to leave it out.

    Edges: null or empty html gives empty text; a null url is a host of its own;
    cut-off tags are markup, cut-off text stays; repeated pages give repeated
    rows but count as one page for templates; other columns are not read.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    base = pages.select("page_id", "url", host(F.col("url")).alias("host"), "html")
    parsed = stage(base.mapInArrow(_parsed, f"page_id {kind}, url string, host string, html string, text string, keys array<long>, content long"), "parsed")
    plain = parsed.where("size(keys) = 0").select("page_id", "url", "text")
    found = stage(templates(parsed, least, share), "templates")
    rest = parsed.where("size(keys) > 0").join(small(found, BROADCAST_HOSTS), "host", "left").select("page_id", "url", "html", "text", "keys", "template")
    cleared = rest.mapInArrow(_cleared, f"page_id {kind}, url string, text string")
    return plain.union(cleared).withColumn("n_chars", F.length("text").cast("long"))


def op10_extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
