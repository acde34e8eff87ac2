"""One parse of a page for all that classification and extraction need: a struct of facts."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa

from millrace.functions.lazy import arrow_udf
from millrace.functions.text import plain, sliced
from millrace.settings import DEFAULT

FACTS = (
    "struct<title:string,og_title:string,has_og_title:boolean,og_type:string,og_image:string,canonical:string,h1:string,article_h1:string,"
    "has_article:boolean,has_main:boolean,itemtype:string,jsonld:array<string>,visible_text:string,link_text_len:int,n_links:int,n_scripts:int,"
    "has_author_mark:boolean,author:string,has_date_mark:boolean,date:string,language:string,headings:array<string>,has_cookie_class:boolean,"
    "from_article:boolean,main_content:string,images:array<struct<url:string,width:string,height:string,cls:string>>,links:array<string>>"
)
#: What duplicates are told by; no other fact is made for them.
COMPARED = "struct<title:string,og_title:string,has_og_title:boolean,canonical:string,h1:string,article_h1:string,main_content:string>"
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_HIDDEN = ("script", "style", "template")
#: An ampersand that begins no reference with a semicolon: text as it stands, as in SQL.
_BARE = re.compile(r"&(?!#?[0-9A-Za-z]+;)")
#: Tags on which the parser's tolerant reading and this plain one agree; not those whose text may be read in another way.
_PLAIN = re.compile(r'<(?:/([a-zA-Z][a-zA-Z0-9]*)|([a-zA-Z][a-zA-Z0-9]*)((?: [a-zA-Z][a-zA-Z-]*="[^"&<>]*")*))>')
_ATTR = re.compile(r' ([a-zA-Z-]+)="([^"]*)"')
_RAW = frozenset("iframe noembed noframes noscript plaintext script style textarea title xmp".split())


class _Node:
    __slots__ = ("attrs", "kids", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: _Node | None):
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, parent, []

    def walk(self) -> Iterator[_Node]:
        """Elements in document order, itself first; no recursion, so depth does no harm."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(k for k in reversed(n.kids) if isinstance(k, _Node))

    def strings(self) -> list[str]:
        """The stripped text nodes below, scripts and styles left out."""
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                if s := n.strip():
                    out.append(s)
            elif n is self or n.tag not in _HIDDEN:
                stack.extend(reversed(n.kids))
        return out

    def text(self, gap: str = " ") -> str:
        return gap.join(self.strings())


class _Tree(HTMLParser):
    """Elements and text. A bare ampersand is read as one character that the page has nowhere, and put back."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None)
        self.bare = next(c for c in map(chr, range(0xF0000, 0xFFFFE)) if c not in html)
        self.feed(_BARE.sub(self.bare, html))
        self.close()

    def updatepos(self, i: int, j: int) -> int:
        """Lines and columns are not kept."""
        return j

    def parse_starttag(self, i: int) -> int:
        return self._run(i) or super().parse_starttag(i)

    def parse_endtag(self, i: int) -> int:
        return self._run(i) or super().parse_endtag(i)

    def _run(self, i: int) -> int:
        """The end of the plain tags from here on, with the texts between them; 0 for none."""
        data, k = self.rawdata, 0
        while self.cdata_elem is None and i >= 0 and (m := _PLAIN.match(data, i)):
            end, start, attrs = m.groups()
            tag = (end or start).lower()
            if tag in _RAW:
                break
            if 0 < k < i:
                self.handle_data(unescape(data[k:i]))
            if end:
                self.handle_endtag(tag)
            else:
                self.handle_starttag(tag, [(x.lower(), v) for x, v in _ATTR.findall(attrs)] if attrs else ())
            k = m.end()
            i = data.find("<", k)
        return k

    def handle_starttag(self, tag: str, attrs: Iterable[tuple]) -> None:
        if tag in _CLOSES_P:
            self._close("p", stop=("article", "div", "section", "main", "td", "li", "body"))
        if tag == "li":
            self._close("li", stop=("ul", "ol"))
        node = _Node(tag, {}, self.at)
        for k, v in attrs:
            node.attrs.setdefault(k, (v or "").replace(self.bare, "&"))
        self.at.kids.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.at = self.at.parent or self.root

    def _close(self, tag: str, stop: tuple = ()) -> None:
        n = self.at
        while n.parent is not None and n.tag != tag and n.tag not in stop:
            n = n.parent
        if n.tag == tag and n.parent is not None:
            self.at = n.parent

    def handle_endtag(self, tag: str) -> None:
        self._close(tag)

    def handle_data(self, data: str) -> None:
        self.at.kids.append(data.replace(self.bare, "&"))


def stripped(body: str, noise: list[str]) -> str:
    """`pages.strip_noise` of one text."""
    for n in noise:
        if len(n) < len(body) * 0.3:
            body = body.replace(n, "")
    return plain(body)


def facts(url: str | None, html: str | None, names: tuple | None = None) -> dict:
    """The facts of one page, or those named."""
    tree = _Tree(html or "")
    nodes = list(tree.root.walk())[1:]
    by: dict[str, list[_Node]] = {}
    for n in nodes:
        by.setdefault(n.tag, []).append(n)
    first = lambda tag: by[tag][0] if tag in by else None
    article = first("article") or first("main")
    body = cache(tree.root.text)

    def meta(name: str) -> _Node | None:
        return next((n for n in by.get("meta", ()) if n.attrs.get("property") == name), None)

    def content(n: _Node | None) -> str | None:
        return n.attrs.get("content") if n else None

    def has(k: str, v: str) -> bool:
        return any(n.attrs.get(k) == v for n in nodes)

    @cache
    def classed() -> list[tuple[_Node, list[str]]]:
        return [(n, n.attrs["class"].split()) for n in nodes if "class" in n.attrs]

    @cache
    def noise() -> list[_Node]:
        found = [n for tag in DEFAULT.noise_tags for n in by.get(tag, ())]
        return found + [n for c in DEFAULT.noise_classes for n, held in classed() if c in held] + [n for n in nodes if n.attrs.get("id") in DEFAULT.noise_ids]

    def author() -> str | None:
        n = next((n for n in nodes if n.attrs.get("itemprop") == "author" or n.attrs.get("rel") == "author"), None)
        return (n.attrs.get("content") or n.text() or None) if n else None

    def date() -> str | None:
        stamp = next((n for n in nodes if n.attrs.get("itemprop") == "datePublished"), None) or first("time")
        return content(meta("article:published_time")) or (stamp.attrs.get("datetime") or stamp.attrs.get("content") or stamp.text() if stamp else None) or None

    @cache
    def article_h1() -> _Node | None:
        return next((n for n in article.walk() if n.tag == "h1"), None) if article else None

    @cache
    def article_text() -> str | None:
        """The text of the article, without what is noise inside it."""
        if article is None:
            return None
        banned, h1 = {id(n) for n in noise()}, article_h1()
        out, stack = [], [article]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                if s := n.strip():
                    out.append(s)
            elif id(n) not in banned and n.tag not in _HIDDEN and n is not h1:
                stack.extend(reversed(n.kids))
        return " ".join(out) or None

    def main_content() -> str | None:
        """The article's text or else the longest block, or the first of the page's text; noise texts removed."""
        text = article_text()
        if text is None:
            blocks = [t for t in (n.text() for n in nodes if n.tag in ("p", "div", "section")) if len(t.split()) > 30]
            text = max(blocks, key=len) if blocks else body()[:5000]
        return stripped(text, [t for n in noise() if (t := n.text())]) if text else None

    def source(n: _Node) -> str | None:
        for k in ("src", "data-src", "data-lazy-src", "data-original", "srcset"):
            if v := n.attrs.get(k):
                return v.split()[0] if k == "srcset" and v.split() else v
        return None

    def joined(link: str) -> str | None:
        try:
            return urljoin(url or "", link)
        except ValueError:
            return None

    def images() -> list[dict]:
        inside: dict[int, _Node] = {}
        for box in (n for n in nodes if n.tag in ("article", "main", "figure")):
            for n in box.walk():
                if n.tag == "img":
                    inside.setdefault(id(n), n)
        found = [(joined(s), n.attrs.get("width"), n.attrs.get("height"), n.attrs.get("class", "").lower()) for n in inside.values() if (s := source(n)) and not s.startswith("data:")]
        return [dict(zip(("url", "width", "height", "cls"), x, strict=True)) for x in found]

    def links() -> list[str]:
        found = (joined(h) for n in by.get("a", ()) if (h := n.attrs.get("href")) is not None and not h.startswith(("#", "mailto:")))
        return [x for x in found if x]

    def canonical() -> str | None:
        n = next((n for n in by.get("link", ()) if "canonical" in n.attrs.get("rel", "").split()), None)
        return n.attrs.get("href") if n else None

    def og_image() -> str | None:
        said = content(meta("og:image"))
        return joined(said) if said else None

    def named(n: _Node | None) -> str | None:
        return n.text("") if n else None

    make = {
        "title": lambda: named(first("title")), "og_title": lambda: content(meta("og:title")), "has_og_title": lambda: meta("og:title") is not None,
        "og_type": lambda: content(meta("og:type")), "og_image": og_image, "canonical": canonical,
        "h1": lambda: named(first("h1")), "article_h1": lambda: named(article_h1()),
        "has_article": lambda: "article" in by, "has_main": lambda: "main" in by,
        "itemtype": lambda: next((n.attrs["itemtype"] for n in nodes if "schema.org/" in n.attrs.get("itemtype", "").lower()), None),
        "jsonld": lambda: ["".join(k for k in n.kids if isinstance(k, str)) for n in by.get("script", ()) if n.attrs.get("type") == "application/ld+json"],
        "visible_text": body, "link_text_len": lambda: sum(len(n.text("")) for n in by.get("a", ())), "n_links": lambda: len(by.get("a", ())), "n_scripts": lambda: len(by.get("script", ())),
        "has_author_mark": lambda: has("rel", "author") or has("itemprop", "author"), "author": author,
        "has_date_mark": lambda: "time" in by or has("itemprop", "datePublished") or meta("article:published_time") is not None, "date": date,
        "language": lambda: (first("html").attrs.get("lang") or None) if first("html") else None,
        "headings": lambda: [n.text("") for n in nodes if n.tag in ("h1", "h2", "h3")][:10],
        "has_cookie_class": lambda: any("cookie" in c.lower() for _, held in classed() for c in held),
        "from_article": lambda: article_text() is not None, "main_content": main_content, "images": images, "links": links,
    }
    return {k: make[k]() for k in names or make}


def _kind(ddl: str) -> pa.DataType:
    """The Arrow type of a DDL text like `FACTS`; executors have no session to ask."""
    if ddl.startswith("array<"):
        return pa.list_(_kind(ddl[6:-1]))
    if ddl.startswith("struct<"):
        return pa.struct([(n, _kind(k)) for n, k in re.findall(r"(\w+):(array<struct<[^>]*>>|array<\w+>|\w+)", ddl[7:-1])])
    return {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32()}[ddl]


_KIND, _KIND_COMPARED = _kind(FACTS), _kind(COMPARED)


def _made(parts: Iterator[tuple[pa.Array, pa.Array]], kind: pa.DataType) -> Iterator[pa.Array]:
    names = tuple(f.name for f in kind)
    for html, url in sliced(parts, 1 << 20):
        yield pa.array([facts(u, h, names) for u, h in zip(url.to_pylist(), html.to_pylist(), strict=True)], kind)


@arrow_udf(FACTS)
def html_facts(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """(html, url) to the struct of facts, for about 1 MB of pages at a time: no batch's parsed pages are ever held together."""
    yield from _made(parts, _KIND)


@arrow_udf(COMPARED)
def compared_facts(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """`html_facts`, only those of `COMPARED`."""
    yield from _made(parts, _KIND_COMPARED)
