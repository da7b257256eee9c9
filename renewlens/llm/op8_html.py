"""Main text of web pages by tag-path ratios.

A page is cut into text blocks, each with its root-to-leaf path of block elements (with their first
class). Per path, text length and punctuation are summed over its blocks; the length per block and
the punctuation per block are fused, smoothed along the page, and paths above a threshold set by the
page's own mean and deviation are content: every block with such a path is taken, wherever it stands.
Blocks under the threshold (headings, short lines) join them if their container holds selected text,
if they are in an article or main element that does, or if they stand between selected blocks; lists of
links never do.
Elements that say by their tag, role, whole class or whole id that they are not the article (menus,
headers, footers, sidebars, notices, adverts, comments) are left out first, unless they hold most of the
text; so are the controls of a form, in which nothing joins.

Character references are decoded, white space inside a block becomes one space, blocks are joined
by line feeds. Line breaks (br) are white space inside a block.

Defined results: null or empty html, and pages without article text, give the empty text; unclosed
and crossing tags are repaired by closing what an end tag encloses; equal ids and repeated rows each
keep a row.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from renewlens.llm.common import str_texts, table

SMOOTH = (0.25, 0.5, 1.0, 0.5, 0.25)  # weights of a block's neighbours along the page

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>"
    # a quoted value may hold ">"; the possessive repeat never tries a tag twice
    r"|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>=]|=\s*+(?:\"[^\"]*\"|'[^']*')?)*+)>"
    r"|[^<]+|<",
    re.DOTALL,
)
_ATTR = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？]")
_NAME_PART = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")

# Element and attribute names of HTML.
_RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "svg", "title", "object", "canvas"}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small"
    " span strike strong sub sup time tt u var"
    " math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mfenced mstyle mpadded"
    " mspace semantics".split()
)
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_PAGE = {"", "html", "body"}
# Elements that are text or parts of it; all others are containers.
_TEXT = set(
    "p h1 h2 h3 h4 h5 h6 hgroup ul ol li dl dt dd pre blockquote table caption thead tbody tfoot tr td th figure"
    " figcaption address details summary".split()
)
_NOT_ARTICLE = {"nav", "aside", "footer", "menu", "dialog", "button", "select", "datalist", "optgroup", "option", "head"}
_FORMS = {"form", "fieldset"}
_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
_WORDS = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent"
    " gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup sidebar nav navbar"
    " navigation menu breadcrumb breadcrumbs masthead footer comment comments disqus reply replies share sharing"
    " social related recommended recommendations widget toolbar pagination pager login search skip copyright"
    " disclaimer bio commentlist commentform adsbygoogle".split()
)
# Parts of a class or id that say where or how something is, not what.
_PLACES = set(
    "area bar block box bottom container group home inner item items left link links list main outer page panel"
    " primary right section secondary site slot text top unit wrap wrapper"
    # and what it belongs to or is made of
    " article articles author body button buttons entry form news post posts reader readers stories story trail user users".split()
)
# What a start tag closes when it is open.
_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "body": {"head"}, "tbody": {"thead", "tbody", "tr", "td", "th"},
}
_SCOPE = set("table ul ol dl div section article main body html td th blockquote aside nav header footer form".split())


NEVER, WORDED, FORM = 1, 2, 3  # kinds of marks


@dataclass
class Element:
    tag: str
    path: int  # number of its root-to-leaf tag path
    mark: int  # how it says that it is not part of an article
    top: Element | None  # the outermost article or main element around, or itself
    parent: Element | None
    outside: bool = False  # not part of the article
    form: bool = False  # in a form: only what passes the threshold is text
    size: int = 0  # characters inside
    size_named: int = 0  # of these, those in an article or main element
    first: int | float = math.inf  # numbers of the first and last selected block inside
    last: int = -1
    direct: bool = False  # hosts selected text itself
    host: Element | None = None  # the container around, or itself
    holder: Element | None = None  # the innermost element around that holds selected text


@dataclass
class Block:
    element: Element
    text: str
    links: int


def _mark(tag: str, attrs: str, inside: bool) -> int:
    """How an element says by itself that it is not part of an article; ``inside`` an article or main, a header is."""
    if tag in _NOT_ARTICLE:
        return NEVER
    if tag == "header":
        return 0 if inside else WORDED
    if not attrs or tag in ("html", "body", "article", "main"):
        return FORM if tag in _FORMS else 0
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return WORDED
        if name == "role" and value.lower() in _ROLES:
            return WORDED
        if name in ("class", "id") and any(_tells(token, inside) for token in value.split()):
            return WORDED
        if name == "style" and "display:none" in value.lower().replace(" ", ""):
            return WORDED
    return FORM if tag in _FORMS else 0


def _tells(token: str, inside: bool) -> bool:
    """Whether a whole class or id is made of words for what is not the article."""
    parts = {w.lower() for w in _NAME_PART.findall(token)} - _PLACES
    return bool(parts) and parts <= (_WORDS if inside else _WORDS | {"header"})


def _exclude(found: list[Block], elements: list[Element]) -> None:
    """Settle which elements are not part of the article. An element with most of the text of the page's
    articles (of the article it is in; of a page without any) is never left out."""
    for b in found:
        b.element.size += len(b.text)
        if b.element.top is not None:
            b.element.size_named += len(b.text)
    for e in reversed(elements):
        if e.parent is not None:
            e.parent.size += 0 if e.mark == NEVER and not e.size_named else e.size
            e.parent.size_named += e.size_named
    page, named = elements[0], any(e.top is not None for e in elements)
    for e in elements:  # parents first
        up = e.parent
        if up is None:
            continue
        if e.mark and e.top is None and named or e.mark == NEVER:
            most = 0 < page.size_named <= 2 * e.size_named and e.top is None
        else:
            whole = page if e.top is None else e.top
            most = 0 < whole.size <= 2 * e.size
        mark = 0 if most else e.mark
        e.outside = up.outside or mark in (NEVER, WORDED)
        e.form = up.form or mark == FORM


def blocks(page: str) -> tuple[list[Block], list[Element]]:
    """Text blocks of a page in order, and its block elements, parents first."""
    root = Element("", 0, 0, None, None)
    elements, paths = [root], {(-1, ""): 0}
    stack, out, text, links, in_link = [root], [], [], 0, 0
    at, low, n = 0, None, len(page)
    last_close = page.rfind(">")  # beyond it nothing can be a tag
    opened: Counter[str] = Counter()  # open elements by tag, so that a stray end tag need not search

    def close_from(depth: int) -> None:
        for e in stack[depth:]:
            opened[e.tag] -= 1
        del stack[depth:]

    def flush():
        nonlocal links
        if text:
            joined = _SPACE.sub(" ", "".join(text)).strip()
            if joined:
                out.append(Block(stack[-1], joined, links))
            text.clear()
        links = 0

    while at < n:
        if at > last_close:
            text.append(entities.unescape(page[at:].split("<!--", 1)[0]))
            break
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m["tag"]
        if tag is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                plain = entities.unescape(piece)
                text.append(plain)
                links += len(plain) if in_link else 0
            continue
        tag, closing = tag.lower(), bool(m["close"])
        if tag in _RAW and not closing:
            if not m["attrs"].endswith("/") or tag != "svg":
                low = page.lower() if low is None else low
                end = low.find(f"</{tag}", at)
                at = n if end < 0 else (low.find(">", end) + 1 or n)
            continue
        if tag in _INLINE:
            in_link = (in_link + 1 if not closing else max(0, in_link - 1)) if tag == "a" else in_link
            continue
        if tag == "br":
            text.append(" ")
            continue
        flush()
        if closing:
            if opened[tag] > 0:
                close_from(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            in_link = 0
            continue
        if tag in _VOID:
            continue
        if stack[-1].tag == "p":
            close_from(len(stack) - 1)  # a block start ends an open paragraph
        closes = _CLOSES.get(tag, ())
        while closes and stack[-1].tag in closes and len(stack) > 1:
            close_from(len(stack) - 1)
        up, attrs = stack[-1], m["attrs"]
        first = re.search(r"class\s*=\s*[\"']?([\w-]+)", attrs) if attrs else None
        name = tag + (f".{first[1]}" if first else "")
        path = paths.setdefault((up.path, name), len(paths))
        e = Element(tag, path, _mark(tag, attrs, up.top is not None), up.top, up)
        if e.top is None and tag in ("article", "main"):
            e.top = e
        elements.append(e)
        stack.append(e)
        opened[tag] += 1
    flush()
    _exclude(out, elements)
    return out, elements


def _ratios(found: list[Block]) -> dict[int, float]:
    """Fused ratio of every path: characters per block (links apart) times punctuation per block."""
    sums: dict[int, list[float]] = {}
    for b in found:
        s = sums.setdefault(b.element.path, [0, 0, 0])
        s[0] += max(0, len(b.text) - b.links)
        s[1] += len(_PUNCTUATION.findall(b.text))
        s[2] += 1
    return {p: (c / n) * math.sqrt(1 + q / n) for p, (c, q, n) in sums.items()}


def _selected(found: list[Block]) -> set[int]:
    """Paths whose smoothed ratio reaches the page's threshold."""
    ratio = _ratios(found)
    raw = [ratio[b.element.path] for b in found]
    half = len(SMOOTH) // 2
    smooth: dict[int, list[float]] = {}
    for i, b in enumerate(found):
        near = [(SMOOTH[k + half], raw[i + k]) for k in range(-half, half + 1) if 0 <= i + k < len(raw)]
        smooth.setdefault(b.element.path, []).append(sum(w * r for w, r in near) / sum(w for w, _ in near))
    values = {p: sum(v) / len(v) for p, v in smooth.items()}
    mean = sum(raw) / len(raw)
    deviation = math.sqrt(sum((r - mean) ** 2 for r in raw) / len(raw))
    threshold = min(max(mean - deviation, mean / 2), max(values.values()))
    high, lists = {p for p, v in values.items() if v >= threshold}, _link_lists(found)
    # smoothing lifts a list of links beside long text, but does not make it text
    return {p for p in high if p not in lists or ratio[p] >= threshold} or high


def extract(page: str) -> str:
    """Main text of one page."""
    found, elements = blocks(page)
    candidates = [b for b in found if not b.element.outside]
    if not candidates:
        return ""
    paths = _selected(candidates)
    for i, b in enumerate(candidates):
        if b.element.path in paths:
            b.element.first, b.element.last = min(i, b.element.first), i
    for e in elements:  # parents first
        up = e.parent
        e.host = e if up is None or e.tag not in _TEXT else up.host
        e.host.direct = e.host.direct or e.last >= 0
    for e in reversed(elements):
        if e.parent is not None:
            e.parent.first, e.parent.last = min(e.first, e.parent.first), max(e.last, e.parent.last)
    for e in elements:
        e.holder = e if e.last >= 0 or e.parent is None else e.parent.holder
    lists = _link_lists(candidates) - paths
    return "\n".join(
        b.text
        for i, b in enumerate(candidates)
        if b.element.path in paths or b.element.path not in lists and _joins(b, i)
    )


def _link_lists(found: list[Block]) -> set[int]:
    """Paths of several blocks, headings apart, with half of their text or more in links."""
    sums: dict[int, list[int]] = {}
    for b in found:
        if b.element.tag not in _HEADINGS:
            s = sums.setdefault(b.element.path, [0, 0, 0])
            s[0], s[1], s[2] = s[0] + len(b.text), s[1] + b.links, s[2] + 1
    return {p for p, (c, k, n) in sums.items() if n > 1 and 2 * k >= c}


def _joins(b: Block, i: int) -> bool:
    """Whether a block under the threshold belongs to the selected ones around it."""
    e = b.element
    if e.form:
        return False
    host, holder = e.host, e.holder
    if host.direct or host.last >= 0 and host.tag not in _PAGE or holder.top is not None:
        return True
    return b.links * 2 < len(b.text) and (holder.first < i < holder.last or e.tag == "h1")


def extract_pages(pages: DataFrame, *, html: str = "html") -> DataFrame:
    """page_id, url, text of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([extract(t) for t in str_texts(b.column(2))], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), texts], names=["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col(html).cast("string").alias("h"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_pages(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
