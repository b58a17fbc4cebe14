"""HTML extraction by tag-path ratios."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A comment, declaration or tag. An attribute value in quotes may hold ">"; nothing is read twice.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)", re.S)
#: One attribute after the other, values with their names, so what a quoted value holds is no attribute.
ATTRIBUTE = re.compile(r"([^\s=>\"'/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++)))?|\"[^\"]*+\"|'[^']*+'")
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Elements whose text is never part of the article.
OUTSIDE = {*RAW, "head", "nav", "header", "footer", "aside", "form", "menu", "dialog", "template", "button", "select", "option", "svg", "canvas", "object", "audio", "video", "map", "fieldset", "math"}
#: Words in class, id or role that mark what is around an article.
AROUND = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|nav\w*|menu\w*|header|masthead|footer|side-?bar\w*|aside|widget\w*|breadcrumbs?|"
    r"comments?|comment-?\w*|replies|reply|disqus|cookies?|consent|gdpr|notice\w*|alert\w*|popup|modal|overlay|newsletter|subscri\w*|sign-?up|"
    r"kommentare?|commentaires?|comentarios?|werbung|anzeigen?|publicit\w*|publicidad|anuncios?|fu(?:ß|ss)zeile|pied|encabezado|"
    r"share|sharing|social\w*|related|recommend\w*|pagination|pager|toolbar|search\w*|login|complementary|navigation|contentinfo|hidden|copyright|legal|disclaimer|skip\w*)(?=$|[\s_-])",
    re.I,
)
#: Tags that end an open paragraph, and tags that end an open tag of their own kind.
ENDS_P = set("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、]")
#: Neighbours on each side in smoothing; share of the page's largest path score from which a path is content.
REACH, SHARE = 1, 0.36
#: Tags by which a page names its article: evidence for the paths in them, weighed by their share of the text.
ARTICLE = {"article", "main"}
#: Tags whose text belongs to the element around them: lists, tables and quotes, and paragraphs beside them.
PART = set("p ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption".split())
LISTED = set("li dt dd caption td th blockquote pre figcaption".split())
HEADS = {"h1", "h2", "h3", "h4", "h5", "h6"}


@dataclass
class Element:
    tag: str
    outside: int
    article: int
    path: int
    home: int = 0
    named: int = 0


@dataclass
class Block:
    path: int
    outside: int
    article: int
    home: int
    named: int
    parts: list[str] = field(default_factory=list)
    linked: int = 0


class Paths:
    """The tag paths of a page by number: 0 is the empty one, each other has a parent and a tag."""

    def __init__(self) -> None:
        self.of: dict[tuple[int, str], int] = {}
        self.parent, self.tag = [0], [""]

    def below(self, path: int, tag: str) -> int:
        number = self.of.setdefault((path, tag), len(self.tag))
        if number == len(self.tag):
            self.parent.append(path)
            self.tag.append(tag)
        return number

    def listed(self, path: int) -> bool:
        """Whether the path ends in a part of a list, table or quote, or in a paragraph of one."""
        return self.tag[path] in LISTED or self.tag[path] == "p" and self.tag[self.parent[path]] in LISTED

    def text(self, path: int) -> str:
        tags = []
        while path:
            tags.append(self.tag[path])
            path = self.parent[path]
        return "".join("/" + t for t in reversed(tags))


def _outside(tag: str, attributes: str) -> int:
    """0 for a place that may hold the article, 1 if its names say otherwise, 2 if its tag does."""
    if tag in OUTSIDE:
        return 2
    if not attributes or tag in ("html", "body"):
        return 0
    for m in ATTRIBUTE.finditer(attributes):
        name, value = (m[1] or "").lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return 2
        if name in ("class", "id", "role") and AROUND.search(value):
            return 1
    return 0


def blocks(page: str) -> tuple[list[Block], Paths, dict[int, int]]:
    """The text blocks of a page in order, each with its root-to-leaf path of block tags; the paths; named elements.

    Tolerant: paragraphs, list items and table cells end where the next begins,
    inline tags belong to no path, ends without a start count for nothing, and
    what is open at the end is closed there. article is the number of the
    outermost article or main element around a block, 0 without one; home that of
    the nearest element that is no part of a list, table or quote; named that of
    the nearest element whose names mark what is around an article, and the last
    result leads from each such element to the next one around it. Time grows
    with the page: an end tag looks for its start only if one is open.
    """
    out: list[Block] = []
    paths, around = Paths(), {}
    stack = [Element("", 0, 0, 0)]
    open_: dict[str, int] = {}
    links, at, new, count = 0, 0, True, 0

    def text(raw: str) -> None:
        nonlocal new
        if new and not raw.strip():
            return
        top = stack[-1]
        if new:
            out.append(Block(top.path, top.outside, top.article, top.home, top.named))
            new = False
        out[-1].parts.append(raw)
        if links:
            out[-1].linked += len(raw)

    def close(index: int) -> None:
        nonlocal new
        for e in stack[index:]:
            open_[e.tag] -= 1
        del stack[index:]
        new = True

    n = len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if tag in INLINE:
            if tag == "a":
                links = max(0, links + (-1 if m[1] else 1))
            continue
        if tag == "br":
            text(" ") if not new else None
            continue
        if m[1]:
            if open_.get(tag):
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            else:
                new = True
            continue
        if tag in ENDS_P and stack[-1].tag == "p":
            close(len(stack) - 1)
        if tag in CLOSES and any(open_.get(t) for t in CLOSES[tag]):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in SCOPE[tag]:
                    break
                if stack[k].tag in CLOSES[tag]:
                    close(k)
                    break
        new = True
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if (m[3] or "").rstrip().endswith("/") and tag in ("svg", "math"):
            continue
        top = stack[-1]
        count += 1
        mark = _outside(tag, m[3] or "")
        article = top.article or (count if tag in ARTICLE else 0)
        home = top.home if tag in PART else count
        if mark == 1:
            around[count] = top.named
        open_[tag] = open_.get(tag, 0) + 1
        stack.append(Element(tag, max(top.outside, mark), article, paths.below(top.path, tag), home, count if mark == 1 else top.named))
    return out, paths, around


def _own(block: Block, text: str) -> int:
    """Characters of a block outside links."""
    return len(text) - min(len(text), block.linked)


def path_scores(found: list[Block], texts: list[str]) -> dict[int, float]:
    """A score for each tag path: its smoothed text-length ratio times its smoothed punctuation ratio.

    Ratios are per node of the path. They are smoothed over the paths next to
    each other in page order and fused by their geometric mean. A path in
    article or main elements gains by the share of the page's text in them.
    """
    paths: dict[int, list[float]] = {}
    named = {b.path for b in found if b.article}
    gain = sum(_own(b, t) for b, t in zip(found, texts) if b.article) / max(1, sum(map(_own, found, texts)))
    for b, t in zip(found, texts):
        sums = paths.setdefault(b.path, [0.0, 0.0, 0.0])
        sums[0] += 1
        sums[1] += _own(b, t)
        sums[2] += len(PUNCTUATION.findall(t)) if len(t) > b.linked else 0
    raw = np.array([[length / n, marks / n] for n, length, marks in paths.values()]).reshape(-1, 2)
    weights = np.array([[1.0, 1.0]] * len(raw)).reshape(-1, 2)
    smooth = raw.copy()
    for k in range(1, REACH + 1):
        part = 0.25**k
        smooth[k:] += part * raw[:-k]
        weights[k:] += part
        smooth[:-k] += part * raw[k:]
        weights[:-k] += part
    smooth /= weights
    fused = np.sqrt((1 + smooth[:, 0]) * (0.1 + smooth[:, 1])).tolist()
    return {p: s * (1 + gain if p in named else 1) for p, s in zip(paths, fused)}


def _barred(pairs: list[tuple[Block, str]], around: dict[int, int]) -> set[int]:
    """The named elements whose text is left out: all but wrappers, and what is in them.

    A wrapper holds over half of the text outside links. A single block is none
    where the page has an article elsewhere.
    """
    sums = {k: [0, 0] for k in around}
    total = 0
    for b, t in pairs:
        total += _own(b, t)
        if b.named:
            sums[b.named][0] += _own(b, t)
            sums[b.named][1] += 1
    for k in sorted(around, reverse=True):  # inner ones have larger numbers
        if around[k]:
            for i in (0, 1):
                sums[around[k]][i] += sums[k][i]
    article = any(b.article and not b.named for b, _ in pairs)
    out: set[int] = set()
    for k in sorted(around):
        size, n = sums[k]
        if around[k] in out or not (2 * size > total and (n > 1 or not article)):
            out.add(k)
    return out


def extract(page: str, share: float = SHARE) -> str:
    """The main text of a page: content blocks in page order, two line ends between them."""
    found, paths, around = blocks(page)
    texts = [" ".join(html.unescape("".join(b.parts)).split()) for b in found]
    pairs = [(b, t) for b, t in zip(found, texts) if t and b.outside < 2]
    barred = _barred(pairs, around)
    pairs = [(b, t) for b, t in pairs if b.named not in barred]
    if not pairs:  # a wrapper of the whole page bears such a name
        pairs = [(b, t) for b, t in zip(found, texts) if t and b.outside < 2]
    if not pairs:
        return ""
    scores = path_scores([b for b, _ in pairs], [t for _, t in pairs])
    least = share * max(scores.values())
    linked = {}
    for b, t in pairs:
        both = linked.setdefault(b.path, [0, 0])
        both[0] += min(b.linked, len(t))
        both[1] += len(t)
    keep = {p for p, s in scores.items() if s >= least and linked[p][0] <= 0.5 * linked[p][1]}
    # An article or main element that holds most of what was found keeps its other text too: short parts of it score low.
    size = {0: 0}
    for b, t in pairs:
        if b.path in keep:
            size[b.article] = size.get(b.article, 0) + len(t)
    most = max(size, key=size.get)
    whole = most if 2 * size[most] > sum(size.values()) else 0
    # Lists, tables and quotes beside content are content, unless they are mostly links.
    homes = {b.home for b, _ in pairs if b.path in keep}
    beside = {i for i, (b, t) in enumerate(pairs) if b.home in homes and paths.listed(b.path) and 2 * b.linked <= len(t) and 2 * linked[b.path][0] <= linked[b.path][1]}
    # Headings go with the content that follows them: they are short and end without a mark.
    first = next((i for i, (b, _) in enumerate(pairs) if b.path in keep), 0)
    return "\n\n".join(t for i, (b, t) in enumerate(pairs) if b.path in keep or i in beside or whole and b.article == whole or paths.tag[b.path] in HEADS and i + 1 >= first)


def extract_pages(pages: DataFrame, share: float = SHARE) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages.

    Null and empty html give an empty text, and so do pages without content;
    repeated rows each get a row; an empty table gives none; only page_id, url
    and html are read. Markup that is cut off or out of order is read as far as
    it goes.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(cell.as_py() or "", share) for cell in batch.column(2)]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(work, "page_id long, url string, text string, n_chars long")
