"""Main text of web pages by tree scoring.

A page is read into a tree with HTML's usual forgiveness: void elements, end tags left out, stray ones. Scripts,
styles, navigation, headers, footers, form controls and what is named like advertisement or boilerplate don't count.
A form is a container like others if it holds a paragraph that scores; else it doesn't count, unless the page has no
other text. Each
block with text of its own is a paragraph; if it is long enough it passes points to its ancestors, for itself, its
commas and its length, whole to the parent, half to the grandparent, and less above. A container's own kind and
names add or take some, and the sum is discounted by the share of its text that stands in links. The best
container is kept, with those of its siblings that score well or read like prose.
"""

from __future__ import annotations

import html as html_
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.llm.text import slices
from tabweave.session import ship

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg|math|object|textarea|select)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*+>|\Z)|<[!?][^>]*+>?|</([a-z][^\s>/]*+)[^>]*+>|<([a-z][^\s>/]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>",
    re.S | re.I)
CAPTIONS = frozenset("label legend option optgroup output".split())  # of controls, in forms
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
JUNK = frozenset("nav aside footer header button menu dialog figure head".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "body": ("head",)}
SCOPE = frozenset("table td th ul ol dl body html article section main div".split())
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
BAD_NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|combx|comments?|cookies?|disqus|footer|header|legal|masthead|menu|meta|modal|nav\w*|pag(?:er|ination)|popup|promo\w*|related|remark|rss|share\w*|shoutbox|sidebar|skyscraper|social|sponsor\w*|subscribe|tags?|toolbar|widget)(?:$|[\s_-])", re.I)
GOOD_NAMES = re.compile(r"article|body|content|entry|hentry|main|page|post|text|blog|story", re.I)
BASE = {"article": 8, "main": 8, "div": 5, "section": 5, "pre": 3, "td": 3, "blockquote": 3, "ol": -3, "ul": -3, "dl": -3, "dd": -3, "dt": -3, "li": -3, "address": -3, "h1": -5, "h2": -5, "h3": -5, "h4": -5, "h5": -5, "h6": -5, "th": -5}
LEAST, LEVELS, NAMED = 25, 5, 25
_WS = re.compile(r"\s+")


class Page:
    """Elements by number, in document order: parents come before children."""

    def __init__(self, source: str):
        self.tag, self.parent, self.junk, self.good = ["#root"], [-1], [False], [False]
        self.pieces: list[tuple[int, str]] = []  # (element, text); "\n" for a line break
        self.title = ""
        stack, open_ = [0], {"#root": 1}
        at = 0
        for m in TOKEN.finditer(source):
            if m.start() > at:
                self._text(stack[-1], source[at : m.start()])
            at = m.end()
            if m[3]:
                self._start(m[3].lower(), m[4], stack, open_)
            elif m[2]:
                self._end(m[2].lower(), stack, open_)
        if at < len(source):
            self._text(stack[-1], source[at:])

    def _text(self, element: int, text: str) -> None:
        if text.isspace() and "\n" not in text and not self.pieces:
            return
        text = html_.unescape(text) if "&" in text else text
        if self.tag[element] == "title":
            self.title = self.title or _WS.sub(" ", text).strip()
        else:
            self.pieces.append((element, _WS.sub(" ", text)))

    def _pop(self, stack: list[int], open_: dict[str, int], to: int) -> None:
        while len(stack) > to:
            open_[self.tag[stack.pop()]] -= 1

    def _start(self, tag: str, attributes: str, stack: list[int], open_: dict[str, int]) -> None:
        if tag == "br":
            self.pieces.append((stack[-1], "\n"))
            return
        for closed, scope in ((SELF_CLOSING.get(tag, ()), True), (("p",) if tag in CLOSES_P else (), False)):
            if any(open_.get(c) for c in closed):
                for k in range(len(stack) - 1, 0, -1):
                    name = self.tag[stack[k]]
                    if name in closed:
                        self._pop(stack, open_, k)
                        if tag not in ("tr", "tbody"):
                            break
                    elif name in SCOPE and not (tag in ("tr", "tbody") and name in ("td", "th")):
                        break
        if tag in VOID:
            return
        parent = stack[-1]
        names = " ".join(x for m in ATTRIBUTE.findall(attributes) for x in m if x) if attributes and "=" in attributes else ""
        self.tag.append(tag)
        self.parent.append(parent)
        self.junk.append(self.junk[parent] or tag in JUNK or bool(names and tag not in ("html", "body", "article", "main") and BAD_NAMES.search(names)))
        self.good.append(bool(names and GOOD_NAMES.search(names)))
        if not attributes.endswith("/") or tag in INLINE or tag in CLOSES_P:
            stack.append(len(self.tag) - 1)
            open_[tag] = open_.get(tag, 0) + 1

    def _end(self, tag: str, stack: list[int], open_: dict[str, int]) -> None:
        if open_.get(tag):
            k = len(stack) - 1
            while self.tag[stack[k]] != tag:
                k -= 1
            if k:
                self._pop(stack, open_, k)


def without_forms(page: Page, block: list[int], link: list[bool]) -> list[bool]:
    """What doesn't count, with the captions of controls and the forms without a paragraph that scores, or without the forms if nothing would be left."""
    n = len(page.tag)
    form, junk = [0] * n, list(page.junk)  # the form around each
    for i in range(1, n):
        form[i] = i if page.tag[i] == "form" else form[page.parent[i]]
        junk[i] = junk[i] or junk[page.parent[i]] or bool(form[i] and page.tag[i] in CAPTIONS)
    prose: dict[int, int] = {}
    for i, text in page.pieces:
        if not junk[i] and not link[i]:
            prose[block[i]] = prose.get(block[i], 0) + len(text.strip())
    alive = {0}
    for b, size in prose.items():
        while size >= LEAST and (b := form[b]) not in alive:
            alive.add(b)
            b = page.parent[b]
    out = [junk[i] or form[i] not in alive for i in range(n)]
    return out if any(not out[i] and text.strip() for i, text in page.pieces) else page.junk


def extract(source: str | None) -> tuple[str, str, int, float] | None:
    """(title, text, paragraphs, score of the best container) of a page."""
    if source is None:
        return None
    page = Page(source)
    n = len(page.tag)
    tag, parent, junk = page.tag, page.parent, page.junk
    block, link = [0] * n, [False] * n
    for i in range(1, n):
        block[i] = block[parent[i]] if tag[i] in INLINE else i
        link[i] = tag[i] == "a" or (link[parent[i]] and tag[i] in INLINE)
    if "form" in tag:
        junk = without_forms(page, block, link)
    own: dict[int, list[str]] = {}
    length, linked = [0] * n, [0] * n
    for i, text in page.pieces:
        if not junk[i] and (size := len(text.strip())):
            own.setdefault(block[i], []).append(text)
            length[i] += size
            linked[i] += size * link[i]
    for i in range(n - 1, 0, -1):
        length[parent[i]] += length[i]
        linked[parent[i]] += linked[i]
    points: dict[int, float] = {}
    for b, texts in own.items():
        text = "".join(texts).strip()
        if b and len(text) >= LEAST:
            gain, up, level = 1 + text.count(",") + text.count("，") + text.count("、") + min(len(text) / 100, 3.0), parent[b], 1
            while up >= 0 and level <= LEVELS:
                if up not in points:
                    points[up] = BASE.get(tag[up], 0) + NAMED * page.good[up]
                points[up] += gain / (1 if level == 1 else 2 if level == 2 else 3 * (level - 1))
                up, level = parent[up], level + 1
    density = lambda i: linked[i] / length[i] if length[i] else 0.0
    score = {i: p * (1 - density(i)) for i, p in points.items() if not junk[i]}
    if score:
        best = max(score, key=lambda i: (score[i], -i))
        top = score[best]
        chosen = {best}
        if best:
            for i in range(1, n):
                if parent[i] == parent[best] and i != best and not junk[i]:
                    text = "".join(own.get(i, ())).strip() if tag[i] == "p" else ""
                    if score.get(i, -1.0) >= max(10.0, 0.2 * top) or (len(text) > 80 and density(i) < 0.25) or (text and len(text) <= 80 and not linked[i] and text[-1] in ".!?"):
                        chosen.add(i)
    else:
        best, top, chosen = 0, 0.0, {0}
    keep = [False] * n
    for i in range(n):
        keep[i] = i in chosen or (i > 0 and keep[parent[i]])
    out: list[str] = []
    last = -1
    for i, text in page.pieces:
        if keep[i] and not junk[i]:
            out.append("\n" + text if block[i] != last and out else text)
            last = block[i]
    lines = [line for x in "".join(out).split("\n") if (line := _WS.sub(" ", x).strip())]
    return page.title, "\n".join(lines), len(lines), round(top, 4)


def extract_pages(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, title, text, n_paragraphs, score) of each page of ``df``.

    A null page has nulls throughout; an empty one, or one without text, has empty strings, 0 paragraphs and score
    0. Without a paragraph of at least 25 characters all text that isn't boilerplate is kept. Equal scores: the
    container that begins first. Null and repeated ids: each row is extracted by itself. Empty table: no rows.
    Long pages are read whole; other columns are not read, so they can't clash.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(1)):
                got = [extract(x) for x in b.column(1).slice(lo, hi - lo).to_pylist()]
                kinds = (pa.string(), pa.string(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo)] + [pa.array([None if g is None else g[k] for g in got], t) for k, t in enumerate(kinds)],
                    names=["id", "title", "text", "n_paragraphs", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).mapInArrow(run, f"id {kind}, title string, text string, n_paragraphs int, score double").withColumnRenamed("id", id_col)
