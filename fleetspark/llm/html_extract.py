"""Main text of web pages by tag-path ratios.

A page is a sequence of text blocks. Each block has a tag path: its block-level elements from the root to the leaf, with
inline elements left out. For each path of a page, the text length and punctuation over all its blocks are summed and
divided by its number of blocks. Paths that differ in parts of a text only (paragraphs, lists, tables, headings) stand in
one container; each path's ratios are smoothed with their means over its container. Text ratio, punctuation ratio and the
root of the container's share of the page's text are fused by their product, and paths above a share of the best one are
content, with all blocks of their containers, however short. A container within another takes half of that one's value if
it has less itself, and an article half of that of the best one in it. What elements and class names say is a factor of a path's value and no more: it moves the balance
between parts of a page, and where it weighs on all of them alike it changes nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from math import sqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is never text of a page.
RAW = "script style noscript template iframe object svg math textarea title select"
#: A quoted value ends where an attribute may; without such an end, the tag ends at the next bracket. Each part is walked once.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(" + RAW.replace(" ", "|") + r")(?=[\s/>])[^>]*+>.*?(?:</\1(?=[\s/>])[^>]*+(?:>|\Z)|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"(?=[\s/>])|'[^']*+'(?=[\s/>]))*+[^>]*+)(?:>|\Z)",
    re.S | re.I,
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that hold no article text, wherever they stand.
AWAY = frozenset("nav header footer aside form menu button dialog fieldset head".split())
MAIN = frozenset("article main".split())
#: Words in class, id or role that mark an element as not of the article.
HINT = re.compile(
    r"(?<![a-z])(?:nav|navbar|navigation|menu|breadcrumbs?|header|footer|foot|masthead|sidebar|side|aside|widget|related|recommended|teasers?|trending|popular"
    r"|ad|ads|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|banner|notice|alert|cookies?|consent|gdpr|newsletter|subscribe|signup|login|modal|popup|overlay"
    r"|comments?|replies|reply|respond|disqus|discussion|share|sharing|social|toolbar|pagination|pager|tags?|search|form|copyright|legal|disclaimer|skip|hidden)(?![a-z])",
    re.I,
)
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Of these words, those that are also topics: as the id of a section within the article they don't mark it.
TOPICS = frozenset("side related popular trending ad ads advertisement advertising promotion notice alert cookies cookie consent gdpr newsletter login discussion sharing social search form copyright legal disclaimer navigation navbar menu header footer tag tags".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLASS_ROLE = re.compile(r"\b(?:class|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Parts of a text, which belong to the container around them.
PARTS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr th td figure figcaption pre blockquote details summary hr address".split())
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
#: Which open elements a start tag closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LIMITS = frozenset("table ul ol dl div section article main body td th blockquote".split())
BREAKS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
PUNCTUATION = re.compile(r"[.,;:!?…、。，；：！？]")
#: A path's fused ratio must reach this share of the best one.
SHARE = 0.06
#: Factors of a path's value: for an element or hidden text that is no article text, for class names that say so, for an
#: article or main element; and what a container within another takes of that one's value.
ASIDE, HINTED, MARKED, WITHIN = 0.001, 0.003, 3.0, 0.5


def _hinted(tag: str, marks: str, attributes: str, inside: bool) -> bool:
    """Whether class, id or role mark an element as not of the article; ids of its headings and topics of its sections don't."""
    if not HINT.search(marks):
        return False
    if tag not in HEADINGS and not (tag == "section" and inside):
        return True
    if HINT.search(" ".join(a or b or c for a, b, c in CLASS_ROLE.findall(attributes))):
        return True
    return tag == "section" and any(w.lower() not in TOPICS for w in HINT.findall(marks))


class Paths:
    """The tag paths of a page, by number; 0 is the page itself. A path's element and marks are its own, the rest its parent's."""

    def __init__(self):
        self.number: dict[tuple[int, str], int] = {}
        self.parent, self.container, self.factor, self.inside, self.off = [0], [0], [1.0], [False], [False]
        self.article = [False]
        self.page = [True]  # paths of containers that are the page or its body: what stands in them isn't one text

    def child(self, parent: int, tag: str, attributes: str) -> int:
        marks = " ".join(a or b or c for a, b, c in ATTRIBUTE.findall(attributes)) if attributes else ""
        hidden = bool(attributes and tag not in ("html", "body") and HIDDEN.search(attributes))
        label = f"{tag}.{'.'.join(sorted(re.sub(r'[0-9]+', '', marks).replace('/', '|').split()))}{'!' * hidden}"
        if (found := self.number.get((parent, label))) is not None:
            return found
        n = self.number[parent, label] = len(self.parent)
        away = tag in AWAY
        hinted = bool(marks) and tag not in ("html", "body") and _hinted(tag, marks, attributes, self.inside[parent])
        self.parent.append(parent)
        self.container.append(self.container[parent] if tag in PARTS else n)
        self.factor.append(self.factor[parent] * (ASIDE if away or hidden else 1) * (HINTED if hinted else 1) * (MARKED if tag in MAIN and not self.inside[parent] else 1))
        self.inside.append(self.inside[parent] or tag in MAIN)
        self.off.append(self.off[parent] or hidden or away and tag != "form")
        self.article.append(self.article[parent] or tag == "article")
        self.page.append(tag in ("html", "body"))
        return n


def blocks(html: str) -> tuple[Paths, list[tuple[int, str, int]]]:
    """The page's paths, and (path, text, characters in links) of each block with text, in page order; white space is made
    plain. Work and memory are in proportion to the page, whatever its depth."""
    paths, out, stack, buffer, linked, at = Paths(), [], [], [], 0, 0  # stack: (tag, path)
    opened: Counter = Counter()

    def flush():
        nonlocal linked
        text = " ".join(unescape("".join(buffer)).split())
        if text:
            out.append((stack[-1][1] if stack else 0, text, min(linked, len(text))))
        buffer.clear()
        linked = 0

    def text(piece):
        nonlocal linked
        if piece:
            buffer.append(piece)
            if opened["a"]:
                linked += len(" ".join(unescape(piece).split()))

    def pop_to(tags, limits):
        if not any(opened[t] for t in tags):
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in tags:
                opened.subtract(x[0] for x in stack[k:])
                del stack[k:]
                return
            if stack[k][0] in limits:
                return

    for m in TOKEN.finditer(html):
        text(html[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                flush()
            continue
        if tag not in INLINE:
            flush()
        if m[2]:
            pop_to({tag}, () if tag in LIMITS or tag in AWAY else LIMITS - {tag})
            continue
        if tag in BREAKS_P:
            pop_to({"p"}, LIMITS)
        if tag in CLOSES:
            pop_to(CLOSES[tag], LIMITS - CLOSES[tag])
        attributes = m[4]
        if attributes and attributes.rstrip().endswith("/") and tag not in INLINE and tag not in BREAKS_P:
            continue
        parent = stack[-1][1] if stack else 0
        stack.append((tag, parent if tag in INLINE and not (attributes and (HIDDEN.search(attributes) or HINT.search(attributes))) else paths.child(parent, tag, attributes)))
        opened[tag] += 1
    text(html[at:])
    flush()
    return paths, out


def values(paths: Paths, found: list[tuple[int, str, int]]) -> dict[int, float]:
    """The smoothed and fused ratio of each path that has blocks."""
    own: dict[int, list[float]] = {}
    for path, text, linked in found:
        s = own.setdefault(path, [0.0, 0.0, 0.0])
        s[0] += len(text) - 0.95 * linked
        s[1] += len(PUNCTUATION.findall(text))
        s[2] += 1
    whole: dict[int, list[float]] = {}
    for path, s in own.items():
        w = whole.setdefault(paths.container[path], [0.0, 0.0, 0.0])
        for k in range(3):
            w[k] += s[k]
    page = sum(w[0] for w in whole.values())
    out = {}
    for path, (chars, marks, n) in own.items():
        w = whole[paths.container[path]]
        length, punctuation = (chars / n + w[0] / w[2]) / 2, 1 + (marks / n + w[1] / w[2]) / 2
        out[path] = length * punctuation * sqrt(w[0] / page) * paths.factor[path]
    return out


def content(paths: Paths, fused: dict[int, float], share: float) -> set[int]:
    """The containers of the paths that reach ``share`` of the best one, by themselves or by what is around them."""
    best: dict[int, float] = {}
    for path, v in fused.items():
        c = paths.container[path]
        best[c] = max(best.get(c, 0.0), v)
    least = share * max(best.values())
    for c in range(len(paths.parent) - 1, 0, -1):  # parents have lesser numbers
        up = paths.container[paths.parent[c]]
        if c in best and paths.article[up]:
            best[up] = max(best.get(up, 0.0), WITHIN * best[c])
    for c in range(1, len(paths.parent)):
        up = paths.container[paths.parent[c]]
        if paths.container[c] == c and up in best and not paths.page[up]:
            best[c] = max(best.get(c, 0.0), WITHIN * best[up] * paths.factor[c] / paths.factor[up])
    return {c for c, v in best.items() if v >= least}


def main_text(html: str | None, share: float = SHARE) -> str:
    """The text of the content paths, blocks joined by a space; empty if there is none, or nothing outside of menus and the like."""
    paths, found = blocks(html) if html else (None, [])
    if all(paths.off[path] for path, _, _ in found):
        return ""
    kept = content(paths, values(paths, found), share)
    return " ".join(text for path, text, _ in found if paths.container[path] in kept)


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), share: float = SHARE) -> DataFrame:
    """``keep``, text and n_chars for each row of ``pages``.

    Null or empty html, and pages without content, give an empty text. Rows aren't merged: equal pages give equal rows.
    Further columns of ``pages`` are ignored. One narrow stage without a shuffle; memory is that of one Arrow batch, and a very
    long page is walked once, so it costs what its length is.
    """
    names = [f"k{i}" for i in range(len(keep))]
    source = pages.select(*(F.col(c).alias(n) for c, n in zip(keep, names)), F.col(html).alias("html"))
    schema = source.drop("html").schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h, share) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(n) for n in names), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"]
            )

    out = source.mapInArrow(run, schema)
    return out.select(*(F.col(n).alias(c) for c, n in zip(keep, names)), "text", "n_chars")
