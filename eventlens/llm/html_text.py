"""Main text of web pages by tag-path ratios.

A page is read as a stream of tags with the usual implied ends (a new paragraph ends the open
one, and so on). Every text node lies on a root-to-leaf tag path. Per path, text length and
punctuation are added up and divided by the path's number of nodes: long, punctuated prose on
a few paths stands out from the many short nodes of menus. The two ratios are fused into one
score, smoothed along the page with a Gaussian, and nodes above a share of the scores' spread
are the *content nodes*. The content region is the deepest element that holds all of
them. All blocks of the region are kept, in page order, but for subtrees that are
boilerplate by their tag, role, class or id, and for untyped blocks whose path scores low.
A class or id, a form, header, fieldset or aside is only a hint: it does not count on a subtree with
more than half of the page's high-scoring text (a wrapper; four fifths if it names
comments), nor if nothing would be left.

Defined cases: null or empty html, or a page without text, gives an empty text; an unclosed
tag at the end is markup; markup in scripts, styles and comments is never read as tags;
repeated rows are read each for itself; an empty table gives an empty result; extra columns
are ignored. Nothing is cut off, however long a page is.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from eventlens.llm.common import columns, small_batches, strings

# HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object select noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
TYPED = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption caption summary".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog button label fieldset".split()) | RAW
HINTED = frozenset("form header fieldset aside".split())  # of these: hints
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay"
    r"|nav|navbar|navigation|menu|breadcrumbs?|pagination|pager|sidebar|side|aside|widget|related|recommend\w*|share|sharing|social"
    r"|subscribe|newsletter|signup|login|search|footer|foot|header|masthead|topbar|toolbar|comments?|replies|reply|respond|disqus|feedback"
    r"|copyright|legal|disclaimer|tags|tagcloud|toc)(?:$|[\s_-]|\d)",
    re.I,
)
HINTED_ROLES = frozenset("banner complementary form".split())
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|replies|reply|respond|disqus|feedback)(?:$|[\s_-]|\d)", re.I)
#: Marks of an element, and the share of the high-scoring text above which one is overruled.
FIXED, HINT_OF_COMMENTS, HINT_OF_NAME = 3, 2, 1
OVERRULED = {FIXED: 1.0, HINT_OF_COMMENTS: 0.8, HINT_OF_NAME: 0.5}
#: Opening one of these ends the nearest open one of the others, unless a container lies between.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"},
}
HOLDS = frozenset("ul ol dl table select body article section div aside nav main form blockquote".split())

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*(?:>|$)|</?[a-zA-Z][^>]*$", re.S)
ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…、。，；：！？]")


def mark(tag: str, attributes: str) -> int:
    """The element's strongest mark as boilerplate, or 0."""
    if tag in BOILERPLATE and tag not in HINTED:
        return FIXED
    found = HINT_OF_NAME if tag in HINTED else 0
    if not attributes or tag in ("body", "html", "article", "main"):
        return found
    for name, *values in ATTR.findall(attributes):
        name, value = name.lower(), next(filter(None, values), "")
        if name in ("class", "id") and HINT.search(value):
            found = max(found, HINT_OF_COMMENTS if COMMENTS.search(value) else HINT_OF_NAME)
        if name == "role" and value.lower() in ROLES:
            found = max(found, HINT_OF_NAME if value.lower() in HINTED_ROLES else FIXED)
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return FIXED
    return found


class Page:
    """Text nodes and blocks of one page.

    nodes: (path, text length, punctuation, block); blocks: [element, texts, innermost marked element
    or 0, tag, whether it goes on from the block before]; marks: mark of each marked element, and the marked
    element around it or 0; elements: parent of each element, in page order, so that a parent comes before its children.
    """

    def __init__(self, source: str) -> None:
        self.paths: dict[tuple[int, str], int] = {}
        self.nodes: list[tuple[int, int, int, int]] = []
        self.blocks: list[list] = []
        self.parents: list[int] = [-1]
        self.tags: list[str] = [""]
        self.marks: dict[int, tuple[int, int]] = {}
        # open elements: (tag, element, path, innermost marked element, innermost block element)
        self.open: list[tuple[str, int, int, int, int]] = [("", 0, 0, 0, 0)]
        self.fresh = True  # the next text starts a block
        self._read(source)

    def _read(self, source: str) -> None:
        at, skip = 0, None
        for m in TOKEN.finditer(source):
            if m.start() < at:
                continue
            if skip is None and m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            tag = m[2] or m[5]
            if not tag:
                continue
            tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] if m[2] else m[6]
            if closing:
                self._close(tag)
            elif tag in RAW and not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(source, at)
                at = end.end() if end else len(source)
            else:
                self._open(tag, attributes)
        if at < len(source):
            self._text(source[at:])

    def _open(self, tag: str, attributes: str) -> None:
        if tag in VOID:
            if tag == "br":
                self._text(" ")
            elif tag == "hr":
                self.fresh = True
            return
        if tag in BLOCK:
            self.fresh = True
            self._end_open({"p"}, HOLDS - {"blockquote"} | {"td", "th", "li"})
        if tag in ENDS:
            self._end_open(ENDS[tag], HOLDS)
        _, parent, path, marked, block = self.open[-1]
        self.parents.append(parent)
        self.tags.append(tag)
        element = len(self.parents) - 1
        path = self.paths.setdefault((path, tag), len(self.paths) + 1)
        if kind := mark(tag, attributes):
            self.marks[element] = kind, marked
            marked = element
        if not attributes.endswith("/") or tag in BLOCK:
            self.open.append((tag, element, path, marked, element if tag in BLOCK else block))

    def _end_open(self, tags: set[str], walls: frozenset[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] in tags:
                del self.open[i:]
                return
            if self.open[i][0] in walls:
                return

    def _close(self, tag: str) -> None:
        if tag in BLOCK:
            self.fresh = True
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return
            if tag not in BLOCK and self.open[i][0] in BLOCK:
                return  # an inline end does not end a block

    def _text(self, raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        plain = text.strip()
        if not plain:
            if text and not self.fresh and self.blocks:
                self.blocks[-1][1].append(" ")
            return
        _, _, path, marked, block = self.open[-1]
        new = self.fresh or not self.blocks or self.blocks[-1][0] != block
        if new or self.blocks[-1][2] != marked:
            self.blocks.append([block, [], marked, self.tags[block], not new])
            self.fresh = False
        self.blocks[-1][1].append(text)
        self.nodes.append((path, len(plain), len(PUNCTUATION.findall(plain)), len(self.blocks) - 1))


def node_scores(nodes: np.ndarray, reach: int = 2) -> np.ndarray:
    """Smoothed score of every text node: the fused ratios of its path."""
    path = nodes[:, 0]
    n = np.bincount(path)[path]
    length = np.bincount(path, weights=nodes[:, 1])[path] / n
    points = np.bincount(path, weights=nodes[:, 2])[path] / n
    score = length * np.log1p(points + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / 1.0) ** 2)
    smooth = np.convolve(score, kernel, "full")[reach : reach + len(score)]
    weight = np.convolve(np.ones(len(score)), kernel, "full")[reach : reach + len(score)]
    return np.minimum(score, smooth / weight) if len(score) > 1 else score


def main_text(source: str, spread: float = 0.5) -> str:
    """The page's main text. spread: threshold in standard deviations."""
    page = Page(source)
    if not page.nodes:
        return ""
    nodes = np.array(page.nodes, np.int64)
    score = node_scores(nodes)
    cut = lambda free: min(spread * float(score.std()), 0.5 * float(score[free].max()))
    owner = np.array([b[2] for b in page.blocks])[nodes[:, 3]]
    fixed, gone = np.zeros(len(page.parents), bool), np.zeros(len(page.parents), bool)
    for e, (kind, outer) in page.marks.items():
        fixed[e] = fixed[outer] or kind == FIXED
    loose = ~fixed[owner]
    if not loose.any():
        return ""
    high = loose & (score >= cut(loose))
    held = np.bincount(owner[high], weights=nodes[high, 1], minlength=len(fixed))
    total = held.sum()
    for e in reversed(page.marks):
        held[page.marks[e][1]] += held[e]
    for e, (kind, outer) in page.marks.items():
        gone[e] = gone[outer] or fixed[e] or held[e] <= OVERRULED[kind] * total
    free = ~gone[owner]
    if not free.any():  # hints alone leave nothing: the ratios decide
        gone, free = fixed, loose
    threshold = cut(free)
    content = free & (score >= threshold)
    # the deepest element that holds all content nodes
    parents = np.array(page.parents)
    holds = np.bincount(np.array([b[0] for b in page.blocks])[nodes[content, 3]], minlength=len(parents))
    for e in range(len(parents) - 1, 0, -1):
        holds[parents[e]] += holds[e]
    # a later element never holds an earlier one; several that hold all lie in one line
    region = int(np.flatnonzero(holds == holds[0])[-1])
    while page.tags[region] in TYPED and region:  # one long paragraph: its surroundings belong to it
        region = int(parents[region])
    inside = np.zeros(len(parents), bool)
    inside[region] = True
    for e in range(region + 1, len(parents)):
        inside[e] = inside[parents[e]]
    best = np.zeros(len(page.blocks))
    np.maximum.at(best, nodes[:, 3], score)
    out, last = [], -2
    for i, (element, texts, marked, tag, goes_on) in enumerate(page.blocks):
        if not gone[marked] and inside[element] and (tag in TYPED or best[i] >= threshold or element == region):
            if goes_on and last == i - 1:
                out[-1] += "".join(texts)
            else:
                out.append("".join(texts))
            last = i
    return "\n".join(filter(None, (" ".join(x.split()) for x in out)))


TEXTS = "page_id long, url string, text string, n_chars long"
_TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in small_batches(whole, "html"):
            texts = [main_text(x) for x in strings(batch, "html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                schema=_TEXTS,
            )


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points)."""
    return columns(pages, page_id=id_col, url=url_col, html=html_col).mapInArrow(extracted, TEXTS)
