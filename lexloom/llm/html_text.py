"""Main text of web pages by tag-path ratios.

A page is a sequence of text nodes, each under a root-to-leaf path of tags. Text length and punctuation are added up per
path and divided by the path's nodes; the two ratios are smoothed along the page and fused. Paths above a
threshold are content, and so are their nodes, but for regions that markup names as something else. Gaps are bridged: what
stands beside content in the same container, or with it in an article, belongs to it, headings and short lines included.
"""

from __future__ import annotations

import html
import re
import sys
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from .common import over_texts, with_columns

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Comments, declarations, elements whose content is no text, tags (one cut off by the page's end, too), and text.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|iframe|svg|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"
    r".*?(?:</\1\s*>|\Z)|<[/!?]?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|<[/!?]?[a-zA-Z][^<>]*\Z|[^<]+|<",
    re.S | re.I,
)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
#: Elements that an opening tag of the same group closes, looked for up to an element of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Elements that never hold the article's text.
OUTSIDE = frozenset("head nav aside footer form button select dialog menu fieldset".split())
#: Words in a class, an id or a role that name such a region.
OUTSIDE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:nav(?:bar|igation)?|menus?|breadcrumbs?|header|masthead|banner|footer|copyright|side-?bars?|aside|"
    r"complementary|contentinfo|ads?|advert\w*|adsense|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alerts?|popup|"
    r"modal|dialog|newsletter|subscri\w+|sign-?up|log-?in|forms?|search|share|sharing|social|comments?|disqus|repl(?:y|ies)|"
    r"discussion|related|recommend\w*|widgets?|tags?|pagination|pager|toolbar|skip)(?=$|[\s_-])",
    re.I,
)
REGIONS = frozenset("article main section div td body html".split())
PUNCTUATION = re.compile(r"[.,;:!?…¡¿、。，！？]")
#: Smoothing radius in text nodes and the share of a standard deviation a node must reach.
SMOOTH_RADIUS = 1
THRESHOLD = 0.5
#: A list outside articles with more of its text than this in links, and several links, is a menu.
LINK_SHARE = 0.6


@dataclass(slots=True)
class Element:
    tag: str
    parent: int
    outside: bool
    path: str
    within: bool


@dataclass(slots=True)
class Node:
    text: str
    element: int
    block: int
    linked: bool


#: What is known of tag tokens; emptied when it holds TOKENS_KEPT.
_tags: dict[str, tuple[str, bool, bool]] = {}
TOKENS_KEPT = 20_000


def _tag(token: str) -> tuple[str, bool, bool]:
    """Name of a tag token in lower case (empty if it is none), whether it closes, whether it names a region outside."""
    if len(_tags) >= TOKENS_KEPT:
        _tags.clear()
    tag = TAG.match(token) if token[-1] == ">" else None
    name = tag[2].lower() if tag else ""
    named = " ".join(next(filter(None, m), "") for m in NAMES.findall(token)) if "=" in token else ""
    outside = bool(named) and name not in ("html", "body", "article", "main") and bool(OUTSIDE_NAMES.search(named))
    found = _tags[token] = (name, bool(tag and tag[1]), outside or name in OUTSIDE)
    return found


def parse(page: str) -> tuple[list[Element], list[Node]]:
    """Elements of a page and its text nodes, but for regions outside the article; unclosed elements end as in a browser."""
    elements = [Element("#", -1, False, "", False)]
    nodes: list[Node] = []
    at, block, links = 0, 0, 0

    def close(index: int) -> None:
        """Leave an element and all inside it."""
        nonlocal at, links
        while at != index:
            links -= elements[at].tag == "a"
            at = elements[at].parent
        links -= elements[at].tag == "a"
        at = elements[at].parent

    def opened(tags: set[str], stop: set[str]) -> int:
        """The innermost open element of ``tags`` inside the innermost one of ``stop``; 0 if none."""
        i = at
        while i and elements[i].tag not in stop:
            if elements[i].tag in tags:
                return i
            i = elements[i].parent
        return 0

    for match in TOKEN.finditer(page):
        token = match[0]
        if token[0] != "<" or len(token) == 1:
            if not elements[at].outside:
                nodes.append(Node(token, at, block, links > 0))
            continue
        if match[1]:
            continue
        name, closing, outside = _tags.get(token) or _tag(token)
        if not name:
            continue
        if name in BLOCKS:
            block += 1
        if name == "br":
            nodes.append(Node("\n", at, block, links > 0))
        if name in VOID:
            continue
        if closing:
            if elements[at].tag == name:
                links -= name == "a"
                at = elements[at].parent
            elif i := opened({name}, {"#"}):
                close(i)
            continue
        if name in BLOCKS and (i := opened({"p"}, {"td", "th", "button"})):
            close(i)
        if name in CLOSES and (i := opened(*CLOSES[name])):
            close(i)
        if token.endswith("/>") and name not in BLOCKS:
            continue
        parent = elements[at]
        path = f"{parent.path}/{name}" if name in BLOCKS or name == "a" else parent.path
        outside = outside or parent.outside or name == "header" and not parent.within
        elements.append(Element(name, at, outside, path, parent.within or name in ("article", "main")))
        at = len(elements) - 1
        links += name == "a"
    return elements, nodes


def path_scores(paths: list[str], lengths: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Smoothed ratios of text length and punctuation of each node's path, fused by their geometric mean.

    Punctuation grows with length, so a plain product would measure length twice and hide short articles behind long ones.
    """
    names, which = np.unique(np.array(paths), return_inverse=True)
    count = np.bincount(which, minlength=len(names))
    text = (np.bincount(which, lengths) / count)[which]
    stops = (np.bincount(which, marks) / count)[which]
    reach = np.arange(-2 * SMOOTH_RADIUS, 2 * SMOOTH_RADIUS + 1)
    kernel = np.exp(-(reach**2) / (2 * SMOOTH_RADIUS**2))
    weight = np.convolve(np.ones(len(text)), kernel, "same")[: len(text)] if len(text) >= len(kernel) else None
    if weight is None:
        return np.sqrt(text * (1 + stops))
    smooth = lambda x: np.convolve(x, kernel, "same") / weight
    return np.sqrt(smooth(text) * (1 + smooth(stops)))


def content_paths(paths: list[str], scores: np.ndarray) -> set[str]:
    """Paths whose mean score is above the threshold, a share of the scores' standard deviation."""
    names, which = np.unique(np.array(paths), return_inverse=True)
    mean = np.bincount(which, scores) / np.bincount(which)
    return set(names[(mean >= THRESHOLD * scores.std()) & (mean > 0)].tolist())


def _places(elements: list[Element]) -> tuple[list[int], list[int], list[int]]:
    """Per element the outermost article or main it lies in, its innermost container and its outermost list; 0 if none."""
    article, container, listed = [0], [0], [0]
    for number, element in enumerate(elements[1:], 1):
        up = element.parent
        article.append(article[up] or (number if element.tag in ("article", "main") else 0))
        container.append(number if element.tag in REGIONS else container[up])
        listed.append(listed[up] or (number if element.tag in ("ul", "ol") else 0))
    return article, container, listed


def main_text(page: str) -> str:
    """The article of a page: blocks in page order, one line each. Empty if the page has no such text."""
    elements, nodes = parse(page)
    for node in nodes:
        if "&" in node.text:
            node.text = html.unescape(node.text)
    real = [n for n in nodes if n.text.strip()]
    if not real:
        return ""
    sizes = np.array([len(n.text.strip()) for n in real])
    marks = np.array([len(PUNCTUATION.findall(n.text)) for n in real])
    linked = np.array([n.linked for n in real])
    paths = [elements[n.element].path for n in real]
    chosen = content_paths(paths, path_scores(paths, sizes * ~linked, marks))
    content = [n for n, path in zip(real, paths) if path in chosen] or [n for n in real if not n.linked]
    article, container, listed = _places(elements)
    menus = _menus(real, article, listed)
    bridged = {article[n.element] for n in content} - {0}
    beside = {container[n.element] for n in content if not article[n.element]}
    own = set(map(id, content))
    lines: list[str] = []
    last, parts = None, []
    for node in [*nodes, Node("", 0, -1, False)]:
        if node.block != last:
            if line := " ".join("".join(parts).split()):
                lines.append(line)
            last, parts = node.block, []
        at = node.element
        if article[at] in bridged or listed[at] not in menus and (id(node) in own or container[at] in beside):
            parts.append(node.text)
    return "\n".join(lines)


def _menus(nodes: list[Node], article: list[int], listed: list[int]) -> set[int]:
    """Lists outside articles whose text is mostly links."""
    total: dict[int, int] = {}
    linked: dict[int, list[int]] = {}
    for node in nodes:
        at = listed[node.element]
        if at and not article[node.element]:
            size = len(node.text.strip())
            total[at] = total.get(at, 0) + size
            if node.linked:
                linked.setdefault(at, []).append(size)
    return {i for i, sizes in linked.items() if len(sizes) > 2 and sum(sizes) > LINK_SHARE * total[i]}


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per row of ``pages`` (page_id, url, html): the article's whole text.

    Character references are decoded, blanks inside a block become one space, blocks are joined by one line end in page
    order. A null or empty html, and a page without an article, give an empty text of 0 characters. Repeated rows each
    come back; ids and urls may be null. Other columns are ignored.
    """

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [main_text(h or "") for h in batch.column("html").to_pylist()]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            return with_columns(batch, ["page_id", "url"], text=pa.array(texts, pa.string()), n_chars=sizes)

        return work

    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", "url", "html")
    return over_texts(rows, "html", make, f"page_id {kind}, url string, text string, n_chars long")
