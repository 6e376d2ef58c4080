"""Main text of web pages by tag-path ratios.

A page is read once into text nodes, each with its root-to-leaf path of tags. Per path the text
length outside links and the punctuation are added up and divided by the number of nodes: content
paths carry long, punctuated text, menus and notices many short bits. Both ratios are laid out
in page order, smoothed with a Gaussian window, fused by multiplication, averaged again per path,
and paths of at least one standard deviation (the best path always) are content paths. The
main element is the article or main that holds nearly all text of content paths or, without one, the
lowest element that holds all of it. Its blocks are the result; without an article or main, blocks of
links alone before its first and after its last block of a content path or heading are none of it.

Menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments
are known by their tags, or by a class, id or role of a block that says so as a whole name: each part of
the name must be such a word or one that goes with it, as in ``site-footer``, so ``section-header``
or ``side-by-side`` says nothing. Names that a layout also uses (``widget``, ``banner``) are overruled by
text on a content path inside. Names of headings, lines and code are not judged. Hidden elements and
formulas are text like any other.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Share of the content paths' text that an article or main has to hold.
HOLDS = 0.8
#: Standard deviation of the smoothing window, in nodes.
SIGMA = 1.0

_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*+)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡]")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes svg".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr img br svg "
    "math mi mn mo ms mtext mrow mfrac msqrt mroot msup msub msubsup mover munder munderover mtable mtr "
    "mtd mspace mpadded mphantom mstyle menclose semantics annotation annotation-xml".split()
)
#: Never text. A ``header`` is one outside of articles and mains only; an annotation is a formula again.
_BOILERPLATE = frozenset(
    "head nav footer aside form fieldset legend label datalist output option script style noscript "
    "template iframe button select textarea menu dialog object svg title input annotation annotation-xml".split()
)
#: Elements that a new element of the same group ends.
_ENDS = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"),
    "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"),
}
#: Words that say what a block is, those that a layout may bear as well, and words beside them.
_STRONG = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies "
    "consent gdpr notice notices popup newsletter subscribe subscription signup comment comments disqus replies "
    "respond related recommended sidebar breadcrumb breadcrumbs pagination pager footer contentinfo nav navbar "
    "navigation share sharing".split()
)
_WEAK = frozenset(
    "banner alert modal overlay menu side aside header masthead login search social widget widgets toolbar "
    "skip complementary dialog".split()
)
_BESIDE = frozenset(
    "site main page top bottom left right global primary secondary container wrapper wrap box block area list "
    "bar slot unit inner outer item items button buttons link links posts stories articles more form".split()
)
_MORE = re.compile(r"(?:more|related|recommended|popular|trending|latest)[-_](?:stories|posts|articles|news|links)")
#: Comments and other articles, which may be longer than the article.
_BESIDES = re.compile(r"(?:^|[\s_-])(?:comments?|disqus|replies|respond|related|recommended)(?=$|[\s_-])", re.IGNORECASE)
_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


#: Elements that an open paragraph inside them does not reach out of.
_P_STOPS = frozenset("table td th button object article section div main body".split())


_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


#: Groups of tags that end each other, by the tags that they don't reach out of.
_SCOPES = {"p": _P_STOPS} | {names: frozenset(stops.split()) for names, stops in _ENDS.values()}


class _Element:
    __slots__ = ("tag", "parent", "path", "depth", "never", "sign", "weak", "skipped", "link", "heading", "size", "inside", "scopes")

    def __init__(self, tag: str, parent: _Element | None, path: int, never: bool, signs: list[str]):
        self.tag, self.parent, self.path = tag, parent, path
        self.depth = parent.depth + 1 if parent else 0
        # Never text, with all inside it; or only by the names it bears, which a layout may bear too.
        self.never = never or bool(parent and parent.never)
        self.sign = " ".join(signs)
        self.weak = bool(signs) and not any(_MORE.fullmatch(x.lower()) or _STRONG & {*_parts(x)} for x in signs)
        self.skipped = self.never or bool(signs) or bool(parent and parent.skipped)
        self.link = tag == "a" or bool(parent and parent.link)
        self.heading = tag if tag in _HEADINGS else parent.heading if parent else ""
        self.size = 0
        self.inside = tag in ("article", "main") or bool(parent and parent.inside)
        # The innermost open element of each group in reach, shared with the parent where alike.
        self.scopes: dict[str, _Element] = parent.scopes if parent else {}
        for names, stops in _SCOPES.items():
            if tag in names.split():
                self.scopes = self.scopes | {names: self}
            elif tag in stops and names in self.scopes:
                self.scopes = {k: v for k, v in self.scopes.items() if k != names}


def _parts(name: str) -> list[str]:
    return [w for w in re.split(r"[-_]+", _CAMEL.sub("-", name).lower()) if w]


def _is_sign(name: str) -> bool:
    words = _parts(name)
    said = any(w in _STRONG or w in _WEAK for w in words)
    return bool(_MORE.fullmatch(name.lower())) or (said and all(w in _STRONG or w in _WEAK or w in _BESIDE for w in words))


def _boilerplate(tag: str, attributes: str, parent: _Element) -> tuple[bool, list[str]]:
    """Whether an element is boilerplate by its tag, and those of its names that say that it is."""
    if tag in _BOILERPLATE or (tag == "header" and not parent.inside):
        return True, []
    if tag in ("html", "body", "article", "main", "pre", "header") or tag in _INLINE or tag in _HEADINGS or not attributes.strip():
        return False, []
    found = {}
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), a or b or c)
    names = " ".join(found.get(k, "") for k in ("class", "id", "role")).split()
    signs = [n for n in names if _is_sign(n)]
    if parent.inside:
        # An article has a headline of its own.
        signs = [n for n in signs if not {"header", "masthead"} & set(_parts(n))]
    if tag == "p":
        signs = [n for n in signs if n.lower() in _STRONG]
    return False, signs


class _Page:
    """Text nodes (element, text, block number) of a page, in order."""

    def __init__(self, source: str):
        self.top = self.root = _Element("", None, 0, False, [])
        self.elements = [self.root]
        # Open elements by tag, so that an end tag that ends none costs nothing.
        self.open: dict[str, int] = {}
        # A path is numbered by its parent's number and its last tag; a page may nest very deep.
        self.paths: dict[tuple[int, str], int] = {}
        self.nodes: list[tuple[_Element, str, int]] = []
        self.block = 0
        self._read(source)

    def _text(self, text: str) -> None:
        if text:
            self.nodes.append((self.top, references.unescape(text) if "&" in text else text, self.block))

    def _leave(self, element: _Element) -> None:
        """End an open element, with what is open in it."""
        while self.top is not element.parent:
            self.open[self.top.tag] -= 1
            self.top = self.top.parent

    def _close(self, tag: str) -> None:
        """End the innermost open element of a tag, if there is one."""
        if self.open.get(tag):
            at = self.top
            while at.tag != tag:
                at = at.parent
            self._leave(at)

    def _open(self, tag: str, attributes: str) -> None:
        if tag not in _INLINE:
            self.block += 1
            if "p" in self.top.scopes:
                self._leave(self.top.scopes["p"])
        if tag in _ENDS and _ENDS[tag][0] in self.top.scopes:
            self._leave(self.top.scopes[_ENDS[tag][0]])
        if tag == "br":
            self.nodes.append((self.top, " ", self.block))
        if tag in _VOID:
            return
        path = self.paths.setdefault((self.top.path, tag), len(self.paths) + 1)
        self.top = _Element(tag, self.top, path, *_boilerplate(tag, attributes, self.top))
        self.open[tag] = self.open.get(tag, 0) + 1
        self.elements.append(self.top)

    def _read(self, s: str) -> None:
        at, n = 0, len(s)
        while at < n:
            lt = s.find("<", at)
            if lt < 0:
                self._text(s[at:])
                return
            if lt > at:
                self._text(s[at:lt])
            after = s[lt + 1 : lt + 2]
            if s.startswith("<!--", lt):
                end = s.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            elif after in ("!", "?") or (after == "/" and s[lt + 2 : lt + 3] not in _LETTERS):
                end = s.find(">", lt)
                at = n if end < 0 else end + 1
            elif after == "/" or after in _LETTERS:
                at = self._tag(s, lt)
            else:
                self._text("<")
                at = lt + 1

    def _tag(self, s: str, lt: int) -> int:
        m = _TAG.match(s, lt)
        if m is None:
            # An open quote: the tag ends at the next bracket, or nothing follows.
            end = s.find(">", lt)
            if end < 0:
                return len(s)
            m = re.match(r"</?([a-zA-Z][^\s/>\"']*)", s[lt:end])
            name, rest, stop = m[1].lower(), "", end + 1
        else:
            name, rest, stop = m[1].lower(), m[2], m.end()
        if s[lt + 1] == "/":
            if name not in _INLINE:
                self.block += 1
            self._close(name)
            return stop
        if name in _RAW:
            if not rest.rstrip().endswith("/"):
                ended = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(s, stop)
                stop = ended.end() if ended else len(s)
            if name not in _INLINE:
                self.block += 1
            return stop
        self._open(name, rest)
        return stop


def _smooth(values: np.ndarray) -> np.ndarray:
    reach = int(3 * SIGMA)
    window = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    padded = np.pad(values, reach, mode="edge")
    return np.convolve(padded, window / window.sum(), mode="valid")


def content_paths(nodes: list[tuple[int, int, int]]) -> set[int]:
    """The content paths among (path, text length, punctuation) of text nodes in page order."""
    if not nodes:
        return set()
    number = {}
    index = np.array([number.setdefault(path, len(number)) for path, _, _ in nodes])
    count = np.bincount(index)
    text = np.bincount(index, weights=[n for _, n, _ in nodes]) / count
    punctuation = np.bincount(index, weights=[p for _, _, p in nodes]) / count
    fused = _smooth(text[index]) * (1 + _smooth(punctuation[index]))
    score = np.bincount(index, weights=fused) / count
    # Smoothing lends neighbours' weight to a path without text of its own; it must not lift it.
    score = np.where(text > 0, score, 0.0)
    least = min(float(score.std()), float(score.max()))
    return {path for path, k in number.items() if score[k] >= least and score[k] > 0}


def _doubted(elements: list[_Element], nodes: list[tuple[_Element, str, int]]) -> tuple[list, set[int]]:
    """Statistics of the text nodes, and their content paths; weak names are judged by these.

    Text under weak names counts like any other at first. An element of such a name that holds text of a
    content path is none of what its name says; the others are skipped, with all inside.
    """
    strong = {id(elements[0]): False}
    for e in elements[1:]:
        strong[id(e)] = strong[id(e.parent)] or e.never or (bool(e.sign) and not e.weak)
    stats = []
    for element, text, _ in nodes:
        own = 0 if element.link or strong[id(element)] else len(" ".join(text.split()))
        stats.append((element.path, own, len(_PUNCTUATION.findall(text)) if own else 0))
    chosen = content_paths(stats)
    holds: set[int] = set()
    for (element, _, _), (path, own, _) in zip(nodes, stats, strict=True):
        while own and path in chosen and element is not None and id(element) not in holds:
            holds.add(id(element))
            element = element.parent
    for e in elements[1:]:
        if e.weak and id(e) in holds:
            e.sign, e.weak = "", False
        e.skipped = e.never or bool(e.sign) or e.parent.skipped
    return stats, chosen


def main_text(source: str | None) -> str:
    """The blocks of the main text, white space inside a block as one space, two line feeds between."""
    page = _Page(source or "")
    nodes = [n for n in page.nodes if n[1] and not n[1].isspace()]
    _clear_layout(page.elements, nodes)
    stats, chosen = _doubted(page.elements, nodes)
    total = 0
    for (element, _, _), (path, size, _) in zip(nodes, stats, strict=True):
        if path in chosen and not element.skipped:
            total += size
            element.size += size
    if not total:
        return ""
    for e in reversed(page.elements[1:]):
        e.parent.size += e.size
    # The lowest element with most of the content: from any content node the one farthest down.
    # Only an article or main around it says that the rest is no part of it; else it holds all.
    main = _lowest(nodes, stats, chosen, HOLDS * total) or page.root
    if not any(a.tag in ("article", "main") for a in _ancestors(main)):
        main = _lowest(nodes, stats, chosen, total) or page.root
    main = _whole_article(main, [n[0] for n in nodes])
    within = {id(page.root): main is page.root}
    for e in page.elements[1:]:
        within[id(e)] = e is main or within[id(e.parent)]
    blocks: dict[int, list[tuple[_Element, str]]] = {}
    for element, text, block in page.nodes:
        if not element.skipped and within[id(element)]:
            blocks.setdefault(block, []).append((element, text))
    joined = []
    for parts in blocks.values():
        if text := " ".join("".join(t for _, t in parts).split()):
            own = [e for e, t in parts if t.strip()]
            joined.append((text, all(e.link for e in own), any(e.heading or e.path in chosen for e in own)))
    if not main.inside:
        # Menus before and lists of other pages after, where no article or main sets them apart.
        while joined and joined[0][1] and not joined[0][2]:
            del joined[0]
        while joined and joined[-1][1] and not joined[-1][2]:
            del joined[-1]
    return "\n\n".join(b[0] for b in joined)


def _clear_layout(elements: list[_Element], nodes: list[tuple[_Element, str, int]]) -> None:
    """Take back the signs of elements around every article and main, or around most of the text.

    From the outside in, so that signed parts of the article stay signed. Elements are in page order.
    """
    if not any(e.sign and not e.never for e in elements):
        return
    size = dict.fromkeys(map(id, elements), 0)
    besides = {id(elements[0]): False}
    for e in elements[1:]:
        besides[id(e)] = besides[id(e.parent)] or bool(_BESIDES.search(e.sign))
    stats = []
    for element, text, _ in nodes:
        own = 0 if element.link or element.never or besides[id(element)] else len(" ".join(text.split()))
        stats.append((element.path, own, len(_PUNCTUATION.findall(text)) if own else 0))
    chosen = content_paths(stats)
    for (element, _, _), (path, own, _) in zip(nodes, stats, strict=True):
        size[id(element)] += own if path in chosen else 0
    # Articles in an element, and those no signed element in it holds; on pages with a main, mains.
    tag = "main" if any(e.tag == "main" and not e.never for e in elements) else "article"
    articles = {id(e): int(e.tag == tag and not e.never) for e in elements}
    clear = dict(articles)
    for e in reversed(elements[1:]):
        size[id(e.parent)] += size[id(e)]
        articles[id(e.parent)] += articles[id(e)]
        clear[id(e.parent)] += 0 if e.sign else clear[id(e)]
    total = size[id(elements[0])]
    lost = {id(elements[0]): not clear[id(elements[0])]}
    for e in elements[1:]:
        lost[id(e)] = lost[id(e.parent)]
        if e.sign and not e.parent.skipped:
            if _BESIDES.search(e.sign):
                around = not total and not besides[id(e.parent)]
            else:
                around = 2 * size[id(e)] > total or (lost[id(e)] and articles[id(e)])
            if around:
                e.sign = ""
                lost[id(e)] = not clear[id(e)]
        e.skipped = e.never or bool(e.sign) or e.parent.skipped


def _lowest(nodes: list, stats: list, chosen: set[int], least: float) -> _Element | None:
    """The element farthest down, no part of a line or paragraph, with ``least`` of the content paths' text."""
    lowest, seen = None, set()
    for (element, _, _), (path, _, _) in zip(nodes, stats, strict=True):
        at = element if path in chosen else None
        while at is not None and id(at) not in seen and (at.tag in _INLINE or at.tag == "p" or at.size < least):
            seen.add(id(at))
            at = at.parent
        if at is not None and id(at) not in seen and (lowest is None or at.depth > lowest.depth):
            lowest = at
    return lowest


def _whole_article(main: _Element, texts: list[_Element]) -> _Element:
    """The article that ``main`` is the body of, so that its headline and shorter parts stay.

    Without such an element, the lowest one below the page's body that holds a first-level heading.
    """
    around = list(_ancestors(main))
    for a in around:
        if a.tag == "article":
            return a
    for a in around:
        if a.tag == "main":
            return a
    above: set[int] = set()
    for e in texts:
        if e.heading == "h1" and not e.skipped:
            for a in _ancestors(e):
                if id(a) in above:
                    break
                above.add(id(a))
    for a in around:
        if a.tag in ("body", "html", ""):
            break
        if id(a) in above:
            return a
    return main


def _ancestors(element: _Element | None) -> Iterator[_Element]:
    while element is not None:
        yield element
        element = element.parent


@F.pandas_udf(StringType())
def _main_texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([main_text(s) for s in batch], dtype=object)


def main_text_column(html: str = "html") -> Column:
    """The main text of a column of pages; empty for null, empty or textless pages."""
    return _main_texts(F.col(html))


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``text``, the main text, and ``n_chars``; they replace columns so named."""
    kept = [F.col(c) for c in pages.columns if c not in ("text", "n_chars")]
    return pages.select(*kept, main_text_column(html).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
