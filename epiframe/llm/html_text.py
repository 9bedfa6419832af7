"""Main text of HTML pages by tag-path ratios.

A tolerant scanner turns a page into blocks of text.  A block's path is the
root-to-leaf sequence of its block elements (tags with their classes); paths and
elements are numbered and know their parent, so memory is linear in the page
however deep it nests.

1. For each path the length and the punctuation of the text without links are
   added up over its blocks; a block's features are its path's length and
   punctuation per block.
2. Both are smoothed over the page order with a Gaussian and scaled.
3. They are fused by their geometric mean, averaged by path, and weighed by what
   the path's names say: more inside ``article`` or ``main``, less inside a form or an
   element whose class or id says that it is an advert, a comment, a sidebar, ...
   (less again if that is all that the name says).  Names only weigh: the page's
   best path is content whatever it is called, as layout wrappers and articles
   have such names too ("content-sidebar-wrap", "share-price").
4. Paths at or above ``THRESHOLD`` of the best are content.

The region is the innermost element with ``REGION`` of the content, or the article or
main element around that.  Blocks of other paths in it (headings, list items, tables)
join unless names below the region weigh against them or, outside an article, links
fill them; if the region is the body, those that stand between content, and headings
before it.

Elements are skipped where HTML itself says that they hold no article text: what is
not shown (head, script, style, template, hidden, ...), form controls, and sections
that are navigation, header (outside an article), footer or aside, by tag or role.
Character references are decoded, white space inside a block becomes one space,
blocks are joined in page order by one space.

Null or empty html gives the empty string; html without tags is one block.
Unclosed and misnested tags are closed as browsers do for head, p, li, td and the
like; a tag cut off at the end is dropped.  Pages are independent rows: there
is no shuffle, and memory is that of the page at hand.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epiframe.llm.staging import Carried, map_arrow

THRESHOLD = 0.35
SMOOTH = 0.6
LINKS = 0.5
REGION = 0.7
#: Weights of names along a path.
ARTICLE, SAID, HINTED, FORM = 6.0, 0.1, 0.6, 0.1
#: Share of the punctuation feature that a path without punctuation has.
PLAIN = 0.05

SKIP_TAGS = frozenset("head title button select option optgroup textarea script style noscript iframe template svg object canvas audio video map datalist nav footer aside menu dialog".split())
HEAD_TAGS = frozenset("head title base link meta style script noscript template".split())
RAW_TAGS = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE_TAGS = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr img".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAF_TAGS = HEADINGS | frozenset("p li dt dd td th caption figcaption pre".split())
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form toolbar".split())
#: Words of a class or id that weigh against its element.
AGAINST = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner nav navbar navigation menu sidebar sidenav rail footer masthead breadcrumb breadcrumbs "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments commentlist disqus respond replies "
    "related recommended recommendations pagination pager widget widgets toolbar skip copyright disclaimer outbrain taboola header topbar siteheader".split()
)
#: Words that add nothing to a name: one of only these and words against is all against.
NEUTRAL = frozenset("top bottom left right main site page global area list section box slot block container wrap wrapper inner outer body item items row col panel bar text title form thread js is the a".split())
#: An opening tag of the first kind closes an open element of the second, up to the nearest of the third.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
P_SCOPE = frozenset("html body table td th caption button object div section article main aside nav footer header blockquote li dd".split())

_TAG = re.compile(r"<!--(?:.*?-->|.*)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<[/A-Za-z][^>]*\Z|[^<]+|<", re.S)
_ATTR = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_PUNCT = re.compile(r"[.,;:!?…。，、；：！？]")


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape((m[2] or "").strip("\"'")) for m in _ATTR.finditer(text)}


def _skipped(tag: str, attrs: dict[str, str], inside_article: bool) -> bool:
    if tag in SKIP_TAGS or tag == "header" and not inside_article:
        return True
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    return attrs.get("role", "").lower() in SKIP_ROLES


def _weight(tag: str, attrs: dict[str, str]) -> float:
    """How far an element's name speaks for its text."""
    if tag == "form":
        return FORM
    if not attrs or tag in ("html", "body", "article", "main"):
        return 1.0
    weight = 1.0
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        words = {w.lower() for w in _WORD.findall(name)}
        if not AGAINST.isdisjoint(words):
            weight = min(weight, SAID if words <= AGAINST | NEUTRAL else HINTED)
    return weight


class Page:
    """Paths, elements and blocks of a page.

    ``paths``: parent path, weight of the names on it, tag of its last element.  ``elements``: parent element, tag, weight.
    ``blocks``: path, element, text, characters without links, characters in links.
    """

    def __init__(self, page: str):
        self.paths: list[tuple[int, float, str]] = [(-1, 1.0, "")]
        self.elements: list[tuple[int, str, float]] = [(-1, "", 1.0)]
        self.blocks: list[tuple[int, int, str, int, int]] = []
        self._numbers: dict[tuple[int, str], int] = {}
        # tag, path, element, skipped, in an article, in a link; inline elements have the path and element around them.
        self._stack: list[tuple[str, int, int, bool, bool, bool]] = [("", 0, 0, False, False, False)]
        self._open: Counter[str] = Counter()
        self._text: list[str] = []
        self._linked = 0
        self._scan(page)

    def _end_block(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                _, path, element, *_ = self._stack[-1]
                self.blocks.append((path, element, text, max(0, len(text) - self._linked), self._linked))
            self._text, self._linked = [], 0

    def _pop_to(self, at: int) -> None:
        if any(e[0] not in INLINE_TAGS for e in self._stack[at:]):
            self._end_block()
        self._open.subtract(e[0] for e in self._stack[at:])
        del self._stack[at:]

    def _close_nearest(self, tags, scope) -> None:
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i][0] in tags:
                self._pop_to(i)
                return
            if self._stack[i][0] in scope:
                return

    def _start(self, tag: str, text: str) -> None:
        if self._open["head"] and tag not in HEAD_TAGS:
            self._end("head")
        if tag in CLOSES_P and self._open["p"]:
            self._close_nearest({"p"}, P_SCOPE)
        if tag in HEADINGS and self._stack[-1][0] in HEADINGS:
            self._pop_to(len(self._stack) - 1)
        if tag in CLOSES:
            self._close_nearest(*CLOSES[tag])
        inline = tag in INLINE_TAGS
        if not inline:
            self._end_block()
        if tag in VOID_TAGS:
            return
        _, path, element, skipped, article, link = self._stack[-1]
        attrs = _attributes(text) if text.strip(" /") else {}
        skipped = skipped or _skipped(tag, attrs, article)
        opens = tag in ("article", "main")
        if not skipped and not inline:
            label = ".".join([tag, *sorted(attrs.get("class", "").split()), attrs.get("id", "")])
            weight = _weight(tag, attrs) * (ARTICLE if opens and not article else 1.0)
            number = self._numbers.setdefault((path, label), len(self.paths))
            if number == len(self.paths):
                self.paths.append((path, self.paths[path][1] * weight, tag))
            self.elements.append((element, tag, self.elements[element][2] * weight))
            path, element = number, len(self.elements) - 1
        self._stack.append((tag, path, element, skipped, article or opens, link or tag == "a"))
        self._open[tag] += 1

    def _end(self, tag: str) -> None:
        if self._open[tag]:
            for i in range(len(self._stack) - 1, 0, -1):
                if self._stack[i][0] == tag:
                    self._pop_to(i)
                    return
        elif tag not in INLINE_TAGS:
            self._end_block()

    def _add(self, text: str) -> None:
        _, _, _, skipped, _, link = self._stack[-1]
        if skipped:
            return
        plain = html.unescape(text)
        self._text.append(plain)
        if link:
            self._linked += len(" ".join(plain.split()))

    def _scan(self, page: str) -> None:
        at, low = 0, None
        while m := _TAG.match(page, at):
            at = m.end()
            tag = m[2] or m[5]
            if tag is None:
                piece = m[0]
                if piece[0] != "<" or piece == "<":
                    self._add(piece)
                continue
            tag = tag.lower()
            if m[1] or m[4]:
                self._end(tag)
                continue
            self._start(tag, m[3] if m[2] else m[6])
            if tag in RAW_TAGS:
                low = page.lower() if low is None else low
                end = low.find(f"</{tag}", at)
                at = len(page) if end < 0 else end
        self._end_block()


def _smooth(x: np.ndarray) -> np.ndarray:
    reach = np.arange(-3, 4)
    kernel = np.exp(-(reach**2) / (2 * SMOOTH**2))
    kernel /= kernel.sum()
    return np.convolve(np.pad(x, 3, mode="edge"), kernel, mode="valid")


def content_paths(page: Page) -> set[int]:
    """The paths whose fused, smoothed and weighed ratios reach the threshold."""
    length, punct, count = defaultdict(float), defaultdict(float), Counter()
    for path, _, text, plain, linked in page.blocks:
        length[path] += plain
        punct[path] += len(_PUNCT.findall(text)) * plain / max(1, plain + linked)
        count[path] += 1
    text_ratio = _smooth(np.array([length[b[0]] / count[b[0]] for b in page.blocks]))
    punct_ratio = _smooth(np.array([punct[b[0]] / count[b[0]] for b in page.blocks]))
    if not text_ratio.max() > 0:
        return set()
    scaled = punct_ratio / punct_ratio.max() if punct_ratio.max() > 0 else np.ones(len(page.blocks))
    fused = np.sqrt(text_ratio / text_ratio.max() * (PLAIN + (1 - PLAIN) * scaled))
    score = defaultdict(float)
    for block, f in zip(page.blocks, fused):
        score[block[0]] += f / count[block[0]]
    weighed = {p: s * page.paths[p][1] for p, s in score.items() if length[p] > 0}
    best = max(weighed.values(), default=0)
    return {p for p, s in weighed.items() if best > 0 and s >= THRESHOLD * best}


def region(page: Page, chosen: set[int]) -> int:
    """The element that is taken for the article."""
    held = np.zeros(len(page.elements))
    for path, element, _, plain, _ in page.blocks:
        if path in chosen:
            up, tag, _ = page.elements[element]
            held[up if tag in LEAF_TAGS else element] += plain
    for e in range(len(held) - 1, 0, -1):  # parents come before their children
        held[page.elements[e][0]] += held[e]
    root = around = int(np.flatnonzero(held >= REGION * held[0]).max())
    while around > 0:
        if page.elements[around][1] in ("article", "main"):
            root = around
            break
        around = page.elements[around][0]
    return root


def in_article(page: Page, element: int) -> bool:
    """Whether an element is, or lies in, an article or main element."""
    while element > 0:
        if page.elements[element][1] in ("article", "main"):
            return True
        element = page.elements[element][0]
    return False


def main_text(page: str | None) -> str:
    """The article text of one page."""
    if not page:
        return ""
    p = Page(page)
    chosen = content_paths(p) if p.blocks else set()
    if not chosen:  # no text outside links: an article that is all links is still the article
        return " ".join(text for _, element, text, _, _ in p.blocks if in_article(p, element))
    root = region(p, chosen)
    article = p.elements[root][1] in ("article", "main")
    whole = p.elements[root][1] in ("", "html", "body")
    inside = np.zeros(len(p.elements), dtype=bool)
    for e in range(root, len(p.elements)):
        inside[e] = e == root or p.elements[e][0] >= 0 and inside[p.elements[e][0]]
    core = [i for i, b in enumerate(p.blocks) if b[0] in chosen]
    kept, first, last = set(core), min(core), max(core)
    for i, (path, element, _, plain, linked) in enumerate(p.blocks):
        if i in kept or not inside[element] or p.elements[element][2] < HINTED * p.elements[root][2] * (1 - 1e-9):
            continue
        if not article and linked > LINKS * (plain + linked):
            continue
        if whole and not first < i < last and not (p.elements[element][1] in HEADINGS and i + 1 in kept):
            continue
        kept.add(i)
    return " ".join(p.blocks[i][2] for i in sorted(kept))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        at = names.index("_html")
        text = [main_text(page) for page in batch.column(at).to_pylist()]
        rest = [(n, batch.column(i)) for i, n in enumerate(names) if i != at]
        yield pa.RecordBatch.from_arrays([c for _, c in rest] + [pa.array(text, pa.string())], names=[n for n, _ in rest] + ["_text"])


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """All rows and other columns of ``pages`` with ``_text``, the main text."""
    carried = Carried(pages, html_col, "_text")
    out = map_arrow(pages.select(carried.column, F.col(html_col).alias("_html")), _extract, carried.schema("_text string"))
    return out.select(*carried.restored(), "_text")
