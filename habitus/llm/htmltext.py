"""Main text of web pages: flat text blocks classified by a decision tree.

A page is read once from left to right into flat blocks: text between tags that break lines. For
each block the tree sees its word count and link density, those of the block before and after
it, whether it lies in markup that names it content (article, main; or beside such markup, or the
page has none), whether in markup that is something else by its element, role or hiding (menus,
headers, footers, asides), and how much of the page's text the innermost region holds whose class or
id speaks of something else. The tree is grown by Gini impurity on the small labelled table below.

Names are evidence, not a verdict: a wrapper with most of the page's words is no menu, whatever it is
called. Classes and ids of html, body, main, article, headings and paragraphs say nothing; those of a
section only if every part is a known word. A region that is wholly named as readers' comments is
something else at any size. A form is a region like a named one.

Text of the blocks found is decoded, its white space folded, and joined in page order.

Cases: a null or empty page, or one without content, has the empty text; unclosed, stray and cut
off tags are taken as browsers take them, as far as blocks go; very long pages are read whole;
repeated rows and clashing further columns do no harm, as each row is read by itself and only
page_id, url and html are looked at.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = (
    "words", "link_density", "words_before", "density_before", "words_after", "density_after",
    "content_markup", "other_markup", "named_share",
)

#: Labelled blocks outside of named regions: the features in the order above, then 1 for main text. Content markup is 1
#: within it, -1 outside of it, and 0 on pages that have none.
_UNNAMED = (
    # Menus, link lists and breadcrumbs.
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 1, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0),
    (2, 1.0, 1, 1.0, 8, 0.0, 0, 1, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0),
    (3, 1.0, 2, 1.0, 2, 1.0, 0, 0, 0), (6, 0.8, 0, 0.0, 40, 0.0, 0, 0, 0),
    (12, 0.9, 30, 0.0, 9, 0.9, 0, 0, 0), (5, 1.0, 60, 0.0, 5, 1.0, 1, 1, 0),
    # Adverts, notices and forms.
    (8, 0.0, 1, 1.0, 9, 0.0, 0, 1, 0), (30, 0.0, 1, 1.0, 12, 0.0, 0, 1, 0),
    (12, 0.1, 40, 0.0, 35, 0.0, 1, 1, 0), (45, 0.0, 40, 0.0, 35, 0.0, 1, 1, 0),
    (3, 0.0, 2, 0.0, 1, 0.0, 0, 1, 0), (9, 0.0, 1, 1.0, 2, 1.0, 0, 0, 0),
    # Headers, footers and comments.
    (4, 0.0, 0, 0.0, 1, 1.0, 0, 1, 0), (9, 0.0, 50, 0.0, 0, 0.0, 0, 1, 0),
    (30, 0.0, 50, 0.0, 0, 0.0, 0, 1, 0), (7, 0.2, 40, 0.0, 0, 0.0, 0, 0, 0),
    (60, 0.0, 50, 0.0, 45, 0.0, 0, 1, 0), (25, 0.0, 3, 0.0, 20, 0.0, 1, 1, 0),
    (2, 0.0, 60, 0.0, 25, 0.0, 1, 1, 0), (4, 0.0, 1, 1.0, 1, 1.0, 0, 0, 0),
    # Text beside the article of a page.
    (40, 0.0, 6, 0.0, 50, 0.0, -1, 0, 0), (90, 0.1, 40, 0.0, 35, 0.0, -1, 0, 0),
    (25, 0.0, 2, 1.0, 45, 0.0, -1, 0, 0), (8, 0.0, 1, 1.0, 9, 0.0, -1, 0, 0),
    (150, 0.02, 9, 0.0, 12, 0.0, -1, 0, 0), (18, 0.0, 30, 0.0, 28, 0.0, -1, 0, 0),
    # Headings and paragraphs of articles, short ones and ones with links among them.
    (7, 0.0, 8, 0.0, 40, 0.0, 1, 0, 1), (1, 0.0, 30, 0.0, 44, 0.0, 1, 0, 1),
    (2, 0.0, 9, 0.0, 0, 0.0, 1, 0, 1), (9, 0.0, 1, 1.0, 80, 0.0, 1, 0, 1),
    (45, 0.0, 7, 0.0, 50, 0.0, 1, 0, 1), (120, 0.05, 45, 0.0, 9, 0.0, 1, 0, 1),
    (30, 0.3, 60, 0.0, 20, 0.0, 1, 0, 1), (80, 0.0, 60, 0.0, 10, 0.0, 1, 0, 1),
    (3, 1.0, 40, 0.0, 60, 0.0, 1, 0, 1), (12, 0.0, 0, 0.0, 0, 0.0, 1, 0, 1),
    (5, 0.4, 40, 0.0, 2, 1.0, 1, 0, 1), (2, 1.0, 2, 1.0, 2, 1.0, 1, 0, 1), (9, 0.6, 1, 1.0, 30, 0.0, 1, 0, 1),
    (4, 0.0, 30, 0.0, 1, 1.0, 1, 0, 1), (20, 0.5, 20, 0.5, 20, 0.5, 1, 0, 1), (1, 0.0, 1, 1.0, 1, 1.0, 1, 0, 1),
    # Text of pages without such markup.
    (40, 0.0, 6, 0.0, 50, 0.0, 0, 0, 1), (90, 0.1, 40, 0.0, 35, 0.0, 0, 0, 1),
    (25, 0.0, 2, 1.0, 45, 0.0, 0, 0, 1), (60, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1),
    (6, 0.0, 40, 0.0, 55, 0.0, 0, 0, 1), (18, 0.0, 30, 0.0, 28, 0.0, 0, 0, 1),
    (35, 0.0, 50, 0.0, 5, 0.0, 0, 0, 1), (22, 0.1, 25, 0.0, 3, 1.0, 0, 0, 1),
    (5, 0.0, 25, 0.0, 30, 0.0, 0, 0, 1), (150, 0.02, 9, 0.0, 12, 0.0, 0, 0, 1),
    # Their short last paragraphs, and notices, imprints and copyright lines without any markup.
    (20, 0.0, 60, 0.0, 0, 0.0, 0, 0, 1), (12, 0.0, 45, 0.0, 0, 0.0, 0, 0, 1), (30, 0.1, 50, 0.0, 0, 0.0, 0, 0, 1),
    (34, 0.0, 60, 0.0, 7, 0.2, 0, 0, 1), (16, 0.0, 30, 0.0, 8, 0.0, 0, 0, 1),
    (8, 0.0, 45, 0.0, 0, 0.0, 0, 0, 0), (6, 0.3, 30, 0.0, 0, 0.0, 0, 0, 0), (5, 0.0, 12, 0.0, 0, 0.0, 0, 0, 0),
    (8, 0.0, 20, 0.0, 14, 0.1, 0, 0, 0), (14, 0.1, 8, 0.0, 0, 0.0, 0, 0, 0), (20, 0.05, 7, 0.0, 0, 0.0, 0, 0, 0),
    (14, 0.0, 0, 0.0, 1, 1.0, 0, 0, 0), (22, 0.1, 0, 0.0, 2, 1.0, 0, 0, 0),
)

#: Labelled blocks in named regions: the share of the page's words that the region has, then the label.
_NAMED = (
    # Small ones: adverts, notices, teasers, comments.
    (8, 0.0, 1, 1.0, 9, 0.0, 0, 0, 0.05, 0), (30, 0.0, 1, 1.0, 12, 0.0, 0, 0, 0.15, 0),
    (45, 0.0, 40, 0.0, 35, 0.0, 1, 0, 0.12, 0), (12, 0.1, 40, 0.0, 35, 0.0, 1, 0, 0.2, 0),
    (60, 0.0, 50, 0.0, 45, 0.0, 0, 0, 0.3, 0), (3, 1.0, 2, 1.0, 2, 1.0, 0, 0, 0.05, 0),
    (25, 0.0, 3, 0.0, 20, 0.0, 1, 0, 0.3, 0), (2, 0.0, 60, 0.0, 25, 0.0, 1, 0, 0.25, 0),
    (90, 0.0, 40, 0.0, 9, 0.0, 0, 0, 0.35, 0), (16, 0.0, 0, 0.0, 40, 0.0, 0, 0, 0.1, 0),
    (14, 0.0, 30, 0.0, 0, 0.0, 1, 0, 0.27, 0), (1, 0.0, 41, 0.0, 0, 0.0, 0, 0, 0.01, 0),
    (5, 0.0, 60, 0.0, 2, 0.0, 1, 0, 0.02, 0), (1, 0.0, 0, 0.0, 60, 0.0, 0, 0, 0.01, 0),
    (3, 0.0, 0, 0.0, 40, 0.0, 1, 0, 0.05, 0), (4, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0.05, 0), (40, 0.0, 8, 0.0, 60, 0.0, 0, 0, 0.4, 0),
    # Wrappers of the text, and link lists in them.
    (60, 0.0, 0, 0.0, 60, 0.0, 0, 0, 1.0, 1), (60, 0.0, 60, 0.0, 0, 0.0, 0, 0, 1.0, 1),
    (60, 0.0, 8, 0.0, 50, 0.0, 1, 0, 0.9, 1), (7, 0.0, 0, 0.0, 60, 0.0, 0, 0, 0.8, 1),
    (25, 0.1, 40, 0.0, 30, 0.0, 0, 0, 0.65, 1), (120, 0.02, 9, 0.0, 80, 0.0, 1, 0, 0.7, 1),
    (12, 0.0, 45, 0.0, 0, 0.0, 1, 0, 0.95, 1), (40, 0.0, 6, 0.0, 50, 0.0, 0, 0, 0.6, 1),
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0.9, 0), (3, 1.0, 2, 1.0, 2, 1.0, 0, 0, 0.65, 0),
)

LABELLED = tuple((*row[:-1], 1.0, row[-1]) for row in _UNNAMED) + _NAMED  # the page itself has all

# Elements of HTML by their part in a page.
_RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font",
    "i", "img", "ins", "kbd", "label", "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small",
    "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
_VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
    "track", "wbr",
}
_CONTENT = {"article", "main"}
_OTHER = {
    "nav", "header", "footer", "aside", "menu", "dialog", "button", "select", "datalist",
    "svg", "canvas", "audio", "video", "object", "math", "head",
}
_OTHER_ROLES = {
    "navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar",
    "dialog", "alert", "alertdialog", "toolbar", "status",
}
_OTHER_NAMES = re.compile(
    r"(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed|s)?|promos?|promotions?|banners?|nav|navbar|"
    r"navigation|menus?|breadcrumbs?|headers?|masthead|footers?|sidebars?|widgets?|cookies?|consent|gdpr|"
    r"notices?|alerts?|newsletter|subscribe|subscription|signup|login|search|social|share|sharing|related|"
    r"recommended|comments?|disqus|repl(?:y|ies)|respond|pagination|pager|popup|modal|overlay|forms?|copyright|"
    r"skip|toolbar|tags)"
)

_READERS = re.compile(r"comments?|disqus|repl(?:y|ies)|respond")
_LAYOUT_NAMES = re.compile(
    r"(?:site|main|page|top|bottom|left|right|primary|secondary|global|post|article|content|box|bar|block|wrap|"
    r"wrapper|container|area|section|lists?|links?|slot|unit|items?|inner|outer|user|body|thread|head|panel|side)"
)
_REGIONS = {"form", "fieldset"}
_UNNAMEABLE = {"html", "body", "main", "article", "p", "h1", "h2", "h3", "h4", "h5", "h6"}

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*(?:\"|$)|'[^']*(?:'|$)|[^>\"'])*)(>|$)"
    r"|<[!?/][^>]*(?:>|$)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)|(?=[\s/]|$))""", re.I)


@lru_cache(maxsize=4096)
def _named(attributes: str, element: str, content: int) -> tuple[bool, bool]:
    """Whether an element is something else by role, hiding or a name for comments; and whether its
    class or id speaks of something else, so that it is a named region.

    The header of an article belongs to it.
    """
    region = False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in _OTHER_ROLES:
            return True, False
        if name not in ("class", "id") or element in _UNNAMEABLE:
            continue
        for token in value.split():
            parts = [p for p in re.split(r"[^a-z]+", token) if p]
            spoken = [p for p in parts if _OTHER_NAMES.fullmatch(p) and not (content and p == "header")]
            whole = all(_OTHER_NAMES.fullmatch(p) or _LAYOUT_NAMES.fullmatch(p) for p in parts)
            if whole and any(_READERS.fullmatch(p) for p in spoken):
                return True, False
            region |= bool(spoken) and (whole or element != "section")
    return False, region


def blocks(page: str) -> list[tuple[str, float, int, int, float]]:
    """(text, link density, in content markup, in other markup, share of its region) of flat blocks."""
    found: list[tuple[str, float, int, int, int]] = []
    open_: list[tuple[str, int, int, int, int]] = []  # element, content, other, link, region
    above = [0]  # the region around each region; 0 is the page
    parts: list[str] = []
    linked: list[str] = []
    content = other = link = region = 0

    def flush() -> None:
        text = " ".join(references.unescape("".join(parts)).split())
        if text:
            share = len("".join(linked).split()) / max(1, len(text.split()))
            found.append((text, min(1.0, share), content, other, region))
        parts.clear()
        linked.clear()

    def add(text: str) -> None:
        parts.append(text)
        if link:
            linked.append(text + " ")

    at = 0
    while (sign := page.find("<", at)) >= 0:
        m = _TOKEN.match(page, sign)
        if m is None:  # a sign of its own
            add(page[at : sign + 1])
            at = sign + 1
            continue
        if sign > at:
            add(page[at:sign])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name not in _INLINE:
                flush()
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == name:
                    content, other, link, region = open_[k][1:]
                    del open_[k:]
                    break
            continue
        if name not in _INLINE:
            flush()
        if name in _VOID or m[3].endswith("/") and name in _OTHER:
            continue
        if name in _RAW:
            end = re.compile(rf"</{name}\b[^>]*(?:>|$)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in _INLINE and name != "a":
            continue
        open_.append((name, content, other, link, region))
        if name == "a":
            link = 1
        elif name in _CONTENT:
            content = 1
        is_other, is_region = _named(m[3], name, content) if m[3] else (False, False)
        if name in _OTHER and not (name == "header" and content) or is_other:
            other = 1
        if is_region or name in _REGIONS:
            above.append(region)
            region = len(above) - 1
    if at < len(page):
        add(page[at:])
    flush()
    return _with_shares(found, above)


def _with_shares(found: list[tuple], above: list[int]) -> list[tuple[str, float, int, int, float]]:
    """Blocks with the share of the page's words, but those in other markup, that their region has."""
    words = [0] * len(above)
    for text, _, _, other, region in found:
        if not other:
            words[region] += len(text.split())
    for region in range(len(above) - 1, 0, -1):  # a region comes after the one around it
        words[above[region]] += words[region]
    return [(*b[:4], words[b[4]] / max(1, words[0]) if b[4] else 1.0) for b in found]


def features(found: list[tuple[str, float, int, int, float]]) -> np.ndarray:
    """A row of ``FEATURES`` for each block."""
    own = np.array([(len(t.split()), d) for t, d, *_ in found], float).reshape(-1, 2)
    edge = np.zeros((1, 2))
    markup = np.array([b[2:] for b in found], float).reshape(-1, 3)
    if markup[:, 0].any():
        markup[markup[:, 0] == 0, 0] = -1
    return np.hstack([own, np.vstack([edge, own])[:-1], np.vstack([own, edge])[1:], markup])


class Tree:
    """A binary decision tree grown by Gini impurity until its leaves are pure."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray):
        self.label = bool(2 * labels.sum() > len(labels))
        self.split: tuple[int, float] | None = None
        if not 0 < labels.sum() < len(labels):
            return
        best = (np.inf, -1, 0.0)
        for f in range(rows.shape[1]):
            values = np.unique(rows[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                low = rows[:, f] <= cut
                impurity = sum(
                    len(side) * 2 * side.mean() * (1 - side.mean()) for side in (labels[low], labels[~low])
                )
                if impurity < best[0] - 1e-12:
                    best = (impurity, f, float(cut))
        if best[1] >= 0:
            self.split = best[1:]
            low = rows[:, best[1]] <= best[2]
            self.low, self.high = Tree(rows[low], labels[low]), Tree(rows[~low], labels[~low])

    def of(self, rows: np.ndarray) -> np.ndarray:
        """Labels of feature rows."""
        if self.split is None:
            return np.full(len(rows), self.label)
        low = rows[:, self.split[0]] <= self.split[1]
        out = np.empty(len(rows), bool)
        out[low], out[~low] = self.low.of(rows[low]), self.high.of(rows[~low])
        return out


def train(table: tuple = LABELLED) -> Tree:
    """The tree of a labelled table."""
    rows = np.array(table, float)
    return Tree(rows[:, :-1], rows[:, -1])


def page_text(page: str | None, tree: Tree) -> str:
    """Main text of one page."""
    found = blocks(page or "")
    if not found:
        return ""
    return " ".join(t for (t, *_), main in zip(found, tree.of(features(found)), strict=True) if main)


def extract(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for each page."""
    tree = tree or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [page_text(p.as_py(), tree) for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )
