"""HTML main text: flat text blocks, classified by a decision tree over each block and its neighbours.

A page becomes a flat list of text blocks: block-level tags end one, inline tags do
not, and what scripts, styles, comments and the head hold is no text.  Features
of a block are its own, the last and the next block's word count and link
density, and where it stands: whether an enclosing element is a menu, header,
footer, sidebar, notice, advert, form or list of comments, whether one is the
article, whether it is a heading, and whether it is a paragraph, list item, cell or
the like.  An element is a menu, notice and so on by its tag or if one name of its class,
id or role has no words but such a mark and layout words ("sidebar-left"; but not
"related-work" or "ad-hoc-networks").  A form that holds the article marks nothing in it.

The tree is grown in numpy (Gini impurity) from the labelled layouts below, whole
pages in short.  Pages are read in linear time whatever they hold.
"""

from __future__ import annotations

import bisect
import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# HTML element names by what they do to text.
RAW = "script style textarea title iframe".split()
SILENT = "template noscript svg math canvas object audio video select button".split()
INLINE = (
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr".split()
)
MENUS = "nav aside footer form menu dialog fieldset".split()
ARTICLES = "article main".split()
HEADINGS = "h1 h2 h3 h4 h5 h6".split()
PARAGRAPHS = "p li dd dt td th blockquote pre figcaption caption address summary".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
#: Words of a class, id or role that mark what is not the article.
MARKS = (
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer "
    "sidebar complementary contentinfo cookie cookies consent notice gdpr popup modal overlay newsletter subscribe signup login search share sharing social related recommended "
    "comment comments reply replies respond discussion disqus pagination pager toolbar widget skip copyright legal disclaimer"
).split()
#: Words that say nothing of what an element is, beside marks and in lists of names.
LAYOUT = (
    "area bar block bottom box btn button card cell col column container content default desktop fixed form global group grid holder inner item items large left level line link links list "
    "main mobile outer page panel post posts primary region right row secondary section site slot small sticky sub tabs text title top unit view wrap wrapper zone"
).split()
#: Words of a class, id or role that mark the article.
BODIES = "article main content post entry story body".split()

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "marked", "article", "heading", "paragraph")

#: Labelled pages, a block each: words, link density in percent after "/", then letters: m marked, a in the article, h heading, p paragraph, and + if it is main text.
LAYOUTS = (
    # an article element between menu, advert and footer; long, short and one-word paragraphs
    "1/100mp 1/100mp 1/100mp 9m 9ah+ 120ap+ 35ap+ 4ap+ 80ap+ 12m",
    "2/100mp 1/100mp 3/100mp 14m 8ah+ 1ap+ 9ap+ 1ap+ 300ap+ 2ap+ 10/20m",
    "5m 1/100mp 1/100mp 6ah+ 60ap+ 3ap+ 9m 6/50m",
    "300a+",
    "1/100mp 1/100mp 7ah+ 5ap+ 3ap+ 1/100m",
    # quotes, lists, captions, tables and reference lists in an article
    "4/100mp 11ah+ 70ap+ 18/60ap+ 25ap+ 5/100ap+ 50ap+ 2ah+ 6/100ap+ 7/100ap+ 5/100ap+ 3ap+ 14m",
    "3m 10ah+ 40ap+ 2ap+ 3ap+ 2ap+ 30ap+ 4ah+ 90/8ap+ 12a+ 3ap+ 8/30m 2/100m",
    "1/100mp 9ah+ 1/100a+ 45/10ap+ 55/30ap+ 3/100ap+ 2ah+ 4/100ap+ 4/100ap+ 20m",
    # adverts, share links, notices and comments inside the article
    "8ah+ 90ap+ 12am 60ap+ 45ap+ 2/100amp 1/100amp 3amh 25amp 60amp 4amp 5/100amp",
    "1/100mp 6ah+ 30ap+ 2amp 70ap+ 9/40am 22ap+ 6amh 120amp 80amp 1amp",
    # sidebars and notices with long text, forms, related lists
    "45m 7ah+ 80ap+ 35ap+ 4mh 60mp 90mp 70mp 12m",
    "20m 3/100mp 2/100mp 8ah+ 200ap+ 3mh 7/100mp 6/100mp 9/90mp 5m 2m 1m",
    "1/100mp 2/100mp 9ah+ 33ap+ 41ap+ 4mh 9mp 11mp 16/10m",
    # no article element: headings and paragraphs among menus that nothing marks
    "1/100p 1/100p 1/100p 7h+ 90p+ 40p+ 55p+ 4/50 2/100",
    "2/100p 3/100p 6h+ 30/5p+ 16p+ 45p+ 2p+ 70p+ 1/100p 1/100p",
    "1/100 1/100 5/80 14+ 60+ 22/12+ 50+ 33+ 6/75 3/100",
    "4/90 2/100 9h+ 60p+ 12p+ 3p+ 70p+ 5h+ 45/10p+ 12/80p 15/70p",
    "3/100p 4/100p 5/100p 8h+ 120p+ 6p+ 35/4p+ 3h 4/100p 5/100p 6/100p",
    "45+ 70+ 38+ 9/50 3/100 2/100",
    "1/100p 1/100p 6h+ 8p+ 35p+ 5p+ 2/100p 2/100p",
    # small pages: a heading and a few short paragraphs
    "2h+ 6p+ 5p+",
    "4h+ 5p+ 9p+ 3p+",
    "1h+ 12p+ 3p+ 1/100p",
    "7p+",
    "3h+ 9+ 14+",
    # pages of nothing but links, lone words and boilerplate
    "1/100p 1/100p 1/100p 2/100p 4/90p 3/100p",
    "2/100 3/100 4 2/100 5/80 3 1/100",
    "9/50 3/100 2/100 12/80 20/60 15/70",
    "3/100m 4m 2/100m 25m",
)


def _blocks_of(layout: str) -> list[tuple]:
    """The blocks of a labelled page, as ``blocks`` gives them, with the label instead of a text."""
    out = []
    for block in layout.split():
        words, links, flags = re.fullmatch(r"(\d+)(?:/(\d+))?([mahp+]*)", block).groups()
        out.append(("+" in flags, int(words), int(words) * int(links or 0) / 100, *(c in flags for c in "mahp")))
    return out


def labelled() -> np.ndarray:
    """A row for each block of the labelled pages: its features, then 1 for main text."""
    pages = [_blocks_of(layout) for layout in LAYOUTS]
    return np.concatenate([np.column_stack([_features(page), [b[0] for b in page]]) for page in pages])


class Tree:
    """A binary decision tree on numeric features, grown until its leaves are pure or have ``least`` rows."""

    def __init__(self, table: np.ndarray, least: int = 1, depth: int = 12):
        self.rows: list[tuple[int, float, int, int, int]] = []  # feature, at most, then, else, class
        self._grow(table, least, depth)

    def _grow(self, table: np.ndarray, least: int, depth: int) -> int:
        label = table[:, -1]
        me = len(self.rows)
        self.rows.append((-1, 0.0, 0, 0, int(2 * label.sum() >= len(label))))
        if depth == 0 or len(table) <= least or label.min() == label.max():
            return me
        best = (np.inf, 0, 0.0)
        for k in range(table.shape[1] - 1):
            values = np.unique(table[:, k])
            for at in (values[1:] + values[:-1]) / 2:
                left = table[:, k] <= at
                impurity = sum(len(part) * 2 * part.mean() * (1 - part.mean()) for part in (label[left], label[~left]))
                best = min(best, (impurity, k, float(at)))
        if np.isinf(best[0]):
            return me
        _, k, at = best
        left = table[:, k] <= at
        yes, no = self._grow(table[left], least, depth - 1), self._grow(table[~left], least, depth - 1)
        self.rows[me] = (k, at, yes, no, self.rows[me][4])
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        feature, at, yes, no, kind = (np.array(c) for c in zip(*self.rows, strict=True))
        while True:
            inner = np.flatnonzero(feature[node] >= 0)
            if not len(inner):
                return kind[node]
            here = node[inner]
            node[inner] = np.where(x[inner, feature[here]] <= at[here], yes[here], no[here])


def grown() -> Tree:
    return Tree(labelled())


_ATTRIBUTES = r"""(?:"[^"]*"|'[^']*'|[^'"<>])*+"""
_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<({"|".join(RAW)})(?=[\s/>]){_ATTRIBUTES}>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*+>|<(/?)([a-zA-Z][^\s/<>]*+)({_ATTRIBUTES})>""", re.DOTALL | re.IGNORECASE
)
_ENDS = re.compile(rf"</({'|'.join(SILENT)})\s*>", re.IGNORECASE)
_NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+")
_INLINE, _MENUS, _ARTICLES, _HEADINGS, _VOID, _MARKS, _BODIES = map(frozenset, (INLINE, MENUS, ARTICLES, HEADINGS, VOID, MARKS, BODIES))
_SILENT, _PARAGRAPHS = frozenset(SILENT), frozenset(PARAGRAPHS)
_PLAIN = frozenset(LAYOUT) | _BODIES
_KEPT = _MENUS | _ARTICLES | _HEADINGS | _PARAGRAPHS | frozenset("div section header ul ol dl table tbody thead tr body head figure details".split())


def _kind(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """(marked, article) of an element by its tag and by the names in its class, id and role."""
    marked = tag in _MENUS or (tag == "header" and not in_article) or tag == "head"
    article = tag in _ARTICLES
    if attributes and not article and tag != "body":
        for name in " ".join(_NAMED.findall(attributes)).replace('"', " ").replace("'", " ").split():
            words = set(_WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()))
            found = words & _MARKS
            if found and words <= _MARKS | _PLAIN and not (in_article and found == {"header"}):
                return True, False
            article = article or bool(words) and words <= _PLAIN and bool(words & _BODIES)
    return marked, article


def blocks(page: str) -> list[tuple[str, int, int, bool, bool, bool, bool]]:
    """(text, words, words in links, marked, in the article, heading, paragraph) of each text block, in page order."""
    out: list[tuple[str, int, int, bool, bool, bool, bool]] = []
    stack: list[tuple[str, bool, bool, bool, bool, bool]] = []  # tag; marked, article, heading, paragraph, marked by forms alone: of it or anything around it
    open_tags: Counter[str] = Counter()
    ends: dict[str, list[int]] = {}
    for end in _ENDS.finditer(page):
        ends.setdefault(end[1].lower(), []).append(end.end())
    parts: list[str] = []
    linked = anchor = 0
    nowhere = ("", False, False, False, False, False)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                words = text.count(" ") + 1
                _, marked, article, heading, paragraph, _ = stack[-1] if stack else nowhere
                out.append((text, words, min(linked, words), marked, article, heading, paragraph))
            parts.clear()
        linked = 0

    def take(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if anchor:
                linked += len(text.split())

    def pop() -> str:
        tag = stack.pop()[0]
        open_tags[tag] -= 1
        return tag

    at = 0
    for token in _TOKEN.finditer(page):
        if token.start() < at:
            continue  # inside an element without text
        take(page[at : token.start()])
        at = token.end()
        tag = token[3]
        if tag is None:
            continue
        tag, closes = tag.lower(), bool(token[2])
        if tag in _SILENT:
            places = ends.get(tag, ())
            k = bisect.bisect(places, at)
            if not closes and not token[4].endswith("/") and k < len(places):
                at = places[k]  # an element that is never closed has no content
            continue
        if tag == "a":
            anchor = max(0, anchor + (-1 if closes else 1))
        if tag in _INLINE:
            if tag == "br":
                parts.append(" ")
            continue
        flush()
        if tag not in _KEPT or tag in _VOID:
            continue
        if not closes:
            if stack and stack[-1][0] == tag and tag in ("p", "li", "dd", "dt", "td", "th", "tr"):
                pop()
            if tag == "body" and stack and stack[-1][0] == "head":
                pop()
            _, marked, article, _, paragraph, forms = stack[-1] if stack else nowhere
            own, body = _kind(tag, token[4], article)
            if forms and tag in _ARTICLES:
                marked = False
            if not token[4].endswith("/"):
                forms = (tag == "form" and not marked) or (forms and marked and not own)
                stack.append((tag, marked or own, article or body, tag in _HEADINGS, paragraph or tag in _PARAGRAPHS, forms))
                open_tags[tag] += 1
            anchor = 0 if tag in ("div", "p", "nav", "article", "footer", "section") else anchor
        elif open_tags[tag]:
            while pop() != tag:
                pass
    take(page[at:])
    flush()
    return out


def _features(found: list[tuple]) -> np.ndarray:
    x = np.zeros((len(found), len(FEATURES)))
    x[:, 0] = [b[1] for b in found]
    x[:, 1] = [100 * b[2] / b[1] for b in found]
    x[1:, 2:4], x[:-1, 4:6] = x[:-1, :2], x[1:, :2]
    x[:, 6:] = [b[3:] for b in found]
    return x


def main_text(page: str | None, tree: Tree | None = None) -> str:
    """The main text of one page: its blocks of main text, joined by one newline."""
    found = blocks(page or "")
    if not found:
        return ""
    kept = (tree or grown()).predict(_features(found))
    return "\n".join(b[0] for b, k in zip(found, kept, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``; n_chars counts code points.

    A null or empty page has an empty text.  Unclosed and stray tags are tolerated;
    text before any tag is a block of its own.  Repeated rows are extracted each;
    extra columns are ignored; no rows give none.
    """
    tree = grown()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = [blocks(page.as_py() or "") for page in part.column(2)]
                flat = [f for f in found if f]
                kept = iter(tree.predict(np.concatenate([_features(f) for f in flat])) if flat else ())
                texts = ["\n".join([b[0] for b in f if next(kept)]) for f in found]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
