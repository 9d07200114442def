"""Main text of web pages: flat text blocks, classified by a decision tree on shallow features.

1. A page is cut into flat blocks at block-level tags. A block knows its words, its share of words in
   links, whether it is a heading, whether it stands in an article or main element, beside one, or in
   an element for page furniture (menu, header, footer, aside, form, dialog ...), which may also be
   known by its class, id or role, unless those name a layout, or a place and the block is long with
   few links. Names of adverts, readers' comments and notices count at any length.
2. A decision tree takes word count and link density of the block and of its two neighbours, with
   those marks, and says text or not. The tree is trained here, by Gini splits, on a small labelled
   table of block features. Within an article runs of links are not text; beside one long plain blocks are.
3. Blocks that stay are joined in page order.

A page is one row's work, linear in its length; nothing is shuffled. Scripts, styles, templates, images
and comments never become blocks; formulas are text. Unclosed and stray tags are tolerated. Null and empty pages have the empty text; pages without
markup are one block. Repeated rows give repeated rows; other columns are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlight.llm.bpe import widened, with_columns

#: A tag. Quotes hold back a ``>`` only behind ``=``; nothing is tried twice.
TAG = re.compile(
    r"<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)>"
)
BEGINS_TAG = re.compile(r"</?[a-zA-Z]")
#: Elements without readable content that end at the first end tag of their name ...
RAW = frozenset("script style noscript iframe textarea select title".split())
END_OF = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for name in RAW}
#: ... and those that may hold others of their own name.
NESTED = frozenset("svg template object annotation annotation-xml".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol "
    "optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTENT = frozenset("article main".split())
FURNITURE = frozenset("nav header footer aside form dialog menu fieldset button label legend".split())
#: Words in a class, id or role that mark furniture, notices, adverts and readers' comments.
FURNITURE_NAMES = frozenset(
    "ad ads adv advert advertisement adsense banner sponsor sponsored promo promotion nav navbar navigation menu "
    "breadcrumb breadcrumbs header masthead footer copyright sidebar aside widget related recommended share "
    "sharing social cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "signup login search form comment comments discussion disqus reply replies respond tags pagination pager toc "
    "skip toolbar complementary contentinfo".split()
)
#: Of these, adverts, readers' comments and notices: believed at any length.
STRONG_NAMES = frozenset(
    "ad ads adv advert advertisement adsense sponsor sponsored promo promotion cookie cookies consent gdpr "
    "newsletter comment comments discussion disqus reply replies respond".split()
)
NAMES = re.compile(r"(?<![\w-])(?:class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Before or after one of those words in the same name, these say how a wrapper is laid out.
LAYOUT_BEFORE = frozenset("has have no not with without hide show tag category".split())
LAYOUT_AFTER = frozenset("layout enabled".split())
#: In an article or main element these name the place of its title.
TITLES = frozenset("header masthead".split())
#: A block of so many words with at most this share in links is text in spite of a name.
LONG, PLAIN = 40, 0.1
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose end tag may be missing: a new one of the kind ends it.
SELF_CLOSING = {"p": "p", "li": "li", "dt": "dt", "dd": "dd", "option": "option", "tr": "tr", "td": "td", "th": "th"}

FEATURES = (
    "words", "link_share", "words_before", "link_share_before", "words_after", "link_share_after", "heading",
    "in_content", "beside_content", "in_furniture",
)
#: Blocks of pages without any marks, in the order of FEATURES up to ``heading``; then 1
#: for text, 0 for the rest.
SHAPES = (
    (70, 0.0, 9, 0.0, 60, 0.0, 0, 1),
    (45, 0.05, 70, 0.0, 5, 0.0, 0, 1),
    (22, 0.1, 45, 0.0, 30, 0.1, 0, 1),
    (30, 0.3, 60, 0.0, 50, 0.0, 0, 1),
    (16, 0.0, 3, 1.0, 40, 0.0, 0, 1),
    (14, 0.0, 40, 0.0, 3, 1.0, 0, 1),
    (35, 0.0, 3, 1.0, 2, 1.0, 0, 1),
    (3, 0.0, 45, 0.0, 60, 0.0, 0, 1),
    (6, 0.0, 50, 0.0, 22, 0.1, 0, 1),
    (1, 0.0, 40, 0.0, 0, 0.0, 0, 1),
    (7, 0.0, 5, 0.0, 8, 0.0, 0, 1),
    (2, 0.0, 1, 0.0, 0, 0.0, 0, 1),
    (1, 0.0, 0, 0.0, 2, 0.0, 0, 1),
    (8, 0.0, 2, 1.0, 50, 0.0, 1, 1),
    (2, 0.0, 3, 1.0, 45, 0.0, 1, 1),
    (4, 0.0, 70, 0.0, 45, 0.0, 1, 1),
    (5, 0.0, 0, 0.0, 70, 0.0, 1, 1),
    (50, 0.0, 0, 0.0, 0, 0.0, 0, 1),
    (1, 0.0, 0, 0.0, 0, 0.0, 0, 1),
    (2, 1.0, 2, 1.0, 2, 1.0, 0, 0),
    (4, 1.0, 0, 0.0, 3, 1.0, 0, 0),
    (5, 1.0, 60, 0.0, 4, 1.0, 0, 0),
    (1, 1.0, 5, 0.0, 40, 0.0, 0, 0),
    (6, 0.6, 50, 0.0, 45, 0.0, 0, 0),
    (12, 0.8, 50, 0.0, 3, 1.0, 0, 0),
    (30, 0.7, 20, 0.9, 25, 0.8, 0, 0),
    (90, 0.9, 50, 0.0, 60, 0.0, 0, 0),
    (5, 0.0, 3, 1.0, 2, 1.0, 0, 0),
    (1, 0.0, 3, 1.0, 0, 0.0, 0, 0),
    (4, 0.0, 2, 1.0, 6, 0.0, 0, 0),
    (7, 0.0, 4, 0.9, 5, 0.0, 0, 0),
    (6, 0.0, 4, 0.0, 3, 1.0, 0, 0),
    (3, 0.0, 2, 1.0, 3, 1.0, 1, 0),
)
#: (in_content, beside_content, in_furniture) of the table's rows.
MARKS = ((0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (0, 1, 1))
#: From this share on a block is a link.
LINKED = 0.6


def _label(shape: tuple, marks: tuple) -> int:
    """What a shape counts as under these marks.

    Without marks as the table says; within an article as text, but for runs of links; beside one only
    if long and plain; in furniture never.
    """
    words, share, _, before, _, after, heading, label = shape
    content, beside, furniture = marks
    if furniture:
        return 0
    if content:
        return int(heading or share < LINKED or max(before, after) < LINKED)
    return int(words >= LONG and share <= PLAIN) if beside else label


#: Beside an article, blocks on both sides of that bound.
EDGES = ((LONG - 1, 0.0, 60, 0.0, 60, 0.0, 0, 0), (LONG, 0.0, 60, 0.0, 60, 0.0, 0, 1), (90, PLAIN, 50, 0.0, 60, 0.0, 0, 1), (90, PLAIN + 0.02, 50, 0.0, 60, 0.0, 0, 0))
#: Within an article, blocks of links with and without links beside them.
RUNS = tuple(
    (words, share, near, before, near, after, heading, 0)
    for words in (1, 4, 30, 300) for share in (0.0, 0.5, LINKED, 1.0) for near in (3, 50)
    for before, after in ((0.0, 0.0), (0.5, 0.5), (LINKED, 0.0), (0.0, LINKED), (1.0, 1.0)) for heading in (0, 1)
)
TRAINING = [(*shape[:-1], *marks, _label(shape, marks)) for marks in MARKS for shape in SHAPES]
TRAINING += [(*shape[:-1], *MARKS[2], _label(shape, MARKS[2])) for shape in EDGES]
TRAINING += [(*shape[:-1], *MARKS[1], _label(shape, MARKS[1])) for shape in RUNS]


class DecisionTree:
    """A binary tree of (feature, threshold) splits that lower the Gini impurity most."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, depth: int = 12):
        self.share = float(labels.mean())
        self.feature = None
        if depth and 0 < self.share < 1 and (split := self._best(rows, labels)):
            self.feature, self.threshold = split
            low = rows[:, self.feature] <= self.threshold
            self.low = DecisionTree(rows[low], labels[low], depth - 1)
            self.high = DecisionTree(rows[~low], labels[~low], depth - 1)

    @staticmethod
    def _best(rows: np.ndarray, labels: np.ndarray) -> tuple[int, float] | None:
        best, found = 1e-12, None
        n, impurity = len(labels), labels.mean() * (1 - labels.mean())
        for feature in range(rows.shape[1]):
            values = np.unique(rows[:, feature])
            for threshold in (values[:-1] + values[1:]) / 2:
                low = rows[:, feature] <= threshold
                a, b = labels[low].mean(), labels[~low].mean()
                gain = impurity - (low.sum() * a * (1 - a) + (~low).sum() * b * (1 - b)) / n
                if gain > best:
                    best, found = gain, (feature, float(threshold))
        return found

    def says(self, row: tuple) -> bool:
        node = self
        while node.feature is not None:
            node = node.low if row[node.feature] <= node.threshold else node.high
        return node.share >= 0.5


@lru_cache(maxsize=1)
def tree() -> DecisionTree:
    table = np.array(TRAINING, float)
    return DecisionTree(table[:, :-1], table[:, -1])


def _named(attrs: str, content: bool) -> int:
    """Whether a class, id or role tells of furniture: 0 no, 1 yes, 2 of a kind that length cannot excuse."""
    if "=" not in attrs:
        return 0
    most = 0
    for match in NAMES.finditer(attrs):
        for name in (match[1] or match[2] or match[3] or "").split():
            words = [w.lower() for w in WORDS.findall(name)]
            ends = next((k for k in range(len(words) - 1, -1, -1) if words[k] in LAYOUT_AFTER), -1)
            for k, word in enumerate(words):
                if word in LAYOUT_BEFORE:
                    break
                if word in FURNITURE_NAMES and k >= ends and not (content and word in TITLES):
                    most = max(most, 2 if word in STRONG_NAMES else 1)
    return most


class _Open:
    """An open element: marked as furniture by its tag or, from the nearest such element outwards, by a name.

    ``article`` and ``main`` tell what content elements a named one holds or is.
    """

    __slots__ = ("tag", "marked", "named", "up", "article", "main", "all_main", "believed")

    def __init__(self, tag: str, marked: bool, named: int, up: _Open | None):
        self.tag, self.marked, self.named, self.up = tag, marked, named, up
        self.article = self.main = self.all_main = False
        self.believed = 0


class _Block:
    __slots__ = ("text", "words", "linked", "content", "furniture", "heading", "named")

    def __init__(self, text: str, linked: int, content: bool, furniture: bool, heading: bool, named: _Open | None):
        self.text, self.words, self.linked = text, text.count(" ") + 1, linked
        self.content, self.furniture, self.heading, self.named = content, furniture, heading, named


def _believe_names(found: list[_Block], names: list[_Open]) -> None:
    """Mark the blocks that names tell of; ``names`` are the named elements, outer ones first.

    A name is not believed of a main element or what holds one, nor of an article or what holds one if
    no other content would be left. Names of places, such as share or sidebar, are not believed either of
    a long block with few links, except beside content; adverts, comments and notices are, at any length.
    """
    for element in names:
        element.all_main = element.main and (element.up is None or element.up.all_main)
    other = any(b.content and not b.furniture and (b.named is None or b.named.all_main) for b in found)
    for element in names:
        own = 0 if element.main or element.article and not other else element.named
        element.believed = max(own, element.up.believed if element.up else 0)
    for block in found:
        believed = block.named.believed if block.named else 0
        if believed:
            beside = other and not block.content
            block.furniture |= believed > 1 or beside or block.words < LONG or block.linked > PLAIN * block.words


class _Page:
    """Builds the flat blocks of one page from its tags and texts, in one pass."""

    def __init__(self) -> None:
        self.found: list[_Block] = []
        self.names: list[_Open] = []
        self.parts: list[str] = []
        self.open: list[_Open] = []
        self.count: dict[str, int] = {}  # open elements by tag
        self.named: _Open | None = None  # the innermost one whose name tells of furniture
        self.furniture = self.content = self.linked = 0
        self.links = self.heading = False

    def text(self, piece: str) -> None:
        self.parts.append(piece)
        if self.links:
            self.linked += len(unescape(piece).split())

    def close(self) -> None:
        if self.parts:
            text = " ".join(unescape("".join(self.parts)).split())
            if text:
                self.found.append(_Block(text, self.linked, self.content > 0, self.furniture > 0, self.heading, self.named))
            self.parts.clear()
        self.linked = 0

    def enter(self, tag: str, marked: bool, named: int) -> None:
        element = _Open(tag, marked, named, self.named)
        self.furniture += marked
        self.content += tag in CONTENT
        self.open.append(element)
        self.count[tag] = self.count.get(tag, 0) + 1
        if named:
            self.named = element
            self.names.append(element)
        if tag in CONTENT:
            outer = self.named
            while outer is not None and not getattr(outer, tag):  # further out it is known already
                setattr(outer, tag, True)
                outer = outer.up

    def leave(self) -> str:
        element = self.open.pop()
        self.furniture -= element.marked
        self.content -= element.tag in CONTENT
        self.count[element.tag] -= 1
        if element.named:
            self.named = element.up
        return element.tag

    def innermost(self) -> str | None:
        return self.open[-1].tag if self.open else None

    def begin(self, tag: str, attrs: str) -> None:
        if tag == "a":
            self.links = True
        elif tag == "br":
            self.parts.append(" ")
        elif tag not in BLOCKS:
            # An inline element that is furniture stands as a block of its own.
            if tag not in VOID and (named := _named(attrs, self.content > 0)):
                self.close()
                self.enter(tag, False, named)
        else:
            self.close()
            if tag in VOID:
                return
            if self.innermost() == SELF_CLOSING.get(tag, ""):
                self.leave()
            # An article's own header holds its title.
            marked = tag in FURNITURE and not (tag == "header" and self.content)
            named = 0 if tag in ("html", "body") else _named(attrs, self.content > 0 or tag in CONTENT)
            self.enter(tag, marked, named)
            self.heading = tag in HEADINGS
            self.links = False

    def end(self, tag: str) -> None:
        if tag == "a":
            self.links = False
        elif tag == "br":
            self.parts.append(" ")
        elif tag not in BLOCKS:
            if self.innermost() == tag:
                self.close()
                self.leave()
        else:
            self.close()
            if self.count.get(tag):
                while self.leave() != tag:
                    pass
            self.heading = False
            if tag not in ("p", "li"):
                self.links = False


def blocks(page: str) -> list[_Block]:
    """Flat text blocks in page order, in time linear in the page.

    Comments, declarations and elements without readable content are skipped; unended ones run to the
    page's end. A tag that never ends is text, with all that follows.
    """
    out = _Page()
    at, size = 0, len(page)
    skipped, depth, foreign = None, 0, 0  # an element that may hold others of its name
    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            begin = size
        if begin > at and skipped is None:
            out.text(page[at:begin])
        if begin == size:
            break
        match = TAG.match(page, begin)
        if match is None:
            at = begin + 1
            if page.startswith(("<!", "<?"), begin):
                last = next((b for a, b in (("<!--", "-->"), ("<![CDATA[", "]]>")) if page.startswith(a, begin)), ">")
                stop = page.find(last, begin + 2)
                at = size if stop < 0 else stop + len(last)
            elif BEGINS_TAG.match(page, begin):
                at = size
                if skipped is None:
                    out.text(page[begin:])
            elif skipped is None:
                out.text("<")
            continue
        at = match.end()
        tag, ends = match["tag"].lower(), bool(match["end"])
        empty = match["attrs"].endswith("/")
        if tag in RAW and not ends and not (empty and skipped == "svg"):
            stop = END_OF[tag].search(page, at)
            at = stop.end() if stop else size
            if skipped is None:
                out.parts.append(" ")
            continue
        if skipped is not None:
            if tag == skipped:
                depth += -1 if ends else not (empty and skipped == "svg")
            elif skipped == "svg" and tag == "foreignobject":
                foreign += -1 if ends else not empty
            # Blocks end an image that was left open, unless it embeds them.
            if depth and not (skipped == "svg" and foreign <= 0 and tag in BLOCKS and not ends):
                continue
            skipped, depth, foreign, closed = None, 0, 0, not depth
            out.parts.append(" ")
            if closed:
                continue
        if tag in NESTED:
            if not ends and not (empty and tag == "svg"):
                skipped, depth = tag, 1
        elif ends:
            out.end(tag)
        else:
            out.begin(tag, match["attrs"])
    out.close()
    _believe_names(out.found, out.names)
    return out.found


def extract(page: str | None) -> str:
    """The page's main text: blocks the tree keeps, joined by blank lines."""
    if not page:
        return ""
    found = blocks(page)
    shares = [min(1.0, b.linked / b.words) for b in found]
    # Articles that are nothing but linked headings are teasers: the text is elsewhere.
    teasers = all(b.heading and share >= LINKED for b, share in zip(found, shares) if b.content and not b.furniture)
    has_content = not teasers
    kept, decide = [], tree().says
    last = len(found) - 1
    for k, block in enumerate(found):
        row = (
            block.words, shares[k],
            found[k - 1].words if k else 0, shares[k - 1] if k else 0.0,
            found[k + 1].words if k < last else 0, shares[k + 1] if k < last else 0.0,
            block.heading, block.content, has_content and not block.content, block.furniture,
        )
        if decide(row):
            kept.append(block.text)
    return "\n\n".join(kept)


def extract_text(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """Add ``text``: the main text of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [extract(page) for page in batch.column(html).to_pylist()]
            yield with_columns(batch, **{text: pa.array(found, pa.string())})

    return pages.mapInArrow(run, widened(pages.schema, **{text: T.StringType()}))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    found = extract_text(pages.select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
