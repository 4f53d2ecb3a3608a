"""HTML extraction: flat text blocks, judged with their neighbours by a decision tree.

A page becomes a flat list of text blocks. Each block is described by its words and
its link density, by those of the blocks before and after it, and by what it stands
in. A small decision tree, trained on a short labelled table of pages, tells main text
from the rest.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallywright.llm.html_table import PAGES
from tallywright.llm.tasks import arrow_map, batch

# Names of elements.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol "
    "p pre search section summary table tbody td tfoot th thead tr ul".split()
)
SKIPPED = set(
    "script style head noscript template svg math iframe object canvas audio video textarea select "
    "option button title map datalist".split()
)
RAW = {"script", "style", "textarea", "title", "iframe", "noscript"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CONTENT = {"article", "main"}
ADDED = {"nav", "footer", "aside", "menu", "dialog", "search"}
#: Headers and forms may be around an article, or a part of it.
MAYBE = {"header", "form"}
ITEMS = ("li", "td", "th", "dt", "dd")
#: Elements that an unclosed paragraph or item ends at, by what is opened.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

# Words of class, id and role names. A name that is such a word tells what the
# element is; one that only holds it may tell what stands beside, as in has-sidebar.
_BAD = (
    r"(?:ad|ads|adv|advert\w*|banner\w*|sponsor\w*|promo\w*|sidebar\w*|side|menu\w*|nav\w*|breadcrumb\w*|"
    r"cookie\w*|consent\w*|notice\w*|gdpr|popup\w*|modal\w*|overlay\w*|comment\w*|disqus\w*|repl(?:y|ies)|"
    r"share\w*|social\w*|related\w*|recommend\w*|newsletter\w*|subscri\w*|signup|login|footer\w*|header\w*|"
    r"masthead|widget\w*|toolbar\w*|pagination|pager|tags?|copyright|legal|disclaimer|search\w*|form\w*|"
    r"navigation|complementary|contentinfo|alert\w*|dialog)"
)
_PARTS = r"(?:area|bar|block|body|box|container|content|inner|item|lists?|outer|section|text|thread|wrap|wrapper|\d+)"
BAD_NAMES = re.compile(rf"(?:^|[_-]){_BAD}(?=$|[_-])", re.IGNORECASE)
BAD_ITSELF = re.compile(rf"{_BAD}(?:[_-]{_PARTS})*", re.IGNORECASE)
COMMENT = re.compile(rf"(?:comments?|repl(?:y|ies))(?:[_-]{_PARTS})*", re.IGNORECASE)
#: What names the head of an article as well as that of a page.
HEAD = re.compile(r"(?:[a-z]+[_-])*(?:header|head|title|masthead)", re.IGNORECASE)
GOOD_NAMES = re.compile(
    r"(?:^|[\s_-])(?:article\w*|content|entry\w*|post|post-?body|story\w*|main\w*|body|text|page-?content)(?=$|[\s_-])",
    re.IGNORECASE,
)
#: An element that holds more than this share of a page's words is no addition to it,
#: whatever its name; one that is itself named so, if the article stands within.
MOST_OF_PAGE = 0.5

#: Attributes as the standard reads them: a value without quotes may hold some.
_TAG = re.compile(
    r"<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)"
    r"(?P<attrs>(?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+|(?=>)))?+|=)*+)>"
)
_TAG_START = re.compile(r"</?[a-zA-Z]")
_PLAIN_TAG = re.compile(r"<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>[^>]*+)>")
_TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|(?P<text>[^<]+|<)",
    re.DOTALL,
)
_NAMES = re.compile(r"(?:^|[\s/\"'])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.IGNORECASE)

FEATURES = (
    "words", "link_density", "words_before", "links_before", "words_after", "links_after",
    "in_content", "in_boilerplate", "heading", "page_has_content", "good_name", "item",
)


@dataclass
class Region:
    """An element that tells something of what stands in it."""

    parent: Region | None = None
    #: "article": main content; "good": named like it; "added": by its kind no part of it; "named":
    #: by its name; "maybe": by a part of its name, or as forms and headers are.
    kind: str = ""
    words: int = 0
    holds_article: bool = False
    in_content: bool = False
    added: bool = False
    maybe: bool = False
    good: bool = False

    def settle(self, total: int) -> None:
        """Tell what holds in it, once the words of all regions are known and its parent is settled."""
        up = self.parent or _NOTHING
        most = self.words > MOST_OF_PAGE * total
        resets = self.kind in ("article", "good")
        self.in_content = up.in_content or self.kind == "article"
        self.added = up.added or self.kind == "added" or (self.kind == "named" and not (most and self.holds_article))
        self.maybe = (up.maybe and not resets) or (self.kind == "maybe" and not most)
        self.good = up.good or self.kind == "good"


_NOTHING = Region()


@dataclass
class Block:
    text: str
    words: int
    link_density: float
    region: Region
    heading: bool
    item: bool
    label: bool | None = None


class _Open:
    """An open block element, with the inline elements opened within it."""

    __slots__ = ("inline", "name", "region")

    def __init__(self, name: str, region: Region) -> None:
        self.name, self.region = name, region
        self.inline: dict[str, list[str]] = {}


class _Flattener:
    """Open elements of a page, and the blocks found so far.

    Whatever is asked of the open elements is counted, so a page of any depth takes time
    in proportion to its length.
    """

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.regions: list[Region] = []
        self.open = [_Open("", Region())]
        self.counts: Counter[str] = Counter()
        self.articles = 0
        #: Kinds of the inline elements that are open.
        self.inline: Counter[str] = Counter()
        #: Text, whether it is a link, whether it is named as no part of the article.
        self.pieces: list[tuple[str, bool, bool]] = []
        self.label: bool | None = None

    @property
    def region(self) -> Region:
        return self.open[-1].region

    def flush(self) -> None:
        if not self.pieces:
            return
        text = " ".join("".join(piece for piece, *_ in self.pieces).split())
        if text:
            words = len(text.split())
            linked = sum(len(piece.split()) for piece, link, _ in self.pieces if link)
            region = self.region
            if all(named or not piece.strip() for piece, _, named in self.pieces):
                region = Region(region, "named")
                self.regions.append(region)
            region.words += words
            self.blocks.append(
                Block(
                    text,
                    words,
                    min(linked / words, 1.0),
                    region,
                    any(self.counts[name] for name in HEADINGS),
                    any(self.counts[name] for name in ITEMS),
                    self.label,
                )
            )
        self.pieces = []

    def start(self, name: str, attrs: str) -> None:
        inline = name not in BLOCKS
        if not inline:
            self.flush()
            self.end_implied(name)
        if name in VOID or attrs.rstrip().endswith("/"):
            return
        kind = self._kind(name, attrs)
        region = self.region
        self.counts[name] += 1
        if inline:
            self.open[-1].inline.setdefault(name, []).append(kind)
            self.inline[kind] += 1
            return
        if kind:
            region = Region(region, kind)
            self.regions.append(region)
        self.open.append(_Open(name, region))
        if kind == "article":
            self.articles += 1

    def _kind(self, name: str, attrs: str) -> str:
        names = " ".join(a or b or c for a, b, c in _NAMES.findall(attrs)).split() if attrs else []
        if attrs and _HIDDEN.search(attrs):
            return "added"
        if name in CONTENT:
            return "named" if any(COMMENT.fullmatch(own) for own in names) else "article"
        if name in ("body", "html"):
            return ""
        if name in ADDED:
            return "added"
        if self.articles:
            names = [own for own in names if not HEAD.fullmatch(own)]
        if any(BAD_ITSELF.fullmatch(own) for own in names):
            return "named"
        if any(BAD_NAMES.search(own) for own in names) or (name in MAYBE and not (name == "header" and self.articles)):
            return "maybe"
        return "good" if any(GOOD_NAMES.search(own) for own in names) else ""

    def end_implied(self, name: str) -> None:
        if self.counts["p"]:
            self.close("p")
        ends = CLOSES.get(name)
        if ends and any(self.counts[end] for end in ends):
            for at in range(len(self.open) - 1, 0, -1):
                if self.open[at].name in ends:
                    self._pop_to(at)
                    return
                if self.open[at].name in ("ul", "ol", "dl", "table", "menu"):
                    return

    def close(self, name: str) -> None:
        """Close an element and what was left open in it; an end without a start is ignored."""
        if not self.counts[name]:
            return
        if name not in BLOCKS:
            opened = self.open[-1].inline.get(name)
            if opened:
                self.inline[opened.pop()] -= 1
                self.counts[name] -= 1
            return
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].name == name:
                self._pop_to(at)
                return

    def _pop_to(self, at: int) -> None:
        while len(self.open) > at:
            gone = self.open.pop()
            self.counts[gone.name] -= 1
            for name, opened in gone.inline.items():
                self.counts[name] -= len(opened)
                self.inline.subtract(opened)
            if gone.region.kind == "article" and gone.region is not self.region:
                self.articles -= 1

    def text(self, value: str) -> None:
        if value and not self.inline["added"]:
            self.pieces.append((value, self.counts["a"] > 0, self.inline["named"] > 0))

    def end(self) -> list[Block]:
        self.flush()
        for region in reversed(self.regions):
            region.parent.words += region.words
            region.parent.holds_article |= region.holds_article or region.kind == "article"
        total = sum(block.words for block in self.blocks)
        for region in self.regions:
            region.settle(total)
        return self.blocks


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page, in order."""
    flat, at, skipping = _Flattener(), 0, []
    page = page.replace("\0", " ")
    last = page.rfind(">")
    while at < len(page):
        found = None
        if _TAG_START.match(page, at):
            if at > last:  # a tag that is never finished
                break
            found = _TAG.match(page, at) or _PLAIN_TAG.match(page, at)
        tag = found is not None
        found = found or _TOKEN.match(page, at)
        at = found.end()
        if tag:
            name = found["name"].lower()
            if found["close"]:
                if skipping:
                    if name in skipping:
                        del skipping[skipping.index(name) :]
                    continue
                if name in BLOCKS:
                    flat.flush()
                flat.close(name)
            elif skipping:
                if name == "body" and skipping == ["head"]:
                    skipping = []
                    flat.start(name, found["attrs"])
                elif name in SKIPPED and name not in VOID and not found["attrs"].rstrip().endswith("/"):
                    if name in RAW:
                        at = _end_of(page, name, at)
                    else:
                        skipping.append(name)
            elif name in RAW:
                at = _end_of(page, name, at)
            elif name in SKIPPED:
                if not found["attrs"].rstrip().endswith("/"):
                    skipping.append(name)
                flat.text(" ")
            elif name in ("br", "wbr", "img", "input"):
                flat.text(" " if name != "wbr" else "")
            else:
                flat.start(name, found["attrs"])
        elif skipping:
            continue
        elif found["text"]:
            flat.text(html.unescape(found["text"]))
        elif found["cdata"]:
            flat.text(found["cdata"])
        elif found["comment"] in ("main", "rest"):
            flat.flush()
            flat.label = found["comment"] == "main"
    return flat.end()


def _end_of(page: str, name: str, at: int) -> int:
    """Where the end tag of an element of raw text ends; the end of the page if there is none."""
    end = re.compile(rf"</{name}[\s/>]", re.IGNORECASE).search(page, at)
    if end is None:
        return len(page)
    close = page.find(">", end.start())
    return len(page) if close < 0 else close + 1


def features_of(blocks: list[Block]) -> np.ndarray:
    """One row of ``FEATURES`` per block."""
    words = [0, *(min(block.words, 200) for block in blocks), 0]
    links = [0.0, *(block.link_density for block in blocks), 0.0]
    has_content = any(block.region.in_content for block in blocks)
    return np.array(
        [
            (
                words[at + 1], links[at + 1], words[at], links[at], words[at + 2], links[at + 2],
                block.region.in_content, block.region.added or block.region.maybe, block.heading, has_content,
                block.region.good, block.item,
            )
            for at, block in enumerate(blocks)
        ],
        float,
    ).reshape(-1, len(FEATURES))


@dataclass
class Node:
    """A node of a decision tree: a leaf, or a feature that is compared with a threshold."""

    share: float
    feature: int = -1
    threshold: float = 0.0
    below: Node | None = None
    above: Node | None = None

    def judge(self, rows: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(rows), self.share)
        low = rows[:, self.feature] <= self.threshold
        out = np.empty(len(rows))
        out[low], out[~low] = self.below.judge(rows[low]), self.above.judge(rows[~low])
        return out


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 7, least: int = 2) -> Node:
    """A tree that splits where the two sides are least mixed; ties go to the first feature."""
    node, best = Node(float(labels.mean()) if len(labels) else 0.0), None
    if depth == 0 or len(labels) < 2 * least or node.share in (0.0, 1.0):
        return node
    for feature in range(rows.shape[1]):
        values = np.unique(rows[:, feature])
        for threshold in (values[1:] + values[:-1]) / 2:
            low = rows[:, feature] <= threshold
            sides = labels[low], labels[~low]
            if min(map(len, sides)) < least:
                continue
            mixed = sum(len(side) * side.mean() * (1 - side.mean()) for side in sides)
            if best is None or mixed < best[0] - 1e-12:
                best = mixed, feature, float(threshold), low
    if best is None or best[0] >= len(labels) * node.share * (1 - node.share) - 1e-12:
        return node
    _, node.feature, node.threshold, low = best
    node.below = grow(rows[low], labels[low], depth - 1, least)
    node.above = grow(rows[~low], labels[~low], depth - 1, least)
    return node


def trained(pages: list[str] = PAGES) -> Node:
    """The tree of the labelled table."""
    rows, labels = [], []
    for page in pages:
        blocks = blocks_of(page)
        rows.append(features_of(blocks))
        labels += [bool(block.label) for block in blocks]
    return grow(np.concatenate(rows), np.array(labels, float))


def main_text(page: str, tree: Node) -> str:
    """The main text of a page: its main blocks, one a line."""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    return "\n".join(
        block.text for block, share in zip(blocks, tree.judge(features_of(blocks)), strict=True) if share >= 0.5
    )


def _extract(tree):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [main_text(page or "", tree.value) for page in part.column("html").to_pylist()]
            yield batch(
                page_id=part.column("page_id"),
                url=part.column("url"),
                text=pa.array(texts, pa.string()),
                n_chars=np.array([len(text) for text in texts], np.int64),
            )

    return run


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages``, from its whole ``html``.

    A null or empty page, or one without main text, gives an empty text. Broken markup is
    read as far as it can be; an end without a start is ignored. Repeated rows each give a
    row, null ids and addresses stay null, other columns are ignored, an empty table
    gives no rows.
    """
    tree = pages.sparkSession.sparkContext.broadcast(trained())
    return arrow_map(
        pages.select("page_id", "url", "html"),
        _extract(tree),
        "page_id long, url string, text string, n_chars long",
    )
