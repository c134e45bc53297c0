"""Main text of web pages by two-pass block rules.

A page is cut into blocks of text at block-level tags. The first pass looks at each block
alone: link density and the place in the page (navigation, footers, forms, comments ...)
tell boilerplate, length with stop-word density tells prose, and everything else (short or
unusual blocks) stays ambiguous. In the second pass an ambiguous block inherits the label of
its nearest decided neighbour. Neighbours in the same container come first, a headline
follows what comes after it, and of two equally near ones the preceding one wins; inside an
``article`` or ``main`` without any decided block, and on pages without any, blocks are kept.
Margins inside an article decide nothing but themselves.

Where the long blocks together are poor in stop words, the page is in another language, and
length with few links tells prose. Boilerplate alone never decides a long block. A word of
class, id or role does not mark an element around all articles of the page or, without any
article, around most of its text.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Prose has at least so many characters and such a share of stop words; a block with a
#: larger share of its characters inside links is boilerplate.
LONG, STOPS, LINKS = 60, 0.12, 0.4
#: Characters that a letter of a script without spaces counts for.
DENSE = 3
#: Containers around a block that count as shared with its neighbours.
LEVELS = 32

# Frequent words of English, French, German, Spanish.
STOP_WORDS = frozenset(
    "a about after all also an and any are as at be been but by can could do for from had has have he her his if in "
    "into is it its more no not of on one only or other our out over she so some such than that the their them then "
    "there these they this to up was we were what when which who will with would you your "
    "au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par "
    "pas plus pour que qui sa se ses si son sont sur un une vous "
    "aber als am an auch auf aus bei bis das dass dem den der die durch ein eine einem einen einer es für hat ich ihr "
    "im ist mit nach nicht noch nur oder sein sich sie sind so über um und uns unter von vor war wie wir wird zu zum zur "
    "al como con cuando del desde donde el ella era es esta este hay la las lo los más me mi muy no nos o para pero por "
    "porque que se ser sin sobre su sus también tiene todo un una y ya".split()
)
# Tags that hold no text of the page, tags of its margins, tags that end a block.
SILENT = frozenset("script style noscript template svg iframe object select textarea button head canvas audio video".split())
MARGIN = frozenset("nav header footer aside form menu dialog".split())
CONTAINERS = frozenset("article main section div body td th ul ol dl table blockquote figure details fieldset center".split()) | MARGIN
BLOCKS = CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 li dt dd tr pre address hr caption thead tbody tfoot figcaption summary legend html title option".split()
)
HEADLINES = frozenset("h1 h2 h3 h4 h5 h6".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Open elements that a new one of the key closes, up to the next container.
ENDS = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}}
# Words of class, id and role that mark margins.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner banners nav navbar "
    "navigation menu menus breadcrumb breadcrumbs header masthead footer foot sidebar side aside widget widgets cookie "
    "cookies consent gdpr notice notices alert popup modal overlay comment comments reply replies respond disqus reader "
    "discussion related recommended recommendations share sharing social subscribe subscription newsletter signup login "
    "search pagination pager copyright legal disclaimer toolbar skip contentinfo complementary hidden".split()
)
# Marking words that also name parts or topics of a text. As one word of a longer
# name ("entry-header", "legal-analysis") they mark nothing inside an article.
WEAK = frozenset("header reader discussion search legal hidden foot side skip".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)", re.S
)
_QUOTE_OR_END = re.compile(r"[>\"']")
# Names begin where no character of a name stands before and are possessive: linear in any tag.
_ATTRIBUTE = re.compile(r"""(?<![a-zA-Z_:-])([a-zA-Z_:-]++)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_WORDS = re.compile(r"[^\W\d_]+")
_SPLIT = re.compile(r"[^a-z0-9]+")
_IDEOGRAPHS = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7a3\U00020000-\U0003ffff]")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _marked(attributes: str, article: bool) -> bool:
    """Do words of class, id or role mark an element as margin?

    Inside an article a weak word counts as a whole name or beside another marking word only.
    """
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = next(filter(None, values), "")
        if name.lower() not in ("class", "id", "role"):
            continue
        for token in value.split():
            words = [w for w in _SPLIT.split(_CAMEL.sub("-", token).lower()) if w]
            marks = MARKS.intersection(words)
            if marks and not (article and marks <= WEAK and len(marks) < len(words)):
                return True
    return False


def _hidden(attributes: str) -> bool:
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = next(filter(None, values), "")
        name = name.lower()
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        elif name == "aria-hidden" and value.lower() == "true":
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attributes))


def _tag_end(html: str, at: int) -> int:
    """The position after a tag's ``>``, which quotes hide; a tag that never ends takes the rest."""
    while found := _QUOTE_OR_END.search(html, at):
        if found[0] == ">":
            return found.end()
        quote = html.find(found[0], found.end())
        at = quote + 1 if quote >= 0 else found.end()
    return len(html)


class _Open:
    """The open elements: containers, text blocks, links and marked inline elements."""

    def __init__(self):
        # Tag, number, margin, article, link.
        self.stack: list[tuple[str, int, bool, bool, bool]] = [("", 0, False, False, False)]
        # Marked elements: the outer one of each, and those around each article; 0 is none.
        self.outer: dict[int, int] = {0: 0}
        self.marks: list[int] = [0]
        self.articles: list[int] = []
        self.count: Counter = Counter()
        self.numbers = 0

    @property
    def top(self):
        return self.stack[-1]

    def containers(self) -> tuple[int, ...]:
        """Numbers of the innermost containers, outermost first; the page is 0."""
        found = []
        for tag, number, *_ in reversed(self.stack):
            if not tag or tag in CONTAINERS:
                found.append(number)
                if len(found) == LEVELS:
                    break
        return tuple(reversed(found))

    def push(self, tag: str, attributes: str) -> None:
        page = tag in ("html", "body", "article", "main")
        marked, hidden = _marked(attributes, self.top[3]), not page and _hidden(attributes)
        if tag not in BLOCKS and tag != "a" and not (marked or hidden) and not self.count[tag]:
            return
        self.numbers += 1
        _, _, margin, article, link = self.top
        mark = self.marks[-1]
        if marked and not page:
            self.outer[self.numbers], mark = mark, self.numbers
        margin = margin or hidden or (tag in MARGIN and not (tag == "header" and article))
        if tag in ("article", "main") and not margin and not marked:
            self.articles.append(mark)
        self.marks.append(mark)
        self.stack.append((tag, self.numbers, margin, article or tag in ("article", "main"), link or tag == "a"))
        self.count[tag] += 1

    def margins(self, sizes: Counter) -> dict[int, bool]:
        """Is what the innermost mark ``key`` covers margin? ``sizes`` has the characters right below each."""
        held, inside = Counter(sizes), Counter(self.articles)
        for mark in reversed(self.outer):
            if mark:
                held[self.outer[mark]] += held[mark]
                inside[self.outer[mark]] += inside[mark]
        found = {0: False}
        for mark, outer in self.outer.items():
            if mark:
                wraps = inside[mark] == inside[0] if inside[0] else 2 * held[mark] > held[0]
                found[mark] = found[outer] or not wraps
        return found

    def pop(self, tags: set[str], across: bool) -> None:
        """Close the innermost element of ``tags``, not across a container unless told so."""
        if not any(self.count[t] for t in tags):
            return
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth][0] in tags:
                for tag, *_ in self.stack[depth:]:
                    self.count[tag] -= 1
                del self.stack[depth:], self.marks[depth:]
                return
            if self.stack[depth][0] in CONTAINERS and not across:
                return


def blocks_of(html: str) -> list[tuple[str, int, tuple[int, ...], bool, bool, bool]]:
    """The page's blocks: text, characters in links, containers, headline, margin, in an article.

    Containers are numbered; the tuple leads from the outer to the innermost one. Unclosed
    elements end with their container.
    """
    out, text, marks, opened = [], [], [], _Open()
    linked, headline, at = 0, False, 0

    def close():
        nonlocal linked, headline
        joined = " ".join(unescape("".join(text)).split())
        if joined:
            out.append((joined, linked, opened.containers(), headline, *opened.top[2:4]))
            marks.append(opened.marks[-1])
        text.clear()
        linked, headline = 0, False

    def add(piece: str):
        nonlocal linked
        text.append(piece)
        if opened.top[4]:
            linked += len(" ".join(unescape(piece).split()))

    while match := _TOKEN.search(html, at):
        add(html[at : match.start()])
        at = match.end()
        if not match[2]:
            if match[0].startswith("<![CDATA["):
                add(match[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag, closing = match[2].lower(), bool(match[1])
        at = _tag_end(html, at)
        attributes = html[match.end() : at - 1]
        alone = attributes.endswith("/")
        if tag in SILENT and not closing and not alone:
            ends = _silent_end(tag).search(html, at)
            at = ends.end() if ends else len(html)
            text.append(" ")
            continue
        if tag in BLOCKS:
            close()
        elif tag == "br":
            text.append(" ")
        if closing:
            opened.pop({tag}, tag in CONTAINERS)
        elif tag not in EMPTY and not alone:
            opened.pop(ENDS.get(tag, {"p"} if tag in BLOCKS else set()), False)
            opened.push(tag, attributes)
            headline = headline or tag in HEADLINES
    add(html[at:])
    close()
    sizes = Counter()
    for block, mark in zip(out, marks):
        if not block[4]:
            sizes[mark] += len(block[0])
    margins = opened.margins(sizes)
    return [(*b[:4], b[4] or margins[mark], b[5]) for b, mark in zip(out, marks)]


def _silent_end(tag: str) -> re.Pattern:
    return re.compile(r"</head\s*>|(?=<body[\s>])" if tag == "head" else rf"</{tag}\s*>", re.I)


def main_text(html: str | None) -> str:
    """The kept blocks in page order, one a line."""
    blocks = blocks_of(html or "")
    labels: list[bool | None] = []
    long: list[bool] = []
    all_stops = all_words = 0
    for text, linked, _, _, margin, _ in blocks:
        words = _WORDS.findall(text.lower())
        stops = sum(w in STOP_WORDS for w in words)
        dense = 0 if text.isascii() else len(_IDEOGRAPHS.findall(text))
        long.append(len(text) + (DENSE - 1) * dense >= LONG)
        if margin or linked > LINKS * len(text):
            labels.append(False)
            continue
        labels.append(True if len(text) >= LONG and words and stops >= STOPS * len(words) else None)
        if long[-1]:
            all_stops, all_words = all_stops + stops, all_words + len(words)
    if all_stops < STOPS * all_words:
        labels = [True if label is None and rich else label for label, rich in zip(labels, long)]

    n = len(blocks)
    # Nearest decided block before and after each, overall and inside the same container.
    nearest: list[list] = [[None] * 4 for _ in range(n)]
    for side, order in ((0, range(n)), (1, range(n - 1, -1, -1))):
        last, inside = None, {}
        for i in order:
            home = blocks[i][2][-1] if blocks[i][2] else 0
            nearest[i][side], nearest[i][2 + side] = last, inside.get(home)
            # An advert or a form inside an article says nothing about the text around it.
            if labels[i] is not None and not (blocks[i][4] and blocks[i][5]):
                last = i
                for container in blocks[i][2]:
                    inside[container] = i

    def inherited(i: int) -> bool:
        headline, article = blocks[i][3], blocks[i][5]
        before, after, before_in, after_in = nearest[i]
        if before_in is None and after_in is None:
            if article or (before is None and after is None):
                return True
        else:
            before, after = before_in, after_in
        if long[i] and not any(labels[k] for k in (before, after) if k is not None):
            return True
        if headline and after is not None:
            return labels[after]
        if before is None or (after is not None and after - i < i - before):
            return labels[after]
        return labels[before]

    kept = [inherited(i) if label is None else label for i, label in enumerate(labels)]
    return "\n".join(b[0] for b, keep in zip(blocks, kept) if keep)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page.

    ``pages`` needs ``page_id, url, html``; other columns are ignored. A null or empty page
    and one without kept blocks have an empty text. Null ids and repeated rows pass, one row
    each; an empty table gives an empty result. A page is handled whole, in time in
    proportion to its length.
    """
    @F.pandas_udf("string")
    def text(html: pd.Series) -> pd.Series:
        return html.map(main_text, na_action=None)

    return pages.select("page_id", "url", text(F.col("html").cast("string")).alias("text")).withColumn(
        "n_chars", F.length("text").cast("long")
    )
