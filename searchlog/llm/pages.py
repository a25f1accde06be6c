"""Main text of web pages by the distribution of text over lines (operator 12).

Markup is stripped so that every block of a page (paragraph, heading, list item, table cell, …) becomes one line, and what is no
part of an article (menus, headers, footers, sidebars, notices, adverts, forms, comments) becomes blank lines. The lengths of lines are then
summed over a sliding window. Where the sum falls to zero the text dives, where it rises again it surges; the lines from a surge to
the next dive are one stretch of text. Stretches whose windows reach enough characters are kept.

What a page says about itself comes first: if it names its article, everything else is blank, and within a single named article any
text is a surge, so that short paragraphs beside an advert stay. Text in links doesn't count, which keeps plain lists of links
from making a stretch.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from searchlog.llm.common import bounded_batches

#: Lines in a window.
WINDOW = 3

#: Characters in a window from which a stretch of text is kept, if the page doesn't name one article.
SURGE = 80

#: Markup, in the order in which it is tried: comments, elements whose content is no markup, declarations, tags. A quote only counts
#: after an equals sign, so that an apostrophe in a tag doesn't swallow the page. What is left open goes to the end of the page.
MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)
    |<(?P<raw>script|style|textarea|title|iframe|noembed|noframes|xmp)(?=[\s/>])(?:[^<>=]|=\s*(?:"[^"]*+"|'[^']*+'|))*+>.*?(?:</(?P=raw)\s*>|\Z)
    |<[!?][^>]*(?:>|\Z)
    |<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/<>]*+)(?P<attributes>(?:[^<>=]|=\s*(?:"[^"]*+"|'[^']*+'|))*+)>""",
    re.DOTALL | re.IGNORECASE | re.VERBOSE,
)

ATTRIBUTE = re.compile(r"""([a-zA-Z][-\w:]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

#: Parts of a name such as "site-footer", "entry_content" or "cookieNotice".
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Elements that stand on lines of their own.
BLOCKS = frozenset(
    """address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table
    tbody td template tfoot th thead tr ul""".split()
)

#: Elements without content.
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())

#: Elements that are no part of an article, and the roles that say so of any element.
OUTSIDE = frozenset(
    "aside audio button canvas datalist dialog footer form menu nav noscript object search select svg template video".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())

#: First or last words of the names of such parts.
NAMES = frozenset(
    """ad ads adbox adslot advert adverts advertisement advertisements advertising adsbygoogle adsense alert aside banner breadcrumb
    breadcrumbs comment comments commentlist consent cookie cookies disclaimer discussion disqus footer form gdpr login masthead menu modal
    nav navbar navigation newsletter notice notices notification notifications pager pagination popup promo promoted promotion rail
    recommended related replies reply respond responses search share sharing sidebar signup skip social sponsor sponsored subscribe
    subscription teaser toolbar topbar widget widgets""".split()
)

#: A name with one of these tells how the page is laid out around the element ("no-sidebar", "comments-open").
LAYOUT = frozenset("closed disabled enabled has hide is layout no off on open with without".split())

#: Elements whose id doesn't tell what they are for.
ANCHORED = frozenset("a dd dt h1 h2 h3 h4 h5 h6 li p td th".split())

#: Names of the element that holds the article, where no element of that kind does.
ARTICLES = frozenset(
    """article article-body article-content article-text articlebody blog-post content content-body entry entry-content main main-content
    maincontent post post-body post-content post-text story story-body story-content storybody""".split()
)

#: A new one of these ends an open one beside it.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
            "option": ("option",)}
LISTS = frozenset("ul ol menu dl table tbody thead tfoot select".split())


class Element:
    """An open element: whether it is outside the article, and the article that it is or lies in."""

    __slots__ = ("tag", "outside", "article")

    def __init__(self, tag: str, outside: bool, article: tuple[int, int] | None) -> None:
        self.tag, self.outside, self.article = tag, outside, article


class Line:
    __slots__ = ("text", "weight", "article")

    def __init__(self, text: str, weight: int, article: tuple[int, int] | None) -> None:
        self.text, self.weight, self.article = text, weight, article


BLANK = Line("", 0, None)


def _names(attributes: dict[str, str]) -> list[str]:
    return f"{attributes.get('class', '')} {attributes.get('id', '')}".split()


def _is_header(words: list[str]) -> bool:
    """Whether a name is that of the page's header and not of an article's."""
    return "header" in (words[0], words[-1]) and not {"article", "entry", "post", "story"}.intersection(words)


def _is_outside(tag: str, attributes: dict[str, str], article: tuple[int, int] | None) -> bool:
    """Whether an element of this kind, or of this name, is no part of an article."""
    if tag in OUTSIDE or attributes.get("role", "").lower() in ROLES:
        return True
    if tag in ("html", "body", "main") or (tag == "header" and article is None):
        return tag == "header"
    if tag == "article" and article is not None and article[0] == 0:
        return True  # an article in an article is a reader's comment, or another page's
    # A heading's or paragraph's id is an anchor: "related-work" is about its text.
    names = attributes.get("class", "").split() if tag in ANCHORED else _names(attributes)
    for name in names:
        words = [word.lower() for word in WORD.findall(name)]
        if words and not LAYOUT.intersection(words):
            if words[0] in NAMES or words[-1] in NAMES or (article is None and _is_header(words)):
                return True
    return False


def _article_rank(tag: str, attributes: dict[str, str]) -> int | None:
    """How surely an element holds the article: 0 most, None if nothing says so."""
    if tag == "article" or attributes.get("role", "").lower() == "article" or "articlebody" in attributes.get("itemprop", "").lower():
        return 0
    if tag == "main" or attributes.get("role", "").lower() == "main":
        return 1
    return 2 if tag in ("div", "section", "td") and any(n.lower().replace("_", "-") in ARTICLES for n in _names(attributes)) else None


class Page:
    """The lines of a page. ``Line.article`` is the rank and number of the element that a line lies in."""

    def __init__(self, html: str) -> None:
        self.lines: list[Line] = []
        self.text: list[str] = []
        self.plain: list[str] = []
        self.open = [Element("", False, None)]
        self.count: Counter[str] = Counter()  # open elements by tag, so that none is looked for in vain
        self.links = self.articles = 0
        at = 0
        for mark in MARKUP.finditer(html):
            if mark.start() > at:
                self._characters(html[at : mark.start()])
            at = mark.end()
            if mark["tag"]:
                self._tag(mark["tag"].lower(), mark["end"] == "/", mark["attributes"])
        self._characters(html[at:])
        self._end_line()

    def _characters(self, raw: str) -> None:
        if not self.open[-1].outside:
            text = entities.unescape(raw) if "&" in raw else raw
            self.text.append(text)
            if not self.links:
                self.plain.append(text)

    def _end_line(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                weight = sum(len(word) for word in "".join(self.plain).split())
                self.lines.append(Line(text, weight, self.open[-1].article))
            self.text, self.plain = [], []

    def _blank(self) -> None:
        self.lines += [BLANK] * WINDOW

    def _tag(self, tag: str, end: bool, raw: str) -> None:
        if tag == "a":
            self.links = 0 if end else 1
        if tag == "br":
            self._characters(" ")
        block = tag in BLOCKS
        if block:
            self._end_line()
        if end:
            for n in range(len(self.open) - 1, 0, -1) if self.count[tag] else ():
                if self.open[n].tag == tag:
                    self._close(n)
                    break
                if not block and self.open[n].tag in BLOCKS:
                    break  # an end tag of an inline element doesn't end a block
            return
        if block:
            self._end_siblings(tag)
        if tag in EMPTY:
            return
        attributes = {}
        if raw:
            for name, *values in ATTRIBUTE.findall(raw):
                attributes.setdefault(name.lower(), "".join(values))
        above = self.open[-1]
        outside = above.outside or _is_outside(tag, attributes, above.article)
        if not block and not (outside and not above.outside):
            return
        rank = None if outside else _article_rank(tag, attributes)
        article = above.article
        if rank is not None and (article is None or rank < article[0]):
            self.articles += 1
            article = (rank, self.articles)
        if block and article is not above.article:
            self._blank()
        self.open.append(Element(tag, outside, article))
        self.count[tag] += 1

    def _end_siblings(self, tag: str) -> None:
        """A block ends the paragraph that it stands in; a list item or cell ends the one before it."""
        if not any(self.count[name] for name in ("p", *SIBLINGS.get(tag, ()))):
            return
        for n in range(len(self.open) - 1, 0, -1):
            name = self.open[n].tag
            if name == "p" or name in SIBLINGS.get(tag, ()):
                self._close(n)
                if name == "p":
                    continue
            if name in LISTS or (name in BLOCKS and name != "p" and tag not in SIBLINGS):
                return

    def _close(self, n: int) -> None:
        """End the open elements from a place on."""
        ended = self.open[n]
        self.count.subtract(element.tag for element in self.open[n:])
        del self.open[n:]
        if ended.tag in BLOCKS and (ended.outside != self.open[-1].outside or ended.article is not self.open[-1].article):
            self._blank()


def stretches(weights: list[int], window: int = WINDOW) -> list[tuple[int, int, int]]:
    """First line, line after the last, and greatest window sum of each stretch of lines between a surge and a dive.

    Text surges where the window that begins with a line has some after there was none, and dives where it has none again; a stretch
    begins and ends with a line that counts.
    """
    found, start, best = [], None, 0
    for i in range(len(weights) + 1):
        total = sum(weights[i : i + window])
        if total and start is None:
            start, best = next(n for n in range(i, i + window) if weights[n]), 0
        best = max(best, total)
        if start is not None and not total:
            found.append((start, i, best))
            start = None
    return found


def main_text(html: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The blocks of the page's article, one on each line; an empty text if there is no text. See ``with_main_text``."""
    lines = Page(html).lines if html else []
    named = [line.article for line in lines if line.article]
    rank = min(named)[0] if named else None
    articles = {article for article in named if article[0] == rank}
    if articles:
        lines = [line if line.article in articles else BLANK for line in lines]
    if len(articles) == 1:
        surge = 1
        found = stretches([len(line.text) for line in lines], window)
    else:
        found = stretches([line.weight for line in lines], window)
    least = min(surge, max((best for _, _, best in found), default=0))
    kept = [line.text for start, end, best in found if best >= least for line in lines[start:end]]
    return "\n".join(text for text in kept if text)


def _extracted(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in pages:
        texts = [main_text(page.as_py()) for page in batch]
        yield pa.StructArray.from_arrays(
            [pa.array(texts, pa.string()), pa.array([len(text) for text in texts], pa.int64())], names=["text", "n_chars"]
        )


def with_main_text(df: DataFrame, html: str | Column = "html") -> DataFrame:
    """Every row with ``text``, the main text of its page, and ``n_chars``, the number of its code points.

    The text holds whole blocks in page order, joined by line feeds. In a block, character references are decoded as HTML 5 does,
    white space of any kind is one space, and a line break element counts as white space. Null and empty pages, and pages without
    text outside menus and the like, have an empty text. Nothing is shuffled; a page is read once, whole, whatever its length. Unclosed
    elements end with the block they stand in, an unclosed comment or script at the end of the page. Repeated rows stay
    repeated, and input columns named ``text`` or ``n_chars`` are replaced.
    """
    bounded_batches(df.sparkSession)
    extracted = F.arrow_udf(_extracted, "struct<text string, n_chars bigint>")
    rows = df.withColumn("_page", extracted(F.col(html) if isinstance(html, str) else html))
    return rows.withColumns({"text": F.col("_page.text"), "n_chars": F.col("_page.n_chars")}).drop("_page")


def op12_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return with_main_text(pages).select("page_id", "url", "text", "n_chars")
