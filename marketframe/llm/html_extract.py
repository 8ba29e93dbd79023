"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one per block element, with containers left as empty
lines.  A line counts with its text length, or with nothing if it lies in a
container that holds no article text (menus, headers, footers, side bars, notices,
adverts, forms, comments), or if it mostly consists of links.  Where <article> or
<main> holds most of the page's other text, lines outside count nothing.  Over the
sums of a sliding window of lines, a surge opens a run of text and a dive to nothing
closes it; the counting lines between them are the text, and so are the other counting
lines of the container that holds all runs, however short, and headings right before
the first run.

Defined results: null html counts as empty and gives an empty text; a page without
a surge gives all its counting lines; broken markup closes where a browser would
close it, an unclosed script or comment at the end of the page; an empty table gives
no rows; repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import html as html_entities
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from marketframe.llm.common import pick, table
from marketframe.llm.registry import query
from marketframe.llm.tokens import Rows, rows_of

#: Lines per window, and the window's text length that makes a surge.
WINDOW = 3
SURGE = 80
#: Share of a line's characters in links from which it is a menu line.
LINKED = 0.6

# Fixed sets of HTML: elements without content, with raw content, and block elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe svg math object canvas".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav "
    "ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = BLOCK - set("h1 h2 h3 h4 h5 h6 p li dd dt td th tr caption summary legend".split())
HEADING = {f"h{i}" for i in range(1, 7)}
#: Elements that never hold article text.
ASIDE = set("nav footer aside form menu dialog select button datalist label head".split())
ROLES = set(
    "navigation banner contentinfo complementary search dialog alertdialog alert form menu "
    "menubar toolbar".split()
)
#: Words of class and id that mark such a container, whatever stands beside them ...
STRONG = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion "
    "cookie cookies consent gdpr newsletter subscribe subscription signup login comment comments "
    "commentlist disqus respond reply replies related recommended recommendations share sharing "
    "social breadcrumb breadcrumbs pagination pager popup modal overlay footer nav navbar "
    "navigation menu form paywall skip trending popular feedback reactions outbrain taboola".split()
)
#: ... and unless it is a layout's modifier ("with-sidebar") or an article's own header.
WEAK = set(
    "sidebar header masthead banner side aside notice notices alert alerts warning widget widgets "
    "search toolbar topbar bottom rail tags meta copyright legal disclaimer".split()
)
MODIFIER = set("with has no without".split())
ARTICLE = set("article post entry story".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _set_aside(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether the element holds no article text."""
    if tag in ASIDE:
        return True
    if tag == "header":
        # the header of an article holds its title
        return not in_article
    if not attributes or tag in ("article", "main", "body", "html"):
        return False
    found = {}
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), a or b or c)
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return True
    if found.get("role", "").lower() in ROLES or _HIDDEN.search(found.get("style", "")):
        return True
    named = f"{found.get('class', '')} {found.get('id', '')}"
    words = {w.lower() for w in _NAME.findall(named)}
    if words & STRONG:
        return True
    weak = words & WEAK
    if not weak or words & MODIFIER:
        return False
    return not (weak == {"header"} and (in_article or words & ARTICLE))


class Lines:
    """Lines of a page: text, link characters, set aside or not, inside an article or not.

    ``places`` has each line's container and whether it is a heading.  Containers are
    numbered as they open, 0 being the page; ``parents`` has the one around each, and
    ``last`` the highest number inside it.
    """

    def __init__(self, page: str):
        self.found: list[tuple[str, int, bool, bool]] = []
        self.texts: list[str] = []
        self.linked = 0
        self.places: list[tuple[int, bool]] = []
        self.parents, self.last, self.here = [0], [0], 0
        # open elements as (name, set aside, article, container), and how many of each kind
        self.open: list[tuple[str, bool, bool, int]] = []
        # where the open elements of a name stand, and the open blocks: no search on any tag
        self.at: defaultdict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []
        self.aside = self.articles = self.links = self.headings = 0
        self._read(page)
        self._pop(0)
        self.last[0] = len(self.parents) - 1

    def _read(self, page: str) -> None:
        at, end = 0, len(page)
        while at < end:
            found = _TOKEN.search(page, at)
            if not found:
                self._text(page[at:])
                break
            if found.start() > at:
                self._text(page[at : found.start()])
            at = found.end()
            closing, name, attributes = found[1], found[2], found[3]
            if name is None:
                closing, name, attributes = found[4], found[5], found[6]
            if name is None:
                continue
            name = name.lower()
            if closing:
                self._end(name)
            elif name in RAW:
                if not attributes.endswith("/"):
                    close = re.compile(rf"</{name}[^>]*(?:>|\Z)", re.I).search(page, at)
                    at = close.end() if close else end
            else:
                self._start(name, attributes)
        self._line()

    def _text(self, raw: str) -> None:
        text = html_entities.unescape(raw) if "&" in raw else raw
        self.texts.append(text)
        if self.links:
            self.linked += len(text.strip())

    def _line(self, container: bool = False) -> None:
        text = " ".join("".join(self.texts).split())
        if text:
            self.found.append((text, self.linked, self.aside > 0, self.articles > 0))
        elif container:
            self.found.append(("", 0, True, self.articles > 0))
        if len(self.places) < len(self.found):
            self.places.append((self.here, self.headings > 0))
        self.texts, self.linked = [], 0

    def _start(self, name: str, attributes: str) -> None:
        if self.open and self.open[-1][0] == "head" and (name == "body" or name in BLOCK):
            # the end tag of the head may be left out
            self._pop(len(self.open) - 1)
        if name in BLOCK:
            self._close_paragraph(name)
            self._line(name in CONTAINER)
        if name in VOID:
            self.texts.append(" ")
            return
        if attributes.endswith("/") and name not in BLOCK:
            return
        aside = _set_aside(name, attributes, self.articles > 0)
        if aside and self.texts:
            # text before an inline advert is not part of it
            self._line()
        article = name in ("article", "main")
        inside = self.here
        if name in CONTAINER:
            inside = len(self.parents)
            self.parents.append(self.here)
            self.last.append(inside)
        self.here = inside
        self.at[name].append(len(self.open))
        if name in BLOCK:
            self.blocks.append(len(self.open))
        self.open.append((name, aside, article, inside))
        self.headings += name in HEADING
        self.aside += aside
        self.articles += article
        self.links += name == "a"

    def _close_paragraph(self, name: str) -> None:
        """A block closes an open paragraph, an item its open predecessor."""
        if self.blocks:
            k = self.blocks[-1]
            opened = self.open[k][0]
            if opened == "p" or (opened == name and name in ("li", "dd", "dt", "td", "th", "tr")):
                self._pop(k)

    def _end(self, name: str) -> None:
        if name in BLOCK:
            self._line(name in CONTAINER)
        if not self.at.get(name):
            return
        k = self.at[name][-1]
        if name not in BLOCK and self.blocks and self.blocks[-1] > k:
            return
        if self.open[k][1]:
            self._line()
        self._pop(k)

    def _pop(self, k: int) -> None:
        if any(x[1] for x in self.open[k:]):
            self._line()
        for name, aside, article, inside in self.open[k:]:
            self.last[inside] = len(self.parents) - 1
            self.headings -= name in HEADING
            self.aside -= aside
            self.articles -= article
            self.links -= name == "a"
            self.at[name].pop()
            if name in BLOCK:
                self.blocks.pop()
        del self.open[k:]
        self.here = self.open[-1][3] if self.open else 0


def weights(lines: list[tuple[str, int, bool, bool]], linked: float = LINKED) -> list[int]:
    """What each line counts: its length, or nothing where it is no article text."""
    own = {True: 0, False: 0}
    for text, links, aside, article in lines:
        if not aside and links < linked * len(text):
            own[article] += len(text) - links
    # teasers or comments may be the only <article>s of a page
    named = any(text and article and not aside for text, _, aside, article in lines)
    named = named and own[True] >= own[False]
    out = []
    for text, links, aside, article in lines:
        if aside or (named and not article):
            out.append(0)
        elif not named and links >= linked * len(text):
            out.append(0)
        else:
            # an article's own line surges however short it is
            out.append(len(text) + (SURGE if named else 0))
    return out


def text_runs(counts: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """Line ranges from each surge of the windowed sums to the dive after it."""
    sums = [sum(counts[i : i + window]) for i in range(len(counts))]
    runs, start = [], None
    for i, total in enumerate(sums):
        if start is None and total >= surge and counts[i]:
            start = i
        elif start is not None and total == 0:
            runs.append((start, i))
            start = None
    if start is not None:
        runs.append((start, len(counts)))
    return runs or [(0, len(counts))]


def chosen(page: Lines, counts: list[int]) -> list[int]:
    """Numbers of the lines that are the text."""
    runs = text_runs(counts)
    held = [i for start, stop in runs for i in range(start, stop) if counts[i]]
    if not held:
        return held
    first, last = (f(page.places[i][0] for i in held) for f in (min, max))
    around = first
    while page.last[around] < last:
        around = page.parents[around]
    taken = set(held)
    taken.update(
        i
        for i, (inside, _) in enumerate(page.places)
        if counts[i] and around <= inside <= page.last[around]
    )
    for i in range(min(taken) - 1, -1, -1):
        if counts[i]:
            if not page.places[i][1]:
                break
            taken.add(i)
    return sorted(taken)


def main_text(page: str | None) -> str:
    lines = Lines(page or "")
    return "\n".join(lines.found[i][0] for i in chosen(lines, weights(lines.found)))


_TEXT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = Rows(_TEXT)
    for page_id, url, page in rows_of(batches, "page_id", "url", "html"):
        text = main_text(page)
        if out.add((page_id, url, text), len(text)):
            yield out.batch()
    yield out.batch()


def extract_text(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """``page_id, url, text`` per page."""
    rows = pick(pages, page_id=page_id, url=url, html=html)
    rows = rows.withColumn("page_id", F.col("page_id").cast("long"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string")


@query("op7_line_block_text")
def op7_line_block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).withColumn(
        "n_chars", F.char_length("text").cast("long")
    )
