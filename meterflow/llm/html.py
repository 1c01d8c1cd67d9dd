"""Main text of web pages by the distribution of text over lines: what lies between a surge and a dive is kept."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from meterflow.llm.texts import map_rows, slices

#: Lines of a window, and weight of a window that a text has to surge to.
LINES = 3
SURGE = 80

#: Part of the greatest text's weight that other texts of a page have to reach.
SHARE = 1 / 4

#: What a character weighs in an article element, and in a block whose class or id names what isn't the article.
IN_ARTICLE, NAMED = 8, 1 / 16

PAGES = StructType(
    [
        StructField("page_id", LongType()),
        StructField("url", StringType()),
        StructField("text", StringType(), False),
        StructField("n_chars", LongType(), False),
    ]
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*)",
    re.S,
)
_SPECIAL = re.compile("[<>\"']")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)

#: Elements whose content is no text of the page.
_RAW = frozenset("script style noscript template textarea select svg math iframe object title".split())
_FOREIGN = frozenset(["svg", "math"])
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in _RAW}

#: Elements that end a line.
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody tfoot thead tr ul".split()
)
_SPACES = frozenset("br td th wbr".split()) - {"wbr"}

#: Elements that can hold others and so pass on what they are.
_HOLDERS = _BLOCKS - frozenset("p hr dd dt li option h1 h2 h3 h4 h5 h6 tr".split()) | frozenset(["button", "label"])
_OUTSIDE = frozenset("nav aside footer form menu dialog button search fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())

#: Words of class names and ids that mark what isn't the article.
_SIGNS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promos promotion sidebar sidebars "
    "aside comment comments commentlist disqus replies respond cookie cookies consent gdpr notice notices notification alert banner "
    "menu menus submenu nav navbar navigation navigations breadcrumb breadcrumbs masthead footer foot social share sharing related "
    "recommended recommendations newsletter subscribe subscription popup modal overlay widget widgets login signin signup register searchbox "
    "searchform toolbar pagination pager skip copyright legal disclaimer paywall teaser teasers trending tags taglist".split()
)
_TALK = re.compile(r"(?:\d+\s+)?(?:reader\s+|user\s+)?(?:comments?|responses|kommentare?|commentaires?|comentarios?)\W*(?:\(?\d+\)?)?\W*", re.I)


@dataclass
class Line:
    """One block of text: its parts, how much of it is link text, and where it stands."""

    sign: int
    inside: bool
    holder: int
    heading: bool = False
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def text(self) -> str:
        return " ".join(html.unescape("".join(self.parts)).split())


#: Signs that a line isn't of the article: none, a class or id that says so, an element or role that does.
_NONE, _BY_NAME, _BY_ELEMENT = 0, 1, 2


def _sign(tag: str, attributes: str, in_article: bool) -> int:
    """What marks an element as a menu, header, footer, sidebar, notice, advert, form or reader comments."""
    if tag in _OUTSIDE or tag == "header" and not in_article:
        return _BY_ELEMENT
    sign = _NONE
    if tag in ("html", "body", "article", "main"):
        return sign
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            if not _SIGNS.isdisjoint(re.findall(r"[a-z]+", value)):
                sign = _BY_NAME
        elif name == "role":
            if value.strip() in _ROLES:
                return _BY_ELEMENT
        elif name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return _BY_ELEMENT
        elif name == "hidden" or value == "true":
            return _BY_ELEMENT
    return sign


def _tag_end(page: str, at: int, failed: set[int]) -> int:
    """Place of the sign that ends a tag, or -1. Quotes are read as strings where the tag then ends, else as single characters.

    Quotes in ``failed`` lead to no end; each is tried once for a page, so that broken tags take time in proportion to it.
    """
    todo = [at]
    while todo:
        m = _SPECIAL.search(page, todo.pop())
        if m is None or m[0] == "<" or m.start() in failed:
            continue
        if m[0] == ">":
            return m.start()
        failed.add(m.start())
        todo.append(m.end())
        close = page.find(m[0], m.end())
        if close >= 0:
            todo.append(close + 1)
    return -1


def _token(page: str, at: int, failed: set[int]) -> tuple[re.Match, int, str] | None:
    """The next comment or tag, its end and, of a tag, what stands behind its name."""
    while m := _TOKEN.search(page, at):
        if m[2] is None:
            return m, m.end(), ""
        end = _tag_end(page, m.end(), failed)
        if end >= 0:
            return m, end + 1, page[m.end() : end]
        at = m.start() + 1
    return None


def lines_of(page: str, signs: bool = True) -> tuple[list[Line], list[int]]:
    """Lines of a page in order, and for each element that holds others the one around it. Without ``signs`` elements and names say nothing.

    Comments, scripts, styles and the like are left out. Each block element begins
    a line; line breaks and table cells are white space inside one.
    """
    lines: list[Line] = []
    around = [0]
    stack: list[tuple[str, int, bool, int]] = [("", _NONE, False, 0)]
    open_: Counter[str] = Counter()
    line, links, at, heading = Line(_NONE, False, 0), 0, 0, False
    failed: set[int] = set()

    def sign(tag: str, attributes: str, in_article: bool) -> int:
        return _sign(tag, attributes, in_article) if signs else _NONE

    def begin() -> None:
        nonlocal line
        if line.parts:
            lines.append(line)
        line = Line(*stack[-1][1:])

    def add(text: str) -> None:
        if text:
            line.parts.append(text)
            if links:
                line.linked += len(text)

    while True:
        found = _token(page, at, failed)
        if found is None:
            break
        m, end, rest = found
        add(page[at : m.start()])
        at = end
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                add(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in _RAW:
            # Only foreign elements may close themselves; the slash may also be the end of an address without quotes.
            if not closing and not (tag in _FOREIGN and rest.endswith("/")):
                end = _RAW_END[tag].search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag == "a":
            links = 0 if closing else 1
        if tag in _SPACES:
            add(" ")
        if tag not in _BLOCKS and tag not in _HOLDERS:
            continue
        if closing and heading and tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            heading = False
            if signs and _TALK.fullmatch(line.text()):
                # From here to the end of what holds it are readers' comments.
                line.sign = _BY_ELEMENT
                stack[-1] = (stack[-1][0], _BY_ELEMENT, *stack[-1][2:])
        if tag in _HOLDERS:
            if not closing:
                inside = stack[-1][2] or signs and tag in ("article", "main")
                around.append(stack[-1][3])
                stack.append((tag, max(stack[-1][1], sign(tag, rest, inside)), inside, len(around) - 1))
                open_[tag] += 1
            elif open_[tag]:
                while True:
                    gone = stack.pop()[0]
                    open_[gone] -= 1
                    if gone == tag:
                        break
        begin()
        if not closing and tag not in _HOLDERS:
            line.sign = max(line.sign, sign(tag, rest, line.inside))
        if not closing and tag[0] == "h" and tag[1:].isdigit():
            heading = line.heading = True
    # A "<" that begins no tag is text; a tag that is cut off at the end of the page is not.
    tail = page[at:]
    cut = re.compile(r"<[/!?A-Za-z]").search(tail, tail.rfind(">") + 1)
    add(tail[: cut.start()] if cut else tail)
    begin()
    return lines, around


def _areas(lines: list[Line], around: list[int]) -> list[int]:
    """For each line the part of the page it stands in: a child of the lowest element that holds all lines, 0 for lines between those.

    An element that holds one line alone is no part, but a paragraph.
    """
    held = np.bincount([x.holder for x in lines], minlength=len(around)).tolist()
    for i in range(len(around) - 1, 0, -1):
        held[around[i]] += held[i]
    root = max(i for i, n in enumerate(held) if n == len(lines))
    area = [0] * len(around)
    for i in range(root + 1, len(around)):
        if around[i] == root:
            area[i] = i if held[i] > 1 else 0
        else:
            area[i] = area[around[i]]
    return [area[x.holder] for x in lines]


def main_text(page: str | None, window: int = LINES, surge: int = SURGE, share: float = SHARE, signs: bool = True) -> str:
    """The article of a page, one line for each block.

    A line weighs its length without link text. A text begins where the weights of ``window`` lines together reach ``surge`` (the largest
    such sum, if none does) and ends where they dive to nothing. Parts of the page, the children of the lowest element that holds all of
    it, stand ``window`` empty lines apart, but for a heading before its part. Of these texts those are kept that weigh at least ``share`` of the greatest.

    Elements and class names only change weights: in an ``article`` or ``main`` element a line weighs eight times its whole length, and a
    surge at least, and all its lines stand together; in a block whose class or id names a menu, an advert or the like it weighs a sixteenth, and such
    blocks are texts of their own, which have to reach ``surge`` by their lengths too. Elements and roles that can't hold the article, hidden ones and what stands
    below a heading of comments weigh nothing. ``signs=False`` leaves all of this out.
    """
    lines, around = lines_of(page or "", signs)
    got = [(x, t) for x in lines if (t := x.text()) and x.sign < _BY_ELEMENT]
    if not got:
        return ""
    areas = _areas([x for x, _ in got], around)
    texts: list[tuple[float, list[int]]] = []
    plain = [i for i, (x, _) in enumerate(got) if not x.sign]
    named = [i for i, (x, _) in enumerate(got) if x.sign]
    weights = [float(max(surge, IN_ARTICLE * len(got[i][1])) if got[i][0].inside else _own(*got[i])) for i in plain]
    texts += _texts(got, areas, plain, weights, window, surge, False)
    texts += _texts(got, areas, named, [_own(*got[i]) * NAMED for i in named], window, surge * NAMED, True)
    least = share * max((w for w, _ in texts), default=0.0)
    return "\n".join(got[i][1] for i in sorted(i for w, rows in texts if w >= least for i in rows))


def _own(line: Line, text: str) -> int:
    """Length of a line without link text."""
    return max(0, len(text) - line.linked)


def _texts(
    got: list[tuple[Line, str]], areas: list[int], rows: list[int], weights: list[float], window: int, surge: float, strict: bool
) -> list[tuple[float, list[int]]]:
    """Weight and lines of each text between a surge and a dive among some lines; ``strict``: none where no sum reaches ``surge``."""
    at, place = 0, []
    for k, i in enumerate(rows):
        if k:
            before, line = got[rows[k - 1]][0], got[i][0]
            together = before.inside and line.inside or areas[rows[k - 1]] == areas[i] or before.heading
            at += 1 if together else window + 1
        place.append(at)
    laid = np.zeros(at + window)
    laid[place] = weights
    sums = np.convolve(laid, np.ones(window))[window - 1 :]
    if not rows or not sums.max() or strict and sums.max() < surge:
        return []
    least = min(surge, sums.max())
    texts, open_ = [], False
    for k, i in enumerate(rows):
        if open_ and not sums[(place[k - 1] + 1) : place[k] + 1].all():
            open_ = False
        if not open_ and weights[k] and sums[place[k]] >= least:
            texts.append([0.0, []])
            open_ = True
        if open_:
            texts[-1][0] += weights[k]
            texts[-1][1].append(i)
    return [(w, kept) for w, kept in texts]


def _extract(window: int, surge: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(p, window, surge) for p in part.column("html").to_pylist()]
                yield {
                    "page_id": part.column("page_id"),
                    "url": part.column("url"),
                    "text": texts,
                    "n_chars": np.array([len(t) for t in texts], dtype=np.int64),
                }

    return run


def main_texts(pages: DataFrame, window: int = LINES, surge: int = SURGE) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages`` (``page_id``, ``url``, ``html``; other columns are ignored).

    Null and empty pages, and pages whose text is all of menus, footers and the like, give the empty text. Broken markup is read as far as
    it goes: tags that close nothing are ignored, elements left open end with what holds them. A page of any length is read whole, in time
    in proportion to it. Texts of equal weight are all kept. Repeated rows give equal texts, an empty table none.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return map_rows(rows, _extract(window, surge), PAGES)
