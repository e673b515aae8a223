"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block of text.  Text in boilerplate
(menus, headers, footers, sidebars, notices, adverts, forms, comments) leaves
blank lines.  Lengths are summed over sliding windows of lines; the text
between a surge of that sum and the dive after it is kept.  Elements only weigh
lines and say where they belong together.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Lines of a window.
WINDOW_LINES = 3
#: Characters outside links that a window needs for a surge.
SURGE_CHARS = 80
#: Where an article holds half of a page's characters outside links, those outside of it count for one in so many.
OUTSIDE = 4
#: Of longer class names and ids only the parts in their last so many characters count.
NAME_CHARS = 100

# Names from the HTML standard and usual class names.
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that hold running text, and those whose lines belong together.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption dd".split())
BOXES = frozenset("html body main article section div td fieldset center details".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset(
    "aside audio button canvas datalist dialog fieldset footer form head iframe menu nav noembed noframes noscript option "
    "script search select style svg template textarea title video xmp".split()
)
HINTS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|comments?|disqus\w*|respond|replies|cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|signup|login|"
    r"nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|widget|footer|header|masthead|topbar|toolbar|social|share|sharing|related|recommended|pagination|pager|skip|copyright|legal|disclaimer)(?=$|[\s_-])",
    re.I,
)
#: Words after a hint that name its box only, and words that make a name tell of a layout ("has-sidebar", "side-by-side").
_BOXES = re.compile(r"(?:[-_]+(?:list|wrap|wrapper|container|bar|box|inner|area|section|block|links?|left|right|top|bottom|\d+))+$", re.I)
_LAYOUT = re.compile(r"(?:^|[_-])(?:has|with|without|no|by)(?=[_-])", re.I)
#: Articles that aren't the page's own, and heads that belong to the article.
ASIDES = re.compile(r"(?:^|[\s_-])(?:comments?|related|recommended|promo\w*|sponsor\w*|advert\w*|ads?|teaser)(?=$|[\s_-])", re.I)
OWN_HEADS = re.compile(r"(?:^|[\s_-])(?:article|entry|post|story|content)[_-]?(?:header|head|title|body|content|text)(?=$|[\s_-])", re.I)
_QUOTE = re.compile(r"(?:^|[_-])(?:pull)?quote(?=$|[_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_TAG = re.compile(r"</?([A-Za-z][^\s/>]*)")
_PLAIN_END = re.compile(r"[^>\"']*+>")
_END = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_SPACE = re.compile(r"\s+")
#: Elements that an opening tag of the same kind closes.
_SELF_CLOSING = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


def _tail(name: str) -> str:
    """A class name or id, of a long one its last whole parts."""
    return name if len(name) <= NAME_CHARS else re.split(r"[_-]", name[-NAME_CHARS:], maxsplit=1)[-1]


def _hint(value: str) -> int:
    """2 if one of the names in a class or id is a hint, 3 if one ends in a hint, else 0."""
    found = [_BOXES.sub("", x) for x in map(_tail, value.split()) if not _LAYOUT.search(x)]
    if any(m.end() == len(x) for x in found if (m := HINTS.match(x))):
        return 2
    return 3 if any(m.end() == len(x) for x in found for m in HINTS.finditer(x)) else 0


def _boilerplate(tag: str, attributes: str, inside: bool) -> int:
    """0: no, 1: yes, 2 or 3: a hint says so, as in ``_hint``. ``inside``: whether an article or main element is open."""
    if tag in HIDDEN and not (tag == "aside" and inside):
        return 1
    if tag == "header":
        return int(not inside)
    if not attributes or tag in ("html", "body"):
        return int(tag == "aside")
    found: dict[str, str] = {}
    for k, v in _ATTRIBUTE.findall(attributes):
        found.setdefault(k.lower(), v.strip("\"'"))
    if "hidden" in found:
        return 1
    if tag == "aside":  # a quote of the story may stand in one
        return int(not any(_QUOTE.search(y) for k in ("class", "id") for y in found.get(k, "").split()))
    if tag in ("main", "p", "h1", "h2", "h3", "h4", "h5", "h6", "b", "i", "em", "strong", "a"):
        return 0
    if found.get("role", "").lower() in ROLES or found.get("aria-hidden", "").lower() == "true":
        return 1
    if re.search(r"display\s*+:\s*+none|visibility\s*+:\s*+hidden", found.get("style", ""), re.I):
        return 1
    names = [found.get(k, "") for k in ("class", "id")]
    own = [_tail(y) for x in names for y in x.split()]
    if tag == "article":
        return int(any(ASIDES.search(y) for y in own if not _LAYOUT.search(y)))
    if any(OWN_HEADS.search(y) for y in own):
        return 0
    return min(filter(None, map(_hint, names)), default=0)


class Line(NamedTuple):
    """A block's text; blank where boilerplate stood."""

    text: str
    free: int = 0  #: characters outside links
    inside: bool = False  #: in an article or main element
    prose: bool = False  #: in a paragraph, heading or the like
    box: int = -1  #: the container it lies in


_BLANKS = [Line("")] * WINDOW_LINES


def tokens(page: str) -> Iterator[tuple[str, str, bool, int]]:
    """(tag or "" for text, text or attributes, whether a tag closes, place), in time linear in the page.

    Comments, declarations and the content of raw elements are left out.  A
    quote that never closes is an ordinary character of its tag.
    """
    n, text_from, at, open_quotes = len(page), 0, 0, set()
    while True:
        lt = page.find("<", at)
        if lt < 0:
            yield "", page[text_from:], False, text_from
            return
        name = _TAG.match(page, lt)
        if not name and page[lt + 1 : lt + 2] not in ("!", "?"):
            at = lt + 1
            continue
        if lt > text_from:
            yield "", page[text_from:lt], False, text_from
        if not name:
            mark, close = next(((m, c) for m, c in (("<!--", "-->"), ("<![CDATA[", "]]>")) if page.startswith(m, lt)), ("<!", ">"))
            end = page.find(close, lt + len(mark))
            text_from = at = n if end < 0 else end + len(close)
            continue
        plain = _PLAIN_END.match(page, name.end())
        end = plain.end() - 1 if plain else name.end()
        while not plain:
            found = _END.search(page, end)
            if not found:
                end = n
                break
            end = found.start()
            if page[end] == ">":
                break
            close = -1 if page[end] in open_quotes else page.find(page[end], end + 1)
            if close < 0:
                open_quotes.add(page[end])
            end = max(end, close) + 1
        tag, closes = name[1].lower(), page[lt + 1] == "/"
        yield tag, page[name.end() : end], closes, lt
        text_from = at = min(n, end + 1)
        if tag in RAW and not closes:
            raw = _RAW_END[tag].search(page, at)
            text_from = at = raw.end() if raw else n


_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?", re.I) for tag in RAW}


def lines(page: str) -> list[Line]:
    """The lines of a page.

    A hint hides no element that holds the page's own text: its first main
    element, or else its first article, or, on pages without these, if the
    hint is only the end of a name, over half of the characters outside links.
    Where hints would hide all text, the one that hides most is passed over.
    """
    hints: dict[int, list[int]] = {}
    out = _lines(page, None, hints)
    if not hints:
        return out
    every = sum(x.free for x in out)
    own = any(x.inside and x.text for x in out)
    spared = {i for i, (kind, chief, free) in hints.items() if chief or kind == 3 and not own and 2 * free > every}
    if len(spared) == len(hints):
        return out
    left = _lines(page, spared, {})
    if not any(x.text for x in left):
        left = _lines(page, spared | {max(hints, key=lambda i: (hints[i][2], -i))}, {})
    return left if any(x.text for x in left) else out


def _lines(page: str, spared: set[int] | None, hints: dict[int, list[int]]) -> list[Line]:
    """As ``lines``; only elements in ``spared`` (None: all) are shown against a hint.

    ``hints`` gets, by the place of its tag, (kind, whether it holds the page's own article, characters outside links) of each shown element with a hint.
    """
    out: list[Line] = []
    text: list[str] = []
    linked = hidden = free = 0
    stack: list[tuple[str, bool, int, int]] = []  # open elements, whether they are boilerplate, the place of a tag in hints, the container
    open_tags: Counter[str] = Counter()
    chief = ""

    def inside() -> bool:
        return open_tags["article"] + open_tags["main"] > 0

    def close_line() -> None:
        nonlocal linked
        line = _SPACE.sub(" ", "".join(text)).strip()
        if line:
            out.append(Line(line, max(0, len(line) - linked), inside(), any(open_tags[t] for t in PROSE), stack[-1][3] if stack else -1))
        text.clear()
        linked = 0

    def pop() -> None:
        nonlocal hidden
        tag, plain, hint, _ = stack.pop()
        open_tags[tag] -= 1
        if hint >= 0:
            hints[hint][2] += free
        if plain:
            hidden -= 1
            if not hidden:
                out.extend(_BLANKS)

    for tag, content, closes, place in tokens(page):
        if not tag:
            if content and not hidden:
                piece = html.unescape(content)
                text.append(piece)
                shown = len(_SPACE.sub(" ", piece).strip())
                if open_tags["a"]:
                    linked += shown
                else:
                    free += shown
            continue
        if tag in BLOCKS:
            close_line()
        if closes:
            if open_tags[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in VOID or content.endswith("/"):
            continue
        if tag in RAW:
            if not hidden:
                close_line()
                out.extend(_BLANKS)
            continue
        if tag in _SELF_CLOSING:
            while stack and stack[-1][0] in _SELF_CLOSING[tag]:
                pop()
        elif tag in BLOCKS and stack and stack[-1][0] == "p":
            pop()
        kind = _boilerplate(tag, content, inside())
        plain, hint = kind == 1, -1
        if kind > 1 and not hidden:
            plain = spared is not None and place not in spared
            if spared is None:
                hint = place
                hints[hint] = [kind, 0, -free]
        elif kind:
            plain = True
        if plain:
            close_line()
            if not hidden:
                out.extend(_BLANKS)
            hidden += 1
        stack.append((tag, plain, hint, place if tag in BOXES else stack[-1][3] if stack else -1))
        open_tags[tag] += 1
        if not hidden and (tag == "main" and chief != "main" or tag == "article" and not chief):
            chief = tag
            for x in hints.values():
                x[1] = 0
            for _, _, i, _ in stack:
                if i >= 0:
                    hints[i][1] = 1
    close_line()
    while stack:
        pop()
    return out


def main_text(page: str | None) -> str:
    """The kept blocks of a page in order, joined by one space; empty if there are none.

    A line weighs its characters outside links.  Where article or main elements
    hold half of these or more, each line in them makes a surge of its own, and
    a line outside counts for one in OUTSIDE; otherwise such elements don't
    count.  Weights are summed over windows of lines.  A run goes from where the
    sum rises above nothing to where it dives to nothing, and is kept if it
    surges to SURGE_CHARS.  From the ends of a run short lines go that are no
    prose (paragraphs, headings and the like).  Short prose that lies in the
    same container as kept lines stays: an advert or script between them isn't
    the end.  Where nothing surges, the heaviest run stays, the first of equals.
    """
    if not page:
        return ""
    got = lines(page)
    within = sum(x.free for x in got if x.inside)
    trusted = any(x.inside and x.text for x in got) and 2 * within >= sum(x.free for x in got)
    if trusted:
        weights = [SURGE_CHARS + x.free if x.inside and x.text else x.free / OUTSIDE for x in got]
    else:
        weights = [float(x.free) for x in got]
    sums = [sum(weights[i : i + WINDOW_LINES]) for i in range(len(got))]
    runs, start = [], None
    for i in range(len(got) + 1):
        alive = i < len(got) and sums[i] > 0
        if alive and start is None:
            start = i
        elif not alive and start is not None:
            runs.append((start, i))
            start = None
    kept = [(a, b) for a, b in runs if max(sums[a:b]) >= SURGE_CHARS] or sorted(runs, key=lambda r: (-sum(weights[r[0] : r[1]]), r[0]))[:1]
    chosen: set[int] = set()
    for a, b in kept:
        own = [i for i in range(a, b) if got[i].text]
        light = lambda i: weights[i] < SURGE_CHARS / 2 and not (got[i].prose and got[i].free)
        heavy = [k for k, i in enumerate(own) if not light(i)] or [0, len(own) - 1]
        chosen.update(own[heavy[0] : heavy[-1] + 1])
    boxes = {got[i].box for i in chosen if got[i].inside or not trusted}
    chosen.update(i for i, x in enumerate(got) if x.text and x.prose and x.free and x.box in boxes)
    return " ".join(got[i].text for i in sorted(chosen))


def page_texts(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` -> ``page_id, url, text, n_chars``, a row for each row.

    Null and empty pages and pages without text have an empty text.  Damaged
    markup is read on a best effort, in time linear in its length: unclosed
    elements close at the end.  Repeated rows and page ids count each; other
    columns are ignored; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = [main_text(x) for x in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
