"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block of the page. A line's weight is
its length, more for a line in a paragraph, heading or list, less for loose text
where a page has enough of the other; lines that are mostly links weigh nothing.
Sums of weights over a sliding window of lines rise at a surge point, where
running text begins, and fall to nothing at a dive point; the text between them
is kept. This is one law for all pages, whether they name an article or not.

Menus, footers, forms and hidden parts are no lines. Nor is an element whose
class or id says that it is boilerplate, unless it holds the page's own text: its
main part, its largest article, its headline, or, where it names none of these,
most of its text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Lines in a window, and the weight in it that makes a surge.
WINDOW_LINES = 3
SURGE_CHARS = 86
#: What a line in a paragraph, heading or list weighs more: a window of short ones is running text too.
ROLE_CHARS = 24
#: What loose text weighs less on pages that have at least as much text in such elements.
LOOSE_LESS = SURGE_CHARS // 2
#: Above this share of link text a line weighs nothing.
LINK_SHARE = 0.5

_SKIPPED = frozenset("head nav footer aside form noscript template button select textarea iframe object svg canvas audio video dialog menu".split())
_NEVER = frozenset("html body article main".split())
_ROLE_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre td th figcaption caption summary".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Words of a class or id that mark boilerplate.
_WORDS = frozenset(
    "ad ads advert advertisement adverts sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal "
    "newsletter subscribe subscription signup sidebar widget widgets related recommended recommendations menu nav navbar navigation "
    "breadcrumb breadcrumbs pagination pager toolbar share sharing social footer copyright masthead topbar header comment comments respond "
    "reply replies disqus discussion reactions search login".split()
)
#: Words that may stand beside such a word in a class or id; any other tells of a subject (social-science).
_LAYOUT = frozenset(
    "site page main top bottom left right item items box wrap wrapper container content section block area list inner outer bar panel unit slot links link form "
    "thread user users reader readers author posts articles stories story more latest popular email mail google native tag tags col row grid fixed sticky small large primary secondary global post article entry blog news my js".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
#: A start of one of these ends an open element of the same kind.
_SIBLINGS = {"li": "li", "dt": "dd dt", "dd": "dd dt", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+[^<>]*+)>"
    r"|<[!?][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+|\d+")


def _attributes(text: str) -> list[tuple[str, str]]:
    if not text or "=" not in text and "hidden" not in text:
        return []
    return [(name.lower(), a or b or c) for name, a, b, c in _ATTRIBUTE.findall(text)]


def _never_shown(tag: str, attributes: list[tuple[str, str]]) -> bool:
    """Tags and attributes that say themselves that this is no part of the text."""
    if tag in _NEVER and tag != "article":
        return False
    return tag in _SKIPPED or any(
        name == "hidden"
        or (name == "aria-hidden" and value.lower() == "true")
        or (name == "style" and "display:none" in value.replace(" ", "").lower())
        or (name == "role" and value.lower() in _ROLES)
        for name, value in attributes
    )


def _says_boilerplate(tag: str, attributes: list[tuple[str, str]]) -> bool:
    """A page's header, or an element whose class or id has words of boilerplate and none of another subject."""
    if tag == "header":
        return True
    if tag in _NEVER and tag != "article":
        return False
    for name, value in attributes:
        for token in value.split() if name in ("class", "id") else ():
            words = [w.lower() for w in _WORD.findall(token)]
            if tag == "article":
                words = words[:1]  # its other words tell of its subject or layout (category-social, has-sidebar)
            if any(w in _WORDS for w in words) and all(w in _WORDS or w in _LAYOUT or len(w) < 3 or w.isdigit() for w in words):
                return True
    return False


_TEXT, _OPEN, _CLOSE, _BREAK = range(4)


def _events(page: str) -> list[tuple]:
    """A page as texts, opened and closed elements (tag, attributes, place) and ends of blocks."""
    out: list[tuple] = []
    stack: list[tuple[str, int]] = []

    def take(text: str) -> None:
        if text:
            out.append((_TEXT, html.unescape(text) if "&" in text else text))

    def pop_to(depth: int) -> None:
        for tag, place in reversed(stack[depth:]):
            out.append((_CLOSE, tag, place))
        del stack[depth:]

    at = 0
    for m in _TOKEN.finditer(page):
        take(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _BLOCKS:
            out.append((_BREAK,))
        elif tag == "br":
            take(" ")
        if tag in _VOID:
            continue
        names = [t for t, _ in stack]
        if m[2]:
            if tag in names:
                pop_to(len(stack) - 1 - names[::-1].index(tag))
            continue
        if tag in _BLOCKS and names and names[-1] == "p":
            pop_to(len(stack) - 1)
        if tag in _SIBLINGS and stack and stack[-1][0] in _SIBLINGS[tag].split():
            pop_to(len(stack) - 1)
        if tag == "body" and "head" in names:
            pop_to(names.index("head"))
        if m[4].endswith("/") and tag not in _BLOCKS:
            continue
        stack.append((tag, m.start()))
        out.append((_OPEN, tag, _attributes(m[4]), m.start()))
    take(page[at:])
    out.append((_BREAK,))
    pop_to(0)
    return out


def _left_out(events: list[tuple]) -> set[int]:
    """The places of the elements that are no part of the text."""
    gone: set[int] = set()
    named: dict[int, str] = {}
    opened: dict[int, tuple[int, int, int]] = {}  # where an element begins: event, characters and headlines before it
    spans: dict[int, tuple[int, int, int, int]] = {}  # its first and last event, its characters and headlines
    articles: list[int] = []
    mains: list[int] = []
    hidden = chars = headlines = 0
    for k, event in enumerate(events):
        if event[0] == _TEXT and not hidden:
            chars += len(event[1])
        elif event[0] == _OPEN:
            _, tag, attributes, place = event
            opened[place] = (k, chars, headlines)
            if _never_shown(tag, attributes):
                gone.add(place)
                hidden += 1
            elif _says_boilerplate(tag, attributes):
                named[place] = tag
            elif tag == "article":
                articles.append(place)
            elif tag == "main":
                mains.append(place)
            headlines += tag == "h1" and not hidden
        elif event[0] == _CLOSE:
            _, tag, place = event
            first, before, heads = opened[place]
            spans[place] = (first, k, chars - before, headlines - heads)
            hidden -= place in gone
    within = lambda inner, outer: outer[0] < inner[0] and inner[1] < outer[1]
    core = spans[mains[0]] if mains else max((spans[a] for a in articles), key=lambda s: (s[2], -s[0]), default=None)
    for place, tag in named.items():
        own = spans[place]
        in_core = core is not None and within(own, core)
        holds = within(core, own) if core else 2 * own[2] > chars
        headline = own[3] > 0 and (in_core or own[3] == headlines)
        if not (holds or headline or (in_core and tag in ("header", "h1", "h2", "h3", "h4", "h5", "h6"))):
            gone.add(place)
    return gone


def lines_of(page: str) -> list[tuple[str, int, bool]]:
    """Each block's text, how many of its characters are links, and whether it stands in an element of running text."""
    events = _events(page)
    gone = _left_out(events)
    lines: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    skipping = links = roles = linked = 0
    for event in events:
        if event[0] == _TEXT:
            if not skipping:
                parts.append(event[1])
                linked += len(event[1]) if links else 0
            continue
        # an element's block ends with it, and where a left out part begins
        if parts and (event[0] == _BREAK or event[-1] in gone):
            text = " ".join("".join(parts).split())
            if text:
                lines.append((text, linked, roles > 0))
            parts, linked = [], 0
        if event[0] != _BREAK:
            step = 1 if event[0] == _OPEN else -1
            skipping += step * (event[-1] in gone)
            links += step * (event[1] == "a")
            roles += step * (event[1] in _ROLE_TAGS)
    return lines


def main_text(page: str | None) -> str:
    """The main text of one page; null, empty and textless pages have none, broken markup is read as far as it goes."""
    lines = lines_of(page or "")
    sized = [(len(text) if linked <= LINK_SHARE * len(text) else 0, role) for text, linked, role in lines]
    loose = sum(n for n, role in sized if not role)
    less = LOOSE_LESS if sum(n for n, role in sized if role) >= loose else 0
    weights = [0 if not n else n + ROLE_CHARS if role else max(0, n - less) for n, role in sized]
    window = [sum(weights[i : i + WINDOW_LINES]) for i in range(len(weights))] + [0]
    surge = min(SURGE_CHARS, max(window) - 1)  # on a page with little text, its fullest window
    kept: list[str] = []
    i = 0
    while i < len(weights):
        if window[i] <= surge or not weights[i]:
            i += 1
            continue
        dive = i  # from this surge to where a whole window has no text
        while dive < len(weights) and window[dive] > 0:
            dive += 1
        kept += [text for (text, _, _), weight in zip(lines[i:dive], weights[i:dive], strict=True) if weight]
        i = dive
    return "\n".join(kept)


def extract(pages: DataFrame, markup: str = "html", into: str = "text") -> DataFrame:
    """Add the main text of each page.

    Null or empty markup, and pages without text, give an empty text; broken
    markup is read as far as it goes; pages of any length are read whole.
    Repeated rows give repeated results; a column named like the output is replaced.
    """
    common.bound_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(main_text, na_action=None)

    return pages.withColumn(into, extracted(F.col(f"`{markup}`")))


def pages_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and length in code points of every page; null, empty and broken pages are as in ``extract``, repeated rows and
    null ids and addresses stay as they are, an empty table gives no rows."""
    pages = common.plain(common.table(spark, sf_dir, "pages"), "page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
