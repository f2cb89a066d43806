"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block element. Lines of elements that
never hold the article (navigation, adverts, notices, comments and the like)
and lines that are mostly links count as empty. The block length of a line is
the text length of the window of ``WINDOW`` lines from it. A surge is a rise of
the block lengths from nothing to ``SURGE`` or more, a dive where the window has
no text left. The text between a surge and its dive is kept; if no rise is that
large, that of the largest. Article and main elements only settle where such a
run begins and ends: with the element, if it holds half of the run or more.
Without one, the headings right before a run belong to it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

#: Lines of a window, and the block length that makes a surge.
WINDOW = 3
SURGE = 20

#: Elements whose text is no part of an article.
OUTSIDE = frozenset("nav header footer aside form menu select button dialog template head noscript iframe object svg canvas audio video".split())
#: Elements that belong to the article if they stand in one.
PARTS = {"header": ("article", "main"), "aside": ("article",)}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Share of a line's text in links from which it counts as empty.
LINKED = 0.5
#: Elements whose content is not markup.
RAW = "script|style|textarea|title|xmp|noembed|noframes"
#: Elements inside a line.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id or role that mark a place outside the article: a whole name of theirs, or the
#: first part of a name whose other parts are such words or say no more than what kind of box it is.
MARKS = frozenset(
    "ad ads adsbygoogle adsense advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert popup modal overlay"
    " newsletter subscribe signup login sidebar side widget related recommended share sharing social menu nav navbar navigation breadcrumb breadcrumbs"
    " toc pagination pager header masthead footer copyright legal tag tags hidden search".split())
COMMENTS = frozenset("comment commentlist comments replies reply respond disqus".split())
BOXES = frozenset("area bar block box button buttons container form icons item items link links list media posts section slot text thread unit wrapper".split())
PLACES = frozenset("site global main user reader readers".split())
#: Share of the page's text from which an element that is marked by a name is a wrapper of the page, not a part beside the article.
WIDE = 0.75

_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"(?=[\s/>]|\Z)|'[^']*'(?=[\s/>]|\Z)|[\"'])*)(?:>|\Z)", re.S | re.I)
_MARK = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_SIZE = re.compile(r"\d+(?:x\d+)?")
_SPACE = re.compile(r"\s+")


#: Why an element is outside: not by itself, by its kind, as comments; from NAMED on the number of one marked by a name.
INNER, KIND, COMMENT, NAMED = range(4)


class Line(NamedTuple):
    """A line of the page: its text, whether it lies outside the article, the number of its outermost article or main
    element (0: none), whether it is mostly links, and whether it is a heading."""

    text: str
    outside: bool
    home: int
    linked: bool
    heading: bool


def lines(page: str) -> list[Line]:
    """The page's text lines in order."""
    out: list[tuple[str, tuple[int, ...], int, bool, bool]] = []
    parts: list[str] = []
    skip: list[tuple[str, int, int]] = []  # open elements from the outermost that is outside the article: name, why, token
    inside: list[tuple[str, int]] = []  # open article and main elements: name, token
    closed: set[int] | None = None
    named = NAMED
    link, in_links, heading = False, 0, False

    def end() -> None:
        nonlocal in_links
        raw = "".join(parts)
        text = _SPACE.sub(" ", html.unescape(raw)).strip()
        if text:
            out.append((text, tuple(why for _, why, _ in skip if why), inside[0][1] if inside else 0,
                        in_links > LINKED * len("".join(raw.split())), heading))
        parts.clear()
        in_links = 0

    def take(piece: str) -> None:
        nonlocal in_links
        parts.append(piece)
        if link:
            in_links += len("".join(piece.split()))

    at = 0
    for k, token in enumerate(_TOKEN.finditer(page), 1):
        take(page[at:token.start()])
        at = token.end()
        name = token[3].lower() if token[3] else None
        if name is None or name in INLINE:
            if token[1] or name == "br":
                parts.append(" ")
            elif name == "a":
                link = not token[2] and "href" in token[4].lower()
            continue
        end()
        heading = name in HEADINGS and not token[2]
        if name in ("p", "article", "main", "body"):
            link = False
        if token[2]:
            if any(name == n for n, _, _ in skip):
                while skip.pop()[0] != name:
                    pass
            elif any(name == n for n, _ in inside):
                while inside.pop()[0] != name:
                    pass
        elif name in ("article", "main", "body"):
            comments = [i for _, why, i in skip if why == COMMENT]
            if comments and name != "body" and closed is None:
                closed = _closed(page)
            if name != "body" and any(i in closed for i in comments):
                skip.append((name, INNER, k))
                continue
            skip.clear()  # an unclosed element before it does not reach into it
            if name == "article" and _why(name, token[4]) == COMMENT:
                skip.append((name, COMMENT, k))
            elif name != "body":
                inside.append((name, k))
        elif name not in VOID and not token[4].endswith("/"):
            why = _why(name, token[4], any(n in PARTS.get(name, ()) for n, _ in inside))
            if why == NAMED:
                why, named = named, named + 1
            if skip or why:
                skip.append((name, why, k))
    take(page[at:])
    end()
    held = dict.fromkeys(range(NAMED, named), 0)
    for text, whys, *_ in out:
        for why in set(whys) & held.keys():
            held[why] += len(text)
    total = sum(len(text) for text, *_ in out)
    wide = {why for why, n in held.items() if n > WIDE * total}
    return [Line(text, not wide.issuperset(whys), *rest) for text, whys, *rest in out]


def _closed(page: str) -> set[int]:
    """The numbers of the start tags that have an end tag."""
    done: set[int] = set()
    open_: list[tuple[str, int]] = []
    for k, token in enumerate(_TOKEN.finditer(page), 1):
        name = token[3].lower() if token[3] else None
        if name is None or name in INLINE or name in VOID:
            continue
        if not token[2]:
            if not token[4].endswith("/"):
                open_.append((name, k))
        elif any(name == n for n, _ in open_):
            while open_[-1][0] != name:
                open_.pop()
            done.add(open_.pop()[1])
    return done


def _why(name: str, attributes: str, part: bool = False) -> int:
    found = KIND if name in OUTSIDE and not part else INNER
    if not attributes.strip():
        return found
    for a, b, c in _MARK.findall(attributes):
        for word in (a or b or c or "").lower().split():
            first, *rest = [x for x in re.split("[_-]+", word) if x] or [""]
            if rest and (first in PLACES or [first, *rest] == ["page", "footer"]):
                first, *rest = rest
            if (first in MARKS or first in COMMENTS) and all(x in MARKS or x in COMMENTS or x in BOXES or _SIZE.fullmatch(x) for x in rest):
                if first in COMMENTS:
                    return COMMENT
                found = found or NAMED
    return KIND if _HIDDEN.search(attributes) else found


def surges(lengths: list[int]) -> Iterator[tuple[int, int]]:
    """First and last line with text of every run between a surge of the block lengths and its dive."""
    blocks = [sum(lengths[i:i + WINDOW]) for i in range(len(lengths))]
    surge = min(SURGE, max(blocks, default=0))
    rise = 0  # where the blocks last rose from nothing
    for i in range(len(blocks) + 1):
        if i == len(blocks) or not blocks[i]:  # a dive
            if rise < i and max(blocks[rise:i]) >= surge:
                texts = [j for j in range(rise, i) if lengths[j]]
                yield texts[0], texts[-1]
            rise = i + 1


def main_text(page: str | None) -> str:
    """The kept lines, one to a row."""
    found = lines(page or "")
    inner = [0 if x.outside else len(x.text) for x in found]
    lengths = [0 if x.linked else n for x, n in zip(found, inner)]
    kept: set[int] = set()
    for first, last in surges(lengths if any(lengths) else inner):
        run = range(first, last + 1)
        homes = {found[i].home for i in run if inner[i]} - {0}
        kept.update(i for i, x in enumerate(found) if x.home in homes)
        if 2 * sum(inner[i] for i in run if found[i].home) < sum(inner[i] for i in run):
            kept.update(run)
            before = first - 1
            while before >= 0 and (not lengths[before] or found[before].heading):
                if found[before].heading and lengths[before]:
                    kept.add(before)
                before -= 1
    return "\n".join(found[i].text for i in sorted(kept) if inner[i])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points of the text) of every row of ``pages``.

    A null or empty page has empty text. Pages of any length are read whole.
    Repeated rows each get a row; an empty table gives no rows. Other columns
    are not looked at.
    """
    def kernel(_: list, __: list, bodies: list) -> dict:
        return {"text": [main_text(b) for b in bodies]}

    done = arrow_map(pages.select("page_id", "url", "html"), kernel, "text string", ["page_id", "url", "html"], ["page_id", "url"])
    return done.withColumn("n_chars", F.length("text").cast("bigint"))
