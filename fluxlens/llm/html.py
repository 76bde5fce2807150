"""Main text of web pages by the distribution of text over line blocks."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, map_texts

#: Sliding window in lines, and the characters in a window at which text surges.
WINDOW, SURGE = 3, 86
#: The same within an article that the page marks.
MARKED = 10

# fixed values: elements
#: Their content is no text of the page.
_DROPPED = frozenset(
    "script style noscript template head title iframe object svg math canvas select textarea button form "
    "nav aside footer menu dialog audio video map datalist".split()
)
#: Their content runs to the end tag whatever stands in it.
_RAW = frozenset("script style textarea title iframe noscript xmp".split())
_BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p "
    "pre search section summary table tbody td tfoot th thead tr ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold text rather than parts of a page.
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th caption figcaption span em strong b i a code cite q mark small sub sup".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element of the left is closed by a start tag of the right.
_CLOSES = {
    "p": _BLOCKS - {"br"},
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "option": frozenset({"option", "optgroup"}),
    "td": frozenset({"td", "th", "tr"}),
    "th": frozenset({"td", "th", "tr"}),
    "tr": frozenset({"tr"}),
}
#: Words of class, id and role that mark what isn't part of an article.
_SIDE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|newsletter|subscribe|"
    r"nav|navbar|navigation|menus?|breadcrumbs?|sidebar|side|widget|footer|masthead|topbar|header|share|sharing|social|"
    r"related|recommended|comments?|commentlist|respond|replies|disqus|popup|modal|overlay|signup|login|search|"
    r"complementary|contentinfo|skip|pagination|pager|toolbar|tags)(?:$|[\s_-])"
)
#: The same for article elements.
_NO_ARTICLE = re.compile(r"comment|reply|replies|respond|related|promo|advert|sponsor|teaser")
#: Name and attributes of a tag, up to its end.  Neither goes beyond the next ``<``, so no character is tried often.
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
_REST = re.compile(r"(?:[^>\"'<]++|\"[^\"<]*+\"|'[^'<]*+')*+>")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\bhidden\b")
_SPACE = re.compile(r"\s+")


@dataclass
class Line:
    """A block's text; ``inside``: it stands in an article element; ``linked``: its characters in links; ``heading``: it is one."""

    text: str
    inside: bool
    linked: int
    heading: bool = False


def _aside(tag: str, attributes: str, inside: bool) -> bool:
    """True if the element holds no article text."""
    if tag in _DROPPED or tag == "header" and not inside:
        return True
    if not attributes or tag in ("body", "html", "main"):
        return False
    marks = _NO_ARTICLE if tag == "article" else _SIDE
    for m in _ATTRIBUTE.finditer(attributes):
        name = (m[1] or "hidden").lower()
        value = (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id") and inside and tag in _TEXT:
            continue  # a paragraph of the article, whatever it is called
        if name == "class" and inside:  # one word among others says nothing against text within an article
            if (words := value.split()) and all(map(marks.search, words)):
                return True
        elif name in ("class", "id", "role", "data-role", "aria-label") and marks.search(value):
            return True
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, text, rest) of the page in order: ``text``; ``start`` and ``end`` tags, with name and attributes.

    Comments and declarations are left out, and what elements of raw text hold.  A ``<`` that begins none of
    these, or that no ``>`` follows, is text.  Each character is gone through a few times at most.
    """
    at = seen = 0
    last = page.rfind(">")
    while (i := page.find("<", at)) >= 0:
        if i > last and not page.startswith("<!--", i):
            break  # no tag ends behind this place
        stop = None
        if page.startswith("<!--", i):
            stop = page.find("-->", i + 4) + 3
            stop = len(page) if stop < 3 else stop
        elif page.startswith("<![CDATA[", i):
            stop = page.find("]]>", i)
            inner = page[i + 9 : len(page) if stop < 0 else stop]
            stop = len(page) if stop < 0 else stop + 3
            yield "text", page[seen:i] + entities.escape(inner), ""
            at = seen = stop
            continue
        elif page.startswith(("<!", "<?"), i):
            stop = page.find(">", i) + 1
        elif m := _NAME.match(page, i):
            whole = _REST.match(page, m.end())
            stop = whole.end() if whole else page.find(">", m.end()) + 1
            if seen < i:
                yield "text", page[seen:i], ""
            name = m[1].lower()
            closing = page[i + 1] == "/"
            yield "end" if closing else "start", name, page[m.end() : stop - 1]
            at = seen = stop
            if name in _RAW and not closing:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
                close = page.find(">", end.end()) + 1 if end else 0
                if name in _DROPPED:
                    at = seen = close or len(page)
                    yield "end", name, ""
                elif not close:
                    at = seen = len(page)
            continue
        if stop is None:
            at = i + 1
            continue
        if seen < i:
            yield "text", page[seen:i], ""
        at = seen = stop
    if seen < len(page):
        yield "text", page[seen:], ""


def lines_of(page: str) -> list[Line]:
    """The page's blocks in order, markup stripped."""
    out: list[Line] = []
    parts: list[str] = []
    open_tags: list[tuple[str, bool]] = []  # (element, it holds no article text)
    places: dict[str, list[int]] = {}  # of the open elements of each name
    blocks: list[int] = []  # places of open block elements
    dropped = inside = links = linked = headings = 0

    def end_block() -> None:
        nonlocal linked
        if parts:
            if text := _SPACE.sub(" ", entities.unescape("".join(parts))).strip():
                out.append(Line(text, inside > 0, linked, headings > 0))
            parts.clear()
        linked = 0

    def close(at: int) -> None:
        nonlocal dropped, inside, links, headings
        while len(open_tags) > at:
            tag, side = open_tags.pop()
            places[tag].pop()
            if tag in _BLOCKS:
                blocks.pop()
            dropped -= side
            inside -= tag in ("article", "main")
            links -= tag == "a"
            headings -= tag in _HEADINGS

    for kind, tag, rest in tokens(page):
        if kind == "text":
            if not dropped:
                parts.append(tag)
                linked += len(tag) if links else 0
            continue
        if tag in _BLOCKS:
            end_block()
        if kind == "end":
            if places.get(tag):
                close(places[tag][-1])
            continue
        if open_tags and tag in _CLOSES.get(open_tags[-1][0], ()):
            close(len(open_tags) - 1)
        elif tag in _BLOCKS and tag != "br" and blocks and open_tags[blocks[-1]][0] == "p":
            close(blocks[-1])  # ends an open paragraph, with the inline elements left open in it
        if tag in _VOID or rest.endswith("/") and tag not in _BLOCKS and tag not in _RAW:
            continue
        side = _aside(tag, rest, inside > 0)
        places.setdefault(tag, []).append(len(open_tags))
        if tag in _BLOCKS:
            blocks.append(len(open_tags))
        open_tags.append((tag, side))
        dropped += side
        inside += tag in ("article", "main")
        links += tag == "a"
        headings += tag in _HEADINGS
    end_block()
    return out


def main_lines(lines: list[Line], window: int = WINDOW, surge: int = SURGE, marked: int = MARKED) -> np.ndarray:
    """Which lines belong to the main text.

    A line weighs its characters outside links, and weights are summed over windows of ``window`` lines.  Where a
    window's sum rises to ``surge`` or more, text surges; where it falls to zero, text dives; all lines between
    are kept, from the surge's first heading or line of an even share on.  If no window reaches that, the densest one surges.

    Where a page marks its article, only the lines in the mark are looked at, and no menu stands before the text there:
    text surges in a window of ``marked`` characters, from its first line on.  What has no text of its own for a whole window,
    such as a list of links, is left out there as well.
    """
    kept = np.zeros(len(lines), bool)
    inside = np.flatnonzero([x.inside for x in lines])
    looked_at = inside if len(inside) else np.arange(len(lines))
    own = np.array([max(0, len(lines[i].text) - lines[i].linked) for i in looked_at], np.int64)
    if not own.any():
        return kept
    total = np.r_[0, np.cumsum(own)]
    sums = total[np.minimum(np.arange(len(own)) + window, len(own))] - total[:-1]
    surge = min(marked if len(inside) else surge, int(sums.max()))
    first = np.flatnonzero((own >= (1 if len(inside) else surge / window)) | (own > 0) & np.array([lines[i].heading for i in looked_at]))
    empty = np.flatnonzero(sums == 0)
    high = np.flatnonzero(sums >= surge)
    at = 0
    while (k := int(np.searchsorted(high, at))) < len(high):
        start = int(first[np.searchsorted(first, high[k])])
        dive = int(np.searchsorted(empty, start))
        stop = int(empty[dive]) if dive < len(empty) else len(own)
        kept[looked_at[start:stop]] = True
        at = stop
    return kept


def main_text(page: bytes | None) -> str:
    """Main text of a whole page: its kept lines joined by a space; empty for null."""
    lines = lines_of(page.decode()) if page else []
    return " ".join(x.text for x, keep in zip(lines, main_lines(lines), strict=True) if keep)


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Per page: the columns ``keep``, text, n_chars (code points).

    Null or empty html: empty text, 0.  Rows are independent: repeated ones get a result each.
    """
    name = fresh(keep, "text")
    out = map_texts(pages, lambda texts: [list(map(main_text, texts))], [(name, T.StringType())], keep, text="html")
    return out.withColumn("n_chars", F.char_length(name).cast("long"))
