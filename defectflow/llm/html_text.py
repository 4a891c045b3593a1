"""Main text of web pages by the distribution of text over line blocks."""

from __future__ import annotations

import html
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: Elements whose text is never part of an article.
DROPPED = frozenset(
    "script style noscript template head title nav aside footer form iframe svg canvas object audio video "
    "button select textarea dialog menu".split()
)
#: Elements that begin and end a line.
BLOCKS = frozenset(
    "address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hr "
    "html legend li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Words of class, id and role that mark what surrounds an article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar aside footer comment comments commentlist disqus respond cookie cookies consent "
    "gdpr notice notices alert popup modal newsletter subscribe signup share sharing social related recommended "
    "pagination pager widget toolbar search login contentinfo complementary masthead".split()
)
_RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template")
_ARTICLES = ("article", "main")
#: Dropped without a trace: what stands before and after them is one line, or one line with a space.
_INLINE = frozenset("script style noscript template iframe svg canvas object audio video button select textarea".split())
_SILENT = frozenset("script style noscript template".split())
#: Elements around a body; others that are dropped may stand between two of its paragraphs.
_FRAMES = frozenset("nav footer header menu title head".split())
#: Text of an article, whatever its class or id is called.
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption td th dd dt b i em strong code".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SPACED = frozenset(("br", "img"))
_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?=>)|[^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORDS = re.compile(r"[a-z0-9]+")


def _surrounds(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element is menu, notice, advert or the like."""
    if name in DROPPED or (name == "header" and not inside):
        return True
    if not attributes or name in ("html", "body", *_ARTICLES) and "comment" not in attributes.lower():
        return False
    words = set()
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values).lower()
        if key in ("class", "id", "role") and not (inside and name in _PROSE):
            words.update(_WORDS.findall(value))
        elif key == "style" and "display:none" in value.replace(" ", ""):
            return True
        elif key == "aria-hidden" and value == "true":
            return True
    if re.search(r"(?:^|\s)hidden(?:\s|$)", attributes):
        return True
    return not words.isdisjoint(MARKS) or (not inside and "header" in words)


def text_lines(page: str, window: int = 3) -> list[str]:
    """The page as one line per block.

    Menus and the elements around a body leave ``window`` empty lines, the borders of an article twice as many. Other dropped
    elements leave none.
    """
    lines: list[str] = []
    parts: list[str] = []
    linked = at = depth = articles = 0
    links = empty = 0
    dropped = block = ""

    def end_line():
        nonlocal linked, links, empty
        if parts:
            line = " ".join(html.unescape("".join(parts)).split())
            # Outside of articles and paragraphs a line that is mostly links belongs to a menu.
            if line and (articles or block == "p" or 2 * linked <= len(line)):
                lines.append(line)
                empty = 0
            elif line:
                gap()
            parts.clear()
        linked = links = 0

    def gap(times=1):
        nonlocal empty
        if lines and empty < times * window:
            lines.extend([""] * (times * window - empty))
            empty = times * window

    end = len(page)
    while at < end:
        found = _TOKEN.search(page, at)
        stop = found.start() if found else end
        if stop > at and not dropped:
            parts.append(page[at:stop])
            linked += stop - at if links else 0
        if not found:
            break
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        closing = bool(found[1])
        if dropped:
            if name in _ARTICLES and (dropped not in _ARTICLES or not closing and not articles):
                dropped = ""  # an element that was never closed ends where an article begins or ends
            elif name == dropped:
                depth += -1 if closing else 1
                if dropped == "p" or depth <= 0:
                    dropped = ""
                    if closing:
                        continue
            elif dropped == "p" and name in BLOCKS:
                dropped = ""
            if dropped:
                if name in _RAW and not closing:
                    at = _after(page, name, at)
                continue
        if not closing and _surrounds(name, found[3], articles > 0):
            if name not in _INLINE:
                end_line()
                if not articles and name in _FRAMES:
                    gap()
            elif name not in _SILENT:
                parts.append(" ")
            if name in _RAW:
                at = _after(page, name, at)
            elif name not in _VOID and not found[3].endswith("/"):
                dropped, depth = name, 1
            continue
        if name in _ARTICLES:
            end_line()
            if not closing:
                if not articles:
                    gap(2)
                articles += 1
            elif articles:
                articles -= 1
                if not articles:
                    gap(2)
            block = ""
        elif name in BLOCKS:
            end_line()
            block = "" if closing else name
        elif name == "a":
            links = int(not closing and bool(re.search(r"(?:^|\s)href\s*=", found[3], re.I)))
        elif name in _SPACED:
            parts.append(" ")
    end_line()
    return lines


def _after(page: str, name: str, at: int) -> int:
    """Where the raw text of an element ends."""
    found = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
    if not found:
        return len(page)
    end = page.find(">", found.start())
    return len(page) if end < 0 else end + 1


def main_text(page: str | None, window: int = 3) -> str:
    """The article of a page; empty for null and for pages without text.

    ``sums[i]`` is the text in the ``window`` lines from line ``i`` on. Where the
    sums leave zero is a surge, where they are back at zero the dive that ends
    it; the stretch with most text between a surge and its dive is the article.
    Neighbours of that stretch belong to it as long as their lines are at least half as long
    on average, unless the border of an article lies between.
    """
    lines = text_lines(page or "", window)
    if not lines:
        return ""
    lengths = np.array([len(x) for x in lines])
    sums = np.convolve(lengths, np.ones(window, "int64"))  # sums[i] covers lines i - window + 1 .. i
    rising = np.diff(np.concatenate(([0], (sums > 0).astype("int8"), [0])))
    surges, dives = np.flatnonzero(rising > 0), np.flatnonzero(rising < 0)
    total = np.concatenate(([0], np.cumsum(lengths)))
    ends = np.minimum(dives, len(lines))
    texts = total[ends] - total[surges]
    first = last = int(np.argmax(texts))
    full = np.concatenate(([0], np.cumsum(lengths > 0)))
    density = texts / (full[ends] - full[surges])
    least = density[first] / 2
    empty = surges[1:] - ends[:-1] + window - 1  # a dive comes when the window is past the text
    while first and density[first - 1] >= least and empty[first - 1] < 2 * window:
        first -= 1
    while last + 1 < len(texts) and density[last + 1] >= least and empty[last] < 2 * window:
        last += 1
    return "\n".join(x for x in lines[surges[first] : ends[last]] if x)


def extract_text(
    pages: DataFrame, html_col: str = "html", keep: Sequence[str] = ("page_id", "url"), window: int = 3
) -> DataFrame:
    """The ``keep`` columns of every page with its main ``text``.

    A narrow map: no page waits for another. Pages that are cut off, unclosed
    elements and stray marks are read as far as they go; null, empty and
    text-free pages give the empty text. Repeated rows each give a row.
    """
    rows = pages.select(*keep, F.col(html_col).cast("string").alias("_html"))
    schema = T.StructType([*rows.drop("_html").schema, T.StructField("text", T.StringType())])

    def extract(batches):
        for batch in batches:
            text = pa.array([main_text(x.as_py(), window) for x in batch.column("_html")], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], text], [*keep, "text"])

    return rows.mapInArrow(extract, schema)
