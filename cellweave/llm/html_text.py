"""Main text of web pages by the distribution of text over line blocks.

1. Markup is stripped into lines, one for each block of the page.
2. A line weighs the characters of its text, without link text unless the page marks its
   article. Lines in navigation, headers, footers, sidebars, notices, adverts, forms,
   comments and the like (told by element, role, class or id) and, on a page that has
   an <article> or <main>, lines outside it are stripped of their text: they keep
   their place but weigh nothing. Stripped lines within an article count as one.
3. Weights are summed over sliding windows of WINDOW lines. The text surges where they
   rise from zero and dives where a window is zero again. What lies between such a pair is
   kept if a window there reaches the threshold: THRESHOLD characters, or SHARE of the
   page's strongest window where that is less.

The same search runs on every page. Where markup tells everything, as on a page that has
one marked article, it finds that one rise; the more text the markup leaves, the more is
decided by the distribution.

Null or empty html gives an empty text. Unclosed, crossed and truncated tags,
comments and references are read as browsers do, roughly: a container ends with
its parent. Repeated rows and null ids give a row each; an empty table gives none.
Extra columns are ignored. Time and memory are linear in the page: no part of it is
scanned again for each tag.
"""

from __future__ import annotations

import html as html_module
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SHARE, THRESHOLD = 0.2, 80

# Element names and words of HTML pages.
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head nav header footer aside form button select menu dialog".split())
MAIN = frozenset("article main".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CELLS = frozenset("td th".split())
#: Elements whose end may be left out; they never hold a container open.
LOOSE = frozenset("p li dt dd tr td th thead tbody tfoot option optgroup colgroup h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification "
    "alert popup modal overlay newsletter subscribe subscription signup login sidebar side aside menu nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead topbar toolbar comment comments disqus reply replies respond related recommended share sharing social widget search "
    "pagination pager copyright skip".split()
)

_MARK = re.compile(r"<(?:!--|[a-zA-Z/!?])")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_PLAIN = re.compile(r"""</?([a-zA-Z][^\s/>]*+)([^"'>]*+)>""")
_EDGE = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden)(?![\w-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")
_END = {name: re.compile(rf"</{name}\b[^>]*>?", re.I) for name in RAW}


def _boilerplate(name: str, attributes: str, in_main: bool) -> bool:
    if name in DROPPED and not (name == "header" and in_main):
        return True
    if not attributes or name in MAIN or name in ("body", "html"):
        return False
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), (a or b or c).lower()
        if (key == "hidden" and value != "until-found") or (key == "aria-hidden" and value == "true"):
            return True
        if key == "role" and value in ROLES:
            return True
        if key in ("class", "id"):
            for token in (a or b or c).split():
                if not token.lower().startswith(("has-", "with-", "no-")) and NAMES.intersection(_WORD.findall(_CAMEL.sub(r"\1 \2", token).lower())):
                    return True
    return False


class _Tags:
    """Finds where tags end. A quote or > outside of quotes leads to the same end from
    whichever tag it is met, so what was found for one is remembered for the others."""

    def __init__(self, page: str):
        self.page = page
        self.ends: dict[int, int] = {}

    def at(self, start: int) -> tuple[str, str, int] | None:
        """(name, attributes, place after the tag) of the tag at `start`, if there is one."""
        if plain := _PLAIN.match(self.page, start):
            return plain[1].lower(), plain[2], plain.end()
        name = _NAME.match(self.page, start)
        if not name:
            return None
        path, at, end = [], name.end(), -1
        while edge := _EDGE.search(self.page, at):
            mark = edge.start()
            if mark in self.ends:
                end = self.ends[mark]
                break
            path.append(mark)
            if edge[0] == ">":
                end = mark + 1
                break
            closing = self.page.find(edge[0], mark + 1)
            if closing < 0:
                break
            at = closing + 1
        self.ends.update(dict.fromkeys(path, end))
        return (name[1].lower(), self.page[name.end() : end - 1], end) if end >= 0 else None


def lines(page: str) -> tuple[list[tuple[str, int]], bool]:
    """(text, weight) of each block in page order, and whether an article is marked."""
    out: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    link = 0  # characters of link text in the open block
    stack: list[tuple[str, bool, bool]] = []  # (container, dropped, main) with what they inherit
    opened: Counter[str] = Counter()  # of the names in the stack
    anchors = 0
    marked = False
    at, n = 0, len(page)
    tags = _Tags(page)

    def text(a: int, z: int) -> None:
        nonlocal link
        if a < z and not (stack and stack[-1][1]):
            parts.append(page[a:z])
            if anchors:
                link += z - a

    def close() -> None:
        nonlocal link
        joined = " ".join(html_module.unescape("".join(parts)).split())
        dropped, main = stack[-1][1:] if stack else (False, False)
        if joined or (dropped and not (main and out and out[-1] == ("", 0, True))):
            out.append((joined, max(0, len(joined) - link), main))
        parts.clear()
        link = 0

    while at < n:
        m = _MARK.search(page, at)
        if not m:
            text(at, n)
            break
        text(at, m.start())
        at = m.start()
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = n if end < 0 else end + 3
            continue
        tag = tags.at(at)
        if not tag:
            end = page.find(">", at)
            at = n if end < 0 else end + 1
            continue
        closes = page[at + 1] == "/"
        name, attributes, at = tag
        if closes:
            if name == "a":
                anchors = max(0, anchors - 1)
            if name not in INLINE and name not in CELLS:
                close()
            if opened[name]:
                while True:
                    ended = stack.pop()[0]
                    opened[ended] -= 1
                    if ended == name:
                        break
            continue
        if name in RAW:
            end = _END[name].search(page, at)
            at = n if not end else end.end()
            continue
        if name == "br" or name in CELLS:
            parts.append(" ")
            continue
        if name == "a":
            anchors += 1
            continue
        if name in INLINE and not attributes.strip():
            continue
        dropped, main = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        if name == "body" and opened["head"]:
            stack = [x for x in stack if x[0] != "head"]
            opened["head"] = 0
            dropped = False
        if name not in INLINE:
            close()
            anchors = 0
        if name in MAIN and not dropped:
            marked = main = True
        if name not in LOOSE and name not in VOID and not attributes.rstrip().endswith("/"):
            if name not in INLINE or _boilerplate(name, attributes, main):
                stack.append((name, dropped or _boilerplate(name, attributes, main), main))
                opened[name] += 1
        elif name in LOOSE and _boilerplate(name, attributes, main):
            # A loose element has no sure end: it counts until its end tag or its parent's.
            stack.append((name, True, main))
            opened[name] += 1
    close()
    if marked:
        return [(t, len(t)) if m else ("", 0) for t, w, m in out], True
    return [(t, w) for t, w, m in out], False


def between(weights: list[int], window: int = WINDOW, share: float = SHARE, most: int = THRESHOLD) -> list[bool]:
    """Which lines lie between a surge and the next dive, and reach the threshold there."""
    n = len(weights)
    kept = [False] * n
    sums = [0, *accumulate(weights)]
    around = [sums[min(i + window, n)] - sums[max(0, i)] for i in range(1 - window, n)]  # windows from 1 - window on
    threshold = max(1, min(most, int(max(around, default=0) * share)))
    start = 0
    while start < n:
        if not weights[start]:
            start += 1
            continue
        # The dive: the first window of zeros from here on, or the page's end.
        end = last = start
        peak = 0
        while end < n and end - last <= window:
            if weights[end]:
                last, peak = end, max(peak, around[end + window - 1])
            end += 1
        if peak >= threshold:
            kept[start : last + 1] = [True] * (last + 1 - start)
        start = end
    return kept


def extract(page: str | None) -> str:
    """The main text: kept blocks in page order, one a line."""
    if not page:
        return ""
    found = lines(page)[0]
    keep = between([w for _, w in found])
    return "\n".join(t for (t, _), k in zip(found, keep, strict=True) if k and t)


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(each, "page_id long, url string, text string, n_chars long")


op4_html_text = main_texts
