"""Main-text extraction from HTML by line-block distribution.

1. Markup is stripped into *lines*, one per block element, in page order.  What no
   reader sees as text (scripts, styles, controls, hidden elements) is no line.
2. A line's weight is its text length less the length of its link text, times a
   factor by markup: ``MARKED`` in an article, main element or main-like
   container, 1 in plain blocks, ``NOISE`` in menus, headers, footers, sidebars,
   notices, adverts, forms and reader comments.  Markup decides no more than that.
3. Over the weights a window of ``WINDOW`` lines is summed.  A surge is where the sum
   rises above the threshold, the next dive where it falls to 0.  The threshold is
   ``THRESHOLD``, or half of the largest sum if that is less; noise always has
   to pass ``THRESHOLD``.  Lines of noise stand in the distribution behind the others,
   so that an advert within a story does not split it.
4. Of the spans from surge to dive those are kept whose total weight is at
   least ``SHARE`` of the heaviest one's; their lines, in page order, are the text.  In
   a marked container the span begins where the sum rises from 0, so that short
   first lines stay.

So a page with an article gives the article, and text beside it only if there is
more of it; a page without one gives its dense blocks; and text in a container that
is marked as noise by mistake, such as a page wrapped in one form, stays if nothing
else on the page weighs as much.

Defined results: null or empty html gives an empty text; unclosed elements end
where HTML ends them or with the page; a page without a surge gives an empty
text; repeated rows each get their own result; texts of any length are processed
whole, in time linear in the page.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
THRESHOLD = 80.0
MARKED, NOISE, SHARE = 10.0, 0.02, 0.1

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<(?P<raw>script|style|textarea|title|iframe|xmp|noembed|noframes)(?=[\s/>])(?>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?(?:.*?</(?P=raw)(?=[\s/>])[^>]*>|.*\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?>(?:[^>\"']|\"[^\"]*\"|'[^']*')*))(?:>|\Z)"
    r"|<(?P<close2>/?)(?P<tag2>[a-z][a-z0-9:-]*)(?P<attrs2>[^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"([a-z:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|([a-z:-]+)", re.I)

_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_BLOCK = _HEADINGS | frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_UNSEEN = frozenset("noscript svg math canvas object video audio button select template dialog head datalist map applet".split())
_ASIDE = frozenset("nav footer aside form menu search".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
# names of a class or id, as a whole: [place-]noise[-part]*
_PLACE = r"(?:(?:site|page|main|top|bottom|global|primary|secondary|post|article|blog|left|right|fixed|sticky|user|reader)[-_])?"
_PART = r"(?:[-_](?:links?|list|bar|box|boxes|buttons?|tools|icons?|form|area|section|thread|wrapper?|container|inner|outer|content|posts?|articles?|stories|items?|news|banner|notices?|menu|nav|text|body|author|meta|title|header|footer|popup|modal|widgets?|slot|unit|top|bottom|left|right|main|\d+))*"
_OTHERS = r"(?:teasers?|related|recommend(?:ed|ations)|sponsor(?:ed|s)?|promo|promotions?|ads?|advert(?:s|isements?|ising)?|adbox|sidebar)"
_REPLIES = r"(?:comments?|commentlist|respond|disqus|repl(?:y|ies))"
_REST = r"(?:nav|navbar|navigation|menus?|breadcrumbs?|aside|header|footer|masthead|banner|cookies?|consent|gdpr|notices?|newsletter|subscribe|subscription|signup|popup|modal|overlay|share|sharing|social|widgets?|toolbar|pagination|pager|login|paywall|disclaimer|copyright|alert)"
_IS_OTHERS = re.compile(f"{_PLACE}{_OTHERS}{_PART}", re.I)
_IS_REPLIES = re.compile(f"{_PLACE}{_REPLIES}{_PART}", re.I)
_IS_NOISE = re.compile(f"{_PLACE}{_REST}{_PART}", re.I)
_IS_HEADER = re.compile(f"{_PLACE}header", re.I)
_IS_MAIN = re.compile(r"(?:(?:article|story|post|entry|main|page)[-_]?)?(?:article|story|body|content|text|post|entry|main)", re.I)
_LEGAL = re.compile(r"(?:©|\(c\)|copyright)\W{0,3}(?:19|20)\d\d\b|^©|all rights reserved", re.I)
_TEXT, _HIDDEN, _HEADS, _SIDE, _OTHER = range(5)  # text; no text; headings only; noise; noise whose articles are noise, too


def _attrs(raw: str) -> dict[str, str]:
    return {(m[1] or m[5]).lower(): next((x for x in m.group(2, 3, 4) if x is not None), "") for m in _ATTR.finditer(raw)}


class _Lines:
    """The lines of a page and their weights; noise has its own list."""

    def __init__(self) -> None:
        self.lines: list[tuple[int, str, float, bool]] = []  # place in the page, text, weight, marked
        self.noise: list[tuple[int, str, float, bool]] = []
        self.stack: list[tuple[str, int, int]] = []  # element, state and level outside of it
        self.state, self.level, self.heading, self.link = _TEXT, 0, 0, 0
        self.parts: list[str] = []
        self.linked = self.place = 0

    def text(self, raw: str) -> None:
        if self.state != _HIDDEN and (self.state != _HEADS or self.heading):
            self.parts.append(raw)
            if self.link:
                self.linked += len(raw.strip())

    def flush(self) -> None:
        if self.parts:
            text = " ".join(_html.unescape("".join(self.parts)).split())
            if text:
                self.place += 1
                noise = self.state >= _SIDE or not self.level and bool(_LEGAL.search(text))
                own = max(0, len(text) - (0 if self.heading else self.linked))
                if noise:
                    self.noise.append((self.place, text, NOISE * own, False))
                elif self.level:
                    self.lines.append((self.place, text, MARKED * max(1, own), True))
                else:
                    self.lines.append((self.place, text, float(own if 2 * own >= len(text) else 0), False))
            self.parts.clear()
        self.linked = 0

    def gap(self, of: list) -> None:
        of.extend([(0, "", 0.0, False)] * WINDOW)

    def open(self, tag: str, raw: str) -> None:
        if tag in _BLOCK:
            self.flush()
            if self.stack and self.stack[-1][0] == "p":
                self.pop()
            elif tag == "li" and self.stack and self.stack[-1][0] == "li":
                self.pop()
        if tag in _VOID:
            if tag == "br":
                self.text(" ")
            return
        if tag == "a":
            self.link = 1
        if tag in _HEADINGS:
            self.heading += 1
            self.link = 0
        known = _attrs(raw) if raw and raw.strip("/ \n\t\r") else {}
        names = [] if tag in _HEADINGS else [w for k in ("class", "id") if known.get(k) for w in known[k].split()]
        state, level, listed = self.judge(tag, known, names)
        if state != self.state or level != self.level:
            if tag in _BLOCK:
                self.flush()
                if state >= _SIDE:
                    self.gap(self.noise)
                elif level != self.level:
                    self.gap(self.lines)
            elif state >= _SIDE:
                state = _HIDDEN  # inline noise is part of no line
            listed = True
        if listed:
            self.stack.append((tag, self.state, self.level))
            self.state, self.level = state, level

    def judge(self, tag: str, known: dict[str, str], names: list[str]) -> tuple[int, int, bool]:
        """(state, level, whether it must be closed) of an element within the current one."""
        listed = tag in _BLOCK and tag not in _HEADINGS
        if self.state in (_HIDDEN, _OTHER):
            return self.state, self.level, listed
        if tag in _UNSEEN or "hidden" in known or re.search(r"display\s*:\s*none", known.get("style", ""), re.I):
            return _HIDDEN, self.level, listed
        if tag in ("html", "body") or tag in _HEADINGS:
            return self.state, self.level, listed
        if any(_IS_REPLIES.fullmatch(w) or _IS_OTHERS.fullmatch(w) for w in names):
            return _OTHER, self.level, listed
        if tag in ("article", "main") or known.get("role") in ("main", "article") or known.get("itemprop", "").lower() == "articlebody":
            inside = any(t in _ASIDE for t, _, _ in self.stack)
            return (self.state if inside else _TEXT), (self.level if inside else 1), listed
        if self.state != _TEXT:
            return self.state, self.level, listed
        if tag == "header":
            return (_HEADS if self.level else _SIDE), self.level, listed
        if tag in _ASIDE or known.get("role") in _ROLES:
            return _SIDE, self.level, listed
        if any(_IS_NOISE.fullmatch(w) for w in names) and not (self.level and all(_IS_HEADER.fullmatch(w) for w in names if _IS_NOISE.fullmatch(w))):
            return _SIDE, self.level, listed
        if listed and not self.level and any(_IS_MAIN.fullmatch(w) for w in names):
            return _TEXT, 1, listed
        return self.state, self.level, listed

    def close(self, tag: str) -> None:
        if tag in _BLOCK:
            self.flush()
        if tag == "a":
            self.link = 0
        if tag in _HEADINGS:
            self.heading = max(0, self.heading - 1)
        if tag in ("body", "html"):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                while len(self.stack) > i:
                    self.pop()
                return
            if tag not in _BLOCK and self.stack[i][0] in _BLOCK:
                return

    def pop(self) -> None:
        tag, state, level = self.stack.pop()
        if tag in _BLOCK and (self.state != state or self.level != level):
            self.flush()
            if self.level != level and self.state == state == _TEXT:
                self.gap(self.lines)
        self.state, self.level = state, level


def lines_of(page: str) -> _Lines:
    lines, at = _Lines(), 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            lines.text(page[at : m.start()])
        at = m.end()
        if m["raw"]:
            if m["raw"].lower() not in ("script", "style"):
                lines.text(" ")
        elif tag := m["tag"] or m["tag2"]:
            if m["close"] or m["close2"]:
                lines.close(tag.lower())
            else:
                lines.open(tag.lower(), m["attrs"] if m["tag"] else m["attrs2"])
    if at < len(page):
        lines.text(page[at:])
    lines.flush()
    return lines


def spans_of(weights: list[float], marked: list[bool], window: int = WINDOW, threshold: float = THRESHOLD, n_text: int | None = None) -> list[tuple[int, int]]:
    """Half-open line ranges from each surge to the next dive; lines from
    ``n_text`` on are noise."""
    n = len(weights)
    n_text = n if n_text is None else n_text
    sums = [sum(weights[i : min(i + window, n_text if i < n_text else n)]) for i in range(n)]
    bar = min(threshold, max(sums[:n_text], default=0.0) / 2)
    out, start = [], None
    for i in range(n):
        if start is None and sums[i] > (bar if i < n_text else threshold):
            start = i
            floor = out[-1][1] if out else 0
            while start > floor and marked[start - 1] and weights[start - 1]:
                start -= 1
        elif start is not None and sums[i] == 0:
            out.append((start, i))
            start = None
    if start is not None:
        out.append((start, n))
    return out


def chosen_spans(weights: list[float], marked: list[bool], n_text: int) -> list[tuple[int, int]]:
    """The spans that weigh at least ``SHARE`` of the heaviest one."""
    spans = spans_of(weights, marked, n_text=n_text)
    heavy = [sum(weights[a:b]) for a, b in spans]
    return [s for s, w in zip(spans, heavy, strict=True) if w >= SHARE * max(heavy)]


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = lines_of(page)
    lines = [*found.lines, *[(0, "", 0.0, False)] * WINDOW]
    n_text = len(lines)
    lines += found.noise
    spans = chosen_spans([x[2] for x in lines], [x[3] for x in lines], n_text)
    kept = sorted((lines[i][0], lines[i][1]) for a, b in spans for i in range(a, b) if lines[i][2])
    return "\n".join(t for _, t in kept)


def extract_text(pages: DataFrame, *, html_col: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text in column ``out`` (replaced if it exists). No shuffle."""

    @F.arrow_udf("string")
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([main_text(x.as_py()) for x in batch], pa.string())

    return pages.withColumn(out, extract.asNondeterministic()(F.col(html_col)))


def digest(pages: DataFrame) -> DataFrame:
    return extract_text(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
