"""Main text of web pages by minimum cut.

The page falls into blocks of text. A linear classifier gives each block the log-odds of being content, from its words, links and
the elements around it; they become its terminal capacity (to the source if positive, to the sink if negative). Neighbouring blocks,
and blocks that follow each other under one parent, are joined by smoothness edges that weaken with distance in the element tree. The
maximum flow separates content from boilerplate. Blocks whose own capacity outweighs their edges are settled before the flow runs, which
changes no cut's value.

The word lists and tags only lean the odds: what stands among content is content, unless its own odds against it outweigh its edges.

Null html counts as empty; a page without content has an empty text; an empty table gives an empty one. Broken markup never fails: an unclosed tag reads as text, an
unclosed script, style or comment runs to the end, and any other element without an end tag, or closed by "/>", hides nothing.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillframe.llm.common import frugal

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|math|iframe|object|textarea|select|title|head)\b((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|[^<]+|<",
    re.DOTALL,
)
#: Elements whose contents aren't text of the page; all but head end at their end tag, head also at body.
SILENT = {k: re.compile(rf"</{k}\s*>" + ("|(?=<body\\b)|(?=<article\\b)" if k == "head" else ""), re.IGNORECASE) for k in "script style noscript template svg math iframe object textarea select title head".split()}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Start tags that close an open element of these kinds under the same parent.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
#: Elements, and words of classes and ids, that speak for content or against it.
AGAINST = frozenset("nav footer aside menu button dialog".split())
FOR = frozenset("article main".split())
WORDS_AGAINST = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup paywall sidebar aside widget related recommended recommendations trending popular comment comments commentlist disqus replies respond reviews share sharing social nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer copyright masthead toolbar login search form disclaimer skip".split()
)
WORDS_FOR = frozenset("article content main post entry story body text".split())
WEIGHTS = {"bias": -2.6, "word": 0.12, "most_words": 40, "sentence": 0.6, "links": -5.0, "against": -6.0, "words_against": -5.0, "header": -4.0, "for": 1.2, "words_for": 0.8, "prose": 1.0, "hidden": -30.0}
#: Smoothness of blocks that follow each other, over the fourth power of their distance in the tree, and of those that follow each other under one grandparent.
SMOOTH, ALONG = 24.0, 0.1
PROSE = frozenset("p blockquote pre h1 h2 h3 h4 h5 h6 li td dd figcaption".split())
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_SPACE = re.compile(r"\s+")
_SENTENCE = re.compile(r"[.!?](?!\w)|[。！？]")
#: Letters of scripts that don't space words; two count as a word.
_UNSPACED = re.compile("[\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")


@dataclass(slots=True)
class Element:
    tag: str
    number: int
    parent: Element | None
    depth: int
    #: What the elements around a block say: content, header and against, as weights.
    inside: float
    against: float


@dataclass(slots=True)
class Block:
    text: str
    parent: Element
    linked: int
    order: int


def _element(tag: str, attributes: str, parent: Element | None, number: int) -> Element:
    inside = parent.inside if parent else 0.0
    against = parent.against if parent else 0.0
    w = WEIGHTS
    if tag in FOR:
        inside = max(inside, w["for"])
        against = 0.0 if against == w["header"] else against
    elif tag in AGAINST:
        against = min(against, w["against"])
    elif tag == "form" or tag == "header":
        against = min(against, w["header"] if not inside or tag == "form" else 0.0)
    if attributes and "=" in attributes:
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values)
            if name == "style" and _HIDDEN.search(value) or name == "aria-hidden" and value == "true":
                against = w["hidden"]
            elif name in ("class", "id", "role") and tag not in ("html", "body", *FOR):
                words = {x.lower() for x in _NAME.findall(value)}
                if words & WORDS_AGAINST or name == "role" and value in ("navigation", "banner", "contentinfo", "complementary", "search"):
                    against = min(against, w["words_against"])
                elif words & WORDS_FOR and not inside:
                    inside = w["words_for"]
    if re.search(r"\bhidden\b(?!\s*=)", attributes) and "hidden" in attributes.split():
        against = w["hidden"]
    return Element(tag, number, parent, parent.depth + 1 if parent else 0, inside, against)


def blocks(html: str) -> list[Block]:
    """Blocks of text in page order; character references are decoded, white space is one space."""
    out: list[Block] = []
    root = here = Element("html", 0, None, 0, 0.0, 0.0)
    number = linked = link = 0
    text: list[str] = []
    at, size = 0, len(html)
    endless: set[str] = set()  # elements that have no end tag from here on

    def close() -> None:
        nonlocal text, linked
        if text:
            whole = _SPACE.sub(" ", unescape("".join(text))).strip()
            if whole:
                out.append(Block(whole, here, linked, len(out)))
            text, linked = [], 0

    while at < size:
        m = TOKEN.match(html, at)
        at = m.end()
        if m[1]:
            kind = m[1].lower()
            if kind in ("textarea", "select", "iframe", "object"):
                close()
            if m[2].endswith("/") and kind not in ("script", "style", "title", "textarea", "head") or kind in endless:
                continue
            end = SILENT[kind].search(html, at)
            if end:
                at = end.end()
            elif kind in ("script", "style"):
                at = size
            else:
                endless.add(kind)
            continue
        tag = m[4]
        if not tag:
            piece = m[0]
            if piece[:2] in ("<!", "<?") and len(piece) > 2:
                continue
            text.append(piece)
            if link:
                linked += len(piece)
            continue
        tag = tag.lower()
        if m[3]:
            if tag == "a":
                link = 0
            if tag not in BLOCK:
                continue
            up: Element | None = here
            while up is not None and up.tag != tag:
                up = up.parent
            close()
            if up is not None and up.parent is not None:
                here = up.parent
            continue
        if tag == "a":
            link = 1
        if tag not in BLOCK:
            if tag == "br":
                text.append(" ")
            continue
        close()
        if tag in VOID:
            continue
        closes = CLOSES.get(tag, {"p"})
        while here.tag in closes and here.parent is not None:
            here = here.parent
        number += 1
        here = _element(tag, m[5], here, number)
        link = 0
    close()
    del root
    return out


def log_odds(b: Block) -> float:
    """The classifier's log-odds that a block is content."""
    w = WEIGHTS
    words = b.text.count(" ") + 1
    if words < w["most_words"]:
        words += len(_UNSPACED.findall(b.text)) // 2
    sentences = sum(1 for _ in islice(_SENTENCE.finditer(b.text), 2))
    z = w["bias"] + w["word"] * min(words, w["most_words"]) + w["sentence"] * sentences
    z += w["links"] * min(1.0, b.linked / len(b.text)) + b.parent.inside + b.parent.against
    return z + w["prose"] * (b.parent.tag in PROSE)


def distance(a: Element, b: Element) -> int:
    """Steps between two elements in the tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent  # type: ignore[assignment]
        else:
            b = b.parent  # type: ignore[assignment]
        steps += 1
    return steps


def edges(found: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: of each block to the next, and to the next under the same grandparent."""
    out = []
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            out.append((i - 1, i, SMOOTH / max(2, distance(found[i - 1].parent, b.parent)) ** 4))
        up = (b.parent.parent or b.parent).number
        if up in last and last[up] < i - 1:
            out.append((last[up], i, ALONG))
        last[up] = i
    return out


def cut(odds: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """For each node whether it is on the source's side of a minimum cut; ties go to the sink's side."""
    n = len(odds)
    z = list(odds)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, c in links:
        near[i][j] = near[i].get(j, 0.0) + c
        near[j][i] = near[j].get(i, 0.0) + c
    side: list[bool | None] = [None] * n
    waiting = deque(range(n))
    while waiting:  # what outweighs its edges is settled, and its edges become terminal capacity of the others
        i = waiting.popleft()
        if side[i] is None and abs(z[i]) > sum(near[i].values()) or side[i] is None and not near[i]:
            side[i] = z[i] > 0
            for j, c in near[i].items():
                z[j] += c if side[i] else -c
                del near[j][i]
                waiting.append(j)
            near[i] = {}
    left = [i for i in range(n) if side[i] is None]
    if left:
        on = _reached(z, near, left)
        for i in left:
            side[i] = i in on
    return [bool(s) for s in side]


def _reached(z: list[float], near: list[dict[int, float]], left: list[int]) -> set[int]:
    """Maximum flow by blocking flows on layers of equal distance from the source; the nodes that the source still reaches."""
    rest = {i: dict(near[i]) for i in left}
    source = {i: z[i] for i in left if z[i] > 0}
    sink = {i: -z[i] for i in left if z[i] < 0}
    while True:
        level = {i: 0 for i, c in source.items() if c > 1e-12}
        order, ends = deque(level), False
        while order:
            i = order.popleft()
            ends |= sink.get(i, 0.0) > 1e-12
            for j, c in rest[i].items():
                if c > 1e-12 and j not in level:
                    level[j] = level[i] + 1
                    order.append(j)
        if not ends:
            return set(level)
        waiting = {i: iter(list(rest[i])) for i in level}
        for start in [i for i, n in level.items() if n == 0]:
            path = [start]
            while path and source[start] > 1e-12:
                i = path[-1]
                if sink.get(i, 0.0) > 1e-12:
                    flow = min([source[start], sink[i], *(rest[a][b] for a, b in zip(path, path[1:], strict=False))])
                    source[start] -= flow
                    sink[i] -= flow
                    for a, b in zip(path, path[1:], strict=False):
                        rest[a][b] -= flow
                        rest[b][a] = rest[b].get(a, 0.0) + flow
                    cut_at = next((k for k, (a, b) in enumerate(zip(path, path[1:], strict=False)) if rest[a][b] <= 1e-12), len(path) - 1)
                    path = path[: cut_at + 1]
                    continue
                for j in waiting[i]:
                    if rest[i].get(j, 0.0) > 1e-12 and level.get(j) == level[i] + 1:
                        path.append(j)
                        break
                else:
                    path.pop()


def main_text(html: str) -> str:
    found = blocks(html)
    side = cut([log_odds(b) for b in found], edges(found))
    return "\n".join([b.text for b, s in zip(found, side, strict=True) if s])


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages without their html, with main_text (columns of that name are replaced). One page at a time, no shuffle."""
    frugal(pages.sparkSession)
    kept = [c for c in pages.columns if c not in (html_col, "main_text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h or "") for h in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(texts, pa.string())], names=[*kept, "main_text"])

    fields = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept)
    return pages.select(*[F.col(f"`{c}`") for c in (*kept, html_col)]).mapInArrow(run, f"{fields}{', ' if kept else ''}main_text string")
