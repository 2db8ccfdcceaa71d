"""Main text of HTML pages by tag-path ratios."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# A quote opens a value only behind an equals sign and no value holds "<", so a stray one ends with its tag.
_ATTRS = r"""(?:=\s*"[^"<]*"|=\s*'[^'<]*'|[^>])*"""
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>script|style|noscript|template|textarea|title)\b{_ATTRS}(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    rf"|<(?P<raw2>iframe|svg|math|object|canvas)\b{_ATTRS}(?:(?<=/)>|>.*?(?:</(?P=raw2)\s*>|\Z)|\Z)"
    rf"|<(?P<close>/?)(?P<name>[a-zA-Z][\w:-]*)(?P<attrs>{_ATTRS})(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|style|hidden|aria-hidden)(?![\w-])(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split())
# Elements that end an open paragraph, and those that end an open one of their own kind.
_ENDS_P = set(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav "
    "ol p pre section table ul".split())
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
# Elements that hold no article text, whatever they say.
_ASIDE = set("nav footer aside form button select dialog fieldset menu".split())
# Names of class, id or role that speak against a path, alone or with words that only tell place or shape.
_ASIDE_WORDS = set(
    "nav navbar navigation menu menubar footer sidebar sidenav aside ad ads adbox adslot advert adverts advertisement advertising sponsor "
    "sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter signup subscribe "
    "login share sharing social related recommended recommendations widget widgets breadcrumb breadcrumbs pagination pager comment comments "
    "disqus reply replies respond responses discussion search toolbar topbar masthead copyright contentinfo complementary header".split())
_PLAIN_WORDS = set(
    "area bar block body box card column container content form group holder inner item items left link links list main outer page panel post "
    "reader right row section site slot text thread top bottom unit user wrap wrapper".split())
_ARTICLES = {"article", "main"}
# Elements that divide a page; what is not one of these shapes text.
_DIVISIONS = set("html body div section article main header table tbody tr td center".split())


@dataclass(frozen=True)
class Settings:
    """``strength`` is the share of a page's spread of path scores that a content path exceeds; ``against`` weighs a path that names an aside."""

    strength: float = 0.3
    radius: int = 2
    against: float = 0.01


@dataclass
class _Block:
    """Text between two block tags: its tag path, its element, and how much of it is link text."""

    path: int
    element: int
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""

    @property
    def link_list(self) -> bool:
        return 2 * self.linked > max(sum(map(len, self.parts)), 1)


@dataclass
class _Page:
    """Blocks in page order, the elements' parents and names (0 is the page), and the paths that name an aside."""

    blocks: list[_Block]
    parents: list[int]
    names: list[str]
    against: set[int]


def _names_aside(value: str, in_article: bool) -> bool:
    """Whether a class, id or role says aside: by words of an aside and of place or shape only."""
    for name in value.split():
        words = [w.lower() for w in _PART.findall(name)]
        told = [w for w in words if w in _ASIDE_WORDS and not (w == "header" and in_article)]
        if told and all(w in _ASIDE_WORDS or w in _PLAIN_WORDS for w in words):
            return True
    return False


def _judge(name: str, attrs: str, in_article: bool, forms: bool) -> tuple[bool, bool]:
    """(holds no article text, names an aside) of an element."""
    hidden = name in _ASIDE and not (forms and name == "form") or (name == "header" and not in_article)
    named = False
    for kind, value in _ATTR.findall(attrs) if attrs and not hidden else ():
        kind, value = kind.lower(), value.strip("\"'")
        if kind == "hidden" or (kind == "aria-hidden" and value.lower() == "true") or (kind == "style" and _HIDDEN.search(value)):
            hidden = True
        # A page may carry such a word for its layout ("with-sidebar").
        if kind in {"class", "id", "role"} and name not in {"html", "body"}:
            named = named or _names_aside(value, in_article)
    return hidden, named


def read(page: str, forms: bool = False) -> _Page:
    """The visible blocks of a page; elements without article text are left out (``forms``: but not forms).

    Every tag costs the same at any depth: an element knows its parent, and paths are numbered from their parents' numbers.
    """
    stack: list[tuple[str, int, int, bool]] = []  # name, element, path, hidden
    found = _Page([], [0], [""], set())
    paths: dict[tuple[int, str], int] = {}
    open_names: dict[str, int] = defaultdict(int)
    state = {"current": None, "links": 0}
    articles = 0

    def flush():
        block = state["current"]
        if block:
            block.text = " ".join(html.unescape("".join(block.parts)).split())
            if block.text:
                found.blocks.append(block)
        state["current"] = None

    def add(text: str):
        if not text or (stack and stack[-1][3]):
            return
        block = state["current"]
        if block is None:
            if text.isspace():
                return
            at = len(stack) - 1
            while at >= 0 and stack[at][0] in INLINE:
                at -= 1
            block = state["current"] = _Block(stack[at][2] if at >= 0 else 0, stack[at][1] if at >= 0 else 0)
        block.parts.append(text)
        if state["links"]:
            block.linked += len(text)

    def close(until: int):
        nonlocal articles
        for name, _, _, _ in stack[until:]:
            open_names[name] -= 1
            state["links"] -= name == "a"
            articles -= name in _ARTICLES
            if name not in INLINE:
                flush()
        del stack[until:]

    def close_near(names: set[str], scope: set[str] | None):
        """The nearest open element of ``names``, if nothing of ``scope`` (None: no element that shapes blocks) stands before it."""
        if not any(open_names[n] for n in names):
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                close(k)
                return
            if stack[k][0] in scope if scope is not None else stack[k][0] not in INLINE:
                return

    at = 0
    for token in _TOKEN.finditer(page):
        add(page[at : token.start()])
        at = token.end()
        name = token["name"]
        if name is None:
            continue
        name = name.lower()
        if token["close"]:
            if open_names[name]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        close(k)
                        break
                    if name in INLINE and stack[k][0] not in INLINE:
                        break  # a stray end of formatting does not end a block
            continue
        if name in VOID:
            if name in INLINE:
                add(" ")
            else:
                flush()
            continue
        if name in _ENDS_P:
            close_near({"p"}, None)
        if name in _SIBLINGS:
            close_near(_SIBLINGS[name], _SCOPES[name])
        if name not in INLINE:
            flush()
        attrs = token["attrs"] or ""
        hidden, named = _judge(name, attrs, articles > 0, forms)
        above = stack[-1] if stack else ("", 0, 0, False)
        path = above[2]
        if name not in INLINE:
            label = name + "!" if named else name
            path = paths.setdefault((above[2], label), len(paths) + 1)
            if named or above[2] in found.against:
                found.against.add(path)
            found.parents.append(above[1])
            found.names.append(name)
        element = len(found.names) - 1 if name not in INLINE else above[1]
        state["links"] += name == "a"
        articles += name in _ARTICLES
        open_names[name] += 1
        stack.append((name, element, path, hidden or above[3]))
        if attrs.endswith("/") and ":" in name:
            close(len(stack) - 1)
    add(page[at:])
    flush()
    return found


def path_scores(page: _Page, settings: Settings = Settings()) -> np.ndarray:
    """Score of each block: text and punctuation of its path per node, fused, smoothed over the page, and weighed by what the path names.

    Neighbours lift a path to twice its own ratio at most, so a line of small print beside the text is not drawn in.
    """
    text, marks, nodes = defaultdict(float), defaultdict(float), defaultdict(int)
    for row in page.blocks:
        text[row.path] += max(len(row.text) - 2 * row.linked, 0)
        marks[row.path] += sum(map(row.text.count, ".,;:!?"))
        nodes[row.path] += 1
    fused = {p: text[p] / nodes[p] * np.log2(2 + marks[p] / nodes[p]) for p in nodes}
    each = np.array([fused[row.path] for row in page.blocks])
    reach = np.arange(-settings.radius, settings.radius + 1)
    kernel = np.exp(-(reach ** 2) / (2 * max(settings.radius, 1) ** 2 / 4))
    # A block of its own path does not lend its score to a path that names an aside, nor the other way round.
    against = np.array([row.path in page.against for row in page.blocks])
    smooth = np.zeros(len(each))
    for side in (False, True):
        rows = np.flatnonzero(against == side)
        if len(rows):
            padded = np.pad(each[rows], settings.radius, mode="edge")
            smooth[rows] = np.minimum(np.convolve(padded, kernel / kernel.sum(), mode="valid"), 2 * each[rows])
    if against.all():
        return smooth
    return np.where(against, settings.against * smooth, smooth)


def select(page: _Page, scores: np.ndarray, settings: Settings = Settings()) -> list[bool]:
    """Which blocks are content, by the scores of their paths and the place of the others among those that pass.

    A division that holds a passing block is a region, and so is an article around one.  A region keeps what shapes its text
    (short paragraphs, headings, lists) and what stands between its passing blocks; in an article that is everything but what
    names an aside.  Lists of links outside an article, and divisions of their own right below the page, stay only between passing
    blocks.  A heading right in front of a region belongs to it.
    """
    rows = page.blocks
    # The threshold is a share of the spread of scores; a path that names an aside has to reach that share of the others' mean.
    against = np.array([r.path in page.against for r in rows])
    limit = np.full(len(rows), min(settings.strength * float(scores.std()), float(scores.max())))
    if not against.all():
        limit[against] = np.maximum(limit[against], settings.strength * scores[~against].mean())
    chosen = scores >= limit
    linked = np.array([r.link_list for r in rows])
    if not (chosen & linked).all():
        chosen &= ~linked  # a list of links passes with its region only
    division = list(range(len(page.names)))
    for e in range(1, len(page.names)):
        division[e] = e if page.names[e] in _DIVISIONS else division[page.parents[e]]
    spans: dict[int, list[int]] = {}
    for k in np.flatnonzero(chosen).tolist():
        spans.setdefault(division[rows[k].element], []).append(k)
    article = [0] * len(page.names)
    region = [0 if 0 in spans else -1] * len(page.names)
    for e in range(1, len(page.names)):
        up = page.parents[e]
        article[e] = e if page.names[e] == "article" else article[up]
        region[e] = e if e in spans else region[up]
    articles = {article[rows[k].element] for ks in spans.values() for k in ks} - {0}
    keep = chosen.tolist()
    for k, row in enumerate(rows):
        if keep[k] or row.path in page.against:
            continue
        if article[row.element] in articles:
            keep[k] = True
            continue
        around = region[row.element]
        if around >= 0:
            between = spans[around][0] < k < spans[around][-1]
            own = division[row.element] == around or page.names[around] not in {"", "html", "body", "main"}
            keep[k] = between or (own and not row.link_list)
    for k in range(len(rows) - 2, -1, -1):
        name, row = page.names[rows[k].element], rows[k]
        if not keep[k] and keep[k + 1] and re.fullmatch("h[1-6]", name) and not row.link_list and row.path not in page.against:
            keep[k] = True
    return keep


def extract(page: str | None, settings: Settings = Settings()) -> str:
    """Main text of a page, blocks joined by one line feed; null and pages without visible text give an empty text.

    Blocks whose smoothed path score exceeds a share of the spread of scores are content; ties count as exceeding.  Broken pages
    are read as far as they go: a tag without end closes with the page, an end without start is ignored, and character
    references that are none stay as written.  Length and depth of a page are not bounded.
    """
    found = read(page) if page else None
    if found and not found.blocks:
        found = read(page, forms=True)  # some pages are one form
    if not found or not found.blocks:
        return ""
    keep = select(found, path_scores(found, settings), settings)
    return "\n".join(r.text for r, k in zip(found.blocks, keep) if k)


def main_text(html_col: str = "html", settings: Settings = Settings()) -> Column:
    """Text column of an HTML column; every page is read whole."""

    @F.arrow_udf("string")
    def of(pages: pa.Array) -> pa.Array:
        return pa.array([extract(p.as_py(), settings) for p in pages], pa.string())

    return of(F.col(html_col))
