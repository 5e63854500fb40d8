"""Main-text extraction from HTML as a maximum-scoring run of tokens.

A page becomes one sequence: each word scores positive, each tag scores negative, with
weights that are counted from labelled pages. One linear scan finds the contiguous run with
the greatest sum; its words are the main text. Words of links weigh by their own log-odds where no
article or main element holds them; so do other words outside those elements, on a page that has them and
does not hold most of its words (``MOSTLY``) elsewhere. An article within another or within a main element
is no edge of the content. Elements that are no part of any article
(menus, sidebars, forms, scripts, adverts, notices, reader comments) leave the sequence
first, wherever they stand, so neither does their text appear nor does it split an article.

Names of classes mislead. A part of a name does not count beside a word that denies it ("ad-free", "no-sidebar").
Names of functions, such as a search, that hold prose and no controls within an article are sections of it. Where the page has article or main elements and all of them would leave
with what holds them, they stay; where nothing at all is left, the page is read once more without
regard to names and forms. A form that holds a heading h1, an article or a main element is a frame of
the whole page, not a form.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterable
from functools import cache

from pyspark.sql import DataFrame

from .common import arrow_map, slices
from .labelled_pages import PAGES

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|title)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-z][^>]*>|<[!?/][^>]*>",
    re.I | re.S,
)
_MARKING = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose open state matters; the others end where a block begins or never hold blocks.
TRACKED = BLOCKS - frozenset("hr".split()) | frozenset("span a ins font button select object".split())
NEVER = frozenset("head nav footer aside form menu dialog fieldset button select object".split())
#: Parts of class, id and role names that mark what is no part of an article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies "
    "discussion disqus feedback footer gdpr login masthead menu modal nav navbar navigation navigator newsletter notice notices notification pager pagination popup promo promoted promotion "
    "recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser teasers toolbar widget".split()
)

#: Of these, parts that name a function; a section of an article may be named by its subject in the same way.
FUNCTIONS = frozenset("login menu pager reply respond search share sharing signup skip social toolbar widget".split())
#: Words that deny the part of a name beside them.
DENIALS = frozenset("free has no with without".split())
#: An element with one of the names of functions is prose with this many words, without controls and with three times the words of its links.
PROSE = 20
#: Words outside article and main elements, times those within, from which on the elements are not believed.
MOSTLY = 4
CONTROLS = frozenset("button form input select textarea".split())


def _marks(attrs: str) -> set[str]:
    """The parts of an element's names that mark it, those beside a denial left out."""
    found = set()
    for m in _MARKING.finditer(attrs):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            parts = _PART.findall(name)
            found.update(x for i, x in enumerate(parts) if x in MARKS and DENIALS.isdisjoint(parts[max(0, i - 1) : i + 2]))
    return found


def _prose(page: str) -> frozenset[int]:
    """Where the elements begin that hold prose; one pass."""
    found: set[int] = set()
    open_: list[tuple[str, int, int, int, int]] = []
    count: Counter = Counter()
    plain = link = controls = at = 0

    def close():
        name, start, p, k, c = open_.pop()
        count[name] -= 1
        if controls == c and plain - p >= max(PROSE, 3 * (link - k)):
            found.add(start)

    for m in _TOKEN.finditer(page):
        words = len(page[at : m.start()].split())
        plain, link = (plain, link + words) if count["a"] else (plain + words, link)
        at = m.end()
        name = (m["name"] or m["raw"] or "").lower()
        if not m["close"]:
            controls += name in CONTROLS
            if name in TRACKED and m["name"] and not m["attrs"].endswith("/"):
                open_.append((name, m.start(), plain, link, controls - (name in CONTROLS)))
                count[name] += 1
        elif count[name]:
            while open_[-1][0] != name:
                close()
            close()
    plain += len(page[at:].split())
    while open_:
        close()
    return frozenset(found)


_FORM = re.compile(r"<(/?)form\b|<(?:h1|article|main)\b", re.I)


def _frames(page: str) -> frozenset[int]:
    """Where the forms begin that hold a heading, an article or a main element."""
    found, at = set(), None
    for m in _FORM.finditer(page):
        if m[1] is None:
            if at is not None:
                found.add(at)
        else:
            at = None if m[1] else m.start()
    return frozenset(found)


class Open:
    """The open elements, with how many of each name there are, so that a page is read in linear time."""

    def __init__(self):
        self.names: list[str] = []
        self.left: list[bool] = []
        self.count: Counter = Counter()
        self.out: Counter = Counter()  # of those that are left out

    def push(self, name: str, left: bool) -> None:
        self.names.append(name)
        self.left.append(left)
        self.count[name] += 1
        self.out[name] += left

    def pop(self) -> str:
        name = self.names.pop()
        self.count[name] -= 1
        self.out[name] -= self.left.pop()
        return name

    def skipping(self) -> bool:
        return bool(self.left) and self.left[-1]

    def within(self) -> bool:
        return bool(self.count["article"] or self.count["main"])


def tokens(page: str, lift: bool = False, names: bool = True) -> list[tuple[str, str]]:
    """("", text), outside articles ("a", text) of a link and ("o", text) of what is none, and (name or /name, "") of what may belong to an article, in order.

    An article or main element within another is given as a div.

    With ``lift``, article and main elements stay whatever holds them; without ``names``, classes and
    forms are not looked at.
    """
    out: list[tuple[str, str]] = []
    stack = Open()
    frames = _frames(page)
    prose: frozenset[int] | None = None
    at = 0

    def said(text):
        out.append(("" if stack.within() else "a" if stack.count["a"] else "o", text))

    for m in _TOKEN.finditer(page):
        skipping = stack.skipping()
        if m.start() > at and not skipping:
            said(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if not name:
            continue
        name = name.lower()
        if m["close"]:
            if name in TRACKED and stack.count[name]:
                while stack.pop() != name:
                    pass
                if skipping:
                    continue
        else:
            if name in BLOCKS:
                while stack.names and (stack.names[-1] in ("p", "span", "a", "ins", "font") or stack.names[-1] == name == "li"):
                    stack.pop()  # these end where a block begins
            skipping = stack.skipping()
            if name in ("article", "main", "body") and skipping and (stack.out["head"] or stack.out["nav"] or stack.out["header"]) and not (stack.count["aside"] or stack.count["footer"] or stack.count["form"]):
                stack = Open()  # a menu or header that was never closed
                skipping = False
            if name in TRACKED and not m["attrs"].endswith("/"):
                within = stack.within()
                marks = _marks(m["attrs"]) if names else ()
                if marks and within and FUNCTIONS.issuperset(marks):
                    prose = _prose(page) if prose is None else prose
                    marks = () if m.start() in prose else marks
                marked = bool(marks)
                never = name in NEVER and not (name == "form" and (not names or m.start() in frames)) and not (name == "fieldset" and not names)
                left = skipping or never or name == "header" and not within or name not in ("html", "body", "article", "main") and marked
                left = left or name == "article" and within and marked
                if lift and name in ("article", "main") and not within and not (name == "article" and marked):
                    left = False
                stack.push(name, left)
        if not stack.skipping():
            inner = name in ("article", "main") and stack.count["article"] + stack.count["main"] > (0 if m["close"] else 1)
            said_name = "div" if inner else name
            out.append(("/" + said_name if m["close"] else said_name, ""))
    if at < len(page) and not stack.skipping():
        said(page[at:])
    return out


def _sequence(page: str) -> list[tuple[str, str]]:
    """The page's tokens under the strictest reading that leaves an article, or any text."""
    has = re.search(r"<(?:article|main)\b", page, re.I)
    for how in ({}, {"lift": True}, {"lift": True, "names": False}):
        seq = tokens(page, **how)
        if any(not t.isspace() for _, t in seq if t) and (not has or any(n in ("article", "main") for n, t in seq if not t) or "names" in how):
            return seq
    return seq


@cache
def weights(pages: tuple[str, ...] = PAGES) -> tuple[dict[str, float], dict[str, float]]:
    """Scores of tags, and of a word by where it stands ("", "a", "o" as in ``tokens``), from labelled pages.

    A tag inside the content costs a small share of a word, so that even a block of one word
    adds to the sum. What stands only outside costs several words, by its log-odds; the
    sectioning tags at the edge of the content cost more than any stray line beside it holds.
    """
    inside, outside, edge, words = Counter(), Counter(), Counter(), Counter()
    for page in pages:
        before, content, after = re.split(r"\[\[|\]\]", page)
        inside.update(n for n, t in tokens(content) if not t)
        for n, t in tokens(content):  # read without the element that holds it
            words["in", "" if n == "o" else n] += len(t.split())
        for part, side in ((before, -1), (after, 0)):
            names = [n for n, t in tokens(part) if not t]
            outside.update(names)
            for n, t in tokens(part):
                words["out", n] += len(t.split())
            if names:
                edge[names[side]] += 1
    scores = {}
    for name in inside.keys() | outside.keys():
        i, o = inside[name], outside[name]
        scores[name] = -0.05 if i else -max(0.5, math.log((o + 1) / (i + 1)))
        if edge[name] and not i:
            scores[name] = -20.0 * (1 + math.log(edge[name]))
    odds = lambda n: min(0.0, math.log((words["in", n] + 1) / (words["out", n] + 1)))
    return scores, {"": 1.0, "a": odds("a"), "o": odds("o")}


def best_run(values: Iterable[float]) -> tuple[int, int]:
    """Where the contiguous run of the greatest positive sum begins and ends (exclusive), the first of equal ones; (0, 0) if there is none."""
    best, best_from, best_to, total, start = 0.0, 0, 0, 0.0, 0
    for i, x in enumerate(values):
        total += x
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, best_from, best_to = total, start, i + 1
    return best_from, best_to


def main_text(page: str | None) -> str:
    """The text of the best run: blocks in page order, joined by one newline; empty if there is none."""
    if not page:
        return ""
    scores, word = weights()
    seq = _sequence(page)
    count = Counter()
    for name, text in seq:
        count[name] += len(text.split())
    if not count[""] or count["o"] > MOSTLY * count[""]:
        word = word | {"o": 1.0}
    best_from, best_to = best_run(word[name] * len(text.split()) if text else scores.get(name, -0.3) for name, text in seq)
    blocks: list[str] = []
    parts: list[str] = []
    for name, text in seq[best_from:best_to]:
        if text:
            parts.append(html.unescape(text))
        elif name == "br" or name == "/br":
            parts.append(" ")
        elif name.lstrip("/") in BLOCKS and parts:
            blocks.append(" ".join("".join(parts).split()))
            parts.clear()
    blocks.append(" ".join("".join(parts).split()))
    return "\n".join(b for b in blocks if b)


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of each page, one row for each row.

    Null or empty html, and pages without text, give the empty text; very long pages take time in
    proportion to their length. Null ids and urls and
    repeated rows pass through; columns other than the three named are not read.
    """

    def make():
        def step(batch):
            for part in slices(batch, 256) if batch is not None else ():
                found = [main_text(x) for x in part.column(2).to_pylist()]
                yield {"page_id": part.column(0), "url": part.column(1), "text": found, "n_chars": [len(x) for x in found]}

        return step

    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    return arrow_map(rows, make, SCHEMA)
