"""Main text of web pages by text-to-tag ratios.

The standard library's streaming parser gives start, end and text events.  Text between two borders of block
elements is a line, with the tags met in it; its ratio is text characters over tags.  The ratios, in page
order, are smoothed by a Gaussian, and lines over a threshold taken from their spread are content.  The content
region is then the innermost element that holds (nearly) all text of content lines, an article or main element
if there is one; all its lines belong to the text, short ones too, except those in parts that by element, role
or class are menus, headers, footers, sidebars, notices, adverts, forms, reader comments or no text at all.  The
class or id of an element that holds most text of content lines is no such mark, nor is a form that does: ratios
overrule it.  A name that only contains a word of many uses ("share-of-market") is evidence, not a verdict: its part goes
only where less than half of its text is in content lines.  Where a page names its parts, names and ratios mostly agree; where it doesn't, ratios alone decide.

Defined results: null or empty html gives an empty text; html without any tag is one block; unclosed and
stray tags are borne as browsers do; pages of any length are read whole; repeated rows give repeated rows; input
columns named like an output column are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .rows import append

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
#: Elements whose text is never the page's main text.
OUT = frozenset("script style noscript template head title nav footer aside form button select option textarea input iframe object svg canvas math audio video menu dialog datalist".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of class and id names that mark such parts.
OUT_WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead cookie cookies consent notice notices gdpr popup modal newsletter subscribe signup share sharing social related recommended comment comments commentlist reply replies respond disqus discussion widget toolbar pager pagination".split())
#: Those of them that mark a part whatever else its name says; the others do where all of a name is such words or plain
#: ones of layout.
SURE_WORDS = frozenset("ads adv advert adverts advertisement advertising navbar breadcrumb breadcrumbs sidebar footer masthead cookie cookies gdpr popup modal newsletter disqus commentlist pagination".split())
LAYOUT_WORDS = frozenset("active area article articles bar block body bottom box btn button buttons center closed col column container content count email entry feed fixed form global group has head header heading holder icon icons inner is item items js left link links list mail main message more msg news no open outer overlay page pane panel post posts primary right row secondary section set side single site slot sticky stories story text thread threads title tools top unit us widgets with wrap wrapper your zone".split())
#: What class and id say, and forms, which may wrap a whole page: the ratios can overrule these.
SOFT = ("comments", "class", "form")
COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond disqus discussion".split())
_SPLIT_NAME = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
#: What an open element closes by itself when one of these starts.
CLOSES = {"p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "option": frozenset(["option"])}
#: Numbers of so many digits that the standard library doesn't read them; no character has one over 0x10ffff.
_LONG_NUMBER = re.compile(r"&#([0-9]{1000,})")
_STOP = frozenset("ul ol table article section div body html main td th".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Line:
    """``marks``: the elements around it that class or id takes out; ``pieces``: its text, each piece with the marked
    elements inside the line that hold it."""

    __slots__ = ("path", "pieces", "tags", "hard", "marks", "text", "out")

    def __init__(self, path: tuple[int, ...], pieces: list[tuple[str, frozenset[int]]], tags: int, hard: bool, marks: frozenset[int]) -> None:
        self.path, self.pieces, self.tags, self.hard, self.marks = path, pieces, tags, hard, marks
        self.text, self.out = "", hard


class Lines(HTMLParser):
    """Lines of a page, from parser events."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, str]] = []  # element, its number, why its text is out ("" if it isn't)
        self.count, self.tags, self.pending, self.lines, self.kinds = 0, 0, [], [], {}
        self.marked: dict[int, str] = {}  # elements that class or id takes out, and forms
        self.hinted: set[int] = set()  # elements whose class or id has such a word beside others

    def flush(self) -> None:
        if any(not data.isspace() for data, _ in self.pending if data):
            hard = [why for _, _, why in self.stack if why not in ("", *SOFT)]
            exempt = self.stack and self.stack[-1][0] in _HEADINGS and all(why == "article header" for why in hard)
            marks = frozenset(n for tag, n, why in self.stack if why in SOFT and tag in BLOCKS)
            self.lines.append(Line(tuple(n for _, n, _ in self.stack), self.pending, self.tags, bool(hard) and not exempt, marks))
            self.tags = 0
        self.pending = []

    def why(self, tag: str, attrs: list) -> str:
        if tag == "form":
            self.marked[self.count] = "form"
        if tag in OUT:
            return tag
        if tag == "header":
            return "article header" if any(t in ("article", "main") for t, _, _ in self.stack) else "header"
        if not attrs:
            return ""
        found = {k: v or "" for k, v in attrs if k in ("class", "id", "role", "hidden", "aria-hidden", "style")}
        if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", ""):
            return "hidden"
        if found.get("role", "").lower() in OUT_ROLES:
            return "role"
        if tag not in ("html", "body", "article", "main") or found.keys() & {"class", "id"}:
            names, hints = set(), set()
            for name in f"{found.get('class', '')} {found.get('id', '')}".split():
                words = {x.lower() for x in _SPLIT_NAME.split(name) if x}
                (names if words & SURE_WORDS or words <= OUT_WORDS | LAYOUT_WORDS else hints).update(words)
            if names & COMMENT_WORDS:
                self.marked[self.count] = "comments"
                return "comments"
            if tag not in ("html", "body", "article", "main"):
                if names & OUT_WORDS:
                    self.marked[self.count] = "class"
                    return "class"
                if hints & OUT_WORDS:
                    self.hinted.add(self.count)
        return ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag == "br":
            self.pending.append((" ", frozenset()))
        if tag in BLOCKS:
            self.flush()
        if tag in VOID:
            return
        for k in range(len(self.stack) - 1, -1, -1):
            name = self.stack[k][0]
            if tag in CLOSES.get(name, ()):
                del self.stack[k:]
                break
            if name in _STOP:
                break
        if tag in ("article", "main") and not any(w == "comments" or t == "aside" for t, _, w in self.stack):
            # an advert or menu that was never closed doesn't swallow the article
            for k, (_, _, why) in enumerate(self.stack):
                if why:
                    del self.stack[k:]
                    break
        self.count += 1
        self.kinds[self.count] = tag
        self.stack.append((tag, self.count, self.why(tag, attrs)))

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                break

    def updatepos(self, i: int, j: int) -> int:
        """Line numbers aren't needed."""
        return j

    def handle_data(self, data: str) -> None:
        # parts inside a block, such as scripts and buttons, leave it without parting it
        inline = [(n, why) for tag, n, why in self.stack if why and tag not in BLOCKS]
        if all(why in SOFT for _, why in inline):
            self.pending.append((data, frozenset(n for n, _ in inline)))

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """A comment up to the next `>`, as in browsers."""
        return self.parse_bogus_comment(i, report)


def smooth(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing over neighbouring lines; edges repeat."""
    reach = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def clustered(ratios: np.ndarray) -> np.ndarray:
    """Which lines are content: two clusters of smoothed ratios, their border half-way between the clusters'
    means, found by moving it from the mean spread until it rests."""
    if not len(ratios):
        return np.zeros(0, bool)
    border = min(float(ratios.std()), float(ratios.mean())) or 0.0
    for _ in range(50):
        high, low = ratios[ratios > border], ratios[ratios <= border]
        if not len(high) or not len(low):
            break
        new = (high.mean() + low.mean()) / 2
        if abs(new - border) < 1e-9:
            break
        border = new
    content = ratios > border
    return content if content.any() else np.ones(len(ratios), bool)


def told(lines: list[Line], ignored: frozenset[int]) -> list[Line]:
    """The lines that have text, with text, tags and out as they are if the marks of ``ignored`` elements don't count;
    tags of lines without text go to the next."""
    out, tags = [], 0
    for x in lines:
        x.text = " ".join("".join(data for data, marks in x.pieces if marks <= ignored).split())
        tags += x.tags
        if x.text:
            x.out = x.hard or not x.marks <= ignored
            out.append((x, max(1, tags)))
            tags = 0
    return out


def content_of(lines: list[tuple[Line, int]], sigma: float, own: float = 0.0) -> list[Line]:
    """Lines that aren't out and whose smoothed ratio makes them content; ``own``: without those whose own ratio is under
    that share of the least smoothed one, if others aren't: such owe it to their neighbours alone, and are as often the
    edge of a menu as a heading."""
    if not lines:
        return []
    ratios = np.asarray([0.0 if x.out else len(x.text) / tags for x, tags in lines])
    smoothed = smooth(ratios, sigma)
    content = clustered(smoothed) & np.asarray([not x.out for x, _ in lines])
    strong = content & (ratios >= own * smoothed[content].min(initial=np.finfo(float).max))
    return [x for (x, _), c in zip(lines, strong if strong.any() else content, strict=True) if c]


def _marked(x: Line) -> Counter:
    """Characters of a line by marked element around it, or inside it."""
    sizes = Counter(dict.fromkeys(x.marks, len(x.text)))
    for data, marks in x.pieces:
        for n in marks:
            sizes[n] += len(" ".join(data.split()))
    return sizes


def wrappers(parser: Lines, sigma: float) -> frozenset[int]:
    """Elements that class or id takes out, or forms, although they hold most text of the content lines, by ratios that heed no
    such name. Where an article or main element outside of them has content the name is right, and reader comments,
    which may be longer than what they are about, must hold all content lines and 95 % of all text."""
    if not parser.marked:
        return frozenset()
    lines = told(parser.lines, frozenset(parser.marked))
    text, content = [x for x, _ in lines if not x.out], content_of(lines, sigma)
    held, parts, every = Counter(), Counter(), Counter()
    for x in content:
        for n, size in _marked(x).items():
            held[n] += size
            parts[n] += 2 * size > len(x.text)
    for x in text:
        every.update(_marked(x))
    most, whole = sum(len(x.text) for x in content) / 2, 0.95 * sum(len(x.text) for x in text)
    named = {n for n, tag in parser.kinds.items() if tag in ("article", "main")}
    left = set(parser.marked)
    for n, why in sorted(parser.marked.items()):  # outer ones first
        if held[n] <= most or any(named.intersection(x.path) and not left.intersection(x.path) for x in content):
            continue
        if why != "comments" or (parts[n] == len(content) and every[n] >= whole):
            left.remove(n)
    return frozenset(parser.marked.keys() - left)


def drop_hinted(parser: Lines, lines: list[tuple[Line, int]], sigma: float) -> None:
    """Take out the parts that a name hints at and ratios don't hold: of whose text less than half is content."""
    if not parser.hinted:
        return
    content, size, held = set(map(id, content_of(lines, sigma, own=0.25))), Counter(), Counter()
    for x, _ in lines:
        for n in parser.hinted.intersection(x.path) if not x.out else ():
            size[n] += len(x.text)
            held[n] += len(x.text) * (id(x) in content)
    gone = {n for n in size if 2 * held[n] < size[n]}
    for x, _ in lines:
        x.out = x.out or not gone.isdisjoint(x.path)


def main_text(html: str | None, sigma: float = 1.0, whole: float = 0.95) -> str:
    """The blocks of the content region, joined by line feeds. ``whole``: share of the content lines' text that
    the region must hold."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(_LONG_NUMBER.sub(lambda m: "&#" + (m[1].lstrip("0")[:8] or "0"), html))
    parser.close()
    parser.flush()
    every = told(parser.lines, wrappers(parser, sigma))
    drop_hinted(parser, every, sigma)
    lines = [x for x, _ in every if not x.out]
    if not lines:
        return ""
    chosen = content_of(every, sigma, own=1.0) or lines
    held: dict[int, int] = {}
    for x in chosen:
        for n in x.path:
            held[n] = held.get(n, 0) + len(x.text)
    total = sum(len(x.text) for x in chosen)
    named = [n for n, size in held.items() if parser.kinds[n] in ("article", "main") and size >= 0.5 * total]
    full = [n for n, size in held.items() if size >= whole * total and parser.kinds[n] not in ("p", "b", "i", "em", "strong", "span", "a", "li", *_HEADINGS)]
    region = max(named or full, default=0)  # the highest number is the innermost
    if named and parser.kinds[region] == "article" and len(named) == 1:
        # several articles of one page are each part of its text
        outer = next((x.path[: x.path.index(region)] for x in lines if region in x.path), ())
        beside = {x.path[len(outer)] for x in lines if len(x.path) > len(outer) and x.path[: len(outer)] == outer and parser.kinds[x.path[len(outer)]] == "article"}
    else:
        beside = {region}
    return "\n".join(x.text for x in lines if not region or beside & set(x.path))


def extract(df: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``df`` with text (the page's main text) and n_chars (its code points)."""
    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]

    def run(pages: pa.Array) -> list:
        texts = [main_text(x) for x in pages.to_pylist()]
        return [texts, [len(x) for x in texts]]

    return append(df, html, fields, run, keep)
