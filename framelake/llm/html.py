"""Main text of web pages: streaming parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering.

A line is the text between two block tags. Its ratio is its characters over its tags; ratios are smoothed over
neighbouring lines, and a threshold between their two clusters marks content lines. The innermost container that holds
nearly all content characters, or the article or main element around it, is the content region. Its lines are the
text, but for those in elements that are named or labelled as menus, notices, adverts, forms or comments.

A label is a class name, id or role made of listed words only, or one that begins or ends with a word of the narrower list,
unless it says that something is with, without or open. It counts for no html, body, main or article, nor for what holds most
content characters unless an article or main element apart from it has a tenth as many of its own, or, for comments, the
article or main element around it. 'header' labels nothing in an article or main element.

Menus without a name are told by their links: a line that is nearly all links goes, outside an article or main element, and
inside one where three such lines follow each other. A menu or header that is never closed ends where an article or main element
begins; without one, it holds its lines of links and those before the first other line.

Null and empty pages, and pages without text, give the empty text. Repeated rows give repeated results. Pages of any
length are read whole; the parser keeps a page's lines only. An empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from framelake.llm.common import map_batches, table

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
SILENT = frozenset("script style noscript template svg math iframe object canvas audio video head title select textarea button datalist".split())
BOILER = frozenset("nav footer aside form menu dialog header".split())
CONTAINERS = frozenset("article main section div td body blockquote".split())
LABELS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header login menu modal nav "
    "navbar navigation newsletter notice notices popup promo promoted promotion related replies reply responses share sharing sidebar signup social sponsor "
    "sponsored subscribe toolbar widget".split()
)
#: Words that label by leading or ending a name, what a name says instead, and labels of what readers write.
EDGES = frozenset(
    "ad ads advert adverts advertisement breadcrumb breadcrumbs comment comments cookie cookies footer gdpr menu nav navbar navigation newsletter promo promoted related replies reply "
    "share sharing sidebar social sponsor sponsored subscribe".split()
)
SAYS = frozenset("has with no without open closed enabled disabled is on off".split())
TALK = frozenset("comment comments disqus replies reply responses".split())
#: Elements that end where an article or main element begins, and how much of a line in links makes it a menu's.
ENDED, LINKED, RUN = frozenset("nav menu header form dialog".split()), 0.8, 3
WHOLE = frozenset("html body main article".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SIGMA = 1.0
_parts = re.compile(r"[^a-z0-9]+").split
_kernel = np.exp(-0.5 * (np.arange(-3, 4) / SIGMA) ** 2)


def is_label(value: str, labels: frozenset[str]) -> bool:
    for name in value.lower().split():
        words = [w for w in _parts(name) if w]
        if words and (labels.issuperset(words) or (not EDGES.isdisjoint((words[0], words[-1])) and SAYS.isdisjoint(words))):
            return True
    return False


class Line(NamedTuple):
    text: str
    tags: int
    boiler: tuple[int, ...]  # boilerplate elements around, by number
    path: tuple[int, ...]  # containers around
    links: float  # the share of its characters in links


class Lines(HTMLParser):
    """Collects lines."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.names: list[str] = []  # of containers and labelled elements, by number
        self.labelled: set[int] = set()
        self.talk: set[int] = set()  # labelled as what readers write
        self.open: list[tuple[str, str]] = []  # tags that matter, and their kinds
        self.path: tuple[int, ...] = ()
        self.boiler: tuple[int, ...] = ()
        self.loose: set[int] = set()  # boilerplate elements that were never closed
        self.text: list[str] = []
        self.tags = self.silent = self.links = self.linked = self.boilers = 0

    def end_line(self) -> None:
        if self.text:
            line = " ".join("".join(self.text).split())
            if line:
                self.lines.append(Line(line, self.tags, self.boiler, self.path, self.linked / len(line)))
                self.tags = 0
            self.text = []
        self.linked = 0

    def _kind(self, tag: str, attrs: list) -> str:
        if tag in SILENT:
            return "silent"
        inside = any(t in ("article", "main") for t, _ in self.open)
        if tag in BOILER and not (tag == "header" and inside):
            return "boiler"
        if any(name == "hidden" or name == "aria-hidden" and value == "true" for name, value in attrs):
            return "boiler"
        if tag not in WHOLE:
            labels = LABELS - {"header"} if inside else LABELS
            names = [value for name, value in attrs if value and name in ("class", "id", "role")]
            if any(is_label(value, labels) for value in names):
                return "talk" if any(not TALK.isdisjoint(_parts(value.lower())) for value in names) else "labelled"
        return "container" if tag in CONTAINERS else ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag in INLINE:
            if tag == "br":
                self.text.append(" ")
            self.links += tag == "a"
            if not attrs or tag in VOID:
                return
        else:
            self.end_line()
            self.links = 0
        if tag in VOID or tag in ("html", "p", "ul", "li") and not attrs:
            return
        if tag in ("article", "main"):
            first = next((k for k, (t, kind) in enumerate(self.open) if kind == "boiler" and t in ENDED), None)
            while first is not None and len(self.open) > first:
                self._pop()
        kind = self._kind(tag, attrs)
        if kind:
            self.open.append((tag, kind))
            if kind in ("container", "labelled", "talk"):
                if kind != "container":
                    self.labelled.add(len(self.names))
                if kind == "talk":
                    self.talk.add(len(self.names))
                self.path = (*self.path, len(self.names))
                self.names.append(tag)
            elif kind == "boiler":
                self.boiler = (*self.boiler, self.boilers)
                self.boilers += 1
            else:
                self.silent += 1

    def _pop(self, loose: bool = False) -> str:
        tag, kind = self.open.pop()
        if kind in ("container", "labelled", "talk"):
            self.path = self.path[:-1]
        elif kind == "boiler":
            if loose:
                self.loose.add(self.boiler[-1])
            self.boiler = self.boiler[:-1]
        else:
            self.silent -= 1
        return tag

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag not in INLINE:
            self.end_line()
        elif tag == "a":
            self.links = max(0, self.links - 1)
        if any(t == tag for t, _ in self.open):
            while self.open and self._pop(tag in WHOLE and self.open[-1][0] != tag) != tag:
                pass

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        elif tag not in INLINE:
            self.tags += 1
            self.end_line()

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.text.append(data)
            if self.links:
                self.linked += len(" ".join(data.split()))

    def finish(self) -> list[Line]:
        self.close()
        self.end_line()
        while self.open:
            self._pop(True)
        return self.lines


def smoothed(ratios: np.ndarray) -> np.ndarray:
    padded = np.convolve(ratios, _kernel)[3:-3]
    return padded / np.convolve(np.ones(len(ratios)), _kernel)[3:-3]


def threshold(x: np.ndarray) -> float:
    """Between the means of two clusters of values, moved until it stays; 0 where the higher mean isn't twice the lower."""
    cut = float(x.mean())
    for _ in range(20):
        low, high = x[x < cut], x[x >= cut]
        if not len(low) or not len(high):
            break
        new = float(low.mean() + high.mean()) / 2
        if abs(new - cut) < 1e-6:
            break
        cut = new
    low, high = x[x < cut], x[x >= cut]
    return cut if len(low) and len(high) and high.mean() >= 2 * low.mean() else 0.0


def boiler_labels(parser: Lines, own: list[int], content: list[int], sizes: np.ndarray) -> set[int]:
    """The labelled elements whose lines go, given the lines that count and those of them that look like content."""
    total, out, held = sizes[content].sum(), set(), dict.fromkeys(parser.labelled, 0.0)
    for k in content:
        for c in [c for c in parser.lines[k].path if c in parser.labelled]:
            held[c] += sizes[k]
    whole = lambda k: {a for a in parser.lines[k].path if parser.names[a] in ("article", "main")}
    for c, n in held.items():
        if n * 2 > total:
            inside = [k for k in content if c in parser.lines[k].path]
            around = {a for k in inside for a in parser.lines[k].path}
            apart = [k for k in own if (whole(k) and c not in parser.lines[k].path if c in parser.talk else whole(k) - around)]
            if sizes[apart].sum() * 10 < n:
                continue
        out.add(c)
    return out


def menus(parser: Lines, own: list[int]) -> set[int]:
    """Lines that are nearly all links: outside an article or main element, or several in a row."""
    out, run = set(), []
    for k in own:
        line = parser.lines[k]
        run = [*run, k] if line.links >= LINKED else []
        inside = any(parser.names[a] in ("article", "main") for a in line.path)
        if run and (not inside or len(run) >= RUN):
            out.update(run[-RUN:] if inside else [k])
    return out


def plain_lines(parser: Lines) -> list[int]:
    """Lines outside boilerplate elements. One that was never closed holds its lines of links, and all before the first other one."""
    ended, out = set(), []
    for k, line in enumerate(parser.lines):
        if line.links < 0.5:
            ended.update(parser.loose.intersection(line.boiler))
        if all(b in ended and line.links < LINKED for b in line.boiler):
            out.append(k)
    return out


def main_text(html: str | None) -> str:
    parser = Lines()
    parser.feed(html or "")
    lines = parser.finish()
    if not lines:
        return ""
    sizes = np.array([len(line.text) for line in lines], float)
    x = smoothed(sizes / np.maximum(1, [line.tags for line in lines]))
    cut = threshold(x)
    own = plain_lines(parser)
    if parser.labelled:
        gone = boiler_labels(parser, own, [k for k in own if x[k] >= cut] or own, sizes)
        own = [k for k in own if gone.isdisjoint(lines[k].path)]
    listed = menus(parser, own)
    own = [k for k in own if k not in listed] or own
    content = [k for k in own if x[k] >= cut] or own
    if not content:
        return ""
    held: dict[int, float] = {}
    for k in content:
        for c in lines[k].path:
            held[c] = held.get(c, 0) + sizes[k]
    total, region = float(sizes[content].sum()), -1
    for c, n in held.items():
        if n >= 0.9 * total and parser.names[c] in CONTAINERS:
            region = max(region, c)  # containers are numbered as they open: the innermost comes last
    if region >= 0:
        path = next(lines[k].path for k in content if region in lines[k].path)
        around = [c for c in path[: path.index(region) + 1] if parser.names[c] in ("article", "main")]
        region = around[-1] if around else region
    return "\n".join(lines[k].text for k in own if region < 0 or region in lines[k].path)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of ``pages`` (page_id, url, html)."""

    def f(batch: dict[str, list]) -> dict[str, list]:
        texts = [main_text(h) for h in batch["html"]]
        return {"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    return map_batches(pages, f, "page_id long, url string, text string, n_chars long", ["page_id", "url", "html"])


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
