"""The main text of a web page, from the standard library's streaming parser.

The parser's events make lines, one for each block of the page. Each line has a ratio of text outside of links to tags,
weighed by where it stands: elements that are made for something else (navigation, forms) count for nothing, names of
class and id that speak for it for little. The ratios are smoothed with a Gaussian and compared with their spread. Lines
above it form clusters, and the regions of the page that hold a cluster are its content, with all their lines, short ones
too. A region that its names speak against is content only if it holds a cluster of its own.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyhold.llm.shared import free

SIGMA = 1.0  # of the Gaussian, in lines
RADIUS = 2
#: Elements, words of class and id, and roles.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NEVER = frozenset("script style noscript template svg math iframe object canvas audio video select textarea button form nav aside footer menu dialog head title applet map datalist".split())
MAIN = frozenset("article main".split())
REGION = frozenset("article main section div td body".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice popup modal overlay "
    "sidebar aside nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer comment comments disqus respond replies share sharing social "
    "related recommended newsletter subscribe signup login toolbar skip widget masthead".split()
)
#: Words that say nothing by themselves, beside those of HINTS.
NEUTRAL = frozenset("site page main top bottom left right box bar list block area section container wrapper wrap inner item items global the post article entry content js col row".split())
HEADER = frozenset("header topbar".split())  # speaks for a header; inside an article that holds its title
STRONG, WEAK = 0.1, 0.5  # weights of an element with a name made of hints alone, or of one with a hint in it
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that a like one, or its parent's next child, ends.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Line:
    text: str
    tags: int
    weight: float  # 0: in an element that is made for something else
    article: int  # number of the outermost article or main element; 0: none
    region: int  # number of the innermost element that can be a region; 0: the body
    heading: bool
    path: tuple[int, ...] = ()  # the regions around it below the body, outermost first
    linked: int = 0  # characters in links, white space left out

    @property
    def ratio(self) -> float:
        return self.weight * max(0, len(self.text) - self.linked) / max(1, self.tags)


class Lines(HTMLParser):
    """Turns parser events into lines."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.stack: list[tuple[str, float, int, tuple[int, ...]]] = []  # element, weight, article, regions
        self.doubted: set[int] = set()  # regions that their names speak against
        self.open: Counter = Counter()
        self.parts: list[str] = []
        self.tags = self.number = self.linked = 0
        self.tag = ""

    def _state(self) -> tuple[float, int, tuple[int, ...]]:
        return self.stack[-1][1:] if self.stack else (1.0, 0, ())

    def _end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            weight, article, path = self._state()
            self.lines.append(Line(text, self.tags, weight, article, path[-1] if path else 0, self.tag in HEADINGS, path, self.linked))
        if text or len(self.parts):
            self.tags = 0
        self.parts, self.linked = [], 0

    def _pop_to(self, names: tuple[str, ...], within: frozenset[str]) -> None:
        """Close the innermost open element of these, if no element of ``within`` lies further in."""
        if not any(self.open[n] for n in names):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in names:
                for x in self.stack[i:]:
                    self.open[x[0]] -= 1
                del self.stack[i:]
                return
            if self.stack[i][0] in within:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        block = tag not in INLINE
        if block:
            self._end_line()
            self._pop_to(("p",), REGION)
            if tag in ENDS:
                self._pop_to(ENDS[tag], frozenset(("ul", "ol", "dl", "table", "menu")))
            self.tag = tag
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        weight, article, path = self._state()
        named = self._named(tag, attrs, bool(article)) if block else 1.0
        if tag in MAIN and named:
            weight = 1.0  # what was left open before it ends here
        elif weight:
            weight *= 0.0 if tag in NEVER or (tag == "header" and not article) else named
        doubted = weight and named == STRONG and tag not in MAIN
        if tag in REGION or doubted:
            self.number += 1
            if tag != "body":
                path = (*path, self.number)
            if doubted:
                self.doubted.add(self.number)
            if tag in MAIN and weight and not article:
                article = self.number
        self.stack.append((tag, weight, article, path))
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash ends only what is void anyway

    @staticmethod
    def _named(tag: str, attrs: list[tuple[str, str | None]], inside: bool) -> float:
        """The weight that attributes give an element: 0 if it is hidden or has another role, else by its names."""
        out = 1.0
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return 0.0
            if name == "role" and (value or "").lower() in ROLES:
                return 0.0
            if name in ("class", "id") and tag not in ("body", "html"):
                for one in (value or "").split():
                    words = {w.lower() for w in _WORDS.findall(one)}
                    speaks = words & HINTS or (not inside and words & HEADER)
                    if speaks:
                        out = min(out, STRONG if words <= HINTS | HEADER | NEUTRAL else WEAK)
        return out

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self._end_line()
            self.tag = ""
        self.tags += 1
        self._pop_to((tag,), frozenset() if tag in REGION or tag in NEVER else REGION)

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        if self.open["a"]:
            self.linked += len("".join(data.split()))

    def finish(self) -> list[Line]:
        self.close()
        self._end_line()
        return self.lines


def smoothed(ratios: np.ndarray, sigma: float = SIGMA, radius: int = RADIUS) -> np.ndarray:
    """Gaussian smoothing; at the ends, with what there is."""
    k = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * sigma * sigma))
    full = lambda x: np.convolve(x, k)[radius : radius + len(x)]
    return full(ratios) / full(np.ones(len(ratios)))


def select(lines: list[Line], doubted: set[int] | frozenset[int] = frozenset()) -> list[str]:
    """The texts of the lines in content regions, in page order."""
    if not lines:
        return []
    ratios = np.array([x.ratio for x in lines])
    smooth = smoothed(ratios)
    least = smooth.std()
    # a cluster's lines; a region is chosen by a line that reaches the threshold by itself, not by its neighbours alone
    seeds = [i for i, x in enumerate(lines) if x.weight and ratios[i] > 0 and ratios[i] >= least and smooth[i] >= least]
    holds = {r for i in seeds for r in lines[i].path}
    fit = [x.weight > 0 and all(r in holds for r in x.path if r in doubted) for x in lines]
    articles = {x.article for x, ok in zip(lines, fit) if ok and x.article and len(x.text) > x.linked}
    if len(articles) > 1:  # teasers may be articles too
        inside = sum(lines[i].weight * len(lines[i].text) for i in seeds if lines[i].article)
        articles = {lines[i].article for i in seeds if lines[i].article} if 2 * inside >= sum(lines[i].weight * len(lines[i].text) for i in seeds) else set()
    if articles:
        return [lines[i].text for i in _undoubted([i for i, x in enumerate(lines) if fit[i] and x.article in articles], lines, doubted)]
    return [lines[i].text for i in sorted(_kept(lines, fit, {lines[i].region for i in seeds}, seeds))]


def _undoubted(at: list[int], lines: list[Line], doubted: set[int] | frozenset[int]) -> list[int]:
    """Positions of an article's lines but for the regions in it that their names speak against, unless one holds most of its text."""
    chars = lambda some: sum(len(lines[i].text) for i in some)
    for r in {r for i in at for r in lines[i].path if r in doubted}:
        own = [i for i in at if r in lines[i].path]
        if 2 * chars(own) < chars(at):
            at = [i for i in at if r not in lines[i].path]
    return at


def _kept(lines: list[Line], fit: list[bool], regions: set[int], seeds: list[int]) -> set[int]:
    """Positions of the lines that fit and belong to the chosen regions; the threshold has no say any more.

    A region below the body stays whole, with the regions in it. So does all content between the first and the last line
    that stay, and what lies in the same element (below the body) as a chosen region or, in the body, beside a chosen
    line, unless most of it is links.
    """
    if not seeds:
        return set()
    lines_of: dict[tuple[int, ...], list[int]] = {}  # what stands beside chosen regions, by the outermost region that isn't around them
    parents = {x.path[-2] for x in (lines[i] for i in seeds) if len(x.path) > 1}
    out = set(seeds)
    for i, x in enumerate(lines):
        if not fit[i]:
            continue
        if any(r in regions for r in x.path):
            out.add(i)
        elif not x.path:
            if 0 in regions:
                lines_of.setdefault((0, i), []).append(i)
        elif (beside := [k for k, r in enumerate(x.path) if r in parents]):
            lines_of.setdefault((*x.path[: beside[0] + 2], *([-i - 1] if len(x.path) == beside[0] + 1 else [])), []).append(i)
    for at in lines_of.values():
        if 2 * sum(lines[i].linked for i in at) < sum(len("".join(lines[i].text.split())) for i in at):
            out.update(at)
    first, last = min(out), max(out)
    while first and lines[first - 1].heading and fit[first - 1] and lines[first - 1].region == lines[first].region:
        first -= 1  # the headings right above
    return {i for i in range(first, last + 1) if fit[i]}


def main_text(html: str | None) -> str:
    """The page's main text, blocks apart by an empty line; empty for null, empty or contentless pages."""
    parser = Lines()
    parser.feed(html or "")
    return "\n\n".join(select(parser.finish(), parser.doubted))


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The rows of ``pages`` without the html, with text (string) and n_chars (long, code points).

    Columns named text or n_chars are replaced. A null, empty or contentless page has an empty text. Rows that repeat are
    rows of their own. An empty table gives no rows.
    """
    keep, at = [c for c in pages.columns if c not in (html_col, "text", "n_chars")], free(pages, "source")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b[at].to_pylist()]
            cols = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*[b[c] for c in keep], *cols], [*keep, "text", "n_chars"])

    schema = T.StructType([*[pages.schema[c] for c in keep], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html_col}`").alias(at)).mapInArrow(run, schema)
