"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams its events into lines, one for each block. A line has its characters and the tags
since the line before; their ratio is smoothed by a Gaussian over the lines, and a threshold of one standard deviation
clusters lines into content and the rest. The content lines then select regions. A wrapper whose name sounds like a
menu or header but that holds most of the content is no such thing; the article is the region for which the content
lines vote by their characters; and a list or block inside it that is mostly links and not mostly content is a menu.
All other lines of the article stay, so a short paragraph between long ones does too. Adverts, notices, reader comments,
navigation, footers, sidebars, forms, scripts and styles are in no region.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA = 1.0
#: Elements whose text is never shown, elements that are never part of an article, and those that may wrap one.
HIDDEN = frozenset("head script style noscript template iframe object svg canvas select textarea option".split())
OUTSIDE = frozenset("nav footer aside button dialog menu".split())
WRAPPER = frozenset("form header".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD_ONLY = frozenset("base link meta noscript script style template title".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that begin and end a line.
BLOCK = HEADING | frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that can be the article, and those that can also be a menu inside it.
REGION = frozenset("article main section div td body".split())
GROUP = REGION | frozenset("ul ol dl table".split())
#: Items that end where the next one of their container begins.
ITEM = {"li": "li", "dt": "d", "dd": "d", "tr": "tr", "td": "td", "th": "td"}
CONTAINER = {"ul": ("li",), "ol": ("li",), "menu": ("li",), "dir": ("li",), "dl": ("d",), "table": ("tr", "td")}
#: Words that name, in a class, id or role, what is never part of an article, and what may be a wrapper around one.
NEVER = frozenset(
    "ad ads adverts adsense adsbygoogle sponsor sponsors sponsored promo promos promotion promotions cookie cookies consent gdpr notice notices disclaimer comment comments commentlist disqus replies respond newsletter subscribe subscription share sharing social related recommended breadcrumb breadcrumbs pagination pager popup".split()
)
PERHAPS = frozenset("banner sidebar menu nav navbar navigation footer masthead header modal overlay widget widgets toolbar login signup search complementary contentinfo".split())
COMMENTS = frozenset("comment comments commentlist disqus replies respond".split())
#: Parts of a name that say nothing by themselves.
PLAIN = frozenset("wrapper wrap container box area section block list bar panel inner outer region unit slot top bottom left right main site page global primary secondary sub mobile desktop links link items item text title thread buttons button icons form posts articles stories content body group row col column".split())
PART = re.compile(r"[A-Z]*[a-z]+|[A-Z]+|[0-9]+")
SPACES = re.compile(r"\s+")


def named(value: str) -> tuple[bool, bool, bool]:
    """Whether a class, id or role names something never in an article, perhaps in one, or comments.

    A word counts if all its parts are known names but for plain ones: `top-nav` and `cookie-notice` count, `has-sidebar`,
    `related-work` and `entry-header` do not.
    """
    never = perhaps = comments = False
    for word in value.replace("side-bar", "sidebar").split():
        parts = {p.lower() for p in PART.findall(word)}
        own = {p for p in parts if p not in PLAIN and not p.isdigit()}
        if not own or not all(p in NEVER or p in PERHAPS or p.startswith("advert") for p in own):
            continue
        comments = comments or not own.isdisjoint(COMMENTS)
        if own <= PERHAPS:
            perhaps = True
        else:
            never = True
    return never, perhaps, comments


class Lines(HTMLParser):
    """Collects lines of (text, tags, linked characters, group, zone).

    A group is the innermost open element of GROUP, a zone the innermost that lies around an article; both are numbers
    into lists of (element, parent), and a zone also knows whether it may be a wrapper.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, int]] = []
        self.groups: list[tuple[str, int]] = [("body", -1)]
        self.zones: list[tuple[bool, int]] = [(True, -1)]  # zone 0 is no zone
        self.open: list[tuple[str, int, int, bool]] = []  # element, the group and zone outside it, and whether it is veiled
        self.count: dict[str, int] = {}
        self.items: dict[str, list[int]] = {g: [-1] for g in ITEM.values()}  # open item of each open container
        self.group = self.zone = self.tags = self.linked = 0
        self.hidden = self.veils = 0  # open elements that show nothing, and those of them that stand inside a line
        self.held: list[str] = []

    def _flush(self) -> None:
        text = SPACES.sub(" ", "".join(self.held)).strip()
        self.held.clear()
        if text:
            self.lines.append((text, max(1, self.tags), min(self.linked, len(text)), self.group, self.zone))
            self.tags = 0
        self.linked = 0

    def _is(self, *tags: str) -> bool:
        return any(self.count.get(t) for t in tags)

    def _pop(self) -> str:
        tag, group, zone, veiled = self.open.pop()
        if tag in BLOCK or zone != self.zone:
            self._flush()
        self.count[tag] -= 1
        self.hidden -= tag in HIDDEN or veiled
        self.veils -= veiled
        self.group, self.zone = group, zone
        for key in CONTAINER.get(tag, ()):
            self.items[key].pop()
        if tag in ITEM and self.items[ITEM[tag]][-1] == len(self.open):
            self.items[ITEM[tag]][-1] = -1
        return tag

    def _pop_to(self, size: int) -> None:
        while len(self.open) > size:
            self._pop()

    def _pop_through(self, tag: str) -> None:
        while self._pop() != tag:
            pass

    def _zone(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool | None:
        """None for an element inside, else whether it may be a wrapper of the article."""
        if tag in OUTSIDE:
            return False
        if tag in HEADING or tag in ("html", "body"):
            return None
        inside = self._is("article", "main")
        names = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v)
        never, perhaps, comments = named(names) if names else (False, False, False)
        if tag in ("article", "main"):
            return False if comments else None
        if never or any(k == "hidden" or (k == "aria-hidden" and v == "true") for k, v in attrs):
            return False
        if tag == "header" or (perhaps and inside and "header" in names.lower()):
            return None if inside else True
        return True if perhaps or tag in WRAPPER else None

    def _implied_ends(self, tag: str) -> None:
        if self.count.get("head") and tag not in HEAD_ONLY and tag != "head":
            self._pop_through("head")
        if tag in BLOCK and self.count.get("p"):
            self._pop_through("p")
        if tag in ITEM:
            at = self.items[ITEM[tag]][-1]
            if 0 <= at < len(self.open):
                self._pop_to(at)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        self._implied_ends(tag)
        if tag in BLOCK:
            self._flush()
        elif tag == "br":
            self.held.append(" ")
        if tag in VOID:
            return
        if tag == "a":
            self.handle_endtag("a")
            self.tags -= 1
        if tag in ("article", "main") and (self.zone or self.veils) and not self._is("article", "main", *OUTSIDE) and self._zone(tag, attrs) is None:
            # an article begins where a notice or menu before it was left open
            while self.zone or self.veils:
                self._pop()
        wrapper = self._zone(tag, attrs)
        # a control or advert inside a line shows nothing and does not end the line
        veiled = wrapper is False and tag not in BLOCK and tag not in HIDDEN
        wrapper = None if veiled else wrapper
        if tag not in BLOCK and tag not in HIDDEN and tag != "a" and wrapper is None and not veiled:
            return  # an inline element needs no end
        if wrapper is not None:
            self._flush()
        self.open.append((tag, self.group, self.zone, veiled))
        self.count[tag] = self.count.get(tag, 0) + 1
        self.hidden += tag in HIDDEN or veiled
        self.veils += veiled
        if tag in ITEM:
            self.items[ITEM[tag]][-1] = len(self.open) - 1
        for key in CONTAINER.get(tag, ()):
            self.items[key].append(-1)
        if wrapper is not None:
            self.zones.append((wrapper, self.zone))
            self.zone = len(self.zones) - 1
        if tag in GROUP and tag != "body":
            self.groups.append((tag, self.group))
            self.group = len(self.groups) - 1

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if not self.count.get(tag):
            return
        if tag not in BLOCK and tag not in HIDDEN:
            # blocks are not ended by what stands open around them
            at = len(self.open) - 1
            while self.open[at][0] != tag:
                if self.open[at][0] in BLOCK:
                    return
                at -= 1
        self._pop_through(tag)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # browsers ignore the slash
        if tag in HIDDEN:
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        self.held.append(data)
        if self.count.get("a"):
            self.linked += len(data.strip())

    def read(self, page: str) -> None:
        """Feeds a whole page in time linear in its length, however its last tags are left unfinished."""
        self.feed(page)
        rest = self.rawdata
        if rest.startswith("<") and not rest.startswith("<!--") and not self.cdata_elem and ">" in rest:
            # a quote left open hides the ends of all tags after it: read them without quotes
            self.rawdata = ""
            self.feed(re.sub(r"<[^<>]*>", lambda m: "" if m[0][1] in "!?" else m[0].replace('"', " ").replace("'", " "), rest))
            rest = self.rawdata
        self.rawdata = ""
        # what is left is a comment, script or tag without end, which shows nothing, or text
        if rest and not self.cdata_elem and not re.match(r"<[A-Za-z/!?]", rest):
            self.handle_data(unescape(rest))
        self._pop_to(0)
        self._flush()


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing with the kernel renormalised at the ends."""
    reach = max(1, round(3 * sigma))
    kernel = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * sigma**2))
    cut = slice(reach, reach + len(ratios))
    return np.convolve(ratios, kernel)[cut] / np.convolve(np.ones(len(ratios)), kernel)[cut]


def content_lines(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """True for lines whose smoothed ratio reaches the standard deviation of the smoothed ratios."""
    values = smoothed(ratios, sigma)
    return values >= min(values.std(), values.max())


def _sums(values: np.ndarray, at: np.ndarray, parents: list[int]) -> np.ndarray:
    """Sums of values by the numbers `at` and all their ancestors; a parent comes before its children."""
    out = np.bincount(at, values, minlength=len(parents))
    for n in range(len(parents) - 1, 0, -1):
        out[parents[n]] += out[n]
    return out


def _outside(lines: Lines, chars: np.ndarray, content: np.ndarray) -> np.ndarray:
    """True for lines in a zone; a wrapper is none if it holds over half of the content that no certain zone holds."""
    zone = np.array([z for *_, z in lines.lines])
    parents = [p for _, p in lines.zones]
    certain = np.zeros(len(parents), bool)
    for n in range(1, len(parents)):
        certain[n] = certain[parents[n]] or not lines.zones[n][0]
    votes = chars * (content & ~certain[zone])
    held = _sums(votes, zone, parents)
    out = certain.copy()
    for n in range(1, len(parents)):
        out[n] = certain[n] or out[parents[n]] or 2 * held[n] <= votes.sum()
    return out[zone]


def main_text(html: str | None, sigma: float = SIGMA) -> str:
    """The article's blocks in page order, one a line; empty if a page has none."""
    if not html:
        return ""
    page = Lines()
    page.read(html)
    if not page.lines:
        return ""
    chars = np.array([len(text) for text, *_ in page.lines], float)
    tags, linked, group = (np.array([line[k] for line in page.lines]) for k in (1, 2, 3))
    at = np.flatnonzero(~_outside(page, chars, content_lines(chars / tags, sigma)))
    if not len(at):
        return ""
    # the lines that are left are clustered by themselves, so that long comments do not hide a short article
    content = content_lines(chars[at] / tags[at], sigma)
    parents = [p for _, p in page.groups]
    chars, linked, group = chars[at], linked[at], group[at]
    votes = _sums(chars * content, group, parents)

    regions = [n for n, (tag, _) in enumerate(page.groups) if tag in REGION]
    elements = [n for n in regions if page.groups[n][0] in ("article", "main") and 2 * votes[n] >= votes[0]]
    if elements:  # the named element with the most content; of nested ones with as much, the inner
        best = max(elements, key=lambda n: (votes[n], n))
    else:  # the innermost region that holds nearly all content
        best = max((n for n in regions if votes[n] >= 0.9 * votes[0]), default=0)
    linked_in, all_in = _sums(linked, group, parents), _sums(chars, group, parents)
    inside, menu = np.zeros(len(parents), bool), np.zeros(len(parents), bool)
    for n, p in enumerate(parents):
        inside[n] = n == best or (p >= 0 and inside[p])
        # inside the article, a group of links that content does not vote for
        menu[n] = (p >= 0 and menu[p]) or (inside[n] and n != best and linked_in[n] >= 0.8 * all_in[n] and 2 * votes[n] < all_in[n])
    kept = np.flatnonzero(inside[group] & ~menu[group])
    if not elements and len(kept):  # without a named element, groups without content before and after it are not its text
        hits = kept[content[kept]]
        if len(hits):
            kept = kept[(votes[group[kept]] > 0) | ((kept >= hits[0] - 1) & (kept <= hits[-1]))]
    return "\n".join(page.lines[n][0] for n in at[kept])


def _extract(sigma: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = pa.array([main_text(h.as_py(), sigma) for h in batch.column("html")], pa.string())
            yield batch.set_column(at, pa.field("text", pa.string()), texts)

    return run


def extracted(pages: DataFrame, sigma: float = SIGMA) -> DataFrame:
    """pages with the columns text and n_chars (code points) of the whole html; columns of these names are replaced.

    A null or empty page has the empty text. Every row stays, repeated ones and those of null ids too.
    """
    names = [n for n in pages.columns if n not in ("text", "n_chars")]
    rows = pages.select(*[F.col(f"`{n}`") for n in names], F.lit(None).cast("string").alias("text"))
    return rows.mapInArrow(_extract(sigma), rows.schema).withColumn("n_chars", F.length("text").cast("long"))
