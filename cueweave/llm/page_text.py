"""Main text of web pages: parser events, text-to-tag ratios, smoothing, clustering.

The standard library's parser streams its events once; nothing builds a tree.
A block of text is a line with a text-to-tag ratio (visible characters outside
links per tag). The ratios are smoothed with a Gaussian along the page, split
into two clusters, and the containers in which the upper cluster lies are the
content regions. An article is one region, with all tables, figures and divisions
inside of it. Elements whose tag or class says that they are no content
(menus, footers, forms, comments, ...) open no lines.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from cueweave.llm.common import slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol optgroup option p pre section summary table tbody td "
    "tfoot th thead tr ul".split())
#: Elements that never hold article text.
SILENT = frozenset(
    "head title script style noscript template nav footer aside form button select option textarea input label iframe "
    "object svg math canvas audio video dialog menu annotation annotation-xml".split())
#: Of these, what may hold text of an article when it stands inside of one.
INSIDE = frozenset("math object label".split())
#: Elements that open a region even inside an article.
REGION = frozenset("article main".split())
CONTAINER = frozenset("article main section div td body html blockquote figure details".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Opening one of these ends an open element of the second set.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "option": {"option"}}
#: Words of class, id and role that mark what is no article text.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox banner sponsor sponsored promo promotion cookie "
    "cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer foot masthead topbar comment comments "
    "commentlist disqus reply replies respond share sharing social related recommended recommendations teaser "
    "teasers widget widgets toolbar pagination pager paywall copyright disclaimer search skip contentinfo "
    "complementary".split())
TOP = frozenset("header banner masthead".split())
_WORDS = re.compile(r"[A-Za-z][a-z]*|[0-9]+")
_MARKED = re.compile(r"<!\[[^>]*>")


class Lines(HTMLParser):
    """(text, ratio, container, in an article) per block, in page order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, float, int, bool]] = []
        # Open elements: tag, silent, container, in an article, in its header.
        self.open: list[tuple[str, bool, int, bool, bool]] = [("", False, 0, False, False)]
        self.count: Counter[str] = Counter()
        self.containers = 0
        self.links = 0
        self.text: list[str] = []
        self.tags = 1
        self.linked = 0

    def end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            tag, _, container, article, header = self.open[-1]
            if not header or any(t[0] in HEADING for t in self.open[-6:]):
                self.lines.append((text, max(0, len(text) - self.linked) / self.tags, container, article))
        self.text, self.tags, self.linked = [], 1, 0

    def close_to(self, tags: set[str], stop: frozenset[str]) -> None:
        """End the innermost open element of `tags`, unless one of `stop` lies inside of it."""
        if not any(self.count[t] for t in tags):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] in tags:
                self.pop_to(i)
                return
            if self.open[i][0] in stop:
                return

    def pop_to(self, i: int) -> None:
        for tag, *_ in self.open[i:]:
            self.count[tag] -= 1
            self.links -= tag == "a"
        del self.open[i:]

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.end_line()
            self.close_to({"p", *HEADING} if tag in HEADING else {"p"}, CONTAINER | {"li", "td", "th", "table"})
        if tag in ENDS:
            self.close_to(ENDS[tag], frozenset({"ul", "ol", "dl", "table", "select"}))
        self.tags += tag not in BLOCK and tag != "br"
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        _, silent, container, article, header = self.open[-1]
        words: set[str] = set()
        hidden = False
        for name, value in attrs:
            if name in ("class", "id", "role", "itemprop") and value:
                words.update(w.lower() for w in _WORDS.findall(value))
            hidden |= name == "hidden" or name == "aria-hidden" and value == "true"
            hidden |= name == "style" and "display:none" in (value or "").replace(" ", "").lower()
        if tag not in ("html", "body", "main"):
            silent |= tag in SILENT and not (article and tag in INSIDE) or hidden or bool(words & NOISE)
            if (tag == "header" or words & TOP) and not silent:
                header, silent = (True, False) if article else (header, True)
        if tag in CONTAINER and (not article or tag in REGION):
            self.containers += 1
            container = self.containers
        article |= tag in REGION or "articlebody" in words or "main" in words and tag != "html"
        self.open.append((tag, silent, container, article, header))
        self.count[tag] += 1
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.end_line()
        elif tag not in VOID:
            self.tags += 1
        if self.count[tag]:
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i][0] == tag:
                    self.pop_to(i)
                    break

    def handle_data(self, data):
        if not self.open[-1][1]:
            self.text.append(data)
            if self.links:
                self.linked += len(data)


def smoothed(values: list[float], sigma: float) -> list[float]:
    """Gaussian smoothing; the kernel is cut at three sigmas and normalised at the ends."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(reach + 1)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for j in range(max(0, i - reach), min(len(values), i + reach + 1)):
            k = kernel[abs(i - j)]
            total, weight = total + k * values[j], weight + k
        out.append(total / weight)
    return out


def threshold(values: list[float]) -> float:
    """The border between two clusters of ratios; 0 where there is one only."""
    cut = sum(values) / len(values)
    for _ in range(50):
        low, high = [v for v in values if v < cut], [v for v in values if v >= cut]
        if not low or not high:
            return 0.0
        a, b = sum(low) / len(low), sum(high) / len(high)
        if abs((a + b) / 2 - cut) < 1e-9:
            break
        cut = (a + b) / 2
    return 0.0 if a > 0.5 * b else cut


def main_text(html: str | None, sigma: float = 1.0) -> str:
    if not html:
        return ""
    parser = Lines()
    parser.feed(_MARKED.sub(" ", html))
    parser.close()
    parser.end_line()
    lines = parser.lines
    if any(article for *_, article in lines):
        lines = [x for x in lines if x[3]]
    if not lines:
        return ""
    values = smoothed([min(ratio, 1e6) for _, ratio, _, _ in lines], sigma)
    cut = threshold(values)
    content = {x[2] for x, v in zip(lines, values) if v >= cut}
    return "\n\n".join(x[0] for x in lines if x[2] in content)


def extract(pages: DataFrame, sigma: float = 1.0, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """`key`, `url`, `text` (empty if none), `n_chars` (its code points) per page.

    A null or empty page has an empty text; null keys and addresses stay null;
    repeated rows give equal rows; an empty table gives none. Text after an
    unclosed element is still read; a page without tags is one block. Other
    columns are not read, so their names cannot clash. No shuffle.
    """
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, html):
            texts = [main_text(h, sigma) for h in batch.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), batch.column(url), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                [key, url, "text", "n_chars"])

    return pages.select(key, url, html).mapInArrow(
        run, f"`{key}` {kinds[key]}, `{url}` {kinds[url]}, text string, n_chars bigint")
