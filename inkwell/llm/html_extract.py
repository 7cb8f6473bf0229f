"""HTML extraction by text-to-tag ratios.

Events of the standard library's streaming parser are folded into lines, which
break at block-level tags and at line feeds of the source. A line's ratio is
its characters of text over its tags (1 at least). Ratios are smoothed by a
Gaussian kernel over neighbouring lines; lines whose smoothed ratio reaches
``spread`` standard deviations of the page's are content, and so are clustered
into regions of neighbouring lines. A region begins and ends at a line whose own
ratio reaches the threshold (smoothing lends weight to menus and banners beside
the text); short lines between those stay. One pass, no shuffle, whole pages.

Defined cases: null or empty html, and pages without text, give an empty text;
unclosed and unknown tags are tolerated as the parser does; script, style,
template, noscript, iframe, svg and head but its title are never text, up to
their end tags (template, noscript, iframe or svg without an end tag hide nothing); equal ratios are
treated alike, so a page of one line, or of equal lines, is content; repeated
rows and rows without page_id give a row each. Other columns are ignored.
"""

from __future__ import annotations

from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Production parameters.
SIGMA, SPREAD = 1.0, 0.5

_BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead tr ul".split())
_MUTE = frozenset("script style template noscript iframe svg".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Lines(HTMLParser):
    def __init__(self, html: str = ""):
        super().__init__(convert_charrefs=True)
        low = html.lower()
        #: End tags that are still to come, and open elements that hide text, by tag.
        self.ends = {t: low.count("</" + t) for t in _MUTE}
        self.hides = dict.fromkeys(_MUTE, 0)
        self.lines: list[str] = []
        self.tags: list[int] = []
        self.parts: list[str] = []
        self.count = 0
        self.head = self.in_title = False
        self.title: list[str] = []

    def flush(self):
        if self.parts or self.count:
            self.lines.append(" ".join("".join(self.parts).split()))
            self.tags.append(self.count)
            self.parts, self.count = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in _MUTE:
            self.hides[tag] += self.ends[tag] > self.hides[tag]
        elif tag in _BLOCK:
            self.flush()
            self.head = False
        elif tag == "head":
            self.head = True
        elif tag == "title":
            self.in_title = True
        self.count += 1

    def handle_startendtag(self, tag, attrs):
        if tag in _BLOCK:
            self.flush()
        self.count += 1

    def handle_endtag(self, tag):
        self.count += 1
        if tag in _MUTE:
            self.ends[tag] -= 1
            self.hides[tag] = max(0, self.hides[tag] - 1)
        elif tag in _BLOCK and tag not in _VOID:
            self.flush()
        elif tag == "head":
            self.head = False
        elif tag == "title":
            self.in_title = False

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.head and not any(self.hides.values()):
            if "\n" in data:
                first, *rest = data.split("\n")
                self.parts.append(first)
                for x in rest:
                    self.flush()
                    self.parts.append(x)
            else:
                self.parts.append(data)


def smooth(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian average over neighbours; at the ends over those that exist."""
    r = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    if not len(x):
        return x
    mid = slice(r, r + len(x))
    return np.convolve(x, kernel)[mid] / np.convolve(np.ones(len(x)), kernel)[mid]


def extract(html: str, sigma: float = SIGMA, spread: float = SPREAD) -> tuple[str, str, int, int, int]:
    """(title, content, lines, content lines, regions)."""
    p = _Lines(html)
    p.feed(html)
    p.close()
    p.flush()
    title = " ".join("".join(p.title).split())
    size = np.array([len(x) for x in p.lines], dtype=float)
    if not size.any():
        return title, "", len(size), 0, 0
    ratio = size / np.maximum(np.array(p.tags, dtype=float), 1)
    soft = smooth(ratio, sigma)
    limit = spread * soft.std()
    region = np.concatenate([[False], soft >= limit, [False]])
    edge = np.flatnonzero(region[1:] != region[:-1])
    take, regions = np.zeros(len(size), dtype=bool), 0
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        own = a + np.flatnonzero(ratio[a:b] >= limit)
        if len(own):
            take[own[0] : own[-1] + 1] = True
            regions += 1
    take &= size > 0
    return title, "\n".join(x for x, t in zip(p.lines, take.tolist(), strict=True) if t), len(size), int(take.sum()), regions


_SCHEMA = "page_id long, url string, title string, text string, n_lines long, n_content_lines long, n_regions long"


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row for each page: its title, its content and the counts behind it."""

    def run(batches):
        for x in batches:
            rows = [extract(h) if h else ("", "", 0, 0, 0) for h in (v.as_py() for v in x.column(2))]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [c.split()[0] for c in _SCHEMA.split(", ")])

    return pages.select(F.col("page_id").try_cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, _SCHEMA)
