"""Main text of web pages, from standard-library parser events.

The parser streams a page's events into blocks (a block element begins and ends one). Elements that never hold the
article (navigation, page headers and footers, asides, forms, scripts, styles, and those whose class, id or role
names a menu, advert, notice, comment and so on) are left out as they stream by; a name that only hints at such a part
makes its blocks doubtful. Of the rest, each block is a line with a text-to-tag ratio: its characters outside links over
its tags. The ratios are smoothed with a Gaussian, and runs of lines over a threshold (a share of the ratios' deviation)
are clusters; those with little text beside the largest do not count. The clusters select the content region: the
smallest element around all of them. The article and main tags are boundaries of it only: a region inside one grows to
the whole of it, and one around several shrinks to those that hold most of the clustered text.

All blocks of the region come out in page order, so short ones between long ones stay. Ratios decide about the others:
doubtful blocks outside all clusters go, and in a region without article or main so do lines of links outside them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import _common as c

#: Fixed values of HTML: elements without an end tag, block elements, elements whose text is never shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
SILENT = frozenset("script style noscript template head title textarea select option button iframe object svg math canvas audio video datalist".split())
CHROME = frozenset("nav footer aside form menu dialog search".split())
#: A new block element ends an open p; these end their own kind.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = frozenset("ul ol dl table article section main body div aside nav footer header form".split())
INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: Names (whole words of class and id, or their first or last part) of what is left out, and those that are so only as a whole
#: word or beside a part of ``PARTS``; as any other part they make a block doubtful.
NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promoted promotion banner banners cookie cookies consent gdpr popup modal newsletter subscribe subscription signup login nav navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar widget widgets comment comments commentlist disqus footer masthead topbar toolbar pagination pager notice notices".split())
VAGUE = frozenset("related recommend recommended recommendations share sharing social side aside replies reply responses response respond foot header tags skip copyright disclaimer alert alerts".split())
PARTS = frozenset("articles posts stories items links list box bar block section area panel container wrap wrapper buttons button icons widget content text message region".split())
REPLY = frozenset("comment comments reply replies response responses widget promo advert adverts advertisement sponsor sponsored ad ads".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: A tag that the end of the page cuts off.
CUT_TAG = re.compile(r"<[A-Za-z/!][^<>]*\Z")
#: A number of a character that is too long for int() or for any character.
LONG_NUMBER = re.compile(r"&#(?=[0-9]{8})0*([0-9]+)")
KEPT_REGIONS = frozenset(["article", "main", "body", "html"])


def left_out(value: str) -> float:
    """Of a class or id: 1 if it names what is left out, 0.5 if a part of it hints at that, else 0."""
    doubt = 0.0
    for word in value.lower().split():
        parts = [x for x in re.split(r"[-_]+", word) if x]
        if not parts:
            continue
        if word in VAGUE or parts[0] in NAMES or parts[-1] in NAMES or len(parts) > 1 and set(parts) <= VAGUE | PARTS and not VAGUE.isdisjoint(parts):
            return 1.0
        if not (VAGUE | NAMES).isdisjoint(parts):
            doubt = 0.5
    return doubt


class _Blocks(HTMLParser):
    """Events to blocks: (text, tags, characters in links, number of the innermost open block element, whether doubtful)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, float]] = []  # name, number, how far left out
        self.names: list[str] = []  # name by number
        self.parents: list[int] = []
        self.blocks: list[tuple[str, int, int, int, bool]] = []
        self.parts: list[str] = []
        self.tags = self.linked = self.hidden = self.doubt = self.links = self.article = 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append((text, self.tags, self.linked, next((n for name, n, _ in reversed(self.open) if name in BLOCKS), -1), self.doubt > 0))
            self.parts = []
        self.tags = self.linked = 0

    def _chrome(self, tag: str, attrs: list[tuple[str, str | None]]) -> float:
        """1 if the element is left out, 0.5 if it is doubtful, else 0."""
        if tag in SILENT or tag in CHROME or tag == "header" and not self.article:
            return 1.0
        if not attrs or tag in KEPT_REGIONS and tag != "article":
            return 0.0
        if tag == "article":  # readers' comments are often articles of their own
            words = {w for name, value in attrs if name in ("class", "id") and value for w in value.lower().split()}
            return float(any(w in REPLY or re.split(r"[-_]+", w)[0] in REPLY for w in words))
        found = 0.0
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and "display:none" in value.replace(" ", ""):
                return 1.0
            if name in ("class", "id") and value:
                found = max(found, left_out(value))
            elif name == "role" and value in ROLES:
                found = 1.0
        return 0.0 if found and self.article and tag in ("header", "h1", "h2", "h3", "p") else found

    def _pop(self) -> None:
        name, _, out = self.open[-1]
        if name in BLOCKS:
            self.flush()
        self.open.pop()
        self.hidden -= out == 1
        self.doubt -= out == 0.5
        self.links -= name == "a"
        self.article -= name == "article" or name == "main"

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            elif tag == "hr":
                self.flush()
            return
        if tag in BLOCKS:
            self.flush()
            # inline elements left open end with their paragraph
            depth = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] not in INLINE), -1)
            if depth >= 0 and self.open[depth][0] == "p":
                while len(self.open) > depth:
                    self._pop()
            if ends := CLOSES.get(tag):
                for i in range(len(self.open) - 1, -1, -1):
                    if self.open[i][0] in ends:
                        while len(self.open) > i:
                            self._pop()
                        break
                    if self.open[i][0] in SCOPES:
                        break
            elif tag == "body" and self.open and self.open[-1][0] == "head":
                self._pop()
        out = self._chrome(tag, attrs)
        self.parents.append(self.open[-1][1] if self.open else -1)
        self.open.append((tag, len(self.names), out))
        self.names.append(tag)
        self.hidden += out == 1
        self.doubt += out == 0.5
        self.links += tag == "a"
        self.article += tag == "article" or tag == "main"

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                while len(self.open) > i:
                    self._pop()
                return
            if tag in INLINE and self.open[i][0] in BLOCKS:
                return  # the element was ended with its block

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """As browsers read them: whatever follows ``<![`` is a comment up to the next ``>``."""
        return self.parse_bogus_comment(i, report)

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def smoothed(values: list[float], sigma: float = 1.0) -> list[float]:
    """Gaussian smoothing over neighbouring lines, with the weights that fall outside left out."""
    reach = math.ceil(2 * sigma)
    weights = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        some = [(values[i + k - reach], w) for k, w in enumerate(weights) if 0 <= i + k - reach < len(values)]
        out.append(sum(v * w for v, w in some) / sum(w for _, w in some))
    return out


def clusters(ratios: list[float], sizes: list[int], *, share: float, least: float) -> list[list[int]]:
    """Runs of lines whose ratios reach ``share`` of their standard deviation, each with ``least`` of the largest's text.

    Lines without text of their own, which smoothing alone lifts, do not begin or end a run.
    """
    mean = sum(ratios) / len(ratios)
    limit = share * math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios))
    runs: list[list[int]] = []
    for i, ratio in enumerate(ratios):
        if ratio >= limit:
            if runs and runs[-1][-1] == i - 1:
                runs[-1].append(i)
            else:
                runs.append([i])
    held = [[i for i in run if sizes[i]] for run in runs]
    runs = [run[run.index(some[0]) : run.index(some[-1]) + 1] for run, some in zip(runs, held, strict=True) if some]
    weights = [sum(sizes[i] for i in run) for run in runs]
    return [run for run, w in zip(runs, weights, strict=True) if w >= least * max(weights)]


def main_text(html: str | None, *, sigma: float = 1.0, share: float = 0.5, least: float = 0.05) -> str:
    """The main text of a page, its blocks joined by line feeds; empty for null, empty and textless pages.

    ``share`` of the ratios' standard deviation is the threshold over which a line is content; clusters with under
    ``least`` of the text of the largest do not select the region.
    """
    if not html:
        return ""
    parser = _Blocks()
    parser.feed(LONG_NUMBER.sub(lambda m: f"&#{m[1] if len(m[1]) < 8 else 0x110000}", CUT_TAG.sub("", html)))
    parser.close()
    while parser.open:
        parser._pop()
    parser.flush()
    blocks = parser.blocks
    if not blocks:
        return ""

    def path(number: int) -> list[int]:
        out = []
        while number >= 0:
            out.append(number)
            number = parser.parents[number]
        return out

    sizes = [max(0, len(text) - linked) for text, _, linked, _, _ in blocks]
    ratios = smoothed([size / max(1, block[1]) for size, block in zip(sizes, blocks, strict=True)], sigma)
    content = {i for run in clusters(ratios, sizes, share=share, least=least) for i in run}
    weight: dict[int, int] = {}
    shared: list[int] | None = None  # from the root down, the elements that hold all lines of content
    for i in sorted(content):
        above = path(blocks[i][3])[::-1]
        for n in above:
            weight[n] = weight.get(n, 0) + sizes[i]
        shared = above if shared is None else [n for n, m in zip(shared, above) if n == m]
    total = sum(sizes[i] for i in content)
    bounded = True
    for kind in ("article", "main"):
        named = {n for n, name in enumerate(parser.names) if name == kind and n in weight}
        # articles side by side are one region; one inside another is part of it
        if named and 2 * sum(weight[n] for n in named if named.isdisjoint(path(n)[1:])) >= total:
            chosen = named
            break
    else:
        chosen, bounded = set(shared[-1:]) if shared else set(), False
    out = []
    for i, (text, _, linked, number, doubtful) in enumerate(blocks):
        if chosen and chosen.isdisjoint(path(number)):
            continue
        if i in content or not doubtful and (bounded or 2 * linked <= len(text)):
            out.append(text)
    return "\n".join(out)


def extract(pages: DataFrame, *, html_col: str = "html", out: tuple[str, str] = ("text", "n_chars")) -> DataFrame:
    """``pages`` without the markup column, with the main text and its length in code points.

    Null and empty markup gives an empty text and 0. Every row is kept, repeated ones too; columns that are named as
    the new ones are replaced.
    """
    taken = {x.lower() for x in out}
    pages = pages.select(*[x for x in pages.columns if x.lower() not in taken or x == html_col])
    schema = c.added(pages, html_col, **{out[0]: "string", out[1]: "bigint"})
    at = pages.columns.index(html_col)
    places, names = [i for i in range(len(pages.columns)) if i != at], schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in places), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names)

    return pages.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: the main text of every page."""
    return extract(c.table(spark, sf_dir, "pages").select("page_id", "url", "html"))
