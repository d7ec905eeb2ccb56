"""Main text of web pages by the maximum-scoring subsequence of their words and tags.

Words score positive and tags negative. The weights come from labelled pages: those that mark
their article (<article> or <main>) say which words, by the element they stand in, and which tags
are inside. Marks are labels only: on every page a linear scan finds the contiguous run of tokens
with the largest sum, and the blocks of that run are the text. Elements that say themselves that
they are no part of an article (menus, forms, scripts, comments) are left out before the scan; what
they hold counts as outside for the weights.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylode.llm.common import table

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\"<>]++)*+)>", re.S
)
ATTRIBUTE = re.compile(r"([A-Za-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
RAW = {k: re.compile(rf"</{k}\b[^>]*>?", re.I) for k in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements within text; of other names, all count as one.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Not part of an article, whatever their text.
OUTSIDE = frozenset(
    "script style noscript template nav header footer aside form head title iframe object svg math canvas audio video select button input textarea "
    "dialog menu fieldset noframes noembed applet map".split()
)
#: Words of a class or an id, and roles, that say the same.
OUTSIDE_NAMES = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising alert aside banner breadcrumb breadcrumbs comment commentlist comments consent cookie "
    "cookies disclaimer discussion disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pager "
    "pagination paywall popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor "
    "sponsored subscribe subscription toolbar widget widgets".split()
)
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open tag that ends the open elements named, up to the nearest of those after the bar.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
SCOPE = frozenset("html body article main section aside div td th table blockquote li figure button form nav header footer".split())
#: Elements that break text off less than others do, as long as no page has told.
MILD = INLINE | VOID | HEADING | frozenset("p li ul ol dl dt dd blockquote pre table tbody thead tr td th figure figcaption html body article main".split())
#: Pages of the sample from which weights are fitted, the weight of a tag never seen inside, and of
#: any tag, mild ones at first.
SAMPLE, TAG_COST, TAG_LEAST = 2000, 4.0, 0.05


class Page:
    """A page as events (feature, count, block; -1 for a tag, -2 in a marked article), blocks (whether
    in a marked article, text) and what was left out (features)."""

    def __init__(self, source: str):
        self.events: list[tuple[str, int, int]] = []
        self.blocks: list[tuple[bool, str]] = []
        self.left_out: Counter[str] = Counter()
        self.has_marks = False
        #: (name, in a marked article, outside): the open elements.
        self.open: list[tuple[str, bool, bool]] = []
        self.piece: list[str] = []
        self.piece_words: Counter[str] = Counter()
        self.links = 0
        self._read(source)
        self._flush()

    def _flush(self) -> None:
        text = " ".join("".join(self.piece).split())
        if text:
            for feature, n in self.piece_words.items():
                self.events.append((feature, n, len(self.blocks)))
            self.blocks.append((bool(self.open) and self.open[-1][1], text))
        self.piece.clear()
        self.piece_words.clear()

    def _text(self, raw: str) -> None:
        if not raw:
            return
        outside = bool(self.open) and self.open[-1][2]
        text = raw if outside else html.unescape(raw)
        if not outside:
            self.piece.append(text)
        if n := len(text.split()):
            (self.left_out if outside else self.piece_words)[("link " if self.links else "word ") + self._block()] += n

    def _block(self) -> str:
        return next((name for name, _, _ in reversed(self.open) if name in BLOCKS), "")

    def _pop_to(self, k: int) -> None:
        if any(name in BLOCKS for name, _, _ in self.open[k:]):
            self._flush()
        self.links -= sum(name == "a" for name, _, _ in self.open[k:])
        del self.open[k:]

    def _close_open(self, names: frozenset[str], within: frozenset[str]) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in names:
                return self._pop_to(k)
            if self.open[k][0] in within:
                return

    def _tag(self, name: str, outside: bool) -> None:
        feature = f"tag {name} {self._block()}" if name in INLINE else "tag " + (name if name in BLOCKS or name in VOID else "other")
        if outside:
            self.left_out[feature] += 1
        else:
            self.events.append((feature, 1, -2 if self.open and self.open[-1][1] else -1))

    def _start(self, name: str, attributes: str) -> None:
        if name == "body":
            self._close_open(frozenset({"head"}), frozenset())
        elif self.open and self.open[-1][0] == "head" and name not in OUTSIDE and name not in VOID:
            self._pop_to(len(self.open) - 1)
        if name in BLOCKS:
            self._close_open(frozenset({"p"}), SCOPE)
            if name in HEADING and self.open and self.open[-1][0] in HEADING:
                self._pop_to(len(self.open) - 1)
            if name in CLOSES:
                self._close_open(*CLOSES[name])
            self._flush()
        inside, outside = self.open[-1][1:] if self.open else (False, False)
        outside = outside or name in OUTSIDE or _says_outside(name, attributes)
        self._tag(name, outside)
        if name == "br":
            self._text(" ")
        if name in VOID:
            return
        self.links += name == "a"
        marks = name in ("article", "main") and not outside
        self.has_marks |= marks
        self.open.append((name, inside or marks, outside))

    def _end(self, name: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == name:
                if any(inner in BLOCKS for inner, _, _ in self.open[k:]):
                    self._flush()
                self._tag(name, self.open[-1][2])
                return self._pop_to(k)
            if name not in BLOCKS and self.open[k][0] in BLOCKS:
                return
        if name == "p":
            self._flush()

    def _read(self, source: str) -> None:
        at = begin = 0
        while m := TOKEN.search(source, at):
            self._text(source[begin : m.start()])
            at = begin = m.end()
            if not m[2]:
                if m[0].startswith("<![CDATA["):
                    self._text(m[0][9:].removesuffix("]]>"))
                continue
            name = m[2].lower()
            if m[1]:
                self._end(name)
            elif name in RAW:
                end = RAW[name].search(source, at)
                at = begin = end.end() if end else len(source)
            elif m[3].endswith("/") and name not in BLOCKS and name not in VOID:
                pass
            else:
                self._start(name, m[3])
        self._text(source[begin:])


def _says_outside(name: str, attributes: str) -> bool:
    if not attributes or name in ("html", "body", "main", "article"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = (m[1] or m[5]).lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        if key == "role" and value.lower() in OUTSIDE_ROLES:
            return True
        if key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
        if key in ("class", "id"):
            for word in value.split():
                parts = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", word).lower())
                if parts and parts[0] not in ("with", "has", "no", "without") and not OUTSIDE_NAMES.isdisjoint(parts):
                    return True
    return False


def _counts(source: str | None) -> Counter[tuple[str, int]]:
    """(feature, 1 inside a marked article or else 0): tokens of a page that marks one."""
    page, found = Page(source or ""), Counter()
    if not page.has_marks:
        return found
    for feature, n, block in page.events:
        found[feature, int(page.blocks[block][0] if block >= 0 else block == -2)] += n
    for feature, n in page.left_out.items():
        found[feature, 0] += n
    return found


def fit_weights(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE) -> dict[str, float]:
    """A weight for each feature from at most so many pages (those of the smallest hashes).

    A word weighs the smoothed share of its kind inside marked articles; a tag costs TAG_COST
    times the share of its kind outside. Kinds are bounded by the names that HTML has.
    """
    key = F.xxhash64(html_col)
    bound = pages.filter(F.col(html_col).isNotNull()).select(key.alias("k")).orderBy("k").limit(sample).agg(F.max("k")).first()[0]
    if bound is None:
        return {}
    chosen = pages.filter(key <= bound).select(F.col(html_col).alias("html")).limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[tuple[str, int]] = Counter()
        for b in batches:
            for t in b.column(0):
                total.update(_counts(t.as_py()))
        rows = [{"feature": k, "inside": i, "n": n} for (k, i), n in total.items()]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("feature", pa.string()), ("inside", pa.int32()), ("n", pa.int64())]))

    counts = chosen.mapInArrow(run, "feature string, inside int, n long").groupBy("feature").agg(F.sum(F.when(F.col("inside") == 1, F.col("n")).otherwise(0)).alias("i"), F.sum("n").alias("n"))
    weights = {}
    for r in counts.collect():
        share = (r["i"] + 1) / (r["n"] + 2)
        weights[r["feature"]] = -TAG_COST * (1 - share) - TAG_LEAST if r["feature"].startswith("tag ") else share
    return weights


def best_run(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous run with the largest sum; empty if none is positive."""
    best, sum_, start, found = 0.0, 0.0, 0, (0, 0)
    for k, s in enumerate(scores):
        if sum_ <= 0:
            sum_, start = 0.0, k
        sum_ += s
        if sum_ > best:
            best, found = sum_, (start, k + 1)
    return found


def _at_first(feature: str) -> float:
    """The weight of a kind that no labelled page has."""
    kind, name = feature.split(" ")[:2]
    if kind == "tag":
        return -TAG_LEAST if name in MILD else -TAG_COST / 2
    return 0.5 if kind == "word" else 0.1


def main_text(source: str | None, weights: dict[str, float]) -> str:
    """The blocks of the maximum-scoring run, one a line; empty for null, empty or textless pages."""
    page = Page(source or "")
    start, end = best_run([n * weights.get(feature, _at_first(feature)) for feature, n, _ in page.events])
    hit = [block for _, _, block in page.events[start:end] if block >= 0]
    return "\n".join(text for _, text in page.blocks[min(hit) : max(hit) + 1]) if hit else ""


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html_col: str = "html", weights: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text, n_chars (code points) for every row of pages, repeated rows included.

    Other columns are not read. Without weights they are fitted from the pages that mark articles.
    """
    weights = fit_weights(pages, html_col) if weights is None else weights
    fields = [pages.schema[page_id], pages.schema[url]]
    schema = T.StructType([T.StructField("page_id", fields[0].dataType), T.StructField("url", fields[1].dataType), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(t.as_py(), weights) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, schema)


def op1_html_text(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_main_text(table(spark, sf_dir, "pages"))
