"""Main text of web pages as a maximum-scoring subsequence.

A page is a sequence of tags and texts. Tags score below zero, the words of a text above or below zero according to the elements
they stand in, and one linear scan finds the contiguous region with the greatest sum. Inside the region, scripts and the like,
boxes (forms, menus, notices and the like, by name or by a whole class or id) and texts that score below zero are left out. No
list decides alone: a box around an article or around most words of the page stays, as does a header inside an article; and an
article's words are scored by what stands inside the article, not by the classes of its wrappers.

Weights come from labelled pages, a bounded sample (``sample`` groups of a hash, one page of up to ``longest`` bytes each): pages
whose markup names its article with one ``article`` or ``main`` element. For words, every element name and class around them has
the logarithm of the odds of article against other words; the names that make the label are no features, so the weights also
serve pages without them. For tags, a tag costs the more the rarer it is inside articles.

Blocks end at block elements; a line break is white space. Character references are decoded as browsers do, also those
without a semicolon where that is allowed. Broken markup is read as far as it goes: an open comment, script or tag runs to the
end of the page, an end tag closes what was left open inside, a new paragraph closes the last one.

Cases: NULL and empty pages have an empty text, as have pages without any word that scores above zero; without labelled pages
fixed weights serve (a word 1, a tag -1); pages of any length are read in linear time; repeated rows are treated alike; an empty
table gives no rows; a NULL page_id or url is carried; further columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitclock.llm.common import column, table, texts

BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style noscript template svg iframe textarea select option object title".split())
DROPPED = frozenset("nav header footer aside form button head menu dialog".split()) | RAW
#: Whole classes and ids of what is no article.
NOTICE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer header masthead "
    "menu modal nav navbar navigation newsletter notice popup promo promoted recommended related replies respond share sharing sidebar social sponsor sponsored subscribe widget".split()
)
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LABELS = frozenset(("article", "main"))
_FRAME = frozenset(("html", "body")) | LABELS
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>")
_MARK = re.compile(r"(?i)\b(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_START = re.compile(r"</?[a-zA-Z]")
_SIMPLE = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>")
_RAW_END = {name: re.compile(f"(?i)</{name}") for name in RAW}
#: How many open elements, from the inside out, a text takes its names and classes from.
LEVELS = 12


@dataclass(frozen=True)
class _Open:
    """An open element: its name, its names and classes (a label has none), whether it or one around it is raw or a label, the
    place of the open paragraph that a new block would close, and the number of the box it is, if it is one."""

    name: str
    names: frozenset[str]
    raw: bool
    inside: bool
    paragraph: int
    box: int = -1


@dataclass
class Text:
    """A piece of text: its words, the names and classes around it, its block, and whether it is never article text."""

    text: str
    words: int
    around: frozenset[str]
    block: int
    dropped: bool
    inside: bool


@dataclass
class Page:
    """The sequence of a page: a `Text`, or the name of a tag, with a dot before it inside a label, where tags cost nothing."""

    items: list[Text | str] = field(default_factory=list)
    labelled: int = 0


def _drop_boxes(page: Page, boxes: list[list[int]], labels: list[int]) -> None:
    """Drop the boxes: elements whose name, class or id says that they are no article.

    A box [first, end) around an article, or around most words of the page, is a frame of the page and stays; it is not judged by
    its name alone. The tags of a dropped box inside an article have no score, but for the first.
    """
    words, tags = [0], []
    for item in page.items:
        words.append(words[-1] + (0 if isinstance(item, str) or item.dropped else item.words))
    drop, quiet = [0] * (len(page.items) + 1), [0] * (len(page.items) + 1)
    for first, end, inside in boxes:
        k = bisect_left(labels, first)
        if (k < len(labels) and labels[k] < end) or 2 * (words[end] - words[first]) > words[-1]:
            continue
        drop[first] += 1
        drop[end] -= 1
        if inside and end > first:
            quiet[min(first + 1, end)] += 1
            quiet[end] -= 1
    dropped = silent = 0
    for k, item in enumerate(page.items):
        dropped, silent = dropped + drop[k], silent + quiet[k]
        if isinstance(item, str):
            tags.append("" if silent else item)
        else:
            item.dropped = item.dropped or dropped > 0
            tags.append(item)
    page.items = tags


def parse(source: str) -> Page:
    """The sequence of a page. Every character is looked at a bounded number of times."""
    page, at, block, n = Page(), 0, 0, len(source)
    stack: list[_Open] = []
    opened: Counter[str] = Counter()
    top = _Open("", frozenset(), False, False, -1)
    around, quoted = frozenset(), True
    boxes: list[list[int]] = []
    labels: list[int] = []

    def put(text: str) -> None:
        if text:
            page.items.append(Text(text, len(text.split()), around, block, top.raw, top.inside))

    def names_around() -> frozenset[str]:
        """The names of the last elements, up to the article: what an article stands in says nothing of its words."""
        found: set[str] = set()
        for x in reversed(stack[-LEVELS:]):
            if x.name in LABELS:
                break
            found |= x.names
        return frozenset(found)

    def cut(k: int) -> None:
        nonlocal top, around
        opened.subtract(x.name for x in stack[k:])
        for x in stack[k:]:
            if x.box >= 0:
                boxes[x.box][1] = len(page.items)
        del stack[k:]
        top = stack[-1] if stack else _Open("", frozenset(), False, False, -1)
        around = names_around()

    while at < n:
        lt = source.find("<", at)
        if lt != at:
            put(source[at:lt] if lt >= 0 else source[at:])
        if lt < 0:
            break
        if source.startswith(("<!", "<?"), lt):
            mark = "-->" if source.startswith("<!--", lt) else ">"
            end = source.find(mark, lt + 2)
            at = n if end < 0 else end + len(mark)
            continue
        m = _TAG.match(source, lt) if quoted else None
        if not m and _START.match(source, lt):
            # Quotes that do not pair: from here on a tag ends at the next sign, or with the page.
            quoted = False
            m = _SIMPLE.match(source, lt)
            if not m:
                break
        if not m:
            put("<")
            at = lt + 1
            continue
        at = m.end()
        close, name, rest = m.group(1), m.group(2).lower(), m.group(3)
        if not (top.raw and top.inside):
            page.items.append("." + name if top.inside else name)
        block += name in BLOCKS
        if close:
            if opened[name] > 0:
                cut(next(k for k in range(len(stack) - 1, -1, -1) if stack[k].name == name))
            continue
        if name in EMPTY or rest.endswith("/"):
            if name == "br":
                put(" ")
            continue
        if name in BLOCKS and top.paragraph >= 0:
            cut(top.paragraph)
        marks = frozenset(w for a in _MARK.finditer(rest) for w in (a.group(1) or a.group(2) or a.group(3) or "").lower().split()) if rest else frozenset()
        frame = name in _FRAME
        if name in LABELS:
            page.labelled += 1
            labels.append(len(page.items) - 1)
        names = frozenset() if frame else frozenset((name, *("." + w for w in marks)))
        box = -1
        if not frame and name not in RAW and not (name == "header" and top.inside) and (name in DROPPED or not marks.isdisjoint(NOTICE_WORDS)):
            box = len(boxes)
            boxes.append([max(len(page.items) - 1, 0), -1, top.inside])
        paragraph = len(stack) if name == "p" else -1 if name in BLOCKS else top.paragraph
        top = _Open(name, names, top.raw or name in RAW, top.inside or name in LABELS, paragraph, box)
        stack.append(top)
        opened[name] += 1
        around = names_around()
        if name in RAW:
            end = _RAW_END[name].search(source, at)
            at = end.start() if end else n
    cut(0)
    _drop_boxes(page, boxes, labels)
    return page


@dataclass(frozen=True)
class Weights:
    """Scores of words by the names and classes around them, and of tags by name."""

    around: dict[str, float]
    tags: dict[str, float]
    bias: float = 1.0
    tag: float = -1.0

    def word(self, names: frozenset[str]) -> float:
        return max(-3.0, min(3.0, self.bias + sum(self.around.get(x, 0.0) for x in names)))

    def score(self, item: Text | str) -> float:
        if isinstance(item, str):
            return 0.0 if not item or item[0] == "." else self.tags.get(item, self.tag)
        if item.dropped:
            return 0.0 if item.inside else -3.0 * item.words
        return self.word(item.around) * item.words


def learned(pages: list[str]) -> Weights:
    """Weights from pages that name their article once; the fixed ones if there are none."""
    good, other, tag_in, tag_all = Counter(), Counter(), Counter(), Counter()
    n_good = n_other = 0
    for source in pages:
        page = parse(source)
        if page.labelled != 1:
            continue
        inside = False
        for item in page.items:
            if isinstance(item, str):
                if item:
                    tag_all[item.lstrip(".")] += 1
                    tag_in[item.lstrip(".")] += inside
                continue
            inside = item.inside
            (good if inside else other).update({x: item.words for x in item.around})
            n_good, n_other = n_good + item.words * inside, n_other + item.words * (not inside)
    if not n_good:
        return Weights({}, {})
    prior = math.log((n_good + 1) / (n_other + 1))
    around = {x: max(-3.0, min(3.0, math.log((good[x] + 1) / (other[x] + 1)) - prior)) for x in {*good, *other}}
    tags = {x: -0.1 - 0.9 * (1 - tag_in[x] / tag_all[x]) for x in tag_all}
    return Weights(around, tags, bias=max(0.5, min(2.0, prior)))


def best_region(scores: list[float]) -> tuple[int, int]:
    """The places of the contiguous region with the greatest positive sum; (0, 0) if there is none. The first and shortest wins."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += s
        if total > best + 1e-9:
            best, found = total, (start, k + 1)
    return found


def main_text(source: str, weights: Weights) -> str:
    """The blocks of the best region, two line feeds apart."""
    items = parse(source).items
    lo, hi = best_region([weights.score(x) for x in items])
    parts: list[list[str]] = []
    last = None
    for item in items[lo:hi]:
        if isinstance(item, str) or item.dropped or (item.words and weights.word(item.around) <= 0):
            continue
        if item.block != last:
            parts.append([])
            last = item.block
        parts[-1].append(item.text)
    blocks = (" ".join(html.unescape("".join(p)).split()) for p in parts)
    return "\n\n".join(b for b in blocks if b)


def labelled_sample(pages: DataFrame, sample: int = 256, longest: int = 1 << 16) -> list[str]:
    rows = pages.where((F.octet_length("html") <= longest) & F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    h = F.xxhash64("html")
    found = rows.groupBy(F.pmod(h, F.lit(sample)).alias("g")).agg(F.min(F.struct(h.alias("h"), F.col("html"))).alias("x")).select("x.html").orderBy("html").collect()
    return [r["html"] for r in found]


def extracted(pages: DataFrame, weights: Weights) -> DataFrame:
    """(page_id, url, text) of every row."""
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.array([main_text(s, weights) for s in texts(batch, "html")], pa.string())
            yield pa.record_batch([column(batch, "page_id"), column(batch, "url"), out], names=["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")


def html_query(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = extracted(pages, learned(labelled_sample(pages.select("html"))))
    return found.withColumn("n_chars", F.length("text").cast("bigint"))
