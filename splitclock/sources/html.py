"""Result pages and start lists as tables: one page in, many rows out, with the standard library's HTML parser.

Pages are rows of a DataFrame (``page_id``, ``url``, ``html``), spread over the cluster by Spark; a page is parsed
whole inside one task and nothing is shared between pages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from splitclock.functions.classes import normalize_class
from splitclock.functions.text import length_from_name, stage_number_from_header
from splitclock.operators.merge import page_status


def _text_schema(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


RESULT_CELLS = ["position", "car_number", "driver_name", "nationality", "car_class", "team", "car_model", "time_str", "time_diff"]
RESULT_ROWS = _text_schema("page_id", "title", "header", "row", *RESULT_CELLS)
ENTRANT_CELLS = ["car_number", "driver_name", "co_driver_name", "nationality", "car_class", "vehicle", "team", "start_time", "championship"]
ENTRANT_ROWS = _text_schema("page_id", "title", "row", *ENTRANT_CELLS)

# First cells of header rows.
HEADER_WORDS = {"sıra", "stage", "no", "öe", "pos"}
# Start-list column by header text, and the order used when a list has no header.
START_COLUMNS = {
    "order": ["sıra", "sira", "#"],
    "car_number": ["no", "no."],
    "team": ["yarışmacı", "yarismaci", "takım", "takim", "team"],
    "driver_name": ["pilot", "sürücü", "surucu", "driver"],
    "nationality": ["uyruk", "ülke", "ulke", "nat"],
    "vehicle": ["otomobil", "araç", "arac", "car", "vehicle"],
    "car_class": ["s/k", "sınıf", "sinif", "class", "kat"],
    "championship": ["şampiyona", "sampiyona", "champ", "championship"],
    "start_time": ["s.zamanı", "s.zamani", "saat", "time", "start"],
}
CO_DRIVER_WORDS = ("co", "yardımcı", "navigator")
DEFAULT_ORDER = ["order", "car_number", "team", "driver_name", "co_driver_name", "nationality", "vehicle", "car_class", "championship", "start_time"]


class _Tables(HTMLParser):
    """Collects tables as rows of cells; a cell is its text pieces and the first link text. Also the page title and
    the last text before each table."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables, self.titles = [], {}
        self._open, self._rows, self._cells, self._cell = 0, None, None, None
        self._heading, self._before, self._link = None, "", False

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self._open += 1
            if self._open == 1:
                self._rows = []
                self.tables.append((self._before, self._rows))
        elif tag == "tr" and self._open:
            self._cells = []
            self._rows.append(self._cells)
            self._cell = None
        elif tag in ("td", "th") and self._cells is not None:
            self._cell = {"text": [], "link": []}
            self._cells.append(self._cell)
        elif tag == "a":
            self._link = True
        elif tag in ("h1", "h2", "h3", "title"):
            self._heading = tag

    def handle_endtag(self, tag):
        if tag == "table" and self._open:
            self._open -= 1
            if not self._open:
                self._rows = self._cells = self._cell = None
        elif tag == "tr":
            self._cells = self._cell = None
        elif tag in ("td", "th"):
            self._cell = None
        elif tag == "a":
            self._link = False
        elif tag == self._heading:
            self._heading = None

    def handle_data(self, data):
        text = data.strip()
        if not text:
            return
        if self._heading:
            self.titles.setdefault(self._heading, text)
        if self._cell is not None:
            self._cell["text"].append(text)
            if self._link:
                self._cell["link"].append(text)
        elif not self._open:
            self._before = text


# A tag as nearly every tag of a page is written: a plain name, quoted attributes without angle brackets, closed.
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9]*)(?:[ \t\n\r\f]+[a-zA-Z_:][a-zA-Z0-9_:.-]*=(?:"[^"<>]*"|'[^'<>]*'))*[ \t\n\r\f]*(/?)>""")
# Elements whose content is no markup.
_RAW = {"script", "style", "title", "textarea", "iframe", "noembed", "noframes", "noscript", "xmp", "plaintext", "svg", "math"}


def _read(html: str) -> _Tables:
    """The page's tables. A page of plain tags alone is split at them, which gives what the standard library's parser gives in a
    fraction of its time; any other page goes through that parser."""
    parser, html = _Tables(), html or ""
    pieces = _TAG.split(html)
    names = [n.lower() for n in pieces[2::4]]
    if len(names) != html.count("<") or not _RAW.isdisjoint(names) or "&" in pieces[-1] or "\0" in html:
        parser.feed(html)
        parser.close()
        return parser
    start, end, data = parser.handle_starttag, parser.handle_endtag, parser.handle_data
    if pieces[0]:
        data(unescape(pieces[0]))
    for closing, name, empty, text in zip(pieces[1::4], names, pieces[3::4], pieces[4::4]):
        if closing:
            end(name)
        else:
            start(name, ())
            if empty:
                end(name)
        if text:
            data(unescape(text) if "&" in text else text)
    return parser


def _joined(cell) -> str:
    return "".join(cell["text"])


def _lines(cell) -> list[str]:
    return [line.strip() for piece in cell["text"] for line in piece.split("\n") if line.strip()]


def _nth(lines: list[str], i: int) -> str:
    return lines[i] if len(lines) > i else ""


def _widest(tables, least: int):
    """The table with the most rows of six or more cells."""
    scored = [(sum(len(r) >= 6 for r in rows), -i) for i, (_, rows) in enumerate(tables)]
    if not scored or max(scored)[0] < least:
        return None
    return tables[-max(scored)[1]]


def _result_rows(page_id, html):
    """Rows of the main table: header rows and rows of cars restarting under other rules are left out."""
    page = _read(html)
    title = page.titles.get("h1") or page.titles.get("h2") or page.titles.get("title") or "Unknown"
    found = _widest(page.tables, 1)
    if found is None:
        return
    before, rows = found
    first = _joined(rows[0][0]) if rows and rows[0] else ""
    header = first if ("ÖE" in first or "SS" in first) else before
    number = 0
    for cells in rows:
        if len(cells) < 7 or _joined(cells[0]).lower() in HEADER_WORDS or "SR" in _joined(cells[1]):
            continue
        number += 1
        names, cars, times = _lines(cells[2]), _lines(cells[5]), _lines(cells[6])
        yield (
            page_id, title, header, str(number), _joined(cells[0]), _joined(cells[1]), _nth(names, 0), _joined(cells[3]), _joined(cells[4]), _nth(cars, 0), _nth(cars, 1), _nth(times, 0),
            _joined(cells[7]) if len(cells) > 7 else "",
        )


def _linked_rows(page_id, html):
    """The other site's layout: every table counts, a row needs a position that starts with a digit, and the driver
    is the link's text."""
    page = _read(html)
    title = page.titles.get("h1") or page.titles.get("title") or "Unknown"
    number = 0
    for header, rows in page.tables:
        for cells in rows:
            if len(cells) < 5 or not _joined(cells[0])[:1].isdigit():
                continue
            name = "".join(cells[1]["link"]) or _joined(cells[1])
            if not name:
                continue
            number += 1
            yield (page_id, title, header, str(number), _joined(cells[0]), "", name, "", _joined(cells[3]), "", _joined(cells[2]), _joined(cells[4]), "")


def _column_map(texts: list[str]) -> dict[str, int]:
    out = {}
    for i, text in enumerate(texts):
        named = next((c for c, words in START_COLUMNS.items() if text in words), None)
        if named is None and any(w in text for w in CO_DRIVER_WORDS):
            named = "co_driver_name"
        if named:
            out[named] = i
    return out


def _entrant_rows(page_id, html):
    page = _read(html)
    title = next((page.titles[t] for t in ("h1", "h2", "h3", "title") if t in page.titles), "Unknown")
    title = re.sub(r"\s*-?\s*(Start|Baslangic)\s*List.*$", "", title, flags=re.IGNORECASE).strip()
    found = _widest(page.tables, 3)
    if found is None:
        return
    rows = found[1]
    start, columns = 0, {}
    for i, cells in enumerate(rows):
        texts = [_joined(c).lower() for c in cells]
        if any(w in " ".join(texts) for w in ("no", "pilot", "sıra")):
            start, columns = i + 1, _column_map(texts)
            break
    columns = columns or {name: i for i, name in enumerate(DEFAULT_ORDER)}
    number = 0
    for cells in rows[start:]:
        if len(cells) < 6:
            continue
        cell = lambda name: cells[columns[name]] if columns.get(name, len(cells)) < len(cells) else {"text": []}  # noqa: B023, E731
        car = re.sub(r"\D", "", _joined(cell("car_number")))
        if not car:
            continue
        number += 1
        yield (
            page_id, title, str(number), str(int(car)), _nth(_lines(cell("driver_name")), 0), _nth(_lines(cell("co_driver_name")), 0), _joined(cell("nationality")), _joined(cell("car_class")),
            _joined(cell("vehicle")), _joined(cell("team")), _joined(cell("start_time")), _joined(cell("championship")),
        )


def _explode_pages(pages: DataFrame, parse, schema: T.StructType) -> DataFrame:
    names = schema.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for page_id, html in zip(batch["page_id"], batch["html"]):
                rows += parse(page_id, html)
                if len(rows) >= 2048:  # what is held is a page's rows, not those of a whole batch
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    return pages.select(F.col("page_id").cast("string").alias("page_id"), "html").mapInPandas(run, schema)


def html_results_rows(pages: DataFrame) -> DataFrame:
    """Result rows with stage number and length from the table header and the status of each row."""
    rows = _explode_pages(pages, _result_rows, RESULT_ROWS).withColumn("row", F.col("row").cast("int"))
    return rows.withColumns(
        {"stage_number": stage_number_from_header(F.col("header")), "stage_length_km": length_from_name(F.col("header")), "status": page_status(F.col("time_str"))}
    )


def html_results_rows_linked(pages: DataFrame) -> DataFrame:
    """Rows of the second layout: FINISHED exactly when the time has a colon; tables without a stage number drop out."""
    rows = _explode_pages(pages, _linked_rows, RESULT_ROWS).withColumn("row", F.col("row").cast("int"))
    out = rows.withColumns(
        {
            "stage_number": F.regexp_extract("header", r"(?i)SS\s*(\d+)", 1).try_cast("int"),
            "stage_length_km": F.coalesce(F.regexp_extract("header", r"(?i)(\d+\.?\d*)\s*km", 1).try_cast("double"), F.lit(0.0)),
            "status": F.when(F.col("time_str").contains(":"), "FINISHED").otherwise("DNF"),
        }
    )
    return out.where(F.col("stage_number").isNotNull())


def event_end_date(text):
    """End of a ``d. m. – d. m. yyyy`` range as a date column."""
    pattern = r"(\d+)\.\s*(\d+)\.\s*[–-]\s*(\d+)\.\s*(\d+)\.\s*(\d{4})"
    part = lambda i: F.regexp_extract(text, pattern, i).try_cast("int")
    return F.when(text.rlike(pattern), F.make_date(part(5), part(4), part(3)))


def html_startlist_rows(pages: DataFrame) -> DataFrame:
    """Entrants with their canonical class."""
    rows = _explode_pages(pages, _entrant_rows, ENTRANT_ROWS)
    return rows.withColumns({"row": F.col("row").cast("int"), "car_number": F.col("car_number").cast("int"), "normalized_class": normalize_class(F.col("car_class"))})
