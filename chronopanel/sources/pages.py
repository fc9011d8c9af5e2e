"""Landed HTML pages to table rows and links."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class _Cells(HTMLParser):
    """Text of table cells by (table, row), and all visible text of list items and headings."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.table, self.row, self.rows, self.cell, self.items, self.item = -1, -1, {}, None, [], None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.table, self.row = self.table + 1, -1
        elif tag == "tr":
            self.row += 1
        elif tag in ("td", "th"):
            self.cell = []
        elif tag in ("li", "p", "h1", "h2", "h3", "h4"):
            self.item = []

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.rows.setdefault((max(self.table, 0), self.row), []).append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag in ("li", "p", "h1", "h2", "h3", "h4") and self.item is not None:
            self.items.append(" ".join("".join(self.item).split()))
            self.item = None

    def handle_data(self, data):
        for buffer in (self.cell, self.item):
            if buffer is not None:
                buffer.append(data)


SCHEMA = "page_id bigint, kind string, table_no int, row_no int, cells array<string>"


def page_rows(pages: DataFrame) -> DataFrame:
    """(page_id, kind, table_no, row_no, cells): table rows, and each list item or paragraph as one cell."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page, html in zip(batch["page_id"], batch["html"], strict=True):
                p = _Cells()
                p.feed(html or "")
                out += [(page, "table", t, r, cells) for (t, r), cells in p.rows.items()]
                out += [(page, "text", 0, i, [text]) for i, text in enumerate(p.items) if text]
            yield pd.DataFrame(out, columns=["page_id", "kind", "table_no", "row_no", "cells"])

    return pages.select("page_id", "html").mapInPandas(run, SCHEMA)


class _Items(HTMLParser):
    """Headings, paragraphs, list items and month or date boxes in their order, each with the next link in it."""

    HELD = ("li", "p", "h1", "h2", "h3", "h4", "h5")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items, self.open = [], None

    def handle_starttag(self, tag, attrs):
        known = dict(attrs)
        kind = next((k for k in ("month", "date") if k in (known.get("class") or "").split()), None)
        if tag in self.HELD or (tag == "div" and kind):
            self.open = [tag, kind or tag, [], None]
        elif tag == "a" and self.open is not None:
            self.open[3] = self.open[3] or known.get("href")

    def handle_endtag(self, tag):
        if self.open is not None and tag == self.open[0]:
            text = " ".join("".join(self.open[2]).split())
            if text:
                self.items.append((self.open[1], text, self.open[3]))
            self.open = None

    def handle_data(self, data):
        if self.open is not None:
            self.open[2].append(data)


class _Grid(HTMLParser):
    """Cells of tables with an id, by row; a cell that spans rows stands in each of them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.table, self.rows, self.cells, self.cell, self.spans, self.later, self.rows_of_cell = None, [], None, None, {}, {}, 1

    def handle_starttag(self, tag, attrs):
        known = dict(attrs)
        if tag == "table":
            self.table, self.spans, self.later = known.get("id") or "", {}, {}
        elif tag == "tr" and self.table is not None:
            self.cells = []
            self._carry()
        elif tag in ("td", "th") and self.cells is not None:
            span = known.get("rowspan") or ""
            self.cell, self.rows_of_cell = [], int(span) if span.isdigit() else 1

    def _carry(self):
        while len(self.cells) in self.spans:
            at = len(self.cells)
            left, text = self.spans.pop(at)
            if left > 1:
                self.later[at] = (left - 1, text)
            self.cells.append(text)

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            text = " ".join("".join(self.cell).split())
            if self.rows_of_cell > 1:
                self.later[len(self.cells)] = (self.rows_of_cell - 1, text)
            self.cells.append(text)
            self.cell = None
            self._carry()
        elif tag == "tr" and self.cells is not None:
            self.rows.append((self.table, self.cells))
            self.cells, self.spans, self.later = None, self.later, {}
        elif tag == "table":
            self.table = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def _parsed(pages: DataFrame, reader, rows, schema: str) -> DataFrame:
    """One frame for each page, so a task holds one page whatever a batch brings."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for page, html in zip(batch["page_id"], batch["html"], strict=True):
                p = reader()
                p.feed(html or "")
                yield pd.DataFrame([(page, i, *r) for i, r in enumerate(rows(p))], columns=names)

    return pages.select("page_id", "html").mapInPandas(run, schema)


def page_items(pages: DataFrame) -> DataFrame:
    """(page_id, item, kind, text, href) in the order of the page."""
    return _parsed(pages, _Items, lambda p: p.items, "page_id bigint, item int, kind string, text string, href string")


def table_grid(pages: DataFrame) -> DataFrame:
    """(page_id, row_no, table_id, cells) with row spans filled in."""
    return _parsed(pages, _Grid, lambda p: p.rows, "page_id bigint, row_no int, table_id string, cells array<string>")


MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"


def meetings(items: DataFrame) -> DataFrame:
    """(page_id, start, end, url, scheduled) of two layouts, without copies.

    Boxes: a heading with a year, then a month box and a date box for each meeting. Headings: `January 29-30 Meeting -
    2019`. Year and month are carried from the last item that had one. A range over two months names both months.
    """
    own = W.partitionBy("page_id").orderBy("item").rowsBetween(W.unboundedPreceding, 0)
    heading = F.col("kind").isin("h1", "h2", "h3", "h4", "h5")
    text = F.col("text")
    year = F.nullif(F.regexp_extract(text, r"\b((?:19|20)\d\d)\b", 1), F.lit(""))
    x = items.withColumn("year", F.last(F.when(heading, year), True).over(own)).withColumn("month", F.last(F.when(F.col("kind") == "month", text), True).over(own))
    named = rf"^({MONTH}(?:/{MONTH})?)\s+(\d{{1,2}}(?:-\d{{1,2}})?)\s+((?i)Meeting|Conference Call)"
    line = heading & text.rlike(named)
    months = F.when(line, F.regexp_extract(text, named, 1)).when(F.col("kind") == "date", F.col("month"))
    days = F.when(line, F.regexp_extract(text, named, 2)).when(F.col("kind") == "date", F.regexp_extract(text, r"^(\d{1,2}(?:-\d{1,2})?)", 1))
    x = x.withColumn("months", F.split(months, "/")).withColumn("days", F.split(F.nullif(days, F.lit("")), "-")).where("year is not null and months is not null and days is not null")
    # the year of the second month is the next one when it comes before the first
    number = lambda name: F.month(F.try_to_date(F.concat(F.initcap(F.substring(name, 1, 3)), F.lit(" 2000")), "MMM yyyy"))
    a, b = number(F.element_at("months", 1)), F.when(F.size("days") > 1, number(F.element_at("months", -1))).otherwise(number(F.element_at("months", 1)))
    day = lambda y, m, d: F.try_to_date(F.concat_ws("-", y.cast("string"), m.cast("string"), d), "yyyy-M-d")
    start = day(F.col("year"), a, F.element_at("days", 1))
    end = day(F.col("year").cast("int") + (b < a).cast("int"), b, F.element_at("days", -1))
    scheduled = ~F.lower(text).rlike("unscheduled|conference call|notation vote")
    return x.select("page_id", start.alias("start"), end.alias("end"), F.col("href").alias("url"), scheduled.alias("scheduled")).where("start is not null and end >= start").groupBy(
        "page_id", "start", "end").agg(F.max("url").alias("url"), F.bool_or("scheduled").alias("scheduled"))


def constituents(grid: DataFrame) -> DataFrame:
    """(page_id, symbol, name, sector, industry, date_added, cik) of the table `constituents`; header rows are left out."""
    from ..functions.scalar import canonical_symbol, digits, tolerant_date

    x = padded(grid.where((F.col("table_id") == "constituents") & (F.size("cells") >= 4) & (F.lower(F.col("cells")[0]) != "symbol")), 7)
    symbol = F.nullif(canonical_symbol(F.col("cells")[0]), F.lit(""))
    some = lambda k: F.nullif(F.col("cells")[k], F.lit(""))
    return x.select("page_id", symbol.alias("symbol"), some(1).alias("name"), F.coalesce(some(2), F.lit("Unknown")).alias("sector"), F.coalesce(some(3), F.lit("Unknown")).alias("industry"),
                    tolerant_date(F.col("cells")[5]).alias("date_added"), digits(F.col("cells")[6]).alias("cik")).where("symbol is not null")


def padded(rows: DataFrame, width: int) -> DataFrame:
    """Short rows padded with empty cells."""
    fill = F.concat(F.col("cells"), F.array_repeat(F.lit(""), F.greatest(F.lit(width) - F.size("cells"), F.lit(0))))
    return rows.withColumn("cells", fill)


def change_rows(rows: DataFrame) -> DataFrame:
    """Rows of a changes table: a parseable date and at least one ticker."""
    from ..functions.scalar import tolerant_date

    x = padded(rows.where("kind = 'table'"), 4).select("page_id", "table_no", "row_no", tolerant_date(F.col("cells")[0]).alias("effective"),
                                                       F.nullif(F.col("cells")[1], F.lit("")).alias("added"), F.nullif(F.col("cells")[3], F.lit("")).alias("removed"))
    return x.where("effective is not null and (added is not null or removed is not null)")


def meeting_days(rows: DataFrame) -> DataFrame:
    """Distinct calendar mentions (month, day) in page text, with the page they came from."""
    text = F.array_join("cells", " ")
    m = F.regexp_extract_all(text, F.lit(r"((?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2})"), 1)
    return rows.select("page_id", F.explode(m).alias("mention")).dropDuplicates()
