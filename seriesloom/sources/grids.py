"""Tables inside stored web pages as grids: cells that span rows and columns, nested tables, heading rows, broken markup.

Pages are read independently of each other in Arrow batches, with one pass of the standard markup reader per page, so memory is bounded by a page.
The JVM regular expressions of :mod:`seriesloom.sources.pages` stay the faster way for flat markup without spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The largest spans that HTML allows.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
SECTIONS = ("thead", "tbody", "tfoot")
UNSEEN = ("script", "style", "template")
PAGES_AT_ONCE = 64


class _Table:
    """One open table: finished rows, the cells that reach into later rows, and the row and cell being read."""

    def __init__(self, number: int, parent: int | None, depth: int):
        self.number, self.parent, self.depth = number, parent, depth
        self.rows: list[tuple[list[str], bool]] = []
        self.reaching: dict[int, tuple[int, str]] = {}
        self.row: list[tuple[str, int, int, bool]] | None = None
        self.cell: tuple[list[str], int, int, bool] | None = None

    def end_cell(self) -> None:
        if self.cell is not None:
            parts, columns, rows, heading = self.cell
            self.row.append((" ".join("".join(parts).split()), columns, rows, heading))
            self.cell = None

    def end_row(self) -> None:
        self.end_cell()
        if self.row is None:
            return
        slots: dict[int, str] = {c: text for c, (_, text) in self.reaching.items()}
        reaching = {c: (left - 1, text) for c, (left, text) in self.reaching.items() if left > 1}
        at = 0
        for text, columns, rows, _ in self.row:
            while at in slots:
                at += 1
            for c in range(at, at + columns):
                slots[c] = text
                if rows > 1:
                    reaching[c] = (rows - 1, text)
            at += columns
        self.reaching = reaching
        width = max(slots, default=-1) + 1
        heading = bool(self.row) and all(h for *_, h in self.row)
        self.rows.append(([slots.get(c, "") for c in range(width)], heading))
        self.row = None

    def end_section(self) -> None:
        self.end_row()
        self.reaching = {}

    def numbered(self) -> list[tuple[int, list[str]]]:
        """Rows with their number: 0 is the last of the leading heading rows (else the first row), those above it are negative."""
        leading = next((i for i, (_, heading) in enumerate(self.rows) if not heading), len(self.rows))
        return [(i - max(leading - 1, 0), cells) for i, (cells, _) in enumerate(self.rows)]


def _span(attributes: dict[str, str | None], name: str, most: int) -> int:
    text = (attributes.get(name) or "").strip()
    number = int(text) if text.isascii() and text.isdigit() and len(text) < 10 else 1
    return min(number, most) if number else (most if name == "rowspan" else 1)  # 0 rows: to the end of the section


class _Reader(HTMLParser):
    def __init__(self, container: str, row: str, cells: dict[str, bool]):
        super().__init__(convert_charrefs=True)
        self.container, self.row_tag, self.cells = container, row, cells
        self.open: list[_Table] = []
        self.done: list[_Table] = []
        self.unseen = 0

    def handle_starttag(self, tag, attrs):
        if tag in UNSEEN:
            self.unseen += 1
        elif tag == self.container:
            parent = self.open[-1].number if self.open else None
            self.open.append(_Table(len(self.done), parent, len(self.open)))
            self.done.append(self.open[-1])
        elif self.open:
            table = self.open[-1]
            if tag in SECTIONS:
                table.end_section()
            elif tag == self.row_tag:
                table.end_row()
                table.row = []
            elif tag in self.cells:
                table.end_cell()
                if table.row is None:
                    table.row = []
                spans = dict(attrs)
                table.cell = ([], _span(spans, "colspan", MOST_COLUMNS), _span(spans, "rowspan", MOST_ROWS), self.cells[tag])
            elif table.cell is not None and tag in ("br", "p", "div", "li"):
                table.cell[0].append(" ")

    def handle_startendtag(self, tag, attrs):
        if tag not in UNSEEN:
            super().handle_startendtag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in UNSEEN:
            self.unseen = max(self.unseen - 1, 0)
        elif self.open:
            table = self.open[-1]
            if tag == self.container:
                table.end_section()
                self.open.pop()
            elif tag in SECTIONS:
                table.end_section()
            elif tag == self.row_tag:
                table.end_row()
            elif tag in self.cells:
                table.end_cell()

    def handle_data(self, data):
        if self.open and not self.unseen and self.open[-1].cell is not None:
            self.open[-1].cell[0].append(data)


def grids_of(html: str | None, container: str = "table", row: str = "tr", cells: dict[str, bool] | None = None) -> list[_Table]:
    """All tables of a page in the order in which they begin; markup that is never closed ends with the page."""
    reader = _Reader(container, row, {"td": False, "th": True} if cells is None else cells)
    reader.feed(html or "")
    reader.close()
    for table in reversed(reader.open):
        table.end_section()
    return reader.done


GRID = "table_id int, parent_id int, depth int, row_no int, cells array<string>"


def extract_grids(
    pages: DataFrame, page_id: str, html: str, container: str = "table", row: str = "tr", cells: dict[str, bool] | None = None
) -> DataFrame:
    """One row per table row of each page: ``page_id, table_id, parent_id, depth, row_no, cells``.

    Cells that span rows or columns stand in every place they cover. A nested table is a table of its own, with the number
    of the one around it in ``parent_id`` and its depth from 0; its text is no part of the outer cell. ``row_no`` 0 holds the
    names: the last of the leading rows made of heading cells only, or the first row; rows above have negative numbers.
    ``cells`` maps each cell tag to whether it is a heading. NULL and empty pages have no tables; tables without rows no rows;
    blanks in a cell are collapsed; other columns of ``pages`` are not looked at.
    """
    schema = T.StructType([T.StructField(page_id, pages.schema[page_id].dataType), *T._parse_datatype_string(GRID).fields])
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PAGES_AT_ONCE):
                part = batch.slice(start, PAGES_AT_ONCE)
                at, rows = [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    for table in grids_of(text, container, row, cells):
                        for number, values in table.numbered():
                            at.append(i)
                            rows.append((table.number, table.parent, table.depth, number, values))
                columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
                ids = part.column(0).take(pa.array(at, pa.int64()))
                yield pa.record_batch([ids, *[pa.array(v, k) for v, k in zip(columns, kinds, strict=True)]], names=schema.names)

    return pages.select(F.col(page_id), F.col(html).cast("string").alias("_html")).mapInArrow(read, schema)
