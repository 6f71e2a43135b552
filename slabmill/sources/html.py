"""Table rows from web pages of any kind: an operator on Arrow batches and a table function around a streaming HTML tokenizer with a stack of open elements."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

# Fixed values of HTML: elements without an end tag, elements whose text is not shown, and elements that an implied end tag doesn't reach across
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset(["script", "style"])
BORDERS = frozenset("table ul ol dl select".split())

ROW = "table_no int, table_id string, row_no int, row_class string, cells array<string>, stats map<string, string>"
#: Characters of a page that the tokenizer is given at once.
CHUNK = 1 << 16
#: Table rows in one batch.
ROWS_AT_ONCE = 5000
_ROW_TYPES = {
    "table_no": pa.int32(), "table_id": pa.string(), "row_no": pa.int32(), "row_class": pa.string(), "cells": pa.list_(pa.string()),
    "stats": pa.map_(pa.string(), pa.string()),
}


class _Element:
    """An open element; ``kind`` is table, row or cell, or empty for all others."""

    __slots__ = ("found", "kind", "parts", "table", "tag")

    def __init__(self, tag: str, kind: str = "", table: _Element | None = None, found: dict | None = None):
        self.tag, self.kind, self.table, self.found, self.parts = tag, kind, table, found, []


class Rows:
    """Builds rows from tags and texts in the order of the page; a row belongs to the innermost table around it."""

    def __init__(self, table: str, row: str, cell: str):
        self._kinds = {tag: kind for kind, tags in (("cell", cell), ("row", row), ("table", table)) for tag in tags.lower().split("|")}
        self._open: list[_Element] = []
        self._tables = 0
        self._hidden = 0
        self.rows: list[dict] = []

    def start(self, tag: str, attributes: dict[str, str | None]) -> None:
        kind = self._kinds.get(tag, "")
        self._space()
        if kind:
            self._imply_ends(kind, tag)
        if tag in VOID:
            return
        element = _Element(tag, kind, self._inner("table"))
        if kind == "table":
            element.found = {"no": self._tables, "id": attributes.get("id") or None, "rows": 0}
            self._tables += 1
        elif kind == "row":
            self._begin_row(element, attributes)
        elif kind == "cell" and element.table is not None:
            if self._inner("row") is None:  # a cell straight in a table begins a row of its own
                row = _Element("", "row", element.table)
                self._begin_row(row, {})
                self._open.append(row)
            element.found = {"row": self._inner("row").found, "stat": attributes.get("data-stat") or None}
        self._hidden += tag in HIDDEN
        self._open.append(element)

    def _begin_row(self, element: _Element, attributes: dict[str, str | None]) -> None:
        if element.table is None:
            return
        table = element.table.found
        element.found = {"table": table, "no": table["rows"], "class": attributes.get("class") or None, "cells": [], "stats": {}}
        table["rows"] += 1
        self.rows.append(element.found)

    def end(self, tag: str) -> None:
        self._space()
        for i in range(len(self._open) - 1, -1, -1):
            if self._open[i].tag == tag:
                while len(self._open) > i:
                    self._close()
                return
            if self._open[i].kind == "table" and self._kinds.get(tag) != "table":
                return  # an end tag doesn't reach out of a table

    def text(self, data: str) -> None:
        if not self._hidden:
            for element in self._open:
                if element.kind == "cell":
                    element.parts.append(data)

    def finish(self) -> None:
        while self._open:
            self._close()

    def _space(self) -> None:
        self.text(" ")

    def _inner(self, kind: str) -> _Element | None:
        """The innermost open element of a kind, of a row or cell only within the innermost table."""
        for element in reversed(self._open):
            if element.kind == kind:
                return element
            if element.kind == "table":
                return None
        return None

    def _imply_ends(self, kind: str, tag: str) -> None:
        """A row ends an open row and cell, a cell an open cell, unless a list or table was begun within."""
        ended = {"row": ("row", "cell"), "cell": ("cell",)}.get(kind, ())
        cut = None
        for i in range(len(self._open) - 1, -1, -1):
            element = self._open[i]
            if element.kind in ended:
                cut = i
            elif element.kind == "table" or element.tag in BORDERS:
                break
        if cut is not None:
            while len(self._open) > cut:
                self._close()

    def _close(self) -> None:
        element = self._open.pop()
        self._hidden -= element.tag in HIDDEN
        if element.kind == "cell" and element.found:
            text = " ".join("".join(element.parts).split())
            row = element.found["row"]
            row["cells"].append(text)
            if element.found["stat"]:
                row["stats"].setdefault(element.found["stat"], text)


class _Tokens(HTMLParser):
    """Passes tags and texts on; markup in comments is read like any other."""

    def __init__(self, rows: Rows):
        super().__init__(convert_charrefs=True)
        self._rows = rows

    def handle_starttag(self, tag, attrs):
        named: dict[str, str | None] = {}
        for name, value in attrs:
            named.setdefault(name, value)
        self._rows.start(tag, named)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash at a tag's end means nothing in HTML

    def handle_endtag(self, tag):
        self._rows.end(tag)

    def handle_data(self, data):
        self._rows.text(data)

    def handle_comment(self, data):
        self._rows.text(" ")
        inside = _Tokens(self._rows)
        inside.feed(data)
        inside.close()


def page_rows(html: str | None, table: str = "table", row: str = "tr", cell: str = "td|th") -> Iterator[tuple]:
    """(table_no, table_id, row_no, row_class, cells, stats) of each row of a page, in the order in which rows begin.

    Tables nest and are numbered in the order of their start tags; a cell's text holds that of tables inside it. All named and numeric entities, unquoted
    attributes and left-out end tags of rows and cells are understood; what is still open at the end of the page is closed there.
    ``stats`` maps each cell's data-stat attribute to its text, the first of equal ones. NULL and empty pages have no rows.
    """
    rows = Rows(table, row, cell)
    tokens = _Tokens(rows)
    for at in range(0, len(html or ""), CHUNK):
        tokens.feed(html[at : at + CHUNK])
    tokens.close()
    rows.finish()
    for r in rows.rows:
        yield r["table"]["no"], r["table"]["id"], r["no"], r["class"], r["cells"], r["stats"]


@F.udtf(returnType=ROW, useArrow=True)
class HtmlRows:
    """Table function ``html_rows(html, table, row, cell)``; see ``page_rows``."""

    def eval(self, html: str, table: str, row: str, cell: str):
        yield from page_rows(html, table, row, cell)


def explode_html_rows(pages: DataFrame, key: str = "page_id", html: str = "html", table: str = "table", row: str = "tr", cell: str = "td|th") -> DataFrame:
    """(page, table_no, table_id, row_no, row_class, cells, stats): one output row per table row, for pages of all kinds.

    ``table``, ``row`` and ``cell`` name the elements, alternatives parted by ``|``. A batch holds the rows of many pages: the table
    function makes one batch a page, which costs far more than reading a small page.
    """
    rows = pages.select(key, F.col(html).cast("string").alias("html"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found, of = batch.column(0), [], []
            for i, text in enumerate(batch.column(1)):
                for one in page_rows(text.as_py(), table, row, cell):
                    found.append(one)
                    of.append(i)
                    if len(found) == ROWS_AT_ONCE:
                        yield _rows_batch(keys, of, found)
                        found, of = [], []
            if found:
                yield _rows_batch(keys, of, found)

    return rows.mapInArrow(read, StructType([StructField(key, rows.schema[0].dataType), *StructType.fromDDL(ROW).fields]))


def _rows_batch(keys: pa.Array, of: list[int], found: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(values, t) for values, t in zip(zip(*found, strict=True), _ROW_TYPES.values(), strict=True)]
    return pa.RecordBatch.from_arrays([keys.take(pa.array(of, pa.int64())), *columns], names=["key", *_ROW_TYPES])
