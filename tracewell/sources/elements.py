"""HTML elements as rows: tag, attributes, path and, where asked for, the text inside."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.sources.rows import rows_of

SCHEMA = "id long, ord int, tag string, attributes map<string,string>, text string, path string"
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSED_BY = {"td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "li": {"li"}, "p": {"p", "div", "table", "ul", "ol", "pre", "h1", "h2", "h3", "h4", "h5", "h6"}}
#: Elements whose text is kept; that of a page is the row with an empty tag.
TEXT_OF = frozenset("td th caption pre a title desc text".split())


class _Elements(HTMLParser):
    """Elements in order of their start; open ones are counted by name, so end tags are found at once."""

    def __init__(self, text_of: frozenset, text_class: str):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[tuple] = []  # (tag, row or None, where its text begins, its path, children by tag)
        self.count: dict[str, int] = {}
        self.parts: list[str] = []
        self.text_of, self.text_class = text_of, text_class
        self.top: dict[str, int] = {}

    def _close(self) -> None:
        tag, row, begin, _, _ = self.open.pop()
        self.count[tag] -= 1
        if row is not None:
            row[3] = "".join(self.parts[begin:])

    def handle_starttag(self, tag, attrs):
        while self.open and tag in _CLOSED_BY.get(self.open[-1][0], ()):
            self._close()
        children = self.open[-1][4] if self.open else self.top
        children[tag] = children.get(tag, 0) + 1
        path = f"{self.open[-1][3] if self.open else ''}/{tag}[{children[tag]}]"
        attributes = {k: v or "" for k, v in attrs}
        row = [len(self.rows) + 1, tag, attributes, None, path]
        self.rows.append(row)
        if tag not in _VOID:
            wanted = tag in self.text_of or self.text_class in attributes.get("class", "").split()
            self.open.append((tag, row if wanted else None, len(self.parts), path, {}))
            self.count[tag] = self.count.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self._close()

    def handle_endtag(self, tag):
        if self.count.get(tag):
            while self.open[-1][0] != tag:
                self._close()
            self._close()

    def handle_data(self, data):
        if not (self.count.get("script") or self.count.get("style")):
            self.parts.append(data)


def elements_of(source: str, text_of: frozenset = TEXT_OF, text_class: str = "math-tex") -> list[list]:
    """[ord, tag, attributes, text, path] of every element; the first row, with an empty tag, is the page and its visible text."""
    walker = _Elements(text_of, text_class)
    walker.feed(source)
    walker.close()
    while walker.open:
        walker._close()
    return [[0, "", {}, " ".join(walker.parts), ""], *walker.rows]


def elements(sources: DataFrame, text_of: frozenset = TEXT_OF, text_class: str = "math-tex") -> DataFrame:
    """One row per element of (id, html); null html has none but its page's row."""

    schema = pa.schema({"id": pa.int64(), "ord": pa.int32(), "tag": pa.string(), "attributes": pa.map_(pa.string(), pa.string()), "text": pa.string(), "path": pa.string()})

    def walk(batches):
        return rows_of(batches, lambda html: ((n, tag, list(attributes.items()), text, path) for n, tag, attributes, text, path in elements_of(html, text_of, text_class)), schema)

    return sources.select(F.col("id").cast("long").alias("id"), F.col("html").cast("string").alias("html")).mapInArrow(walk, SCHEMA).hint("merge")
