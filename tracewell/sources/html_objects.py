"""HTML to ordered, typed source objects with stable locators."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.sources.rows import rows_of

SCHEMA = "page_id long, ord int, kind string, text string, target string, locator string, parent string, scope string"
_BLOCKS = {"p": "text", "li": "text", "blockquote": "text", "dt": "text", "dd": "text", "td": "text", "th": "text", "figcaption": "text", "div": "text", "pre": "code", **{f"h{n}": "heading" for n in range(1, 7)}}
_VOID = {"br", "img", "hr", "meta", "link", "input", "source", "track", "wbr", "area", "base", "col", "embed", "param"}
_CHROME = {"nav", "header", "footer", "aside"}


class _Walker(HTMLParser):
    """One walk: open elements with a child counter each give the locators."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple] = []
        self.open: list[dict] = [{"tag": "", "path": "", "counts": {}, "kind": None, "text": []}]

    def _scope(self) -> str:
        tags = {e["tag"] for e in self.open}
        return "site_chrome" if tags & _CHROME else "article" if tags & {"article", "main"} else "page"

    def _add(self, kind: str, text: str, target: str | None, path: str, parent: str) -> None:
        self.rows.append((len(self.rows), kind, text, target, path, parent, self._scope()))

    def _flush(self) -> None:
        for element in reversed(self.open):
            if element["kind"]:
                text = " ".join("".join(element["text"]).split())
                element["text"] = []
                if text:
                    self._add(element["kind"], text, None, element["path"], self.open[max(0, self.open.index(element) - 1)]["path"])
                return

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "li") and any(e["tag"] == tag for e in self.open):
            self._close(tag)
        if _BLOCKS.get(tag):
            self._flush()
        top = self.open[-1]
        top["counts"][tag] = top["counts"].get(tag, 0) + 1
        path = f"{top['path']}/{tag}[{top['counts'][tag]}]"
        attributes = dict(attrs)
        if tag == "img":
            self._add("image", attributes.get("alt") or "", attributes.get("src"), path, top["path"])
        if tag in _VOID:
            if tag == "br":
                self.handle_data(" ")
            return
        self.open.append({"tag": tag, "path": path, "counts": {}, "kind": _BLOCKS.get(tag), "text": [], "href": attributes.get("href") if tag == "a" else None, "own": []})

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def _close(self, tag: str) -> None:
        while len(self.open) > 1:
            element = self.open[-1]
            if element["kind"]:
                self._flush()
            if element["tag"] == "a" and element["href"] is not None:
                self._add("link", " ".join("".join(element["own"]).split()), element["href"], element["path"], self.open[-2]["path"])
            if element["tag"] in ("script", "style"):
                self._add("unknown", "".join(element["own"]), None, element["path"], self.open[-2]["path"])
            self.open.pop()
            if element["tag"] == tag:
                return

    def handle_endtag(self, tag):
        if any(e["tag"] == tag for e in self.open):
            self._close(tag)

    def handle_data(self, data):
        top = self.open[-1]
        if "own" in top:
            top["own"].append(data)
        if top["tag"] in ("script", "style", "title"):
            return
        for element in reversed(self.open):
            if element["kind"]:
                element["text"].append(data)
                return


def objects_of(source: str) -> list[tuple]:
    """(ord, kind, text, target, locator, parent, scope) of a page's objects, in page order."""
    walker = _Walker()
    walker.feed(source)
    walker.close()
    while len(walker.open) > 1:
        walker._close(walker.open[-1]["tag"])
    return walker.rows


def page_objects(pages: DataFrame) -> DataFrame:
    """One row per object of every page."""

    schema = pa.schema({"page_id": pa.int64(), "ord": pa.int32(), **dict.fromkeys(("kind", "text", "target", "locator", "parent", "scope"), pa.string())})

    def walk(batches):
        return rows_of(batches, objects_of, schema)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(walk, SCHEMA).hint("merge")
