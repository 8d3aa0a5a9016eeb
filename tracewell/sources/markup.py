"""Markdown and RST sources: line scanners that yield typed objects in order."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.sources.rows import rows_of

OBJECT_SCHEMA = "id string, ord int, kind string, text string, language string, line int"
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})\s*(\S*)")
_HEADING = re.compile(r"^ {0,3}(#{1,6})\s+(.*?)\s*#*\s*$")
_TABLE = re.compile(r"^\s*\|.*\|\s*$")
_ITEM = re.compile(r"^\s*(?:[-*+]|\d+[.)])\s+(.*)$")
_FORMULA = re.compile(r"\$\$(.+?)\$\$|\\\[(.+?)\\\]|(?<![\\$])\$([^$\n]+)\$", re.S)
_DIRECTIVE = re.compile(r"^\.\. ([A-Za-z][\w:-]*)::\s*(.*)$")

Found = tuple[str, str, str | None, int]


def markdown_objects(source: str) -> Iterator[Found]:
    """(kind, text, language, first line) of front matter, headings, paragraphs, items, tables, fences, formulas, footnotes."""
    lines = source.split("\n")
    at = 0
    if lines and lines[0].strip() == "---" and "---" in (x.strip() for x in lines[1:]):
        end = next(i for i, x in enumerate(lines[1:], 1) if x.strip() == "---")
        yield "metadata", "\n".join(lines[1:end]), "yaml", 0
        at = end + 1
    held: list[str] = []
    began = at

    def paragraph() -> Iterator[Found]:
        if held:
            text = "\n".join(held)
            held.clear()
            yield "text", text, None, began
            for m in _FORMULA.finditer(text):
                yield "formula", (m[1] or m[2] or m[3]).strip(), None, began

    while at < len(lines):
        line = lines[at]
        fence, heading, item = _FENCE.match(line), _HEADING.match(line), _ITEM.match(line)
        if fence:
            yield from paragraph()
            mark, end = fence[1], at + 1
            while end < len(lines) and not re.match(rf"^ {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}\s*$", lines[end]):
                end += 1
            yield "code", "\n".join(lines[at + 1 : end]), fence[2] or None, at
            at = end + 1
        elif heading:
            yield from paragraph()
            yield "heading", heading[2], None, at
            at += 1
        elif _TABLE.match(line):
            yield from paragraph()
            end = at
            while end < len(lines) and _TABLE.match(lines[end]):
                end += 1
            yield "table", "\n".join(lines[at:end]), None, at
            at = end
        elif re.match(r"^\[\^[^\]]+\]:", line):
            yield from paragraph()
            yield "footnote", line, None, at
            at += 1
        elif item:
            yield from paragraph()
            yield "text", item[1], None, at
            at += 1
        elif not line.strip():
            yield from paragraph()
            at += 1
        else:
            if not held:
                began = at
            held.append(line)
            at += 1
    yield from paragraph()


def rst_directives(source: str) -> Iterator[Found]:
    """(kind, body, name, line) of top-level directives: options are metadata, the rest text."""
    lines = source.split("\n")
    for at, line in enumerate(lines):
        m = _DIRECTIVE.match(line)
        if not m:
            continue
        body, end = [m[2]] if m[2] else [], at + 1
        while end < len(lines) and (not lines[end].strip() or lines[end][0] in " \t"):
            body.append(lines[end].strip())
            end += 1
        text = "\n".join(body).strip()
        yield ("metadata" if all(b.startswith(":") for b in body if b) and body else "text"), text, m[1], at


def scanned(texts: DataFrame, scanner) -> DataFrame:
    """One row per object that ``scanner`` finds in (id, text)."""

    schema = pa.schema({"id": pa.string(), "ord": pa.int32(), "kind": pa.string(), "text": pa.string(), "language": pa.string(), "line": pa.int32()})

    def scan(batches):
        return rows_of(batches, lambda text: ((n, *found) for n, found in enumerate(scanner(text))), schema)

    return texts.select(F.col("id").cast("string").alias("id"), "text").mapInArrow(scan, OBJECT_SCHEMA).hint("merge")
