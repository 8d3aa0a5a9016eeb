"""HTML tables as cells with their spans, and the logical grid that the spans make."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.sources.elements import elements_of
from tracewell.sources.rows import rows_of

SCHEMA = "id long, table_no int, r int, c int, rowspan int, colspan int, is_header boolean, text string"
#: Columns that a cell spans at most.
WIDEST = 1_000
_OWN_TABLE = re.compile(r"^(.*/table\[\d+\])(?:/(?:thead|tbody|tfoot)\[\d+\])?/tr\[\d+\]$")


def _span(value: str | None, most: int) -> int:
    number = int(value) if value and value.isdigit() and len(value) < 9 else 1
    return max(1, min(number or most, most))


def placed_cells(rows: list[list[tuple]]) -> list[tuple]:
    """(row, column, rowspan, colspan, cell) of the rows of a table; a cell takes the first columns that earlier spans leave free.

    ``rows`` hold (rowspan, colspan, cell) as written; a row span of 0 goes to the end, one too long ends there.
    """
    out, taken = [], {}  # taken: column -> first row in which it is free again
    for r, row in enumerate(rows):
        c = 0
        for rowspan, colspan, cell in row:
            while taken.get(c, 0) > r:
                c += 1
            high, wide = _span(rowspan, len(rows) - r), _span(colspan, WIDEST)
            out.append((r, c, high, wide, cell))
            for column in range(c, c + wide):
                taken[column] = max(taken.get(column, 0), r + high)
            c += wide
    return out


def tables_of(source: str) -> list[tuple]:
    """(table number from 1, row, column, rowspan, colspan, is header, text) of all cells; tables inside cells are tables of their own."""
    numbers: dict[str, int] = {}
    rows: dict[str, dict[str, list]] = {}
    for _, tag, attributes, text, path in elements_of(source):
        if tag == "table":
            numbers[path] = len(numbers) + 1
        elif tag in ("td", "th") and (own := _OWN_TABLE.match(path.rpartition("/")[0])):
            rows.setdefault(own[1], {}).setdefault(own[0], []).append((attributes.get("rowspan"), attributes.get("colspan"), (tag == "th", " ".join((text or "").split()))))
        elif tag == "tr" and (own := _OWN_TABLE.match(path)):
            rows.setdefault(own[1], {}).setdefault(own[0], [])
    return [(numbers[name], r, c, high, wide, *cell) for name, held in rows.items() if name in numbers for r, c, high, wide, cell in placed_cells(list(held.values()))]


def html_tables(pages: DataFrame) -> DataFrame:
    """Cells of the tables in ``pages(id, html)`` by their place in the logical grid; a null page has none."""
    schema = pa.schema({"id": pa.int64(), **dict.fromkeys(("table_no", "r", "c", "rowspan", "colspan"), pa.int32()), "is_header": pa.bool_(), "text": pa.string()})

    def walk(batches):
        return rows_of(batches, tables_of, schema)

    return pages.select(F.col("id").cast("long").alias("id"), F.col("html").cast("string").alias("html")).mapInArrow(walk, SCHEMA).hint("merge")


def logical_grid(cells: DataFrame) -> DataFrame:
    """(id, table_no, r, c, is_header, text): a row for each place that a cell covers."""
    down = cells.withColumn("r", F.explode(F.sequence(F.col("r"), F.col("r") + F.col("rowspan") - 1)))
    return down.withColumn("c", F.explode(F.sequence(F.col("c"), F.col("c") + F.col("colspan") - 1))).select("id", "table_no", "r", "c", "is_header", "text").hint("merge")


def native_signatures(cells: DataFrame) -> DataFrame:
    """(id, table_no, signature): a digest of the texts and spans of a table's cells, row by row."""
    cell = F.concat_ws(":", "text", F.col("rowspan").cast("string"), F.col("colspan").cast("string"))
    rows = cells.groupBy("id", "table_no", "r").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", cell.alias("cell")))), lambda x: x["cell"]), "|").alias("line"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy("id", "table_no").agg(F.sha2(lines, 256).alias("signature"))
