"""Text analytics over lines, spans and blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.sources.rows import rows_of

SPAN_LIMIT, SPAN_LEAST = 900, 200


def canonical_text(blocks: DataFrame) -> DataFrame:
    """(material_id, blocks, text): blocks in order, joined by blank lines, and a newline."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("ord", "markdown"))), lambda b: b["markdown"])
    return blocks.groupBy("material_id").agg(F.count("*").alias("blocks"), F.concat(F.array_join(rows, "\n\n"), F.lit("\n")).alias("text"))


def cut_spans(text: str, limit: int = SPAN_LIMIT, least: int = SPAN_LEAST) -> Iterator[tuple[int, int]]:
    """[start, end) spans: each ends at the last paragraph or sentence end after ``least``, else the last space."""
    if not text:
        yield 0, 0
    start = 0
    while start < len(text):
        end = min(len(text), start + limit)
        if end < len(text):
            part = text[start:end]
            paragraph = part.rfind("\n\n", least)
            sentence = max(part.rfind(mark, least) + len(mark) if part.rfind(mark, least) >= 0 else -1 for mark in (". ", "! ", "? ", "。", "！", "？", ".\n"))
            cut = max(paragraph + 2 if paragraph >= 0 else -1, sentence)
            if cut < 0:
                cut = part.rfind(" ", least) + 1 or len(part)
            end = start + cut
        yield start, end
        start = end


def source_spans(texts: DataFrame) -> DataFrame:
    """(id, span_id, start, end) of every span of (id, text)."""

    schema = pa.schema({"id": pa.string(), "start": pa.int32(), "end": pa.int32()})

    def spans(batches):
        return rows_of(batches, cut_spans, schema)

    cut = texts.select(F.col("id").cast("string"), "text").mapInArrow(spans, "id string, start int, end int")
    return cut.select("id", F.concat("id", F.lit(":"), "start", F.lit(":"), "end").alias("span_id"), "start", "end").hint("merge")


def lines_of(blocks: DataFrame) -> DataFrame:
    """(keys of a block, line number from 0, line)."""
    return blocks.select("material_id", "block_id", F.posexplode(F.split("markdown", "\n")).alias("line_no", "line")).hint("merge")


_FENCE = re.compile(r"[ \t]*(`{3,}|~{3,})(.*)", re.S)
_SHAPED = re.compile(r" {0,3}(?:>|#{1,6}\s|\|)|    |\t|\s*\|.*\|\s*$")


def fenced_lines(text: str) -> Iterator[tuple[str, bool]]:
    """(line, whether it is a fence or inside one).

    A fence closes with the same character at least as often and nothing behind it; other fences inside it are its content.
    """
    mark = ""
    for line in text.split("\n"):
        found = _FENCE.match(line)
        if found and not mark:
            mark = found[1]
            yield line, True
        elif found and found[1][0] == mark[0] and len(found[1]) >= len(mark) and not found[2].strip():
            mark = ""
            yield line, True
        else:
            yield line, bool(mark)


def protected_mask(text: str) -> list[bool]:
    """Which lines are fences or inside one, display math, quotations, tables, headings or indented code."""
    out, math = [], False
    for line, fenced in fenced_lines(text):
        display = not fenced and line.strip() == "$$"
        out.append(fenced or math or display or bool(_SHAPED.match(line)))
        math ^= display
    return out


def protected_lines(blocks: DataFrame) -> DataFrame:
    """(material_id, block_id, line_no, line, protected) of every line; a fold over the lines of each block."""

    block = pa.struct({"material_id": pa.int64(), "block_id": pa.string()})
    schema = pa.schema({"block": block, "line_no": pa.int32(), "line": pa.string(), "protected": pa.bool_()})

    def fold(batches):
        return rows_of(batches, lambda text: ((n, line, protected) for n, (line, protected) in enumerate(zip(text.split("\n"), protected_mask(text)))), schema)

    key = F.struct(F.col("material_id").cast("long").alias("material_id"), F.col("block_id").cast("string").alias("block_id"))
    picked = blocks.where("markdown IS NOT NULL").select(key.alias("block"), F.col("markdown").cast("string").alias("markdown"))
    found = picked.mapInArrow(fold, "block struct<material_id: long, block_id: string>, line_no int, line string, protected boolean")
    return found.select("block.material_id", "block.block_id", "line_no", "line", "protected").hint("merge")


def evidence_catalog(blocks: DataFrame) -> DataFrame:
    """(material_id, evidence_id, block_id, text) of every non-blank line."""
    rows = blocks.select("material_id", "ord", "block_id", F.posexplode(F.split("markdown", "\n")).alias("line_no", "text")).where(F.trim("text") != "").hint("merge")
    return rows.select("material_id", F.concat(F.lit("e"), "ord", F.lit("-"), "line_no").alias("evidence_id"), "block_id", "text")


def repeated_texts(rows: DataFrame, text: str = "text", least: int = 100) -> DataFrame:
    """(ref, text, n): texts of at least ``least`` characters that occur more than once."""
    digest = F.sha2(text, 256)
    long = rows.where(F.char_length(text) >= least)
    return long.groupBy(digest.alias("ref")).agg(F.min(text).alias("text"), F.count("*").alias("n")).where("n > 1")


def referenced(rows: DataFrame, dictionary: DataFrame, text: str = "text") -> DataFrame:
    """Texts of the dictionary replaced by their reference; ``restored`` undoes it."""
    refs = dictionary.select(F.col("ref"))
    met = rows.withColumn("ref", F.sha2(text, 256)).join(refs.withColumn("known", F.lit(True)), "ref", "left")
    return met.withColumn(text, F.when(F.col("known"), F.lit(None)).otherwise(F.col(text))).withColumn("ref", F.when(F.col("known"), F.col("ref"))).drop("known")


def restored(rows: DataFrame, dictionary: DataFrame, text: str = "text") -> DataFrame:
    full = dictionary.select("ref", F.col("text").alias("full_text"))
    return rows.join(full, "ref", "left").withColumn(text, F.coalesce(text, "full_text")).drop("ref", "full_text")


def merged_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping or touching [start, end) spans of a key merged (running maximum of ends, then islands)."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("is_new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    island = marked.withColumn("island", F.sum("is_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def occurrences(texts: DataFrame, keys: list[str], text: str, literal) -> DataFrame:
    """[start, end) of every occurrence of a literal (non-overlapping, from the left)."""
    parts = F.split(F.col(text), F.concat(F.lit("\\Q"), literal, F.lit("\\E")), -1)
    before = F.aggregate(
        F.slice(parts, 1, F.size(parts) - 1),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found")),
        lambda s, p: F.struct((s["at"] + F.char_length(p) + F.char_length(literal)).alias("at"), F.concat(s["found"], F.array(s["at"] + F.char_length(p))).alias("found")),
    )["found"]
    return texts.where(literal != "").select(*keys, F.explode(before).alias("start"), F.char_length(literal).alias("length")).hint("merge").select(*keys, "start", (F.col("start") + F.col("length")).alias("end"))


def heading_rows(blocks: DataFrame) -> DataFrame:
    """(material_id, block_id, line_no, level, title) of Markdown headings."""
    level = F.length(F.regexp_extract("line", r"^ {0,3}(#{1,6})\s+\S", 1))
    return lines_of(blocks).withColumn("level", level).where("level > 0").select("material_id", "block_id", "line_no", "level", F.trim(F.regexp_extract("line", r"^ {0,3}#{1,6}\s+(.*)$", 1)).alias("title"))


def heading_skips(headings: DataFrame, order: list[str]) -> DataFrame:
    """(material_id, skips): jumps of more than one level down."""
    before = F.lag("level").over(Window.partitionBy("material_id").orderBy(*order))
    return headings.withColumn("jump", F.col("level") - before).groupBy("material_id").agg(F.count_if(F.col("jump") > 1).alias("skips"))


def numbered_headings(headings: DataFrame, order: list[str], depth: int = 6) -> DataFrame:
    """Adds ``number``: running counters per level ("2.1.3"), restarted below a higher heading."""
    out, keys, columns = headings, [], []
    for level in range(1, depth + 1):
        scope = Window.partitionBy("material_id", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn(f"n{level}", F.sum(F.when(F.col("level") == level, 1).otherwise(0)).over(scope))
        keys.append(f"n{level}")
        columns.append(F.when(F.col("level") >= level, F.col(f"n{level}").cast("string")))
    return out.withColumn("number", F.concat_ws(".", *columns)).drop(*keys)


def authored_measures(blocks: DataFrame) -> DataFrame:
    from tracewell.functions.scalars import authored_text, han_characters, latin_words

    own = authored_text(F.col("markdown"))
    return blocks.select("material_id", "block_id", latin_words(own).cast("long").alias("latin"), han_characters(own).cast("long").alias("han"))


def format_signals(lines: DataFrame, rules: dict[str, str]) -> DataFrame:
    """One row per line and rule that it shows: (keys of the line, rule)."""
    shown = F.filter(F.array(*(F.when(F.col("line").rlike(p), F.lit(name)) for name, p in rules.items())), lambda r: r.isNotNull())
    return lines.select("material_id", "block_id", "line_no", F.explode(shown).alias("rule"))


def tightened(markdown: Column) -> Column:
    """No blank lines between list items, trimmed edges, at most one blank line."""
    text = F.regexp_replace(markdown, r"(?m)(^[ \t]*(?:[-*+]|\d+\.)[ \t].*)\n(?:[ \t]*\n)+(?=[ \t]*(?:[-*+]|\d+\.)[ \t])", "$1\n")
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
