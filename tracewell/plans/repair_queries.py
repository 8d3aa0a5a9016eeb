"""The query of the line mask, over drafts that show each rule.

A draft is a block of a conversation behind a few lines that the rule changes, or must not change,
written around the block's first longer word.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import text as op
from tracewell.registry import query
from tracewell.sources.model import BLOCKS_SQL, blocks

_WORD = "[A-Za-z]{3,}"
_WORD_SQL = f"CASE WHEN regexp_extract(markdown, '{_WORD}') = '' THEN 'word' ELSE regexp_extract(markdown, '{_WORD}') END"


def _drafts(spark, sf_dir, lines: str):
    """Blocks behind ``lines``, in which ``{w}`` stands for the word."""
    found = F.regexp_extract("markdown", _WORD, 0)
    head = F.replace(F.lit(lines + "\n"), F.lit("{w}"), F.when(found == "", "word").otherwise(found))
    return blocks(spark, sf_dir).withColumn("markdown", F.concat(head, "markdown"))


_FENCES = "a {w}\n````\n```\n{w}\n````\nafter {w}\n~~~ x\n````\n~~~ y\n~~~~ \n$$\n{w}\n$$\n> {w}\n | t |\n    code\nend"


@query(
    f"WITH RECURSIVE {BLOCKS_SQL}, w AS (SELECT *, {_WORD_SQL} AS w FROM blocks), d AS (SELECT material_id, block_id, string_split(replace('{_FENCES}', '{{w}}', w) || chr(10) || markdown, chr(10)) AS ls FROM w), "
    "l AS (SELECT material_id, block_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM d), "
    "f AS (SELECT *, regexp_extract(line, '^[ \\t]*(`{3,}|~{3,})', 1) AS mark, trim(regexp_extract(line, '^[ \\t]*(?:`{3,}|~{3,})(.*)$', 1)) AS rest, regexp_matches(line, '^\\s*\\$\\$\\s*$') AS display, "
    "regexp_matches(line, '^ {0,3}(>|#{1,6}\\s|\\|)|^(    |\\t)') OR regexp_matches(line, '^\\s*\\|.*\\|\\s*$') AS shaped FROM l), "
    "r AS (SELECT material_id, block_id, 0 AS n, '' AS mark, false AS math, false AS protected FROM d UNION ALL "
    "SELECT f.material_id, f.block_id, f.n, CASE WHEN r.mark = '' THEN f.mark WHEN f.mark <> '' AND left(f.mark, 1) = left(r.mark, 1) AND length(f.mark) >= length(r.mark) AND f.rest = '' THEN '' ELSE r.mark END, "
    "CASE WHEN r.mark = '' AND f.mark = '' AND f.display THEN NOT r.math ELSE r.math END, r.mark <> '' OR f.mark <> '' OR r.math OR f.display OR f.shaped "
    "FROM r JOIN f ON f.material_id = r.material_id AND f.block_id = r.block_id AND f.n = r.n + 1) "
    "SELECT material_id, block_id, (n - 1)::BIGINT AS line_no, protected FROM r WHERE n > 0".replace("'" + _FENCES + "'", "'" + _FENCES.replace("\n", "' || chr(10) || '") + "'")
)
def t05_protected_lines(spark, sf_dir):
    """Longer fences hold shorter ones, and only a bare one closes."""
    return op.protected_lines(_drafts(spark, sf_dir, _FENCES)).select("material_id", "block_id", F.col("line_no").cast("long").alias("line_no"), "protected")
