"""Queries of the text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import scalars as fn
from tracewell.operators import text as op
from tracewell.registry import query
from tracewell.sources.model import BLOCKS_SQL, OBJECTS_SQL, blocks, objects, table


def _after(text: str, mark: str, size: int) -> str:
    """SQL: where the last ``mark`` at or behind place 200 of ``text`` ends, or 0."""
    turned = f"strpos(reverse({text}), reverse({mark}))"
    return f"CASE WHEN {turned} > 0 AND length({text}) - {turned} - {size} + 1 >= 200 THEN length({text}) - {turned} + 1 ELSE 0 END"


@query(
    "SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) || regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') || "
    "CASE WHEN regexp_extract(url, '\\?([^#]*)', 1) = '' THEN '' ELSE '?' || regexp_extract(url, '\\?([^#]*)', 1) END AS audit_url, "
    "lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) || regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) || "
    "CASE WHEN regexp_extract(url, '\\?([^#]*)', 1) = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&')), '&') END AS evaluation_url FROM pages"
)
def t01_canonical_url(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", fn.canonical_url(url).alias("audit_url"), fn.canonical_url(url, True).alias("evaluation_url"))


#: Case folding of letters that data of these languages and Greek samples hold.
_FOLDED_SQL = "replace(replace(lower({x}), 'ß', 'ss'), 'ς', 'σ')"


@query("SELECT doc_id, sha256(" + _FOLDED_SQL.format(x="trim(regexp_replace('STRASSE Straße ΟΔΟΣ οδος ' || text, '\\s+', ' ', 'g'))") + ") AS normal_sha256 FROM documents")
def t02_normal_text(spark, sf_dir):
    """Texts behind words that only case folding makes equal."""
    text = F.concat(F.lit("STRASSE Straße ΟΔΟΣ οδος "), "text")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(fn.normal_text(text), 256).alias("normal_sha256"))


_SPANS_SQL = (
    "WITH RECURSIVE d AS (SELECT doc_id::VARCHAR AS id, coalesce(text, '') AS t FROM documents), "
    "cut AS (SELECT id, t, 0::BIGINT AS start, NULL::BIGINT AS size FROM d UNION ALL SELECT id, t, start + coalesce(size, 0), CASE WHEN length(p) < 900 OR last THEN length(p) ELSE coalesce(nullif(greatest(para, sentence), 0), nullif(space, 0), 900) END FROM ("
    "SELECT *, " + _after("p", "chr(10) || chr(10)", 2) + " AS para, greatest(" + ", ".join(_after("p", f"'{m}'" if m != ".N" else "'.' || chr(10)", 2 if len(m) > 1 else 1) for m in (". ", "! ", "? ", "。", "！", "？", ".N")) + ") AS sentence, " + _after("p", "' '", 1) + " AS space "
    "FROM (SELECT *, substr(t, start + coalesce(size, 0) + 1, 900) AS p, length(t) <= start + coalesce(size, 0) + 900 AS last FROM cut WHERE start + coalesce(size, 0) < length(t) OR (size IS NULL AND t = ''))) WHERE size IS NULL OR t <> '') "
)


@query(_SPANS_SQL + "SELECT id, id || ':' || start || ':' || (start + size) AS span_id, start::INT AS start, (start + size)::INT AS \"end\" FROM cut WHERE size IS NOT NULL")
def t03_source_spans(spark, sf_dir):
    """The cut of a span depends on where the last one ended."""
    return op.source_spans(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


@query(_SPANS_SQL + "SELECT id, count(*) AS spans, true AS contiguous FROM cut WHERE size IS NOT NULL GROUP BY id")
def t04_span_ranges(spark, sf_dir):
    """A range over canonical spans expands to the spans it covers, if they are contiguous."""
    from pyspark.sql import Window

    spans = op.source_spans(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    claims = spans.groupBy("id").agg(F.min("start").alias("claim_start"), F.max("end").alias("claim_end"))
    inside = spans.join(claims, "id").where("start >= claim_start and end <= claim_end")
    gap = F.col("start") - F.coalesce(F.lag("end").over(Window.partitionBy("id").orderBy("start")), F.col("claim_start"))
    return inside.withColumn("gap", gap).groupBy("id").agg(F.count("*").alias("spans"), (F.max("gap") == 0).alias("contiguous"))


@query(
    f"WITH {BLOCKS_SQL}, l AS (SELECT material_id, block_id, generate_subscripts(string_split(markdown, chr(10)), 1) - 1 AS line_no, unnest(string_split(markdown, chr(10))) AS line FROM blocks) "
    "SELECT material_id, block_id, line_no, 'double-space' AS rule FROM l WHERE regexp_matches(line, '\\S  +\\S') UNION ALL SELECT material_id, block_id, line_no, 'space-before-comma' FROM l WHERE regexp_matches(line, '\\s[,;]') "
    "UNION ALL SELECT material_id, block_id, line_no, 'short-sentence' FROM l WHERE regexp_matches(line, '(^|\\. )[^ .]+\\.( |$)') UNION ALL SELECT material_id, block_id, line_no, 'trailing-space' FROM l WHERE regexp_matches(line, '\\s$')"
)
def t06_format_signals(spark, sf_dir):
    rules = {"double-space": r"\S  +\S", "space-before-comma": r"\s[,;]", "short-sentence": r"(^|\. )[^ .]+\.( |$)", "trailing-space": r"\s$"}
    return op.format_signals(op.lines_of(blocks(spark, sf_dir)), rules).select("material_id", "block_id", F.col("line_no").cast("long").alias("line_no"), "rule")


@query(
    f"WITH {BLOCKS_SQL}, p AS (SELECT material_id, block_id, regexp_replace(regexp_replace(regexp_replace(markdown, '`[^`\\n]*`', ' ', 'g'), 'https?://\\S+', ' ', 'g'), '<[^>\\n]*>', ' ', 'g') AS t FROM blocks) "
    "SELECT material_id, block_id, len(regexp_extract_all(t, '[A-Za-z]+')) AS latin, len(regexp_extract_all(t, '[\\x{4E00}-\\x{9FFF}]')) AS han FROM p"
)
def t16_authored_language(spark, sf_dir):
    return op.authored_measures(blocks(spark, sf_dir))


@query("SELECT doc_id, sha256(regexp_replace(lower(text), '[^\\p{L}\\p{N}\\p{S}]', '', 'g') || '|' || array_to_string(regexp_extract_all(text, '(\\d+(?:\\.\\d+)?)', 1), ',')) AS signature FROM documents")
def t17_format_signature(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(fn.format_signature(F.col("text")), 256).alias("signature"))


_HEADINGS = f"{OBJECTS_SQL}, headings AS (SELECT material_id, ord, text, 1 + length(text) % 3 AS level FROM objects WHERE kind = 'heading')"


def _headings(spark, sf_dir):
    return objects(spark, sf_dir).where("kind = 'heading'").select("material_id", "ord", "text", (1 + F.char_length("text") % 3).alias("level"))


@query(
    f"WITH {_HEADINGS}, a AS (SELECT *, sum((level = 1)::INT) OVER (PARTITION BY material_id ORDER BY ord) AS n1 FROM headings), "
    "b AS (SELECT *, sum((level = 2)::INT) OVER (PARTITION BY material_id, n1 ORDER BY ord) AS n2 FROM a), c AS (SELECT *, sum((level = 3)::INT) OVER (PARTITION BY material_id, n1, n2 ORDER BY ord) AS n3 FROM b) "
    "SELECT material_id, ord, level, n1 || CASE WHEN level >= 2 THEN '.' || n2 ELSE '' END || CASE WHEN level >= 3 THEN '.' || n3 ELSE '' END AS number FROM c"
)
def t18_heading_numbers(spark, sf_dir):
    return op.numbered_headings(_headings(spark, sf_dir), ["ord"], 3).select("material_id", "ord", F.col("level").cast("long").alias("level"), "number")


@query(f"WITH {_HEADINGS}, j AS (SELECT material_id, level - lag(level) OVER (PARTITION BY material_id ORDER BY ord) AS jump FROM headings) SELECT material_id, count(*) FILTER (jump > 1) AS skips FROM j GROUP BY material_id")
def t19_heading_skips(spark, sf_dir):
    return op.heading_skips(_headings(spark, sf_dir), ["ord"])


@query(
    "WITH p AS (SELECT DISTINCT p_name AS name, p_type AS short FROM part), d AS (SELECT conv_id AS material_id, lower(string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn)) AS draft FROM conversations GROUP BY conv_id) "
    "SELECT material_id, count(*) AS missing FROM d JOIN p ON NOT contains(draft, lower(p.name)) GROUP BY material_id"
)
def t21_missing_names(spark, sf_dir):
    """How many glossary names a draft lacks: all of them less those it holds."""
    from tracewell.operators import literals

    names = table(spark, sf_dir, "part").select(F.lower("p_name").alias("name"), "p_type").distinct().select("name")
    drafts = op.canonical_text(blocks(spark, sf_dir)).select("material_id", F.lower("text").alias("draft"))
    has = literals.held(drafts, names, ["material_id"], "draft", "name").groupBy("material_id").agg(F.count_distinct("name").alias("has"))
    every = F.lit(names.where("name IS NOT NULL").count())
    missing = (every - F.coalesce("has", F.lit(0))).alias("missing")
    return drafts.select("material_id").hint("merge").join(has, "material_id", "left").select("material_id", missing).where("missing > 0")


@query(f"WITH {BLOCKS_SQL}, l AS (SELECT material_id, ord, block_id, generate_subscripts(string_split(markdown, chr(10)), 1) - 1 AS n, unnest(string_split(markdown, chr(10))) AS t FROM blocks) SELECT material_id, 'e' || ord || '-' || n AS evidence_id, block_id, sha256(t) AS text_sha256 FROM l WHERE trim(t) <> ''")
def t24_evidence_catalog(spark, sf_dir):
    return op.evidence_catalog(blocks(spark, sf_dir)).select("material_id", "evidence_id", "block_id", F.sha2("text", 256).alias("text_sha256"))


@query(f"WITH {BLOCKS_SQL} SELECT material_id, sha256(string_agg(markdown, chr(10) || chr(10) ORDER BY ord) || chr(10)) AS digest FROM blocks GROUP BY material_id")
def t25_canonical_digest(spark, sf_dir):
    return op.canonical_text(blocks(spark, sf_dir)).select("material_id", F.sha2("text", 256).alias("digest"))


@query(f"WITH {OBJECTS_SQL} SELECT sha256(text) AS ref, count(*) AS n FROM objects WHERE length(text) >= 100 GROUP BY 1 HAVING count(*) > 1")
def t26_repeated_texts(spark, sf_dir):
    return op.repeated_texts(objects(spark, sf_dir)).select("ref", "n")


@query(
    "WITH w AS (SELECT doc_id, unnest(range(0, len(string_split(text, 'the')) - 1)) AS k, string_split(text, 'the') AS p FROM documents WHERE contains(text, 'the')) "
    "SELECT doc_id, length(array_to_string(p[1:k + 1], 'the')) AS start, length(array_to_string(p[1:k + 1], 'the')) + 3 AS \"end\" FROM w"
)
def t30_literal_spans(spark, sf_dir):
    found = op.occurrences(table(spark, sf_dir, "documents"), ["doc_id"], "text", F.lit("the"))
    return found.select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query("SELECT DISTINCT p_name AS name, lower(nfc_normalize(p_name)) AS key, length(p_name) BETWEEN 1 AND 180 AND NOT regexp_matches(p_name, '[/\\\\\\x00-\\x1f]') AS valid FROM part")
def t31_name_keys(spark, sf_dir):
    from tracewell.functions.names import name_key, valid_name

    return table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct().select("name", name_key("name").alias("key"), valid_name(F.col("name")).alias("valid"))


@query(
    f"WITH {OBJECTS_SQL}, f AS (SELECT *, first_value(CASE WHEN kind = 'text' THEN text END IGNORE NULLS) OVER (PARTITION BY material_id ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM objects) "
    "SELECT material_id, object_id, sha256(left(coalesce(nxt, ''), 1200)) AS context_sha256 FROM f WHERE kind = 'heading' AND regexp_matches(text, '[A-Za-z]') AND NOT regexp_matches(text, '[\\x{4E00}-\\x{9FFF}]')"
)
def t32_foreign_headings(spark, sf_dir):
    from pyspark.sql import Window

    after = Window.partitionBy("material_id").orderBy("ord").rowsBetween(1, Window.unboundedFollowing)
    following = F.first(F.when(F.col("kind") == "text", F.col("text")), ignorenulls=True).over(after)
    rows = objects(spark, sf_dir).withColumn("following", following).where("kind = 'heading'").where(F.col("text").rlike("[A-Za-z]") & ~F.col("text").rlike(r"[\x{4E00}-\x{9FFF}]"))
    return rows.select("material_id", "object_id", F.sha2(F.left(F.coalesce("following", F.lit("")), F.lit(1200)), 256).alias("context_sha256"))


@query("SELECT doc_id, " + _FOLDED_SQL.format(x="'Maß ΟΔΟΣ ' || source") + " AS folded FROM documents")
def u01_sql_function(spark, sf_dir):
    fn.register(spark)
    return table(spark, sf_dir, "documents").select("doc_id", F.expr("processor_casefold('Maß ΟΔΟΣ ' || source)").alias("folded"))


@query("SELECT event_id, 'k' AS key, CAST(json_extract(props, '$.k') AS VARCHAR) AS value FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def u03_json_each(spark, sf_dir):
    """Lateral expansion of a JSON body into its members."""
    rows = table(spark, sf_dir, "events").select("event_id", F.parse_json("props").alias("body"))
    rows.createOrReplaceTempView("json_bodies")
    return spark.sql("SELECT event_id, e.key, CAST(e.value AS STRING) AS value FROM json_bodies, LATERAL variant_explode(body) AS e")


@query("SELECT p_partkey, row_number() OVER (ORDER BY lower(p_name), p_partkey) AS place FROM part")
def u02_collated_order(spark, sf_dir):
    """Every part's place under a case-insensitive collation."""
    from tracewell.operators.sequence import globally_numbered

    names = table(spark, sf_dir, "part").select(F.collate("p_name", "UNICODE_CI").alias("name"), "p_partkey")
    return globally_numbered(names, ["name", "p_partkey"], "place").select("p_partkey", F.col("place").cast("long").alias("place"))
