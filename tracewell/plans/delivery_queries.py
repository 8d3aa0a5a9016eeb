"""Queries of markup sources, delivery states, compile checks and glossary rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import delivery as op
from tracewell.operators import intake
from tracewell.operators.text import lines_of
from tracewell.registry import query
from tracewell.sources.markup import markdown_objects, rst_directives, scanned
from tracewell.sources.model import BLOCKS_SQL, OBJECTS_SQL, blocks, objects, table


def _markdown(spark, sf_dir):
    """Documents as Markdown: their kinds of line become headings, tables, fences and formulas."""
    rows = objects(spark, sf_dir)
    piece = (
        F.when(F.col("kind") == "heading", F.concat(F.lit("# "), F.regexp_replace("text", "[#|$]", " ")))
        .when(F.col("kind") == "code", F.concat(F.lit("```py\n"), F.regexp_replace("text", "`", " "), F.lit("\n```")))
        .when(F.col("kind") == "table", F.concat(F.lit("| "), F.regexp_replace("text", "[$`]", " "), F.lit(" |")))
        .otherwise(F.regexp_replace("text", r"[$`#|>*+-]", "x"))
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", piece.alias("p")))), lambda x: x["p"])
    return rows.groupBy(F.col("material_id").alias("id")).agg(F.array_join(ordered, "\n\n").alias("text"))


@query(f"WITH {OBJECTS_SQL} SELECT material_id::VARCHAR AS id, kind, count(*) AS n FROM objects WHERE kind IN ('heading', 'code', 'table') GROUP BY ALL")
def s07_markdown_objects(spark, sf_dir):
    """Headings, fences and tables of the documents written as Markdown."""
    found = scanned(_markdown(spark, sf_dir), markdown_objects).where(F.col("kind").isin("heading", "code", "table"))
    return found.groupBy("id", "kind").agg(F.count("*").alias("n"))


@query("SELECT doc_id::VARCHAR AS id, count(*) AS directives FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '' GROUP BY doc_id")
def s09_rst_directives(spark, sf_dir):
    """Every non-blank line of a document as the argument of a directive."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    rst = F.array_join(F.transform(lines, lambda x: F.concat(F.lit(".. note:: "), x)), "\n")
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), rst.alias("text"))
    return scanned(texts, rst_directives).groupBy("id").agg(F.count("*").alias("directives"))


@query(
    "WITH c AS (SELECT o_custkey AS material_id, o_orderpriority AS language, o_orderstatus AS content, o_orderkey AS ord, row_number() OVER (PARTITION BY o_custkey, o_orderpriority, o_orderstatus ORDER BY o_orderkey) AS k FROM orders), "
    "f AS (SELECT l_orderkey, l_linenumber, o_custkey AS material_id, o_orderpriority AS language, o_orderstatus AS content, l_linenumber || ':' || l_suppkey AS raw, "
    "row_number() OVER (PARTITION BY o_custkey, o_orderpriority, o_orderstatus ORDER BY l_orderkey * 1000000 + l_linenumber * 100000 + l_suppkey) AS k FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R') "
    "SELECT c.ord, f.raw FROM c LEFT JOIN f USING (material_id, language, content, k)"
)
def s10_fence_binding(spark, sf_dir):
    """The k-th order of a customer, priority and status binds the k-th returned line of the like."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("material_id"), F.col("o_orderpriority").alias("language"), F.col("o_orderstatus").alias("content"), F.col("o_orderkey").alias("ord"))
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o"), (F.col("l_orderkey") * 1_000_000 + F.col("l_linenumber") * 100_000 + F.col("l_suppkey")).alias("ord"), F.concat_ws(":", "l_linenumber", "l_suppkey").alias("raw"))
    fences = orders.withColumnRenamed("ord", "o").join(lines, "o").drop("o")
    return intake.bind_fences(orders, fences).select("ord", "raw")


@query("SELECT p_partkey, 'l.png,s.png,' || p_type || '.png' AS candidates FROM part")
def s11_image_candidates(spark, sf_dir):
    """Srcset entries by descriptor, then the fallback."""
    srcset = F.lit("s.png 1x, l.png 2.5x")
    urls = intake.ranked_candidates(srcset, F.array(F.concat("p_type", F.lit(".png")), F.lit("s.png")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(urls, ",").alias("candidates"))


@query(
    "WITH RECURSIVE e AS (SELECT user_id AS project, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CASE event_type WHEN 'view' THEN 'review_ready' WHEN 'click' THEN 'accept' WHEN 'purchase' THEN 'publish' WHEN 'error' THEN 'edit' ELSE 'other' END AS kind FROM events), "
    "s(project, n, state, rejected) AS (SELECT DISTINCT project, 0::BIGINT, 'draft', 0 FROM e UNION ALL "
    "SELECT s.project, e.n, CASE WHEN kind = 'edit' THEN 'draft' WHEN kind = 'review_ready' AND state = 'draft' THEN 'ready_for_review' WHEN kind = 'accept' AND state = 'ready_for_review' THEN 'accepted' WHEN kind = 'publish' AND state = 'accepted' THEN 'published' ELSE state END, "
    "rejected + CASE WHEN kind = 'edit' OR (kind = 'review_ready' AND state = 'draft') OR (kind = 'accept' AND state = 'ready_for_review') OR (kind = 'publish' AND state = 'accepted') THEN 0 ELSE 1 END FROM s JOIN e ON e.project = s.project AND e.n = s.n + 1) "
    "SELECT project, max_by(state, n) AS state, max_by(rejected, n) AS rejected FROM s GROUP BY project"
)
def a18_delivery_states(spark, sf_dir):
    kind = F.create_map(*(F.lit(x) for pair in (("view", "review_ready"), ("click", "accept"), ("purchase", "publish"), ("error", "edit")) for x in pair))
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("project"), "ts", "event_id", F.coalesce(F.try_element_at(kind, F.col("event_type")), F.lit("other")).alias("kind"))
    return op.delivery_states(events)


def _marked_lines(spark, sf_dir):
    """Documents as drafts: every table or formula line has become a marker, code lines a marker within text."""
    marker = F.concat(F.lit("{{source:"), F.col("kind"), F.lit("}}"))
    line = F.when(F.col("kind").isin("table", "formula"), marker).when(F.col("kind") == "code", F.concat(F.lit("see "), marker)).otherwise(F.lit("text"))
    return objects(spark, sf_dir).select("material_id", F.col("ord").alias("line_no"), line.alias("line"), F.lit(False).alias("protected"))


_MARKED = f"{OBJECTS_SQL}, m AS (SELECT material_id, ord AS line_no, kind, row_number() OVER (PARTITION BY material_id, kind ORDER BY ord) AS nth FROM objects WHERE kind IN ('table', 'formula', 'code')), i AS (SELECT material_id, line_no, 'UNKNOWN_MARKER' AS code FROM m WHERE kind = 'formula' UNION ALL SELECT material_id, line_no, 'DUPLICATE_RESOURCE' FROM m WHERE nth > 1 UNION ALL SELECT material_id, line_no, 'MARKER_PLACEMENT' FROM m WHERE kind = 'code')"


def _marker_issues(spark, sf_dir):
    known = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("material_id"), F.explode(F.array(F.lit("table"), F.lit("code"))).alias("marker"))
    return op.marker_issues(_marked_lines(spark, sf_dir), known)


@query(f"WITH {_MARKED} SELECT material_id, line_no, code FROM i")
def a37_marker_issues(spark, sf_dir):
    return _marker_issues(spark, sf_dir).select("material_id", "line_no", "code")


@query("SELECT o_custkey AS material_id, 'OMITTED_RESOURCE' AS code, o_orderkey::VARCHAR AS resource_id FROM orders ANTI JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, 'RESOURCE_BINARY_UNAVAILABLE', o_orderkey::VARCHAR FROM orders WHERE o_orderstatus = 'F' AND o_totalprice < 2000 UNION ALL SELECT c_custkey, 'EMPTY_BODY', NULL FROM customer WHERE c_acctbal < 0")
def a38_resource_issues(spark, sf_dir):
    """Finished orders are body resources, their lines placements; customers in debt have empty bodies."""
    bodies = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("material_id"), F.when(F.col("c_acctbal") < 0, "").otherwise("x").alias("markdown"))
    resources = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("material_id"), F.col("o_orderkey").cast("string").alias("resource_id"), F.when(F.col("o_orderstatus") == "F", "body").otherwise("reference").alias("usage"), F.when(F.col("o_totalprice") >= 2000, F.col("o_totalprice")).alias("size"))
    placed = resources.select("material_id", "resource_id").join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("resource_id")).distinct(), "resource_id", "left_semi")
    return op.resource_issues(bodies, resources, placed)


@query(f"WITH {_MARKED} SELECT material_id, count(*) FILTER (code <> 'UNKNOWN_MARKER') AS repair, count(*) FILTER (code = 'UNKNOWN_MARKER') AS confirm, 0 AS service FROM i GROUP BY material_id")
def a39_issue_counts(spark, sf_dir):
    return op.issue_counts(_marker_issues(spark, sf_dir))


@query(f"WITH {BLOCKS_SQL} SELECT material_id, block_id, 'ABC' AS acronym FROM blocks WHERE kind = 'source'")
def t07_acronym_definitions(spark, sf_dir):
    """Questions, each with a definition line put before it."""
    rows = blocks(spark, sf_dir).where("kind = 'source'").withColumn("markdown", F.concat(F.lit("词（Any Big Company, ABC）\n"), "markdown"))
    return op.acronym_definitions(lines_of(rows)).select("material_id", "block_id", "acronym")


@query("SELECT conv_id AS material_id, conv_id % 3 = 0 AS overgrown FROM conversations GROUP BY conv_id")
def t20_glossary_growth(spark, sf_dir):
    """The beginning of each first question as source, and an output of three definitions, or of six for every third material."""
    rows = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("material_id")).agg(F.left(F.coalesce(F.min_by("text", "turn"), F.lit("")), F.lit(100)).alias("source"))
    n = F.when(F.col("material_id") % 3 == 0, 6).otherwise(3)
    output = F.array_join(F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.lit("term "), k, F.lit(": "), F.repeat(F.lit("x"), F.lit(200)))), "\n")
    return op.glossary_growth(rows.withColumn("output", output))


_NUMERONYMS = "n AS (SELECT doc_id AS id, 'i' || (10 + n_chars % 90) || 'n' AS token FROM documents)"


@query(f"WITH {_NUMERONYMS} SELECT id, token FROM n SEMI JOIN (SELECT DISTINCT 'i' || p_size || 'n' AS token FROM part) c USING (token) ANTI JOIN labels l ON l.doc_id = n.id")
def t22_numeronyms(spark, sf_dir):
    """Tokens like i18n, from the lengths of documents; part sizes are the catalog, reviews the declarations."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("about I"), 10 + F.col("n_chars") % 90, F.lit("N here")).alias("text"))
    known = table(spark, sf_dir, "part").select(F.concat(F.lit("i"), "p_size", F.lit("n")).alias("token")).distinct()
    token = F.regexp_extract(F.lower("text"), r"\b([a-z][0-9]{1,2}[a-z])\b", 1)
    declared = docs.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi").select("id", token.alias("token"))
    return op.numeronyms(docs, known, declared)


@query("SELECT b.item_id AS concept_id, coalesce(bool_or(regexp_matches(d.text, '(^|[^A-Za-z])' || regexp_extract(b.text, '([A-Za-z]+)', 1) || '([^A-Za-z]|$)')), false) AS anchored FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id GROUP BY b.item_id")
def t23_anchored(spark, sf_dir):
    """Whether an item's first word occurs in the document of the same number."""
    concepts = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("concept_id"), F.col("item_id").alias("source_id"), F.regexp_extract("text", "([A-Za-z]+)", 1).alias("short"))
    return op.anchored(concepts, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "text"))


@query("SELECT item_id AS name_id, CASE WHEN d.doc_id IS NULL THEN 'unsearched' WHEN regexp_matches(d.text, '(^|[^A-Za-z0-9])(?i:' || regexp_extract(b.text, '([A-Za-z]+)', 1) || ')([^A-Za-z0-9]|$)') THEN 'verified' ELSE 'ambiguous' END AS status FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id")
def t29_name_status(spark, sf_dir):
    names = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("name_id"), F.regexp_extract("text", "([A-Za-z]+)", 1).alias("name"))
    quotes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name_id"), F.col("text").alias("quote"))
    return op.name_status(names, quotes)


@query(f"WITH {OBJECTS_SQL} SELECT material_id, object_id, '{{{{source:' || object_id || '}}}}' AS marker FROM objects WHERE kind <> 'text'")
def t34_marker_unwrap(spark, sf_dir):
    from tracewell.functions.scalars import unwrapped_markers

    wrapped = F.concat(F.lit("![x]({{source:"), "object_id", F.lit("}})"))
    return objects(spark, sf_dir).where("kind <> 'text'").select("material_id", "object_id", unwrapped_markers(wrapped).alias("marker"))


@query("SELECT 0 AS tree, o_orderkey AS id, 'unknown parent' AS fault FROM orders ANTI JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey")
def t35_node_trees(spark, sf_dir):
    """Customers not in debt are roots, orders children of their customer (shifted so that ids differ)."""
    roots = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.lit(0).alias("tree"), (-F.col("c_custkey") - 1).alias("id"), F.lit(None).cast("long").alias("parent"))
    children = table(spark, sf_dir, "orders").select(F.lit(0).alias("tree"), F.col("o_orderkey").alias("id"), (-F.col("o_custkey") - 1).alias("parent"))
    return op.node_faults(roots.unionByName(children))
