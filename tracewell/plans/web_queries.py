"""Queries of page objects: parsing, classification and binding."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewell.functions.scalars import canonical_url, safe_target
from tracewell.operators import binding as bind
from tracewell.operators import classify as op
from tracewell.operators import literals
from tracewell.registry import query
from tracewell.sources.html_objects import page_objects
from tracewell.sources.model import BLOCKS_SQL, OBJECTS_SQL, blocks, objects, table

_LINKS = (
    "links AS (SELECT page_id, n, regexp_extract(tag, 'href=\"([^\"]*)\"', 1) AS target, regexp_extract(tag, '>([^<]*)</a>', 1) AS label FROM "
    "(SELECT page_id, unnest(tags) AS tag, generate_subscripts(tags, 1) AS n FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"[^\"]*\">[^<]*</a>') AS tags FROM pages)))"
)


def _pages(spark, sf_dir):
    return page_objects(table(spark, sf_dir, "pages"))


def _links(spark, sf_dir):
    return _pages(spark, sf_dir).where("kind = 'link'")


@query("SELECT page_id, 'link' AS kind, len(regexp_extract_all(html, '<a href=')) AS n FROM pages WHERE contains(html, '<a href=') UNION ALL SELECT page_id, 'heading', 1 FROM pages WHERE contains(html, '<h1>') UNION ALL SELECT page_id, 'unknown', 2 FROM pages WHERE contains(html, '<script>')")
def s08_html_objects(spark, sf_dir):
    found = _pages(spark, sf_dir).where(F.col("kind").isin("link", "heading", "unknown"))
    return found.groupBy("page_id", "kind").agg(F.count("*").alias("n"))


@query(f"WITH {_LINKS} SELECT page_id, target, label FROM links")
def s12_link_occurrences(spark, sf_dir):
    return _links(spark, sf_dir).select("page_id", "target", F.col("text").alias("label"))


@query("SELECT page_id, 2 AS metadata FROM pages WHERE contains(html, '<script>')")
def p01_inert_markup(spark, sf_dir):
    found = op.inert_markup(_pages(spark, sf_dir)).where("class = 'metadata'")
    return found.groupBy("page_id").agg(F.count("*").alias("metadata"))


@query(f"WITH {_LINKS} SELECT page_id, 'site_chrome' AS class, count(*) AS n FROM links GROUP BY page_id")
def p02_site_chrome(spark, sf_dir):
    """Links under the navigation prefix of their page."""
    rows = _pages(spark, sf_dir)
    nav = rows.where("kind = 'link'").select("page_id", F.regexp_extract("locator", r"^(.*/nav\[\d+\])", 1).alias("prefix")).where("prefix <> ''").distinct()
    found = op.under_prefix(rows.where("kind = 'link'"), nav.withColumns({"class": F.lit("site_chrome"), "priority": F.lit(1)}))
    return found.where("class is not null").groupBy("page_id", "class").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS material_id, l_linenumber || ':' || l_suppkey AS object_id, v AS visible_id FROM (SELECT *, min(CASE WHEN l_returnflag = 'N' THEN l_linenumber || ':' || l_suppkey END) OVER (PARTITION BY l_orderkey, l_partkey) AS v FROM lineitem) WHERE l_returnflag <> 'N' AND v IS NOT NULL")
def p04_duplicate_media(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("material_id"), F.col("l_partkey").alias("target"), F.concat_ws(":", "l_linenumber", "l_suppkey").alias("object_id"), (F.col("l_returnflag") == "N").alias("captured"))
    return op.duplicate_media(rows).select("material_id", "object_id", "visible_id")


@query(f"WITH {OBJECTS_SQL} SELECT material_id, object_id, CASE WHEN l.doc_id IS NULL THEN 'open' ELSE 'resolved' END AS state FROM objects LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = material_id WHERE kind IN ('table', 'formula')")
def p08_resolved_gaps(spark, sf_dir):
    gaps = objects(spark, sf_dir).where(F.col("kind").isin("table", "formula")).select("material_id", "object_id")
    proven = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("material_id")).distinct()
    left, done = op.split_gaps(gaps, proven, ["material_id"])
    return left.withColumn("state", F.lit("open")).unionByName(done.withColumn("state", F.lit("resolved")))


@query(f"WITH {_LINKS} SELECT page_id, count(*) AS decorative FROM links GROUP BY page_id")
def p09_decorative(spark, sf_dir):
    found = _pages(spark, sf_dir).where("kind = 'link'").where(op.is_decorative(F.col("kind"), F.col("text"), F.col("scope")))
    return found.groupBy("page_id").agg(F.count("*").alias("decorative"))


@query("SELECT p_partkey, CASE WHEN greatest(p_size, p_size * 0.5) < 24 AND p_type = 'SMALL' THEN 'table-symbol' WHEN p_size < 24 THEN 'inline-component' ELSE 'source-image' END AS role FROM part")
def p11_presentation(spark, sf_dir):
    boxes = F.array(F.struct(F.col("p_size").cast("double").alias("width"), (F.col("p_size") * 0.5).alias("height")))
    kind = F.when(F.col("p_type") == "SMALL", "table").otherwise("text")
    return table(spark, sf_dir, "part").select("p_partkey", op.presentation(boxes, kind).alias("role"))


@query(f"WITH {OBJECTS_SQL} SELECT material_id, object_id, CASE WHEN l.quality = 0 THEN 'exclude' WHEN l.toxic = 1 THEN 'reference' ELSE 'body' END AS usage FROM objects LEFT JOIN labels l ON l.doc_id = material_id WHERE kind = 'table'")
def p12_effective_usage(spark, sf_dir):
    rows = objects(spark, sf_dir).where("kind = 'table'").select("material_id", "object_id", "kind")
    said = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("material_id"), F.when(F.col("quality") == 0, "exclude").when(F.col("toxic") == 1, "reference").alias("choice"))
    choices = rows.select("material_id", "object_id").join(said, "material_id").where("choice is not null")
    return op.effective_usage(rows, choices).select("material_id", "object_id", "usage")


@query(f"WITH {_LINKS} SELECT page_id, 'navigation' AS role, count(*) AS n FROM links GROUP BY page_id")
def p13_link_roles(spark, sf_dir):
    return op.link_roles(_links(spark, sf_dir)).groupBy("page_id", "role").agg(F.count("*").alias("n"))


@query(f"WITH {OBJECTS_SQL}, h AS (SELECT *, last_value(CASE WHEN kind = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY material_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS head FROM objects) SELECT material_id, object_id, coalesce(regexp_matches(head, '(?i)^\\s*(see also|references|further reading|参考资料)'), false) AND kind <> 'heading' AS label_only FROM h WHERE kind <> 'text'")
def p14_label_scope(spark, sf_dir):
    return op.label_scope(objects(spark, sf_dir)).where("kind <> 'text'").select("material_id", "object_id", "label_only")


@query(f"WITH {OBJECTS_SQL} SELECT material_id, object_id FROM objects ANTI JOIN labels l ON l.doc_id = material_id")
def p17_pending_obligations(spark, sf_dir):
    accepted = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("material_id")).distinct()
    return objects(spark, sf_dir).join(accepted, "material_id", "left_anti").select("material_id", "object_id")


@query("SELECT page_id, regexp_matches(url, '^https?://[^/?#@\\s]+([/?#]\\S*)?$') AS safe FROM pages")
def p18_safe_targets(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", safe_target(F.col("url")).alias("safe"))


_HOSTED = "hosted AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, url FROM pages)"


@query(
    f"WITH {_LINKS}, {_HOSTED}, l AS (SELECT host, target AS original, 'https://' || host || target AS full_target FROM links JOIN hosted USING (page_id)) "
    "SELECT host, original, min(full_target) AS target FROM l GROUP BY host, original HAVING count(DISTINCT full_target) = 1 AND bool_and(regexp_matches(full_target, '^https?://[^/?#@\\s]+([/?#]\\S*)?$'))"
)
def j01_link_targets(spark, sf_dir):
    """Relative links of a host and the one target that all its pages agree on."""
    return bind.link_targets(_hosted_links(spark, sf_dir)).select(F.col("material_id").alias("host"), "original", "target")


def _hosted_links(spark, sf_dir):
    hosts = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"))
    return _links(spark, sf_dir).hint("merge").join(hosts, "page_id").select("page_id", F.col("host").alias("material_id"), F.col("target").alias("original"), F.concat(F.lit("https://"), "host", "target").alias("target"))


@query(f"WITH {_LINKS}, {_HOSTED} SELECT page_id, target AS original, CASE WHEN regexp_matches('https://' || host || target, '^https?://[^/?#@\\s]+([/?#]\\S*)?$') THEN 'https://' || host || target ELSE target END AS restored FROM links JOIN hosted USING (page_id)")
def j02_restored_links(spark, sf_dir):
    rows = _hosted_links(spark, sf_dir)
    return bind.restored_links(rows.drop("target"), bind.link_targets(rows)).select("page_id", "original", "restored")


@query(
    "WITH w AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS k FROM orders WHERE o_orderstatus = 'O'), f AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS k FROM orders WHERE o_orderstatus = 'F') "
    "SELECT w.o_orderkey AS wanted, f.o_orderkey AS object_id, f.o_orderkey IS NOT NULL AS ready FROM w LEFT JOIN f USING (o_custkey, o_orderpriority, k)"
)
def j03_kth_binding(spark, sf_dir):
    """The k-th open order of a customer and priority binds the k-th finished one."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus", F.col("o_orderkey").alias("ord"))
    found = rows.where("o_orderstatus = 'F'").withColumn("object_id", F.col("ord"))
    return bind.kth_binding(rows.where("o_orderstatus = 'O'"), found, ["o_custkey", "o_orderpriority"]).select(F.col("ord").alias("wanted"), "object_id", "ready")


_RECTS = "rect AS (SELECT l_orderkey AS material_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS id, l_linenumber::DOUBLE AS x, (l_suppkey % 5)::DOUBLE AS y, l_quantity AS width, ceil(l_tax * 100 + l_quantity / 2) AS height FROM lineitem)"


@query(
    f"WITH {_RECTS}, m AS (SELECT i.material_id, i.id, o.id AS container, count(*) OVER (PARTITION BY i.material_id, i.id) AS n FROM rect i JOIN rect o USING (material_id) WHERE o.x <= i.x AND o.y <= i.y AND o.x + o.width >= i.x + i.width AND o.y + o.height >= i.y + i.height AND o.id <> i.id) "
    "SELECT material_id, id, CASE WHEN n = 1 THEN min(container) END AS container, CASE WHEN n > 1 THEN 'ambiguous' END AS reason FROM m GROUP BY material_id, id, n"
)
def j05_containment(spark, sf_dir):
    """Rectangles drawn from order lines: the single one that contains another, else ambiguous."""
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("material_id"), nth.cast("long").alias("id"), F.col("l_linenumber").cast("double").alias("x"), (F.col("l_suppkey") % 5).cast("double").alias("y"),
        F.col("l_quantity").alias("width"), F.ceil(F.col("l_tax") * 100 + F.col("l_quantity") / 2).cast("double").alias("height"), F.array().cast("array<long>").alias("ancestry"),
    )
    return bind.contained_in(rows, rows)


@query(
    f"WITH {OBJECTS_SQL}, c AS (SELECT *, last_value(CASE WHEN kind IN ('text', 'heading') THEN text END IGNORE NULLS) OVER w AS ctx, last_value(CASE WHEN kind = 'heading' THEN text END IGNORE NULLS) OVER w AS hd FROM objects WINDOW w AS (PARTITION BY material_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) "
    "SELECT material_id, object_id, sha256(coalesce(left(ctx, 1200), '')) AS context_sha, left(hd, 160) AS heading FROM c WHERE kind = 'table'"
)
def j07_sentence_context(spark, sf_dir):
    """The backward as-of context of every table line, which stands for a link here."""
    rows = objects(spark, sf_dir).withColumn("kind", F.when(F.col("kind") == "table", "link").otherwise(F.col("kind"))).withColumn("parent_id", F.lit(None).cast("string"))
    return bind.sentence_context(rows).select("material_id", "object_id", F.sha2(F.coalesce("context", F.lit("")), 256).alias("context_sha"), "heading")


@query(f"WITH {BLOCKS_SQL}, {OBJECTS_SQL} SELECT b.material_id, b.block_id, o.locator, 'doc-' || o.material_id AS original FROM blocks b JOIN objects o ON o.material_id = b.material_id AND o.object_id = printf('src-%05d', b.ord + 1)")
def j08_block_locations(spark, sf_dir):
    rows = blocks(spark, sf_dir).withColumn("object_id", F.format_string("src-%05d", F.col("ord") + 1)).drop("ord", "kind")
    return rows.join(objects(spark, sf_dir), ["material_id", "object_id"]).select("material_id", "block_id", "locator", F.regexp_extract("locator", "^([^/]+)", 1).alias("original"))


_WORDS = "list_distinct(regexp_extract_all(lower({}), '[a-z]+'))"


@query(
    "WITH f AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'), b AS (SELECT event_id AS block, user_id, ts FROM events WHERE event_type = 'purchase'), "
    "m AS (SELECT f.event_id, b.block, row_number() OVER (PARTITION BY f.event_id ORDER BY abs(b.block - f.event_id) NULLS LAST, (b.block < f.event_id)::INT, b.block) AS nth FROM f LEFT JOIN b USING (user_id)) SELECT event_id AS finding_id, block AS block_id, block IS NULL AS is_note FROM m WHERE nth = 1"
)
def j13_retarget(spark, sf_dir):
    """Errors move to the nearest purchase of the same user, by event number."""
    events = table(spark, sf_dir, "events")
    findings = events.where("event_type = 'error'").select(F.lit(0).alias("material_id"), F.col("user_id").alias("source_id"), F.col("event_id").alias("finding_id"), F.col("event_id").alias("ord"))
    targets = events.where("event_type = 'purchase'").select(F.lit(0).alias("material_id"), F.col("user_id").alias("source_id"), F.col("event_id").alias("block_id"), F.col("event_id").alias("ord"))
    return bind.nearest_block(findings, targets).select("finding_id", "block_id", "is_note")


@query(f"WITH {BLOCKS_SQL}, p AS (SELECT material_id, block_id, left(markdown, 30) AS quote FROM blocks WHERE kind = 'source'), e AS (SELECT material_id, block_id FROM blocks WHERE length(markdown) > 400) SELECT p.material_id, p.block_id, p.quote FROM p ANTI JOIN e USING (material_id, block_id)")
def j14_carried_findings(spark, sf_dir):
    """Findings on short questions survive edits of the long ones."""
    rows = blocks(spark, sf_dir)
    previous = rows.where("kind = 'source'").select("material_id", "block_id", F.left("markdown", F.lit(30)).alias("quote"))
    edited = rows.where(F.char_length("markdown") > 400)
    return bind.carried(previous, previous.limit(0), edited, rows).select("material_id", "block_id", "quote")


@query("WITH t AS (SELECT DISTINCT regexp_extract(lower(text), '([a-z]+)', 1) AS trigger FROM benchmark) SELECT d.doc_id, t.trigger FROM documents d JOIN t ON regexp_matches(lower(d.text), '(^|[^a-z])' || t.trigger || '([^a-z]|$)')")
def j15_glossary_triggers(spark, sf_dir):
    """Terms that occur with no letter on either side."""
    lower = F.lower(F.replace("text", F.lit("İ"), F.lit("i")))  # one letter, as in the SQL
    terms = table(spark, sf_dir, "benchmark").select(F.regexp_extract(lower, "([a-z]+)", 1).alias("trigger"))
    docs = table(spark, sf_dir, "documents").select("doc_id", lower.alias("text"))
    return literals.held_words(docs, terms, ["doc_id"], word="trigger")


@query(
    "WITH p AS (SELECT doc_id, unnest(string_split(text, 'the ')) AS s, generate_subscripts(string_split(text, 'the '), 1) AS k, len(string_split(text, 'the ')) AS n FROM documents), "
    "o AS (SELECT doc_id, k, n, sum(length(s)) OVER (PARTITION BY doc_id ORDER BY k) + 4 * (k - 1) AS start FROM p), sp AS (SELECT doc_id, greatest(start - 50, 0) AS a, start + 54 AS b FROM o WHERE k < n), "
    "m AS (SELECT *, max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sp), "
    "i AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m) "
    'SELECT doc_id, min(a)::INT AS start, max(b)::INT AS "end" FROM i GROUP BY doc_id, island'
)
def j17_merged_excerpts(spark, sf_dir):
    """Spans of 100 characters around a word, merged where they overlap."""
    from tracewell.operators.text import merged_spans, occurrences

    found = occurrences(table(spark, sf_dir, "documents"), ["doc_id"], "text", F.lit("the "))
    return merged_spans(found.select("doc_id", F.greatest(F.col("start") - 50, F.lit(0)).alias("start"), (F.col("end") + 50).alias("end")), ["doc_id"])


@query("SELECT d.doc_id, b.item_id, (length(d.text) - length(replace(d.text, b.text, ''))) / length(b.text) = 1 AS unique_match FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def j18_quote_resolution(spark, sf_dir):
    """The literal path: quotes that occur exactly once in their source resolve."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    met = literals.held(table(spark, sf_dir, "documents").select("doc_id", "text"), items, ["doc_id"], literal="quote").hint("merge").join(items, "quote")
    hits = (F.char_length("text") - F.char_length(F.replace("text", F.col("quote"), F.lit("")))) / F.char_length("quote")
    return met.select("doc_id", "item_id", (hits == 1).alias("unique_match"))


@query("SELECT d.doc_id, b.item_id, CASE WHEN (length(d.text) - length(replace(d.text, b.text, ''))) / length(b.text) = 1 THEN sha256(b.text) END AS quote_sha FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def j18_tolerant_quotes(spark, sf_dir):
    """Passages quoted with other white space resolve to the exact bytes of their source, if to one place."""
    from tracewell.functions.quotes import source_quote

    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    met = literals.held(table(spark, sf_dir, "documents").select("doc_id", "text"), items, ["doc_id"], literal="item").hint("merge").join(items, "item")
    spread = F.regexp_replace("item", r"\s+", "  ")
    quote = source_quote(spread, "text")
    tail = F.regexp_extract("item", r"([^\p{L}\p{N}]*)$", 1)
    return met.select("doc_id", "item_id", F.sha2(F.when(quote.isNotNull(), F.concat(quote, tail)), 256).alias("quote_sha"))


@query("SELECT d.doc_id, sha256(d.text) <> sha256(c.text) AND c.text <> '' AS is_new FROM documents d JOIN conversations c ON c.conv_id = d.doc_id AND c.turn = 1")
def j22_not_a_fallback(spark, sf_dir):
    delivered = table(spark, sf_dir, "conversations").where("turn = 1").select(F.col("conv_id").alias("doc_id"), F.col("text").alias("output"))
    fresh = (F.sha2("text", 256) != F.sha2("output", 256)) & (F.col("output") != "")
    return table(spark, sf_dir, "documents").join(delivered, "doc_id").select("doc_id", fresh.alias("is_new"))


@query("SELECT l_orderkey AS source, count(*) AS placements, bool_and(p.p_partkey IS NOT NULL AND p.p_size >= l_quantity) AS covered FROM lineitem LEFT JOIN part p ON p_partkey = l_partkey GROUP BY l_orderkey")
def j23_page_coverage(spark, sf_dir):
    """Every placement lies on a known page that is large enough."""
    pages = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    fits = F.coalesce(F.col("p_size") >= F.col("l_quantity"), F.lit(False))
    return table(spark, sf_dir, "lineitem").join(pages, "l_partkey", "left").groupBy(F.col("l_orderkey").alias("source")).agg(F.count("*").alias("placements"), F.bool_and(fits).alias("covered"))


@query("SELECT DISTINCT b.item_id, d.source AS scope FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def j25_allowed_evidence(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    met = literals.held(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), items, ["doc_id"], literal="quote").select("quote", "source").distinct()
    return met.hint("merge").join(items, "quote").select("item_id", F.col("source").alias("scope")).distinct()


