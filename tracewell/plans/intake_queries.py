"""Queries of the intake operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import intake as op
from tracewell.registry import query
from tracewell.sources.model import BLOCKS_SQL, OBJECTS_SQL, OBLIGATIONS_SQL, blocks, line_objects, objects, obligations, table


def _files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("material_id"), "source", F.concat(F.lit("doc-"), "doc_id", F.lit(".txt")).alias("name"), F.col("text").alias("content"))


def _identified(spark, sf_dir):
    return op.content_identity(_files(spark, sf_dir))


_FILES = "files AS (SELECT doc_id AS material_id, source, 'doc-' || doc_id || '.txt' AS name, text AS content, octet_length(encode(text)) AS size, 'text/plain' AS mime, sha256(text) AS sha256 FROM documents)"


@query(f"WITH {_FILES} SELECT material_id, name, size, mime, sha256 FROM files")
def s01_corpus_scan(spark, sf_dir):
    return _identified(spark, sf_dir).select("material_id", "name", "size", "mime", "sha256")


@query(f"WITH {_FILES} SELECT sha256, min(name) AS name, max(size) AS size, count(*) AS occurrences FROM files GROUP BY sha256")
def s02_resource_pool(spark, sf_dir):
    return op.resource_pool(_identified(spark, sf_dir))


@query(
    "WITH k AS (SELECT DISTINCT sha256(text) AS key FROM documents UNION SELECT DISTINCT sha256(text) FROM conversations), "
    "c AS (SELECT DISTINCT sha256(text) AS key FROM documents) "
    "SELECT key, CASE WHEN c.key IS NULL THEN 'missing' ELSE 'verified' END AS status FROM k LEFT JOIN c USING (key)"
)
def s03_byte_verification(spark, sf_dir):
    docs, turns = table(spark, sf_dir, "documents"), table(spark, sf_dir, "conversations")
    registry = docs.select(F.sha2("text", 256).alias("key")).unionByName(turns.select(F.sha2("text", 256).alias("key"))).distinct()
    contents = docs.select(F.sha2("text", 256).alias("key"), F.col("text").alias("content")).dropDuplicates(["key"])
    return op.verify_bytes(registry, contents)


@query(
    "WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*', '') AS path FROM pages) SELECT page_id, CASE WHEN path IS NULL OR path = '' THEN 'empty' WHEN starts_with(path, '/') THEN 'absolute' END AS reject_reason, "
    "CASE WHEN substr(path, 2) = '' THEN 'empty' WHEN list_contains(string_split(substr(path, 2), '/'), '') THEN 'empty part' END AS relative_reason FROM p"
)
def s04_unsafe_paths(spark, sf_dir):
    paths = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://[^/]*", "").alias("path"))
    relative = F.substring("path", 2, 1 << 30)
    return paths.select("page_id", op.unsafe_path(F.col("path")).alias("reject_reason"), op.unsafe_path(relative).alias("relative_reason"))


@query(
    f"WITH {_FILES}, {OBJECTS_SQL}, n AS (SELECT material_id, count(*) AS objects FROM objects GROUP BY 1) "
    "SELECT material_id, max(size) AS largest, sum(size)::BIGINT AS expanded, coalesce(max(objects), 0) AS objects, max(size) <= 25000000 AS file_ok, sum(size) <= 100000000 AS expanded_ok, "
    "coalesce(max(objects), 0) <= 5000 AS objects_ok, count(*) = count(DISTINCT name) AS names_ok FROM files LEFT JOIN n USING (material_id) GROUP BY material_id"
)
def s05_limit_report(spark, sf_dir):
    return op.limit_report(_identified(spark, sf_dir), objects(spark, sf_dir))


@query(f"WITH {OBJECTS_SQL} SELECT material_id, object_id, kind, ord, locator, sha256(text) AS text_sha256 FROM objects")
def s06_segmentation(spark, sf_dir):
    return objects(spark, sf_dir).select("material_id", "object_id", "kind", "ord", "locator", F.sha2("text", 256).alias("text_sha256"))


@query(f"WITH {OBLIGATIONS_SQL} SELECT material_id, obligation_id, object_id, sha256(statement) AS statement_sha256, array_to_string(quantities, ';') AS quantities FROM obligations")
def s13_obligations(spark, sf_dir):
    return obligations(objects(spark, sf_dir)).select("material_id", "obligation_id", "object_id", F.sha2("statement", 256).alias("statement_sha256"), F.array_join("quantities", ";").alias("quantities"))


@query(
    f"WITH {OBJECTS_SQL} SELECT material_id, object_id, locator, 'unparsed table' AS reason FROM objects WHERE kind = 'table' "
    "UNION ALL SELECT material_id, object_id, locator, 'unrendered formula' FROM objects WHERE kind = 'formula' "
    "UNION ALL SELECT doc_id, NULL, 'doc-' || doc_id, 'empty document' FROM documents WHERE text IS NULL OR trim(text) = ''"
)
def s14_gap_ledger(spark, sf_dir):
    objs = objects(spark, sf_dir)
    reason = F.when(F.col("kind") == "table", "unparsed table").when(F.col("kind") == "formula", "unrendered formula")
    marked = objs.where(F.col("kind").isin("table", "formula")).select("material_id", "object_id", "locator", reason.alias("reason"))
    empty = table(spark, sf_dir, "documents").where("text is null or trim(text) = ''")
    none = empty.select(F.col("doc_id").alias("material_id"), F.lit(None).cast("string").alias("object_id"), F.concat(F.lit("doc-"), "doc_id").alias("locator"), F.lit("empty document").alias("reason"))
    return marked.unionByName(none)


@query(
    "WITH m AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://', '') AS path, sha256(html) AS sha FROM pages) "
    "SELECT page_id, path, count(*) OVER (PARTITION BY path) AS declared, count(*) OVER (PARTITION BY path, sha) AS agreeing, "
    "CASE WHEN count(*) OVER (PARTITION BY path) > 1 THEN 'duplicate url' ELSE 'accepted' END AS status FROM m"
)
def s15_source_manifest(spark, sf_dir):
    from pyspark.sql import Window

    path = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^https?://", "")
    rows = table(spark, sf_dir, "pages").select("page_id", path.alias("path"), F.sha2("html", 256).alias("sha"))
    declared = F.count("*").over(Window.partitionBy("path"))
    agreeing = F.count("*").over(Window.partitionBy("path", "sha"))
    return rows.select("page_id", "path", declared.alias("declared"), agreeing.alias("agreeing"), F.when(declared > 1, "duplicate url").otherwise("accepted").alias("status"))


@query(
    f"WITH {OBJECTS_SQL} SELECT material_id, object_id, scope FROM (SELECT material_id, object_id, 'doc-' || material_id AS scope FROM objects "
    "UNION ALL SELECT conv_id, 'append-1-' || printf('src-%05d', turn + 1), 'append-1-conv-' || conv_id FROM conversations)"
)
def s16_append_namespaced(spark, sf_dir):
    own = objects(spark, sf_dir).select("material_id", "object_id", F.concat(F.lit("doc-"), "material_id").alias("scope"))
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("material_id"), F.format_string("src-%05d", F.col("turn") + 1).alias("object_id"), F.concat(F.lit("conv-"), "conv_id").alias("scope"))
    return op.append_namespaced(own, turns, "append-1-")


@query(
    f"WITH {OBLIGATIONS_SQL}, adds AS (SELECT conv_id AS material_id, 'obl-' || printf('src-%05d', turn * 3 + 1) AS obligation_id, printf('src-%05d', turn + 1) AS object_id, coalesce(text, '') AS statement FROM conversations) "
    "SELECT a.material_id, a.obligation_id, a.object_id, CASE WHEN o.obligation_id IS NOT NULL OR count(*) OVER (PARTITION BY a.material_id, a.obligation_id) > 1 THEN 'id taken' WHEN b.object_id IS NULL THEN 'object unknown' WHEN trim(a.statement) = '' THEN 'blank' END AS reason "
    "FROM adds a LEFT JOIN obligations o USING (material_id, obligation_id) LEFT JOIN objects b ON a.material_id = b.material_id AND a.object_id = b.object_id"
)
def s17_append_obligations(spark, sf_dir):
    objs = objects(spark, sf_dir)
    turns = table(spark, sf_dir, "conversations")
    adds = turns.select(F.col("conv_id").alias("material_id"), F.concat(F.lit("obl-"), F.format_string("src-%05d", F.col("turn") * 3 + 1)).alias("obligation_id"), F.format_string("src-%05d", F.col("turn") + 1).alias("object_id"), F.coalesce("text", F.lit("")).alias("statement"))
    return op.append_obligations(obligations(objs), objs, adds)


@query(f"WITH {OBJECTS_SQL} SELECT material_id, sha256(string_agg(object_id || ':' || kind || ':' || text, chr(10) ORDER BY ord)) AS digest FROM objects GROUP BY material_id")
def s18_inventory_digest(spark, sf_dir):
    return op.ordered_digest(objects(spark, sf_dir), F.concat_ws(":", "object_id", "kind", "text"), F.col("ord"))


@query(f"WITH {OBJECTS_SQL} SELECT material_id, sha256(string_agg(kind || ':' || CASE WHEN kind IN ('table', 'formula') THEN '' ELSE text END, chr(10) ORDER BY ord)) AS digest FROM objects GROUP BY material_id")
def s19_material_signature(spark, sf_dir):
    authored = F.when(F.col("kind").isin("table", "formula"), F.lit("")).otherwise(F.col("text"))
    return op.ordered_digest(objects(spark, sf_dir), F.concat_ws(":", "kind", authored), F.col("ord"))


@query(
    "WITH r AS (SELECT page_id // 5 AS id, page_id, url, row_number() OVER (PARTITION BY page_id // 5 ORDER BY page_id) AS rank FROM pages) "
    "SELECT id, rank::INT AS rank, CASE page_id % 3 WHEN 2 THEN '' ELSE 't' || page_id END AS title, url, CASE page_id % 4 WHEN 0 THEN 's' || page_id WHEN 1 THEN 'a b' ELSE '' END AS snippet FROM r WHERE page_id % 7 <> 6 AND regexp_matches(url, '^https?://')"
)
def s20_result_normalisation(spark, sf_dir):
    """Answers of five pages each, their results under one of five names, in an object of results, or bare; every seventh result has no URL."""
    from tracewell.sources.nested import search_results

    k, page = F.col("page_id"), F.col("page_id").cast("string")
    url = F.when(k % 7 == 6, "none").otherwise(F.col("url"))
    no = lambda keep, value: F.when(keep, value)
    location = F.struct(F.struct(no(k % 6 == 4, url).alias("homepage_url")).alias("source"), no(k % 6 == 3, url).alias("landing_page_url"))
    row = F.struct(
        no(k % 6 == 0, url).alias("url"), no(k % 6 == 1, url).alias("link"), no(k % 6 == 2, url).alias("href"), location.alias("primary_location"), no(k % 6 == 5, url).alias("id"),
        no(k % 3 == 0, F.concat(F.lit("t"), page)).alias("title"), no(k % 3 == 1, F.concat(F.lit("t"), page)).alias("display_name"),
        no(k % 4 == 0, F.concat(F.lit("s"), page)).alias("description"), no(k % 4 == 1, F.array(F.lit("a"), F.lit("b"))).alias("excerpts"),
    )
    made = table(spark, sf_dir, "pages").select((k - k % 5).alias("first"), F.struct("page_id", F.to_json(row).alias("row")).alias("r"))
    held = made.groupBy("first").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["row"]), ",").alias("rows"))
    shapes = ('{"results":[%]}', '{"items":{"results":[%]}}', '{"other":[1],"matches":[%]}', '{"data":"x","works":[%]}', "[%]", '{"items":null,"data":{"results":[%]}}')
    shape = F.element_at(F.array(*map(F.lit, shapes)), ((F.col("first") / 5).cast("int") % len(shapes) + 1).cast("int"))
    return search_results(held.select((F.col("first") / 5).cast("long").alias("id"), F.replace(shape, F.lit("%"), F.col("rows")).alias("body")))


@query(
    "WITH i AS (SELECT page_id, regexp_replace(url, '#.*$', '') || '|' || sha256(html) AS source_key FROM pages) "
    "SELECT page_id, source_key, count(*) OVER (PARTITION BY source_key) AS n FROM i"
)
def s21_manifest_identity(spark, sf_dir):
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("|"), F.sha2("html", 256)).alias("source_key"))
    return rows.withColumn("n", F.count("*").over(Window.partitionBy("source_key")))


@query(
    "WITH w AS (SELECT doc_id AS id, sha256(text) AS want FROM documents), h AS (SELECT doc_id AS id, sha256(trim(text)) AS have FROM documents JOIN labels USING (doc_id)) "
    "SELECT id, CASE WHEN have IS NULL THEN 'failed' WHEN want IS NULL THEN 'downloaded' WHEN want = have THEN 'existing' ELSE 'different_source_version' END AS status FROM w FULL JOIN h USING (id)"
)
def s22_version_check(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    read_again = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id").select(F.col("doc_id").alias("id"), F.sha2(F.trim("text"), 256).alias("sha256"))
    return op.version_check(docs.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("sha256")), read_again)


@query(
    f"WITH {OBJECTS_SQL} SELECT material_id, sha256(string_agg(CASE kind WHEN 'text' THEN text WHEN 'heading' THEN '# ' || text ELSE '{{{{source:' || object_id || '}}}}' END, chr(10) || chr(10) ORDER BY ord)) AS text_sha256 FROM objects GROUP BY material_id"
)
def s23_source_text(spark, sf_dir):
    return op.source_text(objects(spark, sf_dir)).select("material_id", F.sha2("source_text", 256).alias("text_sha256"))


@query(
    f"WITH {_FILES}, r AS (SELECT source AS material, sha256, name, size, row_number() OVER (PARTITION BY source, sha256 ORDER BY size, name) AS nth FROM files) "
    "SELECT material, sha256, name, size FROM r WHERE nth = 1"
)
def s24_handoff_attachments(spark, sf_dir):
    rows = _identified(spark, sf_dir).withColumn("material_id", F.col("source"))
    return op.handoff(rows, F.col("size")).select(F.col("material_id").alias("material"), "sha256", "name", "size")


@query(
    f"WITH {BLOCKS_SQL}, ok AS (SELECT material_id FROM blocks GROUP BY material_id HAVING bool_and(trim(markdown) <> '')) "
    "SELECT material_id, count(*) AS blocks, sha256(string_agg(markdown, chr(10) || chr(10) ORDER BY ord) || chr(10)) AS digest FROM blocks SEMI JOIN ok USING (material_id) GROUP BY material_id"
)
def s25_package_receipts(spark, sf_dir):
    from tracewell.operators.text import canonical_text

    rows = blocks(spark, sf_dir)
    passed = rows.groupBy("material_id").agg(F.bool_and(F.trim("markdown") != "").alias("ok")).where("ok").select("material_id")
    kept = rows.join(passed, "material_id", "left_semi")
    return canonical_text(kept).select("material_id", "blocks", F.sha2("text", 256).alias("digest"))


@query(f"WITH {OBJECTS_SQL} SELECT material_id, object_id, kind, left(text, 180) AS label, locator FROM objects WHERE kind <> 'text'")
def s26_resource_table(spark, sf_dir):
    return objects(spark, sf_dir).where("kind <> 'text'").select("material_id", "object_id", "kind", F.left("text", F.lit(180)).alias("label"), "locator")


@query(
    f"WITH {OBLIGATIONS_SQL}, missing AS (SELECT o.* FROM objects o ANTI JOIN labels l ON o.material_id = l.doc_id) "
    "SELECT d.source, d.lang, count(*) AS omitted, count(DISTINCT m.material_id) AS materials, sum(len(b.quantities))::BIGINT AS quantities, grouping(d.source, d.lang)::INT AS level "
    "FROM missing m JOIN obligations b USING (material_id, object_id) JOIN documents d ON d.doc_id = m.material_id GROUP BY ROLLUP (d.source, d.lang)"
)
def a12_coverage_report(spark, sf_dir):
    """Flagship: obligations of unassessed documents, by source and language."""
    docs = table(spark, sf_dir, "documents")
    assessed = table(spark, sf_dir, "labels").select("doc_id")
    omitted = obligations(line_objects(docs.join(assessed, "doc_id", "left_anti")))
    places = docs.select(F.col("doc_id").alias("material_id"), "source", "lang")
    met = omitted.select("material_id", F.size("quantities").alias("q")).join(places, "material_id")
    return met.rollup("source", "lang").agg(
        F.count("*").alias("omitted"), F.count_distinct("material_id").alias("materials"), F.sum("q").cast("long").alias("quantities"), F.grouping_id("source", "lang").cast("int").alias("level")
    )
