"""Queries of the coverage and audit rules.

The draft of a document is its conversation of the same number: turn t places line t of the
document and covers its obligation, and quotes the first 40 characters of the turn.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import coverage as op
from tracewell.registry import query
from tracewell.sources.model import BLOCKS_SQL, OBJECTS_SQL, OBLIGATIONS_SQL, blocks, objects, obligations, table

_MODEL = f"{OBLIGATIONS_SQL}, {BLOCKS_SQL}, placed AS (SELECT material_id, block_id, printf('src-%05d', ord + 1) AS object_id, 'obl-' || printf('src-%05d', ord + 1) AS obligation_id, left(markdown, 40) AS quote FROM blocks)"
_V = "SELECT material_id, '{}' AS code, {} AS block_id, {} AS object_id, {} AS obligation_id"


def _v(code, block="NULL::VARCHAR", obj="NULL::VARCHAR", obl="NULL::VARCHAR"):
    return _V.format(code, block, obj, obl)


def _placed(spark, sf_dir):
    number = F.format_string("src-%05d", F.col("ord") + 1)
    return blocks(spark, sf_dir).select("material_id", "block_id", number.alias("object_id"), F.concat(F.lit("obl-"), number).alias("obligation_id"), F.left("markdown", F.lit(40)).alias("quote"))


def _drafted(spark, sf_dir):
    """Objects of the materials that have a draft."""
    drafts = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id")).distinct()
    from tracewell.sources.model import line_objects

    return line_objects(table(spark, sf_dir, "documents").join(drafts, "doc_id", "left_semi"))


_DRAFTED = "drafted AS (SELECT o.* FROM objects o SEMI JOIN blocks b ON o.material_id = b.material_id)"


@query("SELECT doc_id AS material_id, 'unfrozen' AS code, NULL::VARCHAR AS block_id, NULL::VARCHAR AS object_id, NULL::VARCHAR AS obligation_id FROM documents d ANTI JOIN labels l USING (doc_id)")
def a01_unfrozen(spark, sf_dir):
    """Inventories without a review are not frozen."""
    frozen = table(spark, sf_dir, "labels").select("doc_id").distinct()
    return op.violation(table(spark, sf_dir, "documents").join(frozen, "doc_id", "left_anti").select(F.col("doc_id").alias("material_id")), "unfrozen")


@query(f"WITH {BLOCKS_SQL} {_v('shape', 'block_id')} FROM blocks WHERE kind NOT IN ('source', 'explanation')")
def a02_draft_shape(spark, sf_dir):
    return op.wrong_shape(blocks(spark, sf_dir), ["source", "explanation"])


@query("SELECT p.page_id AS material_id, 'resource_missing' AS code, NULL::VARCHAR AS block_id, p.page_id::VARCHAR AS object_id, NULL::VARCHAR AS obligation_id FROM pages p ANTI JOIN benchmark b ON p.page_id = b.item_id")
def a03_resource_missing(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("material_id"), F.col("page_id").alias("object_id"))
    return op.unknown(pages, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("object_id")), ["object_id"], "resource_missing")


@query(f"WITH {_MODEL} {_v('embedded', 'p.block_id', 'p.object_id')} FROM (SELECT p.material_id, p.block_id, p.object_id FROM placed p JOIN objects o USING (material_id, object_id) JOIN blocks b USING (material_id, block_id) WHERE NOT contains(b.markdown, o.text)) p")
def a04_embedded_bytes(spark, sf_dir):
    """Placed objects whose text is not literally in the block."""
    met = _placed(spark, sf_dir).join(objects(spark, sf_dir), ["material_id", "object_id"]).join(blocks(spark, sf_dir).select("material_id", "block_id", "markdown"), ["material_id", "block_id"])
    return op.violation(met.where(~F.contains("markdown", F.col("text"))).drop("obligation_id"), "embedded")


@query("SELECT l_orderkey AS material_id, 'duplicate' AS code, l_linenumber::VARCHAR AS block_id, NULL::VARCHAR AS object_id, NULL::VARCHAR AS obligation_id FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def a05_duplicate_block(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("material_id"), F.col("l_linenumber").alias("block_id"))
    return op.duplicated(rows, ["material_id", "block_id"], "duplicate")


@query("SELECT o_orderkey AS material_id, 'unit' AS code, o_custkey::VARCHAR AS block_id, NULL::VARCHAR AS object_id, NULL::VARCHAR AS obligation_id FROM orders ANTI JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def a06_unknown_unit(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("material_id"), F.col("o_custkey").alias("block_id"))
    known = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("block_id"))
    return op.unknown(rows, known, ["block_id"], "unit")


@query(f"WITH {_MODEL} {_v('empty', 'block_id')} FROM blocks b WHERE (ord % 5 = 0 OR trim(markdown) = '') AND NOT EXISTS (SELECT 1 FROM placed p SEMI JOIN objects o USING (material_id, object_id) WHERE p.material_id = b.material_id AND p.block_id = b.block_id)")
def a07_empty_block(spark, sf_dir):
    """Drafts in which every fifth turn was left blank."""
    real = _placed(spark, sf_dir).join(objects(spark, sf_dir).select("material_id", "object_id"), ["material_id", "object_id"], "left_semi")
    rows = blocks(spark, sf_dir).withColumn("markdown", F.when(F.col("ord") % 5 == 0, " ").otherwise(F.col("markdown")))
    return op.empty_blocks(rows, real)


@query(f"WITH {_MODEL} {_v('unknown_obligation', 'block_id', 'object_id', 'obligation_id')} FROM placed ANTI JOIN obligations USING (material_id, obligation_id)")
def a08_unknown_obligation(spark, sf_dir):
    return op.unknown(_placed(spark, sf_dir), obligations(objects(spark, sf_dir, hint=None)), ["material_id", "obligation_id"], "unknown_obligation", few=True)


@query(
    f"WITH {_MODEL}, covers AS (SELECT material_id, block_id, 'obl-' || printf('src-%05d', ord + 1 + ord % 2) AS obligation_id FROM blocks) "
    f"{_v('unmapped', 'block_id', 'object_id', 'obligation_id')} FROM (SELECT c.material_id, c.block_id, c.obligation_id, o.object_id FROM covers c JOIN obligations o USING (material_id, obligation_id)) x ANTI JOIN placed p USING (material_id, block_id, object_id)"
)
def a09_unmapped_obligation(spark, sf_dir):
    """A draft whose odd turns cover the obligation after the object that they place."""
    covers = blocks(spark, sf_dir).select("material_id", "block_id", F.concat(F.lit("obl-"), F.format_string("src-%05d", F.col("ord") + 1 + F.col("ord") % 2)).alias("obligation_id"))
    return op.unmapped(covers, obligations(objects(spark, sf_dir)), _placed(spark, sf_dir))


@query(f"WITH {_MODEL} {_v('quote', 'block_id', 'object_id')} FROM placed LEFT JOIN (SELECT material_id, object_id, text FROM objects) USING (material_id, object_id) WHERE NOT coalesce(CASE WHEN quote = '' THEN text = '' ELSE contains(text, quote) END, false)")
def a10_quote_mismatch(spark, sf_dir):
    return op.misquoted(_placed(spark, sf_dir).drop("obligation_id"), objects(spark, sf_dir, hint=None))


@query(f"WITH {_MODEL} {_v('unknown_object', 'block_id', 'object_id', 'obligation_id')} FROM placed ANTI JOIN objects USING (material_id, object_id)")
def a11_unknown_object(spark, sf_dir):
    return op.unknown(_placed(spark, sf_dir), objects(spark, sf_dir, hint=None), ["material_id", "object_id"], "unknown_object", few=True)


@query(f"WITH {_MODEL} {_v('omission', obj='object_id', obl='obligation_id')} FROM obligations ANTI JOIN placed USING (material_id, obligation_id)")
def a12_omission(spark, sf_dir):
    return op.omitted(obligations(objects(spark, sf_dir, hint=None)), _placed(spark, sf_dir))


@query(f"WITH {_MODEL}, {_DRAFTED} {_v('protected_object', obj='object_id')} FROM drafted ANTI JOIN placed USING (material_id, object_id) WHERE kind IN ('image', 'media', 'table', 'code', 'formula', 'link', 'page', 'attachment', 'footnote')")
def a13_protected_object(spark, sf_dir):
    return op.unplaced(_drafted(spark, sf_dir), _placed(spark, sf_dir))


@query(f"WITH {_MODEL} {_v('heading', obj='object_id')} FROM objects WHERE kind = 'heading' AND NOT EXISTS (SELECT 1 FROM placed p JOIN blocks b USING (material_id, block_id) WHERE p.material_id = objects.material_id AND p.object_id = objects.object_id AND regexp_matches(b.markdown, '(?m)^ {{0,3}}#{{1,6}}\\s+\\S'))")
def a14_heading_structure(spark, sf_dir):
    return op.headings_lost(objects(spark, sf_dir), _placed(spark, sf_dir), blocks(spark, sf_dir))


@query(
    "WITH r AS (SELECT DISTINCT c_custkey AS unit FROM customer), a AS (SELECT DISTINCT o_custkey AS unit FROM orders WHERE o_orderstatus = 'F') "
    "SELECT coalesce(r.unit, a.unit) AS unit, CASE WHEN a.unit IS NULL THEN 'missing' ELSE 'unexpected' END AS side FROM r FULL JOIN a ON r.unit = a.unit WHERE r.unit IS NULL OR a.unit IS NULL"
)
def a15_plan_coverage(spark, sf_dir):
    """Units that a plan requires and units that its finished orders reach, as two differences."""
    required = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("unit"))
    actual = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("unit"))
    return op.set_difference(required, actual, ["unit"])


@query(
    f"WITH {_MODEL}, all_v AS ({_v('unknown_object', 'block_id', 'object_id', 'obligation_id')} FROM placed ANTI JOIN objects USING (material_id, object_id) "
    f"UNION ALL {_v('quote', 'block_id', 'object_id')} FROM placed LEFT JOIN (SELECT material_id, object_id, text FROM objects) USING (material_id, object_id) WHERE NOT coalesce(CASE WHEN quote = '' THEN text = '' ELSE contains(text, quote) END, false) "
    f"UNION ALL {_v('omission', obj='object_id', obl='obligation_id')} FROM obligations ANTI JOIN placed USING (material_id, obligation_id)) SELECT code, count(*) AS violations, count(DISTINCT material_id) AS materials FROM all_v GROUP BY code"
)
def a17_release_issues(spark, sf_dir):
    objs, placed = objects(spark, sf_dir, hint=None), _placed(spark, sf_dir)
    found = op.all_rules(op.unknown(placed, objs, ["material_id", "object_id"], "unknown_object", few=True), op.misquoted(placed.drop("obligation_id"), objs), op.omitted(obligations(objs), placed))
    return found.groupBy("code").agg(F.count("*").alias("violations"), F.count_distinct("material_id").alias("materials"))


_CHECKS = (
    f"{BLOCKS_SQL}, checks AS (SELECT material_id, 'has_text' AS code, bool_and(trim(markdown) <> '') AS passed FROM blocks GROUP BY 1 UNION ALL SELECT material_id, 'has_answer', bool_or(kind = 'explanation') FROM blocks GROUP BY 1 "
    "UNION ALL SELECT material_id, 'starts_at_zero', min(ord) = 0 FROM blocks GROUP BY 1 UNION ALL SELECT material_id, 'no_gaps', max(ord) = count(*) - 1 FROM blocks GROUP BY 1 UNION ALL SELECT material_id, 'bounded', sum(length(markdown)) <= 8000 FROM blocks GROUP BY 1)"
)


def _checks(spark, sf_dir):
    facts = blocks(spark, sf_dir).groupBy("material_id").agg(
        F.bool_and(F.trim("markdown") != "").alias("has_text"), F.bool_or(F.col("kind") == "explanation").alias("has_answer"), (F.min("ord") == 0).alias("starts_at_zero"),
        (F.max("ord") == F.count("*") - 1).alias("no_gaps"), (F.sum(F.char_length("markdown")) <= 8000).alias("bounded"),
    )
    return facts.unpivot("material_id", ["has_text", "has_answer", "starts_at_zero", "no_gaps", "bounded"], "code", "passed")


@query(f"WITH {_CHECKS} SELECT material_id, count(*) AS checks, count(*) FILTER (NOT passed) AS failed, bool_and(passed) AS passed FROM checks GROUP BY material_id")
def a19_project_scorecard(spark, sf_dir):
    return op.scorecard(_checks(spark, sf_dir))


@query(f"WITH {_CHECKS}, s AS (SELECT material_id, bool_and(passed) AS passed FROM checks GROUP BY material_id) SELECT count(*) AS total, count(*) FILTER (passed) AS passed, bool_and(passed) AS all_passed FROM s")
def a20_campaign_report(spark, sf_dir):
    return op.scorecard(_checks(spark, sf_dir)).agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.bool_and("passed").alias("all_passed"))


@query(
    f"WITH {OBJECTS_SQL}, prose AS (SELECT * FROM objects WHERE kind = 'text' AND len(regexp_extract_all(text, '[A-Za-z]+')) >= 8 AND len(regexp_extract_all(text, '[\\x{{4E00}}-\\x{{9FFF}}]')) <= 2) "
    "SELECT material_id, count(*) AS gaps FROM prose ANTI JOIN labels l ON material_id = l.doc_id GROUP BY material_id"
)
def a21_translation_gaps(spark, sf_dir):
    """Prose lines of materials that nobody has reviewed."""
    from tracewell.functions.scalars import han_characters, latin_words

    prose = objects(spark, sf_dir).where("kind = 'text'").where((latin_words(F.col("text")) >= 8) & (han_characters(F.col("text")) <= 2))
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("material_id")).distinct()
    return prose.join(done, "material_id", "left_anti").groupBy("material_id").agg(F.count("*").alias("gaps"))


@query("SELECT sha256(text) AS digest, CASE WHEN count(*) FILTER (side = 'd') = 0 THEN 'unexpected' ELSE 'missing' END AS side FROM (SELECT text, 'd' AS side FROM documents UNION ALL SELECT text, 'b' FROM benchmark) GROUP BY 1 HAVING count(DISTINCT side) = 1")
def a22_package_consistency(spark, sf_dir):
    digests = lambda name: table(spark, sf_dir, name).select(F.sha2("text", 256).alias("digest"))
    return op.set_difference(digests("documents"), digests("benchmark"), ["digest"])


_FACTS = "facts AS (SELECT doc_id AS id, quality::VARCHAR || toxic::VARCHAR AS body FROM labels), adds AS (SELECT doc_id AS id, (CASE WHEN contains(text, '***') THEN '0' ELSE '1' END) || '0' AS body FROM documents)"


def _facts(spark, sf_dir):
    facts = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.concat(F.col("quality").cast("string"), F.col("toxic").cast("string")).alias("body"))
    adds = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.contains("text", F.lit("***")), "00").otherwise("10").alias("body"))
    return facts, adds


@query(f"WITH {OBJECTS_SQL} SELECT material_id, count(*) AS facts, count(*) FILTER (text <> '') AS quoted, count(DISTINCT object_id) = count(*) AS unique_ids FROM objects GROUP BY material_id")
def a23_fact_inventory(spark, sf_dir):
    return objects(spark, sf_dir).groupBy("material_id").agg(F.count("*").alias("facts"), F.count_if(F.col("text") != "").alias("quoted"), (F.count_distinct("object_id") == F.count("*")).alias("unique_ids"))


@query(f"WITH {_FACTS}, b AS (SELECT *, 0 AS added FROM facts UNION ALL SELECT *, 1 FROM adds) SELECT id, CASE WHEN count(DISTINCT body) > 1 THEN 'conflict' WHEN min(added) = 1 THEN 'added' ELSE 'kept' END AS status FROM b GROUP BY id")
def a24_fact_additions(spark, sf_dir):
    return op.merged_facts(*_facts(spark, sf_dir))


@query(
    "WITH n AS (SELECT n_nationkey::BIGINT AS id, n_nationkey::BIGINT AS ord, n_name AS body FROM nation), r AS (SELECT r_regionkey::BIGINT AS id, r_name AS body FROM region), a AS (SELECT s_suppkey + 1000000 AS id, s_name AS body FROM supplier), "
    "d AS (SELECT n_nationkey::BIGINT AS id FROM nation ANTI JOIN supplier ON n_nationkey = s_nationkey) "
    "SELECT n.id, n.ord, coalesce(r.body, n.body) AS body FROM n LEFT JOIN r USING (id) ANTI JOIN d ON n.id = d.id UNION ALL SELECT a.id, (SELECT max(ord) FROM n) + row_number() OVER (ORDER BY a.id), a.body FROM a"
)
def a25_inventory_patch(spark, sf_dir):
    """Nations as inventory, regions as replacements, suppliers as additions, unsupplied nations removed."""
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    rows = nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_nationkey").cast("long").alias("ord"), F.col("n_name").alias("body"))
    replace = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("body"))
    add = supplier.select((F.col("s_suppkey") + 1_000_000).alias("id"), F.col("s_name").alias("body"))
    remove = rows.join(supplier.select(F.col("s_nationkey").cast("long").alias("id")).distinct(), "id", "left_anti")
    return op.patched(rows, replace, add, remove)


@query(
    "WITH k AS (SELECT DISTINCT c_custkey AS id FROM customer), r AS (SELECT CASE WHEN o_orderkey % 97 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS id FROM orders WHERE o_orderpriority = '1-URGENT'), a AS (SELECT o_orderkey // 2 AS id FROM orders WHERE o_orderkey % 40 < 2), "
    "m AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 9 = 0 UNION ALL SELECT s_suppkey * 9 FROM supplier UNION ALL SELECT s_suppkey + 2000000 FROM supplier) "
    "SELECT DISTINCT id, 'unknown replacement' AS conflict FROM r ANTI JOIN k USING (id) UNION ALL SELECT DISTINCT id, 'unknown removal' FROM m ANTI JOIN k USING (id) UNION ALL SELECT DISTINCT id, 'existing addition' FROM a SEMI JOIN k USING (id) UNION ALL SELECT DISTINCT id, 'replaced and removed' FROM m SEMI JOIN r USING (id) "
    "UNION ALL SELECT id, 'repeated replacement' FROM r GROUP BY id HAVING count(*) > 1 UNION ALL SELECT id, 'repeated addition' FROM a GROUP BY id HAVING count(*) > 1 UNION ALL SELECT id, 'repeated removal' FROM m GROUP BY id HAVING count(*) > 1"
)
def a25_patch_conflicts(spark, sf_dir):
    """Customers as inventory; urgent orders replace, pairs of orders add, every ninth customer and what suppliers name is removed."""
    customers, orders, suppliers = (table(spark, sf_dir, t) for t in ("customer", "orders", "supplier"))
    key = F.when(F.col("o_orderkey") % 97 == 0, F.col("o_custkey") + 1_000_000).otherwise(F.col("o_custkey"))
    replace = orders.where("o_orderpriority = '1-URGENT'").select(key.alias("id"))
    add = orders.where("o_orderkey % 40 < 2").select(F.expr("o_orderkey div 2").alias("id"))
    remove = customers.where("c_custkey % 9 = 0").select(F.col("c_custkey").alias("id")).unionByName(suppliers.select((F.col("s_suppkey") * 9).alias("id"))).unionByName(suppliers.select((F.col("s_suppkey") + 2_000_000).alias("id")))
    return op.patch_conflicts(customers.select(F.col("c_custkey").alias("id")), replace, add, remove)


@query(
    "WITH d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), f AS (SELECT 'f' || (doc_id - CASE WHEN doc_id % 12 = 1 THEN 1 ELSE 0 END) AS id, doc_id AS source_id, CASE WHEN doc_id % 10 = 3 THEN left(text, 9) || chr(7) ELSE substr(text, 3, 30) END AS quote FROM d WHERE doc_id % 8 <> 5) "
    "SELECT doc_id::VARCHAR AS id, 'not assessed' AS issue FROM d WHERE doc_id % 9 = 2 UNION SELECT doc_id::VARCHAR, 'no fact' FROM d WHERE doc_id % 8 = 5 UNION SELECT id, 'repeated fact' FROM f GROUP BY id HAVING count(*) > 1 "
    "UNION SELECT id, 'quote not in source' FROM f JOIN d ON doc_id = source_id WHERE NOT (quote <> '' AND contains(text, quote)) UNION SELECT DISTINCT (c_custkey + 50000000)::VARCHAR, 'unknown source' FROM customer WHERE c_custkey % 100 = 1"
)
def a23_inventory_issues(spark, sf_dir):
    """A fact from most documents, some under the id of the one before, some with a quote that is not there; some documents are not assessed."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("source_id"), "text")
    own = F.concat(F.lit("f"), (F.col("source_id") - F.when(F.col("source_id") % 12 == 1, 1).otherwise(0)).cast("string"))
    quote = F.when(F.col("source_id") % 10 == 3, F.concat(F.left("text", F.lit(9)), F.lit("\x07"))).otherwise(F.substring("text", 3, 30))
    facts = docs.where("source_id % 8 <> 5").select(own.alias("id"), "source_id", quote.alias("quote"))
    stray = table(spark, sf_dir, "customer").where("c_custkey % 100 = 1").select((F.col("c_custkey") + 50_000_000).cast("long").alias("source_id"))
    return op.inventory_issues(facts, docs, docs.where("source_id % 9 <> 2").select("source_id").unionByName(stray))


@query(f"WITH {_FACTS} SELECT f.id, CASE WHEN a.id IS NULL THEN 'source missing' WHEN a.body <> f.body THEN 'status differs' END AS issue FROM facts f LEFT JOIN adds a USING (id) WHERE a.id IS NULL OR a.body <> f.body")
def a27_fidelity_issues(spark, sf_dir):
    facts, adds = _facts(spark, sf_dir)
    met = facts.join(adds.withColumnRenamed("body", "seen"), "id", "left")
    return met.select("id", F.when(F.col("seen").isNull(), "source missing").when(F.col("seen") != F.col("body"), "status differs").alias("issue")).where("issue is not null")


@query("WITH rules AS (SELECT DISTINCT event_type AS rule FROM events), u AS (SELECT DISTINCT user_id FROM events), e AS (SELECT user_id, event_type AS rule, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, rule, coalesce(n, 0) AS judged, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated' ELSE 'once' END AS state FROM u CROSS JOIN rules LEFT JOIN e USING (user_id, rule)")
def a28_style_rules(spark, sf_dir):
    """Every rule judged exactly once per reviewer: what is missing and what is repeated."""
    from tracewell.operators.binding import small

    events = table(spark, sf_dir, "events").withColumnRenamed("event_type", "rule")
    counted = events.groupBy("user_id", "rule").agg(F.count("*").alias("n"))
    every = counted.select("user_id").distinct().crossJoin(small(counted.select("rule").distinct()))
    state = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated").otherwise("once")
    return every.join(counted, ["user_id", "rule"], "left").select("user_id", "rule", F.coalesce("n", F.lit(0)).alias("judged"), state.alias("state"))


@query(f"WITH {BLOCKS_SQL}, b AS (SELECT * FROM blocks WHERE kind <> 'document_info'), e AS (SELECT material_id, block_id AS a, lead(block_id) OVER (PARTITION BY material_id ORDER BY ord) AS z FROM b) SELECT material_id, a, z FROM e WHERE z IS NOT NULL")
def a29_teaching_transitions(spark, sf_dir):
    from tracewell.operators.sequence import transition_pairs

    return transition_pairs(blocks(spark, sf_dir))


@query("SELECT o_orderkey AS unit, o_custkey AS plan, CASE WHEN row_number() OVER w = 1 THEN 'first' WHEN o_orderdate >= lag(o_orderdate) OVER w THEN 'follows' ELSE 'out of order' END AS relation FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def a30_plan_order(spark, sf_dir):
    """Units follow earlier ones only: an order placed before its predecessor is out of order."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    before = F.lag("o_orderdate").over(w)
    relation = F.when(F.row_number().over(w) == 1, "first").when(F.col("o_orderdate") >= before, "follows").otherwise("out of order")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("unit"), F.col("o_custkey").alias("plan"), relation.alias("relation"))


@query("SELECT l_orderkey AS edge, l_suppkey AS target, 'supplier' AS kind FROM lineitem ANTI JOIN supplier ON l_suppkey = s_suppkey UNION SELECT l_orderkey, l_partkey, 'buyer' FROM lineitem ANTI JOIN customer ON l_partkey = c_custkey UNION SELECT l_orderkey, l_orderkey, 'order' FROM lineitem ANTI JOIN orders ON l_orderkey = o_orderkey")
def a33_evidence_integrity(spark, sf_dir):
    """References that lead nowhere, for each kind of edge."""
    lines = table(spark, sf_dir, "lineitem")
    edges = (("l_suppkey", "supplier", "s_suppkey", "supplier"), ("l_partkey", "customer", "c_custkey", "buyer"), ("l_orderkey", "orders", "o_orderkey", "order"))
    broken = [
        lines.select(F.col("l_orderkey").alias("edge"), F.col(own).alias("target")).join(table(spark, sf_dir, other).select(F.col(key).alias("target")), "target", "left_anti").select("edge", "target", F.lit(kind).alias("kind"))
        for own, other, key, kind in edges
    ]
    return op.all_rules(*broken).distinct()


@query(
    "WITH f AS (SELECT user_id AS material_id, event_type AS invariant, CASE WHEN value > 300 THEN 'FAIL' WHEN value > 100 THEN 'UNKNOWN' ELSE 'PASS' END AS status FROM events), i AS (SELECT DISTINCT event_type AS invariant FROM events) "
    "SELECT m.material_id, i.invariant, CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_or(status = 'UNKNOWN') THEN 'UNKNOWN' ELSE 'PASS' END AS verdict FROM (SELECT DISTINCT material_id FROM f) m CROSS JOIN i LEFT JOIN f USING (material_id, invariant) GROUP BY ALL"
)
def a34_integrity_verdict(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    status = F.when(F.col("value") > 300, "FAIL").when(F.col("value") > 100, "UNKNOWN").otherwise("PASS")
    findings = events.select(F.col("user_id").alias("material_id"), F.col("event_type").alias("invariant"), status.alias("status"))
    return op.roll_up(findings, findings.select("invariant").distinct())


@query("SELECT b.item_id, count(d.doc_id) AS sources, CASE WHEN count(d.doc_id) > 0 THEN 'SUPPORTED' ELSE 'UNSUPPORTED' END AS status FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id")
def a35_claim_provenance(spark, sf_dir):
    """Claims and the documents that literally hold them."""
    from tracewell.operators import literals

    claims = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("claim"))
    held = literals.held(table(spark, sf_dir, "documents").select("doc_id", "text"), claims, ["doc_id"], literal="claim").groupBy("claim").agg(F.count("*").alias("n"))
    sources = F.coalesce("n", F.lit(0))
    return claims.hint("merge").join(held, "claim", "left").select("item_id", sources.alias("sources"), F.when(sources > 0, "SUPPORTED").otherwise("UNSUPPORTED").alias("status"))


@query(f"WITH {OBJECTS_SQL} SELECT material_id, count(*) AS objects, sum(length(text))::BIGINT AS chars, ceil(count(*) / 6.0)::BIGINT AS batches, ceil(count(*) / 6.0)::BIGINT + 2 <= 24 AS feasible FROM objects GROUP BY material_id")
def a41_work_estimate(spark, sf_dir):
    found = objects(spark, sf_dir).groupBy("material_id").agg(F.count("*").alias("objects"), F.sum(F.char_length("text")).cast("long").alias("chars"))
    return found.withColumn("batches", F.ceil(F.col("objects") / 6).cast("long")).withColumn("feasible", F.col("batches") + 2 <= 24)


@query(f"WITH {OBJECTS_SQL} SELECT kind, lang, count(*) AS n, grouping(kind, lang)::INT AS level FROM objects JOIN documents ON doc_id = material_id GROUP BY CUBE (kind, lang)")
def a42_object_counts(spark, sf_dir):
    langs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("material_id"), "lang")
    return objects(spark, sf_dir).select("material_id", "kind").join(langs, "material_id").cube("kind", "lang").agg(F.count("*").alias("n"), F.grouping_id("kind", "lang").cast("int").alias("level"))


@query("SELECT o_custkey AS job, count(*) FILTER (o_orderstatus = 'F') AS commits, count(*) AS attempts, count(*) FILTER (o_orderstatus = 'F') <= 2 AS within_limit FROM orders GROUP BY o_custkey")
def a43_execution_evidence(spark, sf_dir):
    done = F.count_if(F.col("o_orderstatus") == "F")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("job")).agg(done.alias("commits"), F.count("*").alias("attempts"), (done <= 2).alias("within_limit"))


_ISSUES = "b AS (SELECT conv_id AS material_id, CASE WHEN contains(text, '. ') THEN 'sentence' ELSE 'fragment' END AS issue FROM conversations WHERE role = 'user'), a AS (SELECT conv_id AS material_id, CASE WHEN contains(text, '. ') THEN 'sentence' ELSE 'fragment' END AS issue FROM conversations WHERE role = 'assistant')"


@query(f"WITH {_ISSUES}, n AS (SELECT material_id, issue, count(*) AS n FROM a GROUP BY ALL), o AS (SELECT material_id, issue, count(*) AS n FROM b GROUP BY ALL) SELECT n.material_id, n.issue, (n.n - coalesce(o.n, 0))::BIGINT AS added FROM n LEFT JOIN o USING (material_id, issue) WHERE n.n > coalesce(o.n, 0)")
def z01_new_issues(spark, sf_dir):
    """Issues of the answers that the questions don't have, repeats counted."""
    turns = table(spark, sf_dir, "conversations")
    issue = F.when(F.contains("text", F.lit(". ")), "sentence").otherwise("fragment")
    of = lambda role: turns.where(F.col("role") == role).select(F.col("conv_id").alias("material_id"), issue.alias("issue"))
    return op.new_issues(of("user"), of("assistant")).groupBy("material_id", "issue").agg(F.count("*").alias("added"))


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'unexpected' END AS side FROM documents d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL")
def z02_set_equality(spark, sf_dir):
    return op.set_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def z03_finding_merge(spark, sf_dir):
    return op.without_repeats(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")


@query("WITH k AS (SELECT doc_id FROM labels WHERE quality = 1), s AS (SELECT doc_id FROM labels WHERE toxic = 1) SELECT doc_id, CASE WHEN k.doc_id IS NOT NULL AND s.doc_id IS NOT NULL THEN 'overlap' WHEN k.doc_id IS NOT NULL THEN 'retained' ELSE 'supplement' END AS part FROM k FULL JOIN s USING (doc_id)")
def z04_disjoint_supplement(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    kept, more = labels.where("quality = 1").select("doc_id", F.lit(True).alias("k")), labels.where("toxic = 1").select("doc_id", F.lit(True).alias("s"))
    part = F.when(F.col("k") & F.col("s"), "overlap").when(F.col("k"), "retained").otherwise("supplement")
    return kept.join(more, "doc_id", "full").select("doc_id", part.alias("part"))


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN quality IS NULL THEN 'invalid' ELSE 'valid' END AS state FROM documents d LEFT JOIN labels l USING (doc_id)")
def z05_assignments(spark, sf_dir):
    returned = table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(True).alias("there"))
    state = F.when(F.col("there").isNull(), "missing").when(F.col("quality").isNull(), "invalid").otherwise("valid")
    return table(spark, sf_dir, "documents").join(returned, "doc_id", "left").select("doc_id", state.alias("state"))
