"""Queries of responsibilities, editable lines, proposals, captures, and completeness."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import screening as op
from tracewell.registry import query
from tracewell.sources.model import BLOCKS_SQL, OBJECTS_SQL, blocks, objects, table


@query(
    f"WITH {OBJECTS_SQL} SELECT material_id, object_id, true AS preserve, ord % 4 <> 0 AND quality IS NOT NULL AND kind IN ('text', 'heading') AS present, ord % 4 <> 0 AND coalesce(quality = 1, false) AND kind = 'text' AS explain "
    "FROM objects LEFT JOIN labels l ON l.doc_id = material_id"
)
def p15_responsibilities(spark, sf_dir):
    """Lines of labelled documents are decided on; every fourth line is chrome, metadata or decoration."""
    scope = F.when(F.col("ord") % 12 == 0, "site_chrome").when(F.col("ord") % 12 == 4, "source_metadata").when(F.col("ord") % 12 == 8, "layout_decorative")
    rows = objects(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("material_id"), "quality")
    decided = rows.join(labels, "material_id").select("material_id", "object_id", F.col("kind").isin("text", "heading").alias("present"), ((F.col("quality") == 1) & (F.col("kind") == "text")).alias("explain"))
    return op.responsibilities(rows.withColumn("source_scope", scope), decided, ["material_id", "object_id"])


@query(
    f"WITH {BLOCKS_SQL} SELECT material_id, block_id, unnest(CASE WHEN kind = 'source' THEN [] WHEN kind = 'explanation' THEN [0, 4] ELSE [0] END)::BIGINT AS line_no FROM blocks WHERE kind <> 'document_info' OR true"
    .replace("WHEN kind = 'explanation' THEN [0, 4] ELSE [0] END", "WHEN kind = 'explanation' THEN [0, 4] WHEN ord % 2 = 1 THEN [0, 4] ELSE [] END")
)
def p16_editable_lines(spark, sf_dir):
    """Blocks of a line, a repeated one, a blank one and a literal over two lines; document information as object blocks, half of which hold literals only."""
    rows = blocks(spark, sf_dir)
    word = F.concat(F.lit("w"), "ord")
    authored = F.concat(word, F.lit("\nsame\nsame\n \n"), F.lit("end\n{{source:"), word, F.lit("}} and\nx<y> more"))
    literal = F.concat(F.lit("{{source:"), word, F.lit("}} and\nx<y>"))
    is_object = F.col("kind") == "document_info"
    text = F.when(is_object & (F.col("ord") % 2 == 0), literal).otherwise(authored)
    made = rows.select("material_id", "block_id", F.when(is_object, "object").otherwise(F.col("kind")).alias("kind"), text.alias("markdown"), literal.alias("literal"))
    held = made.groupBy("material_id").agg(F.collect_set("literal").alias("literals"))
    return op.editable_lines(made.drop("literal"), held).withColumn("line_no", F.col("line_no").cast("long"))


@query(
    f"WITH {BLOCKS_SQL}, b AS (SELECT material_id * 1000 + ord AS block_id, (material_id + ord) % 9 AS k FROM blocks) SELECT block_id, 0 AS part, CASE k WHEN 0 THEN 'refused: no change' WHEN 1 THEN 'refused: empty target' WHEN 2 THEN 'refused: literal changed' WHEN 3 THEN 'refused: literal overlapped' "
    "WHEN 4 THEN 'refused: object markup' WHEN 5 THEN 'refused: inline code removed' WHEN 6 THEN 'one -> 1' WHEN 7 THEN 'one -> 1' ELSE 'two' || chr(10) || 'same -> 2' END AS told FROM b UNION ALL SELECT block_id, 1, 'two -> ' FROM b WHERE k = 7"
)
def v07_proposal_screening(spark, sf_dir):
    """An edit of each block: the same text, none, one that breaks a literal, one that overlaps it, markup, lost code, a word, two lines, two lines of which one repeats."""
    rows = blocks(spark, sf_dir).select((F.col("material_id") * 1000 + F.col("ord")).alias("block_id"), ((F.col("material_id") + F.col("ord")) % 9).alias("k"))
    text = F.lit("one\ntwo\nsame\nsame\n`code` {{source:a}} <b>x</b>")
    old = F.element_at(F.array(*map(F.lit, ("one", "", "{{source:a}}", "{source:a", "<b>x", "`code`", "one", "one\ntwo", "two\nsame"))), (F.col("k") + 1).cast("int"))
    new = F.element_at(F.array(*map(F.lit, ("one", "x", "gone", "{source:b", "<i>x", "code", "1", "1", "2"))), (F.col("k") + 1).cast("int"))
    held = rows.select("block_id", F.when(F.col("k") == 4, "object").otherwise("explanation").alias("kind"), text.alias("markdown"), F.array(F.lit("{{source:a}}"), F.lit("")).alias("literals"))
    made, refused = op.screened_proposals(rows.select(F.col("block_id").alias("edit_id"), "block_id", old.alias("old"), new.alias("new")), held)
    done = made.select("block_id", "part", F.concat("old", F.lit(" -> "), "new").alias("told"))
    return done.unionByName(refused.select("block_id", F.lit(0).alias("part"), F.concat(F.lit("refused: "), "reason").alias("told")))


@query(
    "SELECT page_id AS capture_id, CASE page_id % 6 WHEN 4 THEN 'synthesized' WHEN 5 THEN 'unbound' ELSE 'bound' END AS state, page_id % 6 = 1 AS differs, page_id % 6 = 5 AND page_id % 4 <> 0 AS is_gap FROM pages"
)
def j04_capture_binding(spark, sf_dir):
    """A capture of each page's link: bound in another spelling, to another destination, as an image, archived only, or lost; every fourth is outside the article."""
    pages = table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 6).alias("k"), F.concat(F.lit("https://example.org/c/"), "page_id").alias("place"))
    found = pages.where("k < 4").select(F.concat(F.lit("o"), "page_id").alias("object_id"), F.when(F.col("k") == 2, "image").otherwise("link").alias("kind"), F.col("page_id").alias("capture_id"), F.col("place").alias("target"))
    target = F.when(F.col("k").isin(1, 2), "https://example.org/elsewhere").otherwise(F.concat("place", F.lit("/#f")))
    captures = pages.select(F.col("page_id").alias("capture_id"), F.lit("link").alias("kind"), F.when(F.col("page_id") % 4 == 0, "page").otherwise("article").alias("scope"), F.concat(F.lit("p"), "page_id").alias("preview"), target.alias("target"))
    told, differs, gaps = op.bound_captures(found, captures, captures.where("capture_id % 6 = 4").select("preview"))
    met = told.join(differs.select("capture_id", F.lit(True).alias("d")).hint("merge"), "capture_id", "left").join(gaps.select("capture_id", F.lit(True).alias("g")).hint("merge"), "capture_id", "left")
    return met.select("capture_id", "state", F.coalesce("d", F.lit(False)).alias("differs"), F.coalesce("g", F.lit(False)).alias("is_gap"))


@query(
    "WITH f AS (SELECT o_custkey AS material, bool_or(o_orderstatus = 'P') AS open FROM orders GROUP BY 1), m AS (SELECT c_custkey AS material, c_custkey % 5 AS k, c_mktsegment <> 'BUILDING' AS has, coalesce(open, false) AS open FROM customer LEFT JOIN f ON f.material = c_custkey), "
    "w AS (SELECT material, CASE WHEN has AND open THEN 'open figures' WHEN k = 1 THEN 'render not completed' WHEN k = 2 THEN 'render gaps' END AS why FROM m) SELECT material, why IS NULL AS complete, why FROM w"
)
def j06_completeness_gate(spark, sf_dir):
    """Customers as materials, orders as their figures, open ones unbound; one segment has no manifest; renders break off, have gaps, or were never tried."""
    customer = table(spark, sf_dir, "customer").withColumn("k", F.col("c_custkey") % 5)
    materials = customer.select(F.col("c_custkey").alias("material"), (F.col("c_mktsegment") != "BUILDING").alias("has_manifest"))
    figures = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("material"), F.lit(True).alias("ready"), (F.col("o_orderstatus") != "P").alias("bound"))
    renders = customer.where("k < 4").select(F.col("c_custkey").alias("material"), (F.col("k") != 3).alias("attempted"), (~F.col("k").isin(1, 3)).alias("completed"), F.when(F.col("k") == 2, 1).otherwise(0).alias("gaps"))
    return op.complete_materials(materials, figures, renders)
