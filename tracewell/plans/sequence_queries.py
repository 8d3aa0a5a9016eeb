"""Queries of the ordered-sequence and paging operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewell.operators import sequence as op
from tracewell.operators import text as text_op
from tracewell.registry import query
from tracewell.sources.model import BLOCKS_SQL, OBJECTS_SQL, blocks, objects, table


def _groups_sql(limit: int, most: int, select: str) -> str:
    """Greedy groups by their first objects: each group's end is the first object that no longer fits."""
    return (
        f"WITH RECURSIVE {OBJECTS_SQL}, c AS (SELECT material_id, object_id, length(text) AS size, row_number() OVER w AS rn, sum(length(text)) OVER w AS upto FROM objects WINDOW w AS (PARTITION BY material_id ORDER BY ord)), "
        f"x AS (SELECT material_id, rn, upto - size + {limit} AS room FROM c), "
        f"e AS MATERIALIZED (SELECT x.material_id, x.rn AS s, greatest(x.rn + 1, least(x.rn + {most}, coalesce(b.rn, x.rn + {most}))) AS next FROM x ASOF LEFT JOIN c b ON x.material_id = b.material_id AND x.room < b.upto), "
        "g AS (SELECT material_id, 1::BIGINT AS s, 0::BIGINT AS grp FROM (SELECT DISTINCT material_id FROM c) UNION ALL "
        "SELECT g.material_id, e.next, g.grp + 1 FROM g JOIN e ON g.material_id = e.material_id AND g.s = e.s WHERE EXISTS (SELECT 1 FROM c WHERE c.material_id = e.material_id AND c.rn = e.next)), "
        f"o AS (SELECT c.material_id, c.object_id, g.grp FROM c ASOF JOIN g ON c.material_id = g.material_id AND c.rn >= g.s) {select}"
    )


@query(_groups_sql(8_000, 5_000, 'SELECT material_id, object_id, grp AS "group" FROM o'))
def w01_bounded_groups(spark, sf_dir):
    """A greedy fold, streamed in order of each material."""
    return op.bounded_groups(objects(spark, sf_dir))


@query(_groups_sql(6_500, 20, 'SELECT material_id, grp AS "group", count(*) AS objects, CASE WHEN grp > 0 THEN grp - 1 END AS depends_on FROM o GROUP BY material_id, grp'))
def w02_writing_batches(spark, sf_dir):
    """Greedy batches of at most 6500 characters and 20 objects, each after the one before."""
    batches = op.bounded_groups(objects(spark, sf_dir), 6_500, 20).groupBy("material_id", "group").agg(F.count("*").alias("objects"))
    return batches.withColumn("depends_on", F.lag("group").over(Window.partitionBy("material_id").orderBy("group")))


@query(f"WITH {OBJECTS_SQL} SELECT material_id, object_id, last_value(CASE WHEN kind = 'heading' THEN object_id END IGNORE NULLS) OVER (PARTITION BY material_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS page_id FROM objects")
def w03_source_map(spark, sf_dir):
    rows = objects(spark, sf_dir).withColumn("page_id", F.when(F.col("kind") == "heading", F.col("object_id")))
    return op.forward_filled(rows, ["material_id"], "ord", "page_id").select("material_id", "object_id", "page_id")


@query(
    f"WITH {OBJECTS_SQL}, c AS (SELECT *, CASE WHEN kind IS NOT DISTINCT FROM lag(kind) OVER w THEN 0 ELSE 1 END AS chg FROM objects WINDOW w AS (PARTITION BY material_id ORDER BY ord)), "
    "i AS (SELECT *, sum(chg) OVER (PARTITION BY material_id ORDER BY ord) AS island FROM c) SELECT material_id, kind, min(ord) AS first, count(*) AS n FROM i GROUP BY material_id, island, kind HAVING count(*) >= 2"
)
def w04_adjacent_islands(spark, sf_dir):
    """Runs of at least two neighbouring objects of one kind."""
    before = F.lag("kind").over(Window.partitionBy("material_id").orderBy("ord"))
    rows = op.islands(objects(spark, sf_dir).withColumn("before", before), ["material_id"], ["ord"], ~F.col("kind").eqNullSafe(F.col("before")))
    return rows.groupBy("material_id", "island", "kind").agg(F.min("ord").alias("first"), F.count("*").alias("n")).where("n >= 2").drop("island")


@query(f"WITH {OBJECTS_SQL} SELECT material_id, object_id, floor((row_number() OVER (PARTITION BY material_id ORDER BY ord) - 1) / 45)::BIGINT AS part FROM objects")
def w05_review_parts(spark, sf_dir):
    from tracewell.operators.coverage import parts

    return parts(objects(spark, sf_dir), 45, ["material_id"], ["ord"]).select("material_id", "object_id", "part")


_RANGES = "ranges AS (SELECT l_orderkey AS id, (l_linenumber - 1)::BIGINT AS start, (l_linenumber - 1 + ceil(l_quantity / 25))::BIGINT AS \"end\" FROM lineitem)"


@query(
    f"WITH {_RANGES}, g AS (SELECT *, start > coalesce(max(\"end\") OVER (PARTITION BY id ORDER BY start, \"end\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gap FROM ranges) "
    "SELECT id, NOT bool_or(gap) AND max(\"end\") >= 5 AS fully_read FROM g GROUP BY id"
)
def w06_read_coverage(spark, sf_dir):
    """Line numbers as reads of one or two places each, over resources of length 5."""
    start = (F.col("l_linenumber") - 1).cast("long")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), start.alias("start"), (start + F.ceil(F.col("l_quantity") / 25)).cast("long").alias("end"), F.lit(5).alias("length"))
    return op.read_coverage(rows, ["id"], "length")


@query(f"WITH {BLOCKS_SQL}, e AS (SELECT material_id, block_id AS a, lead(block_id) OVER (PARTITION BY material_id ORDER BY ord) AS z FROM blocks WHERE kind <> 'document_info') SELECT * FROM e WHERE z IS NOT NULL")
def w07_transition_pairs(spark, sf_dir):
    return op.transition_pairs(blocks(spark, sf_dir))


@query(
    f"WITH {BLOCKS_SQL}, u AS (SELECT *, sum(length(markdown)) OVER w AS used, row_number() OVER w AS nth FROM blocks WINDOW w AS (PARTITION BY material_id ORDER BY ord DESC)) "
    "SELECT material_id, block_id, least(length(markdown), 3000) AS chars FROM u WHERE used <= 3000 OR nth = 1"
)
def w08_bounded_context(spark, sf_dir):
    return op.bounded_context(blocks(spark, sf_dir), 3_000).select("material_id", "block_id", F.char_length("markdown").cast("long").alias("chars"))


@query(
    f"WITH {BLOCKS_SQL}, l AS (SELECT *, length(markdown) - length(replace(markdown, chr(10), '')) + 1 AS lines FROM blocks), f AS (SELECT *, coalesce(sum(lines + 1) OVER (PARTITION BY material_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS first_line FROM l) "
    "SELECT material_id, block_id, first_line::BIGINT AS first_line, (first_line + lines - 1)::BIGINT AS last_line FROM f"
)
def w10_line_places(spark, sf_dir):
    return op.line_places(blocks(spark, sf_dir))


_FAULTS = "f AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'error' THEN 'error' END AS fault FROM events)"


@query(
    f"WITH {_FAULTS}, l AS (SELECT *, CASE WHEN fault IS NOT DISTINCT FROM lag(fault) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS chg FROM f WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), "
    "i AS (SELECT *, sum(chg) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM l), r AS (SELECT user_id, island, count(*) AS n, max(fault) AS fault FROM i GROUP BY ALL) "
    "SELECT user_id, max_by(CASE WHEN fault IS NULL THEN 0 ELSE n END, island) AS streak FROM r GROUP BY user_id"
)
def w11_fault_streaks(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.when(F.col("event_type") == "error", "error").alias("fault"))
    return op.streaks(rows, ["user_id"], ["ts", "event_id"], "fault")


@query("SELECT event_id, row_number() OVER w AS ordinal, row_number() OVER w > 3 AS over_limit FROM events WHERE event_type <> 'signup' WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)")
def w12_dispatch_ordinals(spark, sf_dir):
    nth = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").where("event_type <> 'signup'").select("event_id", nth.cast("long").alias("ordinal"), (nth > 3).alias("over_limit"))


@query(
    f"WITH {OBJECTS_SQL}, t AS (SELECT material_id, ord, coalesce(first_value(CASE WHEN kind <> 'heading' THEN ord END IGNORE NULLS) OVER (PARTITION BY material_id ORDER BY ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), ord) AS target FROM objects) "
    "SELECT material_id, target, count(*) AS members, min(ord) AS first FROM t GROUP BY ALL"
)
def w13_heading_merge(spark, sf_dir):
    return op.merged_headings(objects(spark, sf_dir).withColumn("heading_only", F.col("kind") == "heading"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS nth FROM events) WHERE nth <= 120")
def o01_latest_events(spark, sf_dir):
    return op.latest(table(spark, sf_dir, "events"), ["user_id"], [F.desc("event_id")], 120).select("user_id", "event_id")


@query("SELECT user_id, event_type, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id, event_type")
def o02_latest_job(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus <> 'F' ORDER BY o_orderdate DESC, o_orderkey")
def o03_material_listing(spark, sf_dir):
    """All of them: the limit is optional."""
    return table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").orderBy(F.desc("o_orderdate"), "o_orderkey").select("o_orderkey", "o_orderdate")


@query(
    "WITH r AS (SELECT 'n' || n_nationkey AS id, n_name AS name, 0 AS rank FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'c' || c_custkey, c_name, 1 FROM customer WHERE c_nationkey = 1) "
    "SELECT id, name, rank, (SELECT count(*) FROM r) AS total FROM r ORDER BY rank, lower(name), id LIMIT 50 OFFSET 3"
)
def o04_children_page(spark, sf_dir):
    folders = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.lit("f1").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("name"))
    documents = table(spark, sf_dir, "customer").where("c_nationkey = 1").select(F.lit("f1").alias("parent"), F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("name"))
    return op.children_page(folders, documents, "f1", 3, 50).select("id", "name", "rank", "total")


@query(
    "WITH w AS (SELECT doc_id, unnest(range(0, len(string_split(lower(text), 'tion')) - 1)) AS k, string_split(lower(text), 'tion') AS p FROM documents WHERE contains(lower(text), 'tion')), "
    "s AS (SELECT doc_id, length(array_to_string(p[1:k + 1], 'tion')) AS start FROM w), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS nth, count(*) OVER (PARTITION BY doc_id) AS all_n FROM s) SELECT doc_id, start, all_n > 100 AS has_more FROM n WHERE nth <= 100"
)
def o05_capped_find(spark, sf_dir):
    """Case-insensitive occurrences, the first 100 of a text (the cap is the feature)."""
    found = text_op.occurrences(table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("text")), ["doc_id"], "text", F.lit("tion"))
    more = F.count("*").over(Window.partitionBy("doc_id")) > 100
    return op.latest(found.withColumn("has_more", more), ["doc_id"], ["start"], 100).select("doc_id", F.col("start").cast("long").alias("start"), "has_more")


@query(f"WITH {OBJECTS_SQL} SELECT material_id, object_id, lag(object_id) OVER w AS before, lead(object_id) OVER w AS after FROM objects WINDOW w AS (PARTITION BY material_id ORDER BY ord)")
def o06_neighbours(spark, sf_dir):
    w = Window.partitionBy("material_id").orderBy("ord")
    return objects(spark, sf_dir).select("material_id", "object_id", F.lag("object_id").over(w).alias("before"), F.lead("object_id").over(w).alias("after"))


@query(f"WITH {BLOCKS_SQL} SELECT material_id, block_id, row_number() OVER (PARTITION BY material_id ORDER BY kind = 'document_info', ord) AS place FROM blocks")
def o07_end_matter(spark, sf_dir):
    nth = F.row_number().over(Window.partitionBy("material_id").orderBy(F.col("kind") == "document_info", "ord"))
    return blocks(spark, sf_dir).select("material_id", "block_id", nth.cast("long").alias("place"))
