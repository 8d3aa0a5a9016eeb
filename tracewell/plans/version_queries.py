"""Queries of versions, patches and table grids.

Orders are materials' current rows and events updates to them; lines of documents with cell marks
are table rows.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewell.operators import grid as grid_op
from tracewell.operators import versions as op
from tracewell.registry import query
from tracewell.sources.model import BLOCKS_SQL, OBJECTS_SQL, blocks, objects, table

_UPDATES = (
    "cur AS (SELECT c_custkey AS key, c_nationkey::BIGINT AS revision, c_name AS body FROM customer), "
    "upd AS (SELECT event_id AS update_id, user_id AS key, CAST(json_extract(props, '$.k') AS BIGINT) % 25 AS base_revision, event_type AS body, ts FROM events), "
    "r AS (SELECT u.*, c.revision AS now, coalesce(base_revision = c.revision, false) AND row_number() OVER (PARTITION BY u.key, base_revision ORDER BY ts, update_id) = 1 AS wins FROM upd u LEFT JOIN cur c USING (key))"
)


def _updates(spark, sf_dir):
    current = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").cast("long").alias("revision"), F.col("c_name").alias("body"))
    k = F.get_json_object("props", "$.k").cast("long")
    updates = table(spark, sf_dir, "events").select(F.col("event_id").alias("update_id"), F.col("user_id").alias("key"), (k % 25).alias("base_revision"), F.col("event_type").alias("body"), "ts")
    return current, updates


@query(f"WITH {_UPDATES} SELECT c.key, CASE WHEN w.key IS NULL THEN c.revision ELSE w.base_revision + 1 END AS revision, coalesce(w.body, c.body) AS body FROM cur c LEFT JOIN (SELECT * FROM r WHERE wins) w USING (key)")
def v01_version_merge(spark, sf_dir):
    return op.merged(*_updates(spark, sf_dir))[0]


@query(f"WITH {_UPDATES} SELECT update_id, key, base_revision, now FROM r WHERE NOT wins")
def v01_version_conflicts(spark, sf_dir):
    return op.merged(*_updates(spark, sf_dir))[1]


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS nth FROM lineitem) WHERE nth = 1")
def v02_first_writes(spark, sf_dir):
    return op.first_writes(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey")


def _patches(spark, sf_dir):
    """Every turn of an assistant is an edit of the question before it, whose old text it quotes rightly only when that is short."""
    rows = blocks(spark, sf_dir)
    old = F.when(F.char_length("markdown") <= 400, F.col("markdown")).otherwise(F.left("markdown", F.lit(400)))
    edits = rows.where("kind = 'source'").select(F.col("material_id").alias("patch_id"), "material_id", "block_id", old.alias("old"), F.concat(F.lit("[edited] "), "markdown").alias("new"))
    return rows, edits


_PATCH = (
    f"{BLOCKS_SQL}, edits AS (SELECT material_id AS patch_id, material_id, block_id, left(markdown, 400) AS old, '[edited] ' || markdown AS new FROM blocks WHERE kind = 'source'), "
    "met AS (SELECT e.*, b.markdown, count(*) OVER (PARTITION BY patch_id, block_id) AS n FROM edits e LEFT JOIN (SELECT material_id, block_id, markdown FROM blocks) b USING (material_id, block_id)), "
    "f AS (SELECT *, CASE WHEN markdown IS NULL THEN 'unknown block' WHEN n > 1 THEN 'repeated' WHEN markdown <> old THEN 'stale' WHEN old = new THEN 'no-op' END AS fault FROM met), "
    "verdicts AS (SELECT patch_id, bool_and(fault IS NULL) AS applied, min(fault) AS fault FROM f GROUP BY patch_id)"
)


@query(f"WITH {_PATCH} SELECT patch_id, applied, fault FROM verdicts")
def v04_patch_verdicts(spark, sf_dir):
    return op.applied(*_patches(spark, sf_dir))[1]


@query(f"WITH {_PATCH} SELECT b.material_id, b.block_id, sha256(CASE WHEN v.applied AND b.kind = 'source' THEN '[edited] ' || b.markdown ELSE b.markdown END) AS sha FROM blocks b LEFT JOIN verdicts v ON v.patch_id = b.material_id")
def v04_patched_blocks(spark, sf_dir):
    return op.applied(*_patches(spark, sf_dir))[0].select("material_id", "block_id", F.sha2("markdown", 256).alias("sha"))


@query(
    "WITH e AS (SELECT d.doc_id, d.text, b.item_id, b.text AS old FROM documents d JOIN benchmark b ON contains(d.text, b.text)) "
    "SELECT item_id AS patch_id, doc_id AS id, CASE WHEN (length(text) - length(replace(text, old, ''))) / length(old) = 1 AND NOT contains(old, chr(10)) THEN sha256(replace(text, old, '[' || item_id || ']')) END AS sha FROM e"
)
def v05_local_repairs(spark, sf_dir):
    """Benchmark passages as old texts of edits to the documents that hold them."""
    from tracewell.operators import literals

    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("patch_id"), F.col("text").alias("old"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    edits = literals.held(docs, items, ["id"], literal="old").hint("merge").join(items, "old").select("patch_id", "id", "old", F.concat(F.lit("["), "patch_id", F.lit("]")).alias("new"))
    return op.local_repairs(docs, edits).select("patch_id", "id", F.sha2("text", 256).alias("sha"))


_EDITS = (
    f"{BLOCKS_SQL}, b AS (SELECT material_id * 1000 + ord AS id, material_id, ord, markdown AS t, kind FROM blocks), "
    "e AS (SELECT id, 1 AS nth, regexp_extract(t, '[A-Za-z]{4,}') AS old, '[1]' AS new FROM b UNION ALL SELECT id, 2, regexp_extract(t, '([A-Za-z]{5,})[^A-Za-z]*$', 1), '[2]' FROM b UNION ALL SELECT id, 3, substr(t, 3, 6), '[3]' FROM b WHERE ord % 3 = 1), "
    "m AS (SELECT e.*, t, CASE WHEN old = '' THEN 'no old text' WHEN kind = 'document_info' THEN 'not allowed' WHEN contains(old, chr(10)) THEN 'several lines' WHEN (length(t) - length(replace(t, old, ''))) / greatest(length(old), 1) <> 1 THEN 'not unique' END AS fault FROM e JOIN b USING (id)), "
    "p AS (SELECT *, CASE WHEN fault IS NULL THEN strpos(t, old) - 1 END AS a, CASE WHEN fault IS NULL THEN strpos(t, old) - 1 + length(old) END AS z FROM m), "
    "o AS (SELECT *, CASE WHEN coalesce(max(z) OVER (PARTITION BY id ORDER BY a, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > a, false) THEN 'overlap' ELSE fault END AS why FROM p), "
    "w AS (SELECT id, arg_min(why, nth) FILTER (why IS NOT NULL) AS of_edit FROM o GROUP BY id), "
    "v AS (SELECT b.id AS patch, CASE WHEN ord % 7 = 5 THEN 'stale' WHEN material_id % 6 = 4 THEN 'too many rounds' WHEN ord % 11 = 8 THEN 'other text' ELSE of_edit END AS fault FROM b JOIN w USING (id))"
)


def _edit_lists(spark, sf_dir):
    """Every block is a patch of two or three edits: its first longer word, its last one, and six characters that may cut a word or a line."""
    from tracewell.operators import edits

    rows = blocks(spark, sf_dir).select((F.col("material_id") * 1000 + F.col("ord")).alias("id"), "material_id", "ord", "kind", F.col("markdown").alias("text"))
    olds = ((1, F.regexp_extract("text", "[A-Za-z]{4,}", 0)), (2, F.regexp_extract("text", "([A-Za-z]{5,})[^A-Za-z]*$", 1)), (3, F.substring("text", 3, 6)))
    made = [rows.where("ord % 3 = 1" if n == 3 else "true").select(F.col("id").alias("patch"), F.lit(n).alias("nth"), "id", old.alias("old"), F.lit(f"[{n}]").alias("new")) for n, old in olds]
    found = edits.located(made[0].unionByName(made[1]).unionByName(made[2]), rows, rows.where("kind <> 'document_info'").select(F.col("id").alias("patch"), "id"))
    sha = F.sha2("text", 256)
    states = rows.select(F.col("id").alias("material"), F.lit(3).alias("revision"), F.when(F.col("material_id") % 6 == 4, 2).otherwise(1).alias("rounds"), sha.alias("digest"))
    told = F.when(F.col("ord") % 11 == 8, F.sha2(F.concat("text", F.lit(" ")), 256)).otherwise(sha)
    patches = rows.select(F.col("id").alias("patch"), F.col("id").alias("material"), F.when(F.col("ord") % 7 == 5, 2).otherwise(3).alias("base_revision"), told.alias("digest"))
    return found, edits.verdicts(found, patches, states)


@query(f"WITH {_EDITS} SELECT patch, fault IS NULL AS applied, fault FROM v")
def v04_edit_list_verdicts(spark, sf_dir):
    return _edit_lists(spark, sf_dir)[1]


@query(
    f"WITH {_EDITS}, l AS (SELECT id, max(old) FILTER (nth = 1) AS o1, max(old) FILTER (nth = 2) AS o2, max(old) FILTER (nth = 3) AS o3, any_value(t) AS t FROM o GROUP BY id) "
    "SELECT patch, id, sha256(CASE WHEN o3 IS NULL THEN replace(replace(t, o1, '[1]'), o2, '[2]') ELSE replace(replace(replace(t, o1, '[1]'), o2, '[2]'), o3, '[3]') END) AS sha FROM l JOIN v ON v.patch = l.id WHERE fault IS NULL"
)
def v05_edit_lists(spark, sf_dir):
    """The text of each block after all edits of its patch."""
    from tracewell.operators import edits

    return edits.applied(*_edit_lists(spark, sf_dir)).select("patch", "id", F.sha2("text", 256).alias("sha"))


@query(
    "WITH d AS (SELECT doc_id AS id, string_split(text, chr(10))[1] AS head, text FROM documents WHERE text IS NOT NULL) "
    "SELECT id, unnest([1, 2, 3])::INT AS round, unnest(CASE id % 5 WHEN 0 THEN ['verified', 'verified', 'verified'] WHEN 1 THEN ['verified', 'other result', 'broken'] WHEN 2 THEN ['other text', 'broken', 'broken'] WHEN 3 THEN ['verified', 'edits don''t fit', 'broken'] ELSE ['verified', 'verified', 'edits don''t fit'] END) AS state FROM d"
)
def v06_commit_chains(spark, sf_dir):
    """Three rounds on each document behind two lines of its own: some record another digest, hit twice, or overlap."""
    from tracewell.operators import edits

    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 5).alias("k"), F.concat(F.lit("one two two\nthree four\n"), "text").alias("text"))
    tail = F.substring("text", 24, 1_000_000_000)
    shas = [F.sha2(F.concat(F.lit(head), tail), 256) for head in ("one two two\nthree four\n", "1 two two\n3 four\n", "1 two two\n3 more\n", "1 two 2\n3 more\n")]
    wrong = F.lit("0" * 64)
    chain = [
        (1, F.when(F.col("k") == 2, wrong).otherwise(shas[0]), shas[1]),
        (2, shas[1], F.when(F.col("k") == 1, wrong).otherwise(shas[2])),
        (3, shas[2], shas[3]),
    ]
    commits = [docs.select("id", F.lit(n).alias("round"), before.alias("before"), after.alias("after")) for n, before, after in chain]
    hits = ((1, 1, 1, "one", "1", "true"), (1, 2, 2, "three", "3", "true"), (2, 1, 2, "four", "more", "true"), (2, 2, 1, "two", "2", "k = 3"), (3, 1, 1, " two two", " two 2", "true"), (3, 2, 1, "two t", "x", "k = 4"))
    made = [docs.where(when).select("id", F.lit(r).alias("round"), F.lit(n).alias("nth"), F.lit(line).alias("line"), F.lit(old).alias("old"), F.lit(new).alias("new")) for r, n, line, old, new, when in hits]
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    return edits.replayed(docs, union(commits), union(made))


@query(f"WITH {BLOCKS_SQL} SELECT material_id, block_id, sha256(replace(markdown, '. ', '.' || chr(10))) = sha256(replace(replace(markdown, '.' || chr(10), '. '), '. ', '.' || chr(10))) AS verified FROM blocks")
def v06_patch_replay(spark, sf_dir):
    rows = blocks(spark, sf_dir)
    commits = rows.select(F.struct("material_id", "block_id").alias("commit_id"), F.replace("markdown", F.lit(".\n"), F.lit(". ")).alias("before"), F.lit(". ").alias("old"), F.lit(".\n").alias("new"), F.sha2(F.replace("markdown", F.lit(". "), F.lit(".\n")), 256).alias("after_sha256"))
    return op.replayed(commits).select("commit_id.material_id", "commit_id.block_id", "verified")


@query(
    f"WITH {BLOCKS_SQL}, n AS (SELECT material_id, ord, CASE WHEN kind = 'explanation' AND contains(markdown, chr(10)) THEN upper(markdown) ELSE markdown END AS new_markdown FROM blocks) "
    "SELECT material_id, bool_and(coalesce(markdown = new_markdown, false)) AS extends FROM blocks LEFT JOIN n USING (material_id, ord) GROUP BY material_id"
)
def v09_incremental_prefix(spark, sf_dir):
    rows = blocks(spark, sf_dir)
    changed = F.when((F.col("kind") == "explanation") & F.contains("markdown", F.lit("\n")), F.upper("markdown")).otherwise(F.col("markdown"))
    return op.unchanged_prefix(rows, rows.withColumn("markdown", changed))


_REQUIRES = "req AS (SELECT DISTINCT p_partkey AS concept, p_partkey // 3 AS needs FROM part WHERE p_partkey > 0)"


@query(
    f"WITH RECURSIVE {_REQUIRES}, c AS (SELECT concept, needs, 1 AS distance FROM req UNION ALL SELECT c.concept, r.needs, c.distance + 1 FROM c JOIN req r ON r.concept = c.needs) SELECT concept, needs, min(distance)::INT AS distance FROM c GROUP BY concept, needs"
)
def v11_prerequisites(spark, sf_dir):
    parts = table(spark, sf_dir, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("concept"), F.expr("p_partkey div 3").alias("needs"))
    return op.prerequisite_closure(parts)


@query("SELECT l_partkey AS obligation_id, arg_min(l_orderkey, (l_shipdate, l_orderkey)) AS node_id FROM lineitem GROUP BY l_partkey")
def v12_ownership(spark, sf_dir):
    return op.owned_once(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("obligation_id"), F.col("l_orderkey").alias("node_id"), F.col("l_shipdate").alias("ord")))


_PREVIOUS = "depends AS (SELECT node, needs FROM (SELECT o_orderkey AS node, unnest([lag(o_orderkey) OVER w, lag(o_orderkey, 2) OVER w]) AS needs FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) WHERE needs IS NOT NULL)"


@query(
    "WITH RECURSIVE own AS (SELECT DISTINCT arg_min(l_orderkey, (l_shipdate, l_orderkey)) AS node FROM lineitem GROUP BY l_partkey), "
    f"{_PREVIOUS}, r AS (SELECT node, needs FROM depends SEMI JOIN own USING (node) UNION SELECT r.node, d.needs FROM r JOIN depends d ON d.node = r.needs WHERE r.needs NOT IN (SELECT node FROM own)) "
    "SELECT node, needs FROM r WHERE needs IN (SELECT node FROM own)"
)
def v12_bridged_dependencies(spark, sf_dir):
    """Orders that own no part's first line go; what depended on them depends on what they depended on."""
    from pyspark.sql import Window

    from tracewell.operators import planning

    owned = op.owned_once(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("obligation_id"), F.col("l_orderkey").alias("node_id"), F.col("l_shipdate").alias("ord")))
    owners = owned.select(F.col("node_id").alias("node")).distinct().withColumn("kept", F.lit(True))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), "o_custkey")
    nodes = orders.select("node").join(owners, "node", "left").select("node", F.coalesce("kept", F.lit(False)).alias("kept"))
    w = Window.partitionBy("o_custkey").orderBy("node")
    depends = orders.withColumns({"one": F.lag("node").over(w), "two": F.lag("node", 2).over(w)})
    depends = depends.select("node", F.col("one").alias("needs")).unionByName(depends.select("node", F.col("two").alias("needs"))).where("needs IS NOT NULL")
    return planning.bridged(nodes, depends)


_CONCEPTS = (
    "concept AS (SELECT p_partkey AS concept, CASE WHEN p_partkey % 2 = 1 THEN p_size * 40 END AS planned, p_partkey % 100 + 1 AS source FROM part WHERE p_partkey > 0), "
    "unit AS (SELECT l_orderkey AS place, l_suppkey AS source FROM lineitem), used AS (SELECT l_partkey AS concept, min(l_orderkey) AS used FROM lineitem WHERE l_linenumber = 1 GROUP BY l_partkey), "
    "placed AS (SELECT c.concept, planned, min(u.place) AS borne, any_value(used) AS used FROM concept c LEFT JOIN unit u USING (source) LEFT JOIN used USING (concept) GROUP BY c.concept, planned), "
    "place AS (SELECT concept, CASE WHEN used < coalesce(planned, borne) THEN used ELSE coalesce(planned, borne) END AS place, CASE WHEN used < coalesce(planned, borne) THEN 'first use' WHEN planned IS NOT NULL THEN 'planned' WHEN borne IS NOT NULL THEN 'first source' ELSE 'no place' END AS why FROM placed)"
)


def _concepts(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    concepts = table(spark, sf_dir, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("concept"), F.expr("CASE WHEN p_partkey % 2 = 1 THEN p_size * 40 END").cast("long").alias("planned"), (F.col("p_partkey") % 100 + 1).alias("source"))
    units = lines.select(F.col("l_orderkey").cast("long").alias("place"), F.col("l_suppkey").alias("source"))
    return units, concepts, lines.where("l_linenumber = 1").select(F.col("l_partkey").alias("concept"), F.col("l_orderkey").cast("long").alias("place"))


@query(f"WITH {_CONCEPTS} SELECT concept, place, why FROM place")
def v11_placements(spark, sf_dir):
    """Parts as concepts: half are planned, the others go to the first order that bears their source; earlier uses pull them forward."""
    from tracewell.operators import planning

    return planning.placements(*_concepts(spark, sf_dir))


@query(
    f"WITH RECURSIVE {_CONCEPTS}, edge AS (SELECT * FROM (SELECT concept, unnest(list_distinct([concept // 3, concept // 5])) AS needs FROM place) WHERE needs > 0), "
    "below AS (SELECT concept, concept AS needs, 0 AS d FROM place UNION ALL SELECT b.concept, e.needs, d + 1 FROM below b JOIN edge e ON e.concept = b.needs), "
    "sound AS (SELECT * FROM place ANTI JOIN (SELECT b.concept FROM below b JOIN place p ON p.concept = b.needs WHERE p.place IS NULL) USING (concept)), "
    "hoisted AS (SELECT b.needs AS concept, min(p.place) AS place FROM below b JOIN sound p ON p.concept = b.concept GROUP BY b.needs), level AS (SELECT concept, max(d) AS level FROM below SEMI JOIN sound USING (concept) GROUP BY concept) "
    "SELECT concept, h.place, level::INT AS level, row_number() OVER (ORDER BY h.place, level, concept) AS nth FROM hoisted h JOIN level USING (concept)"
)
def v11_concept_order(spark, sf_dir):
    """Each part needs two smaller ones, which come no later than it does."""
    from tracewell.operators import planning

    placed = planning.placements(*_concepts(spark, sf_dir))
    requires = placed.select("concept", F.explode(F.array(F.expr("concept div 3"), F.expr("concept div 5"))).alias("needs")).where("needs > 0").hint("merge")
    return planning.concept_order(placed, requires)[0]


@query(
    "WITH RECURSIVE c AS (SELECT p_partkey AS concept, count(*) OVER () AS n FROM part WHERE p_partkey > 0), req AS (SELECT concept, CASE WHEN concept % 11 = 3 THEN 1000000000 ELSE concept * concept % n + 1 END AS needs FROM c WHERE concept % 5 <> 0), "
    "reach AS (SELECT concept, needs FROM req UNION SELECT r.concept, q.needs FROM reach r JOIN req q ON q.concept = r.needs), loop AS (SELECT concept FROM reach WHERE concept = needs), bad AS (SELECT concept FROM loop UNION SELECT needs FROM reach WHERE needs = 1000000000), "
    "lacks AS (SELECT concept FROM req WHERE needs = 1000000000) "
    "SELECT DISTINCT concept, CASE WHEN concept IN (SELECT concept FROM loop) THEN 'cycle' WHEN concept IN (SELECT concept FROM lacks) THEN 'unknown prerequisite' ELSE 'needs a fault' END AS reason FROM reach WHERE needs IN (SELECT concept FROM bad)"
)
def v11_concept_faults(spark, sf_dir):
    """Each part needs another one, so that there are cycles, ends and unknown ones."""
    from tracewell.operators import planning

    parts = table(spark, sf_dir, "part").where("p_partkey > 0").select(F.col("p_partkey").cast("long").alias("concept"))
    n = parts.count()
    needs = F.when(F.col("concept") % 11 == 3, F.lit(1_000_000_000)).otherwise(F.col("concept") * F.col("concept") % n + 1).cast("long")
    return planning.concept_order(parts.withColumn("place", F.lit(1).cast("long")), parts.where("concept % 5 <> 0").select("concept", needs.alias("needs")))[1]


@query(f"WITH {BLOCKS_SQL} SELECT material_id, block_id, sha256(trim(markdown)) AS digest FROM blocks WHERE sha256(trim(markdown)) = sha256(markdown)")
def v13_carry_forward(spark, sf_dir):
    rows = blocks(spark, sf_dir)
    return op.carried_forward(rows.select("material_id", "block_id", F.sha2(F.trim("markdown"), 256).alias("digest")), rows)


@query("SELECT event_id AS action_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AND event_type <> 'error' AS can_undo FROM events")
def v14_undo(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("material_id"), F.col("event_id").alias("action_id"), "ts", (F.col("event_type") != "error").alias("active"))
    return op.undoable(rows).select("action_id", "can_undo")


# ---------------------------------------------------------------- grids

_GRIDS = (
    f"{OBJECTS_SQL}, t AS (SELECT material_id, ord, string_split(text, ' | ') AS row FROM objects WHERE kind = 'table'), src AS (SELECT material_id AS table_id, list(row ORDER BY ord) AS grid FROM t GROUP BY material_id), "
    "drf AS (SELECT material_id AS table_id, list(list_transform(row, lambda x: CASE WHEN length(x) > 12 THEN x || '!' ELSE x END) ORDER BY ord) AS grid FROM t GROUP BY material_id)"
)
_CELLS = "{0}c AS (SELECT table_id, r - 1 AS r, generate_subscripts(row, 1) - 1 AS c, unnest(row) AS cell FROM (SELECT table_id, unnest(grid) AS row, generate_subscripts(grid, 1) AS r FROM {0}))"


def _grids(spark, sf_dir):
    """Source tables, and drafts of them in which long cells were changed."""
    rows = objects(spark, sf_dir).where("kind = 'table'").select("material_id", "ord", F.split("text", r" \| ").alias("row"))
    loud = F.transform("row", lambda x: F.when(F.char_length(x) > 12, F.concat(x, F.lit("!"))).otherwise(x))
    grid = lambda row: F.transform(F.array_sort(F.collect_list(F.struct("ord", row.alias("row")))), lambda x: x["row"])
    both = rows.groupBy(F.col("material_id").alias("table_id")).agg(grid(F.col("row")).alias("source"), grid(loud).alias("draft"))
    return both.select("table_id", F.col("source").alias("grid")), both.select("table_id", F.col("draft").alias("grid"))


@query(f"WITH {_GRIDS} SELECT table_id, len(grid) AS n_rows, list_max(list_transform(grid, lambda r: len(r))) AS n_columns FROM src")
def g01_table_signatures(spark, sf_dir):
    source, _ = _grids(spark, sf_dir)
    width = F.array_max(F.transform("grid", lambda r: F.size(r)))
    return source.select("table_id", F.size("grid").cast("long").alias("n_rows"), width.cast("long").alias("n_columns"))


_HTML_CELLS = (
    "p AS (SELECT CAST(substr(p_brand, 7) AS BIGINT) AS id, p_type, p_partkey, p_name, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_type, p_partkey) AS r, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS k, count(*) OVER (PARTITION BY p_brand, p_type) AS n FROM part)"
)


def _html_tables(spark, sf_dir):
    """A page for each brand, a table of its parts: a heading over two columns, a cell over the rows of each container, and a small table in the first name's cell."""
    from tracewell.sources.tables import html_tables

    nth = F.row_number().over(Window.partitionBy("p_brand", "p_type").orderBy("p_partkey"))
    n = F.count("*").over(Window.partitionBy("p_brand", "p_type"))
    rows = table(spark, sf_dir, "part").withColumns({"k": nth, "n": n})
    first = F.when(F.col("k") == 1, F.concat(F.lit('<td rowspan="'), F.col("n").cast("string"), F.lit('">'), "p_type", F.lit("</td>"))).otherwise("")
    inner = F.when(F.col("k") == 1, F.lit("<table><tr><td>in</td></tr></table>")).otherwise("")
    row = F.concat(F.lit("<tr>"), first, F.lit("<td>"), "p_name", inner, F.lit("</td><td> "), F.col("p_size").cast("string"), F.lit("\n</td></tr>"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("p_type", "p_partkey", row.alias("row")))), lambda x: x["row"])
    html = F.concat(F.lit('<p>x</p><table><thead><tr><th>Box</th><th colspan="2">Part</th></tr></thead><tbody>'), F.array_join(lines, ""), F.lit("</tbody></table>"))
    return html_tables(rows.groupBy(F.substring("p_brand", 7, 9).cast("long").alias("id")).agg(html.alias("html")))


@query(
    f"WITH {_HTML_CELLS} SELECT DISTINCT id, 0 AS r, unnest([0, 1, 2]) AS c, true AS is_header, unnest(['Box', 'Part', 'Part']) AS text FROM p UNION ALL "
    "SELECT id, r, unnest([0, 1, 2]), false, unnest([p_type, CASE WHEN k = 1 THEN p_name || 'in' ELSE p_name END, p_size::VARCHAR]) FROM p"
)
def g01_logical_grids(spark, sf_dir):
    """Every place of the grid that spans make, outer tables only."""
    from tracewell.sources.tables import logical_grid

    return logical_grid(_html_tables(spark, sf_dir).where("table_no = 1")).select("id", "r", "c", "is_header", "text")


@query(
    f"WITH {_HTML_CELLS}, l AS (SELECT id, r, CASE WHEN k = 1 THEN p_type || ':' || n || ':1|' ELSE '' END || CASE WHEN k = 1 THEN p_name || 'in' ELSE p_name END || ':1:1|' || p_size || ':1:1' AS line FROM p) "
    "SELECT id, sha256('Box:1:1|Part:1:2' || chr(10) || string_agg(line, chr(10) ORDER BY r)) AS signature FROM l GROUP BY id"
)
def g01_native_signatures(spark, sf_dir):
    from tracewell.sources.tables import native_signatures

    return native_signatures(_html_tables(spark, sf_dir).where("table_no = 1")).select("id", "signature")


@query(
    "WITH p AS (SELECT p_brand AS table_id, p_partkey::VARCHAR AS key, p_name, p_size, p_partkey FROM part) "
    "SELECT table_id, key, 'size' AS name, p_size::VARCHAR AS expected, (p_size + 1)::VARCHAR AS current, 'other text' AS state FROM p WHERE p_partkey % 10 = 0 AND p_partkey % 7 <> 3 UNION ALL "
    "SELECT table_id, key, NULL, key, NULL, 'missing row' FROM p WHERE p_partkey % 7 = 3 UNION ALL SELECT DISTINCT table_id, NULL, 'weight', 'weight', NULL, 'missing column' FROM p UNION ALL SELECT DISTINCT table_id, NULL, 'price', 'price', NULL, 'ambiguous column' FROM p"
)
def g03_headed_differences(spark, sf_dir):
    """Each brand's parts with their columns in another order, one more between them, two that might be the price, some sizes changed and some rows gone."""
    parts = table(spark, sf_dir, "part").select(F.col("p_brand").alias("table_id"), F.col("p_partkey").cast("string").alias("key"), "p_partkey", "p_name", "p_size")
    numbered = parts.withColumn("r", F.row_number().over(Window.partitionBy("table_id").orderBy("p_partkey")))
    cell = lambda df, values: df.select("table_id", "r", F.posexplode(F.array(*values)).alias("c", "text")).hint("merge")
    head = lambda names: cell(parts.select("table_id").distinct().withColumn("r", F.lit(0)), [F.lit(n) for n in names])
    size = F.col("p_size").cast("string")
    expected = head(["id", "name", "size", "weight", "price"]).unionByName(cell(numbered, [F.col("key"), F.col("p_name"), size, F.lit("1"), F.lit("2")]))
    changed = F.when(F.col("p_partkey") % 10 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).cast("string")
    current = head(["id", "Extra", "Size (cm)", "Old price", "NAME", "New Price"]).unionByName(cell(numbered.where("p_partkey % 7 <> 3"), [F.col("key"), F.lit("e"), changed, F.lit("2"), F.col("p_name"), F.lit("2")]))
    return grid_op.headed_differences(expected, current)


@query(f"WITH {_GRIDS}, {_CELLS.format('src')}, {_CELLS.format('drf')} SELECT table_id, r, c, s.cell AS expected, d.cell AS current FROM srcc s FULL JOIN drfc d USING (table_id, r, c) WHERE s.cell IS DISTINCT FROM d.cell")
def g02_grid_differences(spark, sf_dir):
    found = grid_op.differences(*_grids(spark, sf_dir))
    return found.select("table_id", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), "expected", "current")


@query(
    f"WITH {_GRIDS}, a AS (SELECT table_id, unnest(grid) AS want FROM src), b AS (SELECT table_id, unnest(grid) AS have FROM drf), ka AS (SELECT *, want[1] AS key, count(*) OVER (PARTITION BY table_id, want[1]) AS wn FROM a), "
    "kb AS (SELECT *, have[1] AS key, count(*) OVER (PARTITION BY table_id, have[1]) AS hn FROM b), m AS (SELECT table_id, key, want, have, CASE WHEN hn IS NULL THEN 'missing row' WHEN wn > 1 OR hn > 1 THEN 'ambiguous row' END AS state FROM ka LEFT JOIN kb USING (table_id, key)), "
    "w AS (SELECT table_id, key, state, want, have, unnest(range(CASE WHEN state IS NULL THEN greatest(len(want), len(have)) ELSE least(1, greatest(len(want), coalesce(len(have), 0))) END)) AS c FROM m) "
    "SELECT DISTINCT table_id, key, c::INT AS c, want[c + 1] AS expected, have[c + 1] AS current, state FROM w WHERE state IS NOT NULL OR want[c + 1] IS DISTINCT FROM have[c + 1]"
)
def g03_keyed_differences(spark, sf_dir):
    """Repeated keys are ambiguous."""
    return grid_op.keyed_differences(*_grids(spark, sf_dir))


@query(f"WITH {_GRIDS}, s AS (SELECT table_id AS source_id, grid::VARCHAR AS g, count(*) OVER (PARTITION BY grid::VARCHAR) AS n FROM src), d AS (SELECT table_id AS draft_id, grid::VARCHAR AS g, count(*) OVER (PARTITION BY grid::VARCHAR) AS n FROM drf) SELECT source_id, draft_id FROM s JOIN d USING (g) WHERE s.n = 1 AND d.n = 1")
def g04_unique_tables(spark, sf_dir):
    return grid_op.unique_tables(*_grids(spark, sf_dir))


@query("SELECT l_partkey AS part, max(l_linenumber) AS version, min(l_suppkey) AS digest, count(DISTINCT l_suppkey) > 1 AS conflict FROM (SELECT *, rank() OVER (PARTITION BY l_partkey ORDER BY l_linenumber DESC) AS r FROM lineitem) WHERE r = 1 GROUP BY l_partkey")
def g05_latest_grids(spark, sf_dir):
    saved = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("version"), F.col("l_suppkey").alias("digest"))
    return grid_op.latest_grids(saved, ["part"])


@query(f"WITH {_GRIDS} SELECT s.table_id, s.grid = d.grid AS still_valid FROM src s JOIN drf d USING (table_id)")
def g06_still_valid(spark, sf_dir):
    source, draft = _grids(spark, sf_dir)
    return source.join(draft.withColumnRenamed("grid", "now"), "table_id").select("table_id", (grid_op.signature(F.col("grid")) == grid_op.signature(F.col("now"))).alias("still_valid"))


@query(f"WITH {_GRIDS}, g AS (SELECT table_id, unnest(grid) AS row, generate_subscripts(grid, 1) - 1 AS r FROM src) SELECT table_id, r, '| ' || array_to_string(row, ' | ') || ' |' AS markdown FROM g")
def g07_cell_repair(spark, sf_dir):
    """Repairing every difference gives the source's rows back."""
    source, draft = _grids(spark, sf_dir)
    return grid_op.repaired(draft, grid_op.differences(source, draft)).select("table_id", F.col("r").cast("long").alias("r"), "markdown")
