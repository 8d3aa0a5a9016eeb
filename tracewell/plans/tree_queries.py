"""Queries of the hierarchy: a region holds nations, a nation its segments; customers are documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import tree as op
from tracewell.registry import query
from tracewell.sources.model import table

_FOLDERS = (
    "folders AS (SELECT 'r' || r_regionkey AS id, NULL::VARCHAR AS parent, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation "
    "UNION ALL SELECT DISTINCT 's' || c_nationkey || c_mktsegment, 'n' || c_nationkey, c_mktsegment FROM customer), "
    "documents_ AS (SELECT c_custkey AS doc_id, 's' || c_nationkey || c_mktsegment AS parent, c_name AS name, c_acctbal FROM customer)"
)
_BELOW = "below AS (SELECT id AS root, id FROM folders UNION SELECT p.id, c.id FROM folders p JOIN folders c ON c.parent = p.id UNION SELECT g.id, c.id FROM folders g JOIN folders p ON p.parent = g.id JOIN folders c ON c.parent = p.id)"


def _folders(spark, sf_dir):
    of = lambda c: F.col(c).cast("string")
    regions = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), of("r_regionkey")).alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), of("n_nationkey")).alias("id"), F.concat(F.lit("r"), of("n_regionkey")).alias("parent"), F.col("n_name").alias("name"))
    segments = table(spark, sf_dir, "customer").select(F.concat(F.lit("s"), of("c_nationkey"), "c_mktsegment").alias("id"), F.concat(F.lit("n"), of("c_nationkey")).alias("parent"), F.col("c_mktsegment").alias("name")).distinct()
    return regions.unionByName(nations).unionByName(segments)


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("s"), F.col("c_nationkey").cast("string"), "c_mktsegment").alias("parent"), F.col("c_name").alias("name"), "c_acctbal")


@query(f"WITH RECURSIVE {_FOLDERS}, t AS (SELECT id, name::VARCHAR AS path, 0 AS depth FROM folders WHERE parent IS NULL UNION ALL SELECT f.id, t.path || '/' || f.name, t.depth + 1 FROM folders f JOIN t ON f.parent = t.id) SELECT id, path, depth FROM t")
def h01_folder_paths(spark, sf_dir):
    return op.paths(_folders(spark, sf_dir))


@query(f"WITH {_FOLDERS}, {_BELOW} SELECT root, id FROM below WHERE root LIKE 'r%' OR root LIKE 'n%'")
def h02_descendants(spark, sf_dir):
    folders = _folders(spark, sf_dir)
    return op.descendants(folders, folders.where("id like 'r%' or id like 'n%'").select("id"))


@query(f"WITH {_FOLDERS} SELECT parent, sum(f)::BIGINT AS folders, sum(d)::BIGINT AS documents FROM (SELECT parent, 1 AS f, 0 AS d FROM folders UNION ALL SELECT parent, 0, 1 FROM documents_) GROUP BY parent")
def h03_child_counts(spark, sf_dir):
    return op.child_counts(_folders(spark, sf_dir), _documents(spark, sf_dir))


@query(f"WITH RECURSIVE {_FOLDERS}, t AS (SELECT id, name::VARCHAR AS path FROM folders WHERE parent IS NULL UNION ALL SELECT f.id, t.path || '/' || f.name FROM folders f JOIN t ON f.parent = t.id) SELECT id, path FROM t WHERE contains(lower(path), 'nation_1')")
def h04_tree_search(spark, sf_dir):
    return op.searched(_folders(spark, sf_dir), "Nation_1")


@query("SELECT p_partkey, p_brand AS parent, lower(p_name) AS name_key, count(*) OVER (PARTITION BY p_brand, lower(p_name)) AS n FROM part QUALIFY count(*) OVER (PARTITION BY p_brand, lower(p_name)) > 1")
def h05_sibling_collisions(spark, sf_dir):
    from tracewell.functions.names import name_key

    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("parent"), name_key("p_name").alias("name_key"))
    return op.colliding(rows)


@query(
    f"WITH {_FOLDERS}, {_BELOW}, moves AS (SELECT 'r' || n_regionkey AS id, 'n' || n_nationkey AS target FROM nation UNION SELECT 'n' || n_nationkey, 'r' || (n_regionkey + 1) FROM nation) "
    "SELECT m.id, m.target, CASE WHEN b.id IS NOT NULL THEN 'cycle' WHEN f.id IS NULL THEN 'unknown target' END AS reason FROM moves m LEFT JOIN below b ON b.root = m.id AND b.id = m.target LEFT JOIN folders f ON f.id = m.target"
)
def h06_moves(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    key = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    down = nation.select(key("r", F.col("n_regionkey")).alias("id"), key("n", F.col("n_nationkey")).alias("target"))
    over = nation.select(key("n", F.col("n_nationkey")).alias("id"), key("r", F.col("n_regionkey") + 1).alias("target"))
    return op.checked_moves(_folders(spark, sf_dir), down.unionByName(over).distinct())


@query(f"WITH {_FOLDERS}, {_BELOW}, sel AS (SELECT id FROM folders WHERE id = 'r1' OR parent = 'r1' OR parent = 'r2'), top AS (SELECT id FROM sel ANTI JOIN (SELECT b.id FROM below b SEMI JOIN sel ON b.root = sel.id WHERE b.root <> b.id) n USING (id)) SELECT b.id, b.root AS trash_group FROM below b SEMI JOIN top ON b.root = top.id")
def h07_grouped_trash(spark, sf_dir):
    folders = _folders(spark, sf_dir)
    return op.trashed(folders, folders.where("id = 'r1' or parent = 'r1' or parent = 'r2'").select("id"))


@query(
    f"WITH {_FOLDERS}, {_BELOW}, c AS (SELECT root, id FROM below WHERE root LIKE 'r%'), k AS (SELECT DISTINCT o_custkey AS doc_id FROM orders WHERE o_orderstatus = 'P'), "
    "d AS (SELECT c.root, d.doc_id, 'document:' || d.doc_id || ':' || (d.doc_id % 5) || ':' || CAST(floor(d.c_acctbal) AS BIGINT) AS line FROM c JOIN documents_ d ON d.parent = c.id), "
    "l AS (SELECT root, id AS folder, NULL AS doc_id, NULL AS blocked, 'folder:' || id AS line FROM c UNION ALL SELECT d.root, NULL, d.doc_id, k.doc_id, line FROM d LEFT JOIN k USING (doc_id)) "
    "SELECT root, count(DISTINCT folder) AS folders, count(doc_id) AS documents, count(blocked) AS blockers, sha256(count(*) || ':' || sum(CAST('0x' || left(md5(line), 15) AS HUGEINT))) AS digest FROM l GROUP BY root"
)
def h08_purge_preview(spark, sf_dir):
    """Customers with an order in progress block; their balance is their content version."""
    folders, documents = _folders(spark, sf_dir), _documents(spark, sf_dir)
    status = F.when(F.col("o_orderstatus") == "P", "running").otherwise("done")
    blockers = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), status.alias("status"))
    versions = documents.withColumns({"revision": F.col("doc_id") % 5, "version": F.floor("c_acctbal").cast("long")})
    return op.purge_preview(op.descendants(folders, folders.where("parent is null").select("id")), versions, blockers)


@query(f"WITH {_FOLDERS}, t AS (SELECT id, parent FROM folders WHERE id LIKE 's1%' OR id IN ('n1', 'n2')), g AS (SELECT id FROM t WHERE id LIKE 's1%') SELECT g.id, CASE WHEN t.parent IN (SELECT id FROM folders WHERE id NOT IN (SELECT id FROM t)) OR t.parent IN (SELECT id FROM g) THEN t.parent END AS parent FROM g JOIN t USING (id)")
def h07_restored(spark, sf_dir):
    """The segments of some nations come back from the trash; where the nation is still there, they fall back to the root."""
    folders = _folders(spark, sf_dir)
    trash = folders.where("id like 's1%' or id in ('n1', 'n2')").select("id", F.when(F.col("id").startswith("s"), "segments").otherwise("nations").alias("trash_group"))
    return op.restored(trash, folders, "segments")


# Nations of every fourth key and their segments are in the trash; customers are in the trash, archived or neither.
_SPACES = (
    f"{_FOLDERS}, fold AS (SELECT *, coalesce((id LIKE 'n%' AND TRY_CAST(substr(id, 2) AS INT) % 4 = 0) OR (parent LIKE 'n%' AND TRY_CAST(substr(parent, 2) AS INT) % 4 = 1), false) AS trashed, length(name) AS created FROM folders), "
    "doc AS (SELECT 'c' || doc_id AS id, parent, name AS title, doc_id % 7 = 0 AS trashed, doc_id % 5 = 0 AS archived, doc_id % 11 AS created FROM documents_ UNION ALL SELECT 'x' || p_partkey, CASE WHEN p_size > 25 THEN 'gone' END, p_name, false, p_size % 2 = 0, p_size FROM part WHERE p_size IN (1, 26, 50)), "
    "t AS (SELECT id, name::VARCHAR AS path FROM folders WHERE parent IS NULL UNION ALL SELECT f.id, t.path || '/' || f.name FROM folders f JOIN t ON f.parent = t.id)"
)


def _spaces(spark, sf_dir):
    number = lambda c: F.expr(f"try_cast(substr({c}, 2) AS INT)")
    hidden = (F.col("id").startswith("n") & (number("id") % 4 == 0)) | (F.coalesce(F.col("parent"), F.lit("")).startswith("n") & (number("parent") % 4 == 1))
    folders = _folders(spark, sf_dir).withColumns({"trashed": F.coalesce(hidden, F.lit(False)), "created": F.char_length("name").cast("long")})
    customers = _documents(spark, sf_dir).select(
        F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("id"), "parent", F.col("name").alias("title"), (F.col("doc_id") % 7 == 0).alias("trashed"), (F.col("doc_id") % 5 == 0).alias("archived"), (F.col("doc_id") % 11).cast("long").alias("created")
    )
    loose = table(spark, sf_dir, "part").where("p_size in (1, 26, 50)").select(
        F.concat(F.lit("x"), F.col("p_partkey").cast("string")).alias("id"), F.when(F.col("p_size") > 25, "gone").alias("parent"), F.col("p_name").alias("title"), F.lit(False).alias("trashed"), (F.col("p_size") % 2 == 0).alias("archived"), F.col("p_size").cast("long").alias("created")
    )
    return folders, customers.unionByName(loose)


def _listing_sql(space: str, wanted_folders: str, wanted_documents: str, order: str, offset: int, limit: int) -> str:
    shown = "false" if space == "archive" else f"f.trashed = {space == 'trash'}"
    held = "d.trashed" if space == "trash" else f"NOT d.trashed AND d.archived = {space == 'archive'}"
    return (
        f"WITH RECURSIVE {_SPACES}, shown AS (SELECT * FROM fold f WHERE {shown}), held AS (SELECT * FROM doc d WHERE {held}), "
        f"n AS (SELECT s.id, 'folder' AS kind, name AS title, parent, created, coalesce(path, '') AS path, parent IS NULL OR parent NOT IN (SELECT id FROM shown) AS loose FROM shown s LEFT JOIN t ON t.id = s.parent UNION ALL "
        f"SELECT h.id, 'document', title, parent, created, coalesce(path, ''), parent IS NULL OR parent NOT IN (SELECT id FROM shown) FROM held h LEFT JOIN t ON t.id = h.parent), "
        f"w AS (SELECT * FROM n WHERE CASE kind WHEN 'folder' THEN {wanted_folders} ELSE {wanted_documents} END), "
        f"r AS (SELECT *, row_number() OVER (ORDER BY kind DESC, {order}) - 1 AS place, count(*) OVER () AS total FROM w), k AS (SELECT parent AS id, count(*) AS k FROM (SELECT parent FROM shown UNION ALL SELECT parent FROM held) GROUP BY parent) "
        f"SELECT place, total, id, kind, title, parent, path, CASE kind WHEN 'folder' THEN coalesce(k, 0) ELSE 0 END AS child_count FROM r LEFT JOIN k USING (id) WHERE place >= {offset} AND place < {offset + limit}"
    )


@query(_listing_sql("mine", "loose", "loose", "lower(title), id", 3, 40))
def h04_root_page(spark, sf_dir):
    """The second page of the root: regions, and what hangs under folders that are in the trash or unknown."""
    return op.listed(*_spaces(spark, sf_dir), offset=3, limit=40)


@query(_listing_sql("mine", "parent = 'n2'", "parent = 'n2'", "lower(title) DESC, id DESC", 0, 200))
def h04_children(spark, sf_dir):
    return op.listed(*_spaces(spark, sf_dir), parent="n2", sort="reverse")


@query(_listing_sql("archive", "false", "true", "created DESC, id", 5, 60))
def h04_archive_page(spark, sf_dir):
    return op.listed(*_spaces(spark, sf_dir), space="archive", sort="recent", offset=5, limit=60)


@query(_listing_sql("trash", "true", "false", "lower(title), id", 0, 500))
def h04_trash_folders(spark, sf_dir):
    return op.listed(*_spaces(spark, sf_dir), space="trash", folders_only=True, limit=500)


@query(_listing_sql(
    "mine", "contains(lower(path || '/' || title), 'machinery/customer#00000001')",
    "contains(lower(title), 'machinery/customer#00000001') OR contains(lower(path), 'machinery/customer#00000001') OR (ends_with(lower(path), 'machinery') AND starts_with(lower(title), 'customer#00000001'))", "lower(title), id", 0, 500,
))
def h04_path_query(spark, sf_dir):
    """A path's end and a title's beginning, in another case."""
    return op.listed(*_spaces(spark, sf_dir), query=" Machinery/CUSTOMER#00000001", limit=500)


@query("SELECT DISTINCT sha256(d.text) AS unreferenced FROM documents d WHERE text IS NOT NULL AND sha256(d.text) NOT IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL AND doc_id % 4 <> 3)")
def h10_unreferenced_blobs(spark, sf_dir):
    """Pool rows whose digest no reviewed material names: in its file, in a list of lists, as an answer's blob; a fourth names it under another key only."""
    from tracewell.sources.nested import blob_references

    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("sha"))
    flat = F.to_json(F.struct("doc_id", F.struct(F.col("sha").alias("sha256"), F.lit("n").alias("name")).alias("file")))
    lists = F.concat(F.lit('{"pages":[[1,[{"a":null,"b":[{"sha256":"'), "sha", F.lit('"}]}]],"x"]}'))
    answer = F.concat(F.lit('[{"calls":{"last":{"response_markdown_blob":"'), "sha", F.lit('","sha256":"short"}}}]'))
    other = F.concat(F.lit('{"manifest":{"digest":"'), "sha", F.lit('"}}'))
    body = F.element_at(F.array(flat, lists, answer, other), (F.col("doc_id") % 4 + 1).cast("int"))
    bodies = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id").select(F.col("doc_id").alias("id"), body.alias("body"))
    named = blob_references(bodies).select("sha").distinct().hint("merge")
    return docs.select("sha").distinct().join(named, "sha", "left_anti").select(F.col("sha").alias("unreferenced"))


@query("SELECT event_id AS id, event_type AS state, CAST(json_extract(props, '$.k') AS INT) AS revision, CAST(json_extract(props, '$.k') AS INT) % 2 = 0 AS archived FROM events")
def h11_metadata_projection(spark, sf_dir):
    revision = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("state"), revision.alias("revision"), (revision % 2 == 0).alias("archived"))
