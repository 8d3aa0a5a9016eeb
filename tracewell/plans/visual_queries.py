"""Queries of page comparison, visual classification, fact quotes, baselines and reopened versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import versions, visual
from tracewell.plans.version_queries import _GRIDS, _grids
from tracewell.registry import query
from tracewell.sources.html_objects import page_objects
from tracewell.sources.model import OBJECTS_SQL, objects, table

_TAIL = (
    '<table><tr><td rowspan="2">c</td></tr></table><pre>x  y</pre><span data-anchor-id="a1">s</span><img src="i.png" alt="pic">'
    '<span class="math-tex">m1</span><a href="#here">f</a><p id="here">t</p><a href="https://e.org/1">e</a>'
)
#: What the other rendering has in its place, by page_id modulo 10 (0: nothing).
_CHANGES = (("", ""), ("t</p>", "t more</p>"), ('rowspan="2"', 'rowspan="3"'), ("x  y", "x y"), ("a1", "a2"), ('alt="pic">', 'alt="pic"><img src="j.png">'), ('alt="pic"', 'alt="other"'), ("m1", "m2"), ('id="here"', 'id="there"'), ("e.org/1", "e.org/2"))


def _differs(*kinds: int) -> str:
    return f"page_id % 10 NOT IN ({', '.join(map(str, kinds))})"


@query(
    f"SELECT page_id AS id, {_differs(1, 7)} AS visible_text, {_differs(2)} AS table_cells, {_differs(3)} AS code_blocks, {_differs(4)} AS anchor_ids, {_differs(5)} AS image_count, "
    f"{_differs(5, 6)} AS image_descriptions, {_differs(7)} AS formula_source, {_differs(9)} AS external_links, {_differs(8)} AS local_fragment_targets FROM pages"
)
def j21_compare_pages(spark, sf_dir):
    """Every page with a table, code, an anchor, an image, a formula and links at its end, against a rendering that changes one of them."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.concat(F.coalesce("html", F.lit("")), F.lit(_TAIL)).alias("html"))
    changed = F.col("html")
    for kind, (old, new) in enumerate(_CHANGES[1:], 1):
        tail = _TAIL.replace(old, new)
        changed = F.when(F.col("id") % 10 == kind, F.concat(F.left("html", F.char_length("html") - len(_TAIL)), F.lit(tail))).otherwise(changed)
    return visual.compared_pages(pages, pages.withColumn("html", changed))


@query(
    "WITH links AS (SELECT page_id, generate_subscripts(tags, 1) AS n, unnest(tags) AS tag FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"[^\"]*\">[^<]*</a>') AS tags FROM pages)) "
    "SELECT page_id, regexp_extract(tag, 'href=\"([^\"]*)\"', 1) AS target, 'site_chrome' AS source_scope, n * 30.0 AS y FROM links WHERE n <= 4 AND page_id % 5 <> 0"
)
def p03_top_navigation(spark, sf_dir):
    """Links of each page with captured boxes 30 apart; every fifth page was captured inside a frame."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("page_id").orderBy("ord"))
    links = page_objects(table(spark, sf_dir, "pages")).where("kind = 'link'").withColumn("n", nth).withColumn("capture_id", F.concat_ws("/", "page_id", "n"))
    captures = links.select("capture_id", F.when(F.col("page_id") % 5 == 0, "frame").otherwise("page").alias("scope"), (F.col("n") * 30).cast("string").alias("y"))
    return visual.top_navigation(links.select("page_id", "target", "capture_id"), captures).select("page_id", "target", "source_scope", "y")


@query(
    "WITH d AS (SELECT doc_id AS id FROM documents WHERE doc_id % 3 <> 1) SELECT id, 'image' AS kind, 'https://ci.org/' || id || '/badge.svg' AS target, 'source_metadata' AS source_scope FROM d "
    "UNION ALL SELECT id, 'link', 'https://ci.org/' || id, 'source_metadata' FROM d UNION ALL SELECT id, 'image', 'https://img.shields.io/' || id, 'source_metadata' FROM d WHERE id % 3 = 0"
)
def p05_badges(spark, sf_dir):
    """Documents under a heading with a linked badge, and a paragraph of badges; every third has no heading, every third more than badges."""
    id_ = F.col("doc_id").cast("string")
    head = F.concat(F.when(F.col("doc_id") % 3 == 1, "").otherwise("# "), F.lit("T [![ci](https://ci.org/"), id_, F.lit("/badge.svg)](https://ci.org/"), id_, F.lit(")\n\n"))
    second = F.concat(F.lit("![s](https://img.shields.io/"), id_, F.lit(")"), F.when(F.col("doc_id") % 3 == 2, " words").otherwise(""), F.lit("\n\n![p](https://ci.org/p.png) "))
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(head, second, F.coalesce("text", F.lit(""))).alias("body"))
    found = visual.heading_badges(visual.markdown_targets(texts), visual.badge_contexts(texts))
    return found.select("id", "kind", "target", "source_scope")


@query(
    "WITH p AS (SELECT page_id, page_id // 10 AS material, CASE page_id % 4 WHEN 0 THEN 'site_chrome' WHEN 1 THEN 'body' WHEN 2 THEN 'layout_decorative' END AS scope FROM pages) "
    "SELECT a.material, a.page_id + 1000000 AS id, b.page_id AS definition_id, b.scope AS source_scope FROM p a JOIN p b ON b.material = a.material AND b.page_id = a.page_id + a.page_id % 2 WHERE b.scope IN ('site_chrome', 'layout_decorative')"
)
def p06_symbol_propagation(spark, sf_dir):
    """Each page defines a symbol; a drawing of it uses its own or the next page's one."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), F.floor(F.col("page_id") / 10).cast("long").alias("material"))
    scope = F.when(F.col("page_id") % 4 == 0, "site_chrome").when(F.col("page_id") % 4 == 1, "body").when(F.col("page_id") % 4 == 2, "layout_decorative")
    defined = pages.select("material", F.col("page_id").alias("id"), F.lit("image").alias("kind"), F.concat(F.lit('<svg width="1" id="s'), "page_id", F.lit('"><path/></svg>')).alias("raw"), scope.alias("source_scope"))
    other = F.col("page_id") + F.col("page_id") % 2
    used = pages.select("material", (F.col("page_id") + 1_000_000).alias("id"), F.lit("unknown").alias("kind"), F.concat(F.lit(' <svg class="i"><use href="#s'), other, F.lit('"></use></svg>')).alias("raw"), F.lit(None).cast("string").alias("source_scope"))
    return visual.symbol_scopes(defined.unionByName(used), ["material"])


_TABLES = (
    '<table><tr><td><img src="i"></td><td><p>{t}</p></td></tr></table>',
    '<table><tr><th>h</th><td><img src="i"></td><td><p>{t}</p></td></tr></table>',
    '<table><tr><td><img src="i"></td></tr><tr><td><p>{t}</p></td></tr></table>',
    '<table role="Grid"><tr><td><img src="i"></td><td><p>{t}</p></td></tr></table>',
    '<table><tr><td colspan="2"><img src="i"></td><td><p>{t}</p></td></tr></table>',
    '<table><tr><td>b<img src="i"></td><td><p>{t}</p></td></tr></table>',
    '<table><tr><td></td><td><p>{t}<img src="i"></p></td></tr></table>',
    '<table><tr><td><img src="i"></td><td>{t}</td></tr></table>',
)


@query("SELECT page_id AS id, page_id % 8 = 0 AS is_layout FROM pages")
def p07_layout_tables(spark, sf_dir):
    """A table around each URL, of which one form in eight is a layout."""
    shapes = F.array(*map(F.lit, _TABLES))
    html = F.replace(F.element_at(shapes, (F.col("page_id") % 8 + 1).cast("int")), F.lit("{t}"), F.concat(F.lit("u"), F.regexp_replace("url", "[<>&]", "")))
    return visual.layout_tables(table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), html.alias("html")))


_DRAWINGS = ('<svg width="{n}"><path d=""/></svg>', '<svg><title>t{n}</title></svg>', '<svg aria-label="l{n}"></svg>', '<svg><text>{n}</text></svg>', '<canvas id="{n}"></canvas>', '<svg alt=" "><!-- {n} --></svg>')


@query(f"WITH {OBJECTS_SQL} SELECT material_id, object_id, 'layout_decorative' AS source_scope FROM objects WHERE ord % 6 IN (0, 5) AND material_id % 3 <> 0")
def p10_placeholders(spark, sf_dir):
    """Every line with a drawing in its place; in every third document some pixel shows."""
    shapes = F.array(*map(F.lit, _DRAWINGS))
    raw = F.replace(F.element_at(shapes, (F.col("ord") % 6 + 1).cast("int")), F.lit("{n}"), F.col("ord").cast("string"))
    method = F.when(F.col("material_id") % 3 == 0, "some_pixels").otherwise("all_pixels_alpha_zero")
    rows = objects(spark, sf_dir).select("material_id", "object_id", F.lit("image").alias("kind"), raw.alias("raw"), method.alias("method"), F.lit(None).cast("string").alias("label"))
    return visual.transparent_placeholders(rows).select("material_id", "object_id", "source_scope")


@query(
    f"WITH {OBJECTS_SQL} SELECT l.doc_id AS material_id, printf('src-%05d', 1 + l.doc_id % 4) AS object_id, sha256(o.text) AS quote_sha, o.text IS NOT NULL AS known FROM labels l "
    "LEFT JOIN objects o ON o.material_id = l.doc_id AND o.object_id = printf('src-%05d', 1 + l.doc_id % 4)"
)
def j19_fact_quotes(spark, sf_dir):
    """A fact for each label names one of the first four lines of its document, which may not be there."""
    facts = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("material_id"), F.format_string("src-%05d", 1 + F.col("doc_id") % 4).alias("object_id"))
    bound, unknown = visual.bound_quotes(facts, objects(spark, sf_dir))
    told = bound.select("material_id", "object_id", F.sha2("quote", 256).alias("quote_sha"), F.lit(True).alias("known"))
    return told.unionByName(unknown.select("material_id", "object_id", F.lit(None).cast("string").alias("quote_sha"), F.lit(False).alias("known")))


@query(
    f"WITH {_GRIDS}, m AS (SELECT s.table_id, s.table_id % 3 = 0 AND s.grid <> d.grid AS conflict FROM src s JOIN drf d USING (table_id)) "
    "SELECT table_id, CASE WHEN conflict THEN NULL ELSE 2 END AS version, conflict FROM m"
)
def j24_comparison_baseline(spark, sf_dir):
    """Two saved versions of each document's table, of which every third document changed the second."""
    source, draft = _grids(spark, sf_dir)
    met = source.join(draft.withColumnRenamed("grid", "changed"), "table_id")
    digest = lambda grid: F.sha2(F.to_json(grid), 256)
    second = F.when(F.col("table_id") % 3 == 0, F.col("changed")).otherwise(F.col("grid"))
    saved = F.array(
        F.struct(F.lit(1).alias("version"), F.array(F.lit("b"), F.lit("a")).alias("source_ids"), digest(F.col("grid")).alias("digest")),
        F.struct(F.lit(2).alias("version"), F.array(F.lit("a"), F.lit("b"), F.lit("a")).alias("source_ids"), digest(second).alias("digest")),
    )
    return visual.comparison_baselines(met.select("table_id", F.inline(saved)), ["table_id"]).select("table_id", "version", "conflict")


@query(
    "WITH r AS (SELECT o_custkey AS project, min(o_orderkey) % 3 AS revision FROM orders GROUP BY 1), j AS (SELECT c_custkey AS project, c_custkey % 3 AS revision, c_mktsegment = 'MACHINERY' AS held, md5(c_name) AS digest FROM customer), "
    "m AS (SELECT j.*, CASE WHEN r.project IS NULL THEN 'no request' WHEN r.revision <> j.revision THEN 'conflict' WHEN held THEN 'unfinished job' END AS why FROM j LEFT JOIN r USING (project)) "
    "SELECT project, 'archived' AS row, revision, 1 AS version, digest, NULL::VARCHAR AS reason FROM m WHERE why IS NULL UNION ALL "
    "SELECT project, 'current', CASE WHEN why IS NULL THEN revision + 1 ELSE revision END, CASE WHEN why IS NULL THEN 2 ELSE 1 END, CASE WHEN why IS NOT NULL THEN digest END, NULL FROM m UNION ALL "
    "SELECT project, 'refused', NULL, NULL, NULL, why FROM m WHERE why IN ('conflict', 'unfinished job')"
)
def v03_snapshot_reopen(spark, sf_dir):
    """Customers as frozen projects; their first orders ask for them at a revision; machinery has an unfinished job."""
    customer = table(spark, sf_dir, "customer")
    projects = customer.select(
        F.col("c_custkey").alias("project"), (F.col("c_custkey") % 3).alias("revision"), F.md5("c_name").alias("digest"), F.lit(1).alias("version"), F.lit(True).alias("frozen"),
        F.lit(None).cast("string").alias("parent"), F.lit("review").alias("review"), F.lit("plan").alias("plan"), F.lit(True).alias("accepted"),
    )
    asked = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("project")).agg((F.min("o_orderkey") % 3).alias("revision"))
    requests = asked.join(projects.select("project", "digest"), "project").withColumn("reason", F.lit("more sources"))
    jobs = customer.where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("project"), F.lit("paused").alias("status"))
    archived, after, refused = versions.reopened(projects, requests, jobs)
    none = lambda kind: F.lit(None).cast(kind)
    old = archived.select("project", F.lit("archived").alias("row"), "revision", F.col("archived_version").alias("version"), "digest", none("string").alias("reason"))
    new = after.select("project", F.lit("current").alias("row"), "revision", "version", "digest", none("string").alias("reason"))
    left = refused.select("project", F.lit("refused").alias("row"), none("bigint").alias("revision"), none("int").alias("version"), none("string").alias("digest"), "reason")
    return old.unionByName(new).unionByName(left)
