"""Queries of rule catalogs, labels, edits, bindings, restores, repair scopes, campaign totals and archive flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import drafting as op
from tracewell.plans.staging import task_count
from tracewell.registry import query
from tracewell.sources.model import BLOCKS_SQL, OBJECTS_SQL, blocks, objects, table


@query(
    "WITH d AS (SELECT doc_id AS material, CASE doc_id % 10 WHEN 0 THEN 'formulas.md' ELSE 'style.md' END AS file, regexp_extract(coalesce(text, ''), '[A-Za-z]+') AS w FROM documents) "
    "SELECT material, 'FMT-1' AS rule, file, 'later ' || w AS text FROM d UNION ALL SELECT material, 'EXPL-22', file, 'why ' || w FROM d UNION ALL "
    "SELECT material, printf('FORMULA-%03d', n), file, t FROM (SELECT material, file, unnest(['`FMT-1` first ' || w, 'plain ' || w, '`EXPL-22` why ' || w, '`FMT-1` later ' || w]) AS t, unnest([1, 2, 3, 4]) AS n FROM d WHERE file = 'formulas.md')"
)
def t27_rule_catalog(spark, sf_dir):
    """A rule file for each document; every tenth is the formula file, whose bullets are numbered as well."""
    docs = table(spark, sf_dir, "documents").withColumn("w", F.regexp_extract(F.coalesce("text", F.lit("")), "[A-Za-z]+", 0))
    text = F.concat(F.lit("# rules\n- `FMT-1` first "), "w", F.lit("\n- plain "), "w", F.lit("\n- `EXPL-22` why "), "w", F.lit("\n - `FMT-9` indented\n- `FMT-1` later "), "w", F.lit("\n-no bullet"))
    files = docs.select(F.col("doc_id").alias("material"), F.when(F.col("doc_id") % 10 == 0, "formulas.md").otherwise("style.md").alias("file"), text.alias("text"))
    return op.rule_catalog(files, "formulas.md")


@query(f"WITH {BLOCKS_SQL} SELECT material_id, block_id, CASE (material_id + ord) % 4 WHEN 0 THEN '出版信息' WHEN 3 THEN 'Article Metadata' END AS label FROM blocks")
def t33_info_labels(spark, sf_dir):
    """Blocks under a metadata heading, one with a second heading, or one under another heading."""
    heads = F.array(F.lit("\n## 出版信息\n"), F.lit("# 出版信息\n\n## more\n"), F.lit("# Something else\n"), F.lit("### Article Metadata \n"))
    rows = blocks(spark, sf_dir)
    text = F.concat(F.element_at(heads, ((F.col("material_id") + F.col("ord")) % 4 + 1).cast("int")), F.regexp_replace("markdown", "#", ""))
    return rows.select("material_id", "block_id", op.info_label(text).alias("label"))


@query(
    f"WITH {BLOCKS_SQL}, b AS (SELECT material_id AS batch, block_id, CASE WHEN ord % 2 = 0 THEN '## 标题' ELSE 'line' END AS t, material_id % 5 AS k FROM blocks), one AS (SELECT batch, min(k) AS k, count(*) AS n, count(*) FILTER (t = 'line') AS plain FROM b GROUP BY batch) "
    "SELECT batch, CASE WHEN k = 0 OR (k = 3 AND n = plain) OR k = 4 THEN 'applied' ELSE 'refused' END AS state, CASE k WHEN 0 THEN n WHEN 3 THEN CASE WHEN n = plain THEN n ELSE 0 END WHEN 4 THEN 0 ELSE 0 END AS edits, "
    "CASE WHEN k = 1 THEN 'repeated line' WHEN k = 2 THEN 'out of scope' WHEN k = 3 AND n > plain THEN 'other heading' END AS reason FROM one"
)
def v08_line_edits(spark, sf_dir):
    """A line of each block, every other one a heading; batches edit all, one twice, one beyond, headings to another level, or nothing."""
    rows = blocks(spark, sf_dir).select(F.col("material_id").alias("batch"), "block_id", (F.col("ord") % 2 == 0).alias("is_heading"), (F.col("material_id") % 5).alias("k"))
    lines = rows.select("batch", F.col("block_id").alias("line_id"), "block_id", F.when(F.col("is_heading"), "## 标题").otherwise("line").alias("text"), "k")
    new = F.when(F.col("k") == 4, F.col("text")).when(F.col("text") == "line", "new line").when(F.col("k") == 3, "# 新标题").otherwise("## 新标题")
    edits = lines.select("batch", "line_id", new.alias("replacement"), "k")
    more = edits.where("k = 1").unionByName(edits.where("k = 2").withColumn("line_id", F.lit("elsewhere")).dropDuplicates(["batch"]))
    done, refused = op.line_edits(edits.unionByName(more).drop("k"), lines.drop("k"))
    n = done.groupBy("batch").agg(F.count("*").alias("edits"))
    met = rows.select("batch").distinct().join(n.hint("merge"), "batch", "left").join(refused.hint("merge"), "batch", "left")
    return met.select("batch", F.when(F.col("reason").isNull(), "applied").otherwise("refused").alias("state"), F.coalesce("edits", F.lit(0)).alias("edits"), "reason")


@query(
    "SELECT o_orderkey AS unit, o_custkey AS follows, CASE WHEN p.o_orderkey IS NULL THEN 'unknown unit' WHEN o.o_custkey = o.o_orderkey THEN 'self' WHEN o.o_custkey > o.o_orderkey THEN 'later unit' WHEN o.o_orderstatus = 'P' THEN 'no reason' ELSE 'accepted' END AS verdict "
    "FROM orders o LEFT JOIN (SELECT o_orderkey FROM orders) p ON p.o_orderkey = o.o_custkey".replace("SELECT o_orderkey AS unit, o_custkey", "SELECT o.o_orderkey AS unit, o.o_custkey")
)
def v10_dependency_patch(spark, sf_dir):
    """Orders as units that follow the unit of their customer's number; open ones give no reason."""
    orders = table(spark, sf_dir, "orders")
    relations = orders.select(F.col("o_orderkey").alias("unit"), F.col("o_custkey").alias("follows"), F.when(F.col("o_orderstatus") == "P", " ").otherwise("why").alias("reason"))
    return op.follow_verdicts(relations, orders.select(F.col("o_orderkey").alias("unit"), F.col("o_orderkey").alias("ord")))


@query("WITH n AS (SELECT l_orderkey, l_partkey, l_linenumber, count(*) OVER (PARTITION BY l_partkey) AS n FROM lineitem) SELECT l_partkey AS item, l_orderkey AS block, CASE WHEN o_orderkey IS NULL THEN 'unknown block' WHEN n > 1 THEN 'assigned twice' ELSE 'accepted' END AS verdict FROM n LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') o ON o_orderkey = l_orderkey")
def v10_binding_patch(spark, sf_dir):
    """Parts assigned to the orders that hold them; open orders are no blocks."""
    assigned = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("item"), F.col("l_orderkey").alias("block"))
    return op.bound_once(assigned, table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("block")))


@query(
    "WITH h AS (SELECT o_custkey AS material, o_orderkey AS version, o_orderpriority AS body, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS back FROM orders), "
    "c AS (SELECT material, version AS revision, body FROM h WHERE back = 1), f AS (SELECT material, version, body AS old FROM h WHERE nth = 1), "
    "m AS (SELECT c.*, version, old, CASE material % 4 WHEN 0 THEN 'unknown version' WHEN 1 THEN 'conflict' WHEN 2 THEN 'conflict' END AS why FROM c JOIN f USING (material)) "
    "SELECT material, CASE WHEN why IS NULL THEN revision + 1 ELSE revision END AS revision, CASE WHEN why IS NULL THEN old ELSE body END AS body, CASE WHEN why IS NULL THEN version END AS restored_from, why AS reason FROM m"
)
def v16_restore(spark, sf_dir):
    """Each customer's orders as versions: the first one is asked back, of an unknown number, on an old revision, or while active."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("material"), F.col("o_orderkey").alias("version"), F.col("o_orderpriority").alias("body"))
    ends = orders.groupBy("material").agg(F.max(F.struct("version", "body")).alias("now"), F.min("version").alias("first"))
    case = F.col("material") % 4
    current = ends.select("material", F.col("now.version").alias("revision"), (case == 2).alias("is_active"), F.col("now.body").alias("body"))
    requests = ends.select("material", F.when(case == 0, -1).otherwise(F.col("first")).alias("version"), F.when(case == 1, F.col("now.version") - 1).otherwise(F.col("now.version")).alias("revision"))
    after, refused = op.restored_versions(current, orders, requests, ["body"])
    return after.drop("state").join(refused.hint("merge"), "material", "left")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 4 IN (0, 1) THEN 2 ELSE 1 END AS version FROM documents WHERE text IS NOT NULL AND doc_id % 4 <> 3")
def v17_previous_position(spark, sf_dir):
    """Documents whose two earlier versions held a marker on a line of its own, once, twice, inside a line, or with other text."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("id"), "text", (F.col("doc_id") % 4).alias("k"))
    marker = F.concat(F.lit("{{source:s"), "id", F.lit("}}"))
    first = F.concat(marker, F.lit("\n"), "text")
    second = F.when(F.col("k") == 0, F.concat("text", F.lit("\n"), marker)).when(F.col("k") == 1, F.concat(F.lit(" "), first)).when(F.col("k") == 2, F.concat(first, F.lit("\n"), marker)).otherwise(F.concat(F.lit("x "), first))
    current = docs.select("id", F.when(F.col("k") == 0, F.concat("text", F.lit("\n"))).otherwise(F.col("text")).alias("text"))
    base = F.when(F.col("k") == 0, F.concat(first, F.lit("\n"))).when(F.col("k") == 3, F.concat(first, F.lit("y"))).otherwise(first)
    earlier = docs.select("id", F.lit(1).alias("version"), base.alias("text")).unionByName(docs.select("id", F.lit(2).alias("version"), second.alias("text")))
    return op.previous_positions(current, earlier, docs.select("id", marker.alias("marker"))).select("id", "version")


@query(
    "WITH e AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day, ts, event_type FROM events), p AS (SELECT user_id, day, max(ts) AS passed FROM e WHERE event_type = 'purchase' GROUP BY ALL) "
    "SELECT event_id, CASE WHEN event_type = 'error' AND passed > ts THEN 'same unit passed' WHEN event_type = 'click' AND event_id % 2 = 0 THEN 'moved to end matter' END AS why, "
    "coalesce((event_type = 'error' AND passed > ts) OR (event_type = 'click' AND event_id % 2 = 0), false) AS resolved FROM e LEFT JOIN p USING (user_id, day) WHERE event_type IN ('error', 'click')"
)
def v18_resolved_findings(spark, sf_dir):
    """Errors as format notes of a user's day, which a purchase on that day resolves; clicks as placement notes, half of whose blocks moved."""
    events = table(spark, sf_dir, "events").withColumn("unit", F.concat_ws("/", "user_id", F.to_date("ts")))
    kind = F.when(F.col("event_type") == "error", "format").otherwise("placement")
    notes = events.where(F.col("event_type").isin("error", "click")).select("event_id", "unit", F.col("event_id").alias("block"), kind.alias("kind"), F.col("ts").alias("at"))
    passed = events.where("event_type = 'purchase'").select("unit", F.col("ts").alias("at"))
    moved = events.where("event_type = 'click' and event_id % 2 = 0").select(F.col("event_id").alias("block"))
    return op.resolved_notes(notes, passed, moved).select("event_id", "why", "resolved")


@query(
    "WITH l AS (SELECT l_orderkey AS plan, l_linenumber AS unit, bool_or(l_returnflag = 'R') AS cited FROM lineitem GROUP BY ALL), c AS (SELECT plan, bool_or(cited) AS any_cited, bool_and(cited) AS all_cited FROM l GROUP BY plan), "
    "r AS (SELECT plan, CASE WHEN NOT any_cited THEN 'no finding' WHEN plan % 5 = 0 AND NOT all_cited THEN 'other units changed' WHEN plan % 7 = 0 THEN 'unknown unit' END AS reason FROM c) "
    "SELECT plan, unit, row_number() OVER (PARTITION BY plan ORDER BY unit) AS place, NULL AS reason FROM l JOIN r USING (plan) WHERE cited AND reason IS NULL UNION ALL SELECT plan, NULL, NULL, reason FROM r WHERE reason IS NOT NULL"
)
def a31_repair_scope(spark, sf_dir):
    """Orders as plans, returned lines as findings; every fifth replan alters all lines, every seventh plan has a finding of no line."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("plan"), F.col("l_linenumber").alias("unit")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("cited"))
    lines = lines.select("plan", "unit", F.col("unit").alias("ord"), F.lit("body").alias("body"), "cited")
    cited = lines.where("cited").select("plan", "unit")
    beyond = cited.where("plan % 7 = 0").select("plan", (F.col("unit") * 0 + 99).alias("unit")).distinct()
    replan = lines.withColumn("body", F.when(F.col("plan") % 5 == 0, "altered").otherwise(F.col("body")))
    scope, refused = op.repair_scopes(cited.unionByName(beyond), lines.drop("cited"), replan.drop("cited"))
    return scope.withColumn("reason", F.lit(None).cast("string")).unionByName(refused.withColumns({"unit": F.lit(None).cast("int"), "place": F.lit(None).cast("int")}).select("plan", "unit", "place", "reason"))


@query(
    "WITH u AS (SELECT l_orderkey AS plan, l_linenumber AS unit FROM lineitem), m AS (SELECT plan, count(*) AS units, plan % 6 AS k FROM u GROUP BY plan) "
    "SELECT plan, units + CASE WHEN k IN (0, 5) THEN 2 ELSE 0 END AS facts, CASE k WHEN 1 THEN 'assigned twice' WHEN 2 THEN 'fact not assigned' WHEN 3 THEN 'fact not missing' WHEN 4 THEN 'unknown unit' END AS reason FROM m"
)
def a32_coverage_patch(spark, sf_dir):
    """Orders as plans whose lines hold a fact each; two facts are missing, and assigned well in two of six."""
    units = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("plan"), F.col("l_linenumber").cast("string").alias("unit"), F.concat(F.lit("f"), "l_linenumber").alias("fact"))
    plans = units.select("plan", "unit").repartition(task_count(units), "plan").groupBy("plan").agg(F.min("unit").alias("unit")).withColumn("k", F.col("plan") % 6)
    missing = plans.select("plan", F.explode(F.array(F.lit("m1"), F.lit("m2"))).alias("fact"))
    facts = F.when(F.col("k") == 1, F.array(F.lit("m1"), F.lit("m2"), F.lit("m2"))).when(F.col("k") == 2, F.array(F.lit("m1"))).when(F.col("k") == 3, F.array(F.lit("m1"), F.lit("m2"), F.lit("f1"))).otherwise(F.array(F.lit("m1"), F.lit("m2")))
    assigned = plans.select("plan", F.explode(facts).alias("fact"), F.when(F.col("k") == 4, "none").otherwise(F.col("unit")).alias("unit"))
    after, refused = op.covered_plans(units, missing, assigned)
    return after.groupBy("plan").agg(F.count("*").alias("facts")).join(refused.hint("merge"), "plan", "left")


@query(
    f"WITH {OBJECTS_SQL}, g AS (SELECT material_id AS material, kind AS part, 'g' || (ord % 3) AS id, count(*) AS members FROM objects GROUP BY ALL) "
    "SELECT material, 'group-' || dense_rank() OVER (PARTITION BY material ORDER BY part) || '-' || id AS group_id, members FROM g"
)
def a26_group_merge(spark, sf_dir):
    """Each document's lines grouped apart for each kind, then in one list."""
    parts = objects(spark, sf_dir).groupBy(F.col("material_id").alias("material"), F.col("kind").alias("part"), F.concat(F.lit("g"), F.col("ord") % 3).alias("group_id")).agg(F.count("*").alias("members"))
    return op.merged_groups(parts)


@query(
    "WITH c AS (SELECT c_mktsegment AS campaign, o_custkey AS material, CASE WHEN o_orderstatus <> 'P' OR c_mktsegment = 'BUILDING' THEN o_totalprice END AS amount FROM orders JOIN customer ON c_custkey = o_custkey), "
    "t AS (SELECT campaign, count(*) AS calls, count(DISTINCT material) AS materials, sum(amount) AS amount, count(*) FILTER (amount IS NULL) AS unknown FROM c GROUP BY 1) "
    "SELECT campaign, calls, materials, round(amount, 0) AS amount, unknown, unknown = 0 AS complete, campaign <> 'MACHINERY' AS reconciled FROM t UNION ALL SELECT 'none', 0, 0, NULL, 0, true, false"
)
def l08_campaign_totals(spark, sf_dir):
    """Segments as campaigns; open orders have no known amount but in one; one declares a call too many, and one without calls declares some."""
    segments = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("campaign"))
    calls = table(spark, sf_dir, "orders").join(segments, "o_custkey").select("campaign", F.col("o_custkey").alias("material"), F.when((F.col("o_orderstatus") != "P") | (F.col("campaign") == "BUILDING"), F.col("o_totalprice")).alias("amount"))
    declared = calls.groupBy("campaign").agg((F.count("*") + F.when(F.col("campaign") == "MACHINERY", 1).otherwise(0)).alias("calls"))
    declared = declared.unionByName(spark.createDataFrame([("none", 3)], "campaign string, calls long"))
    return op.campaign_totals(calls, declared).withColumn("amount", F.round("amount", 0))


@query(
    "WITH i AS (SELECT c_custkey AS id, c_nationkey AS parent, c_custkey % 50 AS name_key, c_acctbal < 3000 AS archived, c_mktsegment = 'MACHINERY' AS trashed, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal >= 3000 END AS archive FROM customer), "
    "s AS (SELECT *, archived AND NOT coalesce(archive, true) AND NOT trashed AS back, NOT archived AND NOT trashed AND NOT coalesce(archive, false) AS stays FROM i), "
    "n AS (SELECT *, sum((back OR stays)::INT) OVER (PARTITION BY parent, name_key) AS company FROM s) "
    "SELECT id, CASE WHEN back AND company > 1 THEN archived ELSE coalesce(archive, archived) END AS archived, CASE WHEN back AND company > 1 THEN 'collision' END AS reason FROM n"
)
def h09_archive_flags(spark, sf_dir):
    """Customers of a nation as siblings; every third asks for the other state."""
    customer = table(spark, sf_dir, "customer")
    archived = F.col("c_acctbal") < 3000
    items = customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("parent"), (F.col("c_custkey") % 50).alias("name_key"), archived.alias("archived"), (F.col("c_mktsegment") == "MACHINERY").alias("trashed"))
    return op.archive_changes(items, customer.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), (~archived).alias("archive")))
