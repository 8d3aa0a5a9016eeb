"""Rules and patches of drafts: rule catalogs, labels, line edits, bindings, restores, scopes, archive flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.plans.staging import task_count

# Headings that name a metadata section.
INFO_LABELS = ("文章标题、作者与机构信息", "作者与机构信息", "作者及机构信息", "出版信息", "文章元数据", "文献元数据", "Author Affiliations", "Publication Information", "Article Metadata")


def rule_catalog(files: DataFrame, formula_file: str) -> DataFrame:
    """(material, rule, file, text) of files(material, file, text): bullet lines under a named rule, and the numbered bullets of the formula file.

    Of a rule that occurs again in its material, the last line counts.
    """
    lines = files.select("material", "file", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).hint("merge")
    pattern = r"^- `((?:FMT|EXPL)-\d+)` (.+)$"
    named = lines.withColumn("rule", F.regexp_extract("line", pattern, 1)).where("rule <> ''").withColumn("said", F.regexp_extract("line", pattern, 2))
    last = named.groupBy("material", "rule").agg(F.max(F.struct("file", "line_no", "said")).alias("last")).select("material", "rule", F.col("last.file").alias("file"), F.col("last.said").alias("text"))
    bullets = lines.where((F.col("file") == formula_file) & F.col("line").startswith("- "))
    nth = F.row_number().over(Window.partitionBy("material").orderBy("line_no"))
    return last.unionByName(bullets.select("material", F.format_string("FORMULA-%03d", nth).alias("rule"), "file", F.substring("line", F.lit(3), F.length("line")).alias("text")))


def info_label(markdown: Column) -> Column:
    """The metadata heading that a block begins with, if it has only that heading; else null."""
    first = F.regexp_extract(markdown, r"\A\s*(#[^\n]*)", 1)
    label = F.trim(F.regexp_replace(first, "^#+", ""))
    alone = F.regexp_count(markdown, F.lit(r"(?m)^ {0,3}#{1,6}(\s|$)")) == 1
    return F.when(label.isin(*INFO_LABELS) & alone, label)


def line_edits(edits: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edits to apply, refused batches with their reason): a batch that edits a line twice, or one out of its scope, is refused as a whole.

    ``edits(batch, line_id, replacement)``, ``lines(batch, line_id, block_id, text)``.  A heading keeps its level and holds a Han character; edits
    that change nothing are dropped.
    """
    level = lambda c: F.length(F.regexp_extract(c, r"^ {0,3}(#{1,6})\s", 1))
    met = edits.withColumn("n", F.count("*").over(Window.partitionBy("batch", "line_id"))).hint("merge").join(lines, ["batch", "line_id"], "left")
    wrong_heading = (level("text") > 0) & ((level("replacement") != level("text")) | ~F.col("replacement").rlike(r"[\x{3400}-\x{9FFF}]"))
    fault = F.when(F.col("n") > 1, "repeated line").when(F.col("text").isNull(), "out of scope").when(wrong_heading, "other heading")
    judged = met.withColumn("fault", fault)
    refused = judged.where("fault is not null").groupBy("batch").agg(F.min("fault").alias("reason"))
    left = judged.hint("merge").join(refused, "batch", "left_anti").where("text <> replacement")
    return left.select("batch", "line_id", "block_id", F.col("text").alias("old"), F.col("replacement").alias("new")), refused


def bound_once(assignments: DataFrame, blocks: DataFrame) -> DataFrame:
    """Assignments(item, block) with ``verdict``: an item goes to one known block."""
    known = blocks.select("block").distinct().withColumn("known", F.lit(True))
    met = assignments.withColumn("n", F.count("*").over(Window.partitionBy("item"))).hint("merge").join(known, "block", "left")
    return met.select("item", "block", F.when(F.col("known").isNull(), "unknown block").when(F.col("n") > 1, "assigned twice").otherwise("accepted").alias("verdict"))


def follow_verdicts(relations: DataFrame, units: DataFrame) -> DataFrame:
    """Relations(unit, follows, reason) with ``verdict``: a unit follows only an earlier known one, and says why; ``units(unit, ord)``."""
    here = units.select("unit", "ord")
    there = units.select(F.col("unit").alias("follows"), F.col("ord").alias("before"))
    met = relations.hint("merge").join(here, "unit", "left").join(there.hint("merge"), "follows", "left")
    verdict = (
        F.when(F.col("ord").isNull() | F.col("before").isNull(), "unknown unit")
        .when(F.col("unit") == F.col("follows"), "self")
        .when(F.col("before") >= F.col("ord"), "later unit")
        .when(F.trim(F.coalesce("reason", F.lit(""))) == "", "no reason")
        .otherwise("accepted")
    )
    return met.select("unit", "follows", verdict.alias("verdict"))


def restored_versions(current: DataFrame, history: DataFrame, requests: DataFrame, content: list[str]) -> tuple[DataFrame, DataFrame]:
    """(current rows after the restores, refusals): the content of an old version becomes a new revision that awaits review.

    ``current(material, revision, is_active, content...)``, ``history(material, version, content...)``, ``requests(material, version, revision)``, one for a material.
    An active material, another revision, or an unknown version is refused.
    """
    old = history.select("material", "version", F.struct(*content).alias("old"))
    asked = requests.withColumnRenamed("revision", "asked")
    met = current.hint("merge").join(asked, "material", "left").join(old.hint("merge"), ["material", "version"], "left")
    why = F.when(F.col("version").isNull(), None).when(F.col("old").isNull(), "unknown version").when(F.col("is_active") | (F.col("asked") != F.col("revision")), "conflict")
    judged = met.withColumn("why", why).withColumn("go", F.col("version").isNotNull() & F.col("why").isNull())
    state = F.when(F.col("go"), "restored").otherwise("as it was")
    after = judged.select("material", (F.col("revision") + F.when(F.col("go"), 1).otherwise(0)).alias("revision"), *(F.when(F.col("go"), F.col(f"old.{c}")).otherwise(F.col(c)).alias(c) for c in content), state.alias("state"), F.when(F.col("go"), F.col("version")).alias("restored_from"))
    return after, judged.where("why is not null").select("material", F.col("why").alias("reason"))


def previous_positions(current: DataFrame, earlier: DataFrame, markers: DataFrame) -> DataFrame:
    """(id, marker, version): the latest earlier version that had a marker exactly once, on a line of its own, and without it is the current text.

    ``current(id, text)``, ``earlier(id, version, text)``, ``markers(id, marker)``; a marker that the current text holds has no previous place.
    """
    now = current.select("id", F.col("text").alias("now"))
    met = markers.hint("merge").join(now, "id").where(~F.contains("now", F.col("marker"))).join(earlier.hint("merge"), "id")
    around = F.split("text", F.concat(F.lit("\\Q"), F.col("marker"), F.lit("\\E")), -1)
    head, tail = F.get("around", 0), F.get("around", 1)
    own_line = head.rlike(r"(^|\n)[ \t]*$") & tail.rlike(r"^[ \t]*(\r?\n|$)")
    without_line = F.concat(F.regexp_replace(head, r"[ \t]*$", ""), F.regexp_replace(tail, r"^[ \t]*(\r?\n|$)", ""))
    fits = met.withColumn("around", around).where((F.size("around") == 2) & own_line & ((F.concat(head, tail) == F.col("now")) | (without_line == F.col("now"))))
    return fits.groupBy("id", "marker").agg(F.max("version").alias("version"))


def resolved_notes(notes: DataFrame, passed: DataFrame, moved: DataFrame) -> DataFrame:
    """Notes(unit, block, kind, at) with ``resolved`` and why: a format note once its own unit passed later; a placement note once its block is proven moved.

    ``passed(unit, at)``, ``moved(block)``.
    """
    last = passed.groupBy("unit").agg(F.max("at").alias("passed_at"))
    there = moved.select("block").distinct().withColumn("is_moved", F.lit(True))
    met = notes.hint("merge").join(last, "unit", "left").join(there.hint("merge"), "block", "left")
    why = F.when((F.col("kind") == "format") & (F.col("passed_at") > F.col("at")), "same unit passed").when((F.col("kind") == "placement") & F.col("is_moved"), "moved to end matter")
    return met.withColumns({"why": why, "resolved": why.isNotNull()}).drop("passed_at", "is_moved")


def repair_scopes(findings: DataFrame, plan: DataFrame, replan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units to repair in plan order, refused plans with their reason).

    ``findings(plan, unit)``, ``plan(plan, unit, ord, body)``, ``replan(plan, unit, ord, body)``.  A plan without findings, or with one of an unknown unit, is refused, and
    so is a replan that moves, drops or alters a unit that no finding cites.
    """
    cited = findings.select("plan", "unit").distinct()
    unknown = cited.hint("merge").join(plan.select("plan", "unit"), ["plan", "unit"], "left_anti").select("plan", F.lit("unknown unit").alias("reason"))
    empty = plan.select("plan").distinct().hint("merge").join(cited.select("plan").distinct(), "plan", "left_anti").select("plan", F.lit("no finding").alias("reason"))
    others = plan.hint("merge").join(cited, ["plan", "unit"], "left_anti")
    new = replan.select("plan", "unit", F.col("ord").alias("new_ord"), F.col("body").alias("new_body"))
    changed = others.hint("merge").join(new, ["plan", "unit"], "left").where(~(F.col("ord").eqNullSafe(F.col("new_ord")) & F.col("body").eqNullSafe(F.col("new_body")))).select("plan", F.lit("other units changed").alias("reason"))
    refused = unknown.unionByName(empty).unionByName(changed).groupBy("plan").agg(F.min("reason").alias("reason"))
    scope = plan.hint("merge").join(cited, ["plan", "unit"], "left_semi").hint("merge").join(refused, "plan", "left_anti")
    return scope.select("plan", "unit", F.row_number().over(Window.partitionBy("plan").orderBy("ord")).alias("place")), refused


def covered_plans(units: DataFrame, missing: DataFrame, assigned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts of each unit after the patch, refused plans): every missing fact goes once to a known unit, and nothing else does.

    ``units(plan, unit, fact)``, ``missing(plan, fact)``, ``assigned(plan, fact, unit)``; the result only adds.  Units are counted, and tables dealt
    over so many tasks that a task has about as many rows at any size.
    """
    n_tasks = task_count(units)
    by_fact = lambda df: df.repartition(n_tasks, "plan", "fact")
    counted = by_fact(assigned.select("plan", "fact")).groupBy("plan", "fact").agg(F.count("*").alias("n"))
    met = by_fact(missing.select("plan", "fact")).distinct().withColumn("asked", F.lit(True)).hint("merge").join(counted, ["plan", "fact"], "full")
    fault = F.when(F.col("asked").isNull(), "fact not missing").when(F.col("n").isNull(), "fact not assigned").when(F.col("n") > 1, "assigned twice")
    uneven = met.select("plan", fault.alias("reason")).where("reason is not null")
    known = units.select("plan", "unit").repartition(n_tasks, "plan", "unit")
    unknown = assigned.select("plan", "unit").repartition(n_tasks, "plan", "unit").hint("merge").join(known, ["plan", "unit"], "left_anti").select("plan", F.lit("unknown unit").alias("reason"))
    refused = uneven.unionByName(unknown).repartition(n_tasks, "plan").groupBy("plan").agg(F.min("reason").alias("reason"))
    added = assigned.select("plan", "unit", "fact").repartition(n_tasks, "plan").hint("merge").join(refused, "plan", "left_anti")
    return units.select("plan", "unit", "fact").unionByName(added), refused


def merged_groups(parts: DataFrame) -> DataFrame:
    """(material, group_id, members): the groups of all partitions in one list, ``group-n-`` before their ids, n the partition's place.

    ``parts(material, part, group_id, members)``.
    """
    place = F.dense_rank().over(Window.partitionBy("material").orderBy("part"))
    return parts.select("material", F.concat(F.lit("group-"), place, F.lit("-"), "group_id").alias("group_id"), "members")


def campaign_totals(calls: DataFrame, declared: DataFrame) -> DataFrame:
    """(campaign, calls, materials, amount, unknown, complete, reconciled) of calls(campaign, material, amount) and declared(campaign, calls).

    Amounts sum what is known; complete if nothing is unknown; reconciled if the declared number of calls is the counted one.
    """
    found = calls.groupBy("campaign").agg(F.count("*").alias("calls"), F.count_distinct("material").alias("materials"), F.sum("amount").alias("amount"), F.count_if(F.col("amount").isNull()).alias("unknown"))
    met = found.hint("merge").join(declared.select("campaign", F.col("calls").alias("said")), "campaign", "full")
    n = F.coalesce("calls", F.lit(0))
    return met.select("campaign", n.alias("calls"), F.coalesce("materials", F.lit(0)).alias("materials"), "amount", F.coalesce("unknown", F.lit(0)).alias("unknown"), (F.coalesce("unknown", F.lit(0)) == 0).alias("complete"), F.coalesce(F.col("said") == n, F.lit(False)).alias("reconciled"))


def archive_changes(items: DataFrame, requests: DataFrame) -> DataFrame:
    """(id, archived, reason): items after requests to archive or bring back, apart from the trash.

    ``items(id, parent, name_key, archived, trashed)``, ``requests(id, archive)``.  What comes back must not meet a visible sibling (neither archived nor
    trashed, and staying so) of its name, nor another one that comes back.
    """
    met = items.hint("merge").join(requests, "id", "left")
    back = F.col("archived") & ~F.coalesce("archive", F.lit(True)) & ~F.col("trashed")
    stays = ~F.col("archived") & ~F.col("trashed") & ~F.coalesce("archive", F.lit(False))
    siblings = Window.partitionBy("parent", "name_key")
    seen = met.withColumns({"back": back, "company": F.sum(F.when(stays | back, 1).otherwise(0)).over(siblings)})
    refused = F.col("back") & (F.col("company") > 1)
    return seen.select("id", F.when(refused, F.col("archived")).otherwise(F.coalesce("archive", "archived")).alias("archived"), F.when(refused, "collision").alias("reason"))
