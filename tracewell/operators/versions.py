"""Versions, patches and idempotency as batch joins over version tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged(current: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new current rows, conflicts): the first update on the current revision wins, all others conflict."""
    met = updates.join(current.select("key", F.col("revision").alias("now")), "key", "left")
    fits = F.col("base_revision") == F.col("now")
    nth = F.row_number().over(Window.partitionBy("key", "base_revision").orderBy("ts", "update_id"))
    ranked = met.withColumn("wins", F.coalesce(fits, F.lit(False)) & (nth == 1))
    winners = ranked.where("wins").select("key", (F.col("base_revision") + 1).alias("new_revision"), F.col("body").alias("new_body"))
    new = current.join(winners, "key", "left").select("key", F.coalesce("new_revision", "revision").alias("revision"), F.coalesce("new_body", "body").alias("body"))
    return new, ranked.where("not wins").select("update_id", "key", "base_revision", "now")


def first_writes(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Append-only: the first write of a key stays."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("nth = 1").drop("nth")


def applied(blocks: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new blocks, verdicts): a patch applies as a whole or not at all.

    Each edit must name a known block once and find its exact old text.
    """
    current = blocks.select("material_id", "block_id", "markdown")
    met = edits.join(current, ["material_id", "block_id"], "left").withColumn("n", F.count("*").over(Window.partitionBy("patch_id", "block_id")))
    fault = F.when(F.col("markdown").isNull(), "unknown block").when(F.col("n") > 1, "repeated").when(F.col("markdown") != F.col("old"), "stale").when(F.col("old") == F.col("new"), "no-op")
    verdicts = met.withColumn("fault", fault).groupBy("patch_id").agg(F.bool_and(F.col("fault").isNull()).alias("applied"), F.min("fault").alias("fault"))
    good = edits.join(verdicts.where("applied").select("patch_id"), "patch_id", "left_semi").select("material_id", "block_id", "new")
    return blocks.join(good, ["material_id", "block_id"], "left").withColumn("markdown", F.coalesce("new", "markdown")).drop("new"), verdicts


def local_repairs(texts: DataFrame, edits: DataFrame) -> DataFrame:
    """(patch_id, id, text): texts in which each old text hits exactly once, within one line; else the patch is refused (null)."""
    met = edits.join(texts, "id")
    hits = (F.char_length("text") - F.char_length(F.replace("text", F.col("old"), F.lit("")))) / F.greatest(F.char_length("old"), F.lit(1))
    once = (F.col("old") != "") & (hits == 1) & ~F.contains("old", F.lit("\n")) & (F.col("old") != F.col("new"))
    return met.select("patch_id", "id", F.when(once, F.replace("text", F.col("old"), F.col("new"))).alias("text"))


def replayed(commits: DataFrame) -> DataFrame:
    """(commit_id, verified): the text before, with its one edit, has the digest that the commit recorded."""
    after = F.replace("before", F.col("old"), F.col("new"))
    return commits.select("commit_id", (F.sha2(after, 256) == F.col("after_sha256")).alias("verified"))


def unchanged_prefix(old: DataFrame, new: DataFrame) -> DataFrame:
    """(material_id, extends): the new draft begins with all old blocks, unchanged."""
    n = new.select("material_id", "ord", F.col("markdown").alias("new_markdown"))
    met = old.join(n, ["material_id", "ord"], "left")
    return met.groupBy("material_id").agg(F.bool_and(F.coalesce(F.col("markdown") == F.col("new_markdown"), F.lit(False))).alias("extends"))


def owned_once(claims: DataFrame) -> DataFrame:
    """Each obligation belongs to the first node that claims it: (obligation_id, node_id)."""
    return first_writes(claims, ["obligation_id"], ["ord", "node_id"]).select("obligation_id", "node_id")


def prerequisite_closure(requires: DataFrame) -> DataFrame:
    """(concept, needs, distance) for all direct and indirect prerequisites, by the shortest way; a cycle leads back once.

    With all distances up to d known, the ways of d + 1 to 2 d steps begin with one of exactly d: only those pairs are joined with the closure, so a
    round doubles the distance and makes a way about once.  Rounds are written, and go on until no pair has the distance d.
    """
    from tracewell.plans.staging import stage

    every, reach = stage(requires.select("concept", "needs").distinct().withColumn("distance", F.lit(1)), "closure"), 1
    while True:
        furthest = every.where(F.col("distance") == reach).select("concept", F.col("needs").alias("via"))
        if furthest.isEmpty():
            return every
        onward = every.select(F.col("concept").alias("via"), "needs", (F.col("distance") + reach).alias("distance"))
        longer = furthest.hint("merge").join(onward, "via").select("concept", "needs", "distance")
        every = stage(every.unionByName(longer).groupBy("concept", "needs").agg(F.min("distance").alias("distance")), "closure")
        reach *= 2


def carried_forward(records: DataFrame, blocks: DataFrame) -> DataFrame:
    """Comparisons follow a new version if their block's text has not changed."""
    now = blocks.select("material_id", "block_id", F.sha2("markdown", 256).alias("now"))
    return records.join(now, ["material_id", "block_id"]).where("digest = now").drop("now")


def undoable(actions: DataFrame) -> DataFrame:
    """Only the latest action of an active version may be undone: adds ``can_undo``."""
    nth = F.row_number().over(Window.partitionBy("material_id").orderBy(F.desc("ts"), F.desc("action_id")))
    return actions.withColumn("can_undo", (nth == 1) & F.col("active"))


def reopened(projects: DataFrame, requests: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(archived states, projects after, refusals (project, reason)) of requests to change the frozen sources.

    ``projects(project, revision, digest, version, frozen, parent, review, plan, accepted)``, ``requests(project, revision, digest, reason)``, one for
    a project, ``jobs(project, status)``.  A request whose revision or digest is not the current one conflicts; uncertain or paused
    jobs come first.  What is granted archives the whole state and begins the next version, unfrozen, with the old digest as parent.
    """
    held = jobs.where(F.col("status").isin("uncertain", "paused")).select("project").distinct().withColumn("held", F.lit(True))
    now = projects.select("project", F.col("revision").alias("now"), F.col("digest").alias("now_digest"))
    met = requests.hint("merge").join(now, "project", "left").join(held.hint("merge"), "project", "left")
    fits = F.coalesce((F.col("revision") == F.col("now")) & (F.col("digest") == F.col("now_digest")), F.lit(False))
    why = F.when(F.col("now").isNull(), "unknown project").when(~fits, "conflict").when(F.col("held"), "unfinished job")
    judged = met.withColumn("why", why)
    granted = judged.where("why is null").select("project", F.col("reason").alias("reopened_for"))
    archived = projects.hint("merge").join(granted.select("project"), "project", "left_semi").withColumnRenamed("version", "archived_version")
    go = F.col("reopened_for").isNotNull()
    after = projects.hint("merge").join(granted, "project", "left").select(
        "project",
        (F.col("revision") + F.when(go, 1).otherwise(0)).alias("revision"),
        F.when(~go, F.col("digest")).alias("digest"),
        (F.col("version") + F.when(go, 1).otherwise(0)).alias("version"),
        (F.col("frozen") & ~go).alias("frozen"),
        F.when(go, F.col("digest")).otherwise(F.col("parent")).alias("parent"),
        *(F.when(~go, F.col(c)).alias(c) for c in ("review", "plan", "accepted")),
    )
    return archived, after, judged.where("why is not null").select("project", F.col("why").alias("reason"))
