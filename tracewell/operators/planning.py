"""Plans of writing units: dependencies bridged over removed units, and an order of concepts.

Both work on edge tables.  Removed units are contracted by pointer jumping, so a chain of n of them takes some log n rounds; levels of
concepts are peeled, a round for each level; cycles are what peeling from both sides leaves.  Each round is written before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.tree import reached
from tracewell.plans.staging import stage


def bridged(nodes: DataFrame, depends: DataFrame) -> DataFrame:
    """(node, needs): what each kept node depends on once removed ones are taken out, each pair once.

    ``nodes(node, kept)``, ``depends(node, needs)``.  A dependency on a removed node becomes one on what that node depends on, however many of
    them follow one another; removed nodes in a cycle lead nowhere besides.  A dependency on an unknown node stays.
    """
    edges = depends.select("node", "needs").where("node <> needs").distinct()
    kept = nodes.select(F.col("node").alias("needs"), "kept")
    told = edges.hint("merge").join(kept, "needs", "left").withColumn("live", F.coalesce("kept", F.lit(True))).drop("kept")
    told = told.hint("merge").join(nodes.select("node", F.col("kept").alias("own")), "node")
    told = stage(told, "edges")
    removed = told.where("not own")
    # what removed nodes lead to: live nodes so far, and removed nodes 2 ** k steps on
    final, open_ = stage(removed.where("live").select("node", "needs"), "final"), stage(removed.where("not live").select("node", "needs"), "open")
    before = None
    while True:
        now = final.count()
        if now == before or open_.isEmpty():
            break
        before = now
        step = open_.select("node", F.col("needs").alias("via"))
        further = step.hint("merge").join(final.withColumnRenamed("node", "via"), "via").select("node", "needs")
        jump = step.hint("merge").join(open_.withColumnRenamed("node", "via"), "via").select("node", "needs").distinct()
        final, open_ = stage(final.unionByName(further).distinct(), "final"), stage(jump, "open")
    direct = told.where("own and live").select("node", "needs")
    over = told.where("own and not live").select("node", F.col("needs").alias("via")).hint("merge").join(final.withColumnRenamed("node", "via"), "via").select("node", "needs")
    return direct.unionByName(over).where("node <> needs").distinct()


def placements(units: DataFrame, concepts: DataFrame, uses: DataFrame) -> DataFrame:
    """(concept, place, why): where each concept is introduced, before prerequisites are looked at.

    ``units(place, source)``: sources that a unit bears; ``concepts(concept, planned, source)``: the place that is planned, or null, and a source that
    the concept is drawn from (one row each); ``uses(concept, place)``: units that require it.  A concept without a planned place goes to the first
    unit that bears one of its sources; one that is required earlier than introduced goes to where it is first used.  No place: null.
    """
    bearing = units.groupBy("source").agg(F.min("place").alias("place"))  # a row for each source: concepts never meet all its units
    borne = concepts.hint("merge").join(bearing, "source").groupBy("concept").agg(F.min("place").alias("borne"))
    first = uses.groupBy("concept").agg(F.min("place").alias("used"))
    met = concepts.groupBy("concept").agg(F.min("planned").alias("planned")).hint("merge").join(borne, "concept", "left").join(first.hint("merge"), "concept", "left")
    own = F.coalesce("planned", "borne")
    early = F.col("used") < own
    why = F.when(early, "first use").when(F.col("planned").isNotNull(), "planned").when(F.col("borne").isNotNull(), "first source").otherwise("no place")
    return met.select("concept", F.when(early, F.col("used")).otherwise(own).alias("place"), why.alias("why"))


def _peeled(edges: DataFrame, free: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(levels (concept, level), edges left): concepts whose needs are all met, round by round."""
    levels, level = stage(free.withColumn("level", F.lit(0)), "levels"), 0
    ready, left = levels.select("concept"), stage(edges, "needed")
    while not ready.isEmpty():
        level += 1
        met = ready.select(F.col("concept").alias("needs"))
        waiting = left.select("concept").distinct()
        left = stage(left.hint("merge").join(met, "needs", "left_anti"), "needed")
        ready = stage(waiting.hint("merge").join(left.select("concept").distinct(), "concept", "left_anti"), "ready")
        levels = levels.unionByName(ready.withColumn("level", F.lit(level)))
    return levels, left


def concept_order(placed: DataFrame, requires: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(order (concept, place, level, nth), faults (concept, reason)).

    ``placed(concept, place)``, ``requires(concept, needs)``.  A prerequisite that is placed after a concept that needs it, directly or not, moves to that
    concept's place.  Within a place concepts follow their prerequisites, then their names; ``nth`` counts over all places from 1.  Concepts
    in a cycle, those that need one, and those that need an unknown concept or one without a place have no order but a reason.
    """
    edges = requires.select("concept", "needs").distinct()
    known = placed.where("place IS NOT NULL").select("concept", "place")
    names = known.select("concept")
    edges = stage(edges.hint("merge").join(names, "concept", "left_semi"), "requires")
    unknown = edges.hint("merge").join(names.withColumnRenamed("concept", "needs"), "needs", "left_anti").select("concept").distinct()
    free = names.hint("merge").join(edges.select("concept").distinct(), "concept", "left_anti")
    levels, left = _peeled(edges, free)
    levels = stage(levels, "levels")
    # what peeling leaves: cycles, what needs them, and what needs something unknown; peeled from the other side, cycles and what lies between
    stuck = left.select("concept").distinct()
    turned = left.hint("merge").join(stuck.withColumnRenamed("concept", "needs"), "needs", "left_semi").select(F.col("needs").alias("concept"), F.col("concept").alias("needs"))
    unneeded = stuck.hint("merge").join(turned.select("concept").distinct(), "concept", "left_anti")
    _, core = _peeled(turned, unneeded)
    on = core.select(F.col("concept").alias("parent"), F.col("needs").alias("id"))
    looped = reached(on, on.select(F.col("parent").alias("root"), "id"), []).where("root = id").select(F.col("id").alias("concept")).distinct().withColumn("loops", F.lit(True))
    missing = unknown.withColumn("lacks", F.lit(True))
    told = stuck.hint("merge").join(looped, "concept", "left").join(missing.hint("merge"), "concept", "left")
    faults = told.select("concept", F.when(F.col("loops"), "cycle").when(F.col("lacks"), "unknown prerequisite").otherwise("needs a fault"))
    faults = faults.toDF("concept", "reason").unionByName(placed.where("place IS NULL").select("concept", F.lit("no place").alias("reason")))
    # prerequisites move forward, level by level from the last
    sound = stage(levels.hint("merge").join(known, "concept"), "places")
    deepest = sound.agg(F.max("level")).first()[0] or 0
    for level in range(deepest, 0, -1):
        ahead = sound.where(F.col("level") == level).select("concept", F.col("place").alias("sooner"))
        moved = ahead.hint("merge").join(edges, "concept").groupBy(F.col("needs").alias("concept")).agg(F.min("sooner").alias("sooner"))
        sound = stage(sound.hint("merge").join(moved, "concept", "left").select("concept", F.least("place", "sooner").alias("place"), "level"), "places")
    from tracewell.operators.sequence import globally_numbered

    return globally_numbered(sound, ["place", "level", "concept"], "nth").select("concept", "place", "level", F.col("nth").cast("long").alias("nth")), faults
