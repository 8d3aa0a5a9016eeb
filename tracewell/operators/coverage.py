"""Coverage and audit rules: each rule returns violation rows, scorecards unite them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.sequence import globally_numbered

#: Invariants that a roll-up takes; they are broadcast to every material.
MAX_INVARIANTS = 10_000

VIOLATION = ("material_id", "code", "block_id", "object_id", "obligation_id")


def violation(rows: DataFrame, code: str) -> DataFrame:
    """Rows shaped as violations of one code; columns they lack are null."""
    return rows.select(*(F.lit(code).alias(c) if c == "code" else (F.col(c).cast("string" if c != "material_id" else "long") if c in rows.columns else F.lit(None).cast("string")).alias(c) for c in VIOLATION))


def all_rules(*rules: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, rules)


def unknown(rows: DataFrame, known: DataFrame, keys: list[str], code: str, few: bool = False) -> DataFrame:
    """Rows whose key is not among the known ones.  With ``few`` rows, these are held in hash tables, and the known ones stream past without a sort."""
    if few:
        met = rows.hint("shuffle_hash").join(known.select(*keys, F.lit(True).alias("is_known")), keys, "left")
        return violation(met.where("is_known IS NULL").drop("is_known"), code)
    return violation(rows.join(known.select(*keys).distinct(), keys, "left_anti"), code)


def duplicated(rows: DataFrame, keys: list[str], code: str) -> DataFrame:
    """Rows of keys that occur more than once, one for each key."""
    return violation(rows.groupBy(*keys).count().where("count > 1"), code)


def empty_blocks(blocks: DataFrame, placed: DataFrame) -> DataFrame:
    """Blocks without text and without objects."""
    return violation(blocks.where("trim(markdown) = ''").join(placed.select("material_id", "block_id").distinct(), ["material_id", "block_id"], "left_anti"), "empty")


def wrong_shape(blocks: DataFrame, kinds: list[str]) -> DataFrame:
    """Blocks without an id, or of a kind outside the enumeration."""
    return violation(blocks.where(F.col("block_id").isNull() | ~F.col("kind").isin(*kinds)), "shape")


def unmapped(covers: DataFrame, obligations: DataFrame, placed: DataFrame) -> DataFrame:
    """Covered obligations whose object is not placed in the covering block."""
    met = covers.join(obligations.select("material_id", "obligation_id", "object_id"), ["material_id", "obligation_id"])
    return violation(met.join(placed.select("material_id", "block_id", "object_id"), ["material_id", "block_id", "object_id"], "left_anti"), "unmapped")


def misquoted(evidence: DataFrame, objects: DataFrame) -> DataFrame:
    """Evidence whose quote is not a literal part of its object."""
    from tracewell.operators.binding import literal_quotes

    return violation(literal_quotes(evidence, objects.select("material_id", "object_id", "text"), ["material_id", "object_id"]).where("not found"), "quote")


def omitted(obligations: DataFrame, covers: DataFrame) -> DataFrame:
    """Obligations that no block covers; covers are held in hash tables, and obligations stream past without a sort."""
    return violation(obligations.join(covers.select("material_id", "obligation_id").distinct().hint("shuffle_hash"), ["material_id", "obligation_id"], "left_anti"), "omission")


PROTECTED_KINDS = ("image", "media", "table", "code", "formula", "link", "page", "attachment", "footnote")


def unplaced(objects: DataFrame, placed: DataFrame) -> DataFrame:
    """Protected objects that no block places."""
    guarded = objects.where(F.col("kind").isin(*PROTECTED_KINDS))
    return violation(guarded.join(placed.select("material_id", "object_id").distinct(), ["material_id", "object_id"], "left_anti"), "protected_object")


def headings_lost(objects: DataFrame, placed: DataFrame, blocks: DataFrame) -> DataFrame:
    """Source headings not tied to a block that has a Markdown heading."""
    titled = blocks.where(F.col("markdown").rlike(r"(?m)^ {0,3}#{1,6}\s+\S")).select("material_id", "block_id")
    tied = placed.join(titled, ["material_id", "block_id"], "left_semi").select("material_id", "object_id").distinct()
    return violation(objects.where("kind = 'heading'").join(tied, ["material_id", "object_id"], "left_anti"), "heading")


def set_difference(required: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side): missing (required only) or unexpected (actual only)."""
    a, b = required.select(*keys).distinct().withColumn("r", F.lit(True)), actual.select(*keys).distinct().withColumn("a", F.lit(True))
    met = a.join(b, keys, "full").where("r is null or a is null")
    return met.select(*keys, F.when(F.col("a").isNull(), "missing").otherwise("unexpected").alias("side"))


def new_issues(before: DataFrame, after: DataFrame) -> DataFrame:
    """Issues that an edit adds, repeats counted."""
    return after.exceptAll(before)


def scorecard(checks: DataFrame) -> DataFrame:
    """(material_id, checks, failed, passed) from (material_id, code, passed)."""
    return checks.groupBy("material_id").agg(F.count("*").alias("checks"), F.count_if(~F.col("passed")).alias("failed"), F.bool_and("passed").alias("passed"))


def roll_up(findings: DataFrame, invariants: DataFrame) -> DataFrame:
    """Verdict per material and invariant: FAIL beats UNKNOWN beats PASS; no finding passes."""
    worst = findings.groupBy("material_id", "invariant").agg(F.max(F.when(F.col("status") == "FAIL", 2).when(F.col("status") == "UNKNOWN", 1).otherwise(0)).alias("rank"))
    if invariants.limit(MAX_INVARIANTS + 1).count() > MAX_INVARIANTS:
        raise ValueError(f"more than {MAX_INVARIANTS} invariants")
    every = findings.select("material_id").distinct().crossJoin(F.broadcast(invariants))
    met = every.join(worst, ["material_id", "invariant"], "left")
    return met.select("material_id", "invariant", F.when(F.col("rank") == 2, "FAIL").when(F.col("rank") == 1, "UNKNOWN").otherwise("PASS").alias("verdict"))


def merged_facts(facts: DataFrame, additions: DataFrame) -> DataFrame:
    """(id, status): equal repeats are ignored, unequal ones conflict, the rest is kept or added."""
    both = facts.select("id", "body", F.lit(0).alias("added")).unionByName(additions.select("id", "body", F.lit(1).alias("added")))
    found = both.groupBy("id").agg(F.count_distinct(F.sha2("body", 256)).alias("versions"), F.min("added").alias("added"))
    return found.select("id", F.when(F.col("versions") > 1, "conflict").when(F.col("added") == 1, "added").otherwise("kept").alias("status"))


def patched(rows: DataFrame, replace: DataFrame, add: DataFrame, remove: DataFrame) -> DataFrame:
    """Rows by id with replacements, without removals, additions last: (id, ord, body)."""
    new = replace.select("id", F.col("body").alias("new_body"))
    kept = rows.join(remove.select("id"), "id", "left_anti").join(new, "id", "left").select("id", "ord", F.coalesce("new_body", "body").alias("body"))
    top = rows.agg(F.coalesce(F.max("ord"), F.lit(0)).alias("top"))
    new_rows = globally_numbered(add.select("id", "body"), ["id"], "nth")
    return kept.unionByName(new_rows.crossJoin(F.broadcast(top)).select("id", (F.col("top") + F.col("nth")).alias("ord"), "body"))


def patch_conflicts(rows: DataFrame, replace: DataFrame, add: DataFrame, remove: DataFrame) -> DataFrame:
    """(id, conflict): why an inventory patch must not be applied; none if it may.

    Replaced and removed ids must be known, added ones new, none both replaced and removed, and each listed once.
    """
    known = rows.select("id").distinct()
    ids = {"replacement": replace.select("id"), "addition": add.select("id"), "removal": remove.select("id")}
    found = [ids[kind].join(known, "id", "left_anti").withColumn("code", F.lit(f"unknown {kind}")) for kind in ("replacement", "removal")]
    found.append(ids["addition"].join(known, "id", "left_semi").withColumn("code", F.lit("existing addition")))
    found.append(ids["removal"].join(ids["replacement"], "id", "left_semi").withColumn("code", F.lit("replaced and removed")))
    found += [listed.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit(f"repeated {kind}").alias("code")) for kind, listed in ids.items()]
    return all_rules(*(f.select("id", F.col("code").alias("conflict")) for f in found)).distinct()


def inventory_issues(facts: DataFrame, sources: DataFrame, assessed: DataFrame) -> DataFrame:
    """(id, issue) of an inventory of facts: sources not assessed or without a fact, repeated fact ids, quotes that their source doesn't hold.

    ``facts(id, source_id, quote)``, ``sources(source_id, text)``, ``assessed(source_id)``; ids are given as strings.
    """
    of_source = lambda df, issue: df.select(F.col("source_id").cast("string").alias("id"), F.lit(issue).alias("issue"))
    names = sources.select("source_id").distinct()
    missing = of_source(names.join(assessed.select("source_id"), "source_id", "left_anti"), "not assessed")
    stray = of_source(assessed.select("source_id").distinct().join(names, "source_id", "left_anti"), "unknown source")
    bare = of_source(names.join(facts.select("source_id"), "source_id", "left_anti"), "no fact")
    repeated = facts.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").cast("string").alias("id"), F.lit("repeated fact").alias("issue"))
    met = facts.hint("merge").join(sources.select("source_id", "text"), "source_id", "left")
    loose = met.where(~F.coalesce((F.col("quote") != "") & F.contains("text", F.col("quote")), F.lit(False))).select(F.col("id").cast("string").alias("id"), F.lit("quote not in source").alias("issue"))
    return all_rules(missing, stray, bare, repeated, loose).distinct()


def parts(tasks: DataFrame, limit: int, keys: list[str], order: list) -> DataFrame:
    """Adds ``part``: tasks of a key in runs of ``limit``."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return tasks.withColumn("part", F.floor((nth - 1) / limit).cast("long"))


def without_repeats(findings: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Findings equal in all but their id, once: that of the earliest part."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return findings.withColumn("nth", nth).where("nth = 1").drop("nth")
