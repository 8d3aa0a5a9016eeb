"""Delivery states, compile checks, glossary rules and node trees."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tracewell.operators.tree import reached

#: From which state each event leads where.
TRANSITIONS = {"review_ready": ("draft", "ready_for_review"), "accept": ("ready_for_review", "accepted"), "publish": ("accepted", "published")}


def delivery_states(events: DataFrame) -> DataFrame:
    """(project, state, rejected): ordered events folded into a state; an event that does not fit is rejected."""
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", "kind")))
    start = F.struct(F.lit("draft").alias("state"), F.lit(0).alias("rejected"))

    def step(held: Column, event: Column) -> Column:
        to = F.coalesce(*(F.when((event["kind"] == kind) & (held["state"] == before), after) for kind, (before, after) in TRANSITIONS.items()))
        reset = F.when(event["kind"] == "edit", "draft")
        return F.struct(F.coalesce(reset, to, held["state"]).alias("state"), (held["rejected"] + F.when(reset.isNull() & to.isNull(), 1).otherwise(0)).alias("rejected"))

    folded = events.groupBy("project").agg(F.aggregate(ordered, start, step).alias("s"))
    return folded.select("project", "s.state", "s.rejected")


def marker_issues(lines: DataFrame, known: DataFrame) -> DataFrame:
    """(material_id, line_no, code) of source markers: unknown, repeated, or not alone on their line; fences are passed over.

    ``lines``: material_id, line_no, line, protected; ``known``: material_id, marker.
    """
    found = lines.where("not protected").select("material_id", "line_no", "line", F.posexplode(F.regexp_extract_all("line", F.lit(r"\{\{source:([^}]+)\}\}"), F.lit(1))).alias("n", "marker")).hint("merge")
    nth = F.row_number().over(Window.partitionBy("material_id", "marker").orderBy("line_no", "n"))
    met = found.withColumn("nth", nth).join(known.select("material_id", "marker", F.lit(True).alias("known")).distinct(), ["material_id", "marker"], "left")
    codes = F.array(
        F.when(F.col("known").isNull(), "UNKNOWN_MARKER"),
        F.when(F.col("nth") > 1, "DUPLICATE_RESOURCE"),
        F.when(F.trim("line") != F.concat(F.lit("{{source:"), "marker", F.lit("}}")), "MARKER_PLACEMENT"),
    )
    return met.select("material_id", "line_no", "marker", F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("code"))


def resource_issues(bodies: DataFrame, resources: DataFrame, placed: DataFrame) -> DataFrame:
    """(material_id, code, resource_id): empty bodies, omitted resources, resources without bytes."""
    empty = bodies.where("trim(markdown) = ''").select("material_id", F.lit("EMPTY_BODY").alias("code"), F.lit(None).cast("string").alias("resource_id"))
    body = resources.where("usage = 'body'")
    omitted = body.join(placed.select("material_id", "resource_id").distinct(), ["material_id", "resource_id"], "left_anti").select("material_id", F.lit("OMITTED_RESOURCE").alias("code"), "resource_id")
    hollow = body.where("size is null or size = 0").select("material_id", F.lit("RESOURCE_BINARY_UNAVAILABLE").alias("code"), "resource_id")
    return empty.unionByName(omitted).unionByName(hollow)


def issue_counts(issues: DataFrame) -> DataFrame:
    """(material_id, repair, confirm, service): issues by what they ask for."""
    category = F.when(F.col("code").isin("MARKER_PLACEMENT", "DUPLICATE_RESOURCE", "EMPTY_BODY"), "repair").when(F.col("code").isin("OMITTED_RESOURCE", "UNKNOWN_MARKER"), "confirm").otherwise("service")
    return issues.withColumn("category", category).groupBy("material_id").pivot("category", ["repair", "confirm", "service"]).count().na.fill(0)


def acronym_definitions(lines: DataFrame) -> DataFrame:
    """Definition lines whose parenthesis hides an acronym: (keys, acronym)."""
    found = F.regexp_extract("line", r"[\x{4E00}-\x{9FFF}]（[A-Za-z][A-Za-z ]+[,，] ?([A-Z]{2,8})）", 1)
    return lines.withColumn("acronym", found).where("acronym <> ''")


def numeronyms(texts: DataFrame, catalog: DataFrame, declared: DataFrame) -> DataFrame:
    """(id, token) of catalogued tokens like i18n that a text uses and nobody declared."""
    tokens = texts.select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\b([a-z][0-9]{1,2}[a-z])\b"), F.lit(1)))).alias("token")).hint("merge")
    return tokens.join(catalog.select("token"), "token", "left_semi").join(declared.select("id", "token"), ["id", "token"], "left_anti")


def anchored(concepts: DataFrame, sources: DataFrame) -> DataFrame:
    """(concept_id, anchored): whether an acronym occurs, with no letter beside it, in any cited source."""
    met = concepts.join(sources, "source_id", "left")
    quoted = F.concat(F.lit("(^|[^A-Za-z])\\Q"), F.replace("short", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E([^A-Za-z]|$)"))
    met = met.withColumn("shape", quoted)
    hit = F.expr("rlike(text, shape)")
    return met.groupBy("concept_id").agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("anchored"))


def glossary_growth(materials: DataFrame, short: int = 1_200, times: float = 2.5) -> DataFrame:
    """(material_id, overgrown): short sources whose visible output grew beyond the allowance and holds many definitions."""
    visible = F.regexp_replace("output", r"\]\([^()\n]*(?:\([^()\n]*\)[^()\n]*)*\)", "]")
    definitions = F.regexp_count("output", F.lit(r"(?m)^[^\n:：]{1,40}[:：] "))
    room = times * F.char_length("source") + 200 * F.regexp_count("source", F.lit("```"))
    return materials.select("material_id", ((F.char_length("source") < short) & (definitions > 3) & (F.char_length(visible) > room)).alias("overgrown"))


_SUPPORT = (
    lambda name: rf"(?i)(?<![A-Za-z0-9]){re.escape(name)}(?![A-Za-z0-9])",
    lambda name: rf"(?i)</?{re.escape(name)}[\s>]",
    lambda name: rf"(?i)(?<![A-Za-z]){re.escape(name.split(' ')[0])}(?:\s*,\s*\w+)*\s+(?:and|or)\s+\w+\s+{re.escape(name.split(' ')[-1])}(?![A-Za-z])",
)


@F.pandas_udf(BooleanType())
def name_supported(names, quotes):
    """Whether a quote supports a name: directly, as a markup element, or as a coordinated modifier."""
    import pandas as pd

    return pd.Series([bool(n and q and any(re.search(p(n), q) for p in _SUPPORT)) for n, q in zip(names, quotes)])


def name_status(names: DataFrame, quotes: DataFrame) -> DataFrame:
    """(name_id, status): verified with a supporting quote, unsearched without any, else ambiguous."""
    met = names.join(quotes, "name_id", "left")
    found = met.groupBy("name_id").agg(F.bool_or(name_supported("name", "quote")).alias("ok"), F.count("quote").alias("n"))
    return found.select("name_id", F.when(F.col("ok"), "verified").when(F.col("n") == 0, "unsearched").otherwise("ambiguous").alias("status"))


def node_faults(nodes: DataFrame) -> DataFrame:
    """(tree, id, fault) of flat node trees(tree, id, parent): repeated ids, unknown parents, nodes no root reaches."""
    repeated = nodes.groupBy("tree", "id").count().where("count > 1").select("tree", "id", F.lit("repeated").alias("fault"))
    known = nodes.select("tree", F.col("id").alias("parent")).distinct()
    orphan = nodes.where("parent is not null").join(known, ["tree", "parent"], "left_anti").select("tree", "id", F.lit("unknown parent").alias("fault"))
    found = reached(nodes, nodes.where("parent is null").select("tree", F.col("id").alias("root"), "id"), ["tree"]).select("tree", "id").distinct()
    lost = nodes.join(found, ["tree", "id"], "left_anti").join(orphan.select("tree", "id"), ["tree", "id"], "left_anti").select("tree", "id", F.lit("unreachable").alias("fault"))
    return repeated.unionByName(orphan).unionByName(lost)
