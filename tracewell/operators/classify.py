"""Classification of source objects: chrome, markup, decoration, badges, layout, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INERT_LIMIT = 12_000


def inert_markup(objects: DataFrame) -> DataFrame:
    """Adds ``class``: scripts and styles are metadata (source metadata if long), empty headings decoration."""
    inert = F.col("kind") == "unknown"
    value = F.when(inert & (F.char_length("text") > INERT_LIMIT), "source_metadata").when(inert, "metadata").when((F.col("kind") == "heading") & (F.trim("text") == ""), "decorative")
    return objects.withColumn("class", value)


def under_prefix(objects: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Objects at or below a locator prefix of their page take its class, by the lowest priority number."""
    met = objects.hint("merge").join(prefixes, "page_id").where((F.col("locator") == F.col("prefix")) | F.col("locator").startswith(F.concat("prefix", F.lit("/"))))
    best = met.groupBy("page_id", "ord").agg(F.min_by("class", "priority").alias("class"))
    return objects.hint("merge").join(best, ["page_id", "ord"], "left")


def duplicate_media(objects: DataFrame) -> DataFrame:
    """Occurrences of a target without a capture, where another one has it: (…, ``visible_id``)."""
    w = Window.partitionBy("material_id", "target")
    visible = F.min(F.when(F.col("captured"), F.col("object_id"))).over(w)
    return objects.withColumn("visible_id", F.when(~F.col("captured"), visible)).where("visible_id is not null")


def is_decorative(kind: Column, text: Column, scope: Column) -> Column:
    """Ordered rules: article media never; decorative scopes; images and links without text."""
    return F.when(kind.isin("image", "media") & (scope == "article"), F.lit(False)).when(scope.isin("layout_decorative", "site_chrome"), F.lit(True)).otherwise(kind.isin("image", "link") & (F.trim(text) == ""))


def presentation(placements: Column, parent_kind: Column) -> Column:
    """Role by placement boxes: components are under 24 points on every side, in a table symbols."""
    small = F.forall(placements, lambda p: F.greatest(p["width"], p["height"]) < 24)
    return F.when(small & (parent_kind == "table"), "table-symbol").when(small, "inline-component").otherwise("source-image")


def effective_usage(objects: DataFrame, choices: DataFrame) -> DataFrame:
    """The chosen usage, else reference for pages and body for the rest."""
    default = F.when(F.col("kind") == "page", "reference").otherwise("body")
    return objects.join(choices.where(F.col("choice").isin("body", "reference", "exclude")), ["material_id", "object_id"], "left").withColumn("usage", F.coalesce("choice", default)).drop("choice")


def link_roles(links: DataFrame) -> DataFrame:
    """navigation, administrative or content, by target, label and repeats."""
    w = Window.partitionBy("page_id", "target")
    repeats, blank = F.count("*").over(w), F.bool_or(F.trim("text") == "").over(w)
    role = (
        F.when(F.col("target").rlike(r"^(#|/$|/index\.)"), "navigation")
        .when(F.col("text").rlike(r"(?i)\b(donate|contact|privacy|license|terms|imprint)\b"), "administrative")
        .when(blank & (repeats > 1), "administrative")
        .when(F.col("scope") == "site_chrome", "navigation")
        .otherwise("content")
    )
    return links.withColumn("role", role)


def split_gaps(gaps: DataFrame, proven: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(open, resolved): gaps of objects that are proven decoration or metadata are resolved."""
    return gaps.join(proven, keys, "left_anti"), gaps.join(proven, keys, "left_semi")


def label_scope(objects: DataFrame) -> DataFrame:
    """Objects under a heading like "See also" or "References" are labels only."""
    before = Window.partitionBy("material_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    heading = F.last(F.when(F.col("kind") == "heading", F.col("text")), ignorenulls=True).over(before)
    return objects.withColumn("label_only", F.coalesce(heading.rlike(r"(?i)^\s*(see also|references|further reading|参考资料)"), F.lit(False)) & (F.col("kind") != "heading"))
