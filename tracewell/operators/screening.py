"""What may be edited, shown and delivered: responsibilities, editable lines, proposals, captures, completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.scalars import canonical_url
from tracewell.operators.text import lines_of

#: Scopes of objects that are kept but never shown or explained.
SILENT_SCOPES = ("site_chrome", "source_metadata", "layout_decorative")


def responsibilities(objects: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, preserve, present, explain): every object is preserved; decisions(keys, present, explain) hold but for silent scopes."""
    met = objects.select(*keys, "source_scope").hint("merge").join(decisions, keys, "left")
    silent = F.coalesce(F.col("source_scope").isin(*SILENT_SCOPES), F.lit(False))
    told = lambda c: (F.coalesce(c, F.lit(False)) & ~silent).alias(c)
    return met.select(*keys, F.lit(True).alias("preserve"), told("present"), told("explain"))


# ---------------------------------------------------------------- literal spans


def literal_spans(texts: Column, literals: Column) -> Column:
    """[start, end) of every place where one of an array of literals stands in a text, each from the left without overlapping itself; from 0."""

    def places(literal: Column) -> Column:
        parts = F.split(texts, F.concat(F.lit("\\Q"), literal, F.lit("\\E")), -1)
        size = F.char_length(literal)
        walked = F.aggregate(
            F.slice(parts, 1, F.size(parts) - 1),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
            lambda s, p: F.struct(
                (s["at"] + F.char_length(p) + size).alias("at"),
                F.concat(s["spans"], F.array(F.struct((s["at"] + F.char_length(p)).alias("start"), (s["at"] + F.char_length(p) + size).alias("end")))).alias("spans"),
            ),
        )
        return walked["spans"]

    return F.flatten(F.transform(F.filter(literals, lambda x: (x != "") & F.contains(texts, x)), places))


def editable_lines(blocks: DataFrame, literals: DataFrame) -> DataFrame:
    """(material_id, block_id, line_no) of lines that may be edited: not blank, once in their block, and clear of every literal.

    ``blocks(material_id, block_id, kind, markdown)``, ``literals(material_id, literals array)``.  Authored blocks, and object blocks that show text of
    their own: something visible besides the literals.
    """
    held = blocks.hint("merge").join(literals, "material_id", "left").withColumn("literals", F.coalesce("literals", F.array().cast("array<string>")))
    left = F.aggregate("literals", F.col("markdown"), lambda text, x: F.when(x == "", text).otherwise(F.replace(text, x, F.lit(""))))
    visible = F.trim(F.regexp_replace(left, r"<[^>]*>|[\s|#>*_-]", "")) != ""
    open_ = held.where((F.col("kind") == "explanation") | ((F.col("kind") == "object") & visible))
    spans = open_.select("material_id", "block_id", literal_spans(F.col("markdown"), F.col("literals")).alias("spans"))
    lines = lines_of(open_).withColumn("length", F.char_length("line"))
    so_far = Window.partitionBy("material_id", "block_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.withColumns({"begin": F.coalesce(F.sum(F.col("length") + 1).over(so_far), F.lit(0)), "n": F.count("*").over(Window.partitionBy("material_id", "block_id", "line"))})
    met = placed.where((F.col("n") == 1) & (F.trim("line") != "")).join(spans.hint("merge"), ["material_id", "block_id"])
    clear = ~F.exists("spans", lambda s: (s["start"] < F.col("begin") + F.col("length")) & (s["end"] > F.col("begin")))
    return met.where(clear).select("material_id", "block_id", "line_no")


def screened_proposals(edits: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edits to make, refused edits with their reason) of edits(edit_id, block_id, old, new) on blocks(block_id, kind, markdown, literals).

    Refused: no change; no old text; a literal in the old text that the new one lacks; an old text that overlaps a literal; markup of an object block;
    inline code that gets lost.  An edit of several lines that occurs once is made line by line, if each line occurs once: the first becomes the
    new text, the others go.
    """
    met = edits.hint("merge").join(blocks, "block_id", "left").withColumn("literals", F.coalesce("literals", F.array().cast("array<string>")))
    old, new, text = F.col("old"), F.col("new"), F.coalesce("markdown", F.lit(""))
    count = lambda whole, part: (F.char_length(whole) - F.char_length(F.replace(whole, part, F.lit("")))) / F.char_length(part)
    lost = F.exists("literals", lambda x: (x != "") & F.contains(old, x) & ~F.contains(new, x))
    # an old text overlaps a literal where it stands, but need not hold it whole
    overlaps = F.exists(literal_spans(text, F.array(old)), lambda o: F.exists(literal_spans(text, F.col("literals")), lambda s: (o["start"] < s["end"]) & (o["end"] > s["start"])))
    codes = F.array_distinct(F.regexp_extract_all(old, F.lit(r"(?<!`)`[^`\n]+`(?!`)"), F.lit(0)))
    markup = lambda c: c.rlike(r"</?[A-Za-z][^>\n]*>|\{\{source:")
    reason = (
        F.when(old == new, "no change")
        .when(old == "", "empty target")
        .when(lost, "literal changed")
        .when(overlaps, "literal overlapped")
        .when((F.col("kind") == "object") & (markup(old) | markup(new)), "object markup")
        .when(F.exists(codes, lambda c: count(new, c) < count(old, c)), "inline code removed")
    )
    judged = met.withColumn("reason", reason)
    parts = F.filter(F.split(old, "\n"), lambda x: x != "")
    split = F.contains(old, F.lit("\n")) & (count(text, old) == 1) & (F.size(parts) > 0) & F.forall(parts, lambda x: count(text, x) == 1)
    pieces = F.transform(parts, lambda x, i: F.struct(i.alias("part"), x.alias("old"), F.when(i == 0, new).otherwise("").alias("new")))
    whole = F.array(F.struct(F.lit(0).alias("part"), old.alias("old"), new.alias("new")))
    made = judged.where("reason is null").select("edit_id", "block_id", F.inline(F.when(split, pieces).otherwise(whole)))
    return made, judged.where("reason is not null").select("edit_id", "block_id", "reason")


# ---------------------------------------------------------------- captures


def bound_captures(objects: DataFrame, captures: DataFrame, originals: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(captures with their object and state, link discrepancies, gaps).

    ``objects(object_id, kind, capture_id, target)``, ``captures(capture_id, kind, scope, preview, target)``, ``originals(preview)``.  A capture is bound to the object of its
    id; one that no object has but whose preview is archived becomes an object; others of the article are gaps.  The captured destination
    of a bound link that is canonically another one is a discrepancy.
    """
    mine = objects.where("capture_id is not null").select("capture_id", "object_id", F.col("kind").alias("object_kind"), F.col("target").alias("parsed_target"))
    kept = originals.select("preview").distinct().withColumn("archived", F.lit(True))
    met = captures.hint("merge").join(mine, "capture_id", "left").join(kept.hint("merge"), "preview", "left")
    state = F.when(F.col("object_id").isNotNull(), "bound").when(F.col("archived"), "synthesized").otherwise("unbound")
    told = met.withColumn("state", state).withColumn("object_id", F.coalesce("object_id", F.when(state == "synthesized", F.concat(F.lit("rendered-"), "capture_id"))))
    same = canonical_url(F.col("parsed_target")).eqNullSafe(canonical_url(F.col("target")))
    differs = told.where((F.col("state") == "bound") & (F.col("object_kind") == "link") & ~same).select("capture_id", "object_id", "parsed_target", "target")
    gaps = told.where((F.col("state") == "unbound") & (F.col("scope") == "article")).select("capture_id", "kind")
    return told.select("capture_id", "object_id", "state"), differs, gaps


def complete_materials(materials: DataFrame, figures: DataFrame, renders: DataFrame) -> DataFrame:
    """(material, complete, why): with a manifest, every article figure is ready and bound; an attempted render is completed without gaps.

    ``materials(material, has_manifest)``, ``figures(material, ready, bound)``, ``renders(material, attempted, completed, gaps)``.
    """
    open_ = figures.groupBy("material").agg(F.count_if(~(F.coalesce("ready", F.lit(False)) & F.coalesce("bound", F.lit(False)))).alias("open"))
    met = materials.hint("merge").join(open_, "material", "left").join(renders.hint("merge"), "material", "left")
    tried = F.coalesce("attempted", F.lit(False))
    why = (
        F.when(F.col("has_manifest") & (F.coalesce("open", F.lit(0)) > 0), "open figures")
        .when(tried & ~F.coalesce("completed", F.lit(False)), "render not completed")
        .when(tried & (F.coalesce("gaps", F.lit(0)) > 0), "render gaps")
    )
    return met.select("material", why.isNull().alias("complete"), why.alias("why"))
