"""What pages look like: comparison of renderings, navigation, badges, symbols, layout tables, placeholders.

Element rows (``sources.elements``) are gathered per page or table, so a group is never larger than its page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.sources.elements import elements

#: Scopes that say of a definition that what uses it carries no content.
DECORATIVE_SCOPES = ("site_chrome", "source_metadata", "layout_decorative")
# Where a status badge's image comes from.
BADGE = r"(?i)/badge(\.svg)?(\?|$)|img\.shields\.io/"
ASPECTS = ("visible_text", "table_cells", "code_blocks", "anchor_ids", "image_count", "image_descriptions", "formula_source", "external_links")


def squeezed(text: Column) -> Column:
    """White space runs become one space."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def attribute(name: str) -> Column:
    return F.try_element_at("attributes", F.lit(name))


def _listed(condition: Column, value: Column) -> Column:
    """The values of the rows that meet a condition, in page order."""
    return F.transform(F.array_sort(F.collect_list(F.when(condition, F.struct("ord", value.alias("value"))))), lambda x: x["value"])


def page_aspects(pages: DataFrame, anchor: str) -> DataFrame:
    """(id, the aspects of a page, fragments, ids) of (id, html)."""
    tag, link = F.col("tag"), attribute("href")
    cell = F.struct(squeezed(F.col("text")).alias("text"), F.coalesce(attribute("rowspan"), F.lit("1")).alias("rows"), F.coalesce(attribute("colspan"), F.lit("1")).alias("columns"))
    in_math = F.array_contains(F.split(F.coalesce(attribute("class"), F.lit("")), r"\s+"), "math-tex")
    return elements(pages).groupBy("id").agg(
        F.max(F.when(tag == "", squeezed(F.col("text")))).alias("visible_text"),
        _listed(tag.isin("td", "th"), cell).alias("table_cells"),
        _listed(tag == "pre", F.col("text")).alias("code_blocks"),
        _listed(attribute(anchor).isNotNull(), attribute(anchor)).alias("anchor_ids"),
        F.count_if(tag == "img").alias("image_count"),
        _listed(tag == "img", F.coalesce(attribute("alt"), F.lit(""))).alias("image_descriptions"),
        _listed(in_math, F.col("text")).alias("formula_source"),
        _listed((tag == "a") & link.rlike("^https?://"), link).alias("external_links"),
        F.collect_set(F.when((tag == "a") & link.startswith("#") & ~link.startswith("#root/"), F.substring(link, F.lit(2), F.length(link)))).alias("fragments"),
        F.collect_set(attribute("id")).alias("ids"),
    )


def compared_pages(expected: DataFrame, actual: DataFrame, anchor: str = "data-anchor-id") -> DataFrame:
    """(id, whether each aspect of two renderings is equal, and whether every fragment link of the actual one has its target)."""
    want, have = page_aspects(expected, anchor), page_aspects(actual, anchor)
    met = want.select("id", *(F.col(a).alias(f"want_{a}") for a in ASPECTS)).hint("merge").join(have, "id")
    equal = [F.col(a).eqNullSafe(F.col(f"want_{a}")).alias(a) for a in ASPECTS]
    return met.select("id", *equal, (F.size(F.array_except("fragments", "ids")) == 0).alias("local_fragment_targets"))


def top_navigation(links: DataFrame, captures: DataFrame, lowest: float = 120) -> DataFrame:
    """Links whose captured box on the page itself begins at ``lowest`` or above: (keys of the link, source_scope, y)."""
    boxes = captures.where(F.col("scope") == "page").select("capture_id", F.col("y").try_cast("double").alias("y")).where(F.col("y") <= lowest)
    return links.hint("merge").join(boxes, "capture_id").withColumn("source_scope", F.lit("site_chrome"))


def markdown_targets(texts: DataFrame) -> DataFrame:
    """(id, parent, kind, target, text) of the images and links of (id, body); the parent is the line they are in."""
    lines = texts.select("id", F.posexplode(F.split("body", "\n")).alias("parent", "line")).hint("merge")
    image, link = r"!\[([^\]]*)\]\(([^)\s]+)[^)]*\)", r"(?<!!)\[((?:!\[[^\]]*\]\([^)]*\)|[^\]\[])*)\]\(([^)\s]+)[^)]*\)"

    def found(kind: str, pattern: str) -> Column:
        both = F.arrays_zip(F.regexp_extract_all("line", F.lit(pattern), F.lit(1)).alias("text"), F.regexp_extract_all("line", F.lit(pattern), F.lit(2)).alias("target"))
        return F.transform(both, lambda x: F.struct(F.lit(kind).alias("kind"), x["target"].alias("target"), F.regexp_replace(x["text"], image, "").alias("text")))

    return lines.select("id", "parent", F.inline(F.concat(found("image", image), found("link", link))))


def badge_contexts(texts: DataFrame) -> DataFrame:
    """(id, context) of (id, body) that begin with a heading: its line, and the next paragraph if it holds badges only."""
    first = F.regexp_extract("body", r"\A\s*([^\n]*)", 1)
    second = F.coalesce(F.try_element_at(F.split("body", "\n\n", 3), F.lit(2)), F.lit(""))
    image = r"!\[[^\]]*\]\(([^)\s]+)[^)]*\)"
    images = F.regexp_extract_all(second, F.lit(image), F.lit(1))
    bare = F.trim(F.regexp_replace(F.regexp_replace(second, image, ""), r"\[\s*\]\([^)]*\)", "")) == ""
    badges = (F.size(images) > 0) & F.forall(images, lambda url: url.rlike(BADGE)) & bare
    return texts.where(first.rlike(r"^#{1,6}\s")).select("id", F.concat(first, F.when(badges, F.concat(F.lit("\n"), second)).otherwise("")).alias("context"))


def heading_badges(objects: DataFrame, contexts: DataFrame) -> DataFrame:
    """Objects(id, parent, kind, target, text) that are badges of their document's heading, or empty links around one: adds ``source_scope``."""
    near = objects.hint("merge").join(contexts, "id").where((F.col("target") != "") & F.contains("context", F.col("target")))
    badges = near.where((F.col("kind") == "image") & F.col("target").rlike(BADGE)).drop("context")
    wrappers = near.where((F.col("kind") == "link") & (F.trim("text") == "")).drop("context").join(badges.select("id", "parent").distinct().hint("merge"), ["id", "parent"], "left_semi")
    return badges.unionByName(wrappers).withColumn("source_scope", F.lit("source_metadata"))


def symbol_scopes(objects: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, definition_id, source_scope): drawings that only use a symbol take the decorative scope proven of its definition.

    ``objects(keys, id, kind, raw, source_scope)``, ids unique; of definitions that repeat a name, the one with the largest id counts.  A drawing
    is a use if its markup is one svg with one use of a name in the same document, and no text.
    """
    found = elements(objects.select("id", F.col("raw").alias("html"))).groupBy("id").agg(
        F.count_if(F.col("ord") > 0).alias("n"),
        F.min(F.when((F.col("tag") == "svg") & (attribute("id") != ""), F.struct("ord", attribute("id").alias("symbol")))).alias("defines"),
        F.max(F.when((F.col("path") == "/svg[1]/use[1]") & attribute("href").startswith("#"), F.substr(attribute("href"), F.lit(2)))).alias("uses"),
        F.max(F.when(F.col("ord") == 0, F.trim("text"))).alias("shown"),
    )
    met = objects.hint("merge").join(found, "id")
    known = met.where("defines IS NOT NULL").groupBy(*keys, F.col("defines.symbol").alias("symbol")).agg(F.max_by(F.struct(F.col("id").alias("definition_id"), "source_scope"), "id").alias("of"))
    uses = met.where("kind = 'unknown' AND n = 2 AND uses <> '' AND coalesce(shown, '') = ''").select(*keys, "id", F.col("uses").alias("symbol"))
    drawn = uses.hint("merge").join(known, [*keys, "symbol"]).where(F.col("of.source_scope").isin(*DECORATIVE_SCOPES))
    return drawn.select(*keys, "id", F.col("of.definition_id").alias("definition_id"), F.col("of.source_scope").alias("source_scope"))


def layout_tables(tables: DataFrame) -> DataFrame:
    """(id, is_layout) of (id, html of a table): one row, no header, caption, data role, scope or span; a single cell with text, in
    paragraphs or a list, and an image in another one."""
    tag = F.col("tag")
    spans = (F.trim(F.coalesce(attribute("rowspan"), F.lit("1"))) != "1") | (F.trim(F.coalesce(attribute("colspan"), F.lit("1"))) != "1")
    gathered = elements(tables).groupBy("id").agg(
        F.count_if(tag.isin("th", "caption")).alias("headers"),
        F.count_if(tag == "tr").alias("n_rows"),
        F.count_if((tag == "table") & F.lower(F.coalesce(attribute("role"), F.lit(""))).isin("table", "grid", "treegrid")).alias("roles"),
        F.count_if(attribute("headers").isNotNull() | attribute("scope").isNotNull() | ((tag == "td") & spans)).alias("relations"),
        F.collect_list(F.when((tag == "td") & (F.trim("text") != ""), F.concat("path", F.lit("/")))).alias("texts"),
        F.collect_list(F.when(tag.isin("p", "ul", "ol"), F.col("path"))).alias("prose"),
        F.collect_list(F.when(tag == "img", F.col("path"))).alias("images"),
    )
    plain = (F.col("headers") == 0) & (F.col("n_rows") == 1) & (F.col("roles") == 0) & (F.col("relations") == 0) & (F.size("texts") == 1)
    cell = F.get("texts", 0)
    around = F.exists("prose", lambda p: p.startswith(cell)) & F.exists("images", lambda p: ~p.startswith(cell))
    return gathered.select("id", (plain & around).alias("is_layout"))


def transparent_placeholders(objects: DataFrame) -> DataFrame:
    """Drawings of (kind, raw, method, label) without a visible pixel, a label, or any text, title or accessible name inside: adds ``source_scope``."""
    named = F.col("raw").rlike(r"""(?i)\b(aria-label|aria-labelledby|aria-description|title|alt)\s*=\s*("[^"]*\S[^"]*"|'[^']*\S[^']*')""")
    text = F.trim(F.regexp_replace("raw", r"(?s)<!--.*?-->|<[^>]*>", "")) != ""
    blank = F.col("kind").isin("image", "media") & (F.col("method") == "all_pixels_alpha_zero") & (F.trim(F.coalesce("label", F.lit(""))) == "") & F.col("raw").rlike(r"(?i)<svg\b")
    return objects.where(blank & ~named & ~text).withColumn("source_scope", F.lit("layout_decorative"))


def bound_quotes(facts: DataFrame, objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts with the full text of their source object as ``quote``, facts whose source is unknown)."""
    keys = ["material_id", "object_id"]
    source = objects.select(*keys, F.col("text").alias("quote"))
    return facts.hint("merge").join(source, keys), facts.hint("merge").join(source.select(*keys), keys, "left_anti")


def comparison_baselines(records: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, version, digest, conflict): the latest saved grid of a source set; where saved ones differ there is none.

    ``records(keys, source_ids, version, digest)``; sources count as a set, and the keys name the occurrence.
    """
    ids = F.array_join(F.array_sort(F.array_distinct("source_ids")), ",")
    found = records.groupBy(*keys, ids.alias("sources")).agg(F.count_distinct("digest").alias("n"), F.max_by(F.struct("version", "digest"), "version").alias("latest"))
    one = F.col("n") == 1
    return found.select(*keys, "sources", F.when(one, F.col("latest.version")).alias("version"), F.when(one, F.col("latest.digest")).alias("digest"), (~one).alias("conflict"))
