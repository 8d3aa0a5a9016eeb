"""Joins that bind links, images, quotes and findings to source objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.scalars import safe_target

#: Rows and bytes up to which a lookup list is broadcast; a longer one is joined without a hint.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 64 << 20


def small(rows: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` marked for broadcast, if their number and the bytes of their values, which are counted here, are small."""
    size = rows.limit(limit + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("bytes")).first()
    return F.broadcast(rows) if size["n"] <= limit and size["bytes"] <= BROADCAST_BYTES else rows


def link_targets(links: DataFrame) -> DataFrame:
    """(material_id, original, target) where all occurrences of an original agree on one safe target."""
    found = links.groupBy("material_id", "original").agg(F.count_distinct("target").alias("n"), F.min("target").alias("target"), F.bool_and(F.coalesce(safe_target(F.col("target")), F.lit(False))).alias("safe"))
    return found.where("n = 1 and safe").select("material_id", "original", "target")


def restored_links(links: DataFrame, targets: DataFrame) -> DataFrame:
    """Links with ``restored``: relative ones by the map, ``http:www.`` repaired, unsafe schemes null."""
    met = links.hint("merge").join(targets.withColumnRenamed("target", "known"), ["material_id", "original"], "left")
    native = F.regexp_replace("original", r"^(https?):(?=[A-Za-z0-9])", "$1://")
    value = F.when(F.col("original").rlike(r"^(#|asset:)"), F.col("original")).when(F.col("original").rlike(r"^(?i)(javascript|data|vbscript):"), None).otherwise(F.coalesce("known", native))
    return met.withColumn("restored", value).drop("known")


def kth_binding(wanted: DataFrame, found: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """The k-th wanted row of a key binds the k-th found row of that key: adds ``object_id`` and ``ready``."""
    nth = lambda df: df.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    right = nth(found).select(*keys, "k", "object_id")
    return nth(wanted).join(right, [*keys, "k"], "left").withColumn("ready", F.col("object_id").isNotNull())


def contained_in(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(material_id, id, container, reason): the nearest declared ancestor that contains a rectangle.

    Without ancestry only a single container is accepted; several are ambiguous.  A container is filed under the tiles it covers in a grid as
    coarse as its larger side, four at most, and a rectangle looks its upper left corner up in each grid in use: what contains
    it has a tile there, and all rectangles of a material never meet.
    """
    sized = outer.where("width >= 0 AND height >= 0").withColumn("level", F.greatest(F.lit(-20), F.ceil(F.log2(F.greatest("width", "height", F.lit(1e-6)))).cast("int")))
    levels = sorted(r["level"] for r in sized.select("level").distinct().collect())  # one for each power of two that occurs
    tile = lambda c, add=F.lit(0): F.floor((F.col(c) + add) / F.pow(F.lit(2.0), F.col("level"))).cast("long")
    spans = lambda c, size: F.sequence(tile(c), tile(c, F.col(size)))  # noqa: E731  two tiles at most: they are as wide as the largest side
    cells = sized.withColumn("tx", F.explode(spans("x", "width"))).withColumn("ty", F.explode(spans("y", "height"))).hint("merge")
    o = cells.select("material_id", "level", "tx", "ty", F.col("id").alias("container"), *(F.col(c).alias(f"o_{c}") for c in ("x", "y", "width", "height")))
    holds = "o_x <= x and o_y <= y and o_x + o_width >= x + width and o_y + o_height >= y + height and container <> id"
    corners = inner.withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumns({"tx": tile("x"), "ty": tile("y")}).hint("merge")
    met = corners.join(o, ["material_id", "level", "tx", "ty"]).where(holds).drop("level", "tx", "ty")
    rank = F.array_position("ancestry", F.col("container"))
    ranked = met.withColumns({"rank": F.when(rank > 0, rank), "n": F.count("*").over(Window.partitionBy("material_id", "id"))})
    best = ranked.withColumn("nth", F.row_number().over(Window.partitionBy("material_id", "id").orderBy(F.col("rank").asc_nulls_last(), "container"))).where("nth = 1")
    bound = F.col("rank").isNotNull() | ((F.size("ancestry") == 0) & (F.col("n") == 1))
    return best.select("material_id", "id", F.when(bound, F.col("container")).alias("container"), F.when(~bound, "ambiguous").alias("reason"))


def sentence_context(objects: DataFrame, limit: int = 1200, heading_limit: int = 160) -> DataFrame:
    """For each link: the latest earlier text of its parent, else the latest earlier text or heading; and the latest heading."""
    before = Window.partitionBy("material_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    of_parent = Window.partitionBy("material_id", "parent_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    text = F.when(F.col("kind").isin("text", "heading"), F.col("text"))
    near = F.last(F.when(F.col("kind") != "link", F.col("text")), ignorenulls=True)
    context = F.coalesce(F.when(F.col("parent_id").isNotNull(), near.over(of_parent)), F.last(text, ignorenulls=True).over(before))
    heading = F.last(F.when(F.col("kind") == "heading", F.col("text")), ignorenulls=True).over(before)
    out = objects.withColumns({"context": F.left(context, F.lit(limit)), "heading": F.left(heading, F.lit(heading_limit))})
    return out.where("kind = 'link'").select("material_id", "object_id", "context", "heading")


def nearest_block(findings: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each finding moves to the closest block of its source; ties prefer the following block; none keeps a note.

    Findings and blocks of a source lie in one order, so the blocks next to a finding are its candidates.
    """
    keys = ["material_id", "source_id"]
    here = F.struct(F.col("ord").alias("ord"), F.col("block_id").alias("block_id"))
    asked = findings.select(*keys, "ord", "finding_id", F.lit(0).alias("is_block"), F.lit(None).cast(blocks.schema["block_id"].dataType).alias("block_id"))
    places = blocks.select(*keys, "ord", F.lit(None).cast(findings.schema["finding_id"].dataType).alias("finding_id"), F.lit(1).alias("is_block"), "block_id")
    order = Window.partitionBy(*keys).orderBy("ord", "is_block", "block_id")
    both = asked.unionByName(places).withColumn("here", F.when(F.col("is_block") == 1, here))
    before = F.last("here", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("here", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    met = both.withColumns({"before": before, "after": after}).where("is_block = 0")
    nearer = F.when(F.col("before").isNull() | (F.col("after.ord") - F.col("ord") <= F.col("ord") - F.col("before.ord")), F.col("after.block_id")).otherwise(F.col("before.block_id"))
    found = F.when(F.col("source_id").isNotNull(), nearer)
    return met.select("material_id", "finding_id", found.alias("block_id"), found.isNull().alias("is_note"))


def carried(previous: DataFrame, current: DataFrame, edited: DataFrame, blocks: DataFrame) -> DataFrame:
    """Previous findings whose block was not edited, whose quote is still there, and that no current one equals."""
    left = previous.join(edited.select("material_id", "block_id").distinct(), ["material_id", "block_id"], "left_anti")
    left = left.join(current.select("material_id", "block_id", "quote").distinct(), ["material_id", "block_id", "quote"], "left_anti")
    return left.join(blocks.select("material_id", "block_id", "markdown"), ["material_id", "block_id"]).where(F.contains("markdown", F.col("quote"))).drop("markdown")


def literal_quotes(quotes: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """Quotes with ``found``: whether they are literal parts of their source; an empty quote fits only an empty text.

    Quotes are held in hash tables, and sources stream past without a sort.
    """
    met = quotes.hint("shuffle_hash").join(sources, keys, "left")
    fits = F.when(F.col("quote") == "", F.col("text") == "").otherwise(F.contains("text", F.col("quote")))
    return met.withColumn("found", F.coalesce(fits, F.lit(False))).drop("text")


def unique_match(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Pairs that are each other's only match on a key."""
    once = lambda df, name: df.withColumn(name, F.count("*").over(Window.partitionBy(key)))
    return once(left, "n_left").where("n_left = 1").join(once(right, "n_right").where("n_right = 1"), key).drop("n_left", "n_right")
