"""Intake: content identity, pools, limits, paths, segmentation, obligations, digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_FILE, MAX_EXPANDED, MAX_OBJECTS = 25_000_000, 100_000_000, 5_000
_RESERVED = "(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\\..*)?$"


def content_identity(files: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    """Adds size, mime (by extension) and sha256 of the exact bytes."""
    kinds = {"txt": "text/plain", "md": "text/markdown", "html": "text/html", "rst": "text/x-rst", "pdf": "application/pdf", "png": "image/png"}
    mime = F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))
    extension = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return files.select(
        "*",
        F.octet_length(content).cast("long").alias("size"),
        F.coalesce(F.try_element_at(mime, extension), F.lit("application/octet-stream")).alias("mime"),
        F.sha2(F.col(content).cast("binary"), 256).alias("sha256"),
    )


def resource_pool(identified: DataFrame) -> DataFrame:
    """One row per different content: its first name, size, and number of occurrences."""
    return identified.groupBy("sha256").agg(F.min("name").alias("name"), F.max("size").alias("size"), F.count("*").alias("occurrences"))


def verify_bytes(registry: DataFrame, contents: DataFrame) -> DataFrame:
    """(key, status) of registered keys: malformed, missing, corrupt or verified."""
    actual = contents.select("key", F.sha2(F.col("content").cast("binary"), 256).alias("actual"))
    status = (
        F.when(~F.col("key").rlike("^[0-9a-f]{64}$"), "malformed")
        .when(F.col("actual").isNull(), "missing")
        .when(F.col("actual") != F.col("key"), "corrupt")
        .otherwise("verified")
    )
    return registry.join(actual, "key", "left").select("key", status.alias("status"))


def unsafe_path(path) -> F.Column:
    """Why a member path is refused, or null."""
    parts = F.split(path, "/")
    return (
        F.when(path.isNull() | (path == ""), "empty")
        .when(F.contains(path, F.lit("\u0000")), "nul")
        .when(F.contains(path, F.lit("\\")), "backslash")
        .when(path.startswith("/"), "absolute")
        .when(path.rlike("^[A-Za-z]:"), "drive")
        .when(F.exists(parts, lambda p: p.isin(".", "..")), "dot")
        .when(F.exists(parts, lambda p: p == ""), "empty part")
        .when(F.exists(parts, lambda p: p.rlike("[. ]$")), "trailing dot or space")
        .when(F.exists(parts, lambda p: p.rlike(_RESERVED)), "reserved name")
    )


def limit_report(files: DataFrame, objects: DataFrame) -> DataFrame:
    """Per material: sizes and counts, and whether each limit holds."""
    sizes = files.groupBy("material_id").agg(
        F.max("size").alias("largest"), F.sum("size").alias("expanded"), F.count("*").alias("files"), F.count_distinct("name").alias("names")
    )
    counted = objects.groupBy("material_id").agg(F.count("*").alias("objects"))
    return sizes.join(counted, "material_id", "left").select(
        "material_id",
        "largest",
        "expanded",
        F.coalesce("objects", F.lit(0)).alias("objects"),
        (F.col("largest") <= MAX_FILE).alias("file_ok"),
        (F.col("expanded") <= MAX_EXPANDED).alias("expanded_ok"),
        (F.coalesce("objects", F.lit(0)) <= MAX_OBJECTS).alias("objects_ok"),
        (F.col("files") == F.col("names")).alias("names_ok"),
    )


def paragraphs(texts: DataFrame) -> DataFrame:
    """Ordered ``text`` objects between blank lines of (material_id, name, text)."""
    parts = texts.select("material_id", "name", F.posexplode(F.split("text", r"\n\s*\n")).alias("pos", "part")).hint("merge").where(F.trim("part") != "")
    nth = F.row_number().over(Window.partitionBy("material_id").orderBy("pos"))
    return parts.withColumn("ord", nth).select(
        "material_id", F.format_string("src-%05d", "ord").alias("object_id"), F.lit("text").alias("kind"), F.col("part").alias("text"), F.concat("name", F.lit("/paragraph["), "ord", F.lit("]")).alias("locator")
    )


def bind_fences(code: DataFrame, fences: DataFrame) -> DataFrame:
    """The k-th code object takes the k-th fence of equal language and stripped content."""
    nth = lambda df: df.withColumn("k", F.row_number().over(Window.partitionBy("material_id", "language", F.trim("content")).orderBy("ord")))
    left, right = nth(code).withColumn("key", F.trim("content")), nth(fences).select("material_id", "language", F.trim("content").alias("key"), "k", "raw")
    return left.join(right, ["material_id", "language", "key", "k"], "left").drop("key", "k")


def ranked_candidates(srcset, fallbacks) -> F.Column:
    """Distinct image URLs: srcset entries by descriptor, best first, then fallbacks in order."""
    entries = F.transform(F.split(srcset, r"\s*,\s*"), lambda e: F.struct(
        (-F.coalesce(F.try_to_number(F.regexp_extract(e, r"\s([0-9]+(?:\.[0-9]+)?)[wx]$", 1), F.lit("999999.999")).cast("double"), F.lit(0.0))).alias("order"),
        F.regexp_extract(F.trim(e), r"^(\S+)", 1).alias("url"),
    ))
    urls = F.transform(F.array_sort(entries), lambda e: e["url"])
    return F.array_distinct(F.filter(F.concat(F.coalesce(urls, F.array().cast("array<string>")), fallbacks), lambda u: u != ""))


def append_namespaced(existing: DataFrame, incoming: DataFrame, prefix: str) -> DataFrame:
    """Union of two inventories; ids, parents and scopes of the incoming one get a prefix."""
    tag = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit(prefix), F.col(c)))
    moved = incoming.withColumns({c: tag(c) for c in ("object_id", "parent_id", "scope") if c in incoming.columns})
    return existing.unionByName(moved)


def append_obligations(obligations: DataFrame, objects: DataFrame, additions: DataFrame, limit: int = 10_000) -> DataFrame:
    """Additions with the reason why each is refused, or null: id taken, object unknown, blank, or over the limit."""
    known = objects.select("material_id", "object_id", F.lit(True).alias("known")).distinct()
    taken = obligations.select("material_id", "obligation_id", F.lit(True).alias("taken")).distinct()
    total = obligations.groupBy("material_id").agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy("material_id").orderBy("obligation_id"))
    again = F.count("*").over(Window.partitionBy("material_id", "obligation_id"))
    reason = (
        F.when(F.col("taken") | (F.col("again") > 1), "id taken")
        .when(F.col("known").isNull(), "object unknown")
        .when(F.trim("statement") == "", "blank")
        .when(F.coalesce("n", F.lit(0)) + F.col("nth") > limit, "over limit")
    )
    met = additions.withColumns({"nth": nth, "again": again}).join(taken, ["material_id", "obligation_id"], "left").join(known, ["material_id", "object_id"], "left").join(total, "material_id", "left")
    return met.select("material_id", "obligation_id", "object_id", reason.alias("reason"))


def ordered_digest(rows: DataFrame, line, order) -> DataFrame:
    """sha256 per material over lines in order: the digest of an inventory or of its identity columns."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("l")))), lambda x: x["l"])
    return rows.groupBy("material_id").agg(F.sha2(F.array_join(lines, "\n"), 256).alias("digest"))


def source_text(objects: DataFrame) -> DataFrame:
    """Ordered text per material: prose as it is, other kinds as markers."""
    piece = F.when(F.col("kind") == "text", F.col("text")).when(F.col("kind") == "heading", F.concat(F.lit("# "), F.col("text"))).otherwise(F.concat(F.lit("{{source:"), F.col("object_id"), F.lit("}}")))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("ord", piece.alias("piece")))), lambda x: x["piece"])
    return objects.groupBy("material_id").agg(F.array_join(rows, "\n\n").alias("source_text"))


def version_check(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(id, status): existing, different_source_version, failed (not read) or downloaded (not expected)."""
    met = expected.select("id", F.col("sha256").alias("want")).join(actual.select("id", F.col("sha256").alias("have")), "id", "full")
    status = F.when(F.col("have").isNull(), "failed").when(F.col("want").isNull(), "downloaded").when(F.col("want") == F.col("have"), "existing").otherwise("different_source_version")
    return met.select("id", status.alias("status"))


def handoff(identified: DataFrame, usage_rank) -> DataFrame:
    """One attachment per material and content: the occurrence of the most important usage."""
    nth = F.row_number().over(Window.partitionBy("material_id", "sha256").orderBy(usage_rank, "name"))
    return identified.withColumn("nth", nth).where("nth = 1").drop("nth")


def reject_duplicates(manifest: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs more than once, with the count."""
    return manifest.withColumn("n", F.count("*").over(Window.partitionBy(key))).where("n > 1")
