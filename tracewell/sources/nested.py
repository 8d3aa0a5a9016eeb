"""Nested JSON as rows: a walk over VARIANT values, one level for each round, and what is read from it.

The values still to be opened are a table of their own, written before the next round; so a body may be nested as deep as it likes, no task
holds more than the members of one value, and bodies of any shape are walked together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.plans.staging import stage

# Keys whose strings name a blob, and the shapes of search results.
BLOB_KEYS = ("sha256", "response_markdown_blob")
LIST_KEYS = ("results", "items", "matches", "data", "works")
URL_PATHS = ("$.url", "$.link", "$.href", "$.primary_location.landing_page_url", "$.primary_location.source.homepage_url", "$.id")
TITLE_PATHS = ("$.title", "$.display_name", "$.name")
SNIPPET_PATHS = ("$.snippet", "$.description", "$.highlight")


def members(bodies: DataFrame) -> DataFrame:
    """(id, path, key, kind, value): every member of ``bodies(id, body)`` at any depth; key is null in a list.

    ``path`` has the places of the members on the way (``/key/3``), ``value`` the JSON of the member.  A null body or one that is no JSON has none.
    """
    open_, parts = bodies.select("id", F.lit("").alias("path"), F.col("body").cast("string").alias("value")), []
    while True:
        parsed = open_.withColumn("tree", F.try_parse_json("value")).where("tree IS NOT NULL").select("id", "path", "tree")
        name = f"members_{len(parts)}"
        parsed.createOrReplaceTempView(name)
        kind = "CASE WHEN schema_of_variant(m.value) LIKE 'OBJECT%' THEN 'object' WHEN schema_of_variant(m.value) LIKE 'ARRAY%' THEN 'list' WHEN schema_of_variant(m.value) = 'STRING' THEN 'string' ELSE 'other' END"
        level = open_.sparkSession.sql(f"SELECT id, concat(path, '/', coalesce(m.key, CAST(m.pos AS STRING))) AS path, m.key, {kind} AS kind, to_json(m.value) AS value FROM {name}, LATERAL variant_explode(tree) AS m")
        level = stage(level, "members")
        parts.append(level)
        open_.sparkSession.catalog.dropTempView(name)
        open_ = level.where("kind IN ('object', 'list')").select("id", "path", "value")
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, parts)


def blob_references(bodies: DataFrame, keys: tuple = BLOB_KEYS) -> DataFrame:
    """(id, sha): digests that a body names under one of the keys, at any depth, each once."""
    text = F.get_json_object(F.concat(F.lit('{"v":'), "value", F.lit("}")), "$.v")
    named = members(bodies).where(F.col("key").isin(*keys) & (F.col("kind") == "string")).select("id", text.alias("sha"))
    return named.where(F.col("sha").rlike("^[0-9a-f]{64}$")).distinct()


def _first(paths: tuple[str, ...], row: Column) -> Column:
    """The first of some members that is a text and not empty."""
    return F.coalesce(*(F.nullif(F.try_variant_get(row, p, "string"), F.lit("")) for p in paths))


def search_results(answers: DataFrame) -> DataFrame:
    """(id, rank, title, url, snippet) of the results in ``answers(id, body)``, in order from 1.

    An answer is a list of results, or an object that holds one under the first of ``LIST_KEYS`` that is a list or an object with a list
    ``results``.  Results without an http(s) URL go, and leave their rank free.
    """
    body = F.try_parse_json("body")
    is_list = lambda v: F.schema_of_variant(v).startswith("ARRAY")
    held = []
    for key in LIST_KEYS:
        for path in (f"$.{key}", f"$.{key}.results"):
            value = F.try_variant_get(F.col("tree"), path, "variant")
            held.append(F.when(is_list(value), value))
    rows = F.when(is_list(F.col("tree")), F.col("tree")).otherwise(F.coalesce(*held))
    lists = answers.select("id", body.alias("tree")).where("tree IS NOT NULL").select("id", F.try_variant_get(rows, "$", "array<variant>").alias("rows"))
    each = lists.select("id", F.posexplode("rows").alias("place", "row")).hint("merge")
    excerpts = F.array_join(F.try_variant_get("row", "$.excerpts", "array<string>"), " ")
    found = each.select(
        "id", (F.col("place") + 1).alias("rank"), F.coalesce(_first(TITLE_PATHS, F.col("row")), F.lit("")).alias("title"), _first(URL_PATHS, F.col("row")).alias("url"),
        F.coalesce(_first(SNIPPET_PATHS, F.col("row")), F.nullif(excerpts, F.lit("")), F.lit("")).alias("snippet"),
    )
    return found.where(F.col("url").rlike("^https?://"))
