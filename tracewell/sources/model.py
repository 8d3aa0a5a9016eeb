"""The document model over Parquet tables: materials, objects, obligations, blocks, events.

A document is a material; its non-blank lines are ordered, typed source objects; every object
carries one obligation.  A conversation is a draft; its turns are ordered blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def object_kind(text) -> F.Column:
    """The kind of a line, by its marks."""
    return (
        F.when(F.contains(text, F.lit(" | ")), "table")
        .when(F.contains(text, F.lit("$$$")), "formula")
        .when(F.contains(text, F.lit("###")), "code")
        .when(F.contains(text, F.lit("!!")), "heading")
        .otherwise("text")
    )


def line_objects(docs: DataFrame, hint: str | None = "merge") -> DataFrame:
    """(material_id, object_id, ord, kind, text, locator): the non-blank lines of each document.

    Without ``hint``, the next join must set its strategy by the other side.
    """
    lines = docs.select(F.col("doc_id").alias("material_id"), F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    lines = lines.where(F.trim("text") != "")
    return (lines.hint(hint) if hint else lines).select(
        "material_id",
        F.format_string("src-%05d", F.col("ord") + 1).alias("object_id"),
        F.col("ord").cast("long").alias("ord"),
        object_kind(F.col("text")).alias("kind"),
        "text",
        F.concat(F.lit("doc-"), F.col("material_id"), F.lit("/line["), F.col("ord") + 1, F.lit("]")).alias("locator"),
    )


def objects(spark: SparkSession, sf_dir: str, hint: str | None = "merge") -> DataFrame:
    return line_objects(table(spark, sf_dir, "documents"), hint)


def quantities(text) -> F.Column:
    """Every number or percentage in a text."""
    return F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?%?)"), F.lit(1))


def obligations(objs: DataFrame) -> DataFrame:
    """One obligation per object: its text (or that the object is preserved), and its quantities."""
    statement = F.when(F.col("kind") == "text", F.col("text")).otherwise(F.concat(F.lit("preserve "), F.col("kind")))
    return objs.select("material_id", F.concat(F.lit("obl-"), F.col("object_id")).alias("obligation_id"), "object_id", statement.alias("statement"), quantities(F.col("text")).alias("quantities"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(material_id, block_id, ord, kind, markdown) from conversation turns."""
    kind = F.when(F.col("role") == "system", "document_info").when(F.col("role") == "user", "source").otherwise("explanation")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("material_id"),
        F.format_string("b-%04d", F.col("turn")).alias("block_id"),
        F.col("turn").cast("long").alias("ord"),
        kind.alias("kind"),
        F.coalesce("text", F.lit("")).alias("markdown"),
    )


#: The same model as SQL common table expressions.
OBJECTS_SQL = """objects AS (
    SELECT material_id, printf('src-%05d', ord + 1) AS object_id, ord, text,
           CASE WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, '$$$') THEN 'formula' WHEN contains(text, '###') THEN 'code'
                WHEN contains(text, '!!') THEN 'heading' ELSE 'text' END AS kind,
           'doc-' || material_id || '/line[' || (ord + 1) || ']' AS locator
    FROM (SELECT doc_id AS material_id, unnest(string_split(text, chr(10))) AS text,
                 generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents WHERE text IS NOT NULL)
    WHERE trim(text) <> ''
)"""
OBLIGATIONS_SQL = (
    OBJECTS_SQL
    + """, obligations AS (
    SELECT material_id, 'obl-' || object_id AS obligation_id, object_id, CASE WHEN kind = 'text' THEN text ELSE 'preserve ' || kind END AS statement,
           regexp_extract_all(text, '(\\d+(?:\\.\\d+)?%?)', 1) AS quantities FROM objects
)"""
)
BLOCKS_SQL = """blocks AS (
    SELECT conv_id AS material_id, printf('b-%04d', turn) AS block_id, turn AS ord,
           CASE role WHEN 'system' THEN 'document_info' WHEN 'user' THEN 'source' ELSE 'explanation' END AS kind, coalesce(text, '') AS markdown
    FROM conversations
)"""
