"""Scalar functions over columns: URLs, normalised text, quantities, language measures."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def canonical_url(url: Column, sort_query: bool = False) -> Column:
    """Identity of an http(s) URL: lower scheme and host, no default port, no fragment.

    The audit identity also drops trailing slashes; with ``sort_query`` (the evaluation
    identity) query pairs are sorted and the path is kept.  Other URLs stay as they are.
    """
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z]+)://", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]*)", 1))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).otherwise(F.regexp_replace(host, ":443$", ""))
    path = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    if sort_query:
        query = F.array_join(F.array_sort(F.split(query, "&")), "&")
    else:
        path = F.regexp_replace(path, "/+$", "")
    tail = F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query))
    return F.when(scheme.isin("http", "https"), F.concat(scheme, F.lit("://"), host, path, tail)).otherwise(url)


def casefold(text: Column) -> Column:
    """Case folded: lower case, with sharp s as two letters and one sigma.  Other letters that fold to several (ligatures) stay."""
    return F.replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def normal_text(text: Column) -> Column:
    """White space collapsed and trimmed, case folded."""
    return casefold(F.trim(F.regexp_replace(text, r"\s+", " ")))


def safe_target(url: Column) -> Column:
    """http(s) with a host and no credentials, or mailto; no white space, control or backslash."""
    web = url.rlike(r"^(?i)https?://[^/?#@\s\\]+([/?#][^\s\\]*)?$")
    return ~url.rlike(r"[\x00-\x20\\]") & (web | url.rlike(r"^(?i)mailto:[^@\s]+@[^@\s]+$"))


def authored_text(markdown: Column) -> Column:
    """Markdown without code, quotes, link targets, URLs and tags."""
    for pattern, new in ((r"(?s)```.*?```", " "), (r"`[^`\n]*`", " "), (r"(?m)^ {0,3}>.*$", " "), (r"\]\([^)\n]*\)", "] "), (r"https?://\S+", " "), (r"<[^>\n]*>", " ")):
        markdown = F.regexp_replace(markdown, pattern, new)
    return markdown


def latin_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[A-Za-z]+"))


def han_characters(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[\x{4E00}-\x{9FFF}]"))


def format_signature(text: Column) -> Column:
    """Letters, numbers and symbols in lower case, then the numbers: equal if only spacing or punctuation differ."""
    return F.concat_ws("|", F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\p{S}]", ""), F.array_join(F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)), ","))


def unwrapped_markers(text: Column) -> Column:
    """``![x]({{source:id}})`` becomes ``{{source:id}}``."""
    return F.regexp_replace(text, r"!\[[^\]\n]*\]\((\{\{source:[^}\n]+\}\})\)", "$1")


def ellipsised(text: Column, limit: int) -> Column:
    return F.when(F.char_length(text) > limit, F.concat(F.left(text, F.lit(limit - 1)), F.lit("…"))).otherwise(text)


def register(spark: SparkSession) -> None:
    """SQL functions of the library, for use in ``spark.sql``."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION processor_casefold(x STRING) RETURNS STRING RETURN replace(replace(lower(x), 'ß', 'ss'), 'ς', 'σ')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION normal_text(x STRING) RETURNS STRING RETURN processor_casefold(trim(regexp_replace(x, '\\\\s+', ' ')))")
