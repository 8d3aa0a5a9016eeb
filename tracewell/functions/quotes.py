"""Resolution of quotes to exact places in their sources."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Characters that an ellipsis may stand for.
ELLIPSIS_REACH = 2_000


def resolve(quote: str | None, source: str | None) -> str | None:
    """The exact source text of a quote if it has exactly one match, else null.

    Literally first; then with one ellipsis; then with any white space and punctuation between the words.
    """
    if not quote or not source:
        return source if quote == "" and source == "" else None
    found = source.count(quote)
    if found:
        return quote if found == 1 else None
    halves = re.split(r"\s*(?:\.\.\.|…)\s*", quote)
    if len(halves) == 2 and all(halves):
        pattern = f"{re.escape(halves[0])}.{{0,{ELLIPSIS_REACH}}}?{re.escape(halves[1])}"
    else:
        words = re.findall(r"\w+", quote)
        if not words:
            return None
        pattern = r"(?<!\w)" + r"[\W_]+".join(map(re.escape, words)) + r"(?!\w)"
    matches = re.findall(pattern, source, re.S)
    return matches[0] if len(matches) == 1 else None


@F.pandas_udf(StringType())
def source_quote(quotes: pd.Series, sources: pd.Series) -> pd.Series:
    return pd.Series([resolve(q, s) for q, s in zip(quotes, sources)], dtype=object)
