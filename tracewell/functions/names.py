"""Name keys: compatibility-normalised and case-folded."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def name_key(names: pd.Series) -> pd.Series:
    """NFKC and case folding, by which sibling names are equal."""
    return names.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


def valid_name(name: Column) -> Column:
    """1 to 180 characters, no separators or control characters."""
    return F.char_length(name).between(1, 180) & ~name.rlike(r"[/\\\x00-\x1f]")
