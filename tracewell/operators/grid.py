"""Comparison of table grids: nested arrays of cells, matched by place or by row key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.scalars import casefold


def cells(tables: DataFrame) -> DataFrame:
    """(table_id, r, c, cell) of tables(table_id, grid array<array<string>>)."""
    rows = tables.select("table_id", F.posexplode("grid").alias("r", "row"))
    return rows.select("table_id", "r", F.posexplode("row").alias("c", "cell")).hint("merge")


def signature(grid: Column) -> Column:
    """A digest of a grid's cells and shape."""
    return F.sha2(F.to_json(grid), 256)


def differences(expected: DataFrame, current: DataFrame) -> DataFrame:
    """(table_id, r, c, expected, current) where the grids differ cell by cell; absent cells are null."""
    a, b = cells(expected).withColumnRenamed("cell", "expected"), cells(current).withColumnRenamed("cell", "current")
    return a.join(b, ["table_id", "r", "c"], "full").where(~F.col("expected").eqNullSafe(F.col("current")))


def keyed_differences(expected: DataFrame, current: DataFrame) -> DataFrame:
    """(table_id, key, c, expected, current, state): rows matched by their first cell; repeated or absent keys are ambiguous."""

    def keyed(tables: DataFrame, name: str) -> DataFrame:
        rows = tables.select("table_id", F.explode("grid").alias("row")).hint("merge").select("table_id", F.col("row")[0].alias("key"), "row")
        return rows.withColumn(f"{name}_n", F.count("*").over(Window.partitionBy("table_id", "key"))).withColumnRenamed("row", name)

    met = keyed(expected, "want").join(keyed(current, "have"), ["table_id", "key"], "left")
    state = F.when(F.col("have_n").isNull(), "missing row").when((F.col("want_n") > 1) | (F.col("have_n") > 1), "ambiguous row")
    pairs = F.arrays_zip(F.col("want").alias("want"), F.coalesce("have", F.array().cast("array<string>")).alias("have"))
    wide = met.select("table_id", "key", state.alias("state"), F.posexplode(F.when(state.isNull(), pairs).otherwise(F.slice(pairs, 1, 1))).alias("c", "pair"))
    return wide.where(F.col("state").isNotNull() | ~F.col("pair.want").eqNullSafe(F.col("pair.have"))).select("table_id", "key", "c", F.col("pair.want").alias("expected"), F.col("pair.have").alias("current"), "state").distinct()


def matched_columns(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """(table_id, name, want_c, have_c, state) of ``wanted(table_id, c, name)`` in ``found(table_id, c, name)``: the one header that holds the name.

    Headers are compared without case.  An equal header comes before those that only hold the name.  A name that no header holds is a ``missing column``; one
    that several hold, or whose header holds several names, is an ``ambiguous column``.
    """
    want = wanted.select("table_id", F.col("c").alias("want_c"), "name", casefold(F.col("name")).alias("key"))
    have = found.select("table_id", F.col("c").alias("have_c"), casefold(F.col("name")).alias("header"))
    met = want.hint("merge").join(have, "table_id").where(F.contains("header", F.col("key"))).withColumn("equal", F.col("key") == F.col("header"))
    of_name, of_header = Window.partitionBy("table_id", "want_c"), Window.partitionBy("table_id", "have_c")
    best = met.withColumn("any", F.bool_or("equal").over(of_name)).where("equal OR NOT any").withColumn("taken", F.bool_or("equal").over(of_header)).where("equal OR NOT taken")
    single = best.withColumns({"names": F.count("*").over(of_name), "headers": F.count("*").over(of_header)})
    told = single.groupBy("table_id", "want_c").agg(F.min(F.when((F.col("names") == 1) & (F.col("headers") == 1), F.col("have_c"))).alias("have_c"), F.lit(True).alias("met"))
    state = F.when(F.col("met").isNull(), "missing column").when(F.col("have_c").isNull(), "ambiguous column")
    return want.hint("merge").join(told, ["table_id", "want_c"], "left").select("table_id", "name", "want_c", "have_c", state.alias("state"))


def headed_differences(expected: DataFrame, current: DataFrame) -> DataFrame:
    """(table_id, key, name, expected, current, state): grids compared by row key and column header, wherever the columns stand.

    ``expected`` and ``current`` are ``(table_id, r, c, text)``; row 0 has the headers and column 0 the keys.  Columns are told by ``matched_columns``; a
    missing or ambiguous column is one row without a key, a row that is missing or repeated one without a name.
    """
    heads = lambda df: df.where("r = 0 AND c > 0").select("table_id", "c", F.col("text").alias("name"))
    columns = matched_columns(heads(expected), heads(current))

    def keyed(df: DataFrame) -> DataFrame:
        keys = df.where("r > 0 AND c = 0").select("table_id", "r", F.col("text").alias("key"))
        return keys.withColumn("n", F.count("*").over(Window.partitionBy("table_id", "key")))

    lost = columns.where("state IS NOT NULL").select("table_id", F.lit(None).cast("string").alias("key"), "name", F.col("name").alias("expected"), F.lit(None).cast("string").alias("current"), "state")
    want, have = keyed(expected), keyed(current).select("table_id", "key", F.col("r").alias("have_r"), F.col("n").alias("have_n"))
    rows = want.hint("merge").join(have, ["table_id", "key"], "left").withColumn("state", F.when(F.col("have_n").isNull(), "missing row").when((F.col("n") > 1) | (F.col("have_n") > 1), "ambiguous row"))
    none = rows.where("state IS NOT NULL").select("table_id", "key", F.lit(None).cast("string").alias("name"), F.col("key").alias("expected"), F.lit(None).cast("string").alias("current"), "state").distinct()
    pairs = rows.where("state IS NULL").select("table_id", "key", "r", "have_r").hint("merge").join(columns.where("state IS NULL").select("table_id", "name", "want_c", "have_c"), "table_id")
    left = expected.select("table_id", "r", F.col("c").alias("want_c"), F.col("text").alias("expected"))
    right = current.select("table_id", F.col("r").alias("have_r"), F.col("c").alias("have_c"), F.col("text").alias("current"))
    met = pairs.hint("merge").join(left, ["table_id", "r", "want_c"], "left").hint("merge").join(right, ["table_id", "have_r", "have_c"], "left")
    unlike = met.where(~F.col("expected").eqNullSafe(F.col("current"))).select("table_id", "key", "name", "expected", "current", F.lit("other text").alias("state"))
    return lost.unionByName(none).unionByName(unlike)


def unique_tables(source: DataFrame, draft: DataFrame) -> DataFrame:
    """(source_id, draft_id): tables that are each other's only one of their signature."""
    from tracewell.operators.binding import unique_match

    left = source.select(F.col("table_id").alias("source_id"), signature(F.col("grid")).alias("signature"))
    right = draft.select(F.col("table_id").alias("draft_id"), signature(F.col("grid")).alias("signature"))
    return unique_match(left, right, "signature").select("source_id", "draft_id")


def latest_grids(saved: DataFrame, keys: list[str]) -> DataFrame:
    """The latest saved grid per key; ``conflict`` where its latest version holds several."""
    top = saved.withColumn("rank", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc("version")))).where("rank = 1")
    return top.groupBy(*keys).agg(F.max("version").alias("version"), F.min("digest").alias("digest"), (F.count_distinct("digest") > 1).alias("conflict"))


def repaired(tables: DataFrame, fixes: DataFrame) -> DataFrame:
    """(table_id, r, markdown): rows rebuilt with the expected cells in the places that differ."""
    fix = fixes.select("table_id", "r", "c", F.col("expected").alias("fixed"))
    met = cells(tables).join(fix, ["table_id", "r", "c"], "left").withColumn("cell", F.coalesce("fixed", "cell"))
    row = F.transform(F.array_sort(F.collect_list(F.struct("c", "cell"))), lambda x: x["cell"])
    return met.groupBy("table_id", "r").agg(F.concat(F.lit("| "), F.array_join(row, " | "), F.lit(" |")).alias("markdown"))
