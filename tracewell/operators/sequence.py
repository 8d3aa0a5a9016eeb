"""Operators over ordered rows: folds, islands, forward fills, batches, top-k and pages."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def folded(rows: DataFrame, keys: list[str], order: list[str], inputs: list[str], start: Callable, step: Callable, name: str, kind: tuple[str, pa.DataType]) -> DataFrame:
    """Adds a column that a fold over the rows of each key gives, in order.

    ``start()`` is a key's first state, ``step(state, values of inputs)`` gives (next state, value of this row).  Rows
    stream through a task in batches and only the state is carried, so a key may be of any size.
    """

    def run(batches):
        key = state = None
        fresh = True
        for batch in batches:
            out = []
            for now, values in zip(zip(*(batch.column(k).to_pylist() for k in keys)), zip(*(batch.column(c).to_pylist() for c in inputs))):
                if fresh or now != key:
                    key, state, fresh = now, start(), False
                state, value = step(state, values)
                out.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind[1])], names=[*batch.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, f"{fields}, {name} {kind[0]}")


def bounded_groups(objects: DataFrame, limit: int = 8_000, max_objects: int = 5_000) -> DataFrame:
    """(material_id, object_id, group): ordered objects in groups of at most ``limit`` characters.

    The fill is greedy, so each group's end depends on the one before: a fold per material, of
    (order, length) alone; texts don't travel.
    """
    narrow = objects.select("material_id", "object_id", F.col("ord").cast("long").alias("ord"), F.char_length("text").cast("long").alias("size"))

    def step(state, values):
        (group, used, n), (size,) = state, values
        if n and (used + size > limit or n >= max_objects):
            group, used, n = group + 1, 0, 0
        return (group, used + size, n + 1), group

    return folded(narrow, ["material_id"], ["ord"], ["size"], lambda: (0, 0, 0), step, "group", ("long", pa.int64())).select("material_id", "object_id", "group")


def globally_numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """Adds each row's place (from 1) in the whole order: ranges are sorted apart and shifted by the counts before them."""
    from tracewell.plans.staging import stage

    placed = stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", 33)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    shift = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    at = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("__part", part).hint("merge").join(shift, "__part").withColumn(name, F.col("__shift") + at + 1).drop("__at", "__part", "__shift")


def transition_pairs(blocks: DataFrame) -> DataFrame:
    """(material_id, a, z): consecutive body blocks; document information is passed over."""
    after = F.lead("block_id").over(Window.partitionBy("material_id").orderBy("ord"))
    return blocks.where("kind <> 'document_info'").select("material_id", F.col("block_id").alias("a"), after.alias("z")).where("z is not null")


def forward_filled(rows: DataFrame, keys: list[str], order: str, column: str) -> DataFrame:
    """Nulls of a column take the latest earlier value."""
    so_far = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(so_far))


def islands(rows: DataFrame, keys: list[str], order: list, changes) -> DataFrame:
    """Adds ``island``: the number of rows so far where ``changes`` holds."""
    so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("change", F.when(changes, 1).otherwise(0)).withColumn("island", F.sum("change").over(so_far)).drop("change")


def streaks(rows: DataFrame, keys: list[str], order: list, fault: str) -> DataFrame:
    """(keys, streak): how often the last fault has come in a row; 0 after a success (null fault)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = islands(rows.withColumn("before", F.lag(fault).over(w)), keys, order, ~F.col(fault).eqNullSafe(F.col("before")))
    runs = marked.groupBy(*keys, "island").agg(F.count("*").alias("n"), F.max(fault).alias("fault"))
    return runs.groupBy(*keys).agg(F.max_by(F.when(F.col("fault").isNull(), 0).otherwise(F.col("n")), "island").alias("streak"))


def read_coverage(ranges: DataFrame, keys: list[str], length: str) -> DataFrame:
    """(keys, fully_read): whether [start, end) ranges cover 0 to the length without a gap."""
    before = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    gap = F.col("start") > F.coalesce(F.max("end").over(before), F.lit(0))
    return ranges.withColumn("gap", gap).groupBy(*keys).agg((~F.bool_or("gap") & (F.max("end") >= F.max(length))).alias("fully_read"))


def bounded_context(blocks: DataFrame, limit: int = 8_000) -> DataFrame:
    """The latest blocks of at most ``limit`` characters; if the newest alone is longer, its tail."""
    newest = Window.partitionBy("material_id").orderBy(F.desc("ord"))
    used = F.sum(F.char_length("markdown")).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    marked = blocks.withColumns({"used": used, "nth": F.row_number().over(newest)}).where((F.col("used") <= limit) | (F.col("nth") == 1))
    return marked.withColumn("markdown", F.right("markdown", F.lit(limit))).drop("used", "nth")


def line_places(blocks: DataFrame) -> DataFrame:
    """(material_id, block_id, first_line, last_line): where each block lies in the joined document."""
    lines = F.regexp_count("markdown", F.lit("\n")) + 1
    before = Window.partitionBy("material_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = blocks.withColumn("lines", lines).withColumn("first_line", F.coalesce(F.sum(F.col("lines") + 1).over(before), F.lit(0)) + 1)
    return rows.select("material_id", "block_id", F.col("first_line").cast("long").alias("first_line"), (F.col("first_line") + F.col("lines") - 1).cast("long").alias("last_line"))


def merged_headings(nodes: DataFrame) -> DataFrame:
    """Heading-only nodes join the next content node: (material_id, target, members)."""
    following = Window.partitionBy("material_id").orderBy("ord").rowsBetween(0, Window.unboundedFollowing)
    target = F.first(F.when(~F.col("heading_only"), F.col("ord")), ignorenulls=True).over(following)
    rows = nodes.withColumn("target", F.coalesce(target, F.col("ord")))
    return rows.groupBy("material_id", "target").agg(F.count("*").alias("members"), F.min("ord").alias("first"))


def latest(rows: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in the given order."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("nth") <= n)


def children_page(folders: DataFrame, documents: DataFrame, parent: str, offset: int, limit: int) -> DataFrame:
    """A page of a folder's children: folders first, then documents, by name; adds the total."""
    rows = folders.select("parent", "id", "name", F.lit(0).alias("rank")).unionByName(documents.select("parent", "id", "name", F.lit(1).alias("rank"))).where(F.col("parent") == parent)
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy("rank", F.lower("name"), "id").offset(offset).limit(limit).crossJoin(F.broadcast(total))
