"""Folder hierarchies: lineages, paths, closures, counts, listings, moves, trash.

A folder's lineage is the list of folders from its root to itself, found by doubling: a folder takes on the lineage of the ancestor it points to,
so a round reaches twice as many levels; ``JUMPS`` rounds are one job, which is written before the next.  Descendants, nested
selections and cycles of moves are read from lineages, without a closure.  A folder whose parent is unknown stands at the root.  Folders in or
below a cycle have no lineage and no path; what they reach is walked apart.  Lineages are as long as a tree is deep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.names import name_key
from tracewell.functions.scalars import casefold
from tracewell.plans.staging import stage

#: Rounds of doubling in one job: eight levels in the first one.
JUMPS = 3


def _jumped(known: DataFrame) -> DataFrame:
    """Every unfinished row with its ancestor's lineage before its own; a lineage that repeats a folder is a cycle's and goes."""
    up = known.select(F.col("id").alias("above"), F.col("above").alias("next"), F.col("lineage").alias("head"), F.col("path").alias("head_path"))
    far = known.where("above IS NOT NULL").join(up, "above").select("id", F.col("next").alias("above"), F.concat("head", "lineage").alias("lineage"), F.concat_ws("/", "head_path", "path").alias("path"))
    return known.where("above IS NULL").unionByName(far.where(F.size(F.array_distinct("lineage")) == F.size("lineage")))


def lineages(folders: DataFrame) -> DataFrame:
    """(id, lineage, path) from folders(id, parent, name): ids and names from the root down."""
    ids = folders.select(F.col("id").alias("parent"), F.lit(True).alias("is_known"))
    met = folders.select("id", "parent", F.col("name").cast("string").alias("path")).join(ids, "parent", "left")
    known = met.select("id", F.when(F.col("is_known"), F.col("parent")).alias("above"), F.array("id").alias("lineage"), "path")
    while True:
        for _ in range(JUMPS):
            known = _jumped(known)
        known = stage(known, "lineages")
        if known.where("above IS NOT NULL").isEmpty():
            return known.select("id", "lineage", "path")


def paths(folders: DataFrame) -> DataFrame:
    """(id, path, depth): names from the root down."""
    return lineages(folders).select("id", "path", (F.size("lineage") - 1).alias("depth"))


def reached(edges: DataFrame, starts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, root, id): what ``edges(keys, parent, id)`` reach from ``starts(keys, root, id)``, these included; each pair once."""
    seen = stage(starts.select(*keys, "root", "id").distinct(), "reached")
    jump, before = edges.where("parent is not null").select(*keys, "parent", "id").distinct(), -1
    while True:
        n = seen.count()
        if n == before:
            return seen
        before = n
        jump = stage(jump, "jumps")
        on = jump.select(*keys, F.col("parent").alias("at"), F.col("id").alias("next"))
        further = seen.withColumnRenamed("id", "at").hint("merge").join(on, [*keys, "at"]).select(*keys, "root", F.col("next").alias("id"))
        seen = stage(seen.unionByName(further).distinct(), "reached")
        jump = jump.withColumnRenamed("id", "at").hint("merge").join(on, [*keys, "at"]).select(*keys, "parent", F.col("next").alias("id")).distinct()


def _in_cycles(folders: DataFrame, known: DataFrame, roots: DataFrame) -> DataFrame | None:
    """(root, id) of what roots without a lineage reach: those in or below a cycle; None if there are no such folders."""
    lost = folders.select("id", "parent").join(known.select("id"), "id", "left_anti")
    if lost.isEmpty():
        return None
    return reached(lost, lost.join(roots.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("root"), "id"), [])


def descendants(folders: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, id) of every folder under a root, itself included; each pair once."""
    known = lineages(folders)
    above = known.select("id", F.explode("lineage").alias("root")).hint("merge")
    found = above.join(roots.select(F.col("id").alias("root")).distinct(), "root", "left_semi").select("root", "id")
    cyclic = _in_cycles(folders, known, roots)
    return found if cyclic is None else found.unionByName(cyclic.select("root", "id"))


def pruned_roots(folders: DataFrame, selected: DataFrame) -> DataFrame:
    """Selected folders that are not below another selected one."""
    known = lineages(folders)
    own = known.join(selected.select("id").distinct(), "id", "left_semi")
    above = own.select(F.explode("lineage").alias("above"), "id").where("above <> id")
    cyclic = _in_cycles(folders, known, selected)
    if cyclic is not None:
        above = above.unionByName(cyclic.where("root <> id").select(F.col("root").alias("above"), "id"))
    nested = above.hint("merge").join(selected.select(F.col("id").alias("above")).distinct(), "above", "left_semi").select("id").distinct()
    return selected.join(nested, "id", "left_anti")


def child_counts(folders: DataFrame, documents: DataFrame) -> DataFrame:
    """(parent, folders, documents) of visible children."""
    rows = folders.select("parent", F.lit(1).alias("f"), F.lit(0).alias("d")).unionByName(documents.select("parent", F.lit(0).alias("f"), F.lit(1).alias("d")))
    return rows.groupBy("parent").agg(F.sum("f").cast("long").alias("folders"), F.sum("d").cast("long").alias("documents"))


def listed(folders: DataFrame, documents: DataFrame, space: str = "mine", parent=None, query: str = "", sort: str = "name", offset: int = 0, limit: int = 200, folders_only: bool = False) -> DataFrame:
    """A page of a space: (place, total, id, kind, title, parent, path, child_count), folders before documents.

    ``folders(id, parent, name, trashed, created)``, ``documents(id, parent, title, trashed, archived, created)``.  A space is ``mine``, ``archive`` (which
    has no folders) or ``trash``.  Without a query the children of ``parent`` are listed; at the root (null) also what hangs under a folder that
    the space doesn't show, and in the archive everything.  A query, whatever its case, is sought in the folders' paths; in the documents' titles,
    in the paths of their folders, and, if it has a slash, as the end of a path and the beginning of a title.  ``sort`` is ``name``,
    ``reverse`` or ``recent``; equal ones follow their ids.  With ``folders_only`` all folders are listed.
    """
    needle = query.strip().casefold()
    shown = folders.where(F.lit(space != "archive") & (F.col("trashed") == F.lit(space == "trash")))
    held = documents.where(F.col("trashed") if space == "trash" else ~F.col("trashed") & (F.col("archived") == F.lit(space == "archive")))
    places = lineages(folders).select(F.col("id").alias("parent"), F.col("path").alias("above"), F.lit(True).alias("has_path"))
    visible = shown.select(F.col("id").alias("parent"), F.lit(True).alias("is_shown"))
    counts = shown.select("parent").unionByName(held.select("parent")).groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("child_count"))
    rows = [shown.select("id", F.lit("folder").alias("kind"), F.col("name").alias("title"), "parent", "created")]
    if not folders_only:
        rows.append(held.select("id", F.lit("document").alias("kind"), "title", "parent", "created"))
    found = rows[0] if folders_only else rows[0].unionByName(rows[1])
    found = found.join(places, "parent", "left").join(visible, "parent", "left").withColumn("path", F.coalesce("above", F.lit("")))
    is_folder, at_root = F.col("kind") == "folder", F.col("parent").isNull() | F.col("is_shown").isNull()
    if needle:
        whole = casefold(F.concat_ws("/", F.nullif("path", F.lit("")), "title"))
        of_document = F.contains(casefold(F.col("title")), F.lit(needle)) | (F.col("has_path") & F.contains(casefold(F.col("path")), F.lit(needle)))
        if "/" in needle:
            end, begin = needle.rsplit("/", 1)
            under = F.col("has_path") & F.endswith(casefold(F.col("path")), F.lit(end)) | (F.lit(not end) & F.col("parent").isNull())
            of_document |= under & F.startswith(casefold(F.col("title")), F.lit(begin))
        wanted = F.when(is_folder, F.contains(F.concat(F.when(F.col("path") == "", F.lit("/")).otherwise(F.lit("")), whole), F.lit(needle))).otherwise(F.coalesce(of_document, F.lit(False)))
    elif folders_only:
        wanted = F.lit(True)
    elif parent is not None:
        wanted = F.col("parent") == F.lit(parent)
    else:
        wanted = at_root | (F.lit(space == "archive") & ~is_folder)
    key = {"recent": [F.col("created").desc_nulls_last(), F.col("id").asc()], "reverse": [F.col("name_key").desc(), F.col("id").desc()]}.get(sort, [F.col("name_key").asc(), F.col("id").asc()])
    return paged(found.where(wanted).withColumn("name_key", name_key("title")), [F.col("kind").desc(), *key], offset, limit).join(counts, "id", "left").select(
        "place", "total", "id", "kind", "title", "parent", "path", F.when(is_folder, F.coalesce("child_count", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("child_count")
    )


def paged(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """The rows of a page with their ``place`` (from 0) and the ``total``; no task sees more than a page and what comes before it."""
    rows = stage(rows, "listed")
    total = rows.count()
    first = rows.orderBy(*order).limit(offset + limit)
    nth = F.row_number().over(Window.orderBy(*order)) - 1
    return first.withColumn("place", nth.cast("long")).where(F.col("place") >= offset).withColumn("total", F.lit(total).cast("long"))


def searched(folders: DataFrame, needle: str) -> DataFrame:
    """(id, path) of folders whose name or path holds a text, whatever its case."""
    return lineages(folders).where(F.contains(casefold(F.col("path")), F.lit(needle.casefold()))).select("id", "path")


def colliding(siblings: DataFrame) -> DataFrame:
    """Siblings whose names have the same key."""
    return siblings.withColumn("n", F.count("*").over(Window.partitionBy("parent", "name_key"))).where("n > 1")


def checked_moves(folders: DataFrame, moves: DataFrame) -> DataFrame:
    """(id, target, reason): moves with why they are refused: unknown target, or into the moved folder itself."""
    known = lineages(folders)
    told = folders.select(F.col("id").alias("target")).join(known.select(F.col("id").alias("target"), "lineage"), "target", "left").withColumn("is_known", F.lit(True))
    met = moves.join(told, "target", "left")
    inside = F.coalesce(F.array_contains("lineage", F.col("id")), F.lit(False))
    cyclic = _in_cycles(folders, known, moves)
    if cyclic is not None:
        met = met.join(cyclic.select(F.col("root").alias("id"), F.col("id").alias("target"), F.lit(True).alias("looped")), ["id", "target"], "left")
        inside |= F.coalesce("looped", F.lit(False))
    return met.select("id", "target", F.when(F.col("is_known").isNull(), "unknown target").when(inside, "cycle").alias("reason"))


def trashed(folders: DataFrame, selected: DataFrame) -> DataFrame:
    """(id, trash_group) of what a trash action moves: the closure of the pruned selection, one group per root."""
    return descendants(folders, pruned_roots(folders, selected)).select("id", F.col("root").alias("trash_group"))


def restored(trash: DataFrame, folders: DataFrame, group) -> DataFrame:
    """(id, parent) of a group's folders when restored; a parent that is gone falls back to the root (null)."""
    back = trash.where(F.col("trash_group") == group).select("id")
    alive = folders.join(trash.select("id"), "id", "left_anti").select("id").unionByName(back).select(F.col("id").alias("parent"), F.lit(True).alias("alive"))
    return back.join(folders, "id").join(alive, "parent", "left").select("id", F.when(F.col("alive"), F.col("parent")).alias("parent"))


def purge_preview(closure: DataFrame, documents: DataFrame, blockers: DataFrame) -> DataFrame:
    """Per root: folders, documents, blockers, and a digest over the affected ids, revisions and content versions.

    ``documents(doc_id, parent, revision, version)``, ``blockers(doc_id, status)``: running and uncertain requests block, others don't.  The digest is of
    the number of ``folder:id`` and ``document:id:revision:version`` lines and the sum of their hashes, so no group is gathered.
    """
    docs = documents.select(F.col("parent").alias("id"), "doc_id", F.concat_ws(":", F.lit("document"), "doc_id", "revision", "version").alias("line"))
    blocking = blockers.where(F.col("status").isin("running", "uncertain")).select("doc_id", F.lit(1).alias("blocked")).distinct()
    held = closure.join(docs, "id").join(blocking, "doc_id", "left").select("root", F.lit(None).cast("string").alias("folder"), "doc_id", "blocked", "line")
    every = held.unionByName(closure.select("root", F.col("id").cast("string").alias("folder"), F.concat(F.lit("folder:"), F.col("id").cast("string")).alias("line")), allowMissingColumns=True)
    hashed = F.sum(F.conv(F.left(F.md5(F.col("line").cast("binary")), F.lit(15)), 16, 10).cast("decimal(38,0)"))
    digest = F.sha2(F.concat_ws(":", F.count("*"), hashed), 256)
    return every.groupBy("root").agg(F.count_distinct("folder").alias("folders"), F.count("doc_id").alias("documents"), F.count("blocked").alias("blockers"), digest.alias("digest"))
