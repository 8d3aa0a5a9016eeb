"""Jaccard join of shingle sets in metric space: pivots, regions, triangle-inequality windows, recursion.

Two texts link when the Jaccard similarity of their sets of ``SHINGLE``-word shingles is at least ``PERCENT`` per cent; linked
documents form components.  With s the sum of two sets' sizes, that is the same as a symmetric difference of at most
``reach(s) = s (100 - PERCENT) div (100 + PERCENT)`` shingles, and the symmetric difference is a metric.  Documents with equal sets are
one point of that space from the start.

First regions.  Unrelated texts all lie about equally far from any pivot document, and a window of twice the threshold
holds them all; so pivots can't part them.  The space is first cut into cells: the universe of shingles is parted
into m classes by hash (m depends on the bracket of the set's size; a set near the upper end of its bracket takes part in
the next one as well).  Two linked sets differ in at most ``reach`` shingles and so agree in all but that many classes.  So each set
registers under its ``reach + 1`` fullest classes (a common order of all classes' contents): any two linked ones share a cell,
and a cell is the hash of several shingles, so that hardly any others do.  Cells with one set are dropped.

Pivots.  The pivot of each cell is its densest set (the one with the most company in all its cells).  All cells with one
pivot make one region.  Each member is carried as its difference D from the pivot, which is short; r, the size of D, is its distance to the
pivot, and ``d(x, y) = r(x) + r(y) - 2 |D(x) & D(y)|`` is exact.  Regions of up to ``SMALL`` members are joined on these differences at once.
Larger ones are parted around their pivot.  What links with the pivot is in its component, and two members that both do need no
comparison.  Every other linked pair obeys the triangle inequality: r(x) and r(y) differ by at most the reach (so regions are cut into
rings, and a member near the outer border of its ring is copied to the next), and the pair shares at least ``(r(x) + r(y) - reach) / 2 >= 1``
shingles of its differences.  So members register under the first shingles of their difference, as many as guarantee that such a
pair meets; where the pivot stands apart from the majority of a sample of its region, come last, as most members share those.  What
meets in a ring under a shingle is a region of the next level, with a pivot of its own, until no region holds two sets that
are not known to be of one component.  A pivot takes no part in the regions below its own, so the recursion ends.

How it scales.  Sets of documents travel only for those that share a cell, once for each region they are in.
Keys are grouped with map-side aggregation, and the joins that bring members together are
sort-merge joins whose hot keys adaptive execution splits.  A task holds one small region, of ``SMALL`` members and ``SMALL_SHINGLES`` shingles
at most; of a larger one it holds a member at a time.  Only ids are ever broadcast, up to ``BROADCAST_ROWS`` of them.

Edge cases: a null text, or one without words, has the empty set and is linked with nothing (its component is its own
doc_id); one or two words are one shingle; rows that repeat a doc_id are judged by their own texts; a null doc_id is not
reachable as a component's number, which is null where nothing else is linked; an empty table gives no rows; very long texts are
taken whole; other columns are ignored.  Shingles are told apart by 64 bits of hash, sets by 128.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.cells import _SALT, Brackets, cells, own_reach, reach
from tracewell.llm.simhash import _LOWER, _roots, components
from tracewell.llm.words import mixed, rolling, text_batches, word_hashes
from tracewell.plans.staging import stage

#: Words of a shingle, and the least similarity in per cent.
SHINGLE, PERCENT = 3, 90
#: Rows of ids that are broadcast at most; beyond, they are joined by sorting.
BROADCAST_ROWS = 500_000

#: Members of a region, and shingles of all of them, up to which it is joined in one task.
SMALL, SMALL_SHINGLES = 2_048, 4_000_000
#: Members of a larger region whose majority shows where its pivot stands apart; it decides an order only.
SAMPLED = 31
#: Columns of a region's shingles that are multiplied together.
_AT_ONCE = 1_024

def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the different shingles of a text, in order."""
    h = word_hashes().of((text or b"").translate(_LOWER).split())
    return np.unique(rolling(h, min(shingle, max(1, len(h)))))


def difference(pivot: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, int]:
    """(shingles that only one of two sets has, how many both have)."""
    at = np.minimum(np.searchsorted(pivot, own), len(pivot) - 1)
    shared = pivot[at] == own
    kept = np.zeros(len(pivot), dtype=bool)
    kept[at[shared]] = True
    return np.concatenate([own[~shared], pivot[~kept]]), int(shared.sum())


def registers(pivot: np.ndarray, own: np.ndarray, majority: np.ndarray, percent: int) -> tuple[bool, np.ndarray]:
    """(whether a set links with its pivot, the regions of the next level that it registers under)."""
    apart, common = difference(pivot, own)
    linked = 100 * common >= percent * (len(own) + len(pivot) - common)
    r, most = len(apart), own_reach(len(own), percent)
    need = max(1, r - most)  # shingles of the difference that a linked set shares at least
    if linked:  # only sets that don't link with the pivot matter, and those lie farther out
        farther = reach(-(-percent * len(own) // 100) + len(pivot), percent) + 1
        need = max(need, -(-(r + farther - most) // 2))
    length = r - need + 1
    if length <= 0:
        return linked, np.zeros(0, dtype=np.uint64)
    late = np.isin(apart, pivot) != np.isin(apart, majority)
    hashes = mixed(apart ^ _SALT)
    hashes = hashes[np.lexsort((hashes, late))[:length]]
    width = 4 * own_reach(len(pivot), percent) + 4
    with np.errstate(over="ignore"):
        return linked, np.concatenate([mixed(hashes + np.uint64(ring)) for ring in range(r // width, (r + most) // width + 1)])


def joined(sizes: np.ndarray, differences: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a region as stars (centre, leaf): sizes of its sets, and their differences from one pivot."""
    n, r = len(sizes), np.array([len(d) for d in differences], dtype=np.int64)
    owner = np.repeat(np.arange(n), r)
    _, element, holders = np.unique(np.concatenate(differences), return_inverse=True, return_counts=True)
    several = holders[element] > 1
    element, owner = np.unique(element[several], return_inverse=True)[1], owner[several]
    order = np.argsort(element, kind="stable")
    element, owner = element[order], owner[order]
    both = np.zeros((n, n), dtype=np.float32)  # counts stay far below 2 ** 24
    last = int(element[-1]) + 1 if len(element) else 0
    for begin in range(0, last, _AT_ONCE):
        low, high = np.searchsorted(element, [begin, begin + _AT_ONCE])
        held = np.zeros((n, min(_AT_ONCE, last - begin)), dtype=np.float32)
        held[owner[low:high], element[low:high] - begin] = 1
        both += held @ held.T
    us, vs = [], []
    for row in range(n - 1):
        apart = r[row] + r[row + 1 :] - 2 * both[row, row + 1 :].astype(np.int64)
        near = np.flatnonzero(apart <= (sizes[row] + sizes[row + 1 :]) * (100 - percent) // (100 + percent)) + row + 1
        us.append(np.full(len(near), row))
        vs.append(near)
    u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs))
    root = _roots(n, u, v)
    leaf = np.flatnonzero(root != np.arange(n))
    return root[leaf], leaf


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _registered(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, cells): set_key is null for the empty set."""

    def register(batches):
        brackets = Brackets(percent)
        for batch, texts in text_batches(batches):
            sets = [shingle_set(t, shingle) for t in texts]
            keys = [xxhash.xxh3_128_digest(s.astype("<u8").tobytes()) if len(s) else None for s in sets]
            columns = [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), _lists([cells(s, brackets) for s in sets])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "set_key", "cells"])

    return docs.mapInArrow(register, "doc_id long, n_shingles long, set_key binary, cells array<long>")


def _few(df: DataFrame) -> DataFrame:
    """A staged table of ids with the strategy of its joins: broadcast where its rows are counted and few, else by sorting."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("merge")


def _sets(docs: DataFrame, signed: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(rep, set_key, shingles) of the wanted sets, each once; rep is the first half of its key."""
    ids = signed.hint("merge").join(wanted, "rep", "left_semi").groupBy("set_key").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    ids = stage(ids, "wanted")
    picked = docs.join(_few(ids), docs.doc_id.eqNullSafe(ids.doc_id), "left_semi")

    def cut(batches):
        for batch, texts in text_batches(batches):
            sets = [s for s in (shingle_set(t, shingle) for t in texts) if len(s)]
            keys = [xxhash.xxh3_128_digest(s.astype("<u8").tobytes()) for s in sets]
            reps = np.array([int.from_bytes(k[:8], "big") for k in keys], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(keys, pa.binary()), _lists(sets)], names=["rep", "set_key", "shingles"])

    found = picked.mapInArrow(cut, "rep long, set_key binary, shingles array<long>")
    return found.hint("merge").join(wanted, "rep", "left_semi").dropDuplicates(["rep", "set_key"])


def _arrays(column: pa.Array) -> list[np.ndarray]:
    """The rows of a list column, as views of its values."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def _with_sets(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Members with their own set and that of their pivot."""
    pivots = sets.select(F.col("rep").alias("pivot"), F.col("set_key").alias("pivot_key"), F.col("shingles").alias("of_pivot"))
    return members.hint("merge").join(sets, "rep").hint("merge").join(pivots, "pivot")


def _small_regions(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of regions that fit into a task, as stars."""

    def differ(batches):
        for batch in batches:
            found = [difference(p, x)[0] for p, x in zip(_arrays(batch.column("of_pivot")), _arrays(batch.column("shingles")))]
            n, n_pivot = (pa.array([len(x) for x in _arrays(batch.column(c))], pa.int64()) for c in ("shingles", "of_pivot"))
            columns = [batch.column("path"), batch.column("pivot_key"), n_pivot, batch.column("set_key"), n, _lists(found)]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "pivot_key", "n_pivot", "set_key", "n", "apart"])

    def join(batches):
        held: list[tuple] = []

        def links_of(region: list[tuple]) -> pa.RecordBatch:
            pivots = dict(row[1:3] for row in region)  # one, but for two sets with one rep
            out_a, out_b = [], []
            for pivot, n_pivot in pivots.items():
                own = [row for row in region if row[1] == pivot]
                keys = [pivot, *(row[3] for row in own)]
                a, b = joined(np.array([n_pivot, *(row[4] for row in own)], dtype=np.int64), [np.zeros(0, np.uint64), *(row[5] for row in own)], percent)
                out_a += [keys[i] for i in a.tolist()]
                out_b += [keys[i] for i in b.tolist()]
            return pa.RecordBatch.from_arrays([pa.array(out_a, pa.binary()), pa.array(out_b, pa.binary())], names=["a", "b"])

        for batch in batches:
            plain = [batch.column(c).to_pylist() for c in ("path", "pivot_key", "n_pivot", "set_key", "n")]
            for row in zip(*plain, _arrays(batch.column("apart"))):
                if held and held[-1][0] != row[0]:
                    yield links_of(held)
                    held = []
                held.append((*row[:5], row[5].copy()))
        if held:
            yield links_of(held)

    both = _with_sets(members, sets).select("path", "pivot_key", "of_pivot", "set_key", "shingles")
    dealt = both.mapInArrow(differ, "path long, pivot_key binary, n_pivot long, set_key binary, n long, apart array<long>").repartition("path").sortWithinPartitions("path")
    return dealt.mapInArrow(join, "a binary, b binary")


def _majorities(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(path, majority): the shingles that most of a bounded sample of each region have."""
    sampled = members.where(F.pmod(F.xxhash64("rep", "path"), F.floor(F.col("n") / SAMPLED) + 1) == 0).select("path", "rep")
    each = stage(sampled.hint("merge").join(sets.select("rep", "shingles"), "rep"), "sampled")
    n = each.groupBy("path").agg(F.count("*").alias("n_sampled"))
    counts = stage(each.select("path", F.explode("shingles").alias("shingle")).groupBy("path", "shingle").agg(F.count("*").alias("times")), "counts")
    return counts.hint("merge").join(n, "path").where("2 * times > n_sampled").groupBy("path").agg(F.sort_array(F.collect_list("shingle")).alias("majority"))


def _large_regions(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Members of larger regions with their pivots: (path, rep, label, pivot_key, rep_key, linked, registered)."""
    schema = "path long, rep long, label long, pivot_key binary, rep_key binary, linked boolean, registered array<long>"

    def compare(batches):
        for batch in batches:
            found = [registers(*x, percent) for x in zip(*(_arrays(batch.column(c)) for c in ("of_pivot", "shingles", "majority")))]
            linked = [yes for yes, _ in found]
            label = np.where(linked, batch.column("pivot").to_numpy(), batch.column("label").to_numpy()).astype(np.int64)
            columns = [batch.column("path"), batch.column("rep"), pa.array(label), batch.column("pivot_key"), batch.column("set_key"), pa.array(linked, pa.bool_()), _lists([x for _, x in found])]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "rep", "label", "pivot_key", "rep_key", "linked", "registered"])

    majorities = stage(_majorities(members, sets), "majorities")
    both = _with_sets(members, sets).hint("merge").join(majorities, "path", "left").withColumn("majority", F.coalesce("majority", F.array().cast("array<long>")))
    return both.select("path", "rep", "label", "pivot", "pivot_key", "set_key", "shingles", "of_pivot", "majority").mapInArrow(compare, schema)


def _pivoted(shared: DataFrame) -> DataFrame:
    """(path, pivot, rep, label): the members of ``shared(path, key, rep, label)`` with the densest member of each key as pivot."""
    sizes = shared.groupBy("path", "key").agg(F.count("*").alias("size"))
    company = stage(shared.hint("merge").join(sizes, ["path", "key"]).groupBy("path", "rep").agg(F.sum("size").alias("company")), "company")
    dense = stage(shared.hint("merge").join(company, ["path", "rep"]), "dense")
    pivots = dense.groupBy("path", "key").agg(F.max(F.struct("company", "rep")).alias("best")).select("path", "key", F.col("best.rep").alias("pivot"))
    met = dense.hint("merge").join(pivots, ["path", "key"]).where("rep <> pivot")
    return met.groupBy(F.xxhash64("path", "pivot").alias("path"), "pivot", "rep").agg(F.min("label").alias("label"))


def _shared(rows: DataFrame) -> DataFrame:
    """Those of ``rows(path, key, rep, label)`` whose key holds several labels."""
    several = rows.groupBy("path", "key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("path", "key")
    several = stage(several, "shared")
    return stage(rows.join(_few(several), ["path", "key"], "left_semi").distinct(), "members")


def links(docs: DataFrame, registered: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between set keys that join all sets that are similar enough."""
    rep = F.conv(F.hex(F.substring("set_key", 1, 8)), 16, -10).cast("long").alias("rep")
    signed = registered.where("set_key IS NOT NULL").select("doc_id", "set_key", rep)
    rows = registered.where("set_key IS NOT NULL").select(F.lit(0).cast("long").alias("path"), F.explode("cells").alias("key"), rep)
    rows = _shared(rows.withColumn("label", F.col("rep")))
    wanted = stage(rows.select("rep").distinct(), "reps")
    sets = stage(_sets(docs, signed, wanted, shingle), "sets")
    sizes = stage(sets.groupBy("rep").agg(F.sum(F.size("shingles")).cast("long").alias("size")), "sizes")
    out = docs.sparkSession.createDataFrame([], "a binary, b binary")
    while not rows.isEmpty():
        members = stage(_pivoted(rows).hint("merge").join(sizes, "rep"), "members")
        regions = members.groupBy("path").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
        members = stage(members.hint("merge").join(regions, "path").drop("size"), "members")
        small = (F.col("n") <= SMALL) & (F.col("total") <= SMALL_SHINGLES)
        out = out.unionByName(stage(_small_regions(members.where(small), sets, percent), "links"))
        large = members.where(~small)
        if large.isEmpty():
            break
        compared = stage(_large_regions(large, sets, percent), "compared")
        out = out.unionByName(compared.where("linked").select(F.col("pivot_key").alias("a"), F.col("rep_key").alias("b")))
        rows = _shared(compared.select("path", F.explode("registered").alias("key"), "rep", "label"))
    return out.distinct()


def clustered(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id): component_id is the smallest doc_id reachable over links."""
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    registered = stage(_registered(picked, shingle, percent), "registered")
    rooted = components(links(picked, registered, shingle, percent))
    points = stage(registered.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("least")), "points")
    named = stage(points.hint("merge").join(rooted, points.set_key == rooted.node, "left").select("set_key", "least", F.coalesce("root", "set_key").alias("root")), "named")
    lowest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_set = named.hint("merge").join(lowest, "root").select(F.col("set_key").alias("own_key"), "component_id")
    every = registered.select("doc_id", "n_shingles", "set_key")
    found = every.where("set_key IS NOT NULL").hint("merge").join(by_set, F.col("set_key") == F.col("own_key")).select("doc_id", "n_shingles", "component_id")
    return found.unionByName(every.where("set_key IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
