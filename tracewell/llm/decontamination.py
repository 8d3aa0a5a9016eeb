"""Benchmark decontamination: SimHash over item-sized windows, then exact similarity.

A window of a document that has as many words as a benchmark item is a hit if the weighted
Jaccard similarity of their five-word shingles (weights: how often a shingle occurs) is at
least ``MIN_SIMILARITY``.  Words are compared in lower case with ASCII punctuation taken as
white space.

Stages inside one pass over the documents, with no shuffle:

1. For every length that items have, a document's windows of that length slide over its words.  A
   window that reaches the similarity holds at least ``ceil(similarity x item shingles)`` shingles that
   items have, whichever; windows with fewer are not fingerprinted.  This is a necessary condition, so
   it is exact, and it names no item.
2. The remaining windows get a 256-bit SimHash from running sums of shingle bits.  Items are found by
   their fingerprints alone: for each length, 32 blocks of 8 bits index them under every value that is near
   theirs, and as two fingerprints within ``RADIUS`` bits agree in some block to within ``RADIUS // 32`` bits, looking
   up a window's blocks yields every item within the radius.  At similarity 0.8 fingerprints differ in about 39 bits with a
   deviation below 6, so the radius lies four deviations beyond.
3. Candidates are verified by their exact weighted shingle similarity.  Of overlapping hits of
   one item the most similar is kept, the earliest among equals.

The benchmark streams through the driver in slices of ``MAX_ITEM_WORDS`` words; each slice is broadcast,
searched in a pass of its own whose hits are written, and released before the next one.  A worker
builds the index of a slice once.

Edge cases: items or documents with null or wordless text never hit; texts of one to four words
are one shingle, whose fingerprint is its hash: they hit where that is equal; repeated items hit
separately; repeated documents too; documents shorter than an item are one window; an empty table on
either side gives no hits; extra columns are ignored by ``hits`` and kept by ``clean``.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.words import WordHashes, mixed, rolling, text_batches, text_key, word_hashes
from tracewell.plans.staging import stage

SHINGLE = 5
MIN_SIMILARITY = 0.8
#: Bits of a fingerprint, its blocks, and the radius searched.
BITS, BLOCKS, RADIUS = 256, 32, 63
#: Words of benchmark text that are broadcast at once.
MAX_ITEM_WORDS = 2_000_000
#: Words of documents whose positions are handled together.
_WORDS_AT_ONCE = 400_000
#: Window starts of a document that are handled together.
_STARTS_AT_ONCE = 4_096

_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SPACES = bytes(32 if chr(b) in _PUNCTUATION else b for b in range(256))

HITS_SCHEMA = "doc_id long, item_id long, start_word int, n_words int, similarity double"


def normal_words(text: bytes) -> list[bytes]:
    """Lower-case words; ASCII punctuation parts them."""
    lowered = text.lower() if text.isascii() else text.decode("utf-8").lower().encode("utf-8")
    return lowered.translate(_SPACES).split()


def shingle_hashes(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hash per shingle; one to ``size - 1`` words are one shingle."""
    if 0 < len(hashes) < size:
        return rolling(hashes, len(hashes))
    return rolling(hashes, size)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two bags of shingles."""
    x, y = Counter(a.tolist()), Counter(b.tolist())
    common = sum((x & y).values())
    return common / max(1, len(a) + len(b) - common)


def _lanes(shingles: np.ndarray) -> np.ndarray:
    """The 256 bits of each shingle, a row of 0 and 1 for each."""
    with np.errstate(over="ignore"):
        lanes = [mixed(shingles + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) for k in range(1, BITS // 64 + 1)]
    return np.unpackbits(np.stack(lanes, axis=1).astype("<u8").view(np.uint8), axis=1)


def fingerprint(shingles: np.ndarray) -> np.ndarray:
    """256-bit SimHash of a bag of shingles, as 32 bytes."""
    return np.packbits(2 * _lanes(shingles).sum(axis=0, dtype=np.int64) > len(shingles))


class MultiIndex:
    """Fingerprints under all values near those of their blocks; ``within`` finds all that lie within the radius."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        bits = BITS // BLOCKS
        near = np.array([sum(1 << b for b in flipped) for w in range(RADIUS // BLOCKS + 1) for flipped in combinations(range(bits), w)], dtype=np.int64)
        # one list of items for each (block, value), all in one array
        cells = (prints.astype(np.int64)[:, :, None] ^ near[None, None, :]) + (np.arange(BLOCKS) << bits)[None, :, None]
        owner = np.broadcast_to(np.arange(len(prints))[:, None, None], cells.shape).ravel()
        self.order = owner[np.argsort(cells.ravel(), kind="stable")]
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(cells.ravel(), minlength=BLOCKS << bits))])

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``prints``, item) of all pairs within the radius: some block nearly agrees, then all bits are counted."""
        cells = (prints.astype(np.int64) + (np.arange(BLOCKS) << BITS // BLOCKS)).ravel()
        begin, size = self.begin[cells], self.begin[cells + 1] - self.begin[cells]
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
        row = np.repeat(np.repeat(np.arange(len(prints)), BLOCKS), size)
        met = np.unique(row * max(1, len(self.prints)) + self.order[place])
        row, item = np.divmod(met, max(1, len(self.prints)))
        near = np.bitwise_count(prints[row] ^ self.prints[item]).sum(axis=1, dtype=np.int64) <= RADIUS
        return row[near], item[near]


class ItemIndex:
    """The items of one slice: the shingles that occur in any of them, and a multi-index of fingerprints for each length."""

    def __init__(self, items: list[tuple[int, bytes]]):
        hashes = WordHashes()
        self.items = []
        for item_id, text in items:
            words = normal_words(text or b"")
            if words:
                self.items.append((item_id, len(words), shingle_hashes(hashes.of(words))))
        self.known = np.unique(np.concatenate([s for _, _, s in self.items])) if self.items else np.zeros(0, np.uint64)
        self.sieve = np.zeros(1 << 22, dtype=bool)
        self.sieve[(self.known >> np.uint64(42)).astype(np.int64)] = True
        self.short = [k for k, (_, n, _) in enumerate(self.items) if n < SHINGLE]
        by_length: dict[int, list[int]] = {}
        for k, (_, n, _) in enumerate(self.items):
            if n >= SHINGLE:
                by_length.setdefault(n, []).append(k)
        prints = {n: np.stack([fingerprint(self.items[k][2]) for k in ks]) for n, ks in by_length.items()}
        self.lengths = sorted((n, np.array(ks), MultiIndex(prints[n])) for n, ks in by_length.items())


_built: dict[str, ItemIndex] = {}


def _index(key: str, items: list) -> ItemIndex:
    """The index of a slice, built once in each Python worker; the one before it goes."""
    if key not in _built:
        _built.clear()
        _built[key] = ItemIndex(items)
    return _built[key]


def _windows(index: ItemIndex, n: int, at: np.ndarray, begin: int, min_similarity: float):
    """(its items, their index, words, shingles, starts) of the windows of each length that start in a stretch and may reach the similarity."""
    longest = index.lengths[-1][0]
    held = np.searchsorted(at, np.arange(begin, min(n, begin + _STARTS_AT_ONCE + longest) + 1))  # marks before each place
    for length, members, prints in index.lengths:
        need = max(1, math.ceil(min_similarity * (length - SHINGLE + 1) - 1e-9))
        if len(at) < need:
            return  # longer items need more
        width = min(length, n)  # a shorter document is one window
        span = max(1, width - SHINGLE + 1)
        last = min(begin + _STARTS_AT_ONCE - 1, n - width, int(at[-1])) - begin + 1
        if last > 0:
            starts = np.flatnonzero(held[span : span + last] - held[:last] >= need) + begin
            if len(starts):
                yield members, prints, width, span, starts


def _passages(index: ItemIndex, hashes: np.ndarray, at: np.ndarray, min_similarity: float):
    """(item, start, words, similarity) of the hits in one document; ``at``: where shingles of items start."""
    if not index.lengths:
        return
    found: dict[tuple[int, int], list[tuple[float, int]]] = {}
    every = None
    for begin in range(max(0, int(at[0]) - index.lengths[-1][0] + 1), int(at[-1]) + 1, _STARTS_AT_ONCE):
        windows = list(_windows(index, len(hashes), at, begin, min_similarity))
        if not windows:
            continue
        every = shingle_hashes(hashes) if every is None else every
        low, high = min(int(w[4][0]) for w in windows), max(int(w[4][-1]) + w[3] for w in windows)
        sums = np.zeros((high - low + 1, BITS), dtype=np.int32)
        np.cumsum(_lanes(every[low:high]), axis=0, dtype=np.int32, out=sums[1:])
        for members, prints, width, span, starts in windows:
            own = np.packbits(2 * (sums[starts - low + span] - sums[starts - low]) > span, axis=1)
            for row, item in zip(*(x.tolist() for x in prints.within(own))):
                k, start = int(members[item]), int(starts[row])
                s = similarity(every[start : start + span], index.items[k][2])
                if s >= min_similarity:
                    found.setdefault((k, width), []).append((-s, start))
    for (k, width), hits_ in found.items():
        taken: list[int] = []
        for s, start in sorted(hits_):
            if all(abs(start - t) >= width for t in taken):
                taken.append(start)
                yield index.items[k][0], start, width, -s


def _short_hits(index: ItemIndex, hashes: np.ndarray):
    """Items of fewer words than a shingle: equal runs of words, those that overlap an earlier one left out."""
    for k in index.short:
        item_id, length, shingles = index.items[k]
        free = 0
        for start in np.flatnonzero(rolling(hashes, length) == shingles[0]).tolist():
            if start >= free:
                free = start + length
                yield item_id, start, length, 1.0


def _slices(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """The benchmark in slices of bounded size; the driver holds one of them."""
    held, words = [], 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).orderBy("item_id", "text").toLocalIterator():
        n = (row["text"] or b"").count(b" ") + 1
        if held and words + n > MAX_ITEM_WORDS:
            yield held
            held, words = [], 0
        held.append((row["item_id"], None if row["text"] is None else bytes(row["text"])))
        words += n
    yield held


def hits(docs: DataFrame, benchmark: DataFrame, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """Rows (doc_id, item_id, start_word, n_words, similarity) of all passages that reach the similarity."""
    return _all_passes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")), benchmark, min_similarity)


def _all_passes(picked: DataFrame, benchmark: DataFrame, min_similarity: float) -> DataFrame:
    """Hits of ``picked(doc_id, text)``, whose doc_id may be of any type; each slice's hits are written before the next slice."""
    out = None
    for items in _slices(benchmark):
        shared = picked.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, items))
        part = stage(_pass(picked, shared, min_similarity), "hits")
        shared.unpersist()
        out = part if out is None else out.unionByName(part)
    return out


def _pass(picked: DataFrame, shared, min_similarity: float) -> DataFrame:
    def search(batches):
        index, cache = _index(*shared.value), word_hashes()
        for batch, texts in text_batches(batches):
            ids = batch.column("doc_id").to_pylist()
            rows, begin = [], 0
            while begin < len(texts):
                parts, held, end = [], 0, begin
                while end < len(texts) and held < _WORDS_AT_ONCE:
                    parts.append(cache.of(normal_words(texts[end])))
                    held += len(parts[-1])
                    end += 1
                rows += _marked(index, ids[begin:end], parts, min_similarity)
                begin = end
            columns = list(zip(*rows)) or [()] * 5
            types = (batch.schema.field("doc_id").type, pa.int64(), pa.int32(), pa.int32(), pa.float64())
            names = ["doc_id", "item_id", "start_word", "n_words", "similarity"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return picked.mapInArrow(search, HITS_SCHEMA.replace("doc_id long", f"doc_id {picked.schema['doc_id'].dataType.simpleString()}"))


def _marked(index: ItemIndex, ids: list, parts: list[np.ndarray], min_similarity: float) -> list[tuple]:
    """Hits of some documents, whose shingles are sieved together."""
    rows: list[tuple] = []
    if not index.items:
        return rows
    every = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    ends = np.cumsum([len(p) for p in parts])
    shingles = rolling(every, SHINGLE)
    at = np.flatnonzero(index.sieve[(shingles >> np.uint64(42)).astype(np.int64)])
    if len(at):
        near = np.minimum(np.searchsorted(index.known, shingles[at]), len(index.known) - 1)
        at = at[index.known[near] == shingles[at]]
        owner = np.searchsorted(ends, at, side="right")
        inside = at + SHINGLE <= ends[owner]
        at, owner = at[inside], owner[inside]
        heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(at) else []
        for head, tail in zip(heads, [*heads[1:], len(at)]):
            i = int(owner[head])
            places = at[head:tail]
            rows += [(ids[i], *hit) for hit in _passages(index, parts[i], places - (ends[i] - len(parts[i])), min_similarity)]
    if index.short:
        for i, part in enumerate(parts):
            rows += [(ids[i], *hit) for hit in _short_hits(index, part)]
    return rows


def clean(docs: DataFrame, benchmark: DataFrame, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """``docs`` without the documents that hold a benchmark passage; the columns stay.

    Whether a document goes depends on its text alone, so hits are carried by a hash of the whole text:
    rows with a null doc_id, or with the same one, are judged apart.
    """
    keyed = docs.withColumn("__text_key", text_key())
    picked = keyed.select(F.col("__text_key").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    found = stage(_all_passes(picked, benchmark, min_similarity).select(F.col("doc_id").alias("__hit")).distinct(), "contaminated")
    return keyed.hint("merge").join(found, F.col("__text_key") == F.col("__hit"), "left_anti").select(*docs.columns)


def contaminated(found: DataFrame) -> DataFrame:
    """(doc_id, item_ids, worst): one row per document that has hits."""
    return found.groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("similarity").alias("worst"))
