"""Best-fit packing by bin completion over the histogram of piece lengths.

A packing depends on lengths alone, and there are at most ``capacity`` different lengths
whatever the corpus weighs.  So Spark counts the pieces of each length, the driver solves
the packing of that histogram (at most ``capacity`` rows), and the plan goes back as
``pattern x multiplicity``: every piece finds its place from its length and its rank among
pieces of equal length.  Ranks are exact and need no global sort: they are counted within
(length, salt) groups and shifted by the counts of the earlier salts.

Solver: bin completion branch-and-bound.  The largest remaining piece opens a sequence,
the undominated fillings of its free room are enumerated, fullest first, branches whose waste exceeds what
the best packing so far allows are cut, and best-fit-decreasing completions serve as
incumbents, beside a few dives that prefer large pieces (mixes of which best fit makes little).  The search effort (not the data) is bounded by ``max_nodes``; the best
incumbent is always a valid, whole packing, and is returned at once when it meets the
lower bound.

Edge cases: null text counts as empty; an empty document is one piece holding only the end
id; repeated rows are separate documents; null doc_ids are kept; an empty table gives no
rows; other columns of the input are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.words import text_batches
from tracewell.plans.staging import stage

CAPACITY = 4096
END_ID = 1
#: Pieces of one length that share a salt when ranks are counted.
ROWS_PER_SALT = 50_000
#: Branch-and-bound nodes before the best incumbent is taken, and the effort that they may cost together
#: (different lengths left, squared, at each node).
MAX_NODES = 2_000
MAX_EFFORT = 100_000_000
#: Fillings tried at one node, fullest first.
MAX_FILLINGS = 12
#: Shares of a sequence that the dives before the search may waste where that uses larger pieces.
WASTES = (0, 1 / 256, 1 / 85, 1 / 32, 1 / 16, 3 / 32, 1 / 8, 5 / 32)

PIECES_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


# ---------------------------------------------------------------- tokens


#: Chunks that a task remembers; from then on, new ones serve their group of texts alone.
#: Frequent chunks come early, so those that matter are remembered.
CACHE_CHUNKS = 400_000
_SIMPLE = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]*)")


def _byte_letters() -> list[str]:
    """The letter that byte-level tokenizers write for each byte."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in set(own)]
    letters = {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(other)}
    return [letters[b] for b in range(256)]


class ChunkEncoder:
    """Token ids of whole texts through a bounded cache of white-space-delimited chunks.

    No pre-token crosses white space in the tokenizers this is used with, so the ids of a
    text are those of its chunks in turn.  A chunk of plain letters with or without closing
    punctuation goes to the tokenizer's own model directly, in lower case; whether that gives
    the tokenizer's ids is tried out first.  Other unseen chunks are encoded many at a time,
    held apart by a special token, which the tokenizer recognises before anything else.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = sorted((i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special)
        self.mark_id, self.mark = special[0] if special else (None, None)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.letters = _byte_letters()
        self.cache: dict[bytes, bytes] = {}
        self.ends: dict[str, bytes] = {"": b""}
        samples = ["The", "word", "Stra\u00dfe", "\u00c9t\u00e9", "a", "z\u00fcrich", "Internationalisation", "xqzj", "\u00d1and\u00fa", "cat"]
        try:
            self.direct = all(self._letters_ids(w.lower()) == self._encode([w])[0].tobytes() for w in samples)
        except Exception:  # a model without such a method, or with another alphabet
            self.direct = False

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, dtype=self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters_ids(self, stem: str) -> bytes:
        """Ids of a lower-case word of letters, from the model alone."""
        if not stem.isascii():
            stem = "".join([self.letters[b] for b in stem.encode("utf-8")])
        return np.array([t.id for t in self.tokenizer.model.tokenize(stem)], dtype=self.dtype).tobytes()

    def _learn(self, chunks: list[bytes]) -> None:
        cache, simple = self.cache, _SIMPLE.fullmatch
        rest: list[tuple[bytes, str]] = []
        for chunk in chunks:
            text = chunk.decode("utf-8")
            match = simple(text) if self.direct else None
            if not match:
                rest.append((chunk, text))
                continue
            word, end = match.groups()
            if end not in self.ends:
                self.ends[end] = self._encode([end])[0].tobytes()
            stem = word.lower()
            key = stem.encode("utf-8")
            ids = cache.get(key)
            if ids is None:
                ids = self._letters_ids(stem)
                if key != chunk and len(cache) < CACHE_CHUNKS:
                    cache[key] = ids
            cache[chunk] = ids + self.ends[end]
        joined, alone = [], []
        for chunk, text in rest:
            (alone if self.mark is None or "<" in text or len(text) > 200 else joined).append((chunk, text))
        groups = [joined[i : i + 100] for i in range(0, len(joined), 100)]
        for group, ids in zip(groups, self._encode([self.mark.join(t for _, t in g) for g in groups]) if groups else []):
            ends = np.append(np.flatnonzero(ids == self.mark_id), len(ids))
            begin = 0
            for (chunk, _), end in zip(group, ends):
                cache[chunk] = ids[begin:end].tobytes()
                begin = end + 1
        for (chunk, _), ids in zip(alone, self._encode([t for _, t in alone]) if alone else []):
            cache[chunk] = ids.tobytes()

    def ids(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        words: list[bytes] = []
        ends: list[int] = []
        for text in texts:
            words += text.split()
            ends.append(len(words))
            if len(words) >= 50_000:
                yield from self._group(words, ends)
                words, ends = [], []
        yield from self._group(words, ends)

    def _group(self, words: list[bytes], ends: list[int]) -> Iterator[np.ndarray]:
        cache = self.cache
        found = list(map(cache.get, words))
        if None in found:
            unseen = [i for i, x in enumerate(found) if x is None]
            new = {words[i] for i in unseen}
            self._learn(list(new))
            for i in unseen:
                found[i] = cache[words[i]]
            if len(cache) > CACHE_CHUNKS:
                for chunk in new:
                    del cache[chunk]
        begin = 0
        for end in ends:
            yield np.frombuffer(b"".join(found[begin:end]), dtype=self.dtype)
            begin = end


@cache
def _encoder(path: str) -> ChunkEncoder:
    """One encoder for each Python worker: its cache serves all tasks that run there."""
    return ChunkEncoder(path)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece of each document: (doc_id, piece, start, length, ids_crc32[, ids])."""

    def cut(batches):
        encoder = _encoder(tokenizer_path)
        end = np.array([end_id], dtype="<u4")
        for batch, texts in text_batches(batches):
            rows: list[list] = [[] for _ in range(6 if with_ids else 5)]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.ids(texts)):
                ids = np.concatenate([ids.astype("<u4"), end])
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    row = (doc_id, piece, start, len(part), zlib.crc32(part.tobytes()), part.astype("<i4"))
                    for column, value in zip(rows, row):
                        column.append(value)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=names[: len(rows)])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return picked.mapInArrow(cut, PIECES_SCHEMA + (", ids array<int>" if with_ids else ""))


# ---------------------------------------------------------------- solver


def lower_bound(hist: dict[int, int], capacity: int) -> int:
    """Fewest sequences that any packing needs: total volume, and the Martello-Toth bound L2 over all its thresholds."""
    if not hist:
        return 0
    size = np.array(sorted(hist), dtype=np.int64)
    count = np.array([hist[s] for s in size.tolist()], dtype=np.int64)
    n_upto = np.concatenate([[0], np.cumsum(count)])
    v_upto = np.concatenate([[0], np.cumsum(size * count)])
    half = int(np.searchsorted(size, capacity // 2, side="right"))
    k = np.concatenate([[0], size[:half]])
    middle = np.maximum(np.searchsorted(size, capacity - k, side="right"), half)
    low = np.minimum(np.searchsorted(size, k, side="left"), half)
    n1, n2 = n_upto[-1] - n_upto[middle], n_upto[middle] - n_upto[half]
    v2, v3 = v_upto[middle] - v_upto[half], v_upto[half] - v_upto[low]
    over = np.maximum(0, -(-(v3 - (n2 * capacity - v2)) // capacity))
    return int(max(-(-v_upto[-1] // capacity), (n1 + n2 + over).max()))


def best_fit(hist: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Best-fit decreasing on a histogram: (how many sequences, {length: pieces in each})."""
    rooms: dict[int, list[tuple[int, dict[int, int]]]] = {}  # free room -> groups of equal sequences
    done: list[tuple[int, dict[int, int]]] = []
    open_rooms: list[int] = []
    for size in sorted(hist, reverse=True):
        left = hist[size]
        open_rooms = sorted(r for r, groups in rooms.items() if groups)
        for room in open_rooms:
            if room < size or not left:
                continue
            groups, kept = rooms.pop(room), []
            for n, content in groups:
                each = min(room // size, left)
                if not each:
                    kept.append((n, content))
                    continue
                full = min(n, left // each)
                for m, k in ((full, each), (1 if full < n and left - full * each > 0 else 0, min(each, left - full * each))):
                    if m and k:
                        now = content | {size: k}
                        rooms.setdefault(room - k * size, []).append((m, now)) if room > k * size else done.append((m, now))
                        left -= m * k
                        n -= m
                if n:
                    kept.append((n, content))
            if kept:
                rooms.setdefault(room, []).extend(kept)
        each = capacity // size
        for m, k in ((left // each, each), (1, left % each)):
            if m and k:
                now = {size: k}
                rooms.setdefault(capacity - k * size, []).append((m, now)) if capacity > k * size else done.append((m, now))
    return done + [g for groups in rooms.values() for g in groups]


def _covers(bins: list[int], items: list[int]) -> bool:
    """Whether ``items`` can be dealt into ``bins`` without overflow (small lists only)."""
    if not items:
        return True
    head, rest = items[0], items[1:]
    tried = set()
    for i, room in enumerate(bins):
        if room >= head and room not in tried:
            tried.add(room)
            if _covers([*bins[:i], room - head, *bins[i + 1 :]], rest):
                return True
    return False


def _dominated(filling: list[int], other: list[int]) -> bool:
    """Whether the pieces of a filling can be dealt into those of another one; of long lists, whether first fit does it."""
    if len(other) > len(filling) or sum(other) < sum(filling):
        return False
    if len(filling) <= 8:
        return _covers(other, filling)
    rooms = list(other)
    for size in filling:
        at = next((i for i, room in enumerate(rooms) if room >= size), None)
        if at is None:
            return False
        rooms[at] -= size
    return True


def _reachable(sizes: list[int], counts: list[int], room: int) -> list[int]:
    """For each place in ``sizes``, the sums up to ``room`` that the pieces from there on can make, as bits of a number."""
    reach, mask = [1] * (len(sizes) + 1), (1 << room + 1) - 1
    for i in range(len(sizes) - 1, -1, -1):
        sums, left, step = reach[i + 1], min(counts[i], room // sizes[i]), 1
        while left:
            step = min(step, left)
            sums |= sums << step * sizes[i]
            left -= step
            step *= 2
        reach[i] = sums & mask
    return reach


def _with_sum(sizes: list[int], counts: list[int], reach: list[int], total: int) -> Iterator[list[int]]:
    """All choices of pieces with that sum, those with the largest pieces first; no step of the search is in vain."""

    def choose(at: int, left: int) -> Iterator[list[int]]:
        if not left:
            yield []
            return
        at = max(at, bisect_left(sizes, -left, key=lambda s: -s))  # larger pieces don't fit
        while at < len(sizes) and reach[at] >> left & 1:
            size = sizes[at]
            for k in range(min(counts[at], left // size), 0, -1):
                if reach[at + 1] >> left - k * size & 1:
                    for rest in choose(at + 1, left - k * size):
                        yield [size] * k + rest
            at += 1

    yield from choose(0, total)


def fillings(hist: dict[int, int], room: int, limit: int) -> list[list[int]]:
    """The ``limit`` fullest undominated fillings of ``room``.

    A filling is dominated if its pieces fit into the pieces of another one that holds no
    more of them: whatever else is packed later, the other is never worse.  Sums that pieces can make are known before any
    is made (subset sums as bits), so the fullest filling of all comes first, whatever the histogram.
    """
    sizes = [s for s in sorted(hist, reverse=True) if s <= room and hist[s] > 0]
    counts = [hist[s] for s in sizes]
    reach = _reachable(sizes, counts, room)
    kept: list[list[int]] = []
    sums, tried = reach[0] & ~1, 0
    while sums and len(kept) < limit and tried < 8 * limit:
        total = sums.bit_length() - 1
        sums ^= 1 << total
        for filling in _with_sum(sizes, counts, reach, total):
            tried += 1
            if not any(_dominated(filling, o) for o in kept):
                kept.append(filling)
            if len(kept) >= limit or tried >= 8 * limit:
                break
    return kept or [[]]


def dive(hist: dict[int, int], capacity: int, waste: int) -> list[tuple[int, dict[int, int]]]:
    """A whole packing without a way back: each sequence takes, with the largest piece left, the largest further pieces that
    can still be filled up to ``waste`` tokens from the best that is possible."""
    rest, out = {s: n for s, n in hist.items() if n > 0}, []
    while rest:
        top = max(rest)
        counts_left = rest | {top: rest[top] - 1}
        sizes = [s for s in sorted(counts_left, reverse=True) if s <= capacity - top and counts_left[s] > 0]
        counts, left, at = [counts_left[s] for s in sizes], capacity - top, 0
        reach, pattern = _reachable(sizes, counts, left), Counter([top])
        spare = max(waste, left - (reach[0].bit_length() - 1))  # what may stay free
        while at < len(sizes):
            size = sizes[at]
            for k in range(min(counts[at], left // size), 0, -1):
                least = max(0, left - k * size - spare)
                if reach[at + 1] >> least & (1 << left - k * size - least + 1) - 1:
                    pattern[size] += k
                    left -= k * size
                    break
            at = max(at + 1, bisect_left(sizes, -left, key=lambda s: -s))
        times = min(rest[s] // k for s, k in pattern.items())
        rest = {s: n for s, n in ((s, n - times * pattern[s]) for s, n in rest.items()) if n}
        out.append((times, dict(pattern)))
    return out


def bin_completion(hist: dict[int, int], capacity: int, max_nodes: int = MAX_NODES, max_fillings: int = MAX_FILLINGS) -> list[tuple[int, dict[int, int]]]:
    """A packing of the histogram in as few sequences as the search finds."""
    hist = {s: n for s, n in hist.items() if n > 0}
    if not hist:
        return []
    volume = sum(s * n for s, n in hist.items())
    bound = lower_bound(hist, capacity)
    best = best_fit(hist, capacity)
    best_n = sum(m for m, _ in best)
    for share in WASTES:
        if best_n == bound:
            break
        other = dive(hist, capacity, int(share * capacity))
        if (n := sum(m for m, _ in other)) < best_n:
            best, best_n = other, n
    rest, made, n_made, waste, nodes, effort = dict(hist), [], 0, 0, 0, 0

    def branches():
        """Fillings of the sequence that the largest remaining piece opens, as often as pieces last, or once: (times, pattern)."""
        top = max(rest)
        rest[top] -= 1
        chosen = fillings({s: n for s, n in rest.items() if n}, capacity - top, max_fillings)
        rest[top] += 1
        for filling in chosen:
            pattern = {top: 1}
            for s in filling:
                pattern[s] = pattern.get(s, 0) + 1
            most = min(rest[s] // k for s, k in pattern.items())
            yield from ((times, pattern) for times in sorted({most, 1}, reverse=True))

    def take(times: int, pattern: dict[int, int]) -> int:
        """Move sequences out of (or, with negative times, back to) ``rest``; the waste they add."""
        for s, k in pattern.items():
            left = rest.pop(s, 0) - times * k
            if left:
                rest[s] = left
        return times * (capacity - sum(s * k for s, k in pattern.items()))

    path = [branches()]  # one open node per depth; the histogram is undone on the way back
    while path and best_n > bound and nodes < max_nodes and effort < MAX_EFFORT:
        step = next(path[-1], None)
        if step is None:
            path.pop()
            if made:
                times, pattern = made.pop()
                n_made -= times
                waste += take(-times, pattern)
            continue
        nodes += 1
        effort += len(rest) ** 2
        made.append(step)
        n_made += step[0]
        waste += take(*step)
        if waste <= (best_n - 1) * capacity - volume and n_made + lower_bound(rest, capacity) < best_n:
            completion = best_fit(rest, capacity)
            total = n_made + sum(m for m, _ in completion)
            if total < best_n:
                best, best_n = list(made) + completion, total
            if rest and n_made + lower_bound(rest, capacity) < best_n:
                path.append(branches())
                continue
        made.pop()
        n_made -= step[0]
        waste += take(-step[0], step[1])
    return best


def placement_table(patterns: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length, first rank, last rank + 1, first sequence, pieces of this length in each, offset of the first)."""
    rows, used, sequence = [], {}, 0
    for times, pattern in patterns:
        offset = 0
        for size in sorted(pattern, reverse=True):
            each = pattern[size]
            begin = used.get(size, 0)
            used[size] = begin + times * each
            rows.append((size, begin, used[size], sequence, each, offset))
            offset += size * each
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)


# ---------------------------------------------------------------- the job


def ranked(pieces: DataFrame, n_pieces: int) -> DataFrame:
    """Adds ``rank``: each piece's exact place (from 0) among the pieces of its length."""
    salts = max(1, -(-n_pieces // ROWS_PER_SALT))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    within = salted.withColumn("place", F.row_number().over(order) - 1)
    counts = salted.groupBy("length", "salt").count()
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("length", "salt", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("shift"))
    return within.hint("merge").join(shift, ["length", "salt"]).withColumn("rank", F.col("place") + F.col("shift")).drop("salt", "place", "shift")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, max_nodes: int = MAX_NODES) -> DataFrame:
    """Places every piece: token_pieces plus (sequence_id, offset); sequences are gapless from 0."""
    pieces = stage(token_pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    counted = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    table = placement_table(bin_completion(counted, capacity, max_nodes))
    shared = pieces.sparkSession.sparkContext.broadcast(table)

    def place(batches):
        table = shared.value
        key = table[:, 0] * (1 << 48) + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            row = table[np.searchsorted(key, length * (1 << 48) + rank, side="right") - 1] if len(table) else np.zeros((0, 6), np.int64)
            nth = rank - row[:, 1]
            sequence, offset = row[:, 3] + nth // row[:, 4], row[:, 5] + nth % row[:, 4] * length
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked(pieces, sum(counted.values())).mapInArrow(place, PIECES_SCHEMA + ", sequence_id long, offset long")


def sequences(docs: DataFrame, placement: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The packed sequences themselves: (sequence_id, n_tokens, tokens, doc_ids), in offset order.

    A sequence holds at most ``capacity`` tokens, so no group is large.  Rows that repeat a
    document are told apart by their rank among equal (doc_id, piece, ids_crc32).
    """
    keys = ["doc_id", "piece", "ids_crc32"]
    nth = lambda df, by: df.withColumn("nth", F.row_number().over(Window.partitionBy(*[F.coalesce(F.col(k), F.lit(-1)) for k in keys]).orderBy(*by)))
    tokens = nth(token_pieces(docs, tokenizer_path, capacity, end_id, with_ids=True), ["doc_id"]).select(*keys, "nth", "ids")
    placed = nth(placement, ["sequence_id", "offset"])
    both = placed.alias("p").join(tokens.alias("t"), [F.col(f"p.{k}").eqNullSafe(F.col(f"t.{k}")) for k in [*keys, "nth"]])
    row = F.struct(F.col("p.offset").alias("offset"), F.col("p.doc_id").alias("doc_id"), F.col("t.ids").alias("ids"))
    gathered = both.groupBy("p.sequence_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    ids = F.flatten(F.col("rows.ids"))
    return gathered.select("sequence_id", F.size(ids).alias("n_tokens"), ids.alias("tokens"), F.col("rows.doc_id").alias("doc_ids"))


def described(patterns: list[tuple[int, dict[int, int]]], capacity: int) -> str:
    """A JSON summary of a packing, for logs."""
    n = sum(m for m, _ in patterns)
    used = sum(m * s * k for m, p in patterns for s, k in p.items())
    return json.dumps({"sequences": n, "patterns": len(patterns), "fill": used / max(1, n * capacity)})
