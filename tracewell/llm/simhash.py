"""SimHash near-dedup by anchor-point covering.

Fingerprints that differ in at most ``threshold`` bits are linked, and linked documents form
components.  Anchors are the codewords of a covering code: a direct product of perfect cyclic
codes (two binary Golay codes of length 23, covering radius 3 each, and a Hamming code of
length 15, covering radius 1) over 61 of the 64 bits.  Every word has exactly one nearest
anchor, within the covering radius.

If two fingerprints differ in at most ``threshold`` bits, some word lies within half the
threshold (rounded up) of both; its anchor is then within covering radius plus that half of
both.  So each fingerprint is replicated to the anchors of all words within half the
threshold - the anchors within covering radius plus threshold that a pair can need, about 16
for a threshold of 2 - and pairs are compared per anchor.  No link is missed.

How it scales.  Documents are first reduced to distinct fingerprints, so a group of equal
texts, or all empty ones, is one row.  Per anchor only links that join different
fingerprints leave a task, as a star per local component: never all pairs of a group.  A
crowded anchor is searched by hashing instead of by pairs: fingerprints two bits apart share
a word one bit from each.  Components are found by alternating large-star and small-star
rounds over staged edge tables; documents then take their component by fingerprint.

Near copies of texts (``copies``, ``deduplicated``) are found in two passes.  The first uses the same covering: each
text has ``TABLES`` SimHash fingerprints of its words (46 bits, two Golay codes, each word counted ``COUNTED`` times at
most), and texts whose fingerprints are linked in some table are compared by their whole sets of five-word
shingles.  That finds nearly all copies and leaves one text of a family.  Fingerprints miss some pairs, so the second pass compares, among
the texts that stay, those that share a cell of shingle space (``cells``), as any two texts of that similarity do, whatever their length.
Both passes part unlike texts where they meet, by parities of their shingles in ``SKETCH_BITS`` classes: two sets differ in as many shingles as
their parities differ in bits, or more, so only pairs that may be alike become rows, however many share a passage.  What they drop is never alike.

Edge cases: null and wordless texts have fingerprint zero and are linked like any other; one
or two words are one shingle; repeated rows stay repeated; a null doc_id never becomes a
component_id unless it has only null company; an empty table gives no rows; other columns of
the input are ignored by ``fingerprints`` and kept by ``deduplicated``.
"""

from __future__ import annotations

import math
from functools import cache, reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.cells import Brackets, cells
from tracewell.llm.words import mixed, rolling, text_batches, text_key, word_hashes
from tracewell.plans.staging import stage

SHINGLE = 3
SEED = 42
THRESHOLD = 2
#: An anchor with more fingerprints is searched by hashing, not by pairs.
CROWDED = 64
#: (length, generator polynomial, covering radius) of the perfect cyclic codes, lowest bits first.
CODES = ((23, 0b110001110101, 3), (23, 0b110001110101, 3), (15, 0b10011, 1))
#: Anchors that a task computes together.
_ANCHORS_AT_ONCE = 1 << 19
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


# ---------------------------------------------------------------- fingerprints


def _fingerprint_rows(texts: list[bytes], shingle: int) -> np.ndarray:
    """64-bit fingerprints: a bit is 1 if set in over half of the shingle hashes."""
    digest, out = xxhash.xxh64_intdigest, np.zeros(len(texts), dtype=np.uint64)
    for row, text in enumerate(texts):
        words = text.translate(_LOWER).split()
        if not words:
            continue
        if len(words) <= shingle:
            hashes = [digest(b" ".join(words), SEED)]
        else:
            hashes = [digest(b" ".join(s), SEED) for s in zip(*(words[k:] for k in range(shingle)))]
        n, total = len(hashes), np.zeros(64, dtype=np.int64)
        array = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
        for begin in range(0, n, 1 << 16):
            total += np.unpackbits(array[begin : begin + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[row] = np.packbits(2 * total > n, bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits of the fingerprint as a signed long."""

    def sign(batches):
        for batch, texts in text_batches(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_fingerprint_rows(texts, shingle).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(sign, "doc_id long, fp long")


# ---------------------------------------------------------------- anchors


@cache
def _code_tables(length: int, generator: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(syndromes of the low 12 bits, of the high bits, error pattern of each syndrome)."""
    degree = generator.bit_length() - 1

    def syndrome(word: int) -> int:
        for bit in range(length - 1, degree - 1, -1):
            if word >> bit & 1:
                word ^= generator << (bit - degree)
        return word

    single = [syndrome(1 << b) for b in range(length)]

    def table(first: int, width: int) -> np.ndarray:
        out = np.zeros(1 << width, dtype=np.uint32)
        for b in range(width):
            out[1 << b : 2 << b] = out[: 1 << b] ^ np.uint32(single[first + b])
        return out

    leader = np.zeros(1 << degree, dtype=np.uint32)
    for weight in range(1, radius + 1):
        for bits in combinations(range(length), weight):
            s = 0
            for b in bits:
                s ^= single[b]
            leader[s] = sum(1 << b for b in bits)
    low = min(12, length)
    return table(0, low), table(low, length - low), leader


def _nearest(words: np.ndarray, code: tuple[int, int, int]) -> np.ndarray:
    """The codeword nearest to each word."""
    low, high, leader = _code_tables(*code)
    return words ^ leader[low[words & np.uint32(len(low) - 1)] ^ high[words >> np.uint32(12)]]


def anchors(fps: np.ndarray, half: int, codes: tuple = CODES) -> np.ndarray:
    """Row per fingerprint: the anchors of every word within ``half`` bits (repeats included)."""
    parts, shifts, at = [], [], 0
    for code in codes:
        parts.append(((fps >> np.uint64(at)) & np.uint64((1 << code[0]) - 1)).astype(np.uint32))
        shifts.append(np.uint64(at))
        at += code[0]
    found: list[tuple[int, np.ndarray]] = [(0, np.zeros(len(fps), dtype=np.uint64))]  # (bits spent, anchor so far)
    for part, shift, code in zip(parts, shifts, codes):
        near = []
        for weight in range(half + 1):
            for bits in combinations(range(code[0]), weight):
                near.append((weight, _nearest(part ^ np.uint32(sum(1 << b for b in bits)), code).astype(np.uint64) << shift))
        found = [(spent + weight, so_far | anchor) for spent, so_far in found for weight, anchor in near if spent + weight <= half]
    return np.stack([anchor for _, anchor in found], axis=1)


def _roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest index in the component of each of n nodes (edges u-v)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _links(group: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside one anchor's sorted distinct fingerprints, enough to join what is linked."""
    n = len(group)
    us, vs = [], []
    if threshold > 2:  # a walk that compares each reached fingerprint with those not yet reached
        left = np.arange(n)
        while len(left):
            todo, left = [int(left[0])], left[1:]
            while todo and len(left):
                here = todo.pop()
                near = np.bitwise_count(group[left] ^ group[here]) <= threshold
                us.append(np.full(int(near.sum()), here))
                vs.append(left[near])
                todo += left[near].tolist()
                left = left[~near]
        return (np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, int), np.zeros(0, int))
    step = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)]) if threshold == 2 else None
    if threshold == 2:  # equal words one bit away: chains of equal keys
        keys = (group[:, None] ^ step[None, :]).ravel()
        owner = np.repeat(np.arange(n), len(step))
        order = np.argsort(keys, kind="stable")
        same = np.flatnonzero(keys[order][1:] == keys[order][:-1])
        us, vs = [owner[order[same]]], [owner[order[same + 1]]]
    else:
        for b in range(64 if threshold else 0):
            other = group ^ (np.uint64(1) << np.uint64(b))
            at = np.minimum(np.searchsorted(group, other), n - 1)
            hit = np.flatnonzero(group[at] == other)
            us.append(hit)
            vs.append(at[hit])
    return (np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, int), np.zeros(0, int))


def links(distinct: DataFrame, threshold: int = THRESHOLD, codes: tuple = CODES, apart: int = 0) -> DataFrame:
    """Edges (a, b) between different fingerprints of ``distinct(fp)`` that join all linked ones.

    ``codes`` cover some of the bits; with fewer of them a fingerprint has fewer copies, and an
    anchor more company.  What is linked does not depend on them.  Fingerprints that differ in a bit
    of ``apart`` are never linked.
    """
    half = -(-threshold // 2)
    bits = sum(c[0] for c in codes)
    at_once = max(64, _ANCHORS_AT_ONCE // sum(comb(bits, w) for w in range(half + 1)))

    def replicate(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            for begin in range(0, len(fps), at_once):
                part = fps[begin : begin + at_once]
                grid = np.sort(anchors(part.view(np.uint64), half, codes) | (part.view(np.uint64) & np.uint64(apart))[:, None], axis=1)
                first = np.ones(grid.shape, dtype=bool)
                first[:, 1:] = grid[:, 1:] != grid[:, :-1]
                row, column = np.nonzero(first)
                yield pa.RecordBatch.from_arrays([pa.array(grid[row, column].view(np.int64)), pa.array(part[row])], names=["anchor", "fp"])

    def compare(batches):
        held_a, held_f = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def found(a: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            begin = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, int)
            size = np.diff(np.append(begin, len(a)))
            us, vs = [], []
            bits = f.view(np.uint64)
            group = np.repeat(np.arange(len(size)), size)
            few = size[group] <= CROWDED if len(a) else np.zeros(0, bool)
            for gap in range(1, int(size[size <= CROWDED].max(initial=0))):
                near = np.flatnonzero((group[gap:] == group[:-gap]) & few[gap:] & (np.bitwise_count(bits[gap:] ^ bits[:-gap]) <= threshold))
                us.append(near)
                vs.append(near + gap)
            for b, s in zip(begin[size > CROWDED], size[size > CROWDED]):
                order = np.argsort(bits[b : b + s])
                u, v = _links(bits[b : b + s][order], threshold)
                us.append(order[u] + b)
                vs.append(order[v] + b)
            u = np.concatenate(us) if us else np.zeros(0, int)
            v = np.concatenate(vs) if vs else np.zeros(0, int)
            if len(u):  # a star for each local component
                nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
                root = _roots(len(nodes), flat[: len(u)], flat[len(u) :])
                leaf = np.flatnonzero(root != np.arange(len(nodes)))
                u, v = nodes[root[leaf]], nodes[leaf]
            pairs = np.unique(np.stack([np.minimum(f[u], f[v]), np.maximum(f[u], f[v])], axis=1), axis=0) if len(u) else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            a, f = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("anchor", "fp"))
            a, f = np.concatenate([held_a, a]), np.concatenate([held_f, f])
            if not len(a):
                continue
            cut = int(np.searchsorted(a, a[-1], side="left"))  # the last anchor may go on
            if cut:
                yield found(a[:cut], f[:cut])
            held_a, held_f = a[cut:], f[cut:]
        yield found(held_a, held_f)

    copies = distinct.select("fp").mapInArrow(replicate, "anchor long, fp long")
    return copies.repartition("anchor").sortWithinPartitions("anchor", "fp").mapInArrow(compare, "a long, b long").distinct()


# ---------------------------------------------------------------- components


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``: root is the least node of its component.

    Alternating large-star and small-star rounds until nothing changes; each keeps at most as
    many edges as it got.
    """
    edges = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.hint("merge").join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stage(large.where("a <> b").distinct(), "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.hint("merge").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = stage(small.where("a <> b").distinct(), "edges")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def clustered(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links."""
    signed = stage(fingerprints(docs, shingle), "fingerprints")
    distinct = stage(signed.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    rooted = components(links(distinct, threshold))
    named = distinct.hint("merge").join(rooted, distinct.fp == rooted.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.hint("merge").join(lowest, "root").select("fp", "component_id")
    return signed.hint("merge").join(by_fp, "fp").select("doc_id", "fp", "component_id")


# ---------------------------------------------------------------- near copies of texts

#: Near copies: words of a shingle, and similarity.
COPY_SHINGLE, MIN_SIMILARITY = 5, 0.8
#: Fingerprints of a text's words: how many, their codes (which cover all their bits), and how often a word counts at most.
TABLES, COPY_CODES, COUNTED = 8, CODES[:2], 4
_COPY_BITS = sum(code[0] for code in COPY_CODES)
#: Bits of a set's sketch, and its columns of 64 bits each.
SKETCH_BITS = 512
SKETCH = tuple(f"s{k}" for k in range(SKETCH_BITS // 64))
_SKETCH_SALT = np.uint64(0xA0761D6478BD642F)
#: Rows that a task holds back to give each once.
_HELD = 1 << 20
#: Numbers of texts that are broadcast at most; beyond, they are joined by sorting.
BROADCAST_ROWS = 500_000


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with the key of their text and a doc_id that joins null with null."""
    id_ = F.col("doc_id").cast("long")
    return docs.withColumns({"__text_key": text_key(), "__id": F.coalesce(id_, F.lit(0)), "__no_id": id_.isNull()})


def _shingle_set(text: bytes) -> np.ndarray:
    """Hashes of the different five-word shingles of lower-cased words, in order."""
    h = word_hashes().of(text.translate(_LOWER).split())
    return np.unique(rolling(h, min(COPY_SHINGLE, max(1, len(h)))))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Whether the number of shingles in each of ``SKETCH_BITS`` classes is odd.  A shingle that one of two sets lacks turns one bit."""
    own = (mixed(shingles ^ _SKETCH_SALT) >> np.uint64(64 - (SKETCH_BITS.bit_length() - 1))).astype(np.int64)
    odd = (np.bincount(own, minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8")


def _allowed(sizes, min_similarity: float):
    """How many shingles two sets of so many together may differ in, and a little more than rounding may cost."""
    return sizes * ((1 - min_similarity) / (1 + min_similarity)) + 1e-6


def _shingle_sets(texts: DataFrame) -> DataFrame:
    """(n, shingles, size, sketch columns)"""

    def cut(batches):
        for batch, rows in text_batches(batches):
            sets = [_shingle_set(t) for t in rows]
            odd = np.stack([sketch(s) for s in sets]) if sets else np.zeros((0, len(SKETCH)), np.int64)
            columns = [batch.column("n"), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([len(s) for s in sets], pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, odd.T)], names=["n", "shingles", "size", *SKETCH])

    return texts.mapInArrow(cut, f"n long, shingles array<long>, size int, {', '.join(f'{c} long' for c in SKETCH)}")


def _sketched(postings: DataFrame, sets: DataFrame) -> DataFrame:
    """``postings`` with the size and the sketch of each text's set."""
    return postings.hint("merge").join(sets.select("n", "size", *SKETCH), "n")


def _whole_groups(batches, columns: tuple[str, ...]):
    """Arrays of rows sorted by the first column, cut between its values."""
    held = [np.zeros(0, np.int64) for _ in columns]
    for batch in batches:
        arrays = [np.concatenate([h, batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)]) for h, c in zip(held, columns)]
        if not len(arrays[0]):
            continue
        cut = int(np.searchsorted(arrays[0], arrays[0][-1], side="left"))  # the last group may go on
        if cut:
            yield [a[:cut] for a in arrays]
        held = [a[cut:] for a in arrays]
    if len(held[0]):
        yield held


def _begins(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where its group begins, rows of its group) for every row of sorted keys."""
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.append(begin, len(keys)))
    return np.repeat(begin, size), np.repeat(size, size)


def _postings(texts: DataFrame, min_similarity: float) -> DataFrame:
    """(key, n, size): the cells that several texts share, and how many shingles those have.  Equal sets share their whole set."""
    percent = math.floor(100 * min_similarity + 1e-9)

    def cut(batches):
        brackets = Brackets(percent)
        for batch, rows in text_batches(batches):
            sets = [_shingle_set(t) for t in rows]
            parts = [np.append(cells(s, brackets), np.uint64(xxhash.xxh3_64_intdigest(s.tobytes()))) if len(s) else s for s in sets]
            lengths = [len(p) for p in parts]
            keys = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
            n = np.repeat(batch.column("n").to_numpy(), lengths)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n), pa.array(np.repeat([len(s) for s in sets], lengths).astype(np.int32))], names=["key", "n", "size"])

    def shared(batches):
        for key, n, size in _whole_groups(batches, ("key", "n", "size")):
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (n[1:] != n[:-1])])  # rows that repeat an id and a text
            key, n, size = key[new], n[new], size[new]
            many = _begins(key)[1] > 1
            yield pa.RecordBatch.from_arrays([pa.array(key[many]), pa.array(n[many]), pa.array(size[many].astype(np.int32))], names=["key", "n", "size"])

    dealt = texts.mapInArrow(cut, "key long, n long, size int").repartition("key").sortWithinPartitions("key", "n")
    return dealt.mapInArrow(shared, "key long, n long, size int")


def _met(postings: DataFrame, leaders: int, min_similarity: float) -> DataFrame:
    """(n, first): texts with the first ``leaders`` texts of each key, where sizes allow the similarity.

    ``first`` is -1 for a text that is not among the first ones of some key of its own.  Texts whose sketches differ in more
    bits than alike texts may differ in shingles are parted here.
    """

    def rows(n, first) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(n.astype(np.int64)), pa.array(first.astype(np.int64))], names=["n", "first"])

    def meet(batches):
        late, n_late = [], 0
        for key, n, size, *odd in _whole_groups(batches, ("key", "n", "size", *SKETCH)):
            begin, members = _begins(key)
            place = np.arange(len(key)) - begin
            late.append(np.unique(n[place >= leaders]))
            n_late += len(late[-1])
            if n_late > _HELD:
                late = [np.unique(np.concatenate(late))]
                yield rows(late[0], np.full(len(late[0]), -1))
                late, n_late = [], 0
            left = np.flatnonzero(members > 1)
            for j in range(min(leaders, int(members.max(initial=1)) - 1)):
                left = left[place[left] > j]
                first = begin[left] + j
                fits = np.minimum(size[left], size[first]) >= min_similarity * np.maximum(size[left], size[first]) - 1e-9
                row, first = left[fits], first[fits]
                differing = sum(np.bitwise_count((s[row] ^ s[first]).view(np.uint64)).astype(np.int64) for s in odd)
                alike = differing <= _allowed(size[row] + size[first], min_similarity)
                if alike.any():
                    pairs = np.unique(np.stack([n[row[alike]], n[first[alike]]], axis=1), axis=0)
                    yield rows(pairs[:, 0], pairs[:, 1])
        if late:
            late = np.unique(np.concatenate(late))
            yield rows(late, np.full(len(late), -1))

    found = postings.repartition("key").sortWithinPartitions("key", "n").mapInArrow(meet, "n long, first long")
    return found.distinct()


def _table_mark(table: int) -> int:
    """Bits that tell the fingerprints of one table from those of another; any two marks differ in four bits or more."""
    return table * 0b001001001001 << _COPY_BITS


def word_fingerprints(texts: list[bytes]) -> np.ndarray:
    """Row per text: a SimHash of its words for each table, under the table's mark."""
    words, counts, sizes = [], [], []
    for text in texts:
        different, n = np.unique(word_hashes().of(text.translate(_LOWER).split()), return_counts=True)
        words.append(different)
        counts.append(np.minimum(n, COUNTED))
        sizes.append(len(different))
    out = np.zeros((len(texts), TABLES), dtype=np.uint64)
    if not sum(sizes):
        return out | np.array([_table_mark(t) for t in range(TABLES)], dtype=np.uint64)
    every, weight = np.concatenate(words), np.concatenate(counts).astype(np.int16)[:, None]
    filled = np.flatnonzero(sizes)
    begins = (np.cumsum(sizes) - sizes)[filled]
    for table in range(TABLES):
        salt = np.uint64(0x9E3779B97F4A7C15 * (table + 1) & (1 << 64) - 1)
        bits = np.unpackbits(mixed(every ^ salt).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :_COPY_BITS]
        votes = np.add.reduceat((2 * bits.astype(np.int16) - 1) * weight, begins, axis=0, dtype=np.int32) > 0
        whole = np.zeros((len(filled), 64), dtype=np.uint8)
        whole[:, :_COPY_BITS] = votes
        out[filled, table] = np.packbits(whole, axis=1, bitorder="little").view("<u8")[:, 0]
        out[:, table] |= np.uint64(_table_mark(table))
    return out


def _linked(texts: DataFrame) -> DataFrame:
    """(key, n, fp): texts with a fingerprint that another text's is linked with, under the star that holds both.

    Fingerprints that share an anchor and lie in one local component have one star, so any two linked ones
    meet under a key.
    """

    def sign(batches):
        for batch, rows in text_batches(batches):
            prints = word_fingerprints(rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("n").to_numpy(), TABLES)), pa.array(prints.ravel())], names=["n", "fp"])

    prints = stage(texts.mapInArrow(sign, "n long, fp long"), "fingerprints")
    distinct = stage(prints.groupBy("fp").count(), "distinct")
    stars = stage(links(distinct, THRESHOLD, COPY_CODES, sum({1 << b for b in range(_COPY_BITS, 64)})), "stars")
    members = stars.select(F.col("a").alias("key"), F.col("b").alias("fp")).unionByName(stars.select(F.col("a").alias("key"), F.col("a").alias("fp")))
    members = members.unionByName(distinct.where("count > 1").select(F.col("fp").alias("key"), "fp")).distinct()
    return prints.hint("merge").join(members, "fp").select("key", "n", "fp")


def _linked_pairs(postings: DataFrame, leaders: int, min_similarity: float | None = None) -> DataFrame:
    """(n, first): texts with the first ``leaders`` texts of each key that their fingerprints are linked with; -1 as in ``_met``.

    With ``min_similarity``, postings have sizes and sketches, and texts that can't be so similar are parted.  First ones are picked before the shuffle as well, so a large group sends few; joins with them are of the kind that
    adaptive execution splits where a key is hot.
    """
    nth = F.row_number().over(Window.partitionBy("key").orderBy("n", "fp"))
    judged = () if min_similarity is None else ("size", *SKETCH)
    firsts = postings.withColumn("nth", nth).where(F.col("nth") <= leaders)
    firsts = stage(firsts.select("key", F.col("n").alias("first"), F.col("fp").alias("first_fp"), "nth", *(F.col(c).alias(f"first_{c}") for c in judged)), "firsts")
    differing = lambda columns: reduce(lambda a, b: a + b, (F.bit_count(F.col(c).bitwiseXOR(F.col(f"first_{c}"))) for c in columns))
    near = (F.col("first") < F.col("n")) & (differing(["fp"]) <= THRESHOLD)
    if judged:
        near &= F.least("size", "first_size") >= min_similarity * F.greatest("size", "first_size") - 1e-9
        near &= differing(SKETCH) <= _allowed(F.col("size") + F.col("first_size"), min_similarity)
    pairs = postings.hint("merge").join(firsts, "key").where(near).select("n", "first").distinct()
    last = firsts.where(F.col("nth") == leaders).select("key", F.col("first").alias("last"))
    late = postings.hint("merge").join(last, "key").where("n > last").select("n").distinct()
    return pairs.unionByName(late.select("n", F.lit(-1).cast("long").alias("first")))


def _alike(pairs: DataFrame, sets: DataFrame, min_similarity: float) -> DataFrame:
    """Those of ``pairs(n, first)`` whose whole shingle sets reach the similarity."""
    ahead = sets.select(F.col("n").alias("first"), F.col("shingles").alias("of_first"))
    common = F.size(F.array_intersect("shingles", "of_first"))
    reached = common >= min_similarity * (F.size("shingles") + F.size("of_first") - common)
    return pairs.hint("merge").join(sets, "n").hint("merge").join(ahead, "first").where(reached).select("n", "first")


def _gone(postings: DataFrame, meet, sets_of, min_similarity: float, leaders: int, growth: int) -> DataFrame:
    """(n, first): texts that are like a text with a smaller n that stays, among those that ``meet`` brings together.

    Taken in order of n, a text stays unless it is like one that stays: exactly that, in rounds.  A text that
    is among the first of all its keys, and like none of those that are still open, stays; it has met all
    that share a key with it, and what is like it goes.  The least open text always stays, and rounds go on
    until none is open.
    """
    out = postings.sparkSession.createDataFrame([], "n long, first long")
    while not postings.isEmpty():
        met = stage(meet(postings, leaders), "met")
        pairs = met.where("first >= 0").select("n", "first")
        wanted = stage(pairs.select("n").unionByName(pairs.select(F.col("first").alias("n"))).distinct(), "wanted")
        like = stage(_alike(pairs, stage(sets_of(wanted), "shingles"), min_similarity), "alike")
        open_ = stage(met.where("first < 0").select("n").unionByName(like.select("n")).distinct(), "open")
        gone = stage(like.hint("merge").join(open_.select(F.col("n").alias("first")), "first", "left_anti").groupBy("n").agg(F.min("first").alias("first")), "near")
        out = out.unionByName(gone)
        left = open_.hint("merge").join(gone, "n", "left_anti")
        postings = stage(postings.hint("merge").join(left, "n", "left_semi"), "postings")
        leaders *= growth
    return out


def _sets_of(sets: DataFrame):
    return lambda wanted: sets.select("n", "shingles").hint("merge").join(wanted, "n", "left_semi")


def _near(texts: DataFrame, min_similarity: float) -> DataFrame:
    """(n, first): texts of ``texts(n, text)`` that are like a text with a smaller n that stays.

    First those that linked fingerprints bring together, which leaves one text of nearly every group; then,
    among what stays, those beyond the radius of all tables, which shared cells bring together.
    """
    linked = stage(_linked(texts), "linked")
    sets = stage(_shingle_sets(texts.hint("merge").join(linked.select("n").distinct(), "n", "left_semi")), "sets")
    linked = stage(_sketched(linked, sets), "linked")
    by_prints = _gone(linked, lambda rows, leaders: _linked_pairs(rows, leaders, min_similarity), _sets_of(sets), min_similarity, 1, 16)
    by_prints = stage(by_prints, "copies")
    gone = by_prints.select("n")
    few = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone.hint("merge")
    rest = texts.join(few, "n", "left_anti")
    shared = stage(_postings(rest, min_similarity), "postings")
    wanted = stage(shared.select("n").distinct(), "wanted")
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted.hint("merge")
    rest_sets = stage(_shingle_sets(texts.join(few, "n", "left_semi")), "sets")
    shared = stage(_sketched(shared.select("key", "n"), rest_sets), "postings")
    by_cells = _gone(shared, lambda rows, leaders: _met(rows, leaders, min_similarity), _sets_of(rest_sets), min_similarity, 4, 4)
    return by_prints.unionByName(by_cells)


def _copies(docs: DataFrame, min_similarity: float) -> tuple[DataFrame, DataFrame]:
    """(texts, near): texts(text_key, first, no_id, n) by their smallest doc_id, and near(n, first) of those that go."""
    keyed = _keyed(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    found = keyed.groupBy(F.col("__text_key").alias("text_key")).agg(F.min(F.when(~F.col("__no_id"), F.col("__id"))).alias("first"))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = found.withColumns({"no_id": F.col("first").isNull(), "first": F.coalesce("first", F.lit(0))})
    texts = stage(found.repartitionByRange(partitions, "no_id", "first", "text_key").sortWithinPartitions("no_id", "first", "text_key").withColumn("n", F.monotonically_increasing_id()), "texts")
    same = (F.col("__text_key") == F.col("text_key")) & (F.col("__id") == F.col("first")) & (F.col("__no_id") == F.col("no_id"))
    again = Window.partitionBy("__text_key", "__id", "__no_id").orderBy("__id")
    once = keyed.hint("merge").join(texts, same).withColumn("__nth", F.row_number().over(again)).where("__nth = 1")
    named = stage(once.select("n", F.col("text").cast("binary").alias("text")), "named")
    return texts, stage(_near(named, min_similarity), "copies")


def copies(docs: DataFrame, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """(doc_id, copy_of): documents that repeat, or nearly repeat, one with a smaller doc_id that stays.

    Equal texts are found by a hash of the whole text.  Different ones are copies if the Jaccard
    similarity of their five-word shingles reaches ``min_similarity``.  Any two such texts share a cell of shingle space, and all
    that meet in one are compared by their whole sets: no pair is missed.
    """
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    texts, near = _copies(docs, min_similarity)
    keyed = _keyed(docs).select(F.col("__text_key").alias("text_key"), F.col("__id").alias("doc_id"))
    equal = keyed.hint("merge").join(texts.select("text_key", "first"), "text_key").where("doc_id <> first").select("doc_id", F.col("first").alias("copy_of"))
    ids = texts.select("n", F.col("first").alias("doc_id"))
    of = texts.select(F.col("n").alias("first"), F.col("first").alias("copy_of"))
    return equal.unionByName(near.hint("merge").join(ids, "n").hint("merge").join(of, "first").select("doc_id", "copy_of")).distinct()


def deduplicated(docs: DataFrame, min_similarity: float = MIN_SIMILARITY, judge_null_ids: bool = False) -> DataFrame:
    """``docs`` with one document of each group of copies; the columns stay.

    A row is known by its doc_id and its whole text, so rows that share only a doc_id are judged apart.
    Rows that repeat both count once.  Rows with a null doc_id all stay, or with ``judge_null_ids`` are
    judged like the others, after those with a doc_id.
    """
    judged = docs if judge_null_ids else docs.where("doc_id is not null")
    texts, near = _copies(judged, min_similarity)
    stay = texts.hint("merge").join(near.select("n"), "n", "left_anti").select(F.col("text_key").alias("__stays"), F.col("first").alias("__first"), F.col("no_id").alias("__no_first"))
    keyed = _keyed(judged)
    same = (F.col("__text_key") == F.col("__stays")) & (F.col("__id") == F.col("__first")) & (F.col("__no_id") == F.col("__no_first"))
    again = Window.partitionBy("__text_key", "__id", "__no_id").orderBy("__id")
    left = keyed.hint("merge").join(stay, same).withColumn("__nth", F.row_number().over(again)).where("__nth = 1").select(*docs.columns)
    return left if judge_null_ids else left.unionByName(docs.where("doc_id is null"))


def hex_digits(fp) -> F.Column:
    """The 16 lowercase hex digits of a fingerprint column."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
