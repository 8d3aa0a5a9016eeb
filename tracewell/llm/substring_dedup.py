"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

The corpus is dealt, in document order, into reference blocks of about ``BLOCK_BYTES`` of text, and the
windows of ``window`` words of all blocks form the index: each different window with the block and the word
where it starts first.  Every document is parsed greedily: at a word whose window the index knows, a
factor opens at that place of its reference block and goes on as long as the next window's place
is the next word there.  At a factor's boundary the windows that straddle it are looked up for
themselves and open factors of their own, so a passage stitched from several references loses
nothing.  Factors, all at least ``window`` words long, are the duplicate spans: the words they cover go.

How it scales.  Text is dealt once into a staged table of compressed blocks, several for each task; two
joins on the block bring it the answers of the index.  What else travels is hashes, in two rounds:

* seeds: the minimum of the 8-word hashes in each window (equal windows have equal seeds),
  one per seven words or so, each block's distinct ones; a seed that no other block has
  rules out all its windows at once;
* windows: of the windows whose seed another block has too, each different one with its first place.

Both are dealt by hash value, packed and sorted.  A block sends each value once, however
often it occurs there, so the rows for one value are at most the blocks: a passage that a
third of all documents share makes no hot task.  Nothing is collected to the driver but the
size of the text.

Windows are equal if two independent hashes of together 96 bits are, in other blocks as inside their own.

Edge cases: null text has no words; texts under ``window`` words are never touched; rows
that repeat a doc_id count as separate documents in order of their text, so the later ones
are duplicates; null doc_ids come first, dealt by how their texts begin; a document longer than a block is a
block of its own; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import math
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.words import WordHashes, mixed, rolling, word_hashes
from tracewell.plans.staging import stage

WINDOW = 20
SEED = 8
#: Text of one reference block; also what one task holds at a time.
BLOCK_BYTES = 6 << 20
#: Hash values that one group of an exchange holds, about.
KEYS_PER_BUCKET = 1 << 20
_SEQ_BITS = 32
#: Bytes of a text that its range partition may depend on.
_HEAD_BYTES = 64

RESULT_SCHEMA = (
    "doc_id long, n_words long, n_removed long, kept_sha256 string, "
    "factors array<struct<start:int,length:int,reference_block:long,reference_word:long>>"
)


# ---------------------------------------------------------------- blocks


def _packed(ids: list, texts: list) -> bytes:
    table = pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.large_binary())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue())


def _unpacked(payload: bytes) -> tuple[list, list[bytes]]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    table = pa.ipc.open_stream(raw).read_all()
    return table.column("doc_id").to_pylist(), [b"" if x is None else x for x in table.column("text").to_pylist()]


class Block:
    """A block's documents and the hashes of its windows, computed anew wherever it is read."""

    def __init__(self, payload: bytes, window: int, hashes: WordHashes):
        self.window = window
        self.ids, self.texts = _unpacked(payload)
        parts = [hashes.of(text.split()) for text in self.texts]
        self.counts = np.array([len(p) for p in parts], dtype=np.int64)
        self.ends = np.cumsum(self.counts)
        self.words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        n = max(0, len(self.words) - window + 1)
        self.valid = np.ones(n, dtype=bool)  # windows inside one document
        marks = np.zeros(len(self.words) + 1, dtype=np.int32)
        np.add.at(marks, np.maximum(self.ends - window + 1, self.ends - self.counts), 1)
        np.add.at(marks, self.ends, -1)
        self.valid &= np.cumsum(marks)[:n] == 0

    def seeds(self) -> np.ndarray:
        """The seed of each window: the least of its SEED-word hashes."""
        if len(self.words) < self.window:
            return np.zeros(0, np.uint64)
        low, width, target = rolling(self.words, SEED), 1, self.window - SEED + 1
        while width < target:
            step = min(width, target - width)
            low = np.minimum(low[: len(low) - step], low[step:])
            width += step
        return low

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of each window, of 64 and 32 bits."""
        return rolling(self.words, self.window), (rolling(mixed(self.words ^ np.uint64(0xA5A5A5A5A5A5A5A5)), self.window) >> np.uint64(32)).astype("<u4")


def _in_order(hashes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order that brings equal ones together and keeps their sequence, whether each in that order equals the one before)."""
    order = np.argsort(hashes, kind="stable")
    h, c = hashes[order], checks[order]
    alike = h[1:] == h[:-1]
    if (alike & (c[1:] != c[:-1])).any():  # one hash, different windows
        order = np.lexsort((checks, hashes))
        h, c = hashes[order], checks[order]
        alike = h[1:] == h[:-1]
    return order, np.concatenate([np.zeros(min(1, len(h)), bool), alike & (c[1:] == c[:-1])])


# ---------------------------------------------------------------- exchange of hashes


def _squeeze(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as byte planes of their gaps."""
    gaps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(gaps.view(np.uint8).reshape(-1, 8).T.tobytes())


def _unsqueeze(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    return np.cumsum(planes.reshape(8, -1).T.copy().view("<u8").ravel(), dtype=np.uint64)


def _planes(values: np.ndarray) -> bytes:
    """Any 64-bit values as byte planes."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T.tobytes())


def _from_planes(blob: bytes, dtype: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    return planes.reshape(8, -1).T.copy().view(dtype).ravel()


def _dealt(keys: np.ndarray, block: int, bits: int, checks: np.ndarray | None = None, places: np.ndarray | None = None):
    """Rows (bucket, block, keys, checks, places) of sorted keys; a bucket is a range of hash values."""
    edges = np.searchsorted(keys, (np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)))
    for bucket, (begin, end) in enumerate(zip(edges, [*edges[1:], len(keys)])):
        if end > begin:
            yield bucket, block, _squeeze(keys[begin:end]), b"" if checks is None else checks[begin:end].tobytes(), b"" if places is None else _planes(places[begin:end].astype("<i8"))


def _rows(rows, names: tuple, types: tuple) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, types)], names=list(names))


KEYS = (("bucket", "block", "keys", "checks", "places"), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))
BLOCK_ROWS = ((*KEYS[0], "payload"), (*KEYS[1], pa.binary()))
KEYS_SCHEMA = "bucket int, block long, keys binary, checks binary, places binary"
FOUND = (("block", "round", "bucket", "bits", "refs", "places"), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))
FOUND_SCHEMA = "block long, round int, bucket int, bits binary, refs binary, places binary"


def _looked_up(keys: DataFrame, round_no: int) -> DataFrame:
    """For each block and bucket: which of its keys other blocks have (round 1), or earlier blocks, and the first place there (round 2)."""

    def look(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        blocks = np.array(table.column("block").to_pylist(), dtype=np.int64)
        bucket = table.column("bucket")[0].as_py()
        parts = [_unsqueeze(b) for b in table.column("keys").to_pylist()]
        sizes = [len(p) for p in parts]
        every = np.concatenate(parts)
        owner = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
        checks = np.zeros(len(every), np.uint32) if round_no == 1 else np.frombuffer(b"".join(table.column("checks").to_pylist()), dtype="<u4")
        order, same = _in_order(every, checks)  # equal keys stay in block order
        found, first, place = np.zeros(len(every), dtype=bool), None, None
        if round_no == 1:
            found[order] = same | np.concatenate([same[1:], [False]])
        else:
            places = np.concatenate([_from_planes(b, "<i8") for b in table.column("places").to_pylist()])
            head = np.maximum.accumulate(np.where(same, 0, np.arange(len(every))))
            first, place = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
            found[order], first[order], place[order] = same, blocks[owner[order[head]]], places[order[head]]
        rows, begin = [], 0
        for block, size in zip(blocks, sizes):
            bits = found[begin : begin + size]
            if bits.any():
                refs = (b"", b"") if round_no == 1 else tuple(_planes(x[begin : begin + size][bits].astype("<i8")) for x in (first, place))
                rows.append((int(block), round_no, bucket, zstandard.ZstdCompressor(level=1).compress(np.packbits(bits).tobytes()), *refs))
            begin += size
        return _rows(rows, *FOUND)

    return keys.groupBy("bucket").applyInArrow(look, FOUND_SCHEMA)


def _flags(found: list[dict], round_no: int, keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flag, first block, word there) of a block's sorted keys."""
    flag, first, place = np.zeros(len(keys), dtype=bool), np.full(len(keys), -1, dtype=np.int64), np.full(len(keys), -1, dtype=np.int64)
    edges = np.append(np.searchsorted(keys, (np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))), len(keys))
    for row in found:
        if row["round"] == round_no:
            begin, end = edges[row["bucket"]], edges[row["bucket"] + 1]
            part = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(row["bits"]), np.uint8))[: end - begin].astype(bool)
            flag[begin:end] = part
            if round_no == 2:
                first[begin:end][part], place[begin:end][part] = _from_planes(row["refs"], "<i8"), _from_planes(row["places"], "<i8")
    return flag, first, place


def reference_blocks(docs: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame, int]:
    """(blocks in document order: block, payload; their seeds: KEYS_SCHEMA; bits of a bucket's number).

    One pass deals the text and cuts each task's share into blocks; only one block is open at a time.
    """
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    size = picked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    parts = min(max(1, math.ceil(size / block_bytes)), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bits = max(3, math.ceil(math.log2(max(1, size / 6 / 4 / KEYS_PER_BUCKET))))

    def pack(batches):
        first, seq, held, ids, texts = TaskContext.get().partitionId() << _SEQ_BITS, 0, 0, [], []

        def done():
            payload = _packed(ids, texts)
            yield _rows([(None, first | seq, None, None, None, payload)], *BLOCK_ROWS).to_batches()[0]
            block = Block(payload, window, word_hashes())
            keys = np.unique(block.seeds()[block.valid])
            yield from _rows([(*row, None) for row in _dealt(keys, first | seq, bits)], *BLOCK_ROWS).to_batches()

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids.append(doc_id)
                texts.append(text)
                held += len(text or b"")
                if held >= block_bytes:
                    yield from done()
                    seq, held, ids, texts = seq + 1, 0, [], []
        if ids:
            yield from done()

    ordered = picked.repartitionByRange(parts, F.col("doc_id"), F.substring("text", 1, _HEAD_BYTES)).sortWithinPartitions("doc_id", "text")
    rows = stage(ordered.mapInArrow(pack, f"{KEYS_SCHEMA}, payload binary"), "blocks", "uncompressed")
    return rows.where("payload is not null").select("block", "payload"), rows.where("payload is null").drop("payload"), bits


# ---------------------------------------------------------------- the job


class Candidates:
    """The windows of a block whose seed some other block has: the different ones, sorted, and where each occurs."""

    def __init__(self, block: Block, found: list[dict], bits: int):
        seeds = block.seeds()
        keys = np.unique(seeds[block.valid])
        flag, _, _ = _flags(found, 1, keys, bits)
        shared = np.zeros(len(seeds), dtype=bool)
        if flag.any():
            shared[block.valid] = flag[np.searchsorted(keys, seeds[block.valid])]
        self.hashes, self.checks = block.windows()
        self.at = np.flatnonzero(shared)
        order, same = _in_order(self.hashes[self.at], self.checks[self.at])
        self.nth = np.empty(len(order), np.int64)  # of each window at ``at``: which of the different ones it is
        self.nth[order] = np.cumsum(~same) - 1
        first = self.at[order[~same]]
        self.keys, self.key_checks, self.places = self.hashes[first], self.checks[first], first


def factor(docs: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, factors[, kept_text].

    ``n_removed`` words are covered by factors; the kept words are joined by one space.
    """
    if window < SEED:
        raise ValueError(f"a window has at least {SEED} words")
    blocks, seeds, bits = reference_blocks(docs, window, block_bytes)

    def read(payload: bytes) -> Block:
        return Block(payload, window, word_hashes())

    def window_keys(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for number, payload in zip(left.column("block").to_pylist(), left.column("payload").to_pylist()):
            met = Candidates(read(payload), right.to_pylist(), bits)
            rows.extend(_dealt(met.keys, number, bits, met.key_checks, met.places))
        return _rows(rows, *KEYS)

    def parse(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for number, payload in zip(left.column("block").to_pylist(), left.column("payload").to_pylist()):
            block, found = read(payload), right.to_pylist()
            met = Candidates(block, found, bits)
            reference, word = np.full(len(met.hashes), -1, dtype=np.int64), np.full(len(met.hashes), -1, dtype=np.int64)
            # inside the block: all but the first of equal windows
            at = np.flatnonzero(block.valid)
            order, same = _in_order(met.hashes[at], met.checks[at])
            if same.any():
                head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
                reference[at[order[same]]], word[at[order[same]]] = number, at[order[head[same]]]
            # in earlier blocks: all of them
            flag, first, place = _flags(found, 2, met.keys, bits)
            hit = flag[met.nth]
            reference[met.at[hit]], word[met.at[hit]] = first[met.nth[hit]], place[met.nth[hit]]
            rows.extend(_parsed(block, reference, word, keep_text))
        names = ("doc_id", "n_words", "n_removed", "kept_sha256", "factors", "kept_text")[: 6 if keep_text else 5]
        factor_type = pa.struct({"start": pa.int32(), "length": pa.int32(), "reference_block": pa.int64(), "reference_word": pa.int64()})
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(factor_type), pa.string())
        return _rows(rows, names, types[: len(names)])

    seen = stage(_looked_up(seeds, 1), "seeds")
    by_block = lambda found: blocks.groupBy("block").cogroup(found.groupBy("block"))
    earlier = stage(_looked_up(by_block(seen).applyInArrow(window_keys, KEYS_SCHEMA), 2), "windows")
    return by_block(seen.unionByName(earlier)).applyInArrow(parse, RESULT_SCHEMA + (", kept_text string" if keep_text else ""))


def greedy_factors(starts: np.ndarray, document: np.ndarray, reference: np.ndarray, word: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(indexes into ``starts`` where factors begin, their lengths in words).

    ``starts`` are the windows with a place in the index.  A factor takes the next window if it starts at the next word of
    the same document and its place is the next word of the same reference block.
    """
    goes_on = np.zeros(len(starts), dtype=bool)
    goes_on[1:] = (np.diff(starts) == 1) & (np.diff(document) == 0) & (np.diff(reference) == 0) & (np.diff(word) == 1)
    heads = np.flatnonzero(~goes_on)
    return heads, np.diff(np.append(heads, len(starts))) + window - 1


def _parsed(block: Block, reference: np.ndarray, word: np.ndarray, keep_text: bool):
    """The greedy parse of each document of a block: its factors, and what they leave."""
    starts = np.flatnonzero(reference >= 0)
    document = np.searchsorted(block.ends, starts, side="right")
    heads, lengths = greedy_factors(starts, document, reference[starts], word[starts], block.window)
    f_start, f_ref, f_word, f_doc = starts[heads], reference[starts[heads]], word[starts[heads]], document[heads]
    cover = np.zeros(len(block.words) + 1, dtype=np.int32)
    np.add.at(cover, f_start, 1)
    np.add.at(cover, f_start + lengths, -1)
    covered = np.cumsum(cover)[:-1] > 0
    bounds = np.searchsorted(f_doc, np.arange(len(block.ids) + 1))
    begin = 0
    for i, (doc_id, text) in enumerate(zip(block.ids, block.texts)):
        end = begin + int(block.counts[i])
        gone = covered[begin:end]
        removed = int(gone.sum())
        words = text.split()
        kept = b" ".join(words if not removed else compress(words, (~gone).tolist()))
        of = slice(bounds[i], bounds[i + 1])
        factors = [
            {"start": s - begin, "length": n, "reference_block": r, "reference_word": w}
            for s, n, r, w in zip(f_start[of].tolist(), lengths[of].tolist(), f_ref[of].tolist(), f_word[of].tolist())
        ]
        row = (doc_id, end - begin, removed, hashlib.sha256(kept).hexdigest(), factors)
        yield (*row, kept.decode("utf-8")) if keep_text else row
        begin = end
