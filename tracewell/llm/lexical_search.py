"""Ranked lexical search by an Aho-Corasick scan of the documents.

Queries are the items of a benchmark.  All terms of a slice of items make one automaton, each term
guarded by a blank on both sides, so that it matches whole terms only.  Documents are scanned as
they stand, two times and with no index of them: the first scan counts documents and terms of
the collection and in how many documents each item term occurs; the second one counts each term in
each document, maps the automaton's outputs to the items that hold the term, and sums scores.

A term is a maximal run of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased.
With N documents that have a term, L terms in all of them, n terms in one document and df documents
that hold a term, its weight is ``w = floor(1000 * ln((2N + 2) / (2df + 1)))``, a document's length
factor ``m = 100 - 50 + (50nN div L)``, and its score the sum of ``w * ((10^9 tf) div (1000 tf + 20 m))`` over the
different terms of the item.  All but the logarithm is integer arithmetic.

How it scales.  Nothing but counts of item terms and the best ``top`` documents of each item leaves
a task; the ranking shuffles at most ``top`` rows for each item and task, whatever the documents hold.
The items stream through the driver in slices of ``MAX_TERMS`` terms (or of one item that has
more), and only the automaton of a slice is broadcast; each slice's ranks are written before the next slice.
Memory of a task is one batch of texts, a score for each item and some of its documents, and the best rows so far.

Edge cases: a null text or one without terms has none and is no document of the collection; rows that repeat a doc_id, or
all of a row, are documents of their own and may both be ranked; a null doc_id is ranked after equal
scores that have one; rows that repeat an item_id make one item of all their terms; an item with a null id
is an item, one without terms has no rows; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.words import text_batches
from tracewell.plans.staging import stage

#: Ranked documents of an item.
TOP = 50
#: Terms of items that are broadcast at once.
MAX_TERMS = 200_000
#: Scores (documents times items) that a task holds at once, and ranked rows after which the worse ones go.
SCORES_AT_ONCE, ROWS_HELD = 1 << 20, 1 << 18

_IS_TERM = [48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128 for b in range(256)]
_GUARDED = bytes((b + 32 if 65 <= b < 91 else b) if _IS_TERM[b] else 32 for b in range(256))
#: Rows of the first scan that are no term.
_DOCUMENTS, _TERMS = -1, -2


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in order, with repeats."""
    return (text or b"").translate(_GUARDED).split()


class Scanner:
    """The automaton of a slice of items, and which items hold each of its terms."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]]):
        self.ids = [item_id for item_id, _ in items]
        self.terms = sorted({t for _, own in items for t in own})
        number = {t: k for k, t in enumerate(self.terms)}
        of = [(number[t], row) for row, (_, own) in enumerate(items) for t in own]
        of.sort()
        self.items = np.array([row for _, row in of], dtype=np.int64)
        self.sizes = np.bincount(np.array([k for k, _ in of], dtype=np.int64), minlength=len(self.terms))
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.automaton = ahocorasick.Automaton()
        for term, k in number.items():
            self.automaton.add_word(f" {term.decode('latin-1')} ", k)
        self.automaton.make_automaton()

    def counts(self, text: bytes) -> tuple[int, Counter]:
        """(terms of the text, how often it holds each item term)."""
        guarded = text.translate(_GUARDED)
        if not self.terms:
            return len(guarded.split()), Counter()
        return len(guarded.split()), Counter(map(itemgetter(1), self.automaton.iter(f" {guarded.decode('latin-1')} ")))


_built: dict[str, Scanner] = {}


def _scanner(key: str, items: list) -> Scanner:
    """The scanner of a slice, built once in each Python worker; the one before it goes."""
    if key not in _built:
        _built.clear()
        _built[key] = Scanner(items)
    return _built[key]


def _slices(benchmark: DataFrame) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """The items in slices of bounded size, each (item_id, its different terms); the driver holds one slice."""

    def cut(batches):
        for batch, texts in text_batches(batches):
            own = [sorted(set(terms(t))) for t in texts]
            rows = np.repeat(np.arange(len(own)), [len(x) for x in own])
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(rows)), pa.array([t for x in own for t in x], pa.binary())], names=["item_id", "term"])

    picked = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    held: list[tuple[int | None, list[bytes]]] = []
    n = 0
    for row in picked.mapInArrow(cut, "item_id long, term binary").distinct().orderBy("item_id", "term").toLocalIterator():
        if not held or held[-1][0] != row["item_id"]:
            if n >= MAX_TERMS:
                yield held
                held, n = [], 0
            held.append((row["item_id"], []))
        held[-1][1].append(bytes(row["term"]))
        n += 1
    if held:
        yield held


def _collection(docs: DataFrame, shared) -> dict[int, int]:
    """Documents and terms of the collection, and the documents that hold each term of the slice."""

    def count(batches):
        scanner, seen = _scanner(*shared.value), Counter()
        for _, texts in text_batches(batches):
            for text in texts:
                n, found = scanner.counts(text)
                seen.update(found.keys())
                seen[_DOCUMENTS] += n > 0
                seen[_TERMS] += n
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.int64()), pa.array(seen.values(), pa.int64())], names=["term", "n"])

    return {r["term"]: r["n"] for r in docs.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator()}


class _Best:
    """The best rows of each item: higher scores first, then smaller doc_ids, nulls last."""

    def __init__(self, n_items: int, top: int):
        self.top, self.rows, self.held = top, [], 0
        self.least = np.ones(n_items, dtype=np.int64)  # scores below don't count any more

    def add(self, scores: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        row, item = np.nonzero(scores >= self.least)
        self.rows.append((item, scores[row, item], ids[row], no_id[row]))
        self.held += len(row)
        if self.held > ROWS_HELD + self.top * len(self.least):
            self.pruned()

    def pruned(self) -> tuple[np.ndarray, ...]:
        item, score, ids, no_id = (np.concatenate(x) for x in zip(*self.rows)) if self.rows else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)
        order = np.lexsort((ids, no_id, -score, item))
        item, score, ids, no_id = item[order], score[order], ids[order], no_id[order]
        begin = np.searchsorted(item, item, side="left")
        place = np.arange(len(item)) - begin
        full = place == self.top - 1
        self.least[item[full]] = score[full]
        keep = place < self.top
        self.rows = [(item[keep], score[keep], ids[keep], no_id[keep])]
        self.held = int(keep.sum())
        return self.rows[0]


def _ranked(docs: DataFrame, shared, weights, top: int) -> DataFrame:
    """(item_id, doc_id, score): the best documents of each item in each task."""

    def rank(batches):
        scanner = _scanner(*shared.value)
        n_docs, n_terms, weight = weights.value
        best = _Best(len(scanner.ids), top)
        at_once = max(1, SCORES_AT_ONCE // max(1, len(scanner.ids)))
        for batch, texts in text_batches(batches):
            ids = batch.column("doc_id")
            values, no_id = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
            for begin in range(0, len(texts), at_once):
                part = texts[begin : begin + at_once]
                scores = np.zeros((len(part), len(scanner.ids)), dtype=np.int64)
                for row, text in enumerate(part):
                    n, found = scanner.counts(text)
                    if not found:
                        continue
                    m = 100 - 50 + (50 * n * n_docs) // n_terms
                    term = np.fromiter(found.keys(), np.int64, len(found))
                    tf = np.fromiter(found.values(), np.int64, len(found))
                    gain = weight[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m))
                    sizes = scanner.sizes[term]
                    place = np.arange(sizes.sum()) + np.repeat(scanner.begins[term] - np.cumsum(sizes) + sizes, sizes)
                    np.add.at(scores[row], scanner.items[place], np.repeat(gain, sizes))
                best.add(scores, values[begin : begin + at_once], no_id[begin : begin + at_once])
        item, score, ids, no_id = best.pruned()
        names = pa.array(scanner.ids, pa.int64())
        yield pa.RecordBatch.from_arrays([names.take(pa.array(item)), pa.array(ids.astype(np.int64), mask=no_id), pa.array(score)], names=["item_id", "doc_id", "score"])

    return docs.mapInArrow(rank, "item_id long, doc_id long, score long")


def search(docs: DataFrame, benchmark: DataFrame, top: int = TOP) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the ``top`` best documents of each item, rank 1 first."""
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    context = docs.sparkSession.sparkContext
    out = docs.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    for items in _slices(benchmark):
        shared = context.broadcast((uuid.uuid4().hex, items))
        seen = _collection(picked, shared)
        n_docs, n_terms = seen.get(_DOCUMENTS, 0), seen.get(_TERMS, 0)
        if n_docs:
            number = sorted({t for _, own in items for t in own})
            weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * seen.get(k, 0) + 1))) for k in range(len(number))], dtype=np.int64)
            weights = context.broadcast((n_docs, n_terms, weight))
            out = out.unionByName(stage(_ranked(picked, shared, weights, top), "ranked"))
            weights.unpersist()
        shared.unpersist()
    best_first = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
