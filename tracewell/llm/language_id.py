"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, everything but letters and their marks becomes a space, and all n-grams of 1 to 3
characters are hashed into ``BUCKETS``.  Training counts buckets per language in Spark (rows are summed
inside tasks first).  A language's log-probabilities are ``log((n + SMOOTHING) / (total + SMOOTHING x BUCKETS))``, its
prior is its share of the learned documents.  The matrix, ``BUCKETS`` x languages, is broadcast.  Scoring counts the
different n-grams of a batch of whole texts, a sparse matrix of texts x ``BUCKETS``, and multiplies it with the
log-probability matrix in numpy.

Each language trains on at most about ``MAX_PER_LANGUAGE`` documents, those with the lowest hashes of
doc_id; a language with fewer uses all.  Rare languages are therefore learned however large the corpus is.  The
matrix grows with the number of languages alone; beyond ``LANGUAGES_AT_ONCE`` it is broadcast in slices, each with a
pass whose best language and sum of likelihoods the next one takes on.

Edge cases: null texts and texts without a letter (Unicode category L) are ``und`` with score 0; with nothing to
learn from, every text is ``und``; ties go to the first language by name; documents with a null
doc_id are scored, never learned from; repeated rows stay repeated; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.plans.staging import stage

BUCKETS = 1 << 16
MAX_PER_LANGUAGE = 3_000
#: Languages of one broadcast slice of the matrix (256 KB each).
LANGUAGES_AT_ONCE = 400
#: Languages whose counts a training task holds before it hands them on.
_LANGUAGES_HELD = 64
SMOOTHING = 0.5
_LETTER = regex.compile(r"\p{L}")
_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
#: Characters whose n-grams are held at once.
_CHARS_AT_ONCE = 1 << 18
_MULTIPLIERS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def prepared(text: str) -> str:
    """Lower case, letters only, one space between and around words."""
    return f" {_NOT_LETTERS.sub(' ', text.lower()).strip()} "


def grams(chars: np.ndarray) -> list[np.ndarray]:
    """Buckets of the n-grams that begin at each character: 1 to 3 long."""
    out, h = [], np.zeros(len(chars), dtype=np.uint32)
    for n, m in enumerate(_MULTIPLIERS):
        h = h[: len(chars) - n] * np.uint32(31) + chars[n:] * m
        out.append(((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)).astype(np.int64))
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def held_out(doc_id, folds: int, fold: int) -> F.Column:
    """Whether the CRC-32 of a doc_id's digits falls into the held-out fold; null ids do not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


class Model:
    """languages, log-probabilities (BUCKETS x languages) and log-priors."""

    def __init__(self, langs: list[str], matrix: np.ndarray, priors: np.ndarray):
        self.langs, self.matrix, self.priors = langs, matrix, priors

    def __getitem__(self, at: int):
        return (self.langs, self.matrix, self.priors)[at]

    def part(self, begin: int, end: int) -> Model:
        return Model(self.langs[begin:end], np.ascontiguousarray(self.matrix[:, begin:end]), self.priors[begin:end])


def train(rows: DataFrame, max_per_language: int = MAX_PER_LANGUAGE) -> Model:
    """The model of rows (doc_id, text, lang)."""
    usable = rows.where("doc_id is not null and lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    shares = rows.sparkSession.createDataFrame([(lang, min(1.0, max_per_language / n)) for lang, n in sizes.items()], "learned_lang string, share double")
    place = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    sample = usable.join(F.broadcast(shares), F.col("lang") == F.col("learned_lang")).where(place < F.col("share"))

    def count(batches):
        totals: dict[str, np.ndarray] = {}

        def told():
            for lang, total in totals.items():
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(total[at])], names=["lang", "bucket", "n"])
            totals.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                if _LETTER.search(text):
                    if lang not in totals and len(totals) >= _LANGUAGES_HELD:
                        yield from told()
                    total = totals.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                    for g in grams(_codes(prepared(text))):
                        total += np.bincount(g, minlength=BUCKETS)
        yield from told()

    counted = sample.select("lang", "text").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))

    def vector(cells: pa.Table) -> pa.Table:
        total = np.zeros(BUCKETS, dtype="<i8")
        total[cells.column("bucket").to_numpy()] = cells.column("n").to_numpy()
        chances = np.log((total + SMOOTHING) / (total.sum() + SMOOTHING * BUCKETS)).astype("<f4")
        return pa.table({"lang": cells.column("lang").slice(0, 1), "chances": pa.array([chances.tobytes()], pa.binary())})

    table = sorted(counted.groupBy("lang").applyInArrow(vector, "lang string, chances binary").collect())  # a vector for each language
    langs = [r["lang"] for r in table]
    matrix = np.zeros((BUCKETS, len(langs)), dtype=np.float32)
    for at, row in enumerate(table):
        matrix[:, at] = np.frombuffer(row["chances"], dtype="<f4")
    learned = np.array([min(sizes[lang], max_per_language) for lang in langs], dtype=float)
    return Model(langs, matrix, np.log(learned / learned.sum()) if len(langs) else np.zeros(0))


def _pieces(texts: list[str | None]):
    """(rows, codes, how many n-grams begin in each) of prepared texts, at most ``_CHARS_AT_ONCE`` characters together; longer texts in pieces."""
    rows, parts, begins, held = [], [], [], 0
    for at, text in enumerate(texts):
        if text is None or not _LETTER.search(text):
            continue
        codes = _codes(prepared(text))
        for begin in range(0, len(codes), _CHARS_AT_ONCE):
            part = codes[begin : begin + _CHARS_AT_ONCE + 2]
            if held and held + len(part) > _CHARS_AT_ONCE:
                yield rows, parts, begins
                rows, parts, begins, held = [], [], [], 0
            rows.append(at)
            parts.append(part)
            begins.append(min(len(part), _CHARS_AT_ONCE))
            held += len(part)
    if rows:
        yield rows, parts, begins


def gram_counts(texts: list[str | None]):
    """The sparse matrix of texts x BUCKETS in parts: arrays (row, bucket, count), sorted by row."""
    for rows, parts, begins in _pieces(texts):
        codes, owner = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        inside = np.arange(len(codes)) - np.repeat(np.cumsum([len(p) for p in parts]) - [len(p) for p in parts], [len(p) for p in parts])
        starts = inside < np.array(begins)[owner]
        keys = []
        for n, g in enumerate(grams(codes)):
            whole = starts[: len(g)] & (owner[: len(g)] == owner[n:])
            keys.append((owner[: len(g)] * BUCKETS + g)[whole])
        cells, counts = np.unique(np.concatenate(keys), return_counts=True)
        yield np.array(rows)[cells // BUCKETS], cells % BUCKETS, counts


def likelihoods(texts: list[str | None], matrix: np.ndarray) -> np.ndarray:
    """Texts x languages: the sparse count matrix times the log-probability matrix."""
    totals = np.zeros((len(texts), matrix.shape[1]))
    for rows, buckets, counts in gram_counts(texts):
        heads = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        np.add.at(totals, rows[heads], np.add.reduceat(matrix[buckets] * counts[:, None].astype(np.float64), heads, axis=0))
    return totals


def _told(texts: list[str | None], model: Model):
    """(whether a text has a letter, its best language, that one's log-likelihood, the log of the sum over languages)."""
    known = np.array([t is not None and _LETTER.search(t) is not None for t in texts], dtype=bool)
    totals = likelihoods(texts, model.matrix) + model.priors
    best = totals.argmax(axis=1)
    top = totals[np.arange(len(texts)), best]
    return known, [model.langs[b] for b in best], top, top + np.log(np.exp(totals - top[:, None]).sum(axis=1))


def score(texts: list[str | None], langs: list[str], matrix: np.ndarray, priors: np.ndarray | None = None) -> tuple[list[str], list[float]]:
    """(language, posterior) of each text; equal priors if none are given."""
    if not langs or not texts:
        return ["und"] * len(texts), [0.0] * len(texts)
    known, best, top, whole = _told(texts, Model(langs, matrix, np.zeros(len(langs)) if priors is None else priors))
    return [b if k else "und" for k, b in zip(known, best)], np.where(known, np.exp(top - whole), 0.0).tolist()


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every document."""
    context = docs.sparkSession.sparkContext
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if len(model.langs) <= LANGUAGES_AT_ONCE:
        shared = context.broadcast(model)

        def label(batches):
            for batch in batches:
                names, scores = score(batch.column("text").to_pylist(), *shared.value)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

        return picked.mapInArrow(label, "doc_id long, lang_pred string, score double")
    schema = "doc_id long, text string, lang_pred string, best double, whole double"
    state = picked.selectExpr("*", "'und' AS lang_pred", "double('-inf') AS best", "double('-inf') AS whole")
    for begin in range(0, len(model.langs), LANGUAGES_AT_ONCE):
        shared = context.broadcast(model.part(begin, begin + LANGUAGES_AT_ONCE))
        state = stage(state.mapInArrow(_take_on(shared), schema), "languages")
        shared.unpersist()
    return state.select("doc_id", "lang_pred", F.when(F.col("lang_pred") == "und", 0.0).otherwise(F.exp(F.col("best") - F.col("whole"))).alias("score"))


def _take_on(shared):
    """A pass over one slice of the languages."""

    def label(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            known, names, top, whole = _told(texts, shared.value)
            before, best, sums = (batch.column(c).to_pylist() for c in ("lang_pred", "best", "whole"))
            better = [k and t > b for k, t, b in zip(known, top, best)]
            columns = [
                pa.array([n if x else b for n, x, b in zip(names, better, before)], pa.string()),
                pa.array([float(t) if x else b for t, x, b in zip(top, better, best)], pa.float64()),
                pa.array(np.logaddexp(np.array(sums, dtype=float), whole), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["doc_id", "text", "lang_pred", "best", "whole"])

    return label
