"""Quality classifier: random-indexing word vectors, pooled, into a small numpy network.

Texts are cut into words (whole runs of letters, in lower case), marks of their case, numbers by length, and runs of
symbols, which are hashed into ``BUCKETS``.  Every bucket has a sparse random index vector; its word vector is
the sum of the index vectors of its neighbours over the labelled texts; a word that these never hold has only its
index vector.  A document is the mean of its tokens' word vectors and index vectors, with its share of
different words and its length beside them (pooling alone can't see repetition); a network with one hidden
layer scores it, and a temperature fitted on rows that trained nothing calibrates the probability.

Labels are learned from at most ``MAX_LABELLED`` rows (lowest hashes of doc_id first), which
are broadcast to find their texts; scores cover every whole text.  The model, about
``2 x DIMENSIONS x BUCKETS`` floats, is broadcast.

Edge cases: null and wordless texts pool to zero and get the network's score for that; with no
labels, or one class, the score is the share of good labels (0.5 with none); labels that
disagree on a document each count; documents with a null doc_id are scored, never learned from;
repeated rows stay repeated; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.words import CACHE_ENTRIES

BUCKETS = 1 << 16
DIMENSIONS = 32
HIDDEN = 24
MAX_LABELLED = 6_000
NEIGHBOURS = 2
THRESHOLD = 0.7
_RUNS = re.compile(r"[^\W\d_]+|\d+|_+|[^\w\s]+")
_TOKENS_AT_ONCE = 1 << 16


class Tokens:
    """Buckets of a text's tokens, through a bounded cache of words."""

    def __init__(self):
        self.cache: dict[bytes, bytes] = {}

    @staticmethod
    def _word(word: bytes) -> bytes:
        out = []
        for run in _RUNS.findall(word.decode("utf-8", "replace")):
            if run[0].isdigit():
                name = f"9{min(len(run), 6)}"
            elif run[0].isalpha():
                if run[0].isupper():
                    out.append(_bucket("U" if len(run) > 1 and run.isupper() else "c"))
                name = f"w{run.lower()}"
            else:
                name = f"s{run[:3]}"
            out.append(_bucket(name))
        return np.array(out, dtype="<u2").tobytes()

    def of(self, text: bytes) -> tuple[np.ndarray, int, int]:
        """(buckets, number of words, number of different words)."""
        cache, words = self.cache, text.split()
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        different = set(words)
        for word in different.difference(cache):
            cache[word] = self._word(word)
        return np.frombuffer(b"".join(map(cache.__getitem__, words)), dtype="<u2"), len(words), len(different)


@cache
def _tokens() -> Tokens:
    """One cache of words for each Python worker."""
    return Tokens()


def _bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8")) % BUCKETS


def index_vectors(seed: int = 11) -> np.ndarray:
    """A sparse random vector of -1, 0 and 1 for every bucket."""
    rng = np.random.default_rng(seed)
    out = np.zeros((BUCKETS, DIMENSIONS), dtype=np.float32)
    for sign in (1.0, 1.0, -1.0, -1.0):
        out[np.arange(BUCKETS), rng.integers(0, DIMENSIONS, BUCKETS)] += sign
    return out


def word_vectors(texts: list[np.ndarray]) -> np.ndarray:
    """Random-indexing vectors of unit length: sums of the neighbours' index vectors."""
    index = index_vectors()
    vectors = np.zeros((BUCKETS, DIMENSIONS), dtype=np.float64)
    for tokens in texts:
        b = tokens.astype(np.int64)
        for gap in range(1, NEIGHBOURS + 1):
            if len(b) <= gap:
                continue
            for here, there in ((b[:-gap], b[gap:]), (b[gap:], b[:-gap])):
                keys, n = np.unique(here * BUCKETS + there, return_counts=True)
                np.add.at(vectors, keys // BUCKETS, index[keys % BUCKETS] * n[:, None])
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.hstack([vectors / np.maximum(length, 1e-9), index / 2]).astype(np.float32)


def pooled(tokens: np.ndarray, n_words: int, n_different: int, vectors: np.ndarray) -> np.ndarray:
    """Mean vector of a document, its share of different words, and the logarithm of its length."""
    total = np.zeros(vectors.shape[1])
    for begin in range(0, len(tokens), _TOKENS_AT_ONCE):
        total += vectors[tokens[begin : begin + _TOKENS_AT_ONCE]].sum(axis=0, dtype=np.float64)
    return np.append(total / max(1, len(tokens)), [n_different / max(1, n_words), np.log1p(n_words)])


class Network:
    """Two layers, trained by Adam on the log loss, and a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, steps: int = 600, seed: int = 5):
        rng = np.random.default_rng(seed)
        apart = np.arange(len(x)) % 5 == 4
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = self._scaled(x)
        shapes = ((x.shape[1], HIDDEN), (HIDDEN,), (HIDDEN, 1), (1,))
        self.w = [rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) == 2 else np.zeros(s) for s in shapes]
        moments = [(np.zeros(s), np.zeros(s)) for s in shapes]
        fit, target = z[~apart], y[~apart].astype(float)
        weight = np.where(target == 1, 0.5 / max(1e-9, target.mean()), 0.5 / max(1e-9, 1 - target.mean()))
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(fit), min(256, len(fit)))
            a, t, k = fit[pick], target[pick], weight[pick]
            h = np.tanh(a @ self.w[0] + self.w[1])
            p = 1 / (1 + np.exp(-(h @ self.w[2] + self.w[3])[:, 0]))
            d = ((p - t) * k / len(pick))[:, None]
            dh = d @ self.w[2].T * (1 - h * h)
            grads = [a.T @ dh + 1e-4 * self.w[0], dh.sum(axis=0), h.T @ d + 1e-4 * self.w[2], d.sum(axis=0)]
            for i, g in enumerate(grads):
                m, v = moments[i]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                self.w[i] = self.w[i] - 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.temperature = 1.0
        if apart.any():
            logits, truth = self._logits(z[apart]), y[apart]
            grid = np.geomspace(0.25, 8, 41)
            losses = [np.logaddexp(0, np.where(truth == 1, -1, 1) * logits / t).mean() for t in grid]
            self.temperature = float(grid[int(np.argmin(losses))])

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def _logits(self, z: np.ndarray) -> np.ndarray:
        return (np.tanh(z @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3])[:, 0]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._logits(self._scaled(x)) / self.temperature, -40, 40)))


class Constant:
    """What is said where there is nothing to learn from."""

    def __init__(self, value: float):
        self.value = value

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED):
    """(vectors, network) from labelled documents: labels(doc_id, quality)."""
    picked = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("label_doc_id"), F.col("quality").cast("int").alias("quality"))
    picked = picked.orderBy(F.xxhash64("label_doc_id"), "label_doc_id", "quality").limit(max_labelled)
    met = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).join(F.broadcast(picked), F.col("doc_id") == F.col("label_doc_id"))

    def cut(batches):
        for batch in batches:
            rows = [_tokens().of(t or b"") for t in batch.column("text").to_pylist()]
            columns = [pa.array([b.tobytes() for b, _, _ in rows], pa.binary()), *(pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), *columns], names=["doc_id", "quality", "tokens", "n_words", "n_different"])

    rows = met.select("doc_id", "quality", "text").mapInArrow(cut, "doc_id long, quality int, tokens binary, n_words long, n_different long").toPandas()
    rows = rows.sort_values(["doc_id", "quality"], kind="stable")
    order = np.random.default_rng(3).permutation(len(rows))
    texts = [np.frombuffer(rows["tokens"].iloc[i], dtype="<u2") for i in order]
    y = (rows["quality"].to_numpy()[order] > 0).astype(int)
    vectors = word_vectors(texts)
    if len(set(y.tolist())) < 2:
        return vectors, Constant(float(y.mean()) if len(y) else 0.5)
    sizes = rows[["n_words", "n_different"]].to_numpy()[order]
    return vectors, Network(np.stack([pooled(t, int(n), int(m), vectors) for t, (n, m) in zip(texts, sizes)]), y)


def scored(docs: DataFrame, model) -> DataFrame:
    """(doc_id, score, predicted) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        vectors, network = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            x = np.stack([pooled(*_tokens().of(t or b""), vectors) for t in texts]) if texts else np.zeros((0, vectors.shape[1] + 2))
            p = network.probabilities(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64()), pa.array((p >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(judge, "doc_id long, score double, predicted int")
