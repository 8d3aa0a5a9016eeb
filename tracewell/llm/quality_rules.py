"""Quality rules: text statistics, and a decision list learned from labelled ones.

Statistics are taken from whole texts in one pass without a shuffle.  A decision list is then
learned by sequential covering: each rule grows, one threshold condition at a time, by
information gain on two thirds of the labelled rows, is pruned on the last third, and removes
the rows it covers before the next one grows.  What is learned is plain data (feature,
comparison, threshold) and is emitted as an ordered Spark ``CASE WHEN`` expression, so that it
can be read, stored and reviewed.

The labelled rows that the list is learned from are bounded by ``MAX_LABELLED`` (lowest hashes
of doc_id first); statistics and verdicts cover every document.

Edge cases: null and wordless texts have zero for every statistic and fail the base rules;
shares with nothing below the line are 0; labels that are null, or whose document is missing,
teach nothing; with no labels, or only one class, the list is empty and only base rules reject;
repeated rows are judged alike and stay; extra columns are kept by ``judged`` (its own columns
replace those of the same name).
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tracewell.llm.words import WordHashes, rolling, word_hashes

#: Labelled rows that the decision list is learned from, at most.
MAX_LABELLED = 20_000
#: Words of a repeated window.
REPEAT = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: A rule must be at least this precise on the rows kept for pruning, and cover so many rows.
MIN_PRECISION, MIN_COVER, MAX_RULES, MAX_CONDITIONS = 0.95, 4, 12, 3

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaim", "n_pipes", "n_digits")
#: Features of the rules: a count over another count.
SHARES = {
    "symbols_per_char": ("n_symbols", "word_chars"),
    "upper_per_char": ("n_upper", "word_chars"),
    "exclaims_per_word": ("n_exclaim", "n_words"),
    "pipes_per_word": ("n_pipes", "n_words"),
    "digits_per_char": ("n_digits", "word_chars"),
    "chars_per_word": ("word_chars", "n_words"),
    "repeats_per_word": ("n_repeat_words", "n_words"),
    "dup_lines_per_line": ("n_dup_lines", "n_lines"),
}
_SYMBOLS, _DIGITS = b"#*$%&|<>", b"0123456789"
_UPPER = bytes(range(65, 91))


class Condition(NamedTuple):
    feature: str
    above: bool
    threshold: float


def repeated_words(words: list[bytes], hashes: WordHashes) -> int:
    """Words inside windows of REPEAT words that occur at least twice in the text."""
    if len(words) <= REPEAT:
        return 0
    keys = rolling(hashes.of(words), REPEAT)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(keys), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, dtype=np.int32)
    at = np.flatnonzero(twice)
    cover[at] += 1
    cover[at + REPEAT] -= 1
    return int((np.cumsum(cover)[:-1] > 0).sum())


def counts_of(text: bytes, hashes: WordHashes) -> tuple[int, ...]:
    """The COUNTS of a text."""
    words = text.split()
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8"))
    seen: set[bytes] = set()
    lines = dups = 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                dups += 1
            else:
                seen.add(line)
    without = lambda drop: len(joined) - len(joined.translate(None, drop))
    return (len(words), chars, without(_SYMBOLS), dups, repeated_words(words, hashes), lines, without(_UPPER), joined.count(b"!"), joined.count(b"|"), without(_DIGITS))


def with_counts(docs: DataFrame) -> DataFrame:
    """``docs`` and the COUNTS of each text; columns of those names are replaced."""
    kept = docs.drop(*COUNTS)
    schema = StructType([*StructType.fromJson(kept.schema.jsonValue()).fields, *(StructField(c, LongType()) for c in COUNTS)])
    at = kept.columns.index("text")

    def count(batches):
        hashes = word_hashes()
        for batch in batches:
            rows = [counts_of(b"" if t is None else t.encode("utf-8"), hashes) for t in batch.column(at).to_pylist()]
            columns = list(zip(*rows)) or [()] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in columns)], names=[*batch.schema.names, *COUNTS])

    return kept.mapInArrow(count, schema)


def share(feature: str) -> F.Column:
    over, under = SHARES[feature]
    return F.when(F.col(under) > 0, F.col(over) / F.col(under)).otherwise(F.lit(0.0))


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


# ---------------------------------------------------------------- learning


def _gain(p0: int, n0: int, p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Information gain of going from (p0, n0) covered rejects and keeps to (p, n)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = p * (np.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
    return np.where(p > 0, gain, -1.0)


def _holds(x: np.ndarray, names: list[str], rule: list[Condition]) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for c in rule:
        column = x[:, names.index(c.feature)]
        out &= column > c.threshold if c.above else column <= c.threshold
    return out


def _best_condition(x: np.ndarray, bad: np.ndarray, names: list[str]) -> Condition | None:
    p0, n0 = int(bad.sum()), int((~bad).sum())
    best, found = 1e-9, None
    for i, name in enumerate(names):
        order = np.argsort(x[:, i], kind="stable")
        values, hits = x[order, i], bad[order]
        cuts = np.flatnonzero(values[1:] > values[:-1])
        if not len(cuts):
            continue
        below_p = np.cumsum(hits)[cuts].astype(float)
        below_n = (cuts + 1) - below_p
        middle = (values[cuts] + values[cuts + 1]) / 2
        for above, p, n in ((False, below_p, below_n), (True, p0 - below_p, n0 - below_n)):
            gain = _gain(p0, n0, p, n)
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, found = float(gain[k]), Condition(name, above, float(middle[k]))
    return found


def learn(x: np.ndarray, bad: np.ndarray, names: list[str]) -> list[list[Condition]]:
    """Ordered rules, each a conjunction, that find the ``bad`` rows of ``x``."""
    rules: list[list[Condition]] = []
    for_pruning = np.arange(len(x)) % 3 == 2
    left = np.ones(len(x), dtype=bool)
    while len(rules) < MAX_RULES:
        grow, prune = left & ~for_pruning, left & for_pruning
        if not bad[grow].any() or bad[grow].all():
            break
        rule: list[Condition] = []
        inside = grow.copy()
        while len(rule) < MAX_CONDITIONS and not bad[inside].all():
            condition = _best_condition(x[inside], bad[inside], names)
            if condition is None:
                break
            rule.append(condition)
            inside &= _holds(x, names, [condition])
        if not rule:
            break

        def worth(candidate: list[Condition]) -> tuple[float, int]:
            hit = prune & _holds(x, names, candidate)
            p, n = int(bad[hit].sum()), int((~bad[hit]).sum())
            return ((p - n) / (p + n) if p + n else -1.0, -len(candidate))

        while len(rule) > 1:
            shorter = max(([c for k, c in enumerate(rule) if k != drop] for drop in range(len(rule))), key=worth)
            if worth(shorter) < worth(rule):
                break
            rule = shorter
        covered = left & _holds(x, names, rule)
        checked = covered & for_pruning
        precise = bad[covered].mean() >= MIN_PRECISION and (not checked.any() or bad[checked].mean() >= MIN_PRECISION)
        if int(covered.sum()) < MIN_COVER or not precise:
            break
        rules.append(rule)
        left &= ~covered
    return rules


def labelled(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """(features, bad) of at most ``limit`` labelled documents; the labels are few enough to broadcast."""
    picked = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("label_doc_id"), F.col("quality").cast("int").alias("label_quality"))
    picked = picked.orderBy(F.xxhash64("label_doc_id"), "label_doc_id", "label_quality").limit(limit)
    met = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), F.col("doc_id") == F.col("label_doc_id")).drop("label_doc_id")
    rows = with_counts(met).select("doc_id", "label_quality", *(share(f).alias(f) for f in SHARES)).toPandas()
    rows = rows.sort_values(["doc_id", "label_quality", *SHARES], kind="stable")
    order = np.random.default_rng(7).permutation(len(rows))
    return rows[list(SHARES)].to_numpy(dtype=float)[order], (rows["label_quality"] == 0).to_numpy()[order]


def learned_list(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> list[list[Condition]]:
    x, bad = labelled(docs, labels, limit)
    return learn(x, bad, list(SHARES)) if len(x) else []


def verdict(rules: list[list[Condition]]) -> F.Column:
    """The number of the first rule that holds, from 1; null where none does."""
    out = F.lit(None).cast("int")
    for number, rule in reversed(list(enumerate(rules, 1))):
        holds = F.lit(True)
        for c in rule:
            holds = holds & (share(c.feature) > c.threshold if c.above else share(c.feature) <= c.threshold)
        out = F.when(holds, F.lit(number)).otherwise(out)
    return out


def judged(docs: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """``docs`` with the COUNTS, ``base_failed``, ``rule`` (the rejecting one) and ``kept``."""
    counted = with_counts(docs.drop("base_failed", "rule", "kept"))
    return counted.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
