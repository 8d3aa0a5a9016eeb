"""Shared word helpers for tasks: splitting, stable hashes, rolling hashes.

Words are maximal runs outside ``[\\x20\\x09-\\x0D]``, which is what ``bytes.split()``
yields on UTF-8 text.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import xxhash
from pyspark.sql import functions as F

#: Entries after which a per-task cache starts afresh, so that its memory stays bounded.
CACHE_ENTRIES = 200_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    """word (bytes) -> stable 64-bit hash, computed on first sight."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


@cache
def word_hashes() -> WordHashes:
    """One cache for each Python worker: it serves all tasks that run there."""
    return WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; its input is left alone."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` hashes: length ``max(0, len(h) - n + 1)``.

    Runs are doubled (1, 2, 4, ...), so the cost is logarithmic in ``n``.
    """
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64)
    out, width = None, 0
    run, size, power = h, 1, _BASE  # hash of `size` items, BASE ** size
    rest = n
    with np.errstate(over="ignore"):
        while rest:
            if rest & 1:
                if out is None:
                    out, width = run, size
                else:
                    m = min(len(out), len(run) - width)
                    out = out[:m] * power + run[width : width + m]
                    width += size
            rest >>= 1
            if rest:
                m = len(run) - size
                run = run[:m] * power + run[size : size + m] if m > 0 else run[:0]
                power = power * power
                size *= 2
        return mixed(out[: len(h) - n + 1])


#: Rows of an Arrow batch that become Python objects together.
ROWS_AT_ONCE = 1_000


def text_batches(batches, column: str = "text"):
    """(rows, list of bytes per row) of Arrow batches whose text column was cast to binary, a slice at a time."""
    for batch in batches:
        for begin in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(begin, ROWS_AT_ONCE)
            yield part, [b"" if x is None else x for x in part.column(column).to_pylist()]


def text_key(text: str = "text") -> F.Column:
    """128 bits of the whole text; a null text is an empty one."""
    return F.substring(F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"), 256)), 1, 16)
