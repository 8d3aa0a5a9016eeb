"""Cells of shingle space: keys of which any two sets that are similar enough share one.

With s the sum of two sets' sizes, a Jaccard similarity of at least p per cent is the same as a symmetric difference of at most
``reach(s) = s (100 - p) div (100 + p)`` shingles.  The universe of shingles is parted into m classes by hash; m depends on the bracket of the
set's size, and a set near the upper end of its bracket takes part in the next one as well.  Two sets that are similar
enough agree in all but ``reach`` classes.  So each set registers under the contents of its ``reach + 1`` fullest classes, in a common order
of all classes' contents: two such sets share one.  A cell is a hash of several shingles, so hardly any others do.  No statistics
of the corpus are needed, and nothing depends on how long a text is.

Edge cases: the empty set has no cells, nor has one so small that only equal sets are similar enough.
"""

from __future__ import annotations

import numpy as np

from tracewell.llm.words import mixed

#: How much the size of a set grows from one bracket to the next.
BRACKET = 1.5

_SALT = np.uint64(0xD6E8FEB86659FD93)


def reach(size: int, percent: int) -> int:
    """The largest symmetric difference at which two sets of so many shingles together are similar enough."""
    return size * (100 - percent) // (100 + percent)


def own_reach(n: int, percent: int) -> int:
    """The largest difference between a set of n shingles and any other that is similar enough."""
    return reach(n + 100 * n // percent, percent)


class Brackets:
    """Brackets of set sizes, and how many classes the universe is parted into for each."""

    def __init__(self, percent: int):
        self.percent = percent
        least = next(n for n in range(1, 1_000) if own_reach(n, percent))
        self.begins = [least]
        while self.begins[-1] < 1 << 40:
            self.begins.append(int(self.begins[-1] * BRACKET) + 1)
        tops = [own_reach(b - 1, percent) for b in self.begins[1:]]
        self.classes = [top + top // 2 + 2 for top in tops]

    def of(self, n: int) -> range:
        """The brackets that a set of n shingles takes part in: its own, and those of larger sets that it may be like."""
        first, last = np.searchsorted(self.begins, [n, 100 * n // self.percent], side="right")
        return range(max(0, first - 1), max(0, last))


def cells(shingles: np.ndarray, brackets: Brackets) -> np.ndarray:
    """The cells under which a set registers: its fullest classes, one more than it may differ in."""
    n, percent = len(shingles), brackets.percent
    most = own_reach(n, percent) if n else 0
    if not most:
        return np.zeros(0, dtype=np.uint64)  # only equal sets are similar enough
    contents, out = mixed(shingles ^ _SALT), []
    for bracket in brackets.of(n):
        m = brackets.classes[bracket]
        own = ((contents >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        size = np.bincount(own, minlength=m)
        order = np.argsort(own, kind="stable")
        sums = np.zeros(m, dtype=np.uint64)
        full = np.flatnonzero(size)
        with np.errstate(over="ignore"):
            sums[full] = np.add.reduceat(contents[order], (np.cumsum(size) - size)[full])
            key = mixed(mixed(sums + np.uint64(bracket + 1)) + np.arange(m, dtype=np.uint64))
        out.append(key[np.lexsort((key, -size))[: most + 1]])
    return np.concatenate(out)
