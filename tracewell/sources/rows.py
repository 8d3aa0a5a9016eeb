"""Rows that a scanner finds in texts, written in small record batches.

An Arrow batch holds up to some ten thousand texts, and a scanner may find many rows in each.  Texts become Python objects one by one, and rows leave
the task as soon as ``ROWS_AT_ONCE`` or ``CHARS_AT_ONCE`` of them are held, also within a text, so that a worker's memory doesn't grow with its share of the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

#: Rows, and characters in them, that are held at most before they are written (and what one more row has).
ROWS_AT_ONCE, CHARS_AT_ONCE = 2_000, 1 << 20


def _chars(value) -> int:
    """Characters of a text, or of the keys and values of a map."""
    if isinstance(value, str):
        return len(value)
    return sum(len(k) + len(v) for k, v in value) if isinstance(value, list) else 0


def _written(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, schema.types)], schema=schema)


def rows_of(batches: Iterable[pa.RecordBatch], scanner: Callable[[str], Iterable[tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(id, *row) for every row that ``scanner`` finds in a text; batches hold an id and a text, and a null text is an empty one."""
    held: list[tuple] = []
    chars = 0
    for batch in batches:
        ids, texts = batch.columns
        for n in range(batch.num_rows):
            own = ids[n].as_py()
            for row in scanner(texts[n].as_py() or ""):
                held.append((own, *row))
                chars += sum(map(_chars, row))
                if len(held) >= ROWS_AT_ONCE or chars >= CHARS_AT_ONCE:
                    yield _written(held, schema)
                    held, chars = [], 0
    if held:
        yield _written(held, schema)
