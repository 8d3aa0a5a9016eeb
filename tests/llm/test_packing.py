"""Best-fit packing: solver against exhaustive search, tokens against the tokenizer, placement rules."""

from __future__ import annotations

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tracewell.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def fewest(items: list[int], capacity: int) -> int:
    best = [len(items)]
    items = sorted(items, reverse=True)

    def place(i: int, bins: list[int]) -> None:
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        tried = set()
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity and bins[k] not in tried:
                tried.add(bins[k])
                bins[k] += items[i]
                place(i + 1, bins)
                bins[k] -= items[i]
        bins.append(items[i])
        place(i + 1, bins)
        bins.pop()

    place(0, [])
    return best[0]


def test_solver_is_optimal_on_small_cases():
    rng = random.Random(3)
    for case in range(250):
        capacity = rng.choice([20, 50, 100])
        low, high = (1, capacity) if case % 2 else (capacity // 5, capacity // 2 + 1)
        items = [rng.randint(low, high) for _ in range(rng.randint(1, 11))]
        hist = dict(Counter(items))
        found = packing.bin_completion(hist, capacity)
        used = Counter()
        for times, pattern in found:
            assert sum(s * k for s, k in pattern.items()) <= capacity
            for s, k in pattern.items():
                used[s] += times * k
        n = sum(m for m, _ in found)
        assert dict(used) == hist
        assert packing.lower_bound(hist, capacity) <= n == fewest(items, capacity)


def test_solver_on_many_pieces_beats_or_equals_best_fit():
    rng = np.random.default_rng(0)
    hist = dict(Counter(rng.integers(400, 1700, 3000).tolist()))
    found = packing.bin_completion(hist, 4096, max_nodes=200)
    assert packing.lower_bound(hist, 4096) <= sum(m for m, _ in found) <= sum(m for m, _ in packing.best_fit(hist, 4096))
    assert packing.bin_completion({}, 10) == []


def test_the_search_beats_best_fit_at_any_size():
    """One code path: gains over best-fit decreasing below and above a few hundred pieces."""
    rng = random.Random(1)
    gains = {False: 0, True: 0}
    for _ in range(60):
        items = [rng.randint(20, 50) for _ in range(rng.randint(20, 400))]
        hist = dict(Counter(items))
        found = packing.bin_completion(hist, 100, max_nodes=300)
        assert sum((Counter({s: m * k for s, k in p.items()}) for m, p in found), Counter()) == Counter(hist)
        n, plain = sum(m for m, _ in found), sum(m for m, _ in packing.best_fit(hist, 100))
        assert packing.lower_bound(hist, 100) <= n <= plain
        gains[len(items) > 200] += n < plain
    assert min(gains.values()) > 3


def test_the_fullest_filling_comes_first():
    rng = random.Random(9)
    for low, high, n in ((200, 1500, 100), (300, 2000, 60), (500, 1300, 200), (1, 40, 30)):
        for _ in range(10):
            hist = dict(Counter(rng.randint(low, high) for _ in range(n)))
            room = rng.randint(low, 4096)
            sums = {0}
            for size, count in hist.items():
                sums = {t for s in sums for k in range(count + 1) if (t := s + k * size) <= room}
            found = packing.fillings(hist, room, 12)
            assert sum(found[0]) == max(sums)
            assert all(not Counter(f) - Counter(hist) and sum(f) <= room for f in found)
            assert [sum(f) for f in found] == sorted((sum(f) for f in found), reverse=True)


def test_undominated_fillings_are_complete_on_small_rooms():
    hist, room = {5: 2, 4: 1, 3: 2, 2: 1}, 9
    found = packing.fillings(hist, room, 50)
    assert found[0] == [5, 4]  # every other filling can be dealt into its pieces, but for those of other shapes
    every = {tuple(sorted(c, reverse=True)) for k in range(1, 6) for c in itertools.combinations([5, 5, 4, 3, 3, 2], k) if sum(c) <= room}
    assert all(any(packing._dominated(list(c), f) or list(c) == f for f in found) for c in every)


@pytest.mark.parametrize(("low", "high", "n", "share"), [(1200, 1500, 1000, 1.011), (900, 2000, 2000, 1.04), (500, 3000, 3000, 1.005)])
def test_search_comes_near_the_bound_where_three_pieces_fit(low, high, n, share):
    hist = dict(Counter(np.random.default_rng(0).integers(low, high + 1, n).tolist()))
    found = packing.bin_completion(hist, 4096, max_nodes=20)
    assert sum((Counter({s: m * k for s, k in p.items()}) for m, p in found), Counter()) == Counter(hist)
    assert sum(m for m, _ in found) <= share * packing.lower_bound(hist, 4096)


def test_lower_bound_against_its_definition():
    rng = random.Random(2)
    for _ in range(200):
        capacity = rng.choice([10, 31, 100])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 30))]
        want = -(-sum(items) // capacity)
        for k in range(capacity // 2 + 1):
            n1 = sum(i > capacity - k for i in items)
            middle = [i for i in items if capacity // 2 < i <= capacity - k]
            small = sum(i for i in items if k <= i <= capacity // 2)
            want = max(want, n1 + len(middle) + max(0, -(-(small - (len(middle) * capacity - sum(middle))) // capacity)))
        assert packing.lower_bound(dict(Counter(items)), capacity) == want


def test_chunk_ids_are_the_tokenizers():
    encoder, plain, rng = packing.ChunkEncoder(PATH), Tokenizer.from_file(PATH), random.Random(5)
    letters = ["a", "B", "é", "É", "ß", "Ñ", ".", ",", "!", "'s", "'", " ", "\n", "\x1c", "\xa0", "12", "<|endoftext|>", "<|startoftext|>", "<", "İ", "é", "ﬁ", "中", "Σ", "the", "µ"]
    for _ in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 14)))
        assert list(encoder.ids([text.encode()]))[0].tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_a_full_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_CHUNKS", 3)
    encoder, plain = packing.ChunkEncoder(PATH), Tokenizer.from_file(PATH)
    texts = ["one two three four five", "six seven one two", "", "one"]
    for _ in range(2):
        assert [x.tolist() for x in encoder.ids([t.encode() for t in texts])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def check(rows, docs, capacity):
    plain = Tokenizer.from_file(PATH)
    want = Counter()
    for doc_id, text in docs:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            want[(doc_id, piece, start, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by_sequence: dict = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by_sequence)


def test_pack_places_everything(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_SALT", 3)
    docs = [(i % 7, "word " * (i * 3 % 23)) for i in range(40)] + [(None, "null id"), (3, None), (3, None), (9, "long " * 200), (9, "long " * 200), (9, "")]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in docs], "doc_id long, text string, sequence_id double")
    rows = packing.pack(df, PATH, capacity=32).collect()
    n = check(rows, docs, 32)
    assert n <= -(-sum(r.length for r in rows) // 32) + 1
    placed = packing.pack(df, PATH, capacity=32)
    made = packing.sequences(df, placed, PATH, capacity=32).collect()
    assert sum(r.n_tokens for r in made) == sum(r.length for r in rows)
    assert max(r.n_tokens for r in made) <= 32


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


@pytest.mark.parametrize("hist", [{5: 1}, {10: 3}, {1: 100}, {6: 2, 5: 2, 4: 2}])
def test_table_is_gapless(hist):
    rows = packing.placement_table(packing.bin_completion(hist, 10))
    for size, n in hist.items():
        own = rows[rows[:, 0] == size]
        assert own[0, 1] == 0 and own[-1, 2] == n and (own[1:, 1] == own[:-1, 2]).all()
