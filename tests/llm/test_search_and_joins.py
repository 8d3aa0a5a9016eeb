"""Phrase collocations, Jaccard join and ranked lexical search against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tracewell.llm import collocations, jaccard_join, lexical_search

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# ---------------------------------------------------------------- phrase collocations


def phrases_by_hand(docs, min_count, longest, top):
    counts, totals = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            totals[lang] += len(w)
            for k in range(1, longest + 1):
                counts.update((lang, w[i : i + k]) for i in range(len(w) - k + 1))
    frequent = {key: n for key, n in counts.items() if n >= min_count}
    out = []
    for lang in totals:
        own = {p: n for (x, p), n in frequent.items() if x == lang and len(p) > 1}
        rows = []
        for p, a in own.items():
            if any(len(q) > len(p) and n >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, n in own.items()):
                continue
            score, _, l, r = min((1000 * a * totals[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), " ".join(p), a, l, r, totals[lang], score))
        out += [(lang, rank, *row[3:]) for rank, row in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def talk(seed, n):
    rng = random.Random(seed)
    vocabulary = ["alpha", "Beta", "gamma", "de", "la", "x\x85y", "ñu", "x", "x", "the"]
    docs = []
    for i in range(n):
        words = [rng.choice(vocabulary) + rng.choice(["", "", "", "", ".", ",", "!"]) for _ in range(rng.randint(0, 30))]
        if i % 3 == 0:
            words[len(words) // 2 : len(words) // 2] = "one two three four five six".split()
        docs.append((rng.choice(["en", "en", "fr", None]), rng.choice([" ", "  ", "\t", " "]).join(words) + rng.choice(["", "\n", "\r\nthe de"])))
    return [*docs, ("en", None), (None, ""), ("es", "only. one; word"), docs[0], docs[0]]


def found_phrases(spark, docs, **kwargs):
    df = spark.createDataFrame([(None, lang, text, 1, "clash") for lang, text in docs], "doc_id long, lang string, text string, n int, phrase string")
    got = collocations.collocations(df.repartition(3), **kwargs).collect()
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got)


@pytest.mark.parametrize("top", [2000, 3])
def test_phrases_are_those_counted_by_hand(spark, top):
    docs = talk(1, 150)
    assert found_phrases(spark, docs, min_count=8, top=top) == phrases_by_hand(docs, 8, 5, top)


def test_phrases_of_tables_without_any(spark):
    assert found_phrases(spark, [], min_count=1) == []
    assert found_phrases(spark, [("en", None), ("en", "?!"), (None, "word")], min_count=1) == []


def test_tries_burst_spill_and_forget_words_without_losing_counts(monkeypatch):
    for burst, entries, words in ((3, 50, 10_000), (4_096, 20, 10_000), (2, 1_000, 8)):
        monkeypatch.setattr(collocations, "MAX_ENTRIES", entries)
        monkeypatch.setattr(collocations, "MAX_WORDS", words)
        monkeypatch.setattr(collocations.BurstTrie.__init__, "__defaults__", (burst,))
        rng, want, got = random.Random(burst), Counter(), Counter()
        known = np.full(collocations.FILTER_BITS // 8, 255, dtype=np.uint8)
        counter = collocations._Counter(3, 5, known, 7)

        def runs(batches):
            for batch in collocations._merged(batches, 1):
                got.update({p: n for p, n in zip(batch.column("phrase").to_pylist(), batch.column("n").to_pylist()) if p is not None})

        for _ in range(40):
            w = [rng.choice("abcdefghijkl") for _ in range(30)]
            for k in (3, 4, 5):
                want.update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
            counter.add("en", counter.ids([x.encode() for x in w] + [b""]))
            runs(list(counter.runs()))
        runs(list(counter.runs(last=True)))
        assert got == want


def test_scores_beyond_64_bits_are_exact(spark):
    """The decimals of the score, on counts whose products pass 64 bits."""
    from pyspark.sql import functions as F

    rows = [(10**12 + 7, 10**15 + 3, 10**12 + 9, 10**13 + 1), (100, 10**16 - 1, 100, 100)]
    df = spark.createDataFrame(rows, "a long, n long, l long, r long")
    got = [r[0] for r in df.select(F.expr(collocations.EXACT_SCORE)).collect()]
    assert got == [1000 * a * n // (l * r) for a, n, l, r in rows]


# ---------------------------------------------------------------- Jaccard join


def components_by_hand(docs, percent=90):
    sets = []
    for _, text in docs:
        w = WORD.findall((text or "").translate(LOWER))
        sets.append(frozenset(" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset())
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]) and root[i] != root[j]:
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    least = {}
    for (doc_id, _), r in zip(docs, root):
        if doc_id is not None:
            least[r] = min(doc_id, least.get(r, doc_id))
    return sorted(((d, len(s), least.get(r)) for (d, _), s, r in zip(docs, sets, root)), key=str)


def families(seed, n, length, edits, kinds=4):
    """Near copies of a few texts: some words changed, some texts cut short or grown."""
    rng = random.Random(seed)
    bases = [[f"b{k}w{rng.randrange(10**6)}" for _ in range(rng.randint(5, length))] for k in range(kinds)]
    docs = []
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.randint(0, edits)):
            at = rng.randrange(len(words))
            words[at : at + rng.choice([0, 1, 1, 1])] = [f"e{rng.randrange(10**6)}"]
        docs.append((i * 7 % n, rng.choice([" ", "\n"]).join(words[: rng.choice([len(words), len(words), len(words) - 2])])))
    return docs


def found_components(spark, docs, **kwargs):
    df = spark.createDataFrame([(d, t, "x", 0) for d, t in docs], "doc_id long, text string, label string, size int").repartition(3)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.clustered(df, **kwargs).collect()), key=str)


EDGES = [(500, None), (501, ""), (502, " \t\n"), (503, "one"), (504, "ONE"), (505, "one two"), (506, "one two"), (507, "a b c"), (7, "a b c"), (7, "other words here"), (None, "a b c"), (None, "null id alone"), (None, None), (508, "\x1cé\xa0x é"), (509, " ".join(f"l{i}" for i in range(30_000)))]


@pytest.mark.parametrize("small", [256, 2])
def test_components_are_those_of_all_pairs(spark, monkeypatch, small):
    """With regions of two members at most, everything goes through rings and regions of deeper levels."""
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 0 if small == 2 else 500_000)
    docs = [*families(3, 70, 120, 6), *EDGES]
    assert found_components(spark, docs) == components_by_hand(docs)


def test_components_of_an_empty_table(spark):
    assert found_components(spark, []) == []


def test_other_similarities(spark):
    docs = families(5, 50, 60, 5)
    assert found_components(spark, docs, percent=75) == components_by_hand(docs, 75)


def test_any_two_linked_sets_share_a_cell():
    rng = np.random.default_rng(0)
    for percent in (60, 80, 90):
        brackets = jaccard_join.Brackets(percent)
        linked = 0
        for _ in range(1500):
            a = np.unique(rng.integers(0, 2**63, rng.integers(1, 400), dtype=np.uint64))
            most = jaccard_join.own_reach(len(a), percent)
            gone = rng.integers(0, min(len(a), most + 2))
            b = np.unique(np.concatenate([a[gone:], rng.integers(0, 2**63, rng.integers(0, most + 2), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= percent * (len(a) + len(b) - both) and not np.array_equal(a, b):
                linked += 1
                assert len(np.intersect1d(jaccard_join.cells(a, brackets), jaccard_join.cells(b, brackets)))
        assert linked > 100


def test_linked_members_of_a_region_meet_again():
    """Two linked sets of which one doesn't link with the pivot share a region of the next level, whatever the pivot and the majority."""
    rng, met = np.random.default_rng(1), 0
    universe = rng.integers(0, 2**63, 600, dtype=np.uint64)
    for case in range(3000):
        base = rng.choice(universe, rng.integers(20, 150), replace=False)
        pivot, a = (np.unique(np.concatenate([base[rng.random(len(base)) > share], rng.choice(universe, extra)])) for share, extra in ((rng.random() / 3, rng.integers(0, 9)), (rng.random() / 3, rng.integers(0, 9))))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > rng.random() / 12], rng.choice(universe, rng.integers(0, 5))]))
        both = len(np.intersect1d(a, b))
        if not len(pivot) or 100 * both < 90 * (len(a) + len(b) - both):
            continue
        majority = base if case % 2 else np.zeros(0, dtype=np.uint64)
        (la, ka), (lb, kb) = (jaccard_join.registers(pivot, x, majority, 90) for x in (a, b))
        if not (la and lb):
            met += 1
            assert len(np.intersect1d(ka, kb)) or np.array_equal(a, b)
    assert met > 300


def test_links_of_a_region_on_differences():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 80, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(80) > 0.06], rng.integers(0, 2**63, rng.integers(0, 5), dtype=np.uint64)])) for _ in range(60)]
    a, b = jaccard_join.joined(np.array([len(s) for s in sets]), [jaccard_join.difference(sets[0], s)[0] for s in sets], 90)
    want = jaccard_join._roots(60, *np.nonzero(np.triu([[100 * (m := len(np.intersect1d(x, y))) >= 90 * (len(x) + len(y) - m) for y in sets] for x in sets], 1)))
    assert (jaccard_join._roots(60, a, b) == want).all() and 1 < len(set(want.tolist())) < 60


# ---------------------------------------------------------------- ranked lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranks_by_hand(docs, items, top):
    split = lambda text: TERM.findall((text or "").translate(LOWER))
    held = [(d, Counter(t)) for d, t in ((d, split(text)) for d, text in docs) if t]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked: dict = {}
    for item_id, text in items:
        asked.setdefault(item_id, set()).update(split(text))
    out = []
    for item_id, terms in asked.items():
        rows = []
        for doc_id, c in held:
            m = 100 - 50 + (50 * c.total() * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score > 0:
                rows.append((-score, doc_id is None, doc_id or 0, doc_id, score))
        out += [(item_id, rank, r[3], r[4]) for rank, r in enumerate(sorted(rows, key=lambda r: r[:3])[:top], 1)]
    return sorted(out, key=str)


def library(seed, n=120):
    rng = random.Random(seed)
    words = ["the", "The", "dog-house", "x1", "É", "é", "naïve", "中文", "a_b", "don't", "cat", "cat", "mouse.", "\x7f", "end\x00start", "¿qué?"]
    docs = [(rng.randrange(n), " ".join(rng.choice(words) for _ in range(rng.randint(0, 25)))) for _ in range(n)]
    docs += [(None, "cat mouse"), (None, "cat mouse"), (3, None), (4, ""), (5, "?! --"), (6, "cat " * 5000), (6, "cat " * 5000), docs[0]]
    items = [(1, "the cat"), (2, "The CAT, the mouse"), (3, None), (4, ""), (5, "absent words"), (6, "É x1 naïve"), (7, "中文 qué"), (2, "dog"), (None, "house b"), (8, "t don start end")]
    return docs, items


@pytest.mark.parametrize(("top", "terms"), [(50, 200_000), (3, 200_000), (50, 2)])
def test_ranks_are_those_by_hand(spark, monkeypatch, top, terms):
    monkeypatch.setattr(lexical_search, "MAX_TERMS", terms)
    docs, items = library(4)
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, score int, rank int").repartition(3)
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in lexical_search.search(df, benchmark, top).collect()), key=str)
    assert got == ranks_by_hand(docs, items, top)


def test_ranks_of_empty_tables(spark):
    docs, items = library(4)
    some = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert lexical_search.search(some[0].limit(0), some[1]).collect() == [] == lexical_search.search(some[0], some[1].limit(0)).collect()
    assert lexical_search.search(some[0].where("text = ''"), some[1]).collect() == []


def test_best_rows_stay_when_rows_are_pruned(monkeypatch):
    monkeypatch.setattr(lexical_search, "ROWS_HELD", 5)
    rng = np.random.default_rng(0)
    scores, ids = rng.integers(0, 6, (400, 3)), rng.permutation(400)
    best = lexical_search._Best(3, 7)
    for begin in range(0, 400, 9):
        best.add(scores[begin : begin + 9], ids[begin : begin + 9], np.zeros(len(ids[begin : begin + 9]), dtype=bool))
    item, score, doc, _ = best.pruned()
    for k in range(3):
        want = sorted((-s, d) for s, d in zip(scores[:, k].tolist(), ids.tolist()) if s > 0)[:7]
        assert [(-s, d) for s, d in zip(score[item == k].tolist(), doc[item == k].tolist())] == want
