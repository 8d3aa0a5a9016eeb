"""Substring dedup, SimHash, PII, decontamination, URL filters and HTML against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tracewell.llm import decontamination, html_text, pii, simhash, substring_dedup, url_filter
from tracewell.llm.words import mixed, rolling

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(seed: int, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(30))
    base = " ".join(rng.choice(vocabulary) for _ in range(80))
    out = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        kind = i % 6
        if kind == 1:
            words[len(words) // 2 : len(words) // 2] = passage.split()
        if kind == 2:
            words = base.split()
        if kind == 3:
            words = base.split()
            words[rng.randrange(len(words))] = "changed"
        if kind == 4:
            words = words[:20] * 3
        out.append((i, " ".join(words).replace(" ", rng.choice([" ", "\n", " \t "]), 3)))
    return [*out, (n, None), (n + 1, ""), (n + 2, "\x1cé\xa0x"), (7, out[1][1]), (None, base), (None, base)]


# ---------------------------------------------------------------- words


def test_rolling_hashes():
    h = np.random.default_rng(0).integers(0, 2**63, 50, dtype=np.uint64)
    for n in (1, 2, 3, 5, 8, 13, 20, 50):
        want = []
        for i in range(50 - n + 1):
            v = 0
            for x in h[i : i + n]:
                v = (v * 0x9E3779B97F4A7C15 + int(x)) % 2**64
            want.append(v)
        assert (mixed(np.array(want, dtype=np.uint64)) == rolling(h, n)).all()
    assert len(rolling(h[:3], 4)) == 0


# ---------------------------------------------------------------- substring dedup


@pytest.mark.parametrize("block_bytes", [200, 1 << 20])
def test_substring_dedup(spark, block_bytes):
    docs = [d for d in documents(1) if d[0] is not None]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, block string")
    found = substring_dedup.factor(df, block_bytes=block_bytes, keep_text=True).collect()
    seen, want = set(), Counter()
    for i, t in sorted(docs, key=lambda d: (d[0], (d[1] or "").encode())):
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - 19):
            key = tuple(words[s : s + 20])
            if key in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(key)
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        want[(i, len(words), sum(gone), hashlib.sha256(kept).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found) == want
    for r in found:
        assert all(f.length >= 20 for f in r.factors)
        covered = set().union(*(range(f.start, f.start + f.length) for f in r.factors)) if r.factors else set()
        assert len(covered) == r.n_removed
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256


def test_substring_dedup_null_ids_and_empty_table(spark):
    df = spark.createDataFrame(documents(2), "doc_id long, text string")
    assert substring_dedup.factor(df, block_bytes=300).count() == len(documents(2))
    assert substring_dedup.factor(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_factors_are_contiguous_in_one_reference_block(spark):
    """A passage stitched from several references: each factor lies whole at its place of an earlier text."""
    rng = random.Random(7)
    words = lambda n: [f"u{rng.randrange(10**6)}" for _ in range(n)]
    sources = [words(60) for _ in range(6)]
    stitched = sources[0][5:40] + sources[3][10:45] + words(7) + sources[5][0:20] + sources[2][30:49] + sources[0][20:60]
    docs = [(i, " ".join(w)) for i, w in enumerate(sources)] + [(10, " ".join(stitched)), (11, " ".join(stitched * 2)), (12, " ".join(words(30_000) + stitched))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for block_bytes in (1, 2_000, 1 << 20):
        found = {r.doc_id: r for r in substring_dedup.factor(df, block_bytes=block_bytes).collect()}
        want = [(0, 35), (35, 35), (77, 20), (116, 40)]  # the run of 19 words is too short
        assert [(f.start, f.length) for f in found[10].factors] == want and found[10].n_removed == 130
        assert found[11].n_removed == 2 * len(stitched) and found[12].n_removed == len(stitched)
    blocks, _, _ = substring_dedup.reference_blocks(df, block_bytes=2_000)
    texts = {r.block: [w for t in substring_dedup._unpacked(bytes(r.payload))[1] for w in t.split()] for r in blocks.collect()}
    own = {i: t.encode().split() for i, t in docs}
    for r in substring_dedup.factor(df, block_bytes=2_000).collect():
        for f in r.factors:
            assert texts[f.reference_block][f.reference_word : f.reference_word + f.length] == own[r.doc_id][f.start : f.start + f.length]


def test_equal_hashes_of_different_windows_are_told_apart():
    hashes, checks = np.array([5, 5, 7, 5, 5], dtype=np.uint64), np.array([1, 2, 3, 1, 2], dtype=np.uint64)
    order, same = substring_dedup._in_order(hashes, checks)
    assert order.tolist() == [0, 3, 1, 4, 2] and same.tolist() == [False, True, False, True, False]


# ---------------------------------------------------------------- simhash


def brute_fingerprint(text: str | None) -> int:
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints: list[int], bits: int) -> list[int]:
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_codes_are_perfect_and_anchors_meet():
    for code in simhash.CODES:
        leaders = simhash._code_tables(*code)[2]
        assert len(set(leaders.tolist())) == len(leaders)
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**64 - 1, 300, dtype=np.uint64)
    for bits, half, codes in ((2, 1, simhash.CODES), (4, 2, simhash.CODES[:2])):
        y = x.copy()
        for i in range(len(x)):
            for b in rng.choice(64, bits, replace=False):
                y[i] ^= np.uint64(1) << np.uint64(b)
        pairs = zip(simhash.anchors(x, half, codes).tolist(), simhash.anchors(y, half, codes).tolist())
        assert all(set(a) & set(b) for a, b in pairs)


def test_simhash_components(spark):
    docs = [d for d in documents(3, 40) if d[0] is not None]
    docs = [(i + 100 * k, t) for k, (i, t) in enumerate(docs)] + [(1, docs[5][1]), (1, docs[5][1])]
    found = simhash.clustered(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", simhash.hex_digits("fp").alias("f"), "component_id").collect()
    prints = [brute_fingerprint(t) for _, t in docs]
    groups: dict = {}
    for (i, _), g in zip(docs, brute_components(prints, 2)):
        groups.setdefault(g, []).append(i)
    want = Counter((i, f"{p:016x}", min(groups[g])) for (i, _), p, g in zip(docs, prints, brute_components(prints, 2)))
    assert Counter((r.doc_id, r.f, r.component_id) for r in found) == want
    assert simhash.clustered(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("threshold", [1, 2, 4])
def test_links_join_exactly_what_is_linked(spark, threshold, monkeypatch):
    monkeypatch.setattr(simhash, "CROWDED", 4)
    rng = random.Random(threshold)
    prints = set()
    for _ in range(12):
        p = rng.getrandbits(64)
        for _ in range(12):
            prints.add(p)
            for _ in range(rng.randint(0, 3)):
                p ^= 1 << rng.randrange(64)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), threshold)
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() for a, b in ((r.a, r.b) for r in edges.collect()))
    root = {r.node: r.root for r in simhash.components(edges).collect()}
    want = brute_components(prints, threshold)
    same = {}
    for p, g in zip(signed, want):
        same.setdefault(g, set()).add(root.get(p, p))
    assert all(len(x) == 1 for x in same.values()) and len({next(iter(x)) for x in same.values()}) == len(same)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {(r.node, r.root) for r in simhash.components(edges).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


def test_near_copies_are_verified(spark):
    rng = random.Random(9)
    base = [rng.choice("abcdefgh") * 4 + str(rng.randrange(500)) + "word" for _ in range(300)]
    near, other = list(base), [w[::-1] for w in base]
    near[50] = "different"
    docs = [(5, " ".join(base), "a"), (6, " ".join(base), "b"), (7, " ".join(near), "c"), (8, " ".join(other), "d"), (9, None, "e"), (10, "", "f"), (None, " ".join(base), "g"), (8, " ".join(other), "d")]
    df = spark.createDataFrame(docs, "doc_id long, text string, text_hash string")
    left = simhash.deduplicated(df)
    assert left.columns == df.columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == [5, 8, 9, None]


def brute_stays(docs: list[tuple], min_similarity: float = 0.8) -> set:
    """doc_ids that stay when each text is compared with all that stay before it."""
    stays: list[tuple] = []
    for i, t in sorted(docs):
        words = t.lower().split()
        own = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
        if not any(t == u or len(own & other) >= min_similarity * len(own | other) for _, u, other in stays):
            stays.append((i, t, own))
    return {i for i, _, _ in stays}


def test_near_copies_are_all_found(spark):
    """Recall against brute force: copies with a tenth or so of the text added, cut or replaced."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    docs = []
    for family in range(40):
        base = [word() for _ in range(rng.choice([8, 60, 200]))]
        docs.append(base)
        for _ in range(3):
            words, n = list(base), max(1, len(base) * rng.randint(4, 20) // 100)
            at = rng.randrange(len(words))
            words[at : at + (n if rng.random() < 0.7 else 0)] = [word() for _ in range(n if rng.random() < 0.7 else 0)]
            docs.append(words)
    rng.shuffle(docs)
    docs = [(i, " ".join(w)) for i, w in enumerate(docs)]
    want = brute_stays(docs)
    assert 50 < len(want) < 140
    left = simhash.deduplicated(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id for r in left.collect()} == want



def test_linked_fingerprints_find_nearly_all_copies(spark):
    """Recall of the covering alone, before shared shingles complete it; texts of the length of documents."""
    rng = random.Random(15)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    vocabulary = [word() for _ in range(3_000)]
    docs, n_copies = [], 0
    for family in range(120):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([120, 300, 500]))]
        docs.append(base)
        for _ in range(2):
            words = list(base)
            for _ in range(max(1, len(words) // 60)):
                words[rng.randrange(len(words))] = word()
            docs.append(words)
            n_copies += 1
    texts = spark.createDataFrame([(i, " ".join(w).encode()) for i, w in enumerate(docs)], "n long, text binary")
    linked = simhash._linked(texts)
    pairs = {(r.n, r.first) for r in simhash._linked_pairs(linked, 64).where("first >= 0").collect()}
    assert sum((i, i - i % 3) in pairs for i in range(len(docs)) if i % 3) >= 0.9 * n_copies
    assert all(a // 3 == b // 3 for a, b in pairs)  # unlike texts are hardly ever linked
    assert linked.where("n >= 0").count() > 0 and simhash._linked(texts.limit(0)).count() == 0


def test_sketches_part_unlike_texts_and_no_alike_ones(spark):
    """A group with a common passage makes no rows but for texts that may be alike, in both passes; no alike pair is parted."""
    rng = np.random.default_rng(16)
    for _ in range(300):
        a = rng.integers(0, 1 << 63, rng.integers(1, 400), dtype=np.uint64)
        b = np.unique(np.concatenate([a[: len(a) - rng.integers(0, len(a) // 5 + 1)], rng.integers(0, 1 << 63, rng.integers(0, len(a) // 5 + 1), dtype=np.uint64)]))
        a = np.unique(a)
        turned = sum((int(x) ^ int(y)).bit_count() for x, y in zip(simhash.sketch(a).view(np.uint64), simhash.sketch(b).view(np.uint64)))
        assert turned <= len(np.setxor1d(a, b))
    passage = [f"passage{k}" for k in range(60)]
    texts = [[*passage, *(f"own{i // 2}x{k}" for k in range(40)), *["end"] * (i % 2)] for i in range(200)]
    texts = spark.createDataFrame([(i, " ".join(t).encode()) for i, t in enumerate(texts)], "n long, text binary")
    want = {(i, i - 1) for i in range(1, 200, 2)}
    sets = simhash._shingle_sets(texts).cache()
    pairs = lambda met: [(r.n, r.first) for r in met.where("first >= 0").collect()]
    cells = simhash._sketched(simhash._postings(texts, 0.8).select("key", "n"), sets).cache()
    assert sorted(pairs(simhash._met(cells, 200, 0.8))) == sorted(want)
    assert {r.n for r in simhash._met(cells, 4, 0.8).where("first < 0").collect()} >= set(range(8, 200))
    one_key = texts.select(F.lit(1).cast("long").alias("key"), "n", F.lit(0).cast("long").alias("fp"))
    assert sorted(pairs(simhash._linked_pairs(simhash._sketched(one_key, sets), 200, 0.8))) == sorted(want)
    assert len(pairs(simhash._linked_pairs(one_key, 200))) == 200 * 199 // 2


def test_table_marks_keep_tables_apart():
    marks = [simhash._table_mark(t) for t in range(simhash.TABLES)]
    assert all((a ^ b).bit_count() >= 4 for i, a in enumerate(marks) for b in marks[:i]) and max(marks) < 2**63
    prints = simhash.word_fingerprints([b"", b"One two two", b"one TWO two", b"three"])
    assert prints.shape == (4, simhash.TABLES) and (prints[1] == prints[2]).all() and (prints[0] == np.array(marks, dtype=np.uint64)).all()


def test_every_family_of_a_large_group_is_examined(spark):
    """Ten orders of the same words, and twenty texts with a common passage, each with a copy of its own."""
    rng = random.Random(14)
    words = [f"longword{k}" for k in range(120)]
    passage = [f"passage{k}" for k in range(150)]
    docs = []
    for family in range(30):
        base = rng.sample(words, len(words)) if family < 10 else [*passage, *(f"own{family}x{k}" for k in range(35))]
        docs += [base, [*base[:-1], "end"]]
    docs = [(i, " ".join(w)) for i, w in enumerate(docs)]
    want = brute_stays(docs)
    assert len(want) == 30
    assert {r.doc_id for r in simhash.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == want


def test_copies_are_known_by_their_own_text(spark):
    rng = random.Random(13)
    one, two, three = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(50)) for _ in range(3))
    near = one.rsplit(" ", 1)[0] + " other"
    docs = [(1, one), (2, near), (2, two), (3, one), (None, two), (None, three), (None, three + " more"), (None, None), (4, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = lambda left: sorted(((r.doc_id, r.text) for r in left.collect()), key=str)
    named = [(1, one), (2, two), (4, "")]
    assert rows(simhash.deduplicated(df)) == sorted(named + [d for d in docs if d[0] is None], key=str)
    left = rows(corpus_pipeline.near_dedup(spark, df, ""))
    assert len(left) == 4 and set(named) <= set(left) and [t for i, t in left if i is None][0] in (three, three + " more")


# ---------------------------------------------------------------- PII

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text: str) -> list[tuple]:
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = "".join(re.findall("[0-9]", m[0]))
            good = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def test_base_spans_follow_the_expressions():
    rng = random.Random(0)
    for _ in range(20_000):
        text = "".join(rng.choice(["1", "2", "5", "0", ".", "-", " ", "@", "a", "b.c", "+", "(", "%", "4111111111111111", "é"]) for _ in range(rng.randint(0, 30)))
        assert [(s.start, s.rank, s.kind, s.end) for s in pii.find(text) if s.rank < 4] == base_spans(text), text


def test_added_kinds_need_checks_or_context():
    kinds = lambda t: [s.kind for s in pii.find(t) if s.kind in pii.ADDED_KINDS]
    assert kinds("bank GB82 WEST 1234 5698 7654 32 ok") == ["iban"]
    assert kinds("bank GB83 WEST 1234 5698 7654 32 ok") == []
    assert kinds("iban or serial GB82WEST12345698765432") == ["iban"] and kinds("serial GB82WEST12345698765432") == []
    assert kinds("code 123-45-6789") == [] and kinds("social security 123-45-6789") == ["ssn"]
    assert kinds("socially insecurity 123-45-6789") == [] and kinds("SSN: 123-45-6789, part of an order") == []
    assert kinds('token = "24be64439e3e49cf46b2d7c90f3602a3"') == ["secret"] and kinds('dummy token = "24be64439e3e49cf46b2d7c90f3602a3"') == []


def test_context_is_whole_words():
    score = lambda t: pii.find(t)[0].score
    plain = score("x 10.0.0.1")
    assert score("recipe 10.0.0.1") == plain < score("the IP 10.0.0.1") and score("version 10.0.0.1") < plain
    assert score("the hotel +1 389 555 5010") == score("x +1 389 555 5010") < score("tel +1 389 555 5010")
    far = "q" * 46 + " "
    assert score(f"ip {far}10.0.0.1") == plain  # only a part of the word is near
    assert pii.context_words("aip bb 10.0.0.1 cc", 7, 15) == {"aip", "bb", "cc"} and pii.context_words("", 0, 0) == set()


def test_pii_job(spark):
    docs = [(1, "mail a@b.co, call +1 (389) 555-5010"), (2, None), (3, ""), (4, "é 10.0.0.1 é"), (None, "4111 1111 1111 1111"), (1, "x")]
    df = spark.createDataFrame([(i, t, "s") for i, t in docs], "doc_id long, text string, found string")
    rows = pii.digest(pii.detect(df)).collect()
    for (i, t), r in zip(docs, rows):
        want = ",".join(f"{k}:{s}:{e}" for s, _, k, e in base_spans(t or ""))
        assert (r.doc_id, r.base_sha256) == (i, hashlib.sha256(want.encode()).hexdigest())
    assert [r.n_email for r in rows] == [1, 0, 0, 0, 0, 0] and rows[3].spans == "ip:2:10"
    clean = pii.redacted(df)
    assert clean.columns == df.columns
    assert [r.text for r in clean.collect()] == ["mail <EMAIL>, call <PHONE>", None, "", "é <IP> é", "<CARD>", "x"]
    assert pii.detect(df.limit(0)).count() == 0


def test_addresses_with_thousands_of_zeros():
    for part in range(4):
        parts = ["1", "1", "1", "1"]
        parts[part] = "0" * 5000 + "7"
        text = "ip " + ".".join(parts)
        assert [(s.kind, s.start, s.end) for s in pii.find(text) if s.kind == "ip"] == [("ip", 3, len(text))]
        parts[part] = "0" * 5000 + "256"
        assert not [s for s in pii.find("ip " + ".".join(parts)) if s.kind == "ip"]
    assert [s.kind for s in pii.find("000.0.00.0")] == ["ip"]


def test_long_texts_are_linear():
    for text in ("1" * 100_000, "a" * 100_000 + "@", "+1" * 50_000, "1." * 50_000, "AB12 " * 20_000):
        pii.find(text)


# ---------------------------------------------------------------- decontamination


def test_decontamination(spark):
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([15, 30, 45])))) for k in range(6)] + [(90, "tiny one"), (91, None), (92, ""), (93, "Tiny, ONE!")]
    docs = []
    for i in range(40):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        item = items[i % 6][1].split()
        if i % 4 == 0:
            words[len(words) // 2 : len(words) // 2] = item
        if i % 4 == 1:
            item[len(item) // 2] = "changed"
            words[len(words) // 2 : len(words) // 2] = item
        docs.append((i, " ".join(words)))
    docs += [(50, None), (51, ""), (52, "a Tiny one b"), (53, items[0][1].upper()), (None, items[1][1])]
    df = spark.createDataFrame([(i, t, "e") for i, t in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.hits(df, bench).collect()}

    def bag(words):
        return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()

    want = set()
    for i, t in docs:
        words = decontamination.normal_words((t or "").encode())
        for k, item in items:
            own = decontamination.normal_words((item or "").encode())
            width = min(len(own), len(words))
            for start in range(len(words) - width + 1) if own and words else ():
                a, b = bag(words[start : start + width]), bag(own)
                common = sum((a & b).values())
                if common / (sum(a.values()) + sum(b.values()) - common) >= 0.8:
                    want.add((i, k))
    assert found == want and len(found) > 12
    left = decontamination.clean(df, bench)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == {i for i, _ in docs} - {i for i, _ in want}
    assert decontamination.hits(df, bench.limit(0)).count() == 0 and decontamination.hits(df.limit(0), bench).count() == 0


def test_clean_judges_rows_by_their_own_text(spark):
    item = " ".join(f"i{k}" for k in range(20))
    docs = [(None, "a clean text"), (None, f"x {item} y"), (1, "another clean text"), (1, item), (2, item), (3, None), (None, None)]
    left = decontamination.clean(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([docs[0], docs[2], docs[5], docs[6]], key=str)


def test_multi_index_finds_all_within_the_radius():
    rng = random.Random(2)
    prints = np.stack([decontamination.fingerprint(np.array([rng.getrandbits(64) for _ in range(26)], dtype=np.uint64)) for _ in range(80)])
    index, asked = decontamination.MultiIndex(prints), []
    for _ in range(60):
        print_ = prints[rng.randrange(80)].copy()
        for _ in range(rng.randint(0, 130)):
            print_[rng.randrange(32)] ^= 1 << rng.randrange(8)
        asked.append(print_)
    want = [(i, k) for i, p in enumerate(asked) for k in range(80) if int(np.bitwise_count(prints[k] ^ p).sum()) <= decontamination.RADIUS]
    assert list(zip(*(x.tolist() for x in index.within(np.stack(asked))))) == want and want
    assert len(decontamination.MultiIndex(np.zeros((0, 32), np.uint8)).within(np.stack(asked))[0]) == 0


@pytest.mark.parametrize("at_once", [7, 4096])
def test_passages_against_every_window(monkeypatch, at_once):
    """All windows of every item's length, each with its own fingerprint and similarity."""
    monkeypatch.setattr(decontamination, "_STARTS_AT_ONCE", at_once)
    rng = random.Random(6)
    items = [(k, " ".join(f"t{rng.randrange(30)}" for _ in range(rng.choice([6, 9, 14, 40]))).encode()) for k in range(12)]
    index = decontamination.ItemIndex(items)
    for _ in range(40):
        words = [f"t{rng.randrange(30)}".encode() for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            words[len(words) // 2 : len(words) // 2] = rng.choice(items)[1].split()
        hashes = np.asarray(decontamination.word_hashes().of(words))
        best = Counter()
        for k, text in items:
            own, width = text.split(), min(len(text.split()), len(words))
            b = decontamination.shingle_hashes(decontamination.word_hashes().of(own))
            for start in range(len(words) - width + 1) if words else ():
                a = decontamination.shingle_hashes(hashes[start : start + width])
                s = decontamination.similarity(a, b)
                if s >= 0.8 and int(np.bitwise_count(decontamination.fingerprint(a) ^ decontamination.fingerprint(b)).sum()) <= decontamination.RADIUS:
                    best[k] = max(best[k], s)
        found = Counter()
        for _, k, _, _, s in decontamination._marked(index, [0], [hashes], 0.8):
            found[k] = max(found[k], s)
        assert found == best


def test_fingerprints_decide_which_items_are_compared(monkeypatch):
    """Without the multi-index nothing is found; at the least similarity its recall is whole."""
    rng = random.Random(8)
    items = [(k, " ".join(f"t{rng.randrange(4000)}" for _ in range(60)).encode()) for k in range(150)]
    index, texts = decontamination.ItemIndex(items), []
    for _, text in items:
        words = text.split()
        words[20] = b"other"  # 5 of 56 shingles: similarity 51 / 61
        texts.append(b" ".join(words))
    hashes = [np.asarray(decontamination.word_hashes().of(t.split())) for t in texts]
    found = decontamination._marked(index, list(range(150)), hashes, 0.8)
    assert [(r[0], r[1]) for r in found] == [(k, k) for k in range(150)]
    monkeypatch.setattr(decontamination.MultiIndex, "within", lambda self, p: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    assert not decontamination._marked(index, list(range(150)), hashes, 0.8)


def test_slices_of_the_benchmark_give_the_same_hits(spark, monkeypatch):
    rng = random.Random(9)
    items = [(k, " ".join(f"t{rng.randrange(50)}" for _ in range(25))) for k in range(9)]
    docs = [(i, f"before {items[i % 9][1]} after " * (1 + i % 3)) for i in range(30)] + [(99, " ".join(f"t{rng.randrange(50)}" for _ in range(60_000)))]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, decontamination.hits(df, bench).collect()))
    monkeypatch.setattr(decontamination, "MAX_ITEM_WORDS", 60)
    assert sorted(map(tuple, decontamination.hits(df, bench).collect())) == whole and len(whole) == 60


# ---------------------------------------------------------------- URL filters


def test_url_filters(spark):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("a.b.c.net", "", "block"), ("a.b.c.net", "", "allow"), ("EXAMPLE.com", "/en/x", "allow"), (None, "/", "block")]
    urls = ["http://www.example.com/en/a", "https://Example.COM/en/", "https://example.com/en/x?q#f", "http://notexample.com/en/a", "http://com/", "http://x.net/es/1", "http://net", "http://q.a.b.c.net", "http://a.b.c.net:80/", "no scheme", None, "", "http://", "ftp://b-net/es/", "http://example.com?x/en/", "http://example.com.net/es/"]
    urls = urls + urls[:3]
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    found = {r.page_id: r for r in url_filter.judged(df, spark.createDataFrame(rules, url_filter.RULES_SCHEMA), partitions=3).collect()}
    assert len(found) == len(urls)
    for i, url in enumerate(urls):
        rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h) + len(p), h.lower() + p, v) for h, p, v in rules if h and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
        best = max(fits) if fits else (0, None, "allow")
        assert (found[i].host, found[i].path, found[i].rule, found[i].verdict) == (host, path, best[1], best[2]), url
    none = url_filter.judged(df, spark.createDataFrame([], url_filter.RULES_SCHEMA))
    assert none.where("verdict = 'allow' and rule is null").count() == len(urls)
    assert url_filter.judged(df.limit(0), spark.createDataFrame(rules, url_filter.RULES_SCHEMA)).count() == 0


# ---------------------------------------------------------------- HTML


def test_blocks_of_marked_articles():
    page = "<head><title>no</title></head><nav>menu</nav><article><header><h1>T &amp; t</h1></header><p>a <em>b</em>c<br/>d<p>e&nbsp;f<div class='advert'>buy</div><section id=comments><p>first!</section></article><footer>f"
    assert html_text.page_blocks(page) == (["T & t", "a bc d", "e f"], [])
    assert html_text.page_blocks("") == ([], [])
    assert html_text.page_blocks("<script>var t='<p>x</p>'</script><p>y<!-- <p>z") == ([], ["y"])


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(6)

    def length(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        places = html_text.shared_lines(a, b)
        assert places == sorted(set(places)) and len(places) == length(a, b)
        rest = iter(b)
        assert all(any(a[i] == y for y in rest) for i in places)


def test_page_differencing(spark):
    page = lambda *own: "<body>" + "".join(f"<div>{x}</div>" for x in ("Site menu", *own, "All rights")) + "</body>"
    rows = [
        (1, "http://h/a/1", page("one is the story of the first page", "two")), (2, "http://h/a/2", page("three is the story of the second page")), (3, "http://h/b", None),
        (4, None, ""), (5, "http://solo/x", page("alone")), (6, "http://c/1", page("same copy")), (7, "http://c/2", page("same copy")), (8, "http://m/1", "<main><p>kept &lt;b&gt;</main><p>gone"), (1, "http://m/1", "<main><p>again</main>"),
    ]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    found = sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract(df, partitions=1).collect())
    texts = [(i, t) for i, t, _ in found]
    assert texts == sorted([
        (1, "one is the story of the first page\n\ntwo"), (1, "again"), (2, "three is the story of the second page"), (3, ""), (4, ""), (5, "Site menu\n\nalone\n\nAll rights"),
        (6, "Site menu\n\nsame copy\n\nAll rights"), (7, "Site menu\n\nsame copy\n\nAll rights"), (8, "kept <b>"),
    ])
    assert all(n == len(t) for _, t, n in found)
    assert html_text.extract(df.limit(0)).count() == 0


def test_columns_named_like_ours_do_not_clash(spark):
    df = spark.createDataFrame([(1, "a b c", 5)], "doc_id long, text string, fp int")
    assert simhash.deduplicated(df).columns == ["doc_id", "text", "fp"]
    assert simhash.clustered(df).count() == 1
    assert pii.detect(df.withColumn("kind", F.lit(1))).count() == 1
